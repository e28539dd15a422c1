"""The programs of the catalogue as users start them: by name and mode, in stages, or side by side."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from quillmere.plans.catalog import QUERIES

#: What a job's numbered modes run.
MODES = {
    "word_pairs": {1: "word_pairs_count", 2: "word_pairs_top200", 3: "word_pairs_total"},
    "edges": {1: "edges_top10k", 2: "edges_broadcast_join", 3: "edges_shuffle_join", 4: "edges_join_equivalence"},
}
#: Jobs of several stages, in the order in which each needs the ones before.
STAGED = {
    "edges": ("edges_top10k", "edges_broadcast_join", "edges_shuffle_join", "edges_join_equivalence"),
    "warehouse": ("ods_users", "ods_posts", "ads_users_with_posts", "dm_users_sex", "dm_users_age"),
}
#: The programs that run at the same time.
CAPSTONE = ("stream_append_table", "stream_deltas", "stream_settings", "dashboard_rows")


def run_mode(spark: SparkSession, sf_dir: str, job: str, mode: int) -> DataFrame:
    """The result of one mode of a job; an unknown one is an error that names those there are."""
    modes = MODES.get(job)
    if modes is None or mode not in modes:
        raise ValueError(f"no mode {mode} of {job}; there are {MODES if modes is None else sorted(modes)}")
    return QUERIES[modes[mode]](spark, sf_dir)


def run_staged(spark: SparkSession, sf_dir: str, job: str) -> Iterator[tuple[str, DataFrame]]:
    """The results of a job's stages, one after another."""
    for name in STAGED[job]:
        yield name, QUERIES[name](spark, sf_dir)


def launch(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = CAPSTONE) -> dict[str, int]:
    """Runs programs at the same time in one session; the rows of each. The first error is raised."""
    with ThreadPoolExecutor(len(names)) as pool:
        return dict(zip(names, pool.map(lambda n: QUERIES[n](spark, sf_dir).count(), names), strict=True))
