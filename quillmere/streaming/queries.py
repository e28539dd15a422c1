"""Structured Streaming: the running summary and its surroundings, on files as the source.

Each query runs its stream over all that is there and returns the sink's rows. Checkpoints and
sinks are in the shared folder. Values travel as JSON through an `Endpoint`: a folder here, a
Kafka topic where there are servers.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.operators.summary import COUNTS, IS_WATCHED, SUMMARY_SQL, WATCHED, merge, score_of, scored_posts, summarise
from quillmere.plans.registry import session_query
from quillmere.sources.shared import fresh_path
from quillmere.sources.tables import table

#: The micro-batch intervals of the three programs.
INTERVALS = {"streamer": "1 second", "analyzer": "10 seconds", "aggregator": "30 seconds"}


@dataclass(frozen=True)
class Endpoint:
    """Where values come from or go to: a folder of text files, or a topic of Kafka servers."""

    topic: str
    folder: str | None = None
    servers: str | None = None

    def __post_init__(self) -> None:
        if (self.folder is None) == (self.servers is None):
            raise ValueError("an endpoint has either a folder or servers")

    def read(self, spark: SparkSession) -> DataFrame:
        """The values as a stream of text; Kafka needs its connector among the session's packages."""
        if self.folder:
            return spark.readStream.text(f"{self.folder}/{self.topic}/*")
        stream = spark.readStream.format("kafka").option("kafka.bootstrap.servers", self.servers).option("subscribe", self.topic)
        return stream.load().select(F.col("value").cast("string").alias("value"))

    def publish(self, rows: DataFrame, number: int) -> None:
        """The rows of batch `number` as JSON values. A folder's batch is overwritten if it is
        repeated; Kafka gets it again, and its reader merges by the batch's number."""
        values = encoded(rows.withColumn("batch", F.lit(number).cast("long")))
        if self.folder:
            values.write.mode("overwrite").text(f"{self.folder}/{self.topic}/batch-{number}")
        else:
            values.write.format("kafka").option("kafka.bootstrap.servers", self.servers).option("topic", self.topic).save()


def encoded(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def decoded(values: DataFrame, schema: str) -> DataFrame:
    return values.select(F.from_json("value", schema).alias("row")).select("row.*")


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream; a glob stands for the file, as a stream reads folders."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")


def run(stream: DataFrame, batch: Callable[[DataFrame, int], None], mode: str = "append", checkpoint: str | None = None, interval: str | None = None) -> None:
    """Runs a stream over all its input, a batch at a time, and stops it when no batch is at work.

    With a checkpoint of an earlier run it goes on where that one ended; a batch that was not
    finished then is repeated under its number. With an interval batches begin at that pace.
    """
    writer = stream.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", checkpoint or fresh_path(stream.sparkSession, "stream"))
    started = (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
    try:
        started.processAllAvailable() if interval else started.awaitTermination()
    finally:
        started.stop()


def last_number(spark: SparkSession, path: str, prefix: str) -> int:
    """The greatest number among folders `<prefix><number>` of a path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [f.getPath().getName() for f in where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)]
    return max(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix))


class Summary:
    """The running summary: a version of the table for each batch, made from the one before.

    A batch that is repeated after a failure makes its version anew from the same one, so nothing
    counts twice. Tags are those of the settings table as it is when the batch comes; a tag that
    is no longer watched goes, with what was summed for it.
    """

    def __init__(self, spark: SparkSession, path: str, settings: str) -> None:
        self.spark, self.path, self.settings = spark, path, settings

    def watched(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.spark.read.schema("tag string").parquet(self.settings).distinct(), "tag", "left_semi")

    def begin(self, history: DataFrame) -> None:
        """Version -1: the summary of (tag, sentiment) rows that are stored already."""
        self.watched(summarise(history)).write.mode("overwrite").parquet(f"{self.path}/version={-1}")

    def batch(self, sums: DataFrame, number: int) -> None:
        """Merges a batch's sums by tag."""
        state = self.spark.read.parquet(f"{self.path}/version={number - 1}").select("tag", *COUNTS)
        self.watched(merge(state, sums.select("tag", *COUNTS))).write.mode("overwrite").parquet(f"{self.path}/version={number}")

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/version={last_number(self.spark, self.path, 'version=')}")


def set_tags(spark: SparkSession, settings: str, tags: tuple[str, ...]) -> None:
    """Overwrites the settings table."""
    spark.createDataFrame([(t,) for t in tags], "tag string").coalesce(1).write.mode("overwrite").parquet(settings)


def to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """The stream's rows as a table: appended, or the last complete result.

    A batch overwrites its own folder, so one that is repeated after a failure counts once.
    """
    spark = stream.sparkSession
    path = fresh_path(spark, "sink")
    done: list[int] = []

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")
        done.append(number)

    run(stream, batch, mode)
    if not done:
        return spark.createDataFrame([], stream.schema)
    folders = done if mode == "append" else done[-1:]
    return spark.read.schema(stream.schema).parquet(*(f"{path}/batch={n}" for n in folders))


@session_query("R2 R3 R6", SUMMARY_SQL.format(where=IS_WATCHED))
def stream_sentiment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running summary of watched tags; the state store holds the sums."""
    posts = scored_posts(events_stream(spark, sf_dir).where(F.col("event_type").isin(*WATCHED)))
    return to_table(summarise(posts), "complete")


@session_query("Y4 Y5 Y6", "SELECT event_id AS id, event_type AS tag, CAST(least(4, greatest(0, floor(value / 20))) AS INTEGER) AS sentiment FROM events")
def stream_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to JSON values and back, and an array of them to rows again."""
    events = events_stream(spark, sf_dir)
    post = F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("tag"), score_of(F.col("value")).alias("sentiment"))
    values = events.select(F.to_json(F.array(post)).alias("value"))
    parsed = values.select(F.explode(F.from_json("value", "array<struct<id:long,tag:string,sentiment:int>>")).alias("p"))
    return to_table(parsed.select("p.*"))


@session_query("R4 R9 K5", "SELECT event_id AS id, event_type AS tag, CAST(least(4, greatest(0, floor(value / 20))) AS INTEGER) AS sentiment FROM events WHERE event_type <> 'error'")
def stream_append_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored posts appended to a table partitioned by tag; an empty batch writes nothing."""
    path = fresh_path(spark, "posts")
    rows = events_stream(spark, sf_dir).where("event_type <> 'error'")
    scored = rows.select(F.col("event_id").alias("id"), F.col("event_type").alias("tag"), score_of(F.col("value")).alias("sentiment"))

    def batch(posts: DataFrame, number: int) -> None:
        if not posts.isEmpty():
            posts.write.mode("overwrite").partitionBy("tag").parquet(f"{path}/batch={number}")

    run(scored, batch)
    read = spark.read.option("basePath", path).schema("id long, sentiment int, batch int, tag string").parquet(path)
    return read.select("id", "tag", "sentiment")


@session_query("R7 U1", SUMMARY_SQL.format(where=IS_WATCHED))
def stream_reinit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State that starts from the stored history and goes on with what the stream brings.

    History and stream are parted by id, so nothing counts twice.
    """
    settings = fresh_path(spark, "settings")
    set_tags(spark, settings, WATCHED)
    state = Summary(spark, fresh_path(spark, "summary"), settings)
    state.begin(scored_posts(table(spark, sf_dir, "events").where("event_id % 2 = 0")))
    run(events_stream(spark, sf_dir).where("event_id % 2 = 1"), lambda events, number: state.batch(summarise(scored_posts(events)), number))
    return state.rows()


@session_query("R1 R8 R10 R12", SUMMARY_SQL.format(where="WHERE event_type IN ('click', 'purchase') OR (event_type = 'error' AND event_id % 3 = 2)"))
def stream_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change of the watched tags while posts come: the stream stops gracefully and starts anew.

    Two thirds of the events come under the first settings. Then a settings update overwrites the
    table, and the restarted stream goes on from the same checkpoint with the last third: `view`
    goes with all that was summed for it, `error` counts from then on.
    """
    events = table(spark, sf_dir, "events")
    inbox, checkpoint, settings = (fresh_path(spark, n) for n in ("inbox", "stream", "settings"))
    state = Summary(spark, fresh_path(spark, "summary"), settings)
    for tags, part in ((WATCHED, "event_id % 3 < 2"), (("click", "purchase", "error"), "event_id % 3 = 2")):
        known = set() if part == "event_id % 3 < 2" else {r["tag"] for r in spark.read.parquet(settings).collect()}
        events.where(part).write.mode("append").parquet(inbox)
        if known != set(tags):  # what the watcher of the settings does
            set_tags(spark, settings, tags)
        if not known:
            state.begin(scored_posts(events.limit(0)))
        stream = spark.readStream.schema(events.schema).parquet(inbox)
        run(stream, lambda rows, number: state.batch(summarise(scored_posts(rows)), number), checkpoint=checkpoint, interval=INTERVALS["streamer"])
    return state.rows()


@session_query("R5 S17 K7", SUMMARY_SQL.format(where=""))
def stream_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The analyser appends scored posts and publishes each batch's sums; the aggregator merges what is published."""
    folder = fresh_path(spark, "topics")
    deltas, posts = Endpoint("analyzed", folder), fresh_path(spark, "posts")

    def analyse(events: DataFrame, number: int) -> None:
        scored_posts(events).write.mode("overwrite").partitionBy("tag").parquet(f"{posts}/batch={number}")
        stored = spark.read.schema("sentiment int, tag string").parquet(f"{posts}/batch={number}")
        deltas.publish(summarise(stored).drop("mean"), number)

    run(events_stream(spark, sf_dir), analyse)
    schema = "tag string, " + ", ".join(f"{c} long" for c in COUNTS) + ", batch long"
    settings = fresh_path(spark, "settings")
    tags = table(spark, sf_dir, "events").select(F.col("event_type").alias("tag")).distinct()
    tags.write.parquet(settings)
    state = Summary(spark, fresh_path(spark, "summary"), settings)
    state.begin(scored_posts(table(spark, sf_dir, "events").limit(0)))
    # a delta that was published twice is equal in all columns, its batch among them
    run(decoded(deltas.read(spark), schema), lambda rows, number: state.batch(rows.distinct().groupBy("tag").agg(*(F.sum(c).alias(c) for c in COUNTS)), number))
    return state.rows()
