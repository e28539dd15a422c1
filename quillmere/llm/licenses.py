"""License scans by winnowed fingerprints and banded alignment (operator 10)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, chunks
from .license_texts import FULL_TEXTS
from .textscan import LOWER, span_hashes, spans, windows

#: Words in a fingerprint, and fingerprints in a window of which the least is kept. A run of
#: GRAM + WINDOW - 1 words in common with a template always has a kept fingerprint in it.
GRAM, WINDOW = 3, 3
#: How far an alignment may leave the diagonal of its fingerprints, in words.
BAND = 8
#: The share of a template's words that must be matched, in order, to report it.
LEAST_COVERAGE = 0.8

# Notices as projects commonly print them, for each kind of grant, the opening of
# some licenses, and full texts. Names of licenses are SPDX identifiers.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
    ],
    "LGPL-2.1": [
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License",
    ],
    "LGPL-3.0": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License",
    ],
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
    ],
    "CC0-1.0": ["This work is licensed under CC0 1.0 Universal.", "This work is marked with CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
for _short, _name in {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}.items():
    for _version, _where in (("4.0", "International"), ("3.0", "Unported")):
        TEMPLATES[f"CC-{_short}-{_version}"] = [
            f"Licensed under CC {_short} {_version}.", f"Creative Commons {_name} {_version} {_where}", f"This work is licensed under a Creative Commons {_name} {_version} {_where} License.",
        ]
for _name, _text in FULL_TEXTS.items():
    TEMPLATES.setdefault(_name, []).append(_text)

# Words are runs of letters and digits, all bytes beyond ASCII among them; case doesn't count.
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, first word of each text)."""
    starts, ends = spans(_IN_WORD[data], bounds)
    return span_hashes(LOWER[data], starts, ends), starts, ends, np.searchsorted(starts, bounds)


def winnow(grams: np.ndarray) -> list[int]:
    """Positions of the least hash of each window, the last of equal ones; all of a short list."""
    if len(grams) <= WINDOW:
        return [len(grams) - 1 - int(grams[::-1].argmin())] if len(grams) else []
    kept: list[int] = []
    for at in range(len(grams) - WINDOW + 1):
        least = at + WINDOW - 1 - int(grams[at : at + WINDOW][::-1].argmin())
        if not kept or kept[-1] != least:
            kept.append(least)
    return kept


class Index:
    """The templates' fingerprints, inverted: hash to (template, position)."""

    def __init__(self, templates: dict[str, list[str]]) -> None:
        self.names = [name for name, texts in templates.items() for _ in texts]
        raw = [text.encode() for texts in templates.values() for text in texts]
        bounds = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        hashes, _, _, first = words(np.frombuffer(b"".join(raw), np.uint8), bounds)
        self.words = [hashes[first[i] : first[i + 1]] for i in range(len(raw))]
        self.postings: dict[int, list[tuple[int, int]]] = {}
        for number, template in enumerate(self.words):
            grams, _ = windows(template, np.array([0, len(template)]), GRAM)
            for at in winnow(grams):
                self.postings.setdefault(int(grams[at]), []).append((number, at))
        self.hashes = np.array(sorted(self.postings), np.uint64)

    def candidates(self, grams: np.ndarray) -> np.ndarray:
        """Where the fingerprints of texts are also some template's."""
        if not len(self.hashes):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, grams), len(self.hashes) - 1)
        return np.flatnonzero(self.hashes[at] == grams)


def align(template: np.ndarray, text: np.ndarray, diagonal: int) -> tuple[int, int, int]:
    """(matched words, first, end) of the best alignment within BAND of the diagonal.

    The whole template is aligned to any stretch of the text: equal words count 1, words left
    out on either side nothing, and of the stretches with most matches the last ending
    earliest, then the one starting latest, is taken. text[t] is on the diagonal of template[t - diagonal].
    """
    width = 2 * BAND + 1
    lowest = -width * 4
    # score and start by offset from the diagonal; row i has seen i words of the template
    score, start = [0] * width, [diagonal + o - BAND for o in range(width)]
    for i, word in enumerate(template.tolist()):
        new_score, new_start = [lowest] * width, [0] * width
        for o in range(width):
            t = i + diagonal + o - BAND  # the text's word that this cell would match
            best, begin = (score[o], start[o]) if 0 <= t < len(text) else (lowest, 0)
            if 0 <= t < len(text) and int(text[t]) == word:
                best = best + 1
                begin = begin if score[o] > 0 else t
            if o + 1 < width and score[o + 1] > best:  # the template's word is left out
                best, begin = score[o + 1], start[o + 1]
            if o and new_score[o - 1] > best:  # the text's word is left out
                best, begin = new_score[o - 1], new_start[o - 1]
            new_score[o], new_start[o] = best, begin
        score, start = new_score, new_start
    best = max(score)
    o = score.index(best)
    begin = max(0, start[o])
    end = min(len(text), len(template) + diagonal + o - BAND)
    return best, begin, end


def within_band(template: np.ndarray, text: np.ndarray, diagonal: int) -> int:
    """How many of the template's words the text has within BAND of their place: no alignment matches more."""
    padded = np.zeros(len(template) + 2 * BAND, np.uint64)
    known = np.zeros(len(padded), bool)
    from_word, to_word = max(0, diagonal - BAND), min(len(text), diagonal - BAND + len(padded))
    if to_word > from_word:
        place = slice(from_word - diagonal + BAND, to_word - diagonal + BAND)
        padded[place], known[place] = text[from_word:to_word], True
    found = np.zeros(len(template), bool)
    for o in range(2 * BAND + 1):
        found |= (padded[o : o + len(template)] == template) & known[o : o + len(template)]
    return int(found.sum())


def matches_in(template: np.ndarray, hashes: np.ndarray, from_word: int, to_word: int, diagonal: int, least: float) -> list[tuple[int, int, int]]:
    """(matched words, first, end) of all matches in a stretch of the text that don't overlap.

    A short template may stand several times within one band: what is left before and after a
    match is aligned again.
    """
    out, stack = [], [(from_word, to_word)]
    while stack:
        start, stop = stack.pop()
        if stop - start < least * len(template) or within_band(template, hashes[start:stop], diagonal - start) < least * len(template):
            continue
        matched, begin, end = align(template, hashes[start:stop], diagonal - start)
        if matched >= least * len(template) and end > begin:
            out.append((matched, start + begin, start + end))
            stack += [(start, start + begin), (start + end, stop)]
    return out


def scan(index: Index, data: np.ndarray, bounds: np.ndarray, least: float = LEAST_COVERAGE) -> list[list[dict]]:
    """For each text its matches: license, coverage, and the span in bytes.

    Of overlapping matches the one with most matched words, less the text's words left out between
    them, is reported, of equal ones the first in order of place, then of the templates.
    """
    hashes, starts, ends, first = words(data, bounds)
    grams, at = windows(hashes, first, GRAM)
    out: list[list[dict]] = [[] for _ in range(len(bounds) - 1)]
    tried: dict[int, set[tuple[int, int]]] = {}
    for hit in index.candidates(grams).tolist():
        place = int(at[hit])
        text = int(np.searchsorted(first, place, "right")) - 1
        for number, where in index.postings[int(grams[hit])]:
            tried.setdefault(text, set()).add((number, place - where))
    for text, pairs in tried.items():
        lo, hi = int(first[text]), int(first[text + 1])
        found = []
        taken: dict[int, int] = {}
        for number, diagonal in sorted(pairs):
            template = index.words[number]
            if number in taken and diagonal - taken[number] <= BAND // 2:
                continue  # the band around the last one holds it
            if within_band(template, hashes[lo:hi], diagonal - lo) < least * len(template):
                continue
            taken[number] = diagonal
            from_word = max(lo, diagonal - 2 * BAND)
            to_word = min(hi, diagonal + len(template) + 2 * BAND)
            for matched, begin, end in matches_in(template, hashes, from_word, to_word, diagonal, least):
                found.append((end - begin - 2 * matched, begin, number, end, matched / len(template)))
        used: list[tuple[int, int]] = []
        for _, begin, number, end, coverage in sorted(found):
            if end > begin and all(end <= a or begin >= b for a, b in used):
                used.append((begin, end))
                span = (int(starts[begin] - bounds[text]), int(ends[end - 1] - bounds[text]))
                out[text].append({"license": index.names[number], "coverage": coverage, "start": span[0], "end": span[1]})
        out[text].sort(key=lambda m: m["start"])
    return out


_MATCH = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))


def _scan_rows(templates: dict[str, list[str]], least: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates)
        for batch in batches:
            for row, end, data, bounds in chunks(batch.column(1)):
                found = scan(index, data, bounds, least)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array(found, _MATCH)], ["doc_id", "matches"])

    return rows


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, least: float = LEAST_COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_matches, license, coverage, matches.

    matches are all reported stretches, in order of place, with byte offsets; license and
    coverage are those of the best covered one, the first of equal ones (null without any).
    Null and empty texts have none. Templates are a parameter, and their index is built by each
    task; it grows with them alone. A template of fewer words than a fingerprint never matches.
    Repeated rows repeat their result; null ids stay null. Other columns are not read. An empty
    table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, matches array<struct<license:string,coverage:double,start:long,end:long>>"
    found = arrow_map(rows, _scan_rows(templates or TEMPLATES, least), schema)
    best = F.array_max(F.transform("matches", lambda m: F.struct(m["coverage"].alias("c"), (-m["start"]).alias("s"), m["license"].alias("l"))))
    return found.select("doc_id", F.size("matches").cast("long").alias("n_matches"), best["l"].alias("license"), best["c"].alias("coverage"), "matches")
