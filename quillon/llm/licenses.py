"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a line of a document or, so that wrapped notices are found, a window of as many words as the template's notice
has, and one more for each that the threshold lets miss, wherever lines and paragraphs end. Wider blocks, as whole
paragraphs, are not compared: a stray "nd" in them would make cc-by-nd of a notice of cc-by-nc. A template is a set of words. Words are ordered by their
frequency in the corpus, rare ones first. A template of k words meets the threshold in a block if the block has at least ``ceil(threshold * k)`` of
them, so it must have one of the template's first ``k - ceil(threshold * k) + 1`` words (prefix filter); a block of
fewer words than that is too short (length filter); and while the template's words are looked up in order, it is given
up when the words left cannot make up the overlap (positional filter). Every block of every document is compared;
windows with the templates that the document as a whole meets. Of windows that overlap one with most of the template is
reported, with the line it begins in, if no line in it or around it has as much.

The base phrases are looked for by themselves, as words in sequence, and keep their labels.

Defined results: a null, empty or wordless text has no words, no places and no labels; repeated documents get a row
each; templates of equal words are each reported; empty tables give no rows; further columns are kept by ``scan`` and
those with its names are overwritten.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Mapping
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.decontam import FOLD
from quillon.llm.shared import built, ship, slices, text_buffer

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices by which public licenses are granted, and sentences of the shorter ones (label, notice).
TEMPLATES = (
    ("agpl", "licensed under the gnu affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2.0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsl-1.0", "distributed under the boost software license version 1.0"),
    ("cc-by-nc", "licensed under cc by nc 4.0"),
    ("cc-by-nd", "licensed under cc by nd 4.0"),
    ("cc-by-sa", "licensed under cc by sa 4.0"),
    ("cc0", "dedicated to the public domain under the cc0 1.0 universal deed"),
    ("epl-2.0", "made available under the terms of the eclipse public license 2.0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    ("proprietary", "no part of this publication may be reproduced without the prior written permission of the publisher"),
    ("reserved", "all rights reserved"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
)

FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_base", T.LongType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", T.StringType()),
        T.StructField("labels", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("blocks", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("line", T.LongType()), T.StructField("containment", T.DoubleType())]))),
    ]
)
_BLOCK = pa.struct([("label", pa.string()), ("line", pa.int64()), ("containment", pa.float64())])
_ARROW = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(_BLOCK)]


def words(text: str) -> list[bytes]:
    return text.encode().translate(FOLD).split()


def least(size: int, percent: int) -> int:
    """The fewest of a template's words that meet the threshold."""
    return (size * percent + 99) // 100


class Matcher:
    """Templates with their words in the global order, and the words by which they are found."""

    def __init__(self, templates, phrases: Mapping[str, str], frequency: Mapping[bytes, int], percent: int):
        self.phrases = [(b" " + b" ".join(words(p)) + b" ", label) for p, label in phrases.items()]
        self.templates, self.prefix = [], {}
        for label, notice in templates:
            order = sorted(set(words(notice)), key=lambda w: (frequency.get(w, 0), w))
            need = least(len(order), percent)
            for w in order[: len(order) - need + 1]:
                self.prefix.setdefault(w, []).append(len(self.templates))
            self.templates.append((label, order, need, len(words(notice)) + len(order) - need))
        self.rare = frozenset(self.prefix)

    def places(self, folded: bytes) -> tuple[int, list[int], set[str]]:
        """Number of words, where the phrases start (word numbers), and their labels. folded: words with spaces between."""
        found, labels = [], set()
        for phrase, label in self.phrases:
            at = folded.find(phrase)
            if at >= 0:
                labels.add(label)
            while at >= 0:
                found.append(at)
                at = folded.find(phrase, at + 1)
        found.sort()
        numbers, done, n = [], 0, 0
        for at in found:
            n += folded.count(b" ", done, at)
            numbers.append(n)
            done = at
        return max(0, folded.count(b" ") - 1), numbers, labels

    def block(self, block: list[bytes]) -> list[tuple[int, float]]:
        """Templates (numbers) whose threshold a block meets, with their containment."""
        have = set(block)
        hits = []
        for t in {t for w in self.rare & have for t in self.prefix[w]}:
            _, order, need, _ = self.templates[t]
            if len(have) < need:
                continue
            overlap = 0
            for i, w in enumerate(order):
                overlap += w in have
                if overlap + len(order) - i - 1 < need:
                    break
            else:
                hits.append((t, overlap / len(order)))
        return hits

    def blocks(self, data: bytes, every: list[bytes]) -> list[tuple[int, int, float]]:
        """(template, line, containment) of the lines and windows of a text that meet a threshold. every: its words."""
        whole = self.block(every)
        if not whole:
            return []
        lines = data.split(b"\n")
        split = [line.translate(FOLD).split() for line in lines]
        starts = [0, *accumulate(map(len, split))]
        found, by_line = [], {}  # by_line: by template, first and last + 1 word of the lines found, and their containment
        for number, line in enumerate(split):
            for t, containment in self.block(line):
                found.append((t, number, containment))
                by_line.setdefault(t, []).append((starts[number], starts[number + 1], containment))
        for t, _ in whole if len(lines) > 1 else ():
            for a, b, containment in self.windows(t, every):
                if not any(x >= containment for x in _nested(by_line.get(t, []), a, b)):
                    found.append((t, bisect_right(starts, a) - 1, containment))
        return found

    def windows(self, t: int, every: list[bytes]):
        """[first, last) words and containment of the windows that meet a template's threshold: of each run of windows
        that overlap, the first one with most, cut to the template's words in it."""
        _, order, need, size = self.templates[t]
        known = set(order)
        mine = [(i, w) for i, w in enumerate(every) if w in known]
        count: dict[bytes, int] = {}
        low, best = 0, None
        for i, w in mine:
            count[w] = count.get(w, 0) + 1
            while mine[low][0] <= i - size:
                gone = mine[low][1]
                count[gone] -= 1
                if not count[gone]:
                    del count[gone]
                low += 1
            if best and mine[low][0] >= best[1]:
                yield best
                best = None
            if len(count) >= need and (best is None or len(count) / len(order) > best[2]):
                best = (mine[low][0], i + 1, len(count) / len(order))
        if best:
            yield best


def _nested(seen: list[tuple[int, int, float]], a: int, b: int):
    """Containments of the blocks seen, which are in order and apart, that lie in [a, b) or around it."""
    i = bisect_left(seen, (a,))
    if i and seen[i - 1][1] >= b:
        yield seen[i - 1][2]
    while i < len(seen) and seen[i][0] < b:
        c, d, containment = seen[i]
        if d <= b or c == a:
            yield containment
        i += 1


def word_frequencies(documents: DataFrame, vocabulary: frozenset[bytes], text: str = "text") -> dict[bytes, int]:
    """How often each word of the templates occurs in all documents. At most len(vocabulary) rows reach the driver."""
    ship(documents.sparkSession)

    def count(batches):
        total: Counter = Counter()
        for batch in batches:
            raw, off = text_buffer(batch.column(0))
            for i, j in slices(off):
                # between texts stands a line feed, so that no word runs over
                folded = b"\n".join(raw[off[k] : off[k + 1]].tobytes() for k in range(i, j)).translate(FOLD)
                total.update(filter(vocabulary.__contains__, folded.split()))
        yield pa.RecordBatch.from_pydict({"word": list(total), "n": list(total.values())}, schema=pa.schema([("word", pa.binary()), ("n", pa.int64())]))

    rows = documents.select(F.col(f"`{text}`")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["word"]): r["n"] for r in rows}


def scan(documents: DataFrame, text: str = "text", templates=TEMPLATES, phrases: Mapping[str, str] = PHRASES, percent: int = 90) -> DataFrame:
    """Adds the columns of FOUND to every document; ``percent`` is the containment threshold."""
    ship(documents.sparkSession)
    vocabulary = frozenset(w for _, notice in templates for w in words(notice))
    frequency = word_frequencies(documents, vocabulary, text)
    shipped = documents.sparkSession.sparkContext.broadcast((tuple(templates), dict(phrases), frequency, percent))
    own = [c for c in documents.columns if c not in FOUND.names]
    kept = documents.select(*[F.col(f"`{c}`") for c in own])
    place = own.index(text)

    def run(batches):
        matcher = built(shipped, lambda x: Matcher(*x))
        for batch in batches:
            raw, off = text_buffer(batch.column(place))
            for i, j in slices(off):
                rows = [_row(matcher, raw[off[k] : off[k + 1]].tobytes()) for k in range(i, j)]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)]
                yield pa.RecordBatch.from_arrays(list(batch.slice(i, j - i).columns) + columns, names=own + FOUND.names)

    return kept.mapInArrow(run, T.StructType(list(kept.schema) + list(FOUND)))


def _row(matcher: Matcher, data: bytes) -> tuple:
    all_words = data.translate(FOLD).split()
    n, places, base = matcher.places(b" " + b" ".join(all_words) + b" " if all_words else b"")
    blocks, labels, score = [], set(base), 0.0
    if not matcher.rare.isdisjoint(all_words):
        for t, number, containment in matcher.blocks(data, all_words):
            label = matcher.templates[t][0]
            blocks.append({"label": label, "line": number, "containment": containment})
            labels.add(label)
            score = max(score, containment)
    if base:
        score = 1.0
    return n, len(places), places[0] if places else None, places[-1] if places else None, ",".join(sorted(base)), ",".join(sorted(labels)), score, blocks


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def _sql() -> str:
    values = ", ".join(f"({i}, '{label}', '{notice}')" for i, (label, notice) in enumerate(TEMPLATES))
    split = lambda x: f"list_filter(regexp_split_to_array(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
    phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in PHRASES.items())
    return f"""
with t as (select t, label, list_distinct({split('notice')}) tw from (values {values}) v(t, label, notice)),
tt as (select t, label, len(tw) k, unnest(tw) w from t),
ph as (select * from (values {phrases}) v(phrase, label, k)),
d as (select doc_id, {split("coalesce(text, '')")} ws, coalesce(text, '') x from documents),
pl as (select doc_id, i - 1 pos, label from d, ph, unnest(range(1, len(ws) - k + 2)) r(i) where len(ws) >= k and array_to_string(ws[i : i + k - 1], ' ') = phrase),
base as (select doc_id, count(*) n, min(pos) lo, max(pos) hi, string_agg(distinct label, ',' order by label) labels from pl group by 1),
ln as (select doc_id, l, unnest(list_distinct({split('line')})) w from (select doc_id, generate_subscripts(lines, 1) l, unnest(lines) line from (select doc_id, string_split(x, chr(10)) lines from d))),
m as (select doc_id, l, t, label, count(*) / any_value(k) c from ln join tt using (w) group by 1, 2, 3, 4 having 100 * count(*) >= 90 * any_value(k)),
own as (select doc_id, max(c) c from m group by 1),
lab as (select doc_id, string_agg(distinct label, ',' order by label) labels from (select doc_id, label from m union select doc_id, label from pl) group by 1)
select d.doc_id, len(ws)::bigint n_words, coalesce(base.n, 0)::bigint n_base, lo::bigint first_word, hi::bigint last_word, coalesce(base.labels, '') base_labels,
       coalesce(lab.labels, '') labels, case when base.n > 0 then 1.0::double else coalesce(c, 0)::double end score
from d left join base using (doc_id) left join own using (doc_id) left join lab using (doc_id)
"""


SQL = _sql()
