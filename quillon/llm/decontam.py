"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark items, one scan of each text.

Normalising lower-cases A-Z and keeps the words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. Every word of the
benchmark is given one code point, every other word the code point 0, so a document becomes a string with one
character per word and a match's end in it *is* a word offset; word offsets are mapped to byte and then to character
offsets of the original text. An item's windows are its runs of ``window`` words (all of it, if it is shorter).

Defined results: a null or wordless text has no words, no hits and is clean; an item without words is never found;
repeated documents get a row each; items with equal windows are all reported; tables may be empty; further columns
are kept by ``scan`` and names that clash with its own are overwritten.
"""

from __future__ import annotations

import hashlib
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.shared import SLICE_BYTES, built, materialise, put_aside, ship, slices, text_buffer

#: Bytes that are no word characters become spaces, A-Z become a-z; bytes of non-ASCII characters stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_IS_WORD = np.frombuffer(FOLD, np.uint8) != 32

FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("n_items", T.LongType()),
        T.StructField("items_sha256", T.StringType()),
        T.StructField("contaminated", T.BooleanType()),
        T.StructField("items", T.ArrayType(T.LongType())),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    ]
)


class Automaton:
    """The automaton of one benchmark, built from (item_id, text) pairs."""

    def __init__(self, items: list[tuple[int, str | None]], window: int):
        import ahocorasick

        self.window, self.symbols, owners = window, {}, {}
        for item, text in items:
            words = (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()
            coded = "".join(self._symbol(w) for w in words)
            for i in range(max(1, len(coded) - window + 1) if coded else 0):
                owners.setdefault(coded[i : i + window], set()).add(item)
        self.matcher = ahocorasick.Automaton()
        for pattern, who in owners.items():
            self.matcher.add_word(pattern, (len(pattern), tuple(sorted(who))))
        self.matcher.make_automaton()
        self.empty = not owners

    def _symbol(self, word: bytes) -> str:
        n = len(self.symbols) + 1
        return self.symbols.setdefault(word, chr(n if n < 0xD800 else n + 0x800))

    def scan(self, data: bytes, piece: int = 4 << 20) -> tuple[int, list[tuple[int, int]], set[int]]:
        """Number of words, merged [first, last) word runs that are hit, and the items found.

        A very long text is coded piece by piece; the last window - 1 words go before the next piece. Matches that end
        among these were found with the piece before.
        """
        folded, at, n, carry = data.translate(FOLD), 0, 0, ""
        runs: list[tuple[int, int]] = []
        found: set[int] = set()
        while at < len(folded):
            cut = folded.find(b" ", at + piece) if at + piece < len(folded) else -1
            cut = len(folded) if cut < 0 else cut
            words = folded[at:cut].split()
            if not self.empty and words:
                coded = carry + "".join(map(self.symbols.get, words, repeat("\0")))
                base = n - len(carry)
                for end, (length, who) in self.matcher.iter(coded):
                    if end < len(carry):
                        continue
                    first, last = base + end - length + 1, base + end + 1
                    while runs and first <= runs[-1][1]:
                        a, b = runs.pop()
                        first, last = min(first, a), max(last, b)
                    runs.append((first, last))
                    found.update(who)
                carry = coded[max(0, len(coded) - self.window + 1) :] if self.window > 1 else ""
            n, at = n + len(words), cut
        return n, runs, found


def character_spans(data: bytes, runs: list[tuple[int, int]]) -> list[dict]:
    """Word runs as character offsets [start, end) of the original text."""
    raw = np.frombuffer(data, np.uint8)
    word = np.concatenate([[False], _IS_WORD[raw], [False]])
    starts, ends = np.flatnonzero(word[1:-1] & ~word[:-2]), np.flatnonzero(word[1:-1] & ~word[2:]) + 1
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return [{"start": int(chars[starts[a]]), "end": int(chars[ends[b - 1]])} for a, b in runs]


def digest(items) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def scan(documents: DataFrame, benchmark: DataFrame, text: str = "text", window: int = 13, share: int = 20, max_words: int = 900_000) -> DataFrame:
    """Adds the columns of FOUND to every row of documents.

    The automaton goes to each executor as a broadcast; its size is that of the benchmark, which is checked to have
    at most ``12 * max_words`` characters before anything is collected. ``scan_all`` takes a larger one.
    """
    spark = documents.sparkSession
    ship(spark)
    size = _characters(benchmark)
    if size > 12 * max_words:
        raise ValueError(f"the benchmark has {size} characters; raise max_words if an executor can hold its automaton, or scan with scan_all")
    shipped = _shipped(benchmark, window)
    own = [c for c in documents.columns if c not in FOUND.names]
    kept = documents.select(*[F.col(f"`{c}`") for c in own])
    schema = T.StructType(list(kept.schema) + list(FOUND))
    place = own.index(text)

    def run(batches):
        machine = built(shipped, lambda x: Automaton(*x))
        for batch in batches:
            raw, off = text_buffer(batch.column(place))
            for i, j in slices(off, 16 * SLICE_BYTES):
                rows = []
                for k in range(i, j):
                    data = raw[off[k] : off[k + 1]].tobytes()
                    rows.append(_row(data, *machine.scan(data), share))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)]
                yield pa.RecordBatch.from_arrays(list(batch.slice(i, j - i).columns) + columns, names=own + FOUND.names)

    return kept.mapInArrow(run, schema)


def _characters(benchmark: DataFrame) -> int:
    return benchmark.select(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]


def _shipped(benchmark: DataFrame, window: int):
    items = [(r["item_id"], r["text"]) for r in benchmark.select("item_id", "text").collect()]
    return benchmark.sparkSession.sparkContext.broadcast((items, window))


def _row(data: bytes, n: int, runs: list[tuple[int, int]], found: set[int], share: int) -> tuple:
    hit = sum(b - a for a, b in runs)
    return n, hit, len(found), digest(found) if found else _NONE, hit > 0 and share * hit >= n, sorted(found), character_spans(data, runs) if runs else []


def scan_all(documents: DataFrame, benchmark: DataFrame, text: str = "text", window: int = 13, share: int = 20, max_words: int = 900_000) -> DataFrame:
    """``scan`` for a benchmark of any size: one above the bound is cut into blocks within it.

    The documents are written once, with a number each, and scanned with one block after another; what the blocks
    find in a document is written, and united before it is judged.
    """
    spark = documents.sparkSession
    ship(spark)
    if _characters(benchmark) <= 12 * max_words:
        return scan(documents, benchmark, text, window, share, max_words)
    own = [c for c in documents.columns if c not in FOUND.names]
    numbered = materialise(documents.select(*[F.col(f"`{c}`") for c in own], F.monotonically_increasing_id().alias(_NUMBER)), "decontam-documents")
    pieces, n_blocks = _blocks(benchmark, window, 12 * max_words)
    hits = None
    for k in range(n_blocks):
        shipped = _shipped(pieces.where(F.col("block") == k), window)
        found = materialise(numbered.select(_NUMBER, F.col(f"`{text}`")).mapInArrow(_hits(shipped), _HITS), "decontam-hits")
        shipped.unpersist()
        hits = found if hits is None else hits.unionByName(found)
    united = hits.groupBy(_NUMBER).agg(F.flatten(F.collect_list("runs")).alias("__runs"), F.array_distinct(F.flatten(F.collect_list("who"))).alias("__who"))
    kept = numbered.join(united, _NUMBER, "left").select(*[F.col(f"`{c}`") for c in own], "__runs", "__who")
    place = own.index(text)
    schema = T.StructType(list(kept.schema)[:-2] + list(FOUND))

    def run(batches):
        for batch in batches:
            raw, off = text_buffer(batch.column(place))
            for i, j in slices(off, 16 * SLICE_BYTES):
                rows = []
                for k, runs, who in zip(range(i, j), batch.column(len(own)).slice(i, j - i).to_pylist(), batch.column(len(own) + 1).slice(i, j - i).to_pylist(), strict=True):
                    data = raw[off[k] : off[k + 1]].tobytes()
                    rows.append(_row(data, len(data.translate(FOLD).split()), _united(runs or []), set(who or []), share))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)]
                yield pa.RecordBatch.from_arrays(list(batch.slice(i, j - i).columns)[: len(own)] + columns, names=own + FOUND.names)

    return kept.mapInArrow(run, schema)


_NUMBER = "__number"
_HITS = f"{_NUMBER} long, runs array<struct<first:long,last:long>>, who array<long>"


def _hits(shipped):
    """Of documents (number, text), those that are hit by the items shipped, with their word runs and the items."""

    def run(batches):
        machine = built(shipped, lambda x: Automaton(*x))
        runs_type = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        for batch in batches:
            raw, off = text_buffer(batch.column(1))
            numbers, all_runs, who = [], [], []
            for k, number in enumerate(batch.column(0).to_pylist()):
                _, runs, found = machine.scan(raw[off[k] : off[k + 1]].tobytes())
                if runs:
                    numbers.append(number)
                    all_runs.append([{"first": a, "last": b} for a, b in runs])
                    who.append(sorted(found))
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(all_runs, runs_type), pa.array(who, pa.list_(pa.int64()))], names=[_NUMBER, "runs", "who"])

    return run


def _united(runs: list[dict]) -> list[tuple[int, int]]:
    """Word runs of several scans, in order and merged where they meet."""
    out: list[tuple[int, int]] = []
    for first, last in sorted((r["first"], r["last"]) for r in runs):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def _blocks(benchmark: DataFrame, window: int, limit: int) -> tuple[DataFrame, int]:
    """(item_id, text, block) with at most `limit` characters a block where a single piece is not longer, and the number of blocks.

    An item is cut into pieces of about limit / 8 characters that overlap by window - 1 words, so that each of its
    windows is in one of them.
    """
    size = max(1, limit // 8)

    def cut(batches):
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()
                out, a = [], 0
                while a < len(words):
                    b, length = a, 0
                    while b < len(words) and (length < size or b - a < window):
                        length += len(words[b]) + 1
                        b += 1
                    if len(words) - b < window:  # no piece may be shorter than a window, unless the item is
                        b = len(words)
                    out.append(b" ".join(words[a:b]).decode("utf-8", "surrogatepass"))
                    a = len(words) if b == len(words) else b - window + 1
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(out), pa.int64()), pa.array(out, pa.string())], names=["item_id", "text"])

    cuts = materialise(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(cut, "item_id long, text string").distinct(), "decontam-items")
    total = cuts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n"), F.max(F.length("text")).alias("longest")).first()
    n = max(1, -(-2 * total["n"] // limit))
    while True:
        dealt = cuts.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
        most = dealt.groupBy("block").agg(F.sum(F.length("text")).alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
        if most <= max(limit, total["longest"] or 0) or n > 2 * total["n"]:
            return dealt, n
        n *= 2


_ARROW = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]


_NONE = digest([])


def remove_contaminated(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows that are not contaminated, with all their own columns."""
    aside, back = put_aside(documents, FOUND.names)
    return back(scan_all(aside, benchmark, **options).where(~F.col("contaminated")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan_all(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


SQL = """
with recursive dw as (
  select doc_id, list_filter(regexp_split_to_array(lower_ascii, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') ws
  from (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') lower_ascii from documents)),
bw as (
  select item_id, list_filter(regexp_split_to_array(lower_ascii, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') ws
  from (select item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') lower_ascii from benchmark)),
lens as (select distinct least(13, len(ws)) k from bw where len(ws) > 0),
bwin as (select distinct item_id, least(13, len(ws)) k, array_to_string(ws[i : i + least(13, len(ws)) - 1], ' ') win
         from bw, unnest(range(1, greatest(1, len(ws) - 12) + 1)) r(i) where len(ws) > 0),
dwin as (select doc_id, k, i, array_to_string(ws[i : i + k - 1], ' ') win
         from dw, lens, unnest(range(1, len(ws) - k + 2)) r(i) where len(ws) >= k),
hits as (select d.doc_id, d.i, d.k, b.item_id from dwin d join bwin b on d.k = b.k and d.win = b.win),
hitwords as (select doc_id, count(distinct p) n_hit from hits, unnest(range(i, i + k)) r(p) group by doc_id),
hititems as (select doc_id, count(*) n_items, string_agg(cast(item_id as varchar), ',' order by cast(item_id as varchar)) ids
             from (select distinct doc_id, item_id from hits) group by doc_id)
select doc_id, len(ws)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
       sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) contaminated
from dw left join hitwords using (doc_id) left join hititems using (doc_id)
"""
