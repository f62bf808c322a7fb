"""N-gram Jaccard join by vertical partitioning.

The global order of n-grams is (frequency class, hash), rare ones first. It is cut into fragments twice:

1. *Frequencies.* Chunks of documents deal their n-grams out to ``parts`` ranges of the hash. A part counts each n-gram
   over all documents and returns, to the chunk, those found in two documents or more with their frequency class.
   An n-gram that a chunk has several times is sent once with its count, so a hot n-gram costs a row a chunk.
   A partner must share 75 % of a document's n-grams, so a document with fewer shared ones is done: it is alone.
2. *Overlaps.* The sets of the others (one for each group of equal sets) are cut into fragments of the global order.
   For candidate pairs each fragment's overlap is counted by itself and the counts are summed per pair.

Candidates share an n-gram of their prefixes. Only components are wanted, so a bucket (a prefix n-gram with its
documents) does not make all its pairs. While many pairs of a bucket are in different components, one of its documents
(its hub, another one each turn, for ``more_hubs`` turns at most) is held against those of other components; at the end
all pairs that are still in different components are held against each other. A pair is left out of a bucket
where its places in the global order exclude a link with this n-gram as the first common one; the bucket of the pair's
first common n-gram has it otherwise. No link between different components is skipped.

A bucket is dealt out to slots of about ``SLOT`` documents: its hub goes to each of them, and at the end its blocks of
slots are held against each other, block by block, so no task gets a whole large bucket. Sets go only to where they are
a candidate's.

Defined results: null, empty and wordless texts have 0 n-grams and are linked with nothing; with fewer than five words
the whole sequence is the one n-gram; repeated documents get a row each; rows of one doc_id with different texts are one
document to ``components``, which is linked by each of its texts, and documents of their own to ``keep_one``; a null
doc_id gets its count and a null component; tables may be empty; other columns are not read. Sets are compared by 48-bit
hashes of their n-grams within one of ``parts`` ranges.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.components import connected_components
from quillon.llm.shared import SLICE_BYTES, discard, materialise, mix64, parts, ship, size_hint, slices, small, text_buffer

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLDED = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)])
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[_FOLDED]
_ROOT = 0xD1342543DE82EF95
_PLACE = mix64(np.arange(1001, 1065, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_LOW = np.uint64((1 << 48) - 1)
#: Fragments of the global order for the second step: frequency classes and, within each, ranges of the hash.
CLASSES, RANGES = 12, 4
#: Documents of a bucket that a task gets together, and how many such slots make a block at the end.
SLOT, BLOCK = 256, 8
#: N-grams of a part in bytes, about; and the most parts, so that a chunk of 64 n-grams for each fits a worker.
PART_BYTES, MOST_PARTS = 32 << 20, 1 << 17
#: Into how many shares a part's n-grams are cut while they are counted.
SHARES = 16
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(SLICE_BYTES, 1 << (n - 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        make = lambda root: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, root, np.uint64)]))
        _POWERS[size] = make(_ROOT), make(pow(_ROOT, -1, 1 << 64))
    return _POWERS[size]


def word_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, A-Z folded, and for each text the range of its words."""
    if len(raw) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    word = ~_SPACE[raw]
    before, after = np.zeros(len(word), bool), np.zeros(len(word), bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    before[off[:-1][off[:-1] < len(raw)]] = False
    after[off[1:][off[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    hashes, i = np.zeros(len(starts), np.uint64), 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + SLICE_BYTES, "right")))
        span = raw[base : ends[j - 1]]
        up, down = _powers(len(span))
        sums = np.zeros(len(span) + 1, np.uint64)
        np.cumsum(_BYTE[span] * up[: len(span)], out=sums[1:])
        at = starts[i:j] - base
        hashes[i:j] = (sums[ends[i:j] - base] - sums[at]) * down[at]
        i = j
    return mix64(hashes), np.searchsorted(starts, off)


def shingle_sets(raw: np.ndarray, off: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    hashes, bounds = word_hashes(raw, off)
    whole = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for k in range(n if len(whole) else 0):
        whole += hashes[k : k + len(whole)] * _PLACE[k]
    whole = mix64(whole)
    sets = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= n:
            s = np.sort(whole[a : b - n + 1])
            sets.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) > 1 else s)
        elif b > a:
            sets.append(mix64((hashes[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64, keepdims=True) + _PLACE[32 + b - a]))
        else:
            sets.append(hashes[:0])
    return sets


def _pack(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


_DEALT = "part long, chunk string, place long, a binary, b binary, c binary, d binary, e binary"
_DEALT_ARROW = pa.schema([("part", pa.int64()), ("chunk", pa.string()), ("place", pa.int64()), *[(c, pa.binary()) for c in "abcde"]])


def _deal(ids: list[int | None], marks: list[int], sets: list[np.ndarray], chunk: str, n_parts: int) -> pa.RecordBatch:
    """The rows of one chunk: a header (place -1), and for each part its n-grams by document and those found twice or more."""
    sizes = np.array([len(s) for s in sets], np.int64)
    grams = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
    part = (((grams >> np.uint64(32)) * np.uint64(n_parts)) >> np.uint64(32)).astype(np.int64)
    grams = grams & _LOW
    order = np.argsort(part.astype(np.uint16) if n_parts <= 65536 else part, kind="stable")
    part, grams, doc = part[order], grams[order], doc[order]
    rows: list[tuple] = []
    repeated = [[], [], []]
    edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else [0]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        g, d, p = grams[a:b], doc[a:b], int(part[a])
        s = np.sort(g)
        twice = np.unique(s[1:][s[1:] == s[:-1]])
        counts = np.zeros(0, np.uint32)
        if len(twice):
            at = np.minimum(np.searchsorted(twice, g), len(twice) - 1)
            several = twice[at] == g
            within = np.argsort(at[several], kind="stable")
            counts = np.bincount(at[several], minlength=len(twice)).astype(np.uint32)
            repeated[0].append(counts)
            repeated[1].append(d[several][within])
            repeated[2].append(twice)
            g, d = g[~several], d[~several]
        rows.append((p, chunk, p, np.bincount(d, minlength=len(sets)).astype(np.uint32).tobytes(), _pack(g), _pack(twice), counts.tobytes(), b""))
    joined = [np.concatenate(x).tobytes() if x else b"" for x in repeated[:2]]
    identity = np.array([[-1 if i is None else i for i in ids], marks], np.int64).tobytes()
    missing = np.array([i is None for i in ids], bool).tobytes()
    rows.append((hash_part(chunk, n_parts), chunk, -1, identity, sizes.astype(np.int32).tobytes(), joined[0], joined[1], missing + _pack(np.concatenate(repeated[2])) if repeated[2] else missing))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _DEALT_ARROW.types, strict=True)], schema=_DEALT_ARROW)


def hash_part(chunk: str, n_parts: int) -> int:
    return sum((i + 1) * ord(c) for i, c in enumerate(chunk)) % n_parts


def _count_part(table: pa.Table) -> pa.Table:
    """Frequencies in one part: keeps, for each chunk, n-grams that two documents or more have, with their class.

    N-grams are counted by their lowest bits, one of SHARES after another, so that beside the part's n-grams only a share
    of them is held in sorted form.
    """
    rows = table.to_pylist()
    data = [r for r in rows if r["place"] >= 0]
    out = [r for r in rows if r["place"] < 0]
    single, several = [_unpack(r["b"]) for r in data], [_unpack(r["c"]) for r in data]
    sizes = [[len(g) for g in single], [len(s) for s in several]]
    late = sum(sizes[0])
    values = np.concatenate([*single, *several]) if data else np.zeros(0, np.uint64)
    times = np.concatenate([np.frombuffer(r["d"], np.uint32) for r in data]) if data else np.zeros(0, np.uint32)
    del single, several
    kind = np.full(len(values), 255, np.uint8)  # 255: one document has it
    lowest = (values & np.uint64(SHARES - 1)).astype(np.uint8)
    for share in range(SHARES if len(values) else 0):
        at = np.flatnonzero(lowest == share)
        if not len(at):
            continue
        at = at[np.argsort(values[at])]
        ranked = values[at]
        first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        weight = np.ones(len(at), np.int64)
        weight[at >= late] = times[at[at >= late] - late]
        df = np.add.reduceat(weight, first)
        classes = np.where(df >= 2, np.minimum(np.log2(df).astype(np.uint8), CLASSES), 255).astype(np.uint8)
        kind[at] = np.repeat(classes, np.diff(first, append=len(at)))
    at = 0
    for r, n, m in zip(data, *sizes, strict=True):
        own = kind[at : at + n]
        keep = own != 255
        docs = np.repeat(np.arange(len(r["a"]) // 4), np.frombuffer(r["a"], np.uint32))
        out.append(r | {"a": np.bincount(docs[keep], minlength=len(r["a"]) // 4).astype(np.uint32).tobytes() if keep.any() else b"", "b": _pack(values[at : at + n][keep]), "c": own[keep].tobytes(), "d": kind[late : late + m].tobytes(), "e": b""})
        at, late = at + n, late + m
    return pa.Table.from_pylist(out, schema=_DEALT_ARROW)


#: row numbers the rows of documents; mark is the text's hash; the first `lead` n-grams of pieces are the prefix.
_SETS = "row long, doc_id long, mark long, n int, shared int, lead int, pieces array<struct<fragment:int,grams:array<long>>>, fp1 long, fp2 long"
_PIECE = pa.struct([("fragment", pa.int32()), ("grams", pa.list_(pa.int64()))])
_SETS_ARROW = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("mark", pa.int64()), ("n", pa.int32()), ("shared", pa.int32()), ("lead", pa.int32()), ("pieces", pa.list_(_PIECE)), ("fp1", pa.int64()), ("fp2", pa.int64())])


def least_overlap(n, percent: int):
    """The fewest n-grams of n that a partner must have."""
    return (n * percent + 99) // 100


def _gather_chunk(table: pa.Table, percent: int) -> pa.Table:
    """Of one chunk: all documents with their sizes, and the ordered sets of those that may have a partner."""
    rows = sorted(table.to_pylist(), key=lambda r: r["place"])
    head, data = rows[0], rows[1:]
    sizes = np.frombuffer(head["b"], np.int32)
    n_docs = len(sizes)
    ids, marks = np.frombuffer(head["a"], np.int64).reshape(2, n_docs)
    task, serial = map(int, head["chunk"].split("-"))
    first = (task << 36) + (serial << 16)
    missing = np.frombuffer(head["e"][:n_docs], bool)
    times, holders, several = np.frombuffer(head["c"], np.uint32), np.frombuffer(head["d"], np.uint16), _unpack(head["e"][n_docs:])
    grams, kinds, docs = [np.repeat(several, times)], [np.repeat(np.frombuffer(b"".join(r["d"] for r in data), np.uint8), times)], [holders.astype(np.int64)]
    for r in data:
        if r["b"]:
            grams.append(_unpack(r["b"]))
            kinds.append(np.frombuffer(r["c"], np.uint8))
            docs.append(np.repeat(np.arange(n_docs), np.frombuffer(r["a"], np.uint32)))
    grams, kinds, docs = np.concatenate(grams), np.concatenate(kinds), np.concatenate(docs)
    shared = np.bincount(docs, minlength=n_docs)
    alive = (shared >= least_overlap(sizes.astype(np.int64), percent)) & (sizes > 0) & ~missing
    keep = alive[docs]
    grams, kinds, docs = grams[keep], kinds[keep], docs[keep]
    order = np.lexsort((grams, kinds, docs))
    grams, kinds, docs = grams[order], kinds[order].astype(np.int64), docs[order]
    fragment = kinds * RANGES + (grams >> np.uint64(46)).astype(np.int64)
    edges = np.searchsorted(docs, np.arange(n_docs + 1))
    cuts = np.flatnonzero(np.concatenate([[True], (docs[1:] != docs[:-1]) | (fragment[1:] != fragment[:-1])])) if len(docs) else np.zeros(0, np.int64)
    signed = grams.astype(np.int64)
    lots = np.searchsorted(cuts, edges)
    out = []
    for k in range(n_docs):
        a, b = edges[k], edges[k + 1]
        row = {"row": first + k, "doc_id": None if missing[k] else int(ids[k]), "mark": int(marks[k]), "n": int(sizes[k]), "shared": int(shared[k]), "lead": None, "pieces": None, "fp1": None, "fp2": None}
        if alive[k]:
            n = int(sizes[k])
            length = n - least_overlap(n, percent) + 1 - (n - int(b - a))
            stops = [*cuts[lots[k] : lots[k + 1]].tolist(), int(b)]
            row["lead"] = max(0, length)
            row["pieces"] = [{"fragment": int(fragment[x]), "grams": signed[x:y]} for x, y in zip(stops[:-1], stops[1:], strict=True)]
            mixed = mix64(grams[a:b])
            row["fp1"], row["fp2"] = int(mixed.sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(mix64(mixed)).view(np.int64))
        out.append(row)
    return pa.Table.from_pylist(out, schema=_SETS_ARROW)


def ngram_sets(documents: DataFrame, text: str = "text", n: int = 5, percent: int = 75, chunk_grams: int | None = None, n_parts: int | None = None) -> DataFrame:
    """Every document with its set's size and, if it may have a partner, its shared n-grams in the global order."""
    spark = documents.sparkSession
    ship(spark)
    # files hold about a third of their n-grams' bytes, and a part is counted by one worker
    n_parts = n_parts or min(MOST_PARTS, max(3 * parts(spark), 3 * size_hint(documents) // PART_BYTES))
    # a chunk has a row for each part: with many parts it is larger, so that the number of rows follows the n-grams
    chunk_grams = chunk_grams or max(1 << 19, 64 * n_parts)

    def deal(batches):
        from pyspark import TaskContext

        me, serial, ids, marks, sets, held = TaskContext.get().partitionId(), 0, [], [], [], 0
        for batch in batches:
            own, own_marks = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            raw, off = text_buffer(batch.column(1))
            for i, j in slices(off):
                lo, hi = off[i], off[j]
                sets += shingle_sets(raw[lo:hi], off[i : j + 1] - lo, n)
                ids += own[i:j]
                marks += own_marks[i:j]
                held += sum(map(len, sets[len(sets) - (j - i) :]))
                while sets and (held >= chunk_grams or len(sets) >= 60_000):
                    take = min(len(sets), 60_000)
                    yield _deal(ids[:take], marks[:take], sets[:take], f"{me}-{serial}", n_parts)
                    ids, marks, sets, serial = ids[take:], marks[take:], sets[take:], serial + 1
                    held = sum(map(len, sets))
        if sets:
            yield _deal(ids, marks, sets, f"{me}-{serial}", n_parts)

    dealt = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), _mark(text).alias("mark")).mapInArrow(deal, _DEALT)
    counted = dealt.groupBy("part").applyInArrow(_count_part, _DEALT)
    gather = lambda table: _gather_chunk(table, percent)
    return counted.groupBy("chunk").applyInArrow(gather, _SETS)


def _mark(text: str):
    return F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with the sum of the overlaps that each fragment has counted by itself. sets: (row, pieces)."""
    asked = small(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct())
    pieces = sets.join(asked, "row", "left_semi").select("row", F.explode("pieces").alias("p")).select("row", "p.fragment", "p.grams")
    left = pairs.join(pieces.select(F.col("row").alias("a"), "fragment", F.col("grams").alias("grams_a")), "a")
    both = left.join(pieces.select(F.col("row").alias("b"), "fragment", F.col("grams").alias("grams_b")), ["b", "fragment"])
    partial = both.select("a", "b", F.size(F.array_intersect("grams_a", "grams_b")).cast("long").alias("overlap"))
    return partial.groupBy("a", "b").agg(F.sum("overlap").alias("overlap"))


def _buckets(sets: DataFrame, percent: int) -> DataFrame:
    """(gram, slots, slot, x, n, place): the documents x of each prefix n-gram that may make a pair."""
    # a place counts the n-grams before it in the global order, those nobody shares first
    prefix = F.slice(F.flatten(F.col("pieces.grams")), F.lit(1), F.col("lead"))
    entries = sets.where("lead > 0").select(F.posexplode(prefix).alias("i", "gram"), F.col("row").alias("x"), "n", "shared").select("gram", "x", "n", (F.col("n") - F.col("shared") + F.col("i")).alias("place"))
    seen = entries.groupBy("gram").agg(F.count("*").alias("m"), F.sum(F.xxhash64("x").cast("decimal(38,0)")).alias("s1"), F.bit_xor(F.xxhash64("x", F.lit(1))).alias("s2"), F.sum("place").alias("order"), F.min("n").alias("least"))
    # buckets of the same documents make the same pairs: the first of them in the global order is enough
    chosen = seen.where("m > 1").groupBy("m", "s1", "s2").agg(F.min(F.struct("order", "gram", "least")).alias("k"))
    buckets = chosen.select("k.gram", "k.least", F.ceil(F.col("m") / SLOT).cast("int").alias("slots"))
    # with this n-gram as the first common one, only a partner of so few n-grams could link; if all have more, the entry ends here
    partner = F.floor((100 + percent) * (F.col("n") - F.col("place")) / percent) - F.col("n")
    slot = F.pmod(F.xxhash64("x", F.lit("slot")), F.col("slots")).cast("int")
    return entries.join(small(buckets), "gram").where(partner >= F.col("least")).select("gram", "slots", slot.alias("slot"), "x", "n", "place")


def _linked_sets(sets: DataFrame, percent: int, more_hubs: int) -> DataFrame:
    """(node, component) of the sets (row, n, shared, lead, pieces) that are linked with others; sets are all different."""
    placed = materialise(_buckets(sets, percent), "buckets")
    side = lambda d, k, on: d.select(*on, *[F.col(c).alias(f"{c}_{k}") for c in ("x", "n", "place", "own")])
    ahead = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    # at the first common n-gram, no more can overlap than lies ahead
    within = (100 * ahead >= percent * (F.col("n_a") + F.col("n_b") - ahead)) & (F.col("x_a") != F.col("x_b")) & (F.col("own_a") != F.col("own_b"))
    pair = [F.least("x_a", "x_b").alias("a"), F.greatest("x_a", "x_b").alias("b"), F.when(F.col("x_a") < F.col("x_b"), F.col("n_a")).otherwise(F.col("n_b")).alias("na"), F.when(F.col("x_a") < F.col("x_b"), F.col("n_b")).otherwise(F.col("n_a")).alias("nb")]

    def linked(met: DataFrame) -> DataFrame:
        crossed = materialise(met.where(within).select(*pair).distinct(), "crossed")
        held = crossed.join(_overlaps(crossed.select("a", "b"), sets.select("row", "pieces")), ["a", "b"])
        links = materialise(held.where(100 * F.col("overlap") >= percent * (F.col("na") + F.col("nb") - F.col("overlap"))).select("a", "b"), "links")
        discard(crossed)
        return links

    known = None
    for turn in range(more_hubs + 1):
        own = placed.withColumn("own", F.col("x")) if known is None else placed.join(known.select(F.col("node").alias("x"), F.col("component").alias("own")), "x", "left").withColumn("own", F.coalesce("own", "x"))
        counts = own.groupBy("gram", "own").agg(F.count("*").alias("c"), F.max("slots").alias("slots")).groupBy("gram").agg(F.max("slots").alias("slots"), F.count("*").alias("k"), F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("q")).where("k > 1")
        counts = counts.select("gram", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), ((F.col("m") * F.col("m") - F.col("q")) / 2).alias("pairs"), "m")
        rest = materialise(own.join(counts, ["gram", "slot"]), "open")
        size = rest.agg(F.coalesce(F.sum(F.col("pairs") / F.col("m")), F.lit(0)).alias("pairs"), F.count("*").alias("rows")).first()
        last = turn == more_hubs or size["pairs"] <= 2 * size["rows"]
        if last:
            # blocks of slots, each against itself and those after it
            block, blocks = F.floor(F.col("slot") / BLOCK).cast("int"), F.ceil(F.col("slots") / BLOCK).cast("int")
            ahead_of = rest.withColumn("i", block).withColumn("j", F.explode(F.sequence(block, blocks - 1)))
            behind = rest.withColumn("j", block).withColumn("i", F.explode(F.sequence(F.lit(0), block)))
            on = ["gram", "i", "j"]
            found = linked(side(ahead_of, "a", on).join(side(behind, "b", on), on).where((F.col("i") < F.col("j")) | (F.col("x_a") < F.col("x_b"))))
        else:
            # a hub for each open bucket, another one each turn, held against the documents of the other components
            # one with few n-grams before this one, as these have least of their own
            early = F.col("place") if turn == 0 else F.floor(16 * F.col("place") / F.col("n"))
            pick = F.struct(early.cast("long").alias("p"), (F.col("x") if turn == 0 else F.xxhash64("x", F.lit(turn))).alias("h"), "x", "n", "place", "own", "slots")
            hub = rest.groupBy("gram").agg(F.min(pick).alias("hub")).select("gram", "hub.*").withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
            on = ["gram", "slot"]
            found = linked(side(hub, "a", on).join(side(rest, "b", on), on))
        discard(rest)
        if not found.isEmpty():
            before, known = known, materialise(connected_components(found), "known") if known is None else _merge(known, found)
            discard(before)
        discard(found)
        if last:
            break
    discard(placed)
    return known if known is not None else sets.sparkSession.createDataFrame([], "node long, component long")


def _merge(known: DataFrame, links: DataFrame) -> DataFrame:
    """The components after further links."""
    label = lambda k: known.select(F.col("node").alias(k), F.col("component").alias(f"c{k}"))
    lifted = links.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).distinct()
    above = connected_components(lifted).select(F.col("node").alias("component"), F.col("component").alias("top"))
    raised = known.join(above, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    new = above.join(known.select("component").distinct(), "component", "left_anti").select(F.col("component").alias("node"), F.col("top").alias("component"))
    return materialise(raised.unionByName(new), "known")


def _grouped(documents: DataFrame, text: str, n: int, percent: int, more_hubs: int, options: dict) -> tuple[DataFrame, DataFrame]:
    """Every row (doc_id, mark, n), and of those that may have a partner (doc_id, mark, comp), comp by links of texts alone."""
    sets = materialise(ngram_sets(documents, text, n, percent, **options), "sets")
    sizes = materialise(sets.select("doc_id", "mark", "n"), "sizes")
    alive = sets.where(F.col("pieces").isNotNull())
    whole = alive.where("shared = n").select("row", "n", "fp1", "fp2")  # only these can have an equal set
    classes = whole.groupBy("n", "fp1", "fp2").agg(F.min("row").alias("rep"), F.count("*").alias("c")).where("c > 1").drop("c")
    copies = materialise(whole.join(small(classes), ["n", "fp1", "fp2"]).where("row <> rep").select("row", "rep"), "copies")
    members = materialise(alive.select("row", "doc_id", "mark").join(small(copies), "row", "left").select("doc_id", "mark", F.coalesce("rep", "row").alias("rep")), "members")
    reps = materialise(alive.join(small(copies), "row", "left_anti").select("row", "n", "shared", "lead", "pieces"), "reps")
    discard(sets)
    discard(copies)
    known = _linked_sets(reps, percent, more_hubs)
    discard(reps)
    label = known.select(F.col("node").alias("rep"), "component")
    return sizes, members.join(small(label), "rep", "left").select("doc_id", "mark", F.coalesce("component", "rep").alias("comp"))


def components(documents: DataFrame, text: str = "text", n: int = 5, percent: int = 75, more_hubs: int = 3, **options) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    sizes, grouped = _grouped(documents, text, n, percent, more_hubs, options)
    of = materialise(grouped.select("doc_id", "comp").distinct(), "of")
    # different texts of one doc_id tie their groups
    ties = of.groupBy("doc_id").agg(F.min("comp").alias("a"), F.count("*").alias("c")).where("c > 1")
    tied = of.join(ties, "doc_id").where("comp <> a").select("a", F.col("comp").alias("b"))
    above = connected_components(tied).select(F.col("node").alias("comp"), F.col("component").alias("top"))
    of = of.join(small(above), "comp", "left").select("doc_id", F.coalesce("top", "comp").alias("comp"))
    smallest = of.groupBy("comp").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most")
    named = materialise(of.join(small(smallest), "comp").select("doc_id", F.col("least").alias("component_id")).distinct(), "named")
    return sizes.select("doc_id", F.col("n").cast("long").alias("n_shingles")).join(small(named), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(documents: DataFrame, text: str = "text", n: int = 5, percent: int = 75, more_hubs: int = 3, **options) -> DataFrame:
    """One document of each group of linked texts, that of the smallest doc_id; a row repeated with its doc_id and text stays once; null ids stay."""
    sizes, grouped = _grouped(documents, text, n, percent, more_hubs, options)
    grouped = materialise(grouped, "grouped")
    first = grouped.groupBy("comp").agg(F.min(F.struct("doc_id", "mark")).alias("f"), F.max(F.struct("doc_id", "mark")).alias("l")).where("f <> l").select("comp", "f")
    gone = grouped.join(small(first), "comp").where((F.col("doc_id") != F.col("f.doc_id")) | (F.col("mark") != F.col("f.mark"))).select("doc_id", "mark", F.lit(True).alias("__gone")).distinct()
    again = sizes.where(F.col("doc_id").isNotNull()).groupBy("doc_id", "mark").count().where("count > 1").select("doc_id", "mark", F.lit(False).alias("__gone"))
    marked = materialise(gone.unionByName(again).groupBy(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")).agg(F.max("__gone").alias("__gone")), "marked")
    names = documents.columns
    own = [F.col(f"`{c}`").alias(f"__own_{i}") for i, c in enumerate(names)]
    rows = documents.select(*own, F.col("doc_id").cast("long").alias("__id"), _mark(text).alias("__mark")).join(small(marked), ["__id", "__mark"], "left")
    back = lambda d: d.select(*[F.col(f"__own_{i}").alias(c) for i, c in enumerate(names)])
    whole = F.struct(*[f"__own_{i}" for i in range(len(names))])
    order = F.xxhash64(*[f"__own_{i}" for i, (_, kind) in enumerate(documents.dtypes) if "map<" not in kind])
    once = rows.where("__gone = false").groupBy("__id", "__mark").agg(F.min_by(whole, order).alias("r")).select("r.*")
    return back(rows.where("__gone is null")).unionByName(back(once))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: Words, shingles, pairs and reachability as plain relations; quick only on small tables.
SQL = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \x09-\x0D]+'), lambda x: x <> '') ws
  from documents),
s as (select distinct doc_id, md5(array_to_string(ws[i : i + 4], ' ')) g from w, unnest(range(1, greatest(1, len(ws) - 4) + 1)) r(i) where len(ws) > 0),
n as (select doc_id, count(*) n from s group by doc_id),
p as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
e as (select a, b from l union select b, a from l),
reach as (select doc_id a, doc_id b from documents union select reach.a, e.b from reach join e on reach.b = e.a)
select doc_id, coalesce(n.n, 0)::bigint n_shingles, m.c component_id
from (select a doc_id, min(b) c from reach group by a) m left join n using (doc_id)
"""
