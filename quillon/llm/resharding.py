"""Resharding by minimum-cost flow: row counts at most one apart, moving the fewest bytes.

Rows lie in old shards; shard j keeps its number if j is a new shard as well. The rows of an old shard are cut into
blocks of like size; a block's cost is the bytes of a row. The flow network has an arc from every old shard to the new
one of its number (cost 0) and an arc for each of its blocks to a pool from which every new shard can draw; new shards
take the even share of rows, and as many as there are left over take one more. The minimum-cost flow says how many rows
each old shard gives to each new one; its smallest rows go.

Whatever the flow, an old shard that is a new one too gives its rows above the share, or all of these but the largest:
that one row, the marginal one, is a block of its own with its exact size, found by counting sizes in ever narrower
ranges. The costs of all other blocks are the same in every solution or never paid, so means do for them and the bytes
moved are the fewest.

Only counts by (old shard, size class) and, for the marginal rows, by ``BINS`` ranges an old shard reach the driver.
Ranks within a group are counted by hash blocks, so no group is put in order as a whole.

Defined results: a null text has no bytes; a null doc_id lies in the old shard of an empty name; repeated documents are
rows of their own; with fewer rows than shards some shards stay empty; an empty table gives no rows; further columns
are not read by ``reshard``, and kept by ``shard_documents`` and ``rewrite``, where those with the names of the added
ones are replaced.
"""

from __future__ import annotations

import heapq

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.shared import materialise, parts_for

OVERHEAD = 8
#: Ranges into which sizes are cut at a time when a row of given rank is looked for.
BINS = 256


class Flow:
    """Minimum-cost flow by successive shortest paths with potentials, on a small network with integer data."""

    def __init__(self):
        self.to, self.room, self.cost, self.out = [], [], [], {}

    def arc(self, u, v, room: int, cost: int) -> int:
        for a, b, r, c in ((u, v, room, cost), (v, u, 0, -cost)):
            self.out.setdefault(a, []).append(len(self.to))
            self.to.append(b)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def used(self, arc: int) -> int:
        return self.room[arc ^ 1]

    def solve(self, source, sink) -> int:
        """Sends as much as it can at the least cost; returns the cost. Costs of arcs are not negative."""
        height, total = dict.fromkeys(self.out, 0), 0
        while True:
            far, by, heap = {source: 0}, {}, [(0, str(source), source)]
            while heap:
                d, _, u = heapq.heappop(heap)
                if d > far[u]:
                    continue
                for e in self.out[u]:
                    v = self.to[e]
                    if self.room[e] > 0 and (x := d + self.cost[e] + height[u] - height[v]) < far.get(v, x + 1):
                        far[v], by[v] = x, e
                        heapq.heappush(heap, (x, str(v), v))
            if sink not in far:
                return total
            worst = max(far.values())
            for u in height:
                height[u] += far.get(u, worst)
            path, v = [], sink
            while v != source:
                path.append(by[v])
                v = self.to[by[v] ^ 1]
            amount = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= amount
                self.room[e ^ 1] += amount
                total += amount * self.cost[e]


def transfers(blocks: list[tuple[int, int, int, int]], n_new: int) -> tuple[dict[int, int], dict[tuple[int, int], int]]:
    """From (old shard, size class, rows, bytes): how many rows stay in each shard, and how many go from one to another.

    New shards must take the even share first, so the arc for the one row more comes at a cost no moves can outweigh.
    """
    total = sum(rows for _, _, rows, _ in blocks)
    if not total:
        return {}, {}
    share, more = divmod(total, n_new)
    heavy = 1 + sum(size for *_, size in blocks)
    net, stay, drawn = Flow(), {}, {}
    by_old: dict[int, int] = {}
    for old, _, rows, size in sorted(blocks):
        by_old[old] = by_old.get(old, 0) + rows
        net.arc(("old", old), "pool", rows, -(-size // rows))
    for old, rows in sorted(by_old.items()):
        net.arc("source", ("old", old), rows, 0)
        if 0 <= old < n_new:
            stay[old] = net.arc(("old", old), ("new", old), rows, 0)
    for new in range(n_new):
        drawn[new] = net.arc("pool", ("new", new), total, 0)
        net.arc(("new", new), "sink", share, 0)
        net.arc(("new", new), "extra", 1, heavy)
    net.arc("extra", "sink", more, 0)
    net.solve("source", "sink")
    kept = {old: net.used(a) for old, a in stay.items()}
    need = {new: net.used(a) for new, a in drawn.items() if net.used(a)}
    moves: dict[tuple[int, int], int] = {}
    for old, rows in sorted(by_old.items()):
        left = rows - kept.get(old, 0)
        for new in sorted(need):
            if left and need[new]:
                take = min(left, need[new])
                moves[old, new] = moves.get((old, new), 0) + take
                need[new] -= take
                left -= take
    return {old: kept.get(old, 0) for old in by_old}, moves


def marginal_ranks(blocks: list[tuple[int, int, int, int]], n_new: int) -> dict[int, tuple[int, int]]:
    """For old shards with more rows than the share: the size class of the marginal row and its rank there, from 0."""
    rows_of: dict[int, int] = {}
    for old, _, rows, _ in blocks:
        rows_of[old] = rows_of.get(old, 0) + rows
    share, more = divmod(sum(rows_of.values()), n_new)
    found = {}
    for old, rows in rows_of.items():
        rank = rows - share - 1
        if not (more and 0 <= old < n_new and rank >= 0):
            continue
        for _, size, n, _ in sorted(b for b in blocks if b[0] == old):
            if rank < n:
                found[old] = (size, rank)
                break
            rank -= n
    return found


def marginal_sizes(table: DataFrame, ranks: dict[int, tuple[int, int]]) -> dict[int, tuple[int, int, int]]:
    """For the rows of these ranks in their (old, class): exact size, and rows and bytes of the class below that size."""
    spark = table.sparkSession
    # by old shard: class, rank left, range [lo, hi) of sizes, rows and bytes before it
    state = {old: (size, rank, (1 << size) >> 1, 1 << size, 0, 0) for old, (size, rank) in ranks.items()}
    while wide := {old: s for old, s in state.items() if s[3] - s[2] > 1}:
        step = {old: max(1, -(-(s[3] - s[2]) // BINS)) for old, s in wide.items()}
        asked = F.broadcast(spark.createDataFrame([(old, s[0], s[2], s[3], step[old]) for old, s in wide.items()], "old int, class int, lo long, hi long, step long"))
        inside = table.join(asked, ["old", "class"]).where("size >= lo and size < hi")
        counts = inside.groupBy("old", F.expr("(size - lo) div step").alias("bin")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
        for old, at, n, size in sorted(map(tuple, counts.collect())):
            kind, rank, lo, hi, rows, total = state[old]
            if (lo, hi) != wide[old][2:4] or rank < 0:
                continue  # found already
            if rank < n:
                state[old] = (kind, rank, lo + at * step[old], min(hi, lo + (at + 1) * step[old]), rows, total)
            else:
                state[old] = (kind, rank - n, lo, hi, rows + n, total + size)
    return {old: (s[2], s[4], s[5]) for old, s in state.items()}


def refined(blocks: list[tuple[int, int, int, int]], ranks: dict[int, tuple[int, int]], sizes: dict[int, tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """The blocks with each marginal row's class cut into the rows before it, itself, and those after it."""
    out = []
    for old, size, rows, total in blocks:
        if old not in ranks or ranks[old][0] != size:
            out.append((old, size, rows, total))
            continue
        rank, (exact, below, below_bytes) = ranks[old][1], sizes[old]
        before = below_bytes + (rank - below) * exact
        parts = ((rank, before), (1, exact), (rows - rank - 1, total - before - exact))
        out += [(old, size, n, b) for n, b in parts if n]
    return out


def ranked(df: DataFrame, group: list[str], order: list[str], rows: int, name: str, first: str | None = None, block_rows: int = 4096) -> DataFrame:
    """Adds the gapless rank from 0 of each row in its group: by `first`, if given, then by hash blocks of `order`.

    Rows are put in order within a (first, hash block) only; the ranks before it come from counts of blocks.
    """
    lead = [first] if first else []
    cut = df.withColumn("__block", F.pmod(F.xxhash64(*order), F.lit(max(1, rows // block_rows))))
    counts = cut.groupBy(*group, *lead, "__block").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*group).orderBy(*lead, "__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    within = F.row_number().over(Window.partitionBy(*group, *lead, "__block").orderBy(*order))
    placed = cut.withColumn("__within", within - 1).join(starts, [*group, *lead, "__block"])
    return placed.withColumn(name, F.col("__start") + F.col("__within")).drop("__block", "__within", "__start")


def plan_rows(sizes: DataFrame, n_new: int) -> DataFrame:
    """sizes (doc_id, size, text_crc32, old, ...): adds shard and slot. The order of rows is (size, crc, doc_id)."""
    spark = sizes.sparkSession
    table = materialise(sizes.withColumn("class", F.length(F.bin("size")).cast("int")).withColumn("__id", F.coalesce("doc_id", F.lit(-1))), "sizes")
    blocks = [tuple(r) for r in table.groupBy("old", "class").agg(F.count("*"), F.sum("size")).collect()]
    total = sum(b[2] for b in blocks)
    ranks = marginal_ranks(blocks, n_new)
    kept, moves = transfers(refined(blocks, ranks, marginal_sizes(table, ranks)), n_new)
    gone: list[tuple[int, int, int]] = []
    for old in kept:
        left = sum(b[2] for b in blocks if b[0] == old) - kept[old]
        for _, size, rows, _ in sorted(b for b in blocks if b[0] == old):
            if left > 0:
                gone.append((old, size, min(left, rows)))
                left -= rows
    ranges, at = [], {}
    for (old, new), rows in sorted(moves.items()):
        ranges.append((old, new, at.get(old, 0), at.get(old, 0) + rows))
        at[old] = at.get(old, 0) + rows
    order = ["text_crc32", "__id"]
    gone_df = F.broadcast(spark.createDataFrame(gone, "old int, class int, quota long"))
    go = table.join(gone_df, ["old", "class"])
    all_rows = {(b[0], b[1]): b[2] for b in blocks}
    cut = [(old, size) for old, size, rows in gone if rows < all_rows[old, size]]  # classes of which only some rows go
    cut_df = F.broadcast(spark.createDataFrame(cut, "old int, class int"))
    whole, some = go.join(cut_df, ["old", "class"], "left_anti"), go.join(cut_df, ["old", "class"], "left_semi")
    some = ranked(some, ["old", "class"], order, total, "r", first="size").withColumn("moves", F.col("r") < F.col("quota")).drop("r")
    leaving = whole.unionByName(some.where("moves").drop("moves")).drop("quota")
    staying = some.where(~F.col("moves")).drop("moves", "quota").unionByName(table.join(gone_df, ["old", "class"], "left_anti"))
    span = F.broadcast(spark.createDataFrame(ranges, "old int, shard int, lo long, hi long"))
    moved = ranked(leaving, ["old"], order, total, "r").join(span, "old").where("r >= lo and r < hi").drop("r", "lo", "hi")
    placed = staying.withColumn("shard", F.col("old")).unionByName(moved.select(*staying.columns, "shard"))
    placed = materialise(placed, "placed")
    return ranked(placed, ["shard"], order, total, "slot").drop("class", "__id")


def measured(documents: DataFrame, old, text: str = "text", *also: str) -> DataFrame:
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return documents.select("doc_id", (F.octet_length(body) + OVERHEAD).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), old.cast("int").alias("old"), *also)


def old_layout(n_old: int):
    """The layout that documents are taken to have: by crc32 of doc_id as text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(n_old))


def _plan(documents: DataFrame, n_new: int, old, *also: str) -> DataFrame:
    plan = plan_rows(measured(documents, old_layout(16) if old is None else old, "text", *also), n_new)
    return plan.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("old").alias("old_shard"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *also)


def reshard(documents: DataFrame, n_new: int = 24, old=None) -> DataFrame:
    """doc_id, size, text_crc32, law, old_shard, shard, slot for every row."""
    return _plan(documents, n_new, old)


ADDED = ("old_shard", "shard", "slot")
#: What tells rows apart: a file and the row's place in it, or a number of its own in a table written down first.
_ROW = ("__file", "__place")


def _identified(documents: DataFrame, columns: list) -> DataFrame:
    """The columns with those of _ROW, the same whenever the frame is read.

    Parquet files that are read as they are number their rows themselves; any other frame is written down first.
    """
    plan = documents._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() == "LogicalRelation" and "_metadata" not in documents.columns:
        try:
            return documents.select(*columns, F.xxhash64("_metadata.file_path").alias(_ROW[0]), F.col("_metadata.row_index").alias(_ROW[1]))
        except AnalysisException:
            pass  # no Parquet files
    return materialise(documents.select(*columns, F.lit(0).cast("long").alias(_ROW[0]), F.monotonically_increasing_id().alias(_ROW[1])), "numbered")


def _placed_documents(documents: DataFrame, n_new: int, old, file_rows: int, moved_only: bool) -> tuple[DataFrame, DataFrame]:
    """Documents with ADDED, dealt out to files of file_rows slots of a shard, in order; and the plan's rows."""
    names = [c for c in documents.columns if c not in ADDED]
    hidden = [F.col(f"`{c}`").alias(f"__own_{i}") for i, c in enumerate(names)]
    numbered = _identified(documents, [*hidden, (old_layout(16) if old is None else old).cast("int").alias("__old")])
    known = [F.col(f"__own_{names.index(c)}").alias(c) for c in ("doc_id", "text")]
    plan = materialise(_plan(numbered.select(*known, "__old", *_ROW), n_new, F.col("__old"), *_ROW), "plan")
    todo = plan.select(*_ROW, *ADDED)
    if moved_only:
        changed = todo.where("old_shard <> shard").select(F.explode(F.array("old_shard", "shard")).alias("shard")).distinct()
        todo = todo.join(F.broadcast(changed), "shard")  # one row a shard at most
    n = parts_for(documents.sparkSession, plan.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"])
    joined = numbered.select(*_ROW, *[f"__own_{i}" for i in range(len(names))]).repartition(n, *_ROW).join(todo.repartition(n, *_ROW), list(_ROW))
    dealt = joined.repartition(n, F.col("shard"), F.floor(F.col("slot") / file_rows)).sortWithinPartitions("shard", "slot")
    return dealt.select(*[F.col(f"__own_{i}").alias(c) for i, c in enumerate(names)], *ADDED), plan.drop(*_ROW)


def shard_documents(documents: DataFrame, n_new: int = 24, old=None, file_rows: int = 5_000) -> DataFrame:
    """documents, whole, with old_shard, shard and slot; rows of a shard lie together in the order of their slots."""
    return _placed_documents(documents, n_new, old, file_rows, False)[0]


def rewrite(spark: SparkSession, folder: str, target: str, n_new: int, file_rows: int = 5_000) -> DataFrame:
    """Reshards a folder of Parquet documents partitioned by `shard` into target, and returns the plan.

    Only shards that lose or get rows are written, in files of file_rows rows at most; the others are left where they
    are in folder, and are those of the plan whose rows all have old_shard = shard and that get none.
    """
    docs = spark.read.parquet(folder)
    out, plan = _placed_documents(docs, n_new, F.col("shard"), file_rows, True)
    out.drop("old_shard", "slot").write.option("maxRecordsPerFile", file_rows).partitionBy("shard").parquet(target)
    return plan


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reshard(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "old_shard")
