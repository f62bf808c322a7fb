"""What several operators need: the shared folder, materialised steps, and Arrow text buffers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of text are worked on in slices of about so many bytes, so that memory does not follow the Arrow batch.
SLICE_BYTES = 1 << 20
#: Whether the shuffle files of a query are freed when it ends.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCHES, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder all nodes see: spark.checkpoint.dir. Only where it is unset and the master is local, a temporary one is made."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jdir.get() if jdir.isDefined() else None
    if not found:
        found = getattr(spark.sparkContext, "_quillon_dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="quillon-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        found = f"file://{path}"
        spark.sparkContext._quillon_dir = found
    return found.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: the lineage ends there and survives lost executors.

    The write's own shuffle files are of no use after it, so Spark is asked to free them at its end.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillon-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FREED, before) if before is not None else spark.conf.unset(FREED)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillon_path = path
    return out


def discard(step: DataFrame | None) -> None:
    """Removes the files of a step that nothing reads any more; step is what ``materialise`` gave, else nothing happens."""
    path = getattr(step, "_quillon_path", None) if step is not None else None
    if path:
        _remove(step.sparkSession, path)


def small(df: DataFrame, limit: int = 1_000_000) -> DataFrame:
    """df, marked for broadcast if it is counted to have at most `limit` rows (of a few numbers each); else as it is."""
    df = df if hasattr(df, "_quillon_path") else materialise(df, "small")
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session is over; the folder's owner clears it
        return


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(spark: SparkSession, size: int, each: int = 32 << 20, most: int = 500_000) -> int:
    """Shuffle partitions for so many bytes: the session's number, or more (up to `most`) where one would get over `each`."""
    return max(parts(spark), min(most, -(-int(size) // each)))


def size_hint(df: DataFrame) -> int:
    """What Spark takes the frame's bytes to be before it is read; 0 where it does not know."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 56 else 0


def held_out(doc_id="doc_id"):
    """True for the rows no classifier may learn from: crc32(doc_id as text) mod 4 is 2. A null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(True))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a string column; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, limit: int = SLICE_BYTES):
    """Ranges (i, j) of rows with about `limit` bytes each; a longer row stands alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BUILT: dict = {}


def built(shipped, make):
    """make(shipped.value), built once for each worker process and broadcast."""
    value = shipped.value
    if _BUILT.get("of") is not value:
        _BUILT.clear()  # the last one goes before the next is made
        _BUILT.update(of=value, is_=make(value))
    return _BUILT["is_"]


def put_aside(df: DataFrame, names) -> tuple[DataFrame, object]:
    """df with columns of these names renamed, and a function that picks df's columns, renamed back, from what was derived."""
    tag = "__own_"
    clash = {c: tag + c for c in df.columns if c in set(names)}
    columns = [(clash.get(c, c), c) for c in df.columns]
    aside = df.select(*[F.col(f"`{c}`").alias(a) for a, c in columns])
    return aside, lambda out: out.select(*[F.col(f"`{a}`").alias(c) for a, c in columns])


def ship(spark: SparkSession) -> None:
    """Hands this package to the Python workers, for clusters where it is not installed; once a session.

    Texts are long, so rows go to Python in batches of BATCH_ROWS, unless the session asks for another number.
    """
    context = spark.sparkContext
    if spark.conf.get(BATCHES) == "10000":  # the default, meant for short rows
        spark.conf.set(BATCHES, str(BATCH_ROWS))
    if getattr(context, "_quillon_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp(prefix="quillon-zip-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    packed = f"{folder}/quillon-package.zip"
    with zipfile.ZipFile(packed, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, str(source.relative_to(root.parent)))
    context.addPyFile(packed)
    context._quillon_shipped = True
