"""What the text operators share: tables cut from their lineage, splits, bounded samples, Arrow maps."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that a function of `arrow_map` is given at once, and that cross from the JVM at once; a longer row comes alone.
SLICE_BYTES, BATCH_BYTES = 1 << 20, 4 << 20
_own_dir: list[str] = []  # the folder of a local session without spark.checkpoint.dir


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir.  Only a session in one process may have none: it gets a folder that goes when the process ends."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jvm_dir.get() if jvm_dir.isDefined() else None
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _own_dir:
            _own_dir.append(tempfile.mkdtemp(prefix="chronogrid-"))
            atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
        found = "file://" + _own_dir[0]
    return found.rstrip("/")


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def drop(spark: SparkSession, path: str) -> None:
    files, place = _place(spark, path)
    files.delete(place, True)


def sized(df: DataFrame, rows: int, per_part: int) -> DataFrame:
    """`df`, of `rows` rows about, in parts of `per_part` rows at least: small tables aren't spread over many tasks and files."""
    return df.coalesce(max(1, -(-rows // per_part)))


def cut(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read again: its lineage ends there, and lost executors cost nothing before it.

    The table is a result's, so it stays until the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/chronogrid/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, place = _place(spark, path)
    files.deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


class Workspace:
    """Tables cut from their lineage that go together when the work is done."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.n = spark, f"{shared_dir(spark)}/chronogrid/work-{uuid.uuid4().hex}", 0

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        drop(self.spark, self.path)

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.path}/{self.n}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit(""))) % F.lit(n)


def slices(batch: pa.RecordBatch, rows: int | None = None):
    """`batch` in parts of at most SLICE_BYTES of its strings and lists, and of at most `rows` rows; a longer row is a part of its own."""
    size = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
            size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        elif pa.types.is_nested(column.type):
            size += column.nbytes // max(1, batch.num_rows)
    total, a = np.cumsum(size), 0
    while a < batch.num_rows:
        before = total[a - 1] if a else 0
        e = max(a + 1, int(np.searchsorted(total, before + SLICE_BYTES, side="right")))
        e = min(e, batch.num_rows, a + rows if rows else e)
        yield batch.slice(a, e - a)
        a = e


def arrow_map(df: DataFrame, fn, schema, rows: int | None = None) -> DataFrame:
    """mapInArrow; `fn` is given an iterator of batches that SLICE_BYTES (and `rows`) bound.

    What crosses from the JVM at once is bounded by spark.sql.execution.arrow.maxBytesPerBatch, which is lowered to
    BATCH_BYTES where it is higher.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if _bytes(conf.get(name)) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))

    def run(batches):
        def parts():
            for b in batches:
                yield from slices(b, rows)
                del b
                pa.default_memory_pool().release_unused()  # or the pool keeps the most that any batch took

        yield from fn(parts())

    return df.mapInArrow(run, schema)


def _bytes(said: str) -> int:
    units = {"k": 10, "m": 20, "g": 30}
    said = said.strip().lower().removesuffix("b")
    return int(said[:-1]) << units[said[-1]] if said[-1:] in units else int(said)


def sample_ids(df: DataFrame, bound: int, key: str = "doc_id") -> DataFrame:
    """At most `bound` distinct ids, the same for the same ids whatever the partitions: those with the least hash."""
    ids = df.select(key).where(F.col(key).isNotNull()).distinct()
    return ids.orderBy(F.xxhash64(F.lit("sample"), F.col(key)), F.col(key)).limit(bound)


def sampled_rows(docs: DataFrame, ids: DataFrame, max_chars: int) -> list:
    """Whole rows of `docs` whose id is in `ids` (bounded by its maker), on the driver.

    Texts beyond `max_chars` aren't learned from, so that the rows' size is bounded as well; repeated rows count once.
    """
    found = docs.join(F.broadcast(ids), "doc_id", "inner").where(F.char_length(F.coalesce("text", F.lit(""))) <= max_chars)
    rows = {(r["doc_id"], r["text"]): r for r in found.collect()}
    return [rows[k] for k in sorted(rows, key=lambda k: (k[0], k[1] or ""))]
