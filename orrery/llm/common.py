"""Shared helpers of the corpus operators: staging to shared storage, joins that hot keys don't hold up, and small expressions."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. Where none is set, a master that runs everything in one
    process gets a temporary one; any other has no folder that all can see, which is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="orrery-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return f"file://{_own[0]}"


#: Rows that go to a Python worker at a time while a table is staged. Whole texts are long.
ARROW_ROWS = 1000
ARROW_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


class Stage:
    """Written tables that cut lineage. A lost executor costs no recomputation of what is staged. What isn't dropped
    before goes when the driver's JVM ends."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/orrery/{label}-{uuid.uuid4().hex[:12]}"
        path, fs = self._at("")
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def _at(self, name: str) -> tuple:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def put(self, df: DataFrame, name: str) -> DataFrame:
        before = self.spark.conf.get(ARROW_CONF)
        small = not 0 < int(before) <= ARROW_ROWS
        if small:
            self.spark.conf.set(ARROW_CONF, str(ARROW_ROWS))
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/{name}")
        finally:
            if small:
                self.spark.conf.set(ARROW_CONF, before)
            release()
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        for name in names or ("",):
            path, fs = self._at(name)
            fs.delete(path, True)

    def sweep(self, *names: str) -> None:
        """Drops tables at the end of a phase, and lets the driver find the shuffles and broadcasts that nothing reads
        any more, which stay on the executors until its garbage is collected."""
        if names:
            self.drop(*names)
        gc.collect()
        self.spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(col: str = "doc_id") -> Column:
    """crc32 of an id written as decimal text."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


def plain(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text), so that other columns can't clash with those an operator adds."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def rows_of(spark: SparkSession, **columns: object) -> DataFrame:
    """A few rows of the driver's as a frame; by Arrow, since lists would go through Python workers."""
    return spark.createDataFrame(pa.table(columns))


#: Most fixed-width ids that a join broadcasts (under 100 MB as a hash table).
BROADCAST_IDS = 1_000_000
#: The same for digests of 16 or 32 bytes.
BROADCAST_KEYS = 300_000
FIXED = (T.LongType, T.IntegerType, T.ShortType, T.ByteType)


def _ids(ids: DataFrame, stage: Stage) -> DataFrame:
    """One column of ids, staged and marked by how it may be joined: broadcast where a count shows that it is small,
    else as the hash side of a shuffle, which never sorts the other side's rows."""
    kept = stage.put(ids.distinct(), f"ids-{uuid.uuid4().hex[:8]}")
    return sized(kept) if isinstance(ids.schema[0].dataType, FIXED) else kept.hint("shuffle_hash")


def sized(side: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """A staged side of narrow rows of fixed width, marked for broadcast if it has few, else as the hash side of a shuffle."""
    return F.broadcast(side) if side.count() <= most else side.hint("shuffle_hash")


def without(docs: DataFrame, ids: DataFrame, stage: Stage, col: str = "doc_id") -> DataFrame:
    """docs less the rows whose id is in the one column of ids, a null id being equal to a null id. While the ids are
    few no row of docs moves."""
    gone = _ids(ids.toDF("_gone"), stage)
    return docs.join(gone, docs[col].eqNullSafe(gone["_gone"]), "left_anti")


def within(rows: DataFrame, ids: DataFrame, stage: Stage, col: str = "doc_id") -> DataFrame:
    """The rows whose id is in the one column of ids."""
    few = _ids(ids.toDF("_id"), stage)
    return rows.join(few, rows[col] == few["_id"], "left_semi")


#: Rows of one key from which a key counts as hot; there are at most a HOT_SHARE-th as many such keys as rows.
HOT_ROWS, HOT_SHARE = 1000, 1000


def join_split(left: DataFrame, right: DataFrame, key: str | list[str], total: int) -> DataFrame:
    """left joined to right (one row for each key, with `n`, how many rows of left have it, which is left out). Keys with
    over 1 / HOT_SHARE of the rows of left, HOT_SHARE at most, are broadcast, so that no task holds all rows of one; the
    other keys meet in a shuffle."""
    limit = max(HOT_ROWS, total // HOT_SHARE)
    on = [key] if isinstance(key, str) else key
    own = [c for c in right.columns if c not in (*on, "n")]
    hot, cold = right.filter(F.col("n") >= limit), right.filter(F.col("n") < limit).drop("n")
    met = left.join(F.broadcast(hot.withColumn("_hot", F.lit(True)).drop("n")), on, "left")
    near = met.filter("_hot").drop("_hot")
    far = met.filter("_hot is null").drop("_hot", *own).join(cold, on)
    return near.unionByName(far.select(near.columns))


def slices(texts: pa.Array, most: int) -> Iterator[pa.Array]:
    """Runs of texts of about so many bytes, one text at least."""
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
        yield texts.slice(at, stop - at)
        at = stop


#: What a worker process keeps between tasks, by the operator that made it.
_kept: dict[str, dict] = {}


def kept(owner: str) -> dict:
    return _kept.setdefault(owner, {})


def release(owner: str | None = None) -> None:
    """Drops what other operators have left in this worker, and gives memory that it no longer uses back to the system."""
    for other in [k for k in _kept if k != owner]:
        del _kept[other]
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def trimmed(run: Callable[[Iterator], Iterator], owner: str | None = None) -> Callable[[Iterator], Iterator]:
    """A partition function that leaves no memory behind in its worker but what its owner keeps."""

    def outer(batches: Iterator) -> Iterator:
        release(owner)
        try:
            yield from run(batches)
        finally:
            release(owner)

    return outer
