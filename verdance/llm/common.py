"""What the operators of this subpackage share: the shared folder, skew-proof joins, Arrow views."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that hot_join sends by broadcast: a fixed number of rows, whatever the input.
HOT_KEYS = 1000
#: A key with fewer rows than this is never frequent.
HOT_ROWS = 64
#: Rows and bytes of an Arrow batch of documents.
BATCH_ROWS, BATCH_BYTES = 1000, 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. In local mode one of our own where it is unset;
    on a cluster that is an error, since executors don't see each other's folders."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='verdance-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to a new Parquet folder in the shared folder and returns what it reads back.

    Cuts lineage: a lost executor costs the tasks that read its splits, not the work before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the folders of tables that stored() returned and nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def short_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session: documents are long rows, and a worker holds one batch at a time."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


_tables: dict = {}


def worker_tables(owner: str, make: Callable[[], Any] = dict) -> Any:
    """The tables of an operator in this Python worker, made once. Those of another operator go, so that a worker
    which several operators use in turn doesn't hold all of theirs."""
    if owner not in _tables:
        _tables.clear()
        _tables[owner] = make()
    return _tables[owner]


def hot_join(big: DataFrame, small: DataFrame, on: list[str], weight: str, how: str = "inner") -> DataFrame:
    """big JOIN small, small unique on the keys `on`, where a few keys may hold most of big's rows.

    The HOT_KEYS keys of largest `weight` (the rows of big with that key, HOT_ROWS at least) go by broadcast, which is
    a fixed number of rows; big's other rows meet the rest of small in a shuffle, where no key is
    frequent any more. how: inner, left or left_semi. No row is dropped on either way."""
    hot = small.where(F.col(weight) >= HOT_ROWS).orderBy(F.desc(weight), *on).limit(HOT_KEYS)
    keys = hot.select(*on)
    kind = "left_semi" if how == "left_semi" else "inner"
    near = big.join(F.broadcast(hot), on, kind)
    far = big.join(F.broadcast(keys), on, "left_anti").join(small.join(F.broadcast(keys), on, "left_anti"), on, how)
    return near.unionByName(far)


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    name = f"__vd_{name}"
    while name in taken:
        name += "_"
    return name


def text_md5(text: Column) -> Column:
    return F.unhex(F.md5(text))


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4; rows of fold 2 are held out from all learning."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def bounded_sample(df: DataFrame, key: list[str], bound: int) -> DataFrame:
    """The `bound` rows of df whose hash of the columns key is lowest, all of it if it has no more."""
    n = df.count()
    if n <= bound:
        return df
    h = unused(df, "hash")
    hashed = df.withColumn(h, F.pmod(F.xxhash64(*key, F.lit(7)), F.lit(1 << 40)))
    few = hashed.where(F.col(h) < int(4 * bound / n * (1 << 40)))
    enough = few.limit(bound).count() == bound  # not so where many rows are alike in key
    return (few if enough else hashed).orderBy(h).limit(bound).drop(h)


def utf8_view(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array as uint8, and the n + 1 offsets of its values; nulls are empty."""
    if not pa.types.is_large_string(arr.type):
        arr = arr.cast(pa.large_string())
    if arr.null_count:
        arr = arr.fill_null("")
    _, offsets, data = arr.buffers()
    off = np.frombuffer(offsets, np.int64, len(arr) + 1, arr.offset * 8)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def pieces(offsets: np.ndarray, most: int):
    """Ranges (i, j) of values of about `most` bytes together; a longer value stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j
