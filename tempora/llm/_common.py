"""What the operators of this subpackage share: scratch tables, Arrow text access, skew-proof joins."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The white space that the text operators split and strip at.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Python workers look at this many bytes of text at once.
SLICE_BYTES = 8 << 20
#: The lists of temporary() that are open in a thread.
_AREAS = threading.local()


def scratch(spark: SparkSession) -> str:
    """A new folder name in the shared folder of spark.checkpoint.dir. Where that is unset, a local session gets a folder
    of this machine; on a cluster, whose executors would not see it, it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def saved(df: DataFrame, *partition_by: str) -> DataFrame:
    """The rows as a written table: lineage ends here, and lost executors cost no more than their own tasks."""
    path = scratch(df.sparkSession)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_to = path
    if areas := getattr(_AREAS, "open", None):
        areas[-1].append(table)
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables that saved() wrote, once nothing that is still to be computed reads them."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


class Area(list):
    """Tables that go when their block ends, and those that are kept for the block around it."""

    def __init__(self) -> None:
        super().__init__()
        self.kept: list[DataFrame] = []

    def keep(self, table: DataFrame) -> DataFrame:
        self[:] = [t for t in self if t is not table]
        self.kept.append(table)
        return table


@contextmanager
def temporary() -> Iterator[Area]:
    """What saved() writes inside is deleted at the end, but for what is kept: that is left to the block around this one, if there is one."""
    area, around = Area(), getattr(_AREAS, "open", [])
    _AREAS.open = [*around, area]
    try:
        yield area
    finally:
        _AREAS.open = around
        discard(*area)
        if around:
            around[-1].extend(area.kept)


def free_name(name: str, *tables: DataFrame) -> str:
    """A column name that no table has, in any case of letters."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def lowered(text: Column) -> Column:
    """A-Z as a-z and nothing else. lower() does just that where all characters are ASCII, at a fraction of the cost."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about `most` bytes of text, one row at least. At the end, memory that Arrow holds in
    reserve is given back, since workers outlive their tasks."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(at, to - at)
            at = to
    pa.default_memory_pool().release_unused()


def in_arrow(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """df.mapInArrow() with batches that end at SLICE_BYTES, where the session says nothing else: by default a batch is
    10,000 rows, and so as large as their texts."""
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(bound, None) is None:
        df.sparkSession.conf.set(bound, str(SLICE_BYTES))
    return df.mapInArrow(work, schema)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts as one array (a view), and the offset of each text and of the end. Null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words between ASCII white space of the texts, one after another, and each text's first word's place."""
    buffers = [None, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(np.ascontiguousarray(data))]
    lists = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, buffers))
    flat, ends = lists.values, lists.offsets.to_numpy()
    keep = pc.not_equal(pc.binary_length(flat), 0)
    before = np.concatenate([[0], np.cumsum(keep.to_numpy(zero_copy_only=False))])
    return flat.filter(keep), before[ends]


def heavy_keys(counts: DataFrame, count: str, most: int = 1000) -> DataFrame:
    """The keys that hold a share of 1/most or more of all rows: `most` keys at the most, so they can be broadcast."""
    total = counts.agg(F.sum(count)).first()[0] or 0
    return counts.where(F.col(count) * most >= F.lit(max(int(total), most)))


def skew_join(rows: DataFrame, table: DataFrame, key: str, count: str, most: int = 1000) -> DataFrame:
    """rows inner join table on key, where key is unique in table and table[count] is the number of rows that have it.

    Keys with 1/most of the rows or more go by broadcast (there are `most` of them at the most), all others by shuffle.
    """
    heavy = F.broadcast(heavy_keys(table, count, most).drop(count))
    light = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(table.drop(count), key)
    return rows.join(heavy, key).select(light.columns).unionByName(light)
