"""Helpers that the operators of this folder share."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of text that a Python worker holds as arrays at a time.
CHUNK_CHARS = 2 << 20
#: Rows that a Python worker holds at a time.
CHUNK_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: what ``spark.checkpoint.dir`` says, or (local mode only) a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there, so that a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """The same for wide rows, as Parquet."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


#: Rows of a partition, about, of tables of a few numbers or hashes a row.
PART_ROWS = 4096


def sized(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in partitions of about PART_ROWS of its rows, or those it has if they are fewer: without a shuffle.

    Every task of a stage leaves files behind, so a loop over a small table should not have as many tasks as one over a large table.
    """
    return df.coalesce(max(1, -(-rows // PART_ROWS)))


#: Groups that hold more than one in so many rows are joined apart from the others. There are fewer of them than this number.
HOT = 1024


def met(rows: DataFrame, groups: DataFrame, key: str | list[str], size: str, total: int) -> DataFrame:
    """The rows of which ``groups`` has the key, with its other columns. size: a column of groups, how many rows have the key.

    Groups of more than total / HOT rows, fewer than HOT, are broadcast, so that no task gets all rows of one.
    """
    hot, other = groups.where(F.col(size) * HOT > total).drop(size), groups.where(F.col(size) * HOT <= total).drop(size)
    cold = rows.join(F.broadcast(hot.select(*([key] if isinstance(key, str) else key))), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(cold.join(other, key))


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``docs`` has, whatever their case."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def id_crc(column: str | Column) -> Column:
    """CRC-32 of the identifier as text (of the empty text for null)."""
    return F.crc32(F.coalesce((F.col(column) if isinstance(column, str) else column).cast("string"), F.lit("")).cast("binary"))


def append(docs: DataFrame, text_col: str, fields: list[tuple[str, T.DataType]], work) -> DataFrame:
    """All columns of ``docs`` and new ones after them, which ``work`` makes from a list of texts (a list for each field).

    A field whose name ``docs`` has already must be named by ``fresh`` first.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    place = docs.columns.index(text_col)
    kinds = [to_arrow_type(t) for _, t in fields]
    names = [*docs.columns, *(name for name, _ in fields)]

    def run(batches):
        for batch in batches:
            start = 0
            for (texts,) in pieces([batch.select([place])], 0):
                new = work(texts)
                yield pa.RecordBatch.from_arrays([*batch.slice(start, len(texts)).columns, *(pa.array(c, k) for c, k in zip(new, kinds, strict=True))], names)
                start += len(texts)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(name, t) for name, t in fields)]))


def pieces(batches, text: int = 1):
    """Cut Arrow batches into lists of Python values, one list a column, of bounded text size.

    A single text longer than the bound comes alone; texts are never cut.
    """
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        start, held = 0, 0
        for i, value in enumerate(columns[text]):
            size = len(value or "")
            if i > start and (held + size > CHUNK_CHARS or i - start >= CHUNK_ROWS):
                yield [c[start:i] for c in columns]
                start, held = i, 0
            held += size
        if batch.num_rows > start:
            yield [c[start:] for c in columns]
