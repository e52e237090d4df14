"""Helpers that the operators share: reading tables, written scratch tables,
row-wise Arrow maps and per-worker state."""

from __future__ import annotations

import math
import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moodlens.session import scratch_path

#: Rows of a batch that are held as Python objects at a time.
CHUNK_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared scratch folder: computed once, and its
    lineage ends there, so a lost executor costs a reread, not a recomputation."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of :func:`written` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bucket(column: Column | str, n: int) -> Column:
    """``crc32(id as text) mod n``; a null id counts as empty text."""
    c = F.col(column) if isinstance(column, str) else column
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def smallest(df: DataFrame, key: Column, ties: list[str], n: int, total: int | None = None) -> DataFrame:
    """The ``n`` rows with the smallest 64-bit hash ``key`` (equal hashes by ``ties``).

    Hashes are even, so a share of their range that is a little over ``n`` of
    ``total`` (counted here, or a lower estimate) holds those rows.  Only rows of that
    share are ordered: tasks send little more than ``n`` rows together, not ``n`` each.
    """
    total = df.count() if total is None else total
    if total > n:
        share = min(1.0, (n + 8 * math.sqrt(n) + 64) / total)
        df = df.where(F.shiftright(key, 11) <= int(share * 2 ** 53) - 2 ** 52)
    return df.orderBy(key, *ties).limit(n)


def chunks(batches: Iterator[pa.RecordBatch], rows: int = CHUNK_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def byte_lists(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A binary or string column as bytes, null as empty."""
    column = batch.column(batch.schema.get_field_index(name))
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def append(df: DataFrame, text: str, fields: T.StructType,
           each: Callable[[], Callable[[list[bytes]], list]]) -> DataFrame:
    """``df`` with ``fields`` computed from the column ``text``.

    ``each()`` runs once per task and returns a function from a list of texts
    (bytes; null is empty) to one list or array per field.  A column of ``df``
    that has the name of a new field gives way to it.  Rows keep their order
    and number; nothing is shuffled.
    """
    new = {f.name for f in fields}
    rest = [c for c in df.columns if c not in new]
    columns = [F.col(f"`{c}`") for c in rest]
    if text in rest:  # it travels once
        at = rest.index(text)
    else:
        at = len(rest)
        columns.append(F.col(f"`{text}`").alias("__body"))
    given = df.select(*columns)
    schema = T.StructType([*given.schema.fields[:len(rest)], *fields])
    names, n_rest = schema.names, len(rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = each()
        for batch in chunks(batches):
            out = fn([x or b"" for x in batch.column(at).cast(pa.binary()).to_pylist()])
            arrays = [pa.array(x, t) for x, t in zip(out, arrow_types(fields), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_rest], *arrays], names=names)

    return given.mapInArrow(run, schema)


def arrow_types(fields: T.StructType) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in fields]


def worker_state(owner: str) -> dict:
    """An operator's dictionary that lives as long as the Python worker, so
    that later tasks find loaded vocabularies and warm caches.  It is emptied
    when a task of another operator comes: a worker holds the caches of one."""
    name = "_moodlens_worker_state"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
        sys.modules[name].state = {}
    state = sys.modules[name].state
    if state.get("owner") != owner:
        state.clear()
        state["owner"] = owner
    return state
