"""What the operators share: written tables in the cluster's shared folder, and grouping of rows in Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``. Only where that setting is absent and all runs in this one process, as in tests, is a local folder taken."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        root = getattr(spark, "_marlstone_folder", None) or "file://" + tempfile.mkdtemp(prefix="spark-")
        spark._marlstone_folder = root
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, survives the loss of executors and is computed once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, marked further until no column of ``df`` is called so."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = "_" + name
    return name


def in_place(docs: DataFrame, run, schema=None) -> DataFrame:
    """``docs.mapInArrow(run)`` for columns of any name: ``run`` sees those but ``doc_id`` and ``text`` by place, and keeps their order.

    ``schema``: that of the result, by default that of ``docs``."""
    schema = schema or docs.schema
    seen, names = [c if c in ("doc_id", "text") else f"c{k}" for k, c in enumerate(docs.columns)], schema.names

    def named(batches):
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, names=names)

    return docs.toDF(*seen).mapInArrow(named, schema)


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``gone`` (doc_id, digest: the 64-bit hash of the text) names; null ids count like others.

    The names are written first, so their size is known: few of them are broadcast by Spark's own threshold, more are joined by sorting."""
    names = written(gone.distinct(), "gone")
    seen = [c if c in ("doc_id", "text") else f"c{k}" for k, c in enumerate(docs.columns)]
    plain = docs.toDF(*seen)
    return plain.join(names, plain["doc_id"].cast("long").eqNullSafe(names["doc_id"]) & (F.xxhash64(text_of()) == names["digest"]), "left_anti").toDF(*docs.columns)


def text_of(column: str = "text"):
    """A text column as string, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def slices(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that ``column`` has at most ``most_bytes`` in each piece; a single longer row is a piece of its own."""
    for batch in batches:
        at, n = 0, batch.num_rows
        if not n:
            continue
        sizes = np.cumsum(np.array([0 if v is None else v for v in lengths(batch.column(column))], dtype=np.int64))
        while at < n:
            before = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, before + most_bytes, side="right")))
            yield batch.slice(at, end - at)
            at = end
    pa.default_memory_pool().release_unused()  # a worker is kept for other tasks


def lengths(column: pa.Array) -> list[int | None]:
    """Bytes of each value of a string or binary column."""
    import pyarrow.compute as pc

    return pc.binary_length(column).to_pylist()


def as_bytes(column: pa.Array) -> list[bytes]:
    """A string or binary column as bytes, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return [v or b"" for v in column.cast(kind).to_pylist()]


def strings(values: list, kind: pa.DataType) -> pa.Array:
    return pa.array(values, type=kind)
