"""What the operators share: the shared folder, written tables, batch plumbing."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.sources.scratch import fresh

# Executors need no copy of the package: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules["cadenza.llm"])

#: The ASCII white space that separates words.
ASCII_SPACE = r"\x09-\x0D\x20"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: the lineage ends there."""
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(df: DataFrame, rows: int, per_task: int) -> int:
    """Partitions for so many rows, no fewer than the session's shuffle partitions."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))


def by_batch(df: DataFrame, schema, make: Callable[[], Callable[[pa.RecordBatch], dict]]) -> DataFrame:
    """mapInArrow where make() runs once a task and gives the function of a batch: columns by name."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for part in slices(batch):
                got = f(part)
                if got is not None:
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, t) for x, t in zip((got[n] for n in arrow.names), arrow.types, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about so many bytes: very long texts come in small parts."""
    rows = max(1, int(batch.num_rows * most / max(batch.nbytes, 1)))
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def free_name(df: DataFrame, wanted: str) -> str:
    """wanted, with underscores in front until no column of df has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def total(df: DataFrame, *exprs) -> list:
    """One row of aggregates, zeros for an empty table."""
    row = df.agg(*exprs).first()
    return [x or 0 for x in row]


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def kept_batches(df: DataFrame, text_col: str, make: Callable[[], Callable[[list[str]], list[bool]]]) -> DataFrame:
    """The rows of df, all columns as they are, whose text the function made in each task keeps; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = make()
        for batch in batches:
            for part in slices(batch):
                texts = [t or "" for t in part.column(part.schema.get_field_index(text_col)).to_pylist()]
                yield part.filter(pa.array(keep(texts), pa.bool_()))

    return df.mapInArrow(run, df.schema)
