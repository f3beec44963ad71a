"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segno.shared import join_counted, settle, shared_folder, written
from segno.shipping import ship_package

__all__ = ["join_counted", "settle", "shared_folder", "written"]


#: Arrow batches are handled in slices of about so many bytes.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just the identifier (long) and the text, under names no other column can clash with."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def id_crc32(id_col: Column) -> Column:
    """crc32 of an identifier written as text; a null identifier counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")))


#: Rows of a few numbers that may be broadcast.
BROADCAST_ROWS = 1_000_000


def without(docs: DataFrame, bad: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """The rows of ``docs`` whose keys are not among the rows of ``bad``; nulls equal nulls.

    ``keys`` maps a column of ``bad`` to a column of ``docs``. The rows to drop go to the texts while they
    are few; more of them are met by a shuffle.
    """
    bad = settle(bad.select(*[F.col(k).alias(f"_bad_{k}") for k in keys]).distinct())
    near = F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad
    met = [own.eqNullSafe(bad[f"_bad_{k}"]) for k, own in keys.items()]
    return docs.join(near, met, "left_anti")


def map_batches(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], dict | None]]) -> DataFrame:
    """Apply a function of Arrow batches to ``df``; ``make`` runs once in each task.

    The function returns a dict of equally long columns (arrays, lists), or None for no rows.
    """
    ship_package(df.sparkSession)
    arrow = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            rows = max(1, batch.num_rows * BATCH_BYTES // max(1, batch.nbytes))
            for k in range(0, batch.num_rows, rows):
                if (out := step(batch.slice(k, rows))) is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def _arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]
