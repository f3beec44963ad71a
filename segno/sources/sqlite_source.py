"""Tables of a SQLite database as a Spark data source: ``segno_sqlite``.

    register(spark)
    spark.read.format("segno_sqlite").option("table", "melody").load("/data/solos.db")

Reading plans its partitions as ranges of row numbers (rowid), a task opens the database read-only and scans its
range in the order of rowid. Filters on columns that compare with a constant go into the scan. Columns have the
kinds that the database declares. The file must be one that all executors can open: a copy or a shared folder.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from segno.shipping import ship_package

#: Rows of a partition, rows that a task hands on at once, and partitions at most.
PARTITION_ROWS, BATCH_ROWS, MOST_PARTITIONS = 250_000, 10_000, 10_000
_COMPARES = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteSource)


def local_path(address: str) -> str:
    parts = urlsplit(address)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"SQLite opens files, not {address}")
    return parts.path if parts.scheme else address


def connect(address: str) -> sqlite3.Connection:
    """Read-only; a file that is not there is an error, not an empty database."""
    return sqlite3.connect(f"file:{quote(local_path(address))}?mode=ro", uri=True)


def _name(identifier: str) -> str:
    return '"' + identifier.replace('"', '""') + '"'


def kind_of(declared: str) -> str:
    """The Spark type of a declared one, by SQLite's own rules of affinity."""
    declared = (declared or "").upper()
    if "INT" in declared:
        return "long"
    if any(x in declared for x in ("CHAR", "CLOB", "TEXT")):
        return "string"
    if "BLOB" in declared or not declared:
        return "binary"
    return "double"


@dataclass
class Rows(InputPartition):
    low: int
    high: int


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "segno_sqlite"

    def schema(self) -> str:
        with connect(self.options["path"]) as db:
            columns = db.execute(f"SELECT name, type FROM pragma_table_info({_literal(self.options['table'])})").fetchall()
        if not columns:
            raise ValueError(f"no table {self.options['table']} in {self.options['path']}")
        return ", ".join(f"`{name}` {kind_of(kind)}" for name, kind in columns)

    def reader(self, schema: StructType) -> DataSourceReader:
        return SqliteReader(self.options["path"], self.options["table"], schema, int(self.options.get("partition_rows", PARTITION_ROWS)))


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: StructType, partition_rows: int):
        self.path, self.table, self.schema, self.partition_rows = path, table, schema, partition_rows
        self.where: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Comparisons of a column with a number or text are taken over; Spark keeps the others."""
        for f in filters:
            sign = _COMPARES.get(type(f))
            if sign and len(f.attribute) == 1 and isinstance(f.value, int | float | str) and not isinstance(f.value, bool):
                self.where.append((f.attribute[0], sign, f.value))
            else:
                yield f

    def partitions(self) -> list[Rows]:
        with connect(self.path) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_name(self.table)}").fetchone()
        if low is None:
            return [Rows(0, 0)]
        step = max(self.partition_rows, -(-(high - low + 1) // MOST_PARTITIONS))
        return [Rows(k, min(k + step, high + 1)) for k in range(low, high + 1, step)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(self.schema)
        columns = ", ".join(_name(f.name) for f in kind)
        also = "".join(f" AND {_name(c)} {sign} ?" for c, sign, _ in self.where)
        with connect(self.path) as db:
            rows = db.execute(f"SELECT {columns} FROM {_name(self.table)} WHERE rowid >= ? AND rowid < ?{also} ORDER BY rowid", (partition.low, partition.high, *[v for *_, v in self.where]))
            while held := rows.fetchmany(BATCH_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), kind, strict=True)], schema=kind)


def write_table(df: DataFrame, path: str, table: str) -> int:
    """Write a table of a new or existing database by one task, as a database has one writer; the number of rows.

    For small tables that a reader of SQLite wants. The rows of a task that runs twice replace those of its first run.
    """
    ship_package(df.sparkSession)
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER", "string": "TEXT", "binary": "BLOB"}
    declared = ", ".join(f"{_name(c)} {kinds.get(kind, 'REAL')}" for c, kind in df.dtypes)
    width, target = len(df.columns), local_path(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = 0
        with sqlite3.connect(target) as db:  # one transaction
            db.execute(f"DROP TABLE IF EXISTS {_name(table)}")
            db.execute(f"CREATE TABLE {_name(table)} ({declared})")
            for batch in batches:
                rows = list(zip(*[c.to_pylist() for c in batch.columns], strict=True))
                db.executemany(f"INSERT INTO {_name(table)} VALUES ({', '.join('?' * width)})", rows)
                count += len(rows)
        yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64())], ["n"])

    return df.coalesce(1).mapInArrow(run, "n long").agg({"n": "sum"}).first()[0]
