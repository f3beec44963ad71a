"""Compression of vectors to short codes by product quantisation over distinct parts.

Every component becomes an integer and every vector is cut into equal parts. Equal parts at one position
are combined into one row with its weight, on the map side first. Lloyd's rounds run over these weighted
rows: each task sums what it assigns, and a round gives the driver no more than the codebooks' size. In
the end the distinct parts get their code and error once, and both are joined back to the vectors by
position and part. Parts that many vectors share are sent to the vectors (a bounded number of them), all
others meet by a shuffle, so no value overloads a task.

All sums and distances are exact: integers in tasks, decimals between them.

Defined results
---------------
* Vectors that are null, empty or hold a null or a non-finite component are dropped, as are those that
  the number of parts does not divide. A component so large that squared distances leave the range of a
  long counts as non-finite (beyond 2 ** 22 / sqrt(size), some 524,288 for 64 components).
* Vectors of another size than that of the smallest identifier are dropped.
* Identifiers may repeat or be null: each row gets its code. The first codebook takes rows by identifier,
  null last, and rows of one identifier by their integers' bytes. With fewer rows than entries the
  codebooks are smaller.
* Rows with a null label form one group. An empty table gives no rows. Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segno.shipping import ship_package

from .common import join_counted, written

SCALE = 256
PARTS, ENTRIES, ROUNDS = 16, 64, 2


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int, parts: int) -> DataFrame:
    """(vec_id, label, cells) of sound vectors; ``cells`` are floor(scale * x) as 32-bit integers, low byte first."""
    values = vectors[vector_col].cast("array<double>")
    held = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[label_col].alias("label"), values.alias("values"))
    bound = F.lit(2.0**30 / scale) / F.sqrt(F.size("values"))  # squares of differences then sum up to 2 ** 62
    sound = (F.size("values") > 0) & (F.size("values") % parts == 0) & F.forall("values", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < bound))
    held = held.where(F.col("values").isNotNull() & sound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("values")
            numbers = lists.flatten().to_numpy(zero_copy_only=False)
            cells = np.floor(numbers * scale).astype("<i4")
            offsets = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))).astype(np.int32) * 4
            packed = pa.BinaryArray.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(cells)])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), packed], ["vec_id", "label", "cells"])

    label = vectors.schema[label_col].dataType.simpleString()
    return held.mapInArrow(run, f"vec_id long, label {label}, cells binary")


def _parts(rows: DataFrame, parts: int, size: int, *more: str) -> DataFrame:
    """(pos, part) of each vector's parts, ``size`` bytes each."""
    cut = F.substring("cells", F.col("pos") * size + 1, F.lit(size))
    return rows.select(*more, "cells", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("pos")).select(*more, "pos", cut.alias("part"))


def _cells(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("part").to_pylist()), dtype="<i4").reshape(-1, width).astype(np.int64)


def nearest(cells: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of the nearest entry of each row, the lower one of equals."""
    most = max(int(np.abs(cells).max(initial=0)), int(np.abs(entries).max(initial=0)))
    kind = np.float64 if 4 * cells.shape[1] * most * most < 1 << 52 else np.int64  # doubles are exact so far
    a, b = cells.astype(kind), entries.astype(kind)
    far = (b * b).sum(axis=1) - 2 * (a @ b.T)  # the row's own square is the same for all entries
    entry = far.argmin(axis=1)
    return entry, (far[np.arange(len(a)), entry] + (a * a).sum(axis=1)).astype(np.int64)


def _assigned(batch: pa.RecordBatch, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(positions, cells, entries, errors) of a batch of parts; ``books`` is positions x entries x width."""
    pos = batch.column("pos").to_numpy(zero_copy_only=False)
    cells = _cells(batch, books.shape[2])
    entry, error = np.zeros(len(pos), dtype=np.int64), np.zeros(len(pos), dtype=np.int64)
    for p in np.unique(pos):
        own = np.flatnonzero(pos == p)
        entry[own], error[own] = nearest(cells[own], books[p])
    return pos, cells, entry, error


def lloyd_round(distinct: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round over (pos, part, n): floored means of what each entry drew; others stay."""
    ship_package(distinct.sparkSession)
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts * entries, width + 1), dtype=object)
        for batch in batches:
            if not batch.num_rows:
                continue
            pos, cells, entry, _ = _assigned(batch, books)
            weight = batch.column("n").to_numpy(zero_copy_only=False)
            exact = (int(np.abs(cells).max(initial=1)) + 1) * sum(weight.tolist()) < 1 << 62
            kind = np.int64 if exact else object
            held = np.column_stack([cells, np.ones(len(cells), dtype=np.int64)]).astype(kind) * weight.astype(kind)[:, None]
            key = pos * entries + entry
            by = np.argsort(key, kind="stable")
            cut = np.flatnonzero(np.append(True, np.diff(key[by]) != 0))
            sums[key[by][cut]] += np.add.reduceat(held[by], cut).astype(object)
        at, column = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(column, pa.int32()), pa.array([str(x) for x in sums[at, column]], pa.string())], ["at", "column", "s"])

    rows = distinct.mapInArrow(run, "at int, column int, s string").groupBy("at", "column").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    total = np.zeros((parts * entries, width + 1), dtype=object)
    for r in rows.collect():  # parts * entries * (width + 1) numbers at most
        total[r["at"], r["column"]] = int(r["s"])
    out = books.reshape(parts * entries, width).copy()
    drawn = np.flatnonzero(total[:, width] > 0)
    out[drawn] = (total[drawn, :width] // total[drawn, width:]).astype(np.int64)
    return out.reshape(books.shape)


def coded(distinct: DataFrame, books: np.ndarray) -> DataFrame:
    """(pos, part, n, entry, error) of distinct parts."""
    ship_package(distinct.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, _, entry, error = _assigned(batch, books)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(entry, pa.int32()), pa.array(error, pa.int64())], [*batch.schema.names, "entry", "error"])

    return distinct.mapInArrow(run, "pos int, part binary, n long, entry int, error long")


def first_codebooks(rows: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """positions x entries x width from the rows of the smallest identifiers; their size is that of the smallest."""
    first = lambda held, n: held.select("vec_id", "cells").orderBy(F.col("vec_id").asc_nulls_last(), "cells").limit(n).collect()
    found = first(rows, entries)
    if not found:
        return None
    size = len(found[0]["cells"])
    if any(len(r["cells"]) != size for r in found):
        found = first(rows.where(F.length("cells") == size), entries)
    held = np.frombuffer(b"".join(bytes(r["cells"]) for r in found), dtype="<i4").astype(np.int64)
    return held.reshape(len(found), parts, -1).transpose(1, 0, 2)


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray | None]:
    """(vec_id, label, code, error) of each sound vector, and the codebooks (positions x entries x width).

    ``code`` has two hexadecimal digits for each part; so there are 256 entries at most.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two digits: 1 to 256 entries")
    spark = vectors.sparkSession
    ship_package(spark)
    rows = integer_vectors(vectors, id_col, vector_col, label_col, scale, parts)
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()))
    books = first_codebooks(rows, parts, entries)
    if books is None:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), None
    size = 4 * books.shape[2]
    rows = rows.where(F.length("cells") == size * parts)
    distinct = written(_parts(rows, parts, size).groupBy("pos", "part").agg(F.count(F.lit(1)).alias("n")))
    for _ in range(rounds):
        books = lloyd_round(distinct, books)

    total = rows.count() * parts
    met = join_counted(_parts(rows, parts, size, "row"), coded(distinct, books), ["pos", "part"], total)
    place = lambda k: F.when(F.floor(F.col("pos") / 8) == k, F.expr("shiftleft(cast(entry as long), 8 * (7 - pos % 8))")).otherwise(F.lit(0).cast("long"))
    digits = range(-(-parts // 8))
    whole = met.groupBy("row").agg(*[F.bit_or(place(k)).alias(f"w{k}") for k in digits], F.sum("error").alias("error"))
    text: Column = F.lower(F.concat(*[F.lpad(F.hex(f"w{k}"), 16, "0") for k in digits])).substr(1, 2 * parts)
    return rows.select("row", "vec_id", "label").join(whole, "row").select("vec_id", "label", text.alias("code"), "error"), books


def codebooks_sha256(books: np.ndarray | None) -> str:
    """Digest of all components by part, entry and position within the part."""
    listed = "" if books is None else ",".join(map(str, books.reshape(-1).tolist()))
    return hashlib.sha256(listed.encode()).hexdigest()


def codes_digest(vectors: DataFrame) -> DataFrame:
    """Codes and errors of the vectors, the error of their label, and a digest of the codebooks."""
    found, books = compress(vectors)
    found = written(found)
    labels = found.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    out = join_counted(found, labels, ["label"], found.count())
    return out.select("vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))


def _sql() -> str:
    steps = []
    for k in range(ROUNDS + 1):
        steps.append(f"""
met{k} AS (
  SELECT pos, part, n, min(d * {ENTRIES} + entry) AS m
  FROM (SELECT p.pos, p.part, n, entry, list_sum(list_transform(range(1, len(p.part) + 1), lambda i: (p.part[i] - b.part[i]) * (p.part[i] - b.part[i])))::BIGINT AS d FROM parts p JOIN book{k} b USING (pos)) GROUP BY ALL),
codes{k} AS (SELECT pos, part, n, m % {ENTRIES} AS entry, m // {ENTRIES} AS error FROM met{k})""")
        if k < ROUNDS:
            steps.append(f"""
means{k} AS (
  SELECT pos, entry, list(x ORDER BY i) AS part
  FROM (SELECT pos, entry, i, floor(sum(n * part[i])::DOUBLE / sum(n)::DOUBLE)::BIGINT AS x FROM (SELECT *, unnest(range(1, len(part) + 1)) AS i FROM codes{k}) GROUP BY ALL) GROUP BY ALL),
book{k + 1} AS (SELECT b.pos, b.entry, coalesce(m.part, b.part) AS part FROM book{k} b LEFT JOIN means{k} m USING (pos, entry))""")
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS (SELECT row, pos, v[pos * (len(v) // {PARTS}) + 1:(pos + 1) * (len(v) // {PARTS})] AS part FROM (SELECT *, unnest(range({PARTS})) AS pos FROM kept)),
parts AS (SELECT pos, part, count(*) AS n FROM cut GROUP BY ALL),
book0 AS (SELECT pos, row AS entry, part FROM cut WHERE row < {ENTRIES}),{",".join(steps)},
whole AS (SELECT row, string_agg(printf('%02x', entry), '' ORDER BY pos) AS code, sum(error)::BIGINT AS error FROM cut JOIN codes{ROUNDS} USING (pos, part) GROUP BY 1),
digest AS (SELECT sha256(string_agg(x, ',' ORDER BY pos, entry, i)) AS codebooks_sha256 FROM (SELECT pos, entry, unnest(part) AS x, unnest(range(len(part))) AS i FROM book{ROUNDS}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN whole USING (row), digest
"""


#: Every step over distinct parts, said in SQL.
SQL = _sql()
