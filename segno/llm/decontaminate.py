"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` stores, for every segment of the corpus (an Arrow batch of documents), the postings
of its tokens: the sorted positions of each term in the segment, where documents are set apart by
gaps. Segments live where their documents are, so nothing is shuffled and a lost executor costs its
own segments. ``search`` answers phrase queries on each segment: it orders a phrase's terms by the
length of their postings, starts with the rarest, shifts every list by the term's offset in the
phrase and intersects. Phrases with a term that the segment lacks are dropped at once, all together.

The index may be limited to terms that some query asks for; postings of others could never be read.

Terms are words of ASCII digits and letters (A-Z lower-cased) and any characters beyond ASCII.

Defined results
---------------
* A window is ``width`` consecutive words of an item; an item of fewer words, but not none, is one
  window; an item of none has no window and occurs nowhere.
* A document word inside any occurrence of any window is hit. A null text has no words.
* Identifiers of items are whole numbers or are read as text. Items whose identifier repeats count once. Items without one are
  searched like others and count as one item, which the list of identifiers does not name.
* Every row has a result of its own, those that repeat an identifier or have none too.
* A document is contaminated if it has a hit and at least ``share`` of its words are hit.
* Empty tables: no documents give no rows; no items give rows without hits.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import id_text, map_batches, settle, texts, without

#: The bytes that make words: digits, lower-case letters, everything beyond ASCII; A-Z are lowered.
_WORD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

#: Characters of text after which a segment is closed, at the end of a document.
SEGMENT_CHARS = 8 << 20

#: Bytes of benchmark text that may be broadcast as queries; beyond it the queries go in parts.
QUERY_BYTES = 64 << 20


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORD).split()


Item = int | str | None


def _null_last(item: Item) -> tuple:
    return item is None, item


class Queries:
    """Distinct phrases as rows of term numbers, and the items that hold them."""

    def __init__(self, items: list[tuple[Item, str]], width: int, kind: str | None = None):
        self.width = width
        self.kind = kind or ("string" if any(isinstance(i, str) for i, _ in items) else "long")
        self.terms: dict[bytes, int] = {}
        phrases: dict[tuple[int, ...], int] = {}
        holders: list[set[Item]] = []
        for item, text in items:
            ids = [self.terms.setdefault(w, len(self.terms)) for w in words(text)]
            for k in range(max(1, len(ids) - width + 1) if ids else 0):
                n = phrases.setdefault(tuple(ids[k : k + width]), len(phrases))
                if n == len(holders):
                    holders.append(set())
                holders[n].add(item)
        self.sizes = np.array([len(p) for p in phrases], dtype=np.int64)
        #: Short phrases repeat their first term, which asks for nothing new.
        self.phrases = np.array([p + (p[0],) * (width - len(p)) for p in phrases], dtype=np.int32).reshape(len(phrases), width)
        self.holders = [sorted(h, key=_null_last) for h in holders]


def postings(batch_words: list[list[int]], n_terms: int, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Postings of a segment: where each term's list begins, the positions, where each document begins."""
    starts = np.zeros(len(batch_words) + 1, dtype=np.int64)
    np.cumsum([len(w) + gap for w in batch_words], out=starts[1:])
    flat = np.full(int(starts[-1]), -1, dtype=np.int32)
    for k, ids in enumerate(batch_words):
        flat[starts[k] : starts[k] + len(ids)] = ids
    at = np.flatnonzero(flat >= 0)
    held = flat[at]
    order = np.argsort(held, kind="stable")
    begins = np.zeros(n_terms + 1, dtype=np.int64)
    np.cumsum(np.bincount(held, minlength=n_terms), out=begins[1:])
    return begins, at[order], starts


def _member(sorted_list: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    k = np.searchsorted(sorted_list, wanted)
    k[k == len(sorted_list)] = 0
    return sorted_list[k] == wanted


def phrase_starts(phrase: np.ndarray, size: int, begins: np.ndarray, at: np.ndarray, slop: int = 0) -> tuple[np.ndarray, int]:
    """Positions where a phrase begins, and its rarest term's offset: lists intersected from that term.

    With ``slop`` each further term may stand up to that many words off its place (proximity).
    """
    rarest_first = sorted(range(size), key=lambda k: begins[phrase[k] + 1] - begins[phrase[k]])
    first = rarest_first[0]
    found = at[begins[phrase[first]] : begins[phrase[first] + 1]] - first
    for k in rarest_first[1:]:
        if not len(found):
            break
        places = at[begins[phrase[k]] : begins[phrase[k] + 1]]
        if slop:
            low = np.searchsorted(places, found + k - slop)
            found = found[(low < len(places)) & (places[np.minimum(low, len(places) - 1)] <= found + k + slop)]
        else:
            found = found[_member(places, found + k)]
    return found, first


def build_index(docs: DataFrame, queries: Queries, id_col: str = "doc_id", text_col: str = "text", slop: int = 0) -> DataFrame:
    """A row per segment: its documents, their word counts and the postings as packed arrays."""
    shared = docs.sparkSession.sparkContext.broadcast(queries.terms)
    gap = queries.width + slop

    def make():
        terms = shared.value
        number = terms.get

        def step(batch):
            out: dict[str, list] = {k: [] for k in ("docs", "n_words", "starts", "terms", "counts", "positions")}
            ids, each, size = [], [], 0

            def close():
                begins, at, starts = postings(each, len(terms), gap)
                known = np.flatnonzero(np.diff(begins))
                out["docs"].append(list(ids))
                out["n_words"].append([len(w) for w in each])
                out["starts"].append(starts.tobytes())
                out["terms"].append(known.astype(np.int32).tobytes())
                out["counts"].append(np.diff(begins)[known].astype(np.int32).tobytes())
                out["positions"].append(at.astype(np.int32).tobytes())
                ids.clear()
                each.clear()

            for doc_id, t in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
                ids.append(doc_id)
                each.append([number(w, -1) for w in words(t)])
                size += len(t)
                if size >= SEGMENT_CHARS:
                    close()
                    size = 0
            if ids:
                close()
            return out

        return step

    schema = "docs array<long>, n_words array<long>, starts binary, terms binary, counts binary, positions binary"
    return map_batches(id_text(docs, id_col, text_col), schema, make)


def search(index: DataFrame, queries: Queries, slop: int = 0) -> DataFrame:
    """A row per document: words hit by exact phrases (from 0), items that hold them, items that are near."""
    shared = index.sparkSession.sparkContext.broadcast(queries)

    def make():
        q = shared.value

        def step(batch):
            out: dict[str, list] = {k: [] for k in ("doc_id", "n_words", "hit_words", "items", "near_items")}
            for row in batch.to_pylist():
                _search_segment(row, q, slop, out)
            return out

        return step

    return map_batches(index, f"doc_id long, n_words long, hit_words array<int>, items array<{queries.kind}>, near_items array<{queries.kind}>", make)


def _search_segment(row: dict, q: Queries, slop: int, out: dict[str, list]) -> None:
    n_docs = len(row["docs"])
    starts = np.frombuffer(row["starts"], dtype=np.int64)
    at = np.frombuffer(row["positions"], dtype=np.int32).astype(np.int64)
    counts = np.zeros(len(q.terms), dtype=np.int64)
    counts[np.frombuffer(row["terms"], dtype=np.int32)] = np.frombuffer(row["counts"], dtype=np.int32)
    begins = np.concatenate([[0], np.cumsum(counts)])
    change = np.zeros(int(starts[-1]) + 1, dtype=np.int32)
    held: list[set[Item]] = [set() for _ in range(n_docs)]
    near: list[set[Item]] = [set() for _ in range(n_docs)]
    possible = np.flatnonzero((counts[q.phrases] > 0).all(axis=1)) if len(q.phrases) else ()
    for p in possible:
        size = int(q.sizes[p])
        found, _ = phrase_starts(q.phrases[p], size, begins, at)
        if len(found):
            np.add.at(change, found, 1)
            np.add.at(change, found + size, -1)
            for d in np.unique(np.searchsorted(starts, found, side="right") - 1):
                held[d].update(q.holders[p])
        if slop:
            found, rarest = phrase_starts(q.phrases[p], size, begins, at, slop)
            for d in np.unique(np.searchsorted(starts, found + rarest, side="right") - 1):
                near[d].update(q.holders[p])
    hit = np.flatnonzero(np.cumsum(change[:-1]) > 0)
    within = np.searchsorted(hit, starts)
    out["doc_id"] += row["docs"]
    out["n_words"] += row["n_words"]
    out["hit_words"] += [hit[within[d] : within[d + 1]] - starts[d] for d in range(n_docs)]
    out["items"] += [sorted(h, key=_null_last) for h in held]
    out["near_items"] += [sorted(h, key=_null_last) for h in near]


def _item_kind(benchmark: DataFrame, item_col: str) -> str:
    return "long" if isinstance(benchmark.schema[item_col].dataType, IntegralType) else "string"


def _query_parts(benchmark: DataFrame, item_col: str, text_col: str):
    """For each part of the items, of bounded size, a function that reads it. One part unless large."""
    kind = _item_kind(benchmark, item_col)
    items = benchmark.select(benchmark[item_col].cast(kind).alias("item_id"), benchmark[text_col].cast("string").alias("text"))
    items = items.where(F.col("text").isNotNull())
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-size // QUERY_BYTES))
    for k in range(parts):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k) if parts > 1 else items
        yield lambda own=own: [(r["item_id"], r["text"]) for r in own.toLocalIterator()]


def contamination(
    docs: DataFrame, benchmark: DataFrame, width: int = 13, share: float = 0.05, slop: int = 0,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """A row per document: doc_id, n_words, hit_words, items, near_items, n_hit, contaminated.

    A benchmark beyond QUERY_BYTES is searched in parts. Rows are numbered once before that, and the hits of
    a row are put together by its number, so rows that share an identifier, or have none, stay apart.
    """
    parts, kind = list(_query_parts(benchmark, item_col, item_text)), _item_kind(benchmark, item_col)
    if len(parts) == 1:
        queries = Queries(parts[0](), width, kind)
        whole = search(settle(build_index(docs, queries, id_col, text_col, slop)), queries, slop)
    else:
        rows = settle(id_text(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
        found = []
        for part in parts:
            queries = Queries(part(), width, kind)
            found.append(search(settle(build_index(rows, queries, "row", "text", slop)), queries, slop))
        together = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)  # noqa: E731  a row for each part
        whole = reduce(DataFrame.unionByName, found).withColumnRenamed("doc_id", "row")
        whole = whole.groupBy("row").agg(F.max("n_words").alias("n_words"), *[together(c) for c in ("hit_words", "items", "near_items")])
        whole = rows.select("row", "doc_id").join(whole, "row").drop("row")
    whole = whole.withColumn("n_hit", F.size("hit_words").cast("long"))
    return whole.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") >= F.col("n_words") * F.lit(share)))


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns: 20 * n_hit >= n_words is a share of 0.05, held in whole numbers."""
    found = contamination(docs, benchmark)
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 13) -> DataFrame:
    """The rows of documents that are not contaminated, with all their columns.

    A text alone decides, told by its hash: rows that share an identifier, or have none, are judged apart.
    """
    text = docs["text"].cast("string")
    hashed = docs.select(F.xxhash64(text).alias("_hash"), text.alias("_text"))
    found = contamination(hashed, benchmark, width, id_col="_hash", text_col="_text")
    bad = found.where((F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))).select(F.col("doc_id").alias("hash"))
    return without(docs, bad, {"hash": F.xxhash64(text)})


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[k:k + 12], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 11))) AS k FROM b WHERE len(w) > 0)
),
places AS (
  SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, greatest(1, len(w) - n + 2))) AS k
        FROM d, (SELECT DISTINCT n FROM windows))
),
met AS (SELECT doc_id, item_id, k, p.n FROM places p JOIN windows USING (phrase)),
hit AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit
  FROM (SELECT doc_id, unnest(range(k, k + n)) AS k FROM met) GROUP BY doc_id
),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM met) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
