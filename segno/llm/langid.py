"""Language identification with language-bitmask n-gram filters.

Training counts character n-grams by language over all training rows. An n-gram belongs to each
language in which it is about as common as in the language that has it most. The filters are one
bit-sliced Bloom filter: a slot holds a mask with a bit for each language, and an n-gram sets its
languages' bits in all its slots, so one lookup (the AND of its slots) returns every language that
may contain the n-gram.

A text's n-grams are looked up at once; the population count of each language's bit, less the false
positives that the filter's fill predicts, decides.

Defined results
---------------
* ``und`` with score 0 for a null text, one without a letter, or when no language was learned.
* Where no n-gram is known, the language with most training rows, with score 0.
* Ties go to the first language in alphabetical order.
* Repeated rows are counted as often as they occur. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segno.shipping import ship_package

from .common import id_crc32, id_text, map_batches, texts

UNKNOWN = "und"
#: Characters of text that are turned into n-grams at once; bounds memory for very long texts.
CHARS = 1 << 20


@dataclass
class Filters:
    """slots: masks of shape (slots, words of 64 languages); fill: share of set slots by language."""

    languages: list[str]
    rows: np.ndarray
    slots: np.ndarray
    hashes: int
    width: int

    def __post_init__(self):
        bits = np.arange(len(self.languages))
        fill = np.array([(self.slots[:, b // 64] >> np.uint64(b % 64) & np.uint64(1)).mean() for b in bits]) if len(bits) else np.zeros(0)
        self.false_share = fill**self.hashes


_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For every code point, whether it is a letter; made once in a Python worker."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(k).isalpha() for k in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTERS[0]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _spread(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of integers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def ngrams(text: str, width: int) -> np.ndarray:
    """64-bit hashes of the n-grams of a text's words; all that is no letter counts as one space."""
    out = []
    text = f" {text.lower()} "
    for k in range(0, len(text), CHARS):
        points = np.frombuffer(text[max(0, k - width) : k + CHARS].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        points = np.where(_letters()[points], points, 32)
        space = points == 32
        points = points[~(space & np.concatenate([[False], space[:-1]]))]
        if len(points) < width:
            continue
        code = np.zeros(len(points) - width + 1, dtype=np.uint64)
        for j in range(width):
            code = code * np.uint64(0x9E3779B97F4A7C15) + points[j : len(points) - width + 1 + j]
        out.append(_spread(code))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def slots_of(grams: np.ndarray, n_slots: int, hashes: int) -> np.ndarray:
    """The slots of each n-gram, shape (hashes, n)."""
    step = (grams >> np.uint64(32)) | np.uint64(1)
    return np.stack([((grams + np.uint64(k) * step) % np.uint64(n_slots)).astype(np.int64) for k in range(hashes)])


class Tally:
    """Counts of n-grams, taken together whenever many wait."""

    def __init__(self):
        self.rows = 0
        self.grams = np.zeros(0, dtype=np.uint64)
        self.n = np.zeros(0, dtype=np.int64)
        self.waiting: list[np.ndarray] = []
        self.size = 0

    def add(self, grams: np.ndarray) -> None:
        self.rows += 1
        self.waiting.append(grams)
        self.size += len(grams)
        if self.size >= 2 * CHARS:
            self._merge()

    def _merge(self) -> None:
        got, n = np.unique(np.concatenate(self.waiting), return_counts=True) if self.waiting else (self.grams[:0], self.n[:0])
        self.waiting, self.size = [], 0
        self.grams, place = np.unique(np.concatenate([self.grams, got]), return_inverse=True)
        self.n = np.bincount(place, weights=np.concatenate([self.n, n]), minlength=len(self.grams)).astype(np.int64)

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        self._merge()
        return self.grams, self.n


def train(rows: DataFrame, width: int = 4, n_slots: int = 1 << 20, hashes: int = 2, ratio: float = 0.2, least: float = 2e-7) -> Filters:
    """Filters from rows (text, lang), all of which count; null languages are left out.

    An n-gram belongs to a language in which its share of n-grams is at least ``ratio`` of its
    largest share in any, and at least ``least``. What reaches the driver is bounded by ``n_slots``.
    """
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")

    def make():
        def step(batch):
            tallies: dict[str, Tally] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), texts(batch), strict=True):
                tallies.setdefault(lang, Tally()).add(ngrams(text, width))
            out = [(lang, *t.result(), t.rows) for lang, t in tallies.items()]
            return {
                "lang": [x for lang, grams, _, _ in out for x in [lang] * (len(grams) + 1)],
                "gram": [x for _, grams, _, _ in out for x in (None, *grams.view(np.int64).tolist())],  # no n-gram: the number of rows
                "n": [x for _, _, n, rows in out for x in (rows, *n.tolist())],
            }

        return step

    counts = map_batches(rows, "lang string, gram long, n long", make).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = counts.persist()
    try:
        totals = counts.groupBy("lang").agg(F.sum(F.when(F.col("gram").isNull(), F.col("n"))).alias("rows"), F.sum(F.when(F.col("gram").isNotNull(), F.col("n"))).alias("n"))
        totals = sorted((r["lang"], r["rows"] or 0, r["n"] or 0) for r in totals.collect())  # a row for each language
        languages = [t[0] for t in totals]
        number = F.create_map(*[x for k, t in enumerate(totals) for x in (F.lit(t[0]), F.lit(k))]) if totals else F.lit(None)
        size = F.create_map(*[x for t in totals for x in (F.lit(t[0]), F.lit(float(max(1, t[2]))))]) if totals else F.lit(None)
        slots = np.zeros((n_slots, max(1, -(-len(languages) // 64))), dtype=np.uint64)
        if languages:
            grams = counts.where(F.col("gram").isNotNull()).select("gram", number[F.col("lang")].alias("k"), (F.col("n") / size[F.col("lang")]).alias("share"))
            grams = grams.groupBy("gram").agg(F.collect_list(F.struct("k", "share")).alias("of"), F.max("share").alias("most"))  # a struct for each language at most
            grams = grams.select("gram", F.explode("of").alias("of"), "most").where((F.col("of.share") >= F.col("most") * ratio) & (F.col("of.share") >= least))
            step = F.shiftrightunsigned("gram", 32).bitwiseOR(F.lit(1))
            places = [_unsigned_mod(F.col("gram"), F.lit(k) * step, n_slots) for k in range(hashes)]
            bits = grams.select(F.explode(F.array(*places)).alias("slot"), F.floor(F.col("of.k") / 64).alias("word"), (F.col("of.k") % 64).alias("bit"))
            masks = bits.groupBy("slot", "word").agg(F.bit_or(F.expr("shiftleft(1L, cast(bit as int))")).alias("mask"))
            got = masks.toPandas()  # at most n_slots rows for 64 languages
            slots[got["slot"].to_numpy(np.int64), got["word"].to_numpy(np.int64)] = got["mask"].to_numpy(np.int64).view(np.uint64)
    finally:
        counts.unpersist()
    return Filters(languages, np.array([t[1] for t in totals]), slots, hashes, width)


def _unsigned_mod(gram, add, n_slots: int):
    """(gram + add) mod n_slots as for unsigned numbers: n_slots is a power of two."""
    if n_slots & (n_slots - 1):
        raise ValueError("the number of slots is a power of two")
    return (F.try_add(gram.bitwiseAND(F.lit(n_slots - 1)), add.bitwiseAND(F.lit(n_slots - 1)))).bitwiseAND(F.lit(n_slots - 1))


def predict_text(text: str, filters: Filters) -> tuple[str, float]:
    languages = filters.languages
    if not languages or not has_letter(text):
        return UNKNOWN, 0.0
    grams = ngrams(text, filters.width)
    counts = np.zeros(len(languages))
    for k in range(0, len(grams), CHARS):
        places = slots_of(grams[k : k + CHARS], len(filters.slots), filters.hashes)
        for word in range(filters.slots.shape[1]):
            masks = filters.slots[places[0], word]
            for h in range(1, filters.hashes):
                masks = masks & filters.slots[places[h], word]
            own = len(languages) - 64 * word
            counts[64 * word : 64 * word + 64] += [np.count_nonzero(masks & np.uint64(1 << b)) for b in range(min(64, own))]
    expected = len(grams) * filters.false_share
    true = np.clip((counts - expected) / np.maximum(1 - filters.false_share, 1e-9), 0, None)
    best = int(true.argmax())
    if true[best] <= 0:
        return languages[int(filters.rows.argmax())], 0.0
    return languages[best], float(min(1.0, true[best] / true.sum()))


def predict(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for each row; a text alone decides."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # n_slots masks

    def make():
        f = shared.value

        def step(batch):
            found = [predict_text(t, f) for t in texts(batch)]
            return {"doc_id": batch.column("doc_id"), "lang_pred": [x[0] for x in found], "score": [x[1] for x in found]}

        return step

    return map_batches(id_text(docs, id_col, text_col), "doc_id long, lang_pred string, score double", make)


def learn(docs: DataFrame) -> Filters:
    """Filters from the rows of ``documents`` that may be learned from."""
    return train(docs.where(id_crc32(F.col("doc_id")) % 3 != 1).select(F.col("text").cast("string"), F.col("lang").cast("string")))


def language_digest(docs: DataFrame) -> DataFrame:
    found = predict(docs, learn(docs))
    return found.select("doc_id", (id_crc32(F.col("doc_id")) % 3 == 1).alias("held_out"), "lang_pred", "score")


#: N-grams below which a text is too short to be told from one in no language.
TELLING = 16


def rejected(text: str, filters: Filters) -> bool:
    """Whether a text is in no language: it has no letter, or is long enough and no learned language has any of it."""
    if not has_letter(text):
        return True
    if not filters.languages:
        return False
    return predict_text(text, filters)[1] == 0 and len(ngrams(text[:CHARS], filters.width)) >= TELLING


def drop_unknown_language(docs: DataFrame) -> DataFrame:
    """The rows that language ID does not reject, with all their columns.

    Rejected are texts that are null, empty or without a letter, and those of TELLING n-grams and more whose
    corrected counts are zero in every learned language. Where no row has a language to learn from, only the
    former go. A text alone decides: repeated rows and rows without an identifier stay or go together. Texts
    are read whole; an empty table gives no rows; names of other columns do not matter.
    """
    filters = learn(docs)
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # n_slots masks

    @F.pandas_udf("boolean")
    def known(text):
        return text.map(lambda t: not rejected(t or "", shared.value))

    return docs.where(known(docs["text"].cast("string")))
