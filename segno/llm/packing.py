"""Packing documents into sequences by minimum bin slack.

Every document is tokenised once and cut at multiples of the window, which leaves one remainder a
document. The remainders are a multiset of at most ``capacity`` different lengths, whatever the number
of documents, so the packing itself is planned on counts: a window takes the largest length that
remains, a bitset subset-sum dynamic program over the remaining multiset finds the fill closest to
the capacity, and backtracking gives how many of each length it uses. A pattern is repeated as often
as the counts allow. Where the best fill leaves too much slack, a remainder is cut at a multiple of
``grain`` and its first part fills the window; checksums of grains are kept from the one reading and
combined, so nothing is tokenised twice.

A remainder finds its window by its rank among those of equal length, from per-partition counts.

Defined results
---------------
* A null or empty text is the end token alone.
* Rows are packed one by one; rows that repeat an identifier are documents of their own.
* An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, map_batches, settle, texts

#: Cached words in one Python worker; frequent words come first, so a full cache takes no more.
CACHE_WORDS = 700_000
#: Characters of text that are encoded at once.
BITE_CHARS = 1 << 20
#: Ranks stay below this, so a length and a rank fit one 64-bit key.
RANKS = 1 << 49
#: Signs that end a word; no part of a contraction.
SIGNS = "".join(chr(b) for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in "'<>|")
#: Longer words are encoded without being cached.
CACHE_CHARS = 48


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Token ids of a text as packed unsigned 32-bit numbers.

    The tokenizer never joins across a space or a line end, so texts are split there and words are
    encoded once.
    """

    def __init__(self, path: str, end_id: int):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel ones
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end = end_id.to_bytes(4, "little")
        self.known: dict[str, bytes] = {"": b""}

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words that are not cached."""
        if not words:
            return {}
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return {w: np.array(e.ids, dtype="<u4").tobytes() for w, e in zip(words, found, strict=True)}

    def encode(self, several: list[str]) -> list[bytes]:
        parts = [_lowered(text).replace("\n", " ").split(" ") for text in several]
        # The texts' own words in a small table: the large cache is asked once for each.
        own = list(set().union(*parts))
        local = dict(zip(own, map(self.known.get, own), strict=True))
        unknown = [w for w, packed in local.items() if packed is None]
        # A word and the signs after it are encoded apart by the tokenizer too.
        tails: dict[str, tuple[str, str]] = {}
        for w in unknown:
            core = w.rstrip(SIGNS)
            if core != w and core and core[-1].isalpha():
                tails[w] = core, w[len(core) :]
        needed = {part for pair in tails.values() for part in pair}.union(w for w in unknown if w not in tails)
        held = {w: self.known.get(w) for w in needed}
        new = self._learn([w for w, packed in held.items() if packed is None])
        held |= new
        for w in unknown:
            local[w] = held[tails[w][0]] + held[tails[w][1]] if w in tails else held[w]
        # The cache takes short words without signs while it has room.
        for w, packed in new.items():
            if len(self.known) >= CACHE_WORDS:
                break
            if len(w) <= CACHE_CHARS:
                self.known[w] = packed
        return [b"".join([*map(local.__getitem__, p), self.end]) for p in parts]


def _lowered(text: str) -> str:
    """The text in lower case, as the tokenizer has it, where that changes nothing else: in Latin-1."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


def _bites(texts: list[str], chars: int) -> Iterator[list[int]]:
    """Indexes of texts in runs of about so many characters."""
    run: list[int] = []
    size = 0
    for k, t in enumerate(texts):
        run.append(k)
        size += len(t)
        if size >= chars:
            yield run
            run, size = [], 0
    if run:
        yield run


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def _encoder(path: str, end_id: int) -> Encoder:
    """One encoder for a Python worker, so its cache outlives a task."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = Encoder(path, end_id)
    return _ENCODERS[path, end_id]


def crc32_joined(crc_a: int, crc_b: int, length_b: int) -> int:
    """crc32 of a + b from those of a and b: a is advanced over length_b zero bytes."""
    return _advanced(crc_a, length_b) ^ crc_b


_POLY = 0xEDB88320


def _times(matrix: list[int], vector: int) -> int:
    total = 0
    k = 0
    while vector:
        if vector & 1:
            total ^= matrix[k]
        vector >>= 1
        k += 1
    return total


def _squared(matrix: list[int]) -> list[int]:
    return [_times(matrix, row) for row in matrix]


_POWERS: list[list[int]] = []  # advance over 2**k zero bytes


def _advanced(crc: int, length: int) -> int:
    if not _POWERS:
        one_bit = [_POLY] + [1 << k for k in range(31)]
        _POWERS.append(_squared(_squared(_squared(one_bit))))
    k = 0
    while length:
        if k == len(_POWERS):
            _POWERS.append(_squared(_POWERS[-1]))
        if length & 1:
            crc = _times(_POWERS[k], crc)
        length >>= 1
        k += 1
    return crc


def tokenised(docs: DataFrame, path: str, end_id: int, capacity: int, grain: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document piece before packing: full windows, then the remainder with its grains' checksums.

    ``part`` and ``nth`` number the pieces of one length within a partition.
    """

    def make():
        encoder = _encoder(path, end_id)
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        seen: dict[int, int] = defaultdict(int)

        def step(batch):
            out: dict[str, list] = {k: [] for k in ("doc_id", "doc_tokens", "start", "length", "crcs", "part", "nth")}
            names, read = batch.column("doc_id").to_pylist(), texts(batch)
            encoded = ((names[k], ids) for run in _bites(read, BITE_CHARS) for k, ids in zip(run, encoder.encode([read[k] for k in run]), strict=True))
            for doc_id, ids in encoded:
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    length = min(capacity, total - start)
                    cut = length if length == capacity else grain
                    crcs = [zlib.crc32(ids[4 * k : 4 * min(k + cut, start + length)]) for k in range(start, start + length, cut)]
                    for name, value in (("doc_id", doc_id), ("doc_tokens", total), ("start", start), ("length", length), ("crcs", crcs), ("part", part), ("nth", seen[length])):
                        out[name].append(value)
                    seen[length] += 1
            return out

        return step

    return map_batches(id_text(docs, id_col, text_col), "doc_id long, doc_tokens long, start long, length int, crcs array<long>, part int, nth long", make)


# --- the plan -----------------------------------------------------------------------------------


def best_fill(counts: dict[int, int], room: int) -> tuple[int, dict[int, int]]:
    """The largest sum of at most ``room`` from a multiset, and how many of each length it takes.

    A bitset holds the sums reached so far; a count is spread over binary multiples, each one shift.
    """
    mask = (1 << (room + 1)) - 1
    reached = 1
    steps: list[tuple[int, int, int]] = []  # length, multiple, sums reached before
    for length in sorted(counts, reverse=True):
        left = min(counts[length], room // length) if length <= room else 0
        multiple = 1
        while left:
            multiple = min(multiple, left)
            steps.append((length, multiple, reached))
            reached |= (reached << length * multiple) & mask
            left -= multiple
            multiple *= 2
        if reached >> room & 1:
            break
    total = reached.bit_length() - 1
    taken: dict[int, int] = defaultdict(int)
    at = total
    for length, multiple, before in reversed(steps):
        if not before >> at & 1:
            at -= length * multiple
            taken[length] += multiple
    return total, dict(taken)


def plan(counts: dict[int, int], capacity: int, grain: int, tolerance: int) -> list[tuple[int, int, int, int, int, int, int, int]]:
    """Rows (length, first rank, how many, layer, start, size, first sequence, offset).

    A row places pieces ``first rank`` to ``first rank + how many - 1`` of those with ``length``
    tokens: of each, the ``size`` tokens from ``start`` go to successive sequences at ``offset``.
    ``layer`` numbers the parts of a piece that was cut.
    """
    #: For a length: what there is of it, as [source length, first rank, how many, layer, start].
    supply: dict[int, list[list[int]]] = defaultdict(list)
    left: dict[int, int] = {}
    for length, n in counts.items():
        if n:
            supply[length].append([length, 0, n, 0, 0])
            left[length] = n
    rows: list[tuple[int, int, int, int, int, int, int, int]] = []
    sequence = 0

    def take(size: int, n: int) -> list[list[int]]:
        got = []
        left[size] -= n
        if not left[size]:
            del left[size]
        while n:
            entry = supply[size][-1]
            m = min(n, entry[2])
            got.append([entry[0], entry[1] + entry[2] - m, m, entry[3], entry[4]])
            entry[2] -= m
            if not entry[2]:
                supply[size].pop()
            n -= m
        return got

    def place(got: list[list[int]], size: int, offset: int) -> None:
        at = sequence
        for source, rank, n, layer, start in got:
            rows.append((source, rank, n, layer, start, size, at, offset))
            at += n

    while left:
        largest = max(left)
        left[largest] -= 1
        spare = {k: n for k, n in left.items() if n}
        total, pattern = best_fill(spare, capacity - largest)
        left[largest] += 1
        pattern = dict(pattern)
        pattern[largest] = pattern.get(largest, 0) + 1
        slack = capacity - largest - total
        cut = slack // grain * grain
        times = min(left[k] // m for k, m in pattern.items())
        filler = None
        if slack > tolerance and cut:
            # What remains is longer than the slack, or the pattern would hold it.
            rest = {k: n - pattern.get(k, 0) for k, n in left.items() if n > pattern.get(k, 0) and k > cut}
            if rest:
                filler = min(rest)
                times = min(times, left[filler] // (pattern.get(filler, 0) + 1))
        offset = 0
        for size in sorted(pattern, reverse=True):
            for _ in range(pattern[size]):
                place(take(size, times), size, offset)
                offset += size
        if filler:
            got = take(filler, times)
            place(got, cut, offset)
            for source, rank, n, layer, start in got:
                supply[filler - cut].append([source, rank, n, layer + 1, start + cut])
                left[filler - cut] = left.get(filler - cut, 0) + n
        sequence += times
    return rows


# --- the operator -------------------------------------------------------------------------------


def pack(
    docs: DataFrame, tokenizer: str | None = None, capacity: int = 4096, end_id: int = 2, grain: int = 128,
    tolerance: int = 32, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = tokenizer or default_tokenizer()
    pieces = settle(tokenised(docs, path, end_id, capacity, grain, id_col, text_col))

    by_part = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    rows = plan(counts, capacity, grain, tolerance)

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank0"))
    ranked = pieces.join(starts, ["length", "part"]).withColumn("rank", F.col("rank0") + F.col("nth"))

    shared = docs.sparkSession.sparkContext.broadcast(_layers(rows))  # bounded by the capacity, not by the documents
    wide = ranked.select("doc_id", "doc_tokens", F.col("start").alias("start0"), "length", "crcs", "rank")

    def make():
        layers = shared.value

        def step(batch):
            return _placed(batch, layers, grain)

        return step

    return map_batches(wide, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long", make)


def _layers(rows: list) -> list[np.ndarray]:
    """The plan by layer, sorted by (length, first rank)."""
    if not rows:
        return []
    table = np.array(rows, dtype=np.int64)
    out = []
    for layer in range(int(table[:, 3].max()) + 1):
        own = table[table[:, 3] == layer]
        out.append(own[np.lexsort((own[:, 1], own[:, 0]))])
    return out


def _placed(batch, layers: list[np.ndarray], grain: int) -> dict:
    length = batch.column("length").to_numpy().astype(np.int64)
    rank = batch.column("rank").to_numpy().astype(np.int64)
    doc_id = np.array(batch.column("doc_id").to_pylist(), dtype=object)
    total = batch.column("doc_tokens").to_numpy()
    start0 = batch.column("start0").to_numpy()
    crcs = batch.column("crcs").to_pylist()
    out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
    for table in layers:
        # The last row not after the rank, if it is one of the length's own.
        low, high = np.searchsorted(table[:, 0], length, "left"), np.searchsorted(table[:, 0], length, "right")
        at = np.searchsorted(table[:, 0] * RANKS + table[:, 1], length * RANKS + rank, "right") - 1
        fits = (high > low) & (at >= low)
        fits[fits] &= rank[fits] < table[at[fits], 1] + table[at[fits], 2]
        for k in np.flatnonzero(fits):
            _, rank0, _, _, start, size, sequence, offset = table[at[k]].tolist()
            out["doc_id"].append(doc_id[k])
            out["start"].append(int(start0[k]) + start)
            out["length"].append(size)
            out["ids_crc32"].append(_joined(crcs[k], int(length[k]), start, size, grain))
            out["doc_tokens"].append(int(total[k]))
            out["sequence_id"].append(sequence + int(rank[k]) - rank0)
            out["offset"].append(offset)
    return out


def _joined(crcs: list[int], length: int, start: int, size: int, grain: int) -> int:
    """The checksum of tokens start to start + size of a piece from those of its grains."""
    if len(crcs) == 1:
        return crcs[0]
    crc = 0
    for k in range(start // grain, -(-(start + size) // grain)):
        crc = crc32_joined(crc, crcs[k], 4 * (min((k + 1) * grain, length) - k * grain))
    return crc
