"""Periodic runs of words by partition refinement.

The positions of a text are held in classes of equal factors of one length, and the classes are refined
from each length to the next. A class of length L+1 is a class of length L, split by the classes of the
following positions; only the smaller classes that the step before split off have to be looked at, as
what stays behind still agrees. So a position is looked at about log n times. Two neighbours in a class
of length L that are L apart begin a square of a primitive word: the factor stands twice in a row, and if
its word had a shorter root, another member would stand between them. Squares of one length at successive
positions merge into a run whose smallest period is that length.

Many documents are refined together, as the first class of each is its own, so a step is a few array
operations on all of them. Documents of like length share a step. Nothing is shuffled: a document is one
row, and the work on it is n log n.

Defined results
---------------
* A null text, or one without words, has no run, four nulls, and the digests of empty text.
* A null identifier counts as empty text where the identifier's checksum is asked for.
* Repeated rows each get their row. An empty table gives no rows. Other columns play no part.
* Texts of any length are read whole; memory grows with the longest, by some 100 bytes a word.
* Among runs of equal exponent the one with the smallest start comes first, then the smallest period.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, map_batches

#: Words that are refined together, unless a single document has more.
TOGETHER = 1 << 19
#: Positions up to which three numbers below them fit in one 64-bit key.
KEYED = 1 << 20


class _Classes:
    """Classes of positions, each a stretch of ``order`` that is named by its first place there.

    ``after`` and ``before`` link the members of a class in the order of the text (-1 at its ends).
    """

    def __init__(self, starts: np.ndarray, sizes: np.ndarray):
        n = int(sizes.sum())
        self.n = n
        self.order = np.arange(n, dtype=np.int32)
        self.place = self.order.copy()
        self.name = np.repeat(starts, sizes).astype(np.int32)
        self.size = np.zeros(n, dtype=np.int32)
        self.size[starts] = sizes
        self.after = np.arange(1, n + 1, dtype=np.int32)
        self.after[starts + sizes - 1] = -1
        self.before = np.arange(-1, n - 1, dtype=np.int32)
        self.before[starts] = -1
        self.moved = np.zeros(n, dtype=bool)

    def _sorted(self, *keys: np.ndarray) -> np.ndarray | list[np.ndarray]:
        """The keys in lexical order, first key first."""
        if self.n <= KEYED:
            packed = keys[0].astype(np.int64)
            for k in keys[1:]:
                packed = (packed << 20) | k
            packed.sort()
            out = []
            for _ in keys:
                out.append(packed & (KEYED - 1))
                packed = packed >> 20
            return out[::-1]
        by = np.lexsort(keys[::-1])
        return [k[by] for k in keys]

    def split(self, at: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Split the classes of the positions ``at`` by their marks; positions that are not named stay together.

        Gives the members of all new classes but one of the largest of each old class, and the positions
        whose next member has changed.
        """
        old, mark, at = self._sorted(self.name[at], mark, at)
        new_class = np.empty(len(at), dtype=bool)
        new_class[:1] = True
        np.not_equal(old[1:], old[:-1], out=new_class[1:])
        new_group = new_class.copy()
        new_group[1:] |= mark[1:] != mark[:-1]
        # Classes that move whole and under one mark do not change.
        class_at = np.flatnonzero(new_class)
        moving = np.diff(np.append(class_at, len(at)))
        groups = np.add.reduceat(new_group, class_at, dtype=np.int64)
        rest = self.size[old[class_at]] - moving
        change = (groups > 1) | (rest > 0)
        if not change.all():
            keep = np.repeat(change, moving)
            old, at, new_class, new_group = old[keep], at[keep], new_class[keep], new_group[keep]
            moving, rest = moving[change], rest[change]
        if not len(at):
            return at, at
        class_at, group_at = np.flatnonzero(new_class), np.flatnonzero(new_group)
        name = old[class_at]
        changed = self._unlink(old, at)

        # What moves goes to the end of the class's stretch, in the order of the groups.
        slots = np.arange(len(at)) + np.repeat(name + rest - class_at, moving)
        self.moved[at] = True
        there = self.order[slots]
        stays = there[~self.moved[there]]
        inside = at[self.place[at] < np.repeat(name + rest, moving)]
        self.order[self.place[inside]] = stays
        self.place[stays] = self.place[inside]
        self.order[slots] = at
        self.place[at] = slots
        self.moved[at] = False
        sizes = np.diff(np.append(group_at, len(at)))
        self.size[name] = rest  # before the groups: one that moves whole leaves its first group under its name
        self.size[slots[group_at]] = sizes
        self.name[at] = np.repeat(slots[group_at], sizes)

        # Links within the groups.
        after, before = np.append(at[1:], -1), np.append(-1, at[:-1])
        after[np.append(group_at[1:], len(at)) - 1] = -1
        before[group_at] = -1
        self.after[at], self.before[at] = after, before

        # All but one of the largest of each old class.
        first = np.flatnonzero(new_class[group_at])
        most = np.maximum.reduceat(sizes, first)
        of = np.cumsum(new_class[group_at]) - 1
        largest = (sizes == most[of]) & (most > rest)[of]
        ones = np.flatnonzero(largest)
        largest[ones[1:][of[ones[1:]] == of[ones[:-1]]]] = False
        small = at[~np.repeat(largest, sizes)]
        left = (most > rest) & (rest > 0)
        if left.any():
            count = rest[left]
            start = np.repeat(name[left] - np.append(0, np.cumsum(count)[:-1]), count)
            small = np.append(small, self.order[start + np.arange(int(count.sum()))])
        return small, np.append(changed, at)

    def _unlink(self, old: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Take positions out of the links of their classes; the positions left with another next member."""
        _, at = self._sorted(old, at)
        head = np.append(True, self.before[at[1:]] != at[:-1])
        tail = np.append(head[1:], True)
        p, q = self.before[at[head]], self.after[at[tail]]
        self.after[p[p >= 0]] = q[p >= 0]
        self.before[q[q >= 0]] = p[q >= 0]
        return p[p >= 0]


def squares(words: np.ndarray, lengths: np.ndarray, times: int = 3) -> Iterator[tuple[int, np.ndarray]]:
    """(L, positions in order) of all squares of primitive words with times * L up to a text's length.

    ``words`` are the numbers of the words of all texts, each followed by a place of its own that
    equals nothing; ``lengths`` count that place.
    """
    starts = np.append(0, np.cumsum(lengths)[:-1]).astype(np.int64)
    classes = _Classes(starts, lengths.astype(np.int64))
    most = int(lengths.max() - 1) // max(2, times)
    first = np.zeros(classes.n, dtype=bool)
    first[starts] = True
    small, changed = classes.split(np.arange(classes.n), words)
    known: dict[int, list[np.ndarray]] = defaultdict(list)
    end = 1
    for size in range(1, most + 1):
        if size == end:  # all neighbours up to twice as far apart; those that come about meanwhile are added
            end, changed = 2 * size, np.flatnonzero(classes.after >= 0)
            known.clear()
        gap = classes.after[changed] - changed
        near = (gap >= size) & (gap < end)
        if near.any():
            gap, changed = gap[near], changed[near]
            by = np.argsort(gap, kind="stable")
            gap, changed = gap[by], changed[by]
            cut = np.append(np.flatnonzero(np.append(True, gap[1:] != gap[:-1])), len(gap))
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                known[int(gap[a])].append(changed[a:b])
        if held := known.pop(size, None):
            at = np.unique(np.concatenate(held))
            at = at[classes.after[at] - at == size]
            if len(at):
                yield size, at
        before = small[~first[small]] - 1
        before = before[classes.size[classes.name[before]] > 1]
        if not len(before):
            break
        small, changed = classes.split(before, classes.name[before + 1])


def runs(words: np.ndarray, lengths: np.ndarray, least: int = 24, times: int = 3) -> np.ndarray:
    """Rows (start, length, period) of runs of at least ``least`` words and ``times`` periods, by start and period."""
    found = [np.zeros((0, 3), dtype=np.int64)]
    for size, at in squares(words, lengths, times):
        cut = np.flatnonzero(np.append(True, at[1:] != at[:-1] + 1))
        start, last = at[cut], at[np.append(cut[1:], len(at)) - 1]
        length = last - start + 2 * size
        long = length >= max(least, times * size)
        if long.any():
            found.append(np.stack([start[long], length[long], np.full(int(long.sum()), size)], axis=1))
    out = np.concatenate(found)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def repeated_tail(words: list[bytes], checksum: int) -> list[bytes]:
    """The words, of which a tenth of all texts (by checksum) repeat a stretch to their end."""
    n, g = len(words), checksum // 10
    if checksum % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * ((n - a) // p + 1))[: n - a]


def _groups(sizes: list[int]) -> Iterator[list[int]]:
    """Numbers of texts of like size, about TOGETHER words in each list."""
    held, total = [], 0
    for k in sorted(range(len(sizes)), key=sizes.__getitem__):
        if held and total + sizes[k] + 1 > TOGETHER:
            yield held
            held, total = [], 0
        held.append(k)
        total += sizes[k] + 1
    if held:
        yield held


def digests(texts: list[list[bytes]]) -> list[tuple]:
    """For each text its number of runs, the four numbers of the run of greatest exponent, and both digests."""
    out: list[tuple] = [()] * len(texts)
    for group in _groups([len(t) for t in texts]):
        numbers: defaultdict[bytes, int] = defaultdict()
        numbers.default_factory = numbers.__len__
        lengths = np.array([len(texts[k]) + 1 for k in group], dtype=np.int64)
        parts = []
        for k in group:
            parts.append(np.fromiter(map(numbers.__getitem__, texts[k]), dtype=np.int32, count=len(texts[k])))
            parts.append(np.zeros(1, dtype=np.int32))
        words, ends = np.concatenate(parts), np.cumsum(lengths)
        words[ends - 1] = len(numbers)  # each text has its own classes, so one number serves all
        found = runs(words, lengths)
        of = np.searchsorted(ends, found[:, 0], side="right")
        cut = np.searchsorted(of, np.arange(len(group) + 1))
        for j, k in enumerate(group):
            own = found[cut[j] : cut[j + 1]] - [ends[j] - lengths[j], 0, 0]
            out[k] = _digest(texts[k], own.tolist())
    return out


def _digest(words: list[bytes], found: list[list[int]]) -> tuple:
    if not found:
        return 0, None, None, None, None, hashlib.sha256().hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()
    best = found[0]
    for run in found[1:]:
        if run[1] * best[2] > best[1] * run[2]:
            best = run
    drop = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in found:
        drop[start + period] += 1
        drop[start + length] -= 1
    kept = [w for w, d in zip(words, np.cumsum(drop)[:-1].tolist(), strict=True) if not d]
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found).encode()
    start, length, period = best
    return len(found), start, length, period, 1000 * length // period, hashlib.sha256(listed).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()


FIELDS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def runs_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: its runs after every tenth document's tail was made to repeat."""

    def make():
        def step(batch: pa.RecordBatch):
            ids = batch.column("doc_id").to_pylist()
            held = batch.column("text").cast(pa.binary()).to_pylist()
            texts = [repeated_tail((t or b"").split(), zlib.crc32(b"" if i is None else str(i).encode())) for i, t in zip(ids, held, strict=True)]
            return {"doc_id": batch.column("doc_id")} | dict(zip(FIELDS, zip(*digests(texts), strict=True), strict=True))

        return step

    return map_batches(id_text(docs, id_col, text_col), SCHEMA, make)


def text_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 24, times: int = 3) -> DataFrame:
    """(doc_id, start, length, period): a row per run of the texts as they stand, in words from 0."""

    def make():
        def step(batch: pa.RecordBatch):
            ids = batch.column("doc_id").to_pylist()
            texts = [(t or b"").split() for t in batch.column("text").cast(pa.binary()).to_pylist()]
            rows = []
            for k, words in enumerate(texts):
                numbers: dict[bytes, int] = {}
                marks = np.array([numbers.setdefault(w, len(numbers)) for w in words] + [len(numbers)], dtype=np.int32)
                rows += [(ids[k], *r) for r in runs(marks, np.array([len(marks)]), least, times).tolist()]
            return dict(zip(["doc_id", "start", "length", "period"], zip(*rows, strict=True), strict=True)) if rows else None

        return step

    return map_batches(id_text(docs, id_col, text_col), "doc_id long, start long, length long, period long", make)


def _crc32(text: str) -> str:
    """DuckDB SQL of the CRC-32 of a short text of ASCII characters."""
    step = "list_reduce(list_prepend({0}, range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({text}) + 1), lambda k: ord(substr({text}, k, 1))::BIGINT)), lambda acc, b: {step.format('xor(acc, b)')}), 4294967295)"


#: Pairs of equal words at one distance form islands; of islands with the same ends the smallest distance is the period.
SQL = f"""
WITH raw AS (SELECT row_number() OVER () AS row, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS w, {_crc32("coalesce(doc_id::VARCHAR, '')")} AS h FROM documents),
sized AS (SELECT *, len(w) AS n, h // 10 AS g FROM raw),
placed AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a, CASE WHEN n > 0 THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM sized),
texts AS (SELECT row, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: CASE WHEN i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END) ELSE w END AS w FROM placed),
words AS (SELECT row, i, w[i + 1] AS word FROM (SELECT row, w, unnest(range(n)) AS i FROM texts)),
pairs AS (SELECT a.row, a.i, b.i - a.i AS q FROM words a JOIN words b ON a.row = b.row AND a.word = b.word AND a.i < b.i),
islands AS (SELECT row, q, min(i) AS start, count(*) AS m FROM (SELECT *, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS k FROM pairs) GROUP BY row, q, k),
runs AS (SELECT row, start, m + q AS length, min(q) AS period FROM islands WHERE m >= 2 * q AND m + q >= 24 GROUP BY row, start, m + q),
runs_of AS (
  SELECT row, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed,
         list({{'s': start, 'l': length, 'q': period}} ORDER BY length::DOUBLE / period DESC, start, period)[1] AS best FROM runs GROUP BY row),
gone AS (SELECT DISTINCT row, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT row, string_agg(word, ' ' ORDER BY i) AS kept FROM words ANTI JOIN gone USING (row, i) GROUP BY row)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.l::BIGINT AS length, best.q::BIGINT AS period, (1000 * best.l // best.q)::BIGINT AS exponent_milli,
       sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM texts LEFT JOIN runs_of USING (row) LEFT JOIN kept USING (row)
"""
