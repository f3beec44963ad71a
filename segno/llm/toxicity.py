"""Toxicity scores of text restored by a noisy-channel decoder.

Writers hide words by leetspeak (``1d10t``), separators or spacing (``i d i o t``, ``i-d-i-o-t``) and
repetition (``idiooot``). A token with such a sign beside a letter or with a repeated letter becomes a
lattice: every character has the letters it may stand for, separators and repeats may also stand for
nothing, and spaces of a run of single characters for nothing or a break between words. Viterbi decoding under a
character trigram model of the whole corpus picks the likeliest letters, and the restored words are
scored beside those of the text as it stands.

The score of a word is the lower confidence bound of the share of toxic documents among labelled ones
with that word, or with a word of the same beginning. Near copies of a labelled document count once.
A document's worst words, their number and their density are its evidence, which a logistic
regression on a bounded sample of the labelled rows turns into a probability.

Defined results
---------------
* A null or empty text, or one without words, has the score of a text with no bad word.
* Without enough labels of both kinds a text's score is that of its worst word, 0 for none.
* Labels that are null are left out; an identifier labelled twice is learned from with either label.
* Repeated rows each get their score. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from array import array
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_crc32, id_text, map_batches, texts

#: Letters that a digit or sign may stand for (fixed values).
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}
#: Signs that may stand for nothing inside a word (fixed values).
SEPARATORS = ".-_*~'"
#: Log-probability of each liberty that the writer takes.
COST_LEET, COST_SEPARATOR, COST_REPEAT = -1.5, -0.7, -0.7

#: Characters after which a path of the decoder is laid down.
FOLD = 64
_FIRST_SIGN = 0xE000  # of as many as there are states, fewer than _CLASSES squared

#: A word counts as bad from this score.
BAD_WORD = 0.3

#: Features are counted in so many buckets; this bounds what reaches the driver.
BUCKETS = 1 << 20
#: Scored tokens that one Python worker keeps; a full cache takes no more.
CACHE_TOKENS = 700_000
#: Tokens whose buckets one Python worker keeps while it learns, likewise.
CACHE_FEATURES = 300_000

_CLASSES = 28  # 0: between words, 1-26: a-z, 27: any other letter
_WORDS = re.compile(r"[^\W\d_]+")
_SIGN = "[" + re.escape("".join(LEET) + SEPARATORS) + "]"
_SUSPECT = re.compile(rf"[^\W\d_]{_SIGN}|{_SIGN}[^\W\d_]|([^\W\d_])\1")
_SPACED = re.compile(r"(?<!\S)(?:[^\W_]|[@$!|+])(?:\s+(?:[^\W_]|[@$!|+])){2,}(?!\S)")

_BYTE_CLASS = np.zeros(256, dtype=np.int64)
_BYTE_CLASS[97:123] = np.arange(1, 27)
_BYTE_CLASS[65:91] = np.arange(1, 27)
_BYTE_CLASS[128:] = 27


def _class(letter: str) -> int:
    return ord(letter) - 96 if "a" <= letter <= "z" else 27 if letter.isalpha() else 0


# --- the character model ------------------------------------------------------------------------


def train_characters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[float]:
    """Log-probabilities of a character after two others, from the texts of all rows."""

    def make():
        def step(batch):
            total = np.zeros(_CLASSES**3, dtype=np.int64)
            for t in texts(batch):
                held = _BYTE_CLASS[np.frombuffer(t.encode("utf-8", "surrogatepass"), dtype=np.uint8)]
                held = np.concatenate([[0, 0], held, [0]])
                total += np.bincount((held[:-2] * _CLASSES + held[1:-1]) * _CLASSES + held[2:], minlength=_CLASSES**3)
            code = np.flatnonzero(total)
            return {"code": code, "n": total[code]}

        return step

    rows = map_batches(id_text(docs, id_col, text_col), "code long, n long", make).groupBy("code").agg(F.sum("n").alias("n")).collect()
    counts = np.full(_CLASSES**3, 0.5)  # at most this many rows
    for r in rows:
        counts[r["code"]] += r["n"]
    counts = counts.reshape(-1, _CLASSES)
    return np.log(counts / counts.sum(axis=1, keepdims=True)).ravel().tolist()


def _options(c: str) -> list[tuple[str, int, float]]:
    """What a character may stand for: letters or signs with their class and cost; empty for nothing."""
    options = [(c, 0.0)] if c.isalpha() else []
    options += [(x, COST_LEET) for x in LEET.get(c, "")]
    if c in SEPARATORS:
        options.append(("", COST_SEPARATOR))
    elif not options:
        options += [("", 0.0), (" ", 0.0)] if c.isspace() else [(c, 0.0)]
    return [(x, _class(x) if x else 0, cost) for x, cost in options]


class _Options(dict):
    """The options of every character that came up."""

    def __missing__(self, c: str) -> list[tuple[str, int, float]]:
        self[c] = options = _options(c)
        return options


_OPTIONS = _Options()
_REPEAT = ("", 0, COST_REPEAT)


def decode(token: str, model: list[float]) -> str:
    """The likeliest letters behind a lower-case token: Viterbi over the last two characters.

    Every FOLD characters the paths so far are laid down, and each goes on from one sign that tells its
    number, so a character costs the same at the end of a long token.
    """
    # A state a, b is the number a * _CLASSES + b.
    states: dict[int, tuple[float, str]] = {0: (0.0, "")}
    laid: list[list[str]] = []
    before = ""
    for begin in range(0, len(token), FOLD):
        if begin:
            laid.append([path for _, path in states.values()])
            states = {state: (score, chr(_FIRST_SIGN + k)) for k, (state, (score, _)) in enumerate(states.items())}
        for c in token[begin : begin + FOLD]:
            options = _OPTIONS[c]
            if c == before:
                options = [*options, _REPEAT]
            reached: dict[int, tuple[float, str]] = {}
            if len(states) == 1 and len(options) == 1 and options[0][0]:  # one way to go on, as in most places
                [(state, (score, path))], [(letter, k, cost)] = states.items(), options
                reached[state % _CLASSES * _CLASSES + k] = score + cost + model[state * _CLASSES + k], path + letter
            else:
                for at, (score, path) in states.items():
                    row, next_row = at * _CLASSES, at % _CLASSES * _CLASSES
                    for letter, k, cost in options:
                        if letter:
                            state, value = next_row + k, score + cost + model[row + k]
                        else:
                            state, value = at, score + cost
                        held = reached.get(state)
                        if held is None or value > held[0]:
                            reached[state] = (value, path + letter)
            states = reached
            if not c.isspace():
                before = c
    path = max((score + model[state * _CLASSES], path) for state, (score, path) in states.items())[1]
    parts = []
    for paths in reversed(laid):
        parts.append(path[1:])
        path = paths[ord(path[0]) - _FIRST_SIGN]
    return "".join(reversed([*parts, path]))


def restored(token: str, model: list[float], run: bool = False) -> list[str]:
    """The words of a lower-case token, and those it may hide; a ``run`` is read as single characters parted by spaces."""
    own = [token] if token.isalpha() else _WORDS.findall(token)
    if run:
        return own + _WORDS.findall(decode(" ".join(token), model)) if own else own
    if not _SUSPECT.search(token):
        return own
    # Separators at the ends part no letters; an exclamation mark there may be one or a letter.
    core = token.strip(SEPARATORS)
    forms = {x for x in {core, core.rstrip("!" + SEPARATORS)} if _SUSPECT.search(x)}
    return own + [w for x in sorted(forms) for w in _WORDS.findall(decode(x, model))]


def spaced(text: str, tokens: list[str] | None = None) -> list[str]:
    """Runs of three or more single characters, as tokens."""
    if b"\1\1\1" not in bytes(map((1).__eq__, map(len, text.split() if tokens is None else tokens))):
        return []  # most texts, which go without a pattern
    return ["".join(m.split()) for m in _SPACED.findall(text)]


# --- the classifier -----------------------------------------------------------------------------


def features(word: str) -> list[int]:
    """Buckets of a word and of its beginnings."""
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in ("=" + word, *("^" + word[:k] for k in (4, 5) if len(word) > k))]


@dataclass
class Tokens:
    """The character model; ``known`` keeps the buckets of tokens in a worker, from one task to the next."""

    model: list[float]
    known: dict[str, array] = field(default_factory=dict)


def _document_features(text: str, tokens: Tokens) -> np.ndarray:
    held: set[int] = set()
    every, known = text.split(), tokens.known
    for token in set(every):
        got = known.get(token)
        if got is None:
            got = array("i", [b for w in restored(token, tokens.model) for b in features(w)])
            if len(known) < CACHE_FEATURES:
                known[token] = got
        held.update(got)
    for token in set(spaced(text, every)):
        held.update(b for w in restored(token, tokens.model, run=True) for b in features(w))
    return np.fromiter(held, dtype=np.int64, count=len(held))


def _copy_key(text: str) -> int:
    """The least hash of four consecutive words: near copies mostly share it."""
    held = text.encode("utf-8", "surrogatepass").split()
    if len(held) < 4:
        return zlib.crc32(b" ".join(held))
    return min(map(zlib.crc32, map(b" ".join, zip(held, held[1:], held[2:], held[3:], strict=False))))


@dataclass
class Lexicon:
    """Scores by bucket, the character model, and weights of the evidence (the first is the bias).

    ``known`` keeps the scores of tokens in a worker, ``starts`` those of beginnings of words, from one task to the next.
    """

    scores: array
    model: list[float]
    weights: np.ndarray | None = None
    known: dict[str, float] = field(default_factory=dict)
    starts: dict[str, float] = field(default_factory=dict)


def train(rows: DataFrame, model: list[float], z: float = 3.0) -> Lexicon:
    """A lexicon from rows (doc_id, text, toxic), all of which count; null labels are left out."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(Tokens(model))
    rows = rows.where(F.col("toxic").isNotNull())

    def make_keys():
        def step(batch):
            return {"doc_id": batch.column("doc_id"), "text": batch.column("text"), "toxic": batch.column("toxic"), "key": [_copy_key(t.lower()) for t in texts(batch)]}

        return step

    keyed = map_batches(rows.select("doc_id", "text", F.col("toxic").cast("int")), "doc_id long, text string, toxic int, key long", make_keys)
    once = keyed.groupBy("key", "toxic").agg(F.min(F.struct("doc_id", "text")).alias("row")).select("toxic", "row.text")

    def make():
        def step(batch):
            counts = np.zeros((2, BUCKETS), dtype=np.int32)
            for toxic, text in zip(batch.column("toxic").to_pylist(), texts(batch), strict=True):
                counts[int(toxic > 0), _document_features(text.lower(), shared.value)] += 1
            held = np.flatnonzero(counts.any(axis=0))
            return {"bucket": held, "clean": counts[0, held], "toxic": counts[1, held]}

        return step

    got = map_batches(once, "bucket long, clean long, toxic long", make).groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    got = got.where("toxic > 0").toPandas()  # at most BUCKETS rows
    scores = np.zeros(BUCKETS)
    n = (got["clean"] + got["toxic"]).to_numpy(np.float64)
    p = got["toxic"].to_numpy(np.float64) / np.maximum(n, 1)
    low = (p + z * z / (2 * n) - z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)  # Wilson's bound
    scores[got["bucket"].to_numpy(np.int64)] = np.clip(low, 0, 1)
    return Lexicon(array("d", scores.tolist()), model)  # read one by one, which is faster than in numpy


def evidence(text: str, lexicon: Lexicon) -> list[float]:
    """What a text holds: its worst word, the next worst, how many bad words there are and how dense."""
    text = text.lower()
    tokens, known = text.split(), lexicon.known
    own = list(set(tokens))
    got = list(map(known.get, own))
    if None in got:
        for k, value in enumerate(got):
            if value is None:
                got[k] = value = _token_score(own[k], lexicon)
                if len(known) < CACHE_TOKENS:
                    known[own[k]] = value
    hidden = spaced(text, tokens)
    shown = [_token_score(t, lexicon, run=True) for t in hidden]
    worst = max([*got, *shown], default=0.0)
    bad, n = {}, 0
    if worst >= BAD_WORD / 2:
        scores = dict(zip(own, got, strict=True))
        # A token that a run hides as well counts as the run does.
        bad = {t: v for t, v in [*scores.items(), *zip(hidden, shown, strict=True)] if v >= BAD_WORD / 2}
        n = sum(scores[t] >= BAD_WORD for t in tokens) + sum(v >= BAD_WORD for v in shown)
    top = sorted(bad.values(), reverse=True)[:2] + [0.0, 0.0]
    size = len(tokens) + len(hidden)
    logit = lambda p: float(np.log(max(p, 0.01) / max(1 - p, 0.01)))
    return [logit(worst), logit(top[1]), float(np.log1p(n)), float(np.log((n + 0.5) / (size + 20)))]


def _token_score(token: str, lexicon: Lexicon, run: bool = False) -> float:
    return max([_word_score(w, lexicon) for w in restored(token, lexicon.model, run)], default=0.0)


def _word_score(word: str, lexicon: Lexicon) -> float:
    """The highest score among a word's ``features``; those of its beginnings are looked up together."""
    own = lexicon.scores[zlib.crc32(("=" + word).encode("utf-8", "surrogatepass")) % BUCKETS]
    if len(word) <= 4:
        return own
    start = word[:5] if len(word) > 5 else word[:4]
    value = lexicon.starts.get(start)
    if value is None:
        value = max(lexicon.scores[b] for b in features(word)[1:])
        if len(lexicon.starts) < CACHE_TOKENS:
            lexicon.starts[start] = value
    return max(own, value)


def score_text(text: str, lexicon: Lexicon) -> float:
    held = evidence(text, lexicon)
    if lexicon.weights is None:  # too few labels to weigh by
        p = float(1 / (1 + np.exp(-held[0])))
        return p if p > 0.01 else 0.0
    return float(1 / (1 + np.exp(-np.clip(lexicon.weights[0] + np.dot(lexicon.weights[1:], held), -30, 30))))


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton's method."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        penalty = ridge * np.array([0.0, *[1.0] * (len(w) - 1)])
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def weigh(rows: DataFrame, lexicon: Lexicon, sample: int = 50_000, least: int = 20) -> Lexicon:
    """Weights of the evidence from about ``sample`` labelled rows, chosen by a hash of the identifier."""
    rows = rows.where(F.col("toxic").isNotNull())
    total = rows.count()
    if total > sample:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(sample / total * (1 << 30)))
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)

    def make():
        def step(batch):
            return {"x": [evidence(t, shared.value) for t in texts(batch)], "y": batch.column("toxic")}

        return step

    got = map_batches(rows.select("text", F.col("toxic").cast("int")), "x array<double>, y int", make).toPandas()  # about `sample` rows
    y = (got["y"].to_numpy() > 0).astype(float)
    if min(y.sum(), len(y) - y.sum()) >= least:
        lexicon.weights = _fit(np.stack(got["x"].to_numpy()), y)
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for each row; a text alone decides."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # BUCKETS numbers and the character model

    def make():
        def step(batch):
            return {"doc_id": batch.column("doc_id"), "score": [score_text(t, shared.value) for t in texts(batch)]}

        return step

    return map_batches(id_text(docs, id_col, text_col), "doc_id long, score double", make)


def learn(docs: DataFrame, labels: DataFrame, sample: int = 200_000) -> Lexicon:
    """The lexicon from rows of ``documents`` that may be learned from; the character model from all.

    Labels are a sample of about ``sample``, chosen by a hash of the identifier (all, if there are no
    more), so they can be broadcast and texts are not shuffled to meet them.
    """
    model = train_characters(docs)
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where(F.col("toxic").isNotNull())
    total = labels.count()
    if total > sample:
        labels = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(sample / total * (1 << 30)))
    labelled = id_text(docs).where(id_crc32(F.col("doc_id")) % 4 != 2).join(F.broadcast(labels), "doc_id")
    return weigh(labelled, train(labelled, model))


def toxicity_digest(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    found = score(docs, learn(docs, labels))
    held_out = id_crc32(F.col("doc_id")) % 4 == 2
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
