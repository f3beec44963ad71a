"""The operators for training data against brute force, on small fixtures with odd rows."""

import functools
import hashlib
import random
import re
import time
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from segno.llm import decontaminate, exact_dedup, html_extract, langid, license_scan, line_dedup, packing, sharding, simhash, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, extra=False):
    """Documents, with columns whose names an operator might use itself."""
    rows = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    df = spark.createDataFrame(rows, DOC)
    if extra:
        from pyspark.sql import functions as F

        for c in ("_text", "_id", "_hash", "shard", "fp", "kept", "component", "norm", "text_sha256", "row"):
            df = df.withColumn(c, F.lit(1))
    return df.repartition(3)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    words = ["the", "of", "and", "in", "sea", "river", "stone", "light", "Éclair", "naïve", "x1", "tree", "bird", "cloud", "wind"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 120)))) for k in range(60)]
    rows += [(100 + k, rows[3][1]) for k in range(400)]  # a hot group of copies
    rows += [(600 + k, " ".join(w if rng.random() > 0.01 else "leaf" for w in rows[5][1].split())) for k in range(20)]
    rows += [(700, None), (701, ""), (702, "   "), (703, "one"), (704, "two words"), (705, "word " * 3000), (None, "lost"), (706, "123 456 ...")]
    rows += [(707, "Same.\nSame.\n\nOther line here.\nsame."), (708, "Same.\r\nOther  line here."), (709, "Same.\nSame.\n\nOther line here.\nsame.")]
    return rows


def collect(df):
    return [r.asDict() for r in df.collect()]


# --- 8, 2, 4 ------------------------------------------------------------------------------------


@pytest.mark.parametrize("extra", [False, True])
def test_exact_dedup(spark, corpus, extra):
    got = collect(exact_dedup.exact_dedup(frame(spark, corpus, extra)))
    groups = defaultdict(list)
    for i, t in corpus:
        groups[t or ""].append(i)
    assert len(got) == len(corpus)
    text = {i: t or "" for i, t in corpus}
    for r in got:
        own = [i for i in groups[text[r["doc_id"]]] if i is not None]
        assert r["group_size"] == len(groups[text[r["doc_id"]]])
        assert r["keep_id"] == (max(own) if own else None) and r["kept"] == (r["doc_id"] == r["keep_id"])
        assert r["text_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()


def test_exact_dedup_keeps_one_of_repeated_rows(spark):
    rows = [(1, "a"), (1, "a"), (2, "a"), (2, "a"), (3, "b")] + [(9, "hot")] * 600
    df = frame(spark, rows)
    assert sorted((r["doc_id"], r["text"]) for r in collect(exact_dedup.drop_exact_copies(df))) == [(2, "a"), (3, "b"), (9, "hot")]
    assert sorted(r["doc_id"] for r in collect(exact_dedup.drop_exact_copies(df, keep="min"))) == [1, 3, 9]
    assert exact_dedup.drop_exact_copies(df).columns == df.columns


def test_sharding(spark, corpus):
    got = collect(sharding.sharding_digest(frame(spark, corpus, True)))
    text = {i: t for i, t in corpus}
    assert len(got) == len(corpus)
    sums, slots, groups = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in got:
        t = text[r["doc_id"]] or ""
        assert r["size"] == len(t.encode()) + 1 and r["text_crc32"] == zlib.crc32(t.encode()) and r["law"] == "bytes" and r["grown_shard"] is None
        sums[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        groups[t].add(r["shard"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert set(sums) <= set(range(16))


def test_shards_have_nearly_equal_bytes_and_whole_groups(spark):
    rng = random.Random(1)
    rows = [(k, f"{k} " + "x" * rng.randrange(10, 200)) for k in range(4000)] + [(5000 + k, "y" * 100) for k in range(2000)] + [(8000 + k, f"pair {k // 2}") for k in range(40)]
    got = collect(sharding.shard_by_bytes(frame(spark, rows)))
    sums, at = defaultdict(int), {}
    for r in got:
        sums[r["shard"]] += r["size"]
        at[r["doc_id"]] = r["shard"]
    mean = sum(sums.values()) / 16
    assert len(sums) == 16 and max(abs(v - mean) for v in sums.values()) < 0.05 * mean
    assert all(at[8000 + 2 * k] == at[8001 + 2 * k] for k in range(20))
    again = {r["doc_id"]: (r["shard"], r["slot"]) for r in collect(sharding.shard_by_bytes(frame(spark, rows[::-1]).repartition(7)))}
    assert again == {r["doc_id"]: (r["shard"], r["slot"]) for r in got}


def brute_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").replace("\r", " ").replace("\t", " ").split(" ") if w]
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash(spark, corpus):
    rows = [r for r in corpus if r[0] is not None]
    got = {r["doc_id"]: r for r in collect(simhash.simhash_digest(frame(spark, rows, True)))}
    prints = {i: brute_fingerprint(t) for i, t in rows}
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= 2:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    assert {i: int(r["fingerprint"], 16) for i, r in got.items()} == prints
    assert {i: r["component_id"] for i, r in got.items()} == {i: root(i) for i in ids}


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_links_connect_exactly_the_ball(spark, radius):
    rng = random.Random(radius)
    base = [rng.getrandbits(64) for _ in range(30)]
    values = sorted({(b ^ sum(1 << k for k in rng.sample(range(64), n))) for b in base for n in (0, 1, 2, 3, 4)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    from segno.llm.components import components

    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = {r["node"]: r["component"] for r in components(simhash.links(df, radius)).collect()}
    for a in signed:
        for b in signed:
            if a != b and bin((a ^ b) & (1 << 64) - 1).count("1") <= radius:
                assert found[a] == found[b]


def test_components_of_a_long_chain(spark):
    from segno.llm.components import components

    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 200), (300, 300)], "u long, v long")
    found = {r["node"]: r["component"] for r in components(edges).collect()}
    assert all(found[k] == 0 for k in range(61)) and found[200] == 100 and 300 not in found


# --- 3 ------------------------------------------------------------------------------------------


def edit_distance(a, b):
    row = np.arange(len(b) + 1)
    bs = np.frombuffer(b.encode("utf-32-le"), np.uint32)
    for i, c in enumerate(a, 1):
        new = np.concatenate([[i], np.minimum(row[:-1] + (bs != ord(c)), row[1:] + 1)])
        row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
    return row[-1]


def alike(a, b):
    if max(len(a), len(b)) > line_dedup.LONG:  # by words
        letter = {w: chr(0x4E00 + k) for k, w in enumerate(dict.fromkeys(a.split(" ") + b.split(" ")))}
        a, b = ("".join(letter[w] for w in x.split(" ")) for x in (a, b))
    most = int(0.2 * max(len(a), len(b)) + 1e-9)
    return abs(len(a) - len(b)) <= most and edit_distance(a, b) <= most


def brute_blocks(line):
    """The blocks of a line, with plain loops."""
    h = lambda *parts: functools.reduce(lambda seed, x: xxhash.xxh64_intdigest(x.encode(), seed), parts, 42)
    prints = lambda hs: sum(1 << b for b in range(64) if sum(x >> b & 1 for x in hs) * 2 > len(hs))
    words = line.split(" ")
    n, out = len(words), set()
    marked = [h(w) % 2 == 0 and len(w) >= 3 for w in words]
    for (lowest, of), above in zip(line_dedup.LEVELS, [*(x[0] for x in line_dedup.LEVELS[1:]), None], strict=True):
        if n < max(4, int(lowest * 0.9)) or above and n > int(above / 0.9):
            continue
        at = 0
        while n - at >= 4 * of:
            end = at + 4 * of
            while end < min(n, at + 7 * of) and not marked[end - 1]:
                end += 1
            held = words[at:end]
            sign = ["\n" if m else " " for m in marked[at:end]]
            runs = [h(w) for w in held] if of == 1 else [h("".join(w + s for w, s in zip(held[k : k + of], sign[k : k + of], strict=True))) for k in range(0, len(held), of)]
            out.add((of, prints(runs)))
            at = end
    forms = [words] if n <= 13 else []
    if 2 <= n <= 12:
        forms += [w for k in range(n) for w in [words[:k] + words[k + 1 :]] if 2 * len(" ".join(w)) >= len(line)]
    return out | {(0, prints([h(*w[k : k + 2]) for k in range(0, len(w), 2)])) for w in forms}


def joined(xs, linked):
    parent = list(range(len(xs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(xs)):
        for b in range(a):
            if linked(a, b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return [root(k) for k in range(len(xs))]


@pytest.fixture(scope="module")
def near_lines():
    """Lines of 3 to 400 words and copies with up to a tenth of the words changed, one at least."""
    rng = random.Random(5)
    words = ["".join(rng.choice(["ra", "mo", "ti", "ken", "sul", "ö", "x"]) for _ in range(rng.randrange(1, 5))) for _ in range(400)] + ["the", "of"] * 60
    lines = [" ".join(rng.choice(words) for _ in range(n)) for n in [*range(3, 20), *range(20, 140, 6), 300, 400]]
    near = []
    for x in lines:
        for _ in range(3):
            held = x.split()
            for k in sorted(rng.sample(range(len(held)), max(1, rng.randrange(len(held) // 10 + 1))), reverse=True):
                held[k : k + 1] = rng.choice([[rng.choice(words)], [rng.choice(words)], [], [held[k], "of"]])
            near.append(" ".join(held))
    pool = lines + near + ["Hot line."] * 200 + ["", "***"] * 5
    rng.shuffle(pool)
    return [(k, "\n".join(pool[7 * k : 7 * k + 7])) for k in range(-(-len(pool) // 7))]


def first_places(rows):
    held = [((i, k), re.sub(r"\s+", " ", x).lower().strip()) for i, t in rows for k, x in enumerate(t.split("\n"))]
    held = [(p, x) for p, x in held if re.search(r"[^\W_]", x)]
    first = {}
    for p, x in held:
        first[x] = min(p, first.get(x, p))
    return held, first


@pytest.mark.parametrize(("limit", "common"), [(1_000_000, 64), (0, 2)])
def test_line_dedup_against_brute_force(spark, near_lines, monkeypatch, limit, common):
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", limit)
    monkeypatch.setattr(line_dedup, "COMMON", common)
    rows = near_lines
    got = {r["doc_id"]: r for r in collect(line_dedup.dedup_lines(frame(spark, rows, True)))}
    held, first = first_places(rows)
    xs = sorted(first, key=first.get)
    prints = [brute_blocks(x) for x in xs]
    roots = joined(xs, lambda a, b: not prints[a].isdisjoint(prints[b]) and alike(xs[a], xs[b]))
    kept = {first[xs[k]] for k in roots}
    assert len(kept) < len(xs)  # some fuzzy groups exist
    assert {(i, k) for i, r in got.items() for k in r["kept_lines"]} == kept
    for i, t in rows:
        n = len(t.split("\n"))
        n_worded = sum(p[0] == i for p, _ in held)
        assert got[i]["n_lines"] == n and got[i]["n_dropped"] == n_worded - len(got[i]["kept_lines"])


def test_line_dedup_links_lines_that_share_a_common_passage_only(spark, monkeypatch):
    """A block that many lines have links those that are alike, however little else of them is made of such blocks."""
    monkeypatch.setattr(line_dedup, "CELL", 16)
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    passage = [word() for _ in range(14)]  # holds a block whatever stands before it
    lines = [" ".join([word() for _ in range(14)] + passage) for _ in range(100)]
    words = lines[70].split(" ")
    near = " ".join(w if k >= 14 or k % 2 else f"{w[:2]}z{w[3:]}" for k, w in enumerate(words))  # each block before the passage changes
    assert brute_blocks(near) & brute_blocks(lines[70]) <= brute_blocks(lines[3]) | brute_blocks(lines[5]) and alike(near, lines[70])
    got = {r["doc_id"]: r["n_dropped"] for r in collect(line_dedup.dedup_lines(frame(spark, list(enumerate([*lines, near])))))}
    assert got == {k: int(k == 100) for k in range(101)}


def test_line_dedup_finds_lines_of_the_edit_similarity(spark, near_lines):
    """Against edit similarity alone, over all pairs: no false link, and nine in ten of the lines to drop."""
    got = collect(line_dedup.dedup_lines(frame(spark, near_lines)))
    _, first = first_places(near_lines)
    xs = sorted(first, key=first.get)
    roots = joined(xs, lambda a, b: alike(xs[a], xs[b]))
    kept = {(r["doc_id"], k) for r in got for k in r["kept_lines"]}
    to_drop = {first[x] for k, x in enumerate(xs) if roots[k] != k}
    dropped = set(first.values()) - kept
    assert dropped <= to_drop and len(dropped) >= 0.9 * len(to_drop), (len(dropped), len(to_drop))


def test_line_dedup_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a\na"), (4, "A "), (5, "one\ntwo\nthree"), (5, "four"), (None, "five\nsix"), (None, "seven"), (None, "one"), (6, "same\nsame two"), (6, "same\nsame two")]
    got = sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["kept_lines"]) for r in collect(line_dedup.dedup_lines(frame(spark, rows))))
    assert got == sorted(
        [("1", 0, 0, []), ("2", 1, 0, []), ("3", 2, 1, [0]), ("4", 1, 1, []), ("5", 3, 0, [0, 1, 2]), ("5", 1, 0, [0]), ("None", 2, 0, [0, 1]), ("None", 1, 0, [0]), ("None", 1, 1, []), ("6", 2, 0, [0, 1]), ("6", 2, 0, [0, 1])]
    )


def test_unlikely_lines_are_measured_once(spark):
    """Without the small distance that is tried first, the same lines are similar, by half the measurements."""
    rng = random.Random(8)
    texts = ["".join(rng.choices("ab |", k=rng.choice([1, 9, 10, 60, 1100]))) for _ in range(60)]
    texts += [t[:-1] + "z" for t in texts]
    pairs = spark.createDataFrame([(a, b) for a in texts[::3] for b in texts], "a string, b string")
    likely, unlikely = line_dedup.similar("a", "b", 0.8), line_dedup.similar("a", "b", 0.8, likely=False)
    held = pairs.select(likely.alias("x"), unlikely.alias("y")).groupBy("x", "y").count().collect()
    assert {(r["x"], r["y"]) for r in held} == {(True, True), (False, False)}
    assert str(unlikely).count("levenshtein") * 2 == str(likely).count("levenshtein")


def test_line_dedup_of_giant_lines(spark):
    rng = random.Random(8)
    words = [f"{rng.choice('abcdefgh')}{k}" for k in range(3000)]
    giant = [rng.choice(words) for _ in range(200_000)]
    changed = list(giant)
    for k in range(0, len(changed), 50_000):
        changed[k] = "changed"
    rows = [(1, " ".join(giant)), (2, " ".join(changed)), (3, "x" * 1_000_000), (4, "- " * 100_000 + "end")]
    got = {r["doc_id"]: r["kept_lines"] for r in collect(line_dedup.dedup_lines(frame(spark, rows)))}
    assert got == {1: [0], 2: [], 3: [0], 4: [0]}


def test_simhash_of_few_features_is_a_majority(spark):
    from pyspark.sql import functions as F

    rng = random.Random(6)
    rows = [([rng.getrandbits(64) - (1 << 63) for _ in range(n)],) for n in (0, 1, 2, 3, 4, 5, 6, 7, 7, 7)]
    for r in spark.createDataFrame(rows, "h array<long>").select("h", line_dedup.simhash(F.col("h")).alias("print")).collect():
        assert r["print"] & (1 << 64) - 1 == sum(1 << b for b in range(64) if sum(x >> b & 1 for x in r["h"]) * 2 > len(r["h"]))


# --- 5 ------------------------------------------------------------------------------------------


def check_packing(rows, got, capacity=4096):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            at += r["length"]
            assert zlib.crc32(np.array(ids[r["start"] : at], dtype="<u4").tobytes()) == r["ids_crc32"]
        assert at == len(ids)
    for held in by_seq.values():
        at = 0
        for r in sorted(held, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(by_seq), sum(r["length"] for r in got)


def test_packing(spark, corpus):
    rows = [r for r in corpus if r[0] is not None] + [(900 + k, "river stone light " * 470) for k in range(60)]
    sequences, tokens = check_packing(rows, collect(packing.pack(frame(spark, rows, True))))
    assert sequences <= tokens / 4096 * 1.05 + 1


def test_best_fill_is_a_best_fill():
    rng = random.Random(2)
    for _ in range(200):
        counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(rng.randrange(1, 6))}
        room = rng.randrange(0, 60)
        sums = {0}
        for length, n in counts.items():
            sums = {s + k * length for s in sums for k in range(n + 1)}
        total, taken = packing.best_fill(counts, room)
        assert total == max(s for s in sums if s <= room) == sum(k * n for k, n in taken.items())
        assert all(n <= counts[k] for k, n in taken.items())


@pytest.mark.parametrize("counts", [{}, {4096: 3}, {2100: 1000}, {1: 5}, {3000: 10, 1500: 10, 1096: 4}])
def test_plan_places_every_token_once(counts):
    rows = packing.plan(counts, 4096, 128, 32)
    held = defaultdict(list)
    used = defaultdict(list)
    for source, rank, n, _, start, size, sequence, offset in rows:
        for k in range(n):
            held[source, rank + k].append((start, size))
            used[sequence + k].append((offset, size))
    assert sorted(held) == sorted((length, k) for length, n in counts.items() for k in range(n))
    for (length, _), parts in held.items():
        at = 0
        for start, size in sorted(parts):
            assert start == at
            at += size
        assert at == length
    for parts in used.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= 4096
    if sum(counts.values()) > 100:
        assert len(used) <= sum(k * n for k, n in counts.items()) / 4096 * 1.04 + 1


def test_joined_checksums():
    rng = random.Random(4)
    for _ in range(50):
        a, b = rng.randbytes(rng.randrange(50)), rng.randbytes(rng.randrange(3000))
        assert packing.crc32_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_encoder_equals_the_tokenizer():
    encoder = packing.Encoder(packing.default_tokenizer(), 2)
    odd = ["Don't it's I'LL <|endoftext|> a.b,c)., x", "ÀÉ ΑΣ Σ word's,' 12,3 | a|b a_b. é́ ", "ﬁ İstanbul ß A B\x1cC\tD", "", "  ", "...", "a.'s b.'", "tail... tail.) <a>. \n\n x"]
    for k, packed in enumerate(encoder.encode(odd)):
        assert np.frombuffer(packed, dtype="<u4").tolist() == encoder.tokenizer.encode(odd[k], add_special_tokens=False).ids + [2], odd[k]


# --- 6 ------------------------------------------------------------------------------------------


def brute_contamination(rows, items):
    out = {}
    split = lambda t: [w.decode() for w in decontaminate.words(t or "")]
    windows = defaultdict(set)
    for item, t in items:
        w = split(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k : k + 13])].add(item)
    for i, t in rows:
        w, hit, held = split(t), set(), set()
        for window, holders in windows.items():
            for k in range(len(w) - len(window) + 1):
                if tuple(w[k : k + len(window)]) == window:
                    hit |= set(range(k, k + len(window)))
                    held |= holders
        out[i] = (len(w), len(hit), len(held), hashlib.sha256(",".join(sorted(map(str, held))).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def test_decontamination(spark):
    rng = random.Random(9)
    words = ["the", "of", "and", "sea", "River", "Émile"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, text(30)) for k in range(12)] + [(20, "short item"), (21, ""), (22, None), (23, "the")]
    rows = [(k, text(40) + " " + (items[k % 12][1] if k % 3 else "") + ", " + text(rng.randrange(400))) for k in range(60)]
    rows += [(100, None), (101, ""), (102, "a SHORT: item."), (103, items[4][1] * 50), (104, "the end of")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = collect(decontaminate.contamination_digest(frame(spark, rows, True), benchmark))
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got} == brute_contamination(rows, items)
    kept = {r["doc_id"] for r in collect(decontaminate.drop_contaminated(frame(spark, rows), benchmark))}
    assert kept == {r["doc_id"] for r in got if not r["contaminated"]}


def test_decontamination_in_parts_and_without_items(spark, monkeypatch):
    items = [(k, f"alpha beta gamma {k} delta epsilon") for k in range(9)]
    rows = [(1, "x alpha beta gamma 3 delta epsilon alpha beta gamma 4 delta epsilon"), (2, "nothing")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    whole = {r["doc_id"]: tuple(r.values()) for r in collect(decontaminate.contamination_digest(frame(spark, rows), benchmark))}
    monkeypatch.setattr(decontaminate, "QUERY_BYTES", 100)
    assert {r["doc_id"]: tuple(r.values()) for r in collect(decontaminate.contamination_digest(frame(spark, rows), benchmark))} == whole
    assert all(not r["contaminated"] for r in collect(decontaminate.contamination_digest(frame(spark, rows), benchmark.limit(0))))


def test_proximity(spark):
    queries = decontaminate.Queries([(1, "red green blue")], 13)
    index = decontaminate.build_index(frame(spark, [(1, "red green blue"), (2, "red very green blue"), (3, "blue green red"), (4, "red x x x x green blue")]), queries, slop=1)
    got = {r["doc_id"]: (r["items"], r["near_items"]) for r in collect(decontaminate.search(index, queries, slop=1))}
    assert got[1] == ([1], [1]) and got[2] == ([], [1]) and got[3] == ([], []) and got[4] == ([], [])


@pytest.mark.parametrize("limit", [64 << 20, 60])
def test_decontamination_of_repeated_and_missing_identifiers(spark, monkeypatch, limit):
    items = [(k, f"alpha beta gamma {k} delta epsilon") for k in range(9)]
    rows = [(1, "alpha beta gamma 3 delta epsilon"), (1, "clean words"), (None, "alpha beta gamma 4 delta epsilon"), (None, "clean too"), (None, None), (2, "alpha beta gamma 3 delta epsilon")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "QUERY_BYTES", limit)
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in collect(decontaminate.contamination_digest(frame(spark, rows), benchmark)))
    assert got == [("1", 2, 0, 0, False), ("1", 6, 6, 1, True), ("2", 6, 6, 1, True), ("None", 0, 0, 0, False), ("None", 2, 0, 0, False), ("None", 6, 6, 1, True)]
    kept = collect(decontaminate.drop_contaminated(frame(spark, rows), benchmark))
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in kept) == [("1", "clean words"), ("None", "None"), ("None", "clean too")]


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_near_copies_are_judged_by_row(spark, monkeypatch, few):
    monkeypatch.setattr("segno.llm.common.BROADCAST_ROWS", few)
    rows = [(5, "one two three four five six"), (5, "other words are here now"), (3, "other  words are here now"), (None, "one two three four five  six"), (None, "lone text without any like it")]
    kept = sorted((str(r["doc_id"]), r["text"]) for r in collect(simhash.drop_near_copies(frame(spark, rows, True))))
    assert kept == [("3", "other  words are here now"), ("5", "one two three four five six"), ("None", "lone text without any like it")]


def test_hot_fingerprints_are_spread(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_ROWS", 10)
    monkeypatch.setattr(simhash, "MOST_HOT", 5)
    rows = [(k, None) for k in range(300)] + [(400 + k, f"text number {k} of some") for k in range(5)] + [(None, "")] * 50
    got = collect(simhash.simhash_digest(frame(spark, rows)))
    assert len(got) == 355 and all(r["component_id"] == 0 for r in got if r["fingerprint"] == "0" * 16)


def test_shards_of_many_empty_rows(spark):
    from pyspark.sql import functions as F

    empty = spark.range(200_000).select(F.when(F.col("id") % 3 == 0, F.col("id")).alias("doc_id"), F.lit(None).cast("string").alias("text"))
    some = spark.range(200).select((F.col("id") + 900_000).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string"), F.lit("y" * 500)).alias("text"))
    got = sharding.shard_by_bytes(empty.unionByName(some)).groupBy("shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.max("slot").alias("last"), F.countDistinct("slot").alias("slots")).collect()
    mean = sum(r["bytes"] for r in got) / 16
    assert len(got) == 16 and all(abs(r["bytes"] - mean) < 0.06 * mean and r["n"] == r["slots"] == r["last"] + 1 for r in got)


# --- 1 ------------------------------------------------------------------------------------------


def scan(text, templates=None):
    automata = [(label, license_scan.compile_template(t)) for label, several in (templates or license_scan.TEMPLATES).items() for t in several]
    base = {b" " + b" ".join(license_scan.words(p)) + b" ": label for p, label in license_scan.BASE.items()}
    return license_scan.scan_text(text, base, automata)


@pytest.mark.parametrize("template", ['<<var;match="foo bar|baz">>', '<<beginOptional>>the <<endOptional>><<var;match="foo bar|baz">>'])
def test_templates_without_wording_at_the_top_match(template):
    assert [(m["start"], m["end"]) for m in scan("the baz or foo bar", {"x": [template]})[1]][-1] == (3, 5) and not scan("foo the bar", {"x": [template]})[1]


@pytest.mark.parametrize(
    ("label", "text", "off"),
    [
        ("gpl-3.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License", "Software"),
        ("lgpl-2.1", "modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1", "Lesser"),
        ("agpl-3.0", "licensed under the GNU Affero General Public License version 3", "Affero"),
        ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Attribution"),
        ("cc-by-sa-4.0", "licensed under CC BY-SA 4.0", "SA"),
        ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla"),
        ("bsd-2-clause", license_scan._BSD.replace("<<beginOptional>>", "").replace("<<endOptional>>", "") + "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED", "DISCLAIMED"),
        ("cc0-1.0", "under CC0 1.0 Universal", "Universal"),
    ],
)
def test_published_notices_match_and_near_misses_do_not(label, text, off):
    assert label in {m["label"] for m in scan("Some words. " + text + " And more.")[1]}
    assert label not in {m["label"] for m in scan(text.replace(off, "else"))[1]}


def test_long_texts_take_time_in_proportion():
    began = time.perf_counter()
    assert len(scan("all rights reserved " * 250_000)[1]) == 250_000
    assert toxicity.decode("1d10t" * 100_000, [-3.0] * 28**3)
    assert time.perf_counter() - began < 30


def test_licenses(spark):
    rows = [
        (1, "Released under the terms of the MIT License."), (2, "x CC-BY, cc by cc by. All Rights Reserved"), (3, None), (4, "This work is licensed under the GNU General Public License, version 3."),
        (5, "Copyright 2020 Some One. All rights reserved."), (6, "released under the big mit license"), (7, "Licensed under CC BY-NC 4.0."),
    ]
    got = {r["doc_id"]: r for r in collect(license_scan.license_digest(frame(spark, rows, True)))}
    assert (got[1]["labels"], got[1]["base_labels"], got[1]["n_base"], got[1]["first_word"], got[1]["score"]) == ("mit", "", 0, None, 1.0)
    assert (got[2]["n_base"], got[2]["first_word"], got[2]["last_word"], got[2]["base_labels"], got[2]["score"]) == (4, 1, 7, "cc-by,reserved", 0.5)
    assert (got[3]["n_words"], got[3]["labels"], got[3]["score"]) == (0, "", 0.0)
    assert got[4]["labels"] == "gpl,gpl-3.0" and got[5]["labels"] == "copyright-notice,reserved" and got[6]["labels"] == "" and got[7]["labels"] == "cc-by,cc-by-nc-4.0"


def test_automata_accept_the_language_of_their_regex():
    import itertools
    import re

    for template in ("a <<beginOptional>>b <<endOptional>>c", "<<var;match=\"a|b c\">> d", "a <<var;words=\"0,2\">> b", "a <<beginOptional>>b <<beginOptional>>c <<endOptional>><<endOptional>>d"):
        auto, pattern = license_scan.compile_template(template), re.compile(license_scan.to_regex(template))
        for n in range(5):
            for held in itertools.product([b"a", b"b", b"c", b"d"], repeat=n):
                line = "".join(w.decode() + " " for w in held)
                ends = [k for k in range(n + 1) if pattern.fullmatch("".join(w.decode() + " " for w in held[:k]))]
                assert auto.longest(list(held), 0) == max(ends, default=-1), (template, line)


# --- 7 ------------------------------------------------------------------------------------------


def test_language_id(spark):
    rng = random.Random(3)
    pools = {"xx": "ra mo ti ken sul".split(), "yy": "vö gnu pry ofs ekl".split()}
    rows = [(k, " ".join("".join(rng.choice(pools[x]) for _ in range(3)) for _ in range(30)), x) for k in range(300) for x in (("xx", "yy")[k % 2],)]
    rows += [(900, None, "xx"), (901, "12 ...", None), (902, "", "yy")]
    df = spark.createDataFrame([(i, t, x, "s", 0) for i, t, x in rows], DOC).repartition(3)
    got = {r["doc_id"]: r for r in collect(langid.language_digest(df))}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got.values())
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    held = [(i, x) for i, _, x in rows[:300] if got[i]["held_out"]]
    assert sum(got[i]["lang_pred"] == x for i, x in held) >= 0.98 * len(held)
    assert all(got[i]["lang_pred"] == "und" for i in (900, 901, 902))
    assert {r["doc_id"] for r in collect(langid.drop_unknown_language(df))} == set(range(300))
    assert {r["lang_pred"] for r in collect(langid.predict(df, langid.train(df.limit(0).select("text", "lang"))))} == {"und"}


def test_filters_hold_every_ngram_they_were_given(spark):
    df = spark.createDataFrame([("abcdefgh", "aa"), ("abcdxyz", "bb")], "text string, lang string")
    filters = langid.train(df)
    grams = langid.ngrams("abcdefgh", 4)
    places = langid.slots_of(grams, len(filters.slots), filters.hashes)
    masks = filters.slots[places[0], 0] & filters.slots[places[1], 0]
    assert (masks & np.uint64(1)).all() and filters.languages == ["aa", "bb"]
    assert langid.ngrams("x" * 5_000, 4).shape == (4_999,)


# --- 9 ------------------------------------------------------------------------------------------


def test_toxicity(spark):
    rng = random.Random(11)
    words = "stone river light tree bird cloud wind leaf wave moss fern rain".split()
    rows, labels = [], []
    for k in range(1200):
        held = [rng.choice(words) for _ in range(40)]
        toxic = k % 5 == 0
        if toxic:
            for bad in rng.sample(["grumbol", "snerkel", "vuldrat"], 2):
                held.insert(rng.randrange(len(held)), bad)
        rows.append((k, " ".join(held)))
        labels.append((k, 1, int(toxic)))
    rows += [(5000, None), (5001, ""), (5002, "stone GRUMBOL river"), (5003, "gr.u.m.b0l snerkel you"), (5004, "a g r u m b o l s n e r k e l b")]
    df, held = frame(spark, rows, True), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in collect(toxicity.toxicity_digest(df, held))}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    out = [k for k in range(1200) if got[k]["held_out"]]
    assert out and all(got[k]["predicted"] == (k % 5 == 0) for k in out)
    assert got[5000]["score"] == got[5001]["score"] < 0.3 and got[5003]["score"] > got[5000]["score"]
    nothing = {r["score"] for r in collect(toxicity.toxicity_digest(df, held.limit(0)))}
    assert nothing == {0.0}


def test_decoding_restores_hidden_words(spark):
    docs = frame(spark, [(k, "the idiot and the stupid loser moron trash of it ") for k in range(5)])
    model = toxicity.train_characters(docs)
    assert [toxicity.decode(x, model) for x in ("1d10t", "st.u.p.1d", "looooser", "tr@sh", "idiot")] == ["idiot", "stupid", "loser", "trash", "idiot"]
    assert toxicity.spaced("you i d i o t and") == ["idiot"]


def test_hidden_words_of_all_kinds_are_decoded(spark):
    docs = frame(spark, [(k, "you idiot and the stupid shit hate fool ass of it are you an idiot or a fool you stupid ass ") for k in range(5)])
    model = toxicity.train_characters(docs)
    for token, word in {"a$$": "ass", "5h17": "shit", "sh!7": "shit", "sh!7!": "shit", "1d107": "idiot", "idi07": "idiot", "h473": "hate", "f001": "fool", "stuupiid": "stupid", "*1d107*": "idiot"}.items():
        assert word in toxicity.restored(token, model), token
    for text in ("y o u i d i o t", "y o u  i d i 0 t", "y o\nu i d i o o t"):
        (token,) = toxicity.spaced("So " + text + " there")
        assert {"you", "idiot"} <= set(toxicity.restored(token, model, run=True)), text
    assert toxicity.spaced("an a s s here") == ["ass"] and toxicity.spaced("a b and") == [] and toxicity.restored("letter.", model)[0] == "letter"


def test_toxicity_reads_a_token_once(monkeypatch):
    """A token that was read is not read again, not in another task of its worker either; the evidence is that of the plain form."""
    read: list[str] = []
    restored = toxicity.restored
    monkeypatch.setattr(toxicity, "restored", lambda token, *a, **k: read.append(token) or restored(token, *a, **k))
    draw = random.Random(3)
    model = [draw.random() - 1 for _ in range(28**3)]
    tokens = toxicity.Tokens(model)
    first, again = (toxicity._document_features("an idiooot, st.u.p.1d idiooot", tokens) for _ in range(2))
    assert sorted(read) == sorted({"an", "idiooot,", "st.u.p.1d", "idiooot"}) and set(first) == set(again)

    lexicon = toxicity.Lexicon(array("d", [draw.random() ** 6 for _ in range(toxicity.BUCKETS)]), model)
    for text in ["", " ", "a", "i d i o t", "x y i d i o t idiot", "élève èè " * 3, *("".join(draw.choices("iIdot1 !$-.*'éa\n\t,", k=draw.randrange(200))) for _ in range(200))]:
        own, hidden = text.lower().split(), toxicity.spaced(text.lower())
        score = lambda t, run: max((lexicon.scores[b] for w in restored(t, model, run) for b in toxicity.features(w)), default=0.0)
        every = [(t, score(t, False)) for t in own] + [(t, score(t, True)) for t in hidden]
        bad = sorted({t: v for t, v in every if v >= toxicity.BAD_WORD / 2}.values(), reverse=True) + [0.0, 0.0]
        n = sum(v >= toxicity.BAD_WORD for _, v in every)
        logit = lambda p: float(np.log(max(p, 0.01) / max(1 - p, 0.01)))
        want = [logit(max((v for _, v in every), default=0.0)), logit(bad[1]), float(np.log1p(n)), float(np.log((n + 0.5) / (len(every) + 20)))]
        assert toxicity.evidence(text, lexicon) == want, text


# --- 10 -----------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Menu</a></ul></nav><!-- ad -->
<div class="ad">Buy <b>now</b></div><article><h1>Head&amp;line</h1><p><b>First</b> par<i>t</i>.<br>Next&nbsp;line<p>Second &lt;p&gt;
 wrapped<aside>side</aside><div class="comments"><p>reader</p></div><form>send</form></article><footer>&copy; foot</footer></body></html>"""


def test_main_text():
    assert html_extract.main_text(PAGE) == "Head&line First part. Next line Second <p> wrapped"
    assert html_extract.main_text("") == "" and html_extract.main_text("just text & more") == "just text & more"
    assert html_extract.main_text("<p>open <b>never closed") == "open never closed" and html_extract.main_text("<p>a<!-- never") == "a"
    assert html_extract.main_text('<main><p title="x > y">a</p></main><p>b') == "a"
    assert html_extract.main_text("<article><header><h1>Title</h1><p>by me</p></header>Body</article>") == "Title Body"


def test_only_the_main_role_makes_an_article():
    page = '<div><a role="button" href="https://domain.example">Press</a><p>Text</p></div>'
    assert html_extract.main_text(page) == "Press Text"
    assert html_extract.main_text('<div role="main"><p>a</p></div><p>b') == "a" and html_extract.main_text("<div class='x' ROLE=main>a</div><p>b") == "a"


def test_quotes_in_tags_and_in_text():
    assert html_extract.main_text("<a title=don't>two</a><p>three isn't four") == "two three isn't four"
    assert html_extract.main_text("""<p title='a > "b"' class = "x>y">text</p> it's <b data-x=1>bold</b>""") == "text it's bold"
    assert html_extract.main_text("""<a href="x"">link</a> 'quoted' <p class="a" b>end""") == "link 'quoted' end"
    assert html_extract.main_text('<p>a <b title="never closed>b</b> c') == "a b c"
    began = time.perf_counter()
    for odd in ("<a b='", '<a b="x ', "<a <", "<p =' ", "<!x"):
        html_extract.main_text(odd * 100_000)
        html_extract.main_text(odd * 100_000 + ">")
    assert time.perf_counter() - began < 20


def test_comments_that_are_articles_are_left_out():
    assert html_extract.main_text('<main><article><p>Body</p></article><article class="comment"><p>reader</p></article></main>') == "Body"


def test_an_article_resets_what_a_compound_name_marks():
    for wrapper in ('class="layout has-sidebar"', 'id="search-page"', 'class="no-ads with_menu"'):
        for tag in ("article", "main", 'div role="main"'):
            page = f'<div {wrapper}><p>by</p><{tag}><p>Body</p><p class="share-bar">Share</p></{tag.split()[0]}><div class="sidebar"><article>Teaser</article></div></div>'
            assert html_extract.main_text(page) == "Body", page
    assert html_extract.main_text('<div class="x sidebar"><article>a</article></div><aside><article>b</article></aside><div hidden><main>c</main></div>') == ""


def test_template_text_of_a_host_is_left_out(spark):
    pages = [(k, f"https://Host.example/{k}", f"<body><div><p>Always here</p></div><div><p>Only {k}</p></div></body>") for k in range(8)]
    pages += [(100, "https://lone.example/", "<body><p>Always here</p></body>"), (101, None, None), (102, "odd", "<p>x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in collect(html_extract.extract_digest(df))}
    assert all(got[k]["text"] == f"Only {k}" for k in range(8))
    assert got[100]["text"] == "Always here" and got[101]["text"] == "" and got[102]["text"] == "x" and got[102]["n_chars"] == 1


def test_template_text_inside_articles_is_left_out(spark):
    page = "<body><article><h1>Head {0}</h1><p>Only <b>{0}</b> and <i>more</i> of {0}</p><div><b>Written by our staff</b></div><ul><li>Tell others</ul></article></body>"
    pages = [(k, f"https://host.example/{k}", page.format(k)) for k in range(6)] + [(10, "https://lone.example/", page.format(10))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in collect(html_extract.extract_digest(df))}
    assert all(got[k] == f"Head {k} Only {k} and more of {k}" for k in range(6)) and got[10] == "Head 10 Only 10 and more of 10 Written by our staff Tell others"


@pytest.mark.parametrize("limit", [2_000_000, 0])
def test_copies_of_a_page_are_no_template(spark, monkeypatch, limit):
    monkeypatch.setattr(html_extract, "BROADCAST_TOKENS", limit)
    pages = [(k, f"https://copies.example/a?from={k}", f"<body><nav>{k}</nav><div><p>The story</p><p>and its end</p></div></body>") for k in range(6)]
    pages += [(10 + k, f"https://copies.example/{k}", f"<body><nav>{k}</nav><div><p>Other {k}</p></div></body>") for k in range(3)]
    pages += [(20 + k, f"https://both.example/{k // 3}", f"<body><p>Always here</p><div><p>Only {k // 3}</p></div></body>") for k in range(12)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in collect(html_extract.extract_digest(df))}
    assert all(got[k] == "The story and its end" for k in range(6)) and all(got[10 + k] == f"Other {k}" for k in range(3))
    assert all(got[20 + k] == f"Only {k // 3}" for k in range(12))


# --- empty tables and the pipeline --------------------------------------------------------------


@pytest.mark.parametrize(
    "run",
    [
        exact_dedup.exact_dedup, sharding.sharding_digest, simhash.simhash_digest, line_dedup.dedup_lines, packing.pack, license_scan.license_digest, langid.language_digest,
        exact_dedup.drop_exact_copies, simhash.drop_near_copies, langid.drop_unknown_language,
    ],
)
def test_empty_tables(spark, run):
    assert run(spark.createDataFrame([], DOC)).count() == 0


def test_other_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOC), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination_digest(docs, items).count() == 0
    assert toxicity.toxicity_digest(docs, spark.createDataFrame([], "doc_id long, toxic int")).count() == 0
    assert html_extract.extract_digest(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pipeline_against_brute_force(spark, corpus, tmp_path):
    import corpus_pipeline

    rows = [r for r in corpus if r[0] is not None]
    items = [(1, " ".join(rows[7][1].split()[:20]))]
    docs = frame(spark, rows)
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = collect(corpus_pipeline.run(spark, str(tmp_path)))
    kept = [(i, t) for i, t in rows if any(c.isalpha() for c in t or "")]
    last = {t: i for i, t in sorted(kept)}
    kept = [(i, t) for i, t in kept if last[t] == i]
    parent = {i: i for i, _ in kept}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    prints = {i: brute_fingerprint(t) for i, t in kept}
    for a in prints:
        for b in prints:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= 2:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    kept = [(i, t) for i, t in kept if root(i) == i]
    found = brute_contamination(kept, items)
    kept = [(i, t) for i, t in kept if not found[i][4]]
    assert {r["doc_id"] for r in got} == {i for i, _ in kept}
    check_packing(kept, got)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontamination", "packing"]


def test_pages_are_read_once_for_their_templates(spark):
    """Classes, their nesting and their closing tags take the tokens from one reading of the pages."""
    page = "<html><body><div class='x'><p>Same words here</p><p>%s</p></div></body></html>"
    rows = [(k, "http://a/x", page % f"own text {k}") for k in range(4)]
    pages = html_extract._pages(spark.createDataFrame(rows, "page_id long, url string, html string"), "page_id", "url", "html")
    found = html_extract.templates(pages)
    assert "MapInArrow" not in found._jdf.queryExecution().toString()
    assert [r["host"] for r in found.collect()] == ["a"]
