"""Periodic runs, vector codes and archives against brute force, on small fixtures with odd rows."""

import base64
import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from segno.llm import periodic_runs, vector_codes, warc

CLASHING = ("row", "n", "pos", "part", "cls", "runs", "entry", "error", "code", "sha1", "size", "to_row", "path", "cells", "html_", "text_")


def clash(df):
    for c in CLASHING:
        df = df.withColumn(c, F.lit("x"))
    return df


def collect(df):
    return [r.asDict() for r in df.collect()]


# --- 11 -----------------------------------------------------------------------------------------


def brute_runs(words, least=24, times=3):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i >= q:
                found.setdefault((i, j - i + q), q)
            i = j
    return sorted((s, n, q) for (s, n), q in found.items() if n >= max(least, times * q))


def brute_row(doc_id, text):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text or "") if w]
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if found else (None, None, None)
    return {
        "doc_id": doc_id, "n_runs": len(found), "start": best[0], "length": best[1], "period": best[2],
        "exponent_milli": best[1] * 1000 // best[2] if found else None,
        "runs_sha256": hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest(),
        "collapsed_sha256": hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest(),
    }


def periodic_texts():
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 200)))) for k in range(150)]
    for k in range(150, 210):  # nested repeats: runs that overlap, tie and hold shorter ones
        unit = [rng.choice("ab") for _ in range(rng.randrange(1, 9))]
        rows.append((k, " ".join((unit * rng.randrange(1, 40) + [rng.choice("ab") for _ in range(rng.randrange(5))]) * rng.randrange(1, 4))))
    rows += [(300, None), (301, ""), (302, " \t\n"), (303, "one"), (304, "x " * 24), (305, "x " * 23), (306, "a\x0bb\x0cc " * 9), (307, "é ü " * 13), (None, "p q " * 30), (304, "x " * 24)]
    rows += [(400, "na me " * 30), (401, " ".join(f"w{k}" for k in range(700)) + " tail" * 30)]
    return rows


def test_runs_against_brute_force(spark):
    rows = periodic_texts()
    df = clash(spark.createDataFrame(rows, "doc_id long, text string")).repartition(3)
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["collapsed_sha256"])
    assert sorted(collect(periodic_runs.runs_digest(df)), key=key) == sorted((brute_row(*r) for r in rows), key=key)


def test_runs_of_long_texts_beside_short_ones():
    rng = random.Random(2)
    unit = [f"u{rng.randrange(50)}".encode() for _ in range(4001)]
    long = [f"v{k}".encode() for k in range(3000)] + unit * 4
    got = periodic_runs.digests([long, [b"a"] * 40, []])
    assert got[0][:5] == (1, 3000, 16004, 4001, 4000) and got[1][:5] == (1, 0, 40, 1, 40000) and got[2][0] == 0


def test_runs_beyond_the_packed_keys(monkeypatch):
    monkeypatch.setattr(periodic_runs, "KEYED", 16)  # keys of three numbers are then sorted one by one
    rng = random.Random(9)
    for _ in range(40):
        words = [rng.randrange(2) for _ in range(rng.randrange(1, 90))]
        marks = np.array([*words, 9], dtype=np.int32)
        assert [tuple(r) for r in periodic_runs.runs(marks, np.array([len(marks)]), 6, 2).tolist()] == brute_runs(words, 6, 2)


def test_runs_as_rows_and_of_nothing(spark):
    df = spark.createDataFrame([(1, "z " + "a b " * 14), (2, "no run here")], "doc_id long, text string")
    assert collect(periodic_runs.text_runs(df)) == [{"doc_id": 1, "start": 1, "length": 28, "period": 2}]
    assert periodic_runs.runs_digest(df.limit(0)).count() == 0


# --- 12 -----------------------------------------------------------------------------------------


def brute_codes(rows, parts=16, entries=64, rounds=2):
    kept = []
    for i, vec, label in rows:
        if vec and all(x is not None and math.isfinite(x) for x in vec) and len(vec) % parts == 0:
            kept.append((i, [math.floor(256 * x) for x in vec], label))
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, np.array(r[1], dtype="<i4").tobytes()))
    width = len(order[0][1]) // parts
    kept = [r for r in kept if len(r[1]) == width * parts]
    order = [r for r in order if len(r[1]) == width * parts]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(r[1], p) for r in order[:entries]] for p in range(parts)]

    def nearest(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            drawn = defaultdict(list)
            for r in kept:
                drawn[nearest(cut(r[1], p), books[p])[1]].append(cut(r[1], p))
            for k, held in drawn.items():
                books[p][k] = [sum(xs) // len(held) for xs in zip(*held, strict=True)]
    out, of_label = [], defaultdict(int)
    for i, v, label in kept:
        met = [nearest(cut(v, p), books[p]) for p in range(parts)]
        out.append([i, "".join(f"{k:02x}" for _, k in met), sum(e for e, _ in met), label])
        of_label[label] += out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted(({"vec_id": i, "code": c, "error": e, "label_error": of_label[label], "codebooks_sha256": digest} for i, c, e, label in out), key=repr)


def odd_vectors(n, width=2):
    rng = random.Random(n)
    make = lambda: [rng.choice((0.0, 0.1, -0.25, rng.gauss(0, 1))) for _ in range(16 * width)]
    rows = [(k * 3 % n, make(), rng.choice((0, 1, None))) for k in range(n)]
    rows += [(5, None, 1), (6, make()[:-1] + [None], 1), (7, make()[:-1] + [math.nan], 0), (8, make()[:-1] + [math.inf], 0), (9, [], 1), (10, [0.5] * 17, 1)]
    rows += [(2, rows[2][1], rows[2][2]), (2, make(), 1), (None, make(), None), (900, [0.0] * 32, 1)] + [(1000 + k, [0.0] * 32, 7) for k in range(40)]
    rows += [(-3, [1e5] * 32, 2), (3, [0.25] * 48, 2)]  # large numbers; another size
    return rows


@pytest.mark.parametrize("n", [3, 150])
def test_codes_against_brute_force(spark, n, monkeypatch):
    import segno.shared

    monkeypatch.setattr(segno.shared, "HOT_ROWS", 20)  # zeros are then sent to the vectors
    rows = odd_vectors(n)
    df = clash(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).repartition(3)
    assert sorted(collect(vector_codes.codes_digest(df)), key=repr) == brute_codes(rows)


def test_codes_of_nothing_and_of_other_shapes(spark):
    df = spark.createDataFrame([(1, [0.5, 1.0, -1.0], "a"), (2, [0.25, 1.0, -1.5], None)], "vec_id long, embedding array<float>, label string")
    assert vector_codes.codes_digest(df).count() == 0  # sixteen parts do not fit
    assert vector_codes.codes_digest(df.limit(0)).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    found, books = vector_codes.compress(df, parts=3, entries=1, rounds=1)
    assert books.tolist() == [[[96]], [[256]], [[-320]]] and {r["vec_id"]: (r["code"], r["error"]) for r in found.collect()} == {1: ("000000", 32**2 + 64**2), 2: ("000000", 32**2 + 64**2)}


# --- 13 -----------------------------------------------------------------------------------------


def brute_pages(rows):
    groups = defaultdict(list)
    for k, (i, _, html) in enumerate(rows):
        groups[html or ""].append((i is None, i or 0, k))
    out = []
    for k, (i, _, html) in enumerate(rows):
        data = (html or "").encode()
        first = min(groups[html or ""])
        revisit = first[2] != k and (first[:2] != (i is None, i or 0) or any(x[:2] == first[:2] and x[2] < k for x in groups[html or ""]))
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((i, len(data), digest, "revisit" if revisit else "response", None if not revisit or first[0] else first[1]))
    return sorted(out, key=repr)


PAGES = [(3, "http://a/1", "<p>same</p>"), (1, "http://a/2", "<p>same</p>"), (2, None, "<p>same</p>"), (1, "http://a/2", "<p>same</p>"), (9, "http://b/\r\nx", None), (8, "http://b", ""),
         (None, "u", "alone"), (None, "u", "null"), (4, "u", "null"), (None, "v", "two"), (None, "w", "two"), (5, "u", "é" * 70000 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"), (6, "u", "\x1f\x8b\x08 not a member")] + [(100 + k, "h", "hot") for k in range(60)]


def read_back(found):
    return sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in collect(found)), key=repr)


def test_pages_come_back_from_archives(spark, monkeypatch):
    import segno.shared

    monkeypatch.setattr(segno.shared, "HOT_ROWS", 20)
    df = clash(spark.createDataFrame(PAGES, "page_id long, url string, html string")).repartition(4)
    assert read_back(warc.archive_digest(df)) == brute_pages(PAGES)
    assert warc.archive_digest(df.limit(0)).count() == 0


def test_small_payloads_and_small_archives(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1)
    made = warc.write_archives(df, str(tmp_path), least_bytes=5, archive_bytes=2000)
    found = warc.records(warc.read_archives(made))
    assert made.count() > 1 and made.agg(F.sum("records")).first()[0] == len(PAGES)
    rows = collect(found)
    assert {r["type"] for r in rows if r["payload_bytes"] < 5} == {"response"} and any(r["type"] == "revisit" for r in rows)
    assert all(hashlib.sha1(bytes(r["payload"])).digest() == base64.b32decode(r["payload_digest"]) for r in rows if r["type"] == "response")
    assert {r["uri"] for r in rows if r["page_id"] == 9} == {"http://b/%0D%0Ax"}


def some_records(n=12):
    make = lambda k: warc.record("response", k, k, f"http://x/{k}", (b"page %d " % k) * (50 + 200 * k), len((b"page %d " % k) * (50 + 200 * k)), warc.base32_sha1((b"page %d " % k) * (50 + 200 * k)), None)
    return [make(k) for k in range(n)]


def salvaged(data):
    found = list(warc.salvage(lambda at, n: data[at : at + n], len(data)))
    return [int(x.headers["warc-page-id"]) for x in found if x.reason is None], [x for x in found if x.reason is not None]


@pytest.mark.parametrize("packed", [True, False])
def test_damage_costs_the_records_that_it_touches(packed):
    parts = [warc.member(r) if packed else r for r in some_records()]
    starts = np.cumsum([0, *map(len, parts)])
    rng = random.Random(4)
    assert salvaged(b"".join(parts)) == (list(range(12)), [])
    for _ in range(60):
        hit = sorted(rng.sample(range(12), 3))
        data = bytearray(b"".join(parts))
        for k in hit:
            at = rng.randrange(starts[k] + (10 if packed else 0), starts[k + 1] - (0 if packed else 4))
            data[at] ^= 0x41
        got, gaps = salvaged(bytes(data))
        assert set(range(12)) - set(hit) <= set(got) and got == sorted(got)
        lost = set(range(12)) - set(got)
        for gap in gaps:  # gaps are whole records, and only lost ones
            assert gap.offset in starts and gap.offset + gap.length in starts
        assert sum(g.length for g in gaps) == sum(len(parts[k]) for k in lost)


def test_cut_inserted_and_missing_bytes():
    parts = [warc.member(r) for r in some_records(6)]
    got, gaps = salvaged(b"".join(parts[:5]) + parts[5][:-7])
    assert got == [0, 1, 2, 3, 4] and [(g.offset, g.length) for g in gaps] == [(sum(map(len, parts[:5])), len(parts[5]) - 7)] and "cut off" in gaps[0].reason
    got, gaps = salvaged(b"noise" + parts[0] + b"\x00" * 9 + parts[1])
    assert got == [0, 1] and [(g.offset, g.length) for g in gaps] == [(0, 5), (5 + len(parts[0]), 9)]
    got, gaps = salvaged(parts[0] + parts[1][5:] + parts[2])  # a member without its beginning
    assert got == [0, 2] and gaps[0].length == len(parts[1]) - 5
    plain = some_records(3)
    wrong = plain[1].replace(b"Content-Length: ", b"Content-Length: 9", 2)
    got, gaps = salvaged(plain[0] + wrong + plain[2] + parts[3])  # plain records and members side by side
    assert got == [0, 2, 3] and gaps[0].length == len(wrong)
    assert salvaged(b"") == ([], []) and len(salvaged(b"junk" * 10)[1]) == 1
    assert salvaged(warc.member(plain[0] + plain[1]))[0] == [0, 1]  # two records in one member


def test_gaps_as_rows(spark, tmp_path):
    df = spark.createDataFrame([(k, "u", f"page {k} " * 400) for k in range(30)], "page_id long, url string, html string").coalesce(1)
    made = warc.write_archives(df, str(tmp_path))
    path = made.first()["path"]
    data = bytearray(open(path, "rb").read())
    data[len(data) // 2] ^= 0xFF
    open(path, "wb").write(data)
    found = warc.read_archives(made, payloads=False)
    assert warc.records(found).count() == 29 and [(r["path"], r["length"] > 0) for r in warc.gaps(found).collect()] == [(path, True)]
