"""Periodic runs against a search over all periods."""

import hashlib
import random
import zlib

import numpy as np

from salescope.llm import periodic, queries

SF = "/root/testdata/sf0.001"


def brute(words, least=24, exponent=3):
    """All periods in turn: the longest stretches of words equal to the one a period later."""
    n, found = len(words), []
    w = np.unique(np.array(words, object), return_inverse=True)[1] if n else np.empty(0, int)
    for q in range(1, n // exponent + 1):
        same = np.concatenate([[False], w[:-q] == w[q:], [False]])
        for i, j in np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2).tolist():
            size = j - i + q
            if size >= max(least, exponent * q):
                part = w[i:i + size]
                if not any((part[:-d] == part[d:]).all() for d in range(1, q)):
                    found.append((i, size, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_runs_of_random_words():
    r = random.Random(5)
    for _ in range(300):
        kinds, n = r.choice([1, 2, 2, 3, 5, 30]), r.randrange(90)
        words = [b"%d" % r.randrange(kinds) for _ in range(n)]
        for _ in range(r.randrange(3)):
            if n:
                a, p = r.randrange(n), r.randrange(1, 9)
                for i in range(a, min(n, a + r.randrange(60))):
                    words[i] = words[a + (i - a) % p]
        for least, exponent in ((24, 3), (2, 2), (6, 2), (9, 4)):
            assert periodic.find(words, least, exponent) == brute(words, least, exponent)


def test_runs_that_overlap_and_share_their_start():
    line = [b"%d" % i for i in range(8)]
    words = (line + [b"x"] * 24) * 3  # runs of period 1 inside one of period 32
    assert periodic.find(words) == brute(words) == [(0, 96, 32), (8, 24, 1), (40, 24, 1), (72, 24, 1)]
    assert periodic.find([b"a"] * 24) == [(0, 24, 1)] and periodic.find([b"a"] * 23) == []


def test_collapse_keeps_the_first_period():
    words = [b"s"] + [b"a", b"b", b"c"] * 9 + [b"e"]
    assert periodic.collapse(words, periodic.find(words)) == [b"s", b"a", b"b", b"c", b"e"]


def test_long_texts():
    words = [b"%d" % (i % 7) for i in range(60_000)]
    assert periodic.find(words) == [(0, 60_000, 7)]
    r = random.Random(2)
    block = [b"%d" % r.randrange(4000) for _ in range(9000)]
    assert periodic.find(block * 3 + [b"end"]) == [(0, 27_000, 9000)]


def test_odd_rows(spark):
    schema = "doc_id bigint, text string, RUNS string, extra int"
    data = [(1, None, "r", 1), (2, "", "r", None), (None, "a " * 30, None, 3), (4, "a\u00a0b " * 24, "r", 4), (4, "a\u00a0b " * 24, "r", 4)]
    got = sorted(periodic.runs(spark.createDataFrame(data, schema)).collect(), key=lambda x: (x.doc_id or 0, x.n_words))
    assert [(g.doc_id, g.n_words, [tuple(r) for r in g.runs], g.collapsed, g.extra) for g in got] == [
        (None, 30, [(0, 30, 1)], "a", 3), (1, 0, [], "", 1), (2, 0, [], "", None),
        (4, 24, [(0, 24, 1)], "a\u00a0b", 4), (4, 24, [(0, 24, 1)], "a\u00a0b", 4)]
    assert periodic.runs(spark.createDataFrame([], schema)).count() == 0


def edited(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op12_periodic_runs(spark, SF).collect()}
    assert len(got) == len(rows) and sum(r.n_runs > 0 for r in got.values()) > 5
    for doc_id, text in rows:
        words = edited(doc_id, text)
        found = brute(words)
        best = None
        for s, n, q in found:
            if best is None or n * best[2] > best[1] * q:
                best = (s, n, q)
        kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in found)]
        g = got[doc_id]
        assert (g.n_runs, g.start, g.length, g.period) == (len(found), *(best or (None,) * 3))
        assert g.exponent_milli == (best and 1000 * best[1] // best[2])
        assert g.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        assert g.collapsed_sha256 == hashlib.sha256(b" ".join(kept)).hexdigest()
