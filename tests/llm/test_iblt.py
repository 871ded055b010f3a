import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from salescope.llm import iblt, queries

SF = "/root/testdata/sf0.001"


def parts(text):
    """The set of a text's pieces: lines; of long ones sentences; then after words, then signs, whose hash says so; then slices."""
    def finer(pieces, cut):
        return [q for p in pieces for q in ([p] if len(p) <= 160 else cut(p))]

    def after(units, n):
        pieces, now = [], ""
        for u in units:
            now += u
            if xxhash.xxh64_intdigest(u.encode(), seed=42) % n == 0:
                pieces, now = [*pieces, now], ""
        return [p for p in [*pieces, now] if p]

    pieces = finer((text or "").split("\n"), lambda p: re.split(r"(?<=[.!?]) ", p))
    pieces = finer(pieces, lambda p: after(re.findall(r"[^ ]* |[^ ]+", p), 8))
    pieces = finer(pieces, lambda p: after(p, 32))
    return set(finer(pieces, lambda p: [p[i:i + 100] for i in range(0, len(p), 100)]))


def sets(spark, pairs):
    df = spark.createDataFrame([(i, list(a), list(b)) for i, (a, b) in enumerate(pairs)], "i int, a array<long>, b array<long>")
    return df, {i: len(set(a) ^ set(b)) for i, (a, b) in enumerate(pairs)}


@pytest.fixture(scope="module")
def pairs():
    rnd = random.Random(9)
    out = [([], []), ([1], []), ([], [1]), ([1], [1]), ([5, 6], [6, 7])]
    for n in (3, 8, 20, 60, 300):
        for keep in (0.0, 0.5, 0.9, 1.0):
            a = [rnd.getrandbits(63) for _ in range(n)]
            out.append((a, [v for v in a if rnd.random() < keep] + [rnd.getrandbits(63) for _ in range(int(n * (1 - keep)))]))
    return out


def test_peeling_recovers_the_difference(spark, pairs):
    df, want = sets(spark, [p for p in pairs if len(p[0]) <= 20])
    size = F.lit(64)
    rows = df.select("i", "a", "b", iblt.peel(iblt.subtract(iblt.sketch(F.col("a"), size), iblt.sketch(F.col("b"), size)), size).alias("p")).collect()
    for r in rows:
        assert {(f.v, f.n) for f in r.p.found} == {(v, 1) for v in set(r.a) - set(r.b)} | {(v, -1) for v in set(r.b) - set(r.a)}
        assert all(c.n == 0 and c.v == 0 and c.h == 0 for row in r.p.cells for c in row)


def test_a_whole_row_gives_the_last_digest_away(spark, monkeypatch):
    monkeypatch.setattr(iblt, "ROUNDS", 1)
    size = F.lit(2)
    df = spark.range(1, 200).select(F.array(F.xxhash64("id"), F.xxhash64("id", F.lit(1)), F.xxhash64("id", F.lit(2))).alias("a"))
    cells = iblt.sketch(F.col("a"), size)
    once = df.select("a", iblt.peel(cells, size).alias("p"), F.filter(F.flatten(cells), lambda c: c["n"] == 1)["v"].alias("alone")).collect()
    one_left = [r for r in once if len(set(r.alone)) == 2]
    assert one_left and all({(f.v, f.n) for f in r.p.found} == {(v, 1) for v in r.a} for r in one_left)
    assert all(len(r.p.found) == len({f.v for f in r.p.found}) and {f.v for f in r.p.found} <= set(r.a) for r in once)
    assert all((len(r.p.found) == 3) == all((c.n, c.v, c.h) == (0, 0, 0) for row in r.p.cells for c in row) for r in once)


def test_bound_values_are_neither_copied_nor_typed_anew(spark):
    value = iblt._let(F.col("id") + 1, lambda x: iblt._let(F.array(x, x * 2), lambda y: F.struct(x.alias("x"), y.alias("y"))))
    df = spark.range(3).select(value.alias("r"))
    assert [(r.r.x, r.r.y) for r in df.collect()] == [(1, [1, 2]), (2, [2, 4]), (3, [3, 6])]
    plan = df._jdf.queryExecution().analyzed().toString()
    assert "transform(" not in plan and "[0]" not in plan


@pytest.mark.parametrize("setting", [{}, {"GROUP": 64, "CELLS": 1, "TRIES": 7}, {"CELLS": 1, "TRIES": 1}])
def test_differing_is_exact_whatever_the_first_size(spark, pairs, setting, monkeypatch):
    for k, v in setting.items():
        monkeypatch.setattr(iblt, k, v)
    df, want = sets(spark, pairs if not setting else pairs[:15])
    assert {r.i: r.d for r in df.select("i", iblt.differing(F.col("a"), F.col("b")).alias("d")).collect()} == want


def test_digests_are_dealt_into_few_more_groups_than_asked(spark):
    rows = spark.range(2, 1500).select("id", iblt._sides(F.col("id")).alias("s")).collect()
    made = {r.id: r.s[0] * r.s[1] * r.s[2] for r in rows}
    assert all(len(r.s) == 3 and min(r.s) >= 1 for r in rows)
    assert all(n <= m <= 1.5 * n + 1 for n, m in made.items()), made


@pytest.mark.parametrize("rows", [1000, 3])
def test_successors_digest_each_text_once(spark, rows):
    docs = spark.createDataFrame([(i, None if i == 5 else f"a{i}\nb\na{i}") for i in range(20)], "doc_id long, text string")
    got = iblt.successors(docs, rows=rows, digested=True)
    checked = got.select("doc_id", (F.col("own") == iblt.digests(F.col("text"))) & (F.col("next") == iblt.digests(F.col("next_text"))))
    assert sorted(tuple(r) for r in checked.collect()) == [(i, True) for i in range(20)]


@pytest.mark.parametrize("rows", [1000, 3, 1])
def test_successors(spark, rows):
    rnd = random.Random(rows)
    ids = rnd.sample(range(-50, 10_000), 60) + [7_000_000_000]
    data = [(i, f"text {i}", "x") for i in ids] + [(None, "no id", "y")]
    got = {r.doc_id: (r.text, r.next_text) for r in iblt.successors(spark.createDataFrame(data, "doc_id long, text string, next_text string"), rows=rows).collect()}
    order = [None, *sorted(ids)]
    texts = {i: t for i, t, _ in data}
    assert got == {i: (texts[i], texts[order[(k + 1) % len(order)]]) for k, i in enumerate(order)}


def test_repeated_ids_and_small_tables(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, None)], "doc_id long, text string")
    rows = iblt.successors(df).collect()
    assert sorted((r.doc_id, r.text) for r in rows) == [(1, "a"), (1, "a"), (1, "b"), (2, "")]
    assert sorted(r.next_text for r in rows) == ["", "a", "a", "b"]
    assert [tuple(r) for r in iblt.successors(df.where("doc_id = 2")).collect()] == [(2, "", "")]
    assert iblt.successors(df.limit(0)).collect() == []


def test_fingerprints(spark):
    texts = [None, "", "a\nb", "b\na", "a\nb", "a\nc", "One. Two! " * 40, "é" * 1000, "p\n" * 3000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "i int, text string, FINGERPRINT int")
    got = {r.i: r.fingerprint for r in iblt.sketched(df).collect()}
    assert got[0] == got[1] and got[2] == got[4] != got[5]
    assert all(f.startswith(f"{len(parts(t)):x}:") for t, f in zip(texts, (got[i] for i in range(len(texts)))))


def test_query(spark):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: r for r in queries.op6_iblt_fingerprints(spark, SF).collect()}
    assert len(got) == len(rows)
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        q = len(text) // 4
        edited = text[:len(text) - q] + following[:q]
        near = lambda x, y: 1 - len(parts(x) ^ parts(y)) / (len(parts(x)) + len(parts(y)))
        g = got[i]
        assert (g.n_chars, g.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert g.near_edited == pytest.approx(near(text, edited)) and g.near_next == pytest.approx(near(text, following))
        assert (g.fingerprint == g.edited_fingerprint) == (parts(text) == parts(edited))


def test_long_lines_without_sentences_keep_their_digests(spark):
    rnd = random.Random(5)
    prose = [f"w{rnd.randrange(3000)}" for _ in range(2000)]
    signs = "".join(chr(0x4E00 + rnd.randrange(3000)) for _ in range(4000))
    texts = [" ".join(prose), " | ".join(prose), ",".join(prose), signs, " ".join(["again"] * 3000) + " " + " ".join(prose[:200])]
    rows = [(i, t, t[:len(t) - len(t) // 4] + "\nnew end") for i, t in enumerate(texts)] + [(9, texts[0], " ".join(f"v{w}" for w in prose))]
    rows.append((10, texts[0], "first " + " ".join(prose[:700] + ["other"] + prose[700:])))  # places follow the content, not the start
    rows.append((11, texts[3], "丁" + signs))
    df = spark.createDataFrame(rows, "i int, a string, b string")
    df = df.select("i", iblt.digests(F.col("a")).alias("a"), iblt.digests(F.col("b")).alias("b"))
    got = {r.i: r.near for r in df.select("i", iblt.likeness(F.col("a"), F.col("b")).alias("near")).collect()}
    assert got.pop(9) == 0.0
    assert got[4] > 0.1 and all(near > 0.7 for i, near in got.items() if i != 4), got


def test_query_over_the_pieces_of_long_lines(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    edits = [(i, t, t[:len(t) - len(t) // 4] + rows[(k + 1) % len(rows)][1][:len(t) // 4]) for k, (i, t) in enumerate(rows)]
    df = spark.createDataFrame(edits, "doc_id long, a string, b string")
    pieces = {r.doc_id: (r.a, r.b) for r in df.select("doc_id", iblt.paragraphs(F.col("a")).alias("a"), iblt.paragraphs(F.col("b")).alias("b")).collect()}
    got = {r.doc_id: r.near_edited for r in queries.op6_iblt_fingerprints(spark, SF).collect()}
    for i, t, _ in edits:
        a, b = pieces[i]
        assert "".join(a).replace(" ", "") == t.replace("\n", "").replace(" ", "") and all(len(p) <= iblt.LONG for p in a)
        assert got[i] == pytest.approx(1 - len(set(a) ^ set(b)) / (len(set(a)) + len(set(b))))
        assert len(t) <= iblt.LONG * 10 or got[i] > 0, i  # three quarters are unchanged
