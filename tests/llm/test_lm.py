import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from salescope.llm import lm, queries

SF = "/root/testdata/sf0.001"


def words(text):
    return [*(text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split(), b""]


class Brute:
    """The same tree with dictionaries of whole sequences."""

    def __init__(self, train, depth, min_share, divergence, evidence):
        self.c = Counter(w for t in train for w in words(t))
        self.n, self.v = sum(self.c.values()), len(self.c)
        least = max(2.0, min_share * self.n)
        grams = Counter()
        for t in train:
            s = [b"", *words(t)]
            for k in range(2, depth + 2):
                grams.update(tuple(s[i:i + k]) for i in range(len(s) - k + 1))
        grams = {g: n for g, n in grams.items() if n >= least}
        self.follow = {}
        for g, n in grams.items():
            self.follow.setdefault(g[:-1], {})[g[-1]] = n
        self.kept = {}
        size = lambda s: self.c[s[0]] if len(s) == 1 else grams[s]
        for s in sorted(self.follow, key=len):
            f = self.follow[s]
            rest = size(s) - sum(f.values()) + len(f) + 1.0
            total = sum(f.values()) + rest
            gain = sum(n * math.log((n + rest * self.p(s[1:], w)) / total / self.p(s[1:], w)) for w, n in f.items()) + (size(s) - sum(f.values())) * math.log(rest / total)
            if gain >= evidence and gain >= divergence * size(s):
                self.kept[s] = (rest, total)

    def p(self, s, w):
        while s and s not in self.kept:
            s = s[1:]
        if not s:
            return (self.c[w] + 0.5) / (self.n + 0.5 * (self.v + 1))
        rest, total = self.kept[s]
        return (self.follow[s].get(w, 0) + rest * self.p(s[1:], w)) / total

    def score(self, text, depth):
        s = [b"", *words(text)]
        return sum(math.log10(self.p(tuple(s[max(0, i - depth):i]), s[i])) for i in range(1, len(s)))

    def base(self, text):
        return sum(math.log10(self.p((), w)) for w in words(text))


@pytest.mark.parametrize("depth,min_share,divergence,evidence", [(3, 1e-9, 0.0, 0.5), (2, 1e-3, 0.01, 2.0), (3, 0.02, 0.01, 1.0)])
def test_scores_equal_brute_force(spark, depth, min_share, divergence, evidence):
    rnd = random.Random(depth)
    make = lambda n: " ".join(rnd.choice("a a a b b c d e ab Ab cd x1 x2 x3".split()) for _ in range(n))
    phrase = "the rose is a rose is a rose"
    train = [make(rnd.randrange(30)) + " " + phrase * rnd.randrange(2) for _ in range(60)] + ["", " ", None]
    held = [make(10), phrase, "new " + phrase + " words\tunseen unseen", "", None, "a " * 3000]
    rows = [(i, t, True) for i, t in enumerate(train)] + [(100 + i, t, False) for i, t in enumerate(held)] + [(3, train[3], True), (None, "a b", False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    brute = Brute([t for _, t, k in rows if k], depth, min_share, divergence, evidence)
    scored, model = lm.fit_and_score(docs, docs.train, depth=depth, min_share=min_share, divergence=divergence, evidence=evidence)
    got = scored.collect()
    assert (model.tokens, model.distinct) == (brute.n, brute.v)
    assert len(got) == len(rows) and brute.kept
    texts = {i: t for i, t, _ in rows}
    for r in got:
        t = texts[r.doc_id]
        assert r.n_tokens == len(words(t)) and r.n_known == sum(brute.c[w] > 0 for w in words(t))
        assert math.isclose(r.base_score, brute.base(t), rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(r.score, brute.score(t, depth), rel_tol=1e-9, abs_tol=1e-9)


def test_distributions_sum_to_one():
    rnd = random.Random(1)
    brute = Brute([" ".join(rnd.choice("abcd") for _ in range(30)) for _ in range(40)], 3, 1e-9, 0.0, 0.5)
    for s in [(), *brute.kept]:
        total = sum(brute.p(s, w) for w in brute.c) + brute.p(s, b"never seen")
        assert math.isclose(total, 1.0)


def test_no_training_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    scored, _ = lm.fit_and_score(docs, docs.doc_id < 0)
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in scored.collect()) == [(1, 3, 0, 0.0, 0.0), (2, 1, 0, 0.0, 0.0)]
    scored, _ = lm.fit_and_score(docs.limit(0), docs.doc_id > 0)
    assert scored.collect() == []


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 5 == 1 for r in rows}
    brute = Brute([r.text for r in rows if not held[r.doc_id]], lm.DEPTH, lm.MIN_SHARE, lm.DIVERGENCE, lm.EVIDENCE)
    got = {r.doc_id: r for r in queries.op5_lm_scores(spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        g = got[r.doc_id]
        assert (g.held_out, g.n_tokens, g.train_tokens) == (held[r.doc_id], len(words(r.text)), brute.n)
        assert math.isclose(g.base_score, brute.base(r.text), rel_tol=1e-9) and math.isclose(g.score, brute.score(r.text, lm.DEPTH), rel_tol=1e-9)
    out = [g for g in got.values() if g.held_out]
    assert sum(g.score for g in out) > sum(g.base_score for g in out)


def test_rare_contexts_are_kept_whatever_the_size_of_the_corpus(spark):
    rnd = random.Random(7)
    noise = [" ".join(f"w{rnd.randrange(200)}" for _ in range(20_000)) for _ in range(75)]  # 1.5 million symbols
    rare = ["qa qb qc qd qe"] * 2  # below 2e-6 of them, with the evidence the test asks for
    docs = spark.createDataFrame([*enumerate(noise + rare), (900, "qa qb qc qd qe")], "doc_id long, text string")
    scored, model = lm.fit_and_score(docs, docs.doc_id < 900, evidence=5.0)
    assert 2 < 2e-6 * model.tokens
    got = {r.doc_id: r for r in scored.where("doc_id >= 75").collect()}
    brute = Brute(noise + rare, lm.DEPTH, 0.0, lm.DIVERGENCE, 5.0)
    assert math.isclose(got[900].score, brute.score("qa qb qc qd qe", lm.DEPTH), rel_tol=1e-9)
    assert got[900].score > got[900].base_score + 5


def test_other_columns_take_no_part(spark):
    rows = [(i, t) for i, t in enumerate(["a b a b c", "A  b a b c", "", None, "a b " * 50_000, "a b a b c"])]
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    clashing = spark.createDataFrame([(i, t, "x", -1, None, 0.5, "y") for i, t in rows], "doc_id long, text string, key string, n int, text_hash long, score double, n_tokens string")
    train = lambda docs: docs.doc_id != 1
    got = [sorted(tuple(r) for r in lm.fit_and_score(d, train(d), evidence=1.0)[0].drop("text_hash").collect()) for d in (plain, clashing)]
    assert len(got[0]) == len(rows) and [r[:3] for r in got[0]] == [r[:3] for r in got[1]]
    assert all(math.isclose(x, y, rel_tol=1e-9) for a, b in zip(*got) for x, y in zip(a[3:], b[3:]))
    assert got[0][0][1:] == got[0][5][1:] and got[0][4][1] == 100_001  # equal texts, and a long one


def test_hashes_follow_the_words():
    texts = [b"", b" ", b"A a\tb\n", b"  x \x0by", "ä   é".encode(), b"ab ba aab", b"z" * 600_000 + b" Z"]
    hashes, sizes = lm._hashes(texts)
    said = [w for t in texts for w in [*t.lower().split(), b""]]
    assert sizes.tolist() == [len(t.split()) + 1 for t in texts] and len(hashes) == 1 + len(said)
    assert hashes[0] == lm._END and len(set(zip(said, hashes[1:].tolist()))) == len(set(said)) == len(set(hashes.tolist()))


def test_rare_sequences_are_asked_for_in_packets(spark, monkeypatch):
    monkeypatch.setattr(lm, "SENT", 1.0)  # no value but of sequences that are everything goes to the tasks
    rnd = random.Random(11)
    texts = [" ".join(f"w{int(rnd.paretovariate(0.7))}" for _ in range(400)) for _ in range(150)] + ["", None, "w1 " * 900, "never seen"]
    rows = [*enumerate(texts), (3, texts[3]), (None, texts[4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    docs.write.mode("overwrite").parquet(path := f"{lm.checkpoint_dir(spark)}/packets-{rnd.random()}")
    docs = spark.read.parquet(path)
    train = ~docs.doc_id.isin(7, 11, 153)
    brute = Brute([t for i, t in rows if i not in (None, 7, 11, 153)], lm.DEPTH, 0.0, lm.DIVERGENCE, 2.0)
    scored, model = lm.fit_and_score(docs, train, evidence=2.0)
    assert "SortMergeJoin" not in scored._jdf.queryExecution().toString()  # no row for each sequence of a text
    got = scored.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i, _ in rows)
    said = {**dict(enumerate(texts)), None: texts[4]}
    for r in got:
        t = said[r.doc_id]
        assert r.n_tokens == len(words(t)) and r.n_known == sum(brute.c[w] > 0 for w in words(t))
        assert math.isclose(r.base_score, brute.base(t), rel_tol=1e-9) and math.isclose(r.score, brute.score(t, lm.DEPTH), rel_tol=1e-9)
    assert model.values.where("root is not null").count() == model.distinct


def test_bitmaps_are_read_from_tables(spark, monkeypatch):
    """Their stretches are made by all tasks at once, not by one task after another as they are gathered."""
    plans, gather = [], lm._bitmap

    def seen(stretches, *rest):
        plans.append(stretches._jdf.queryExecution().executedPlan().toString())
        return gather(stretches, *rest)

    monkeypatch.setattr(lm, "_bitmap", seen)
    lm.fit(spark.createDataFrame([("a b c a b c d",), ("a b c",)], "text string"))
    assert len(plans) == lm.DEPTH + 2 and not [p for p in plans if "Arrow" in p or "Exchange" in p]


def test_bitmaps_grow_with_the_texts():
    sizes = [lm._power(n) for n in (0, 999_999_999, 1_999_999_999, 2_000_000_000, 3_999_999_999, 4_000_000_000, 10 ** 12)]
    assert sizes == [26, 26, 26, 27, 27, 28, 28]
    keys = lm._mix(np.arange(5000, dtype=np.uint64))
    for power in (26, 27):
        bitmap = np.zeros((1 << power) // 8, np.uint8)
        for part in np.array_split(np.sort(keys[:2500]), 3):
            start, bits = lm._bits(part, power)
            bitmap[start:start + len(bits)] |= np.frombuffer(bits, np.uint8)
        assert lm._listed(bitmap, keys[:2500]).all() and lm._listed(bitmap, keys[2500:]).sum() < 5


def test_places_of_frequent_keys():
    near_ones = (np.uint64(77) << np.uint64(44)) + np.arange(0, 40, 2, dtype=np.uint64)  # of one slot
    keys = np.sort(np.concatenate([near_ones, lm._mix(np.arange(3000, dtype=np.uint64)), np.array([0, 2 ** 64 - 1], np.uint64)]))
    asked = np.concatenate([keys, near_ones + np.uint64(1), lm._mix(np.arange(2000, 9000, dtype=np.uint64))])
    near, hit = lm._Places(keys).of(asked)
    assert hit.tolist() == np.isin(asked, keys).tolist()
    assert (keys[near[hit]] == asked[hit]).all()
