import random

import pytest
import xxhash

from salescope.llm import simhash


def brute_fp(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    if not words:
        return 0
    parts = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(fps, bits=3):
    ids = list(range(len(fps)))

    def root(i):
        while ids[i] != i:
            i = ids[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                a, b = sorted((root(i), root(j)))
                ids[b] = a
    return [root(i) for i in range(len(fps))]


def signed(fp):
    return fp - (1 << 64) if fp >> 63 else fp


TEXTS = [None, "", "  \t\n", "one", "ONE", "a b", "A  B\nc", "a b c", "a b c d e f g", "ünï cödé wörds ÀB", "nul\x00 x y z", " a b c", "word " * 3000]


def test_fingerprint_is_the_contracts():
    for t in TEXTS:
        assert simhash.fingerprint((t or "").encode()) == signed(brute_fp(t))


@pytest.mark.parametrize("hot", [512, 2])
def test_links_give_the_components_of_all_near_pairs(spark, hot):
    rnd = random.Random(5)
    fps = [rnd.getrandbits(64) for _ in range(60)]
    for _ in range(3):  # dense groups around some words
        base = rnd.getrandbits(64)
        for _ in range(40):
            w = base
            for _ in range(rnd.randrange(6)):
                w ^= 1 << rnd.randrange(64)
            fps.append(w)
    fps = sorted({signed(f) for f in fps})
    want = brute_classes([f & (1 << 64) - 1 for f in fps])
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    links = simhash.linked(df, hot=hot)
    assert all(bin((r.a ^ r.b) & (1 << 64) - 1).count("1") <= 3 for r in links.collect())
    got = {r.node: r.root for r in simhash.components(links).collect()}
    got |= {r: r for r in got.values()}
    assert [got.get(f, f) for f in fps] == [fps[r] for r in want]


def test_classes_and_deduplicate(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, "one", "x"), (None, "one", "y"), (None, "lonely words here today", "z"), (40, "a b c d e f g", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, first string")
    fps = [brute_fp(t) for _, t, _ in rows]
    want = brute_classes(fps)
    least = {c: min((rows[i][0] for i in range(len(rows)) if want[i] == c and rows[i][0] is not None), default=None) for c in want}
    got = simhash.classes(docs).collect()
    assert sorted((str(r.doc_id), r.fp, str(r.component_id)) for r in got) == sorted((str(r[0]), signed(f), str(least[c])) for r, f, c in zip(rows, fps, want))
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(v) for v in least.values())


def test_texts_need_not_come_back_from_the_workers(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, source string")
    got = simhash.fingerprints(docs, keep=False)
    assert got.columns == ["doc_id", "source", "fp"]
    assert sorted(map(tuple, got.collect())) == [(i, "x", signed(brute_fp(t))) for i, t in enumerate(TEXTS)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.classes(docs).collect() == []
    assert simhash.deduplicate(docs).collect() == []


def test_query_on_given_documents(spark):
    from salescope.llm import queries

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    fps = [brute_fp(r.text) for r in rows]
    roots = brute_classes(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op2_simhash_dedup(spark, "/root/testdata/sf0.001").collect()}
    assert got == {r.doc_id: (f"{f:016x}", rows[c].doc_id) for r, f, c in zip(rows, fps, roots)}
