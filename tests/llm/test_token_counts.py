import random

import pytest
import sentencepiece

from salescope.llm import queries, token_counts

MODEL = token_counts.load(queries.tokenizer("piece_bpe_32k.model"))
ODD = [None, "", " ", "   a", "a  b ", "a\nb\n\n c", "<s> x</s><unk>", "<0x0A>", "ﬁ½ x", "\x00a", "a\tb\r\n", "é é ", "中文字𝒳 ▁x▁▁", "𝒳𝒳", "a" * 500, "ab" * 2000, " " * 100, "word " * 3000]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_proto=MODEL)


def test_every_prefix_equals_encoding_it(library):
    own = token_counts.counter(MODEL)
    rnd = random.Random(11)
    letters = "abcdehinorst  \n.,é▁中𝒳0"
    texts = [t for t in ODD if t and len(t) < 60] + ["".join(rnd.choice(letters) for _ in range(rnd.randrange(40))) for _ in range(150)]
    for t in texts:
        counts = own.prefixes(t)
        assert counts == [len(library.encode(t[:i])) for i in range(len(t) + 1)], t
        for budget in (0, 1, 3, 10):
            assert own.within(t, budget) == max(i for i, n in enumerate(counts) if n <= budget), (t, budget)


def test_columns_and_odd_rows(spark, library, monkeypatch):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)] + [(1, "", None)], "doc_id long, text string, N_TOKENS string")
    got = token_counts.count(df, MODEL, budget=7)
    assert got.columns == ["doc_id", "text", "n_tokens", "kept_chars"]
    for r in got.collect():
        t = r.text or ""
        assert r.n_tokens == len(library.encode(t)), t[:50]
        assert len(library.encode(t[:r.kept_chars])) <= 7 and (r.kept_chars == len(t) or r.n_tokens > 7)
    assert token_counts.count(df.limit(0), MODEL).collect() == []
    assert token_counts.prefix_counts(df.where("doc_id = 3"), MODEL).first().prefix_tokens == [len(library.encode("   a"[:i])) for i in range(5)]


def test_kept_stretches_may_be_dropped(library, monkeypatch):
    monkeypatch.setattr(token_counts, "KEPT", 2)
    own = token_counts.Counter(MODEL)
    for t in ("one two three one two four", "five two six", "one two"):
        assert own.count_batch([t, t]) == [len(library.encode(t))] * 2


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.op8_token_counts(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        n = len(library.encode(r.text))
        g = got[r.doc_id]
        assert (g.n_bytes, g.n_tokens, g.over_limit) == (len(r.text.encode()), n, n > 4096)
        assert g.kept_chars == len(r.text) or n > 4096 >= len(library.encode(r.text[:g.kept_chars]))
