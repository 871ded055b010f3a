import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from salescope.llm import bpe, queries

SOURCE = bpe.load(queries.tokenizer("word_bpe_49k.json"))
ODD = [None, "", " \t\n", "a", "It's we'll 'LL don't", "<|endoftext|>a<|startoftext|> b<|endoftext|>", "</w> <|endoftext|", "a" * 200, "!" * 50, "0123456789 ½",
       "中文字𝒳 ΟΔΥΣΣΕΥΣ İ\x1c\x85x ﬁ½", "é é  x y", "nul\x00byte", "ÀÉÎÕÜ straße ẞ", "word " * 4000, "x" * 3000]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_str(SOURCE)
    t.no_padding()
    t.no_truncation()
    return t


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_codec_equals_the_library(library):
    codec = bpe.Codec(SOURCE)
    rnd = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyz'!.,#*  \n\tÀéßΣς0123</w>|"
    texts = [t or "" for t in ODD] + ["".join(rnd.choice(letters) for _ in range(rnd.randrange(120))) for _ in range(300)]
    decoder = bpe.Decoder(SOURCE)
    for text, got in zip(texts, codec.encode_batch(texts)):
        ids = np.frombuffer(got, np.int32).tolist()
        assert ids == ids_of(library, text), text
        assert decoder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_kept_words_may_be_dropped(library, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 3)
    codec = bpe.Codec(SOURCE)
    for text in ("one two three four five", "two three six", "one one"):
        assert np.frombuffer(codec.encode_batch([text])[0], np.int32).tolist() == ids_of(library, text)


def test_columns_and_odd_rows(spark, library):
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(ODD)] + [(1, "", 0)], "doc_id long, text string, ids int")
    coded = bpe.decode(bpe.encode(df, SOURCE), SOURCE)
    assert coded.columns == ["doc_id", "text", "ids", "decoded"]
    rows = coded.collect()
    assert len(rows) == len(ODD) + 1
    for r in rows:
        assert r.ids == ids_of(library, r.text) and r.decoded == library.decode(r.ids, skip_special_tokens=False)
    both = bpe.encode_and_decode(df, SOURCE)
    assert both.columns == coded.columns and sorted(both.collect(), key=str) == sorted(rows, key=str)
    assert bpe.encode_and_decode(df.limit(0), SOURCE).collect() == []
    nulls = bpe.decode(spark.createDataFrame([(None,)], "ids array<int>"), SOURCE)
    assert nulls.first().decoded == ""
    assert bpe.encode(df.limit(0), SOURCE).collect() == []


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.op10_bpe(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = ids_of(library, r.text)
        g = got[r.doc_id]
        assert g.n_tokens == len(ids)
        assert g.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert g.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
