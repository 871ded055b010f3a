import random
import unicodedata

import numpy as np
import pytest

from salescope.llm import decontam


def brute_tiles(doc, item, least):
    """The textbook form: the longest common unmarked runs first."""
    md, mi, out = [w == 0 for w in doc], [False] * len(item), []
    while True:
        best, found = least, []
        for j in range(len(item)):
            for i in range(len(doc)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and not md[i + n] and not mi[j + n]:
                    n += 1
                if n > best:
                    best, found = n, []
                if n == best:
                    found.append((j, i))
        if not found:
            return out
        for j, i in found:
            if not any(md[i:i + best]) and not any(mi[j:j + best]):
                md[i:i + best] = mi[j:j + best] = [True] * best
                out.append((i, j, best))


def test_tiles_cover_as_the_textbook_algorithm():
    rnd = random.Random(3)
    for _ in range(150):
        item = [rnd.randrange(1, 9) for _ in range(rnd.randrange(3, 30))]
        doc = [rnd.randrange(0, 12) for _ in range(rnd.randrange(0, 20))]
        for _ in range(rnd.randrange(3)):
            a = rnd.randrange(len(item))
            doc += item[a:a + rnd.randrange(4, 20)] + [0]
        got = decontam.tiles(np.array(doc, np.int64), np.array(item, np.int64), 5)
        want = brute_tiles(doc, item, 5)
        assert sum(t[2] for t in got) == sum(t[2] for t in want), (doc, item)
        used_d, used_i = set(), set()
        for i, j, n in got:
            assert n >= 5 and doc[i:i + n] == item[j:j + n]
            assert not used_d & set(range(i, i + n)) and not used_i & set(range(j, j + n))
            used_d |= set(range(i, i + n))
            used_i |= set(range(j, j + n))


PASSAGE = "The quick brown fox jumps over the lazy dog while seven grey cats watch from a tall garden wall today"


@pytest.mark.parametrize("block_bytes", [16 << 20, 64])
def test_matches(spark, block_bytes):
    p = PASSAGE.split()
    docs = spark.createDataFrame([
        (0, None, "a"), (1, "", "a"), (2, PASSAGE, "a"), (3, "lead in " + PASSAGE.upper().replace(" ", ", ") + "! tail", "b"),
        (4, " ".join(p[10:] + ["and"] + p[:10]), "c"), (5, " ".join(p[:10]), "d"), (6, " ".join(p[::-1]), None), (None, "x " * 5000 + PASSAGE, "e"),
        (2, PASSAGE, "a")], "doc_id long, text string, matches string")
    bench = spark.createDataFrame([(7, PASSAGE, 1), (8, None, 1), (9, "too short", 1), (10, PASSAGE + ".", 1), (11, "", 1), (12, "other words that nobody has ever said before now", 1)],
                                  "item_id long, text string, more int")
    got = decontam.matches(docs, bench, block_bytes=block_bytes).collect()
    hits = sorted((str(r.doc_id), m.item_id, round(m.coverage, 3)) for r in got for m in r.matches)
    assert hits == sorted((d, i, 1.0) for d in ("2", "2", "3", "4", "None") for i in (7, 10))
    four = next(r for r in got if r.doc_id == 4).matches[0].tiles
    assert sorted((t.doc_word, t.item_word, t.words) for t in four) == [(0, 10, 10), (11, 0, 10)]
    kept = decontam.clean(docs, bench, block_bytes=block_bytes)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 5, 6]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, PASSAGE)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.matches(docs, none).first().matches == []
    assert decontam.matches(docs.limit(0), docs.toDF("item_id", "text")).collect() == []


def plain_words(text):
    """Words sign by sign."""
    out, before = [], ""
    for c in text.lower():
        kind = unicodedata.category(c)[0]
        alone = kind in "LN" and any(n in unicodedata.name(c, "") for n in ("CJK", "HIRAGANA", "KATAKANA", "THAI"))
        if before and kind == "M" or before == "run" and kind in "LN" and not alone:
            out[-1] += c
        elif kind in "LNM":
            out.append(c)
            before = "alone" if alone else "run"
        else:
            before = ""
    return out


def test_words_of_all_scripts():
    for text in ("ÉTÉ\u00a0à “Köln”—don’t, a1b2_c", "東京は日本の首都です。Tokyo 2020年", "ภาษาไทย ง่าย", "e\u0301te\u0301 hôtel", "Привет, МИР", "हिन्दी भाषा", "", " - "):
        assert [w.decode() for w in decontam.words(text.encode())] == plain_words(text), text
    assert decontam.words("Über Nacht".encode()) == ["über".encode(), b"nacht"]


@pytest.mark.parametrize("block_bytes", [16 << 20, 64])
def test_short_items_and_scripts_without_blanks(spark, block_bytes):
    zh = "人工智能正在改变我们的生活方式和工作方式"
    texts = [zh, "他说：" + zh[10:] + "，又说：" + zh[:10], zh[:8], "Prague, Zürich", "in PRAGUE\u00a0ZÜRICH wins; prague zürich", "prague and zürich", "Yes!", "yes, no", "は", "x は",
             "a b c d", "a b c d e", "b a c d"]
    items = [(0, zh), (1, "Prague Zürich"), (2, "yes"), (3, "は"), (4, "A, b, c: d"), (4, "A, b, c: d"), (5, "zürich"), (None, "…")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = []
    for d, t in enumerate(texts):
        w = plain_words(t)
        for k, it in items:
            v = plain_words(it)
            if 1 < len(v) < 5 and any(w[i:i + len(v)] == v for i in range(len(w))) or len(v) == 1 and w == v:
                want.append((d, k))
            elif len(v) >= 5:
                ids = {x: i + 1 for i, x in enumerate(dict.fromkeys(v))}
                if sum(x[2] for x in brute_tiles([ids.get(x, 0) for x in w], [ids[x] for x in v], 5)) / len(v) >= 0.8:
                    want.append((d, k))
    found = decontam.matches(docs, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes).collect()
    assert sorted((r.doc_id, m.item_id) for r in found for m in r.matches) == sorted(want)
    assert {(0, 0), (1, 0), (4, 1), (6, 2), (8, 3), (11, 4)} <= set(want) and want.count((10, 4)) == 2
    assert [tuple(t) for r in found if r.doc_id == 4 for m in r.matches for t in m.tiles] == [(1, 0, 2)]


def test_query_finds_what_brute_force_finds(spark):
    from salescope.llm import queries

    sf = "/root/testdata/sf0.001"
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    want = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        w = decontam.words(r.text.encode())
        for it in items:
            v = decontam.words(it.text.encode())
            ids = {x: i + 1 for i, x in enumerate(dict.fromkeys(v))}
            seeds = {tuple(v[k:k + 5]) for k in range(len(v) - 4)}
            if any(tuple(w[k:k + 5]) in seeds for k in range(len(w) - 4)):
                t = brute_tiles([ids.get(x, 0) for x in w], [ids[x] for x in v], 5)
                if sum(x[2] for x in t) / len(v) >= 0.8:
                    want.add((r.doc_id, it.item_id))
    got = {(r.doc_id, r.item_id) for r in queries.op1_decontamination(spark, sf).collect()}
    assert got == want and want
