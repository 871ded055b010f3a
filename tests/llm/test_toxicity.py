import random

import pytest

from salescope.llm import queries, toxicity
from salescope.llm.toxicity import Matcher, Model, fold


def test_folding():
    assert fold("ΙDIOT 1d10t! іdiоt IDIOT") == " idiot idiot idiot idiot "
    assert fold("tr@sh$$$ $cum. 2024 café") == " trash scum café "
    assert fold("") == "  " and fold("***\n") == "  "


def test_heaviest_entry_of_a_word_counts_and_exceptions_do_not():
    m = Matcher(Model({"tras": 2.0, "trash ": 5.0, "scum ": 3.0}, ("Trash can",)))
    assert m.density("trash here") == (100 * 5.0 / 2, 1)
    assert m.density("trashy extra") == (100 * 2.0 / 2, 1)
    assert m.density("untrash") == (0.0, 0)  # entries are word beginnings
    assert m.density("the TRA$H can, scum") == (100 * 3.0 / 4, 1)
    assert Matcher(Model()).density("anything") == (0.0, 0)


def brute(text, model):
    words = fold(text).split()
    covered = set()
    for phrase in model.exceptions:
        p = fold(phrase).split()
        covered |= {k for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p for k in range(i, i + len(p))}
    total = sum(max([w for s, w in model.weights.items() if (word + " ").startswith(s)], default=0.0) for i, word in enumerate(words) if i not in covered)
    return 100.0 * total / max(1, len(words))


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(8)
    clean = ["".join(rnd.choice("bdfgklmnprstvz") + rnd.choice("aeiou") for _ in range(rnd.randrange(2, 5))) for _ in range(400)]
    rows, labels = [], []
    for i in range(400):
        words = [rnd.choice(clean) for _ in range(rnd.randrange(20, 80))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(2):
                words.insert(rnd.randrange(len(words)), rnd.choice(["wretchling", "wretches", "qu0xxer", "qυoxxing"]))
        elif i % 7 == 0:
            words += ["wretched", "excess"]
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    return docs, spark.createDataFrame(labels + [(0, 1), (None, 1), (3, None), (9999, 1)], "doc_id long, toxic int")


def test_fit_learns_entries_and_exceptions(spark, corpus):
    docs, labels = corpus
    model = toxicity.fit(docs, labels)
    assert any("quoxxer".startswith(s) for s in model.weights) and any("wretchling".startswith(s) for s in model.weights)
    scored = toxicity.score(docs, model)
    assert scored.columns == ["doc_id", "text", "score", "n_matched", "predicted"]
    rows = {r.doc_id: r for r in scored.collect()}
    find = Matcher(model)
    for r in rows.values():
        assert find.density(r.text)[0] == pytest.approx(brute(r.text, model))
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    wrong = sum(r.predicted != (i % 5 == 0) for i, r in rows.items())
    assert wrong <= 8
    kept = toxicity.clean(docs, model)
    assert kept.columns == docs.columns and kept.first().score == "x"
    assert kept.count() == sum(1 - r.predicted for r in rows.values())


def test_odd_rows_and_tables(spark, corpus):
    docs, labels = corpus
    model = Model({"scum ": 5.0}, (), 2.0, -3.0)
    odd = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "scum"), (3, "fine " * 20000), (4, "***")], "doc_id long, text string")
    got = [(r.doc_id, r.predicted, round(r.score, 6)) for r in toxicity.score(odd, model).collect()]
    low = round(1 / (1 + 2.718281828459045 ** 3), 6)
    assert sorted(got, key=str) == sorted([(1, 0, low), (2, 0, low), (2, 0, low), (None, 1, got[3][2]), (3, 0, low), (4, 0, low)], key=str) and got[3][2] > 0.3
    assert toxicity.score(odd.limit(0), model).collect() == []
    for few in (labels.limit(0), labels.where("toxic = 0"), labels.where("doc_id = 9999")):
        assert [r.score for r in toxicity.score(odd.where("doc_id = 3"), toxicity.fit(docs, few)).collect()] == [0.0]


def test_query_separates_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.op7_toxicity(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    out = [(r.score, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    toxic, clean = [s for s, t in out if t], [s for s, t in out if not t]
    auc = sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean) / (len(toxic) * len(clean))
    assert auc > 0.75 and sum(s >= 0.3 for s in clean) <= 0.05 * len(clean)
