
import corpus_pipeline
from salescope.llm import decontam, queries, simhash, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_name_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_dedup", "decontamination", "bpe"]


def test_each_stage_takes_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    dirty = docs.unionByName(docs.where("doc_id < 3"))  # repeated rows
    kept = dirty
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, SF).cache()
        assert kept.columns == docs.columns, name
        assert kept.exceptAll(before).count() == 0, name
    ids = {r.doc_id for r in kept.collect()}
    assert len(ids) == kept.count() and ids
    # Brute force over what each stage saw.
    model = toxicity.fit(dirty, spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic"))
    find = toxicity.Matcher(model)
    calm = {r.doc_id: r.text for r in docs.collect() if toxicity._value(find.density(r.text)[0], model.slope, model.offset) < toxicity.THRESHOLD}
    prints = {i: simhash.fingerprint(t.encode()) & (1 << 64) - 1 for i, t in calm.items()}
    root = {i: i for i in prints}
    for a in sorted(prints):
        for b in sorted(prints):
            if b < a and (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((root[a], root[b]))
                root = {k: x if v == y else v for k, v in root.items()}
    first = {i for i in prints if root[i] == i}
    bench = [decontam.words(r.text.encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    seeds = {tuple(w[k:k + 5]) for w in bench for k in range(len(w) - 4)}
    has_seed = {i for i in first if any(tuple(w[k:k + 5]) in seeds for w in [decontam.words(calm[i].encode())] for k in range(len(w) - 4))}
    assert ids >= first - has_seed and ids <= first
    assert has_seed - ids


def test_run_returns_encoded_documents(spark):
    done = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "text", "ids", "decoded", "n_tokens"} <= set(done.columns)
    rows = done.collect()
    assert rows and all(len(r.ids) == r.n_tokens for r in rows)


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.collect() == []


def test_every_operator_has_a_query():
    names = queries.queries()
    assert all(any(k.startswith(f"op{n}_") for k in names) for n in range(1, 11))
