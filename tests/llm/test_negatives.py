"""Hard negatives against all pairs, and the table scores against products."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from salescope.llm import negatives, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, anchor, positives=5, negatives_=10, low=30, high=90, scale=256):
    usable = {(i, lab, tuple(math.floor(scale * x) for x in v)) for i, v, lab in rows
              if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = set()
    firsts = {}
    for r in sorted(usable, key=lambda r: (r[0], r[1])):
        firsts.setdefault(r[0], r)
    for a in (r for r in firsts.values() if anchor(r[0])):
        scored = sorted({(-dot(a[2], r[2]), r[0], r[1] == a[1]) for r in usable if r[0] != a[0]})
        for ps, pid, _ in [s for s in scored if s[2]][:positives]:
            fit = [s for s in scored if not s[2] and low * -ps <= 100 * -s[0] <= high * -ps][:negatives_]
            out |= {(a[0], pid, k + 1, nid, -ps, -ns) for k, (ns, nid, _) in enumerate(fit)}
    return out


def test_scores_from_tables():
    r = np.random.default_rng(3)
    for bits, groups in ((2, 1), (9, 8), (13, 3)):
        ints = r.integers(-(1 << bits - 1), 1 << bits - 1, (40, groups * 8))
        planes = np.stack([np.packbits((ints >> b & 1).astype(np.uint8).reshape(40, groups, 8), axis=2, bitorder="little")[:, :, 0] for b in range(bits)], 1)
        assert (negatives.integers(planes) == ints).all()
        table = negatives.subset_sums(ints[:7], np.int64)
        assert (negatives.scores(table, planes) == ints @ ints[:7].T).all()


def test_all_pairs(spark, monkeypatch):
    r = random.Random(4)
    rows = [(i, [r.choice([-0.5, 0.1, 0.25, 0.7, 1.5]) for _ in range(11)], r.choice([0, 0, 0, 1, 2])) for i in range(400)]
    rows += rows[:30]  # repeated rows
    rows += [(None, [0.1] * 11, 1), (401, None, 1), (402, [0.1] * 11, None), (403, [0.1, None] + [0.2] * 9, 1), (404, [float("nan")] * 11, 1),
             (405, [float("inf")] * 11, 1), (406, [0.5, 0.5, 0.5], 1), (410, [], 2), (420, [0.0] * 11, 0)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit("clash")).repartition(5)
    monkeypatch.setattr(negatives, "ANCHORS", 7)  # several groups and stripes
    monkeypatch.setattr(negatives, "CHUNK", 16)
    got = negatives.mine(frame, F.col("id") % 10 == 0).collect()
    assert len(got) == len(set(map(tuple, got))) and {tuple(g) for g in got} == brute(rows, lambda i: i % 10 == 0)
    assert len({g.anchor_id for g in got}) > 20


def test_odd_tables(spark):
    assert negatives.mine(spark.createDataFrame([], SCHEMA), F.col("id") % 2 == 0).count() == 0
    same = spark.createDataFrame([(i, [0.5, 0.5], 1) for i in range(9)], SCHEMA)
    assert negatives.mine(same, F.col("id") % 2 == 0).count() == 0  # no other label
    none = spark.createDataFrame([(0, [0.5], 1), (1, [0.25], 2)], SCHEMA)
    assert negatives.mine(none, F.col("id") == 0).count() == 0  # no positive
    with pytest.raises(ValueError):
        negatives.mine(spark.createDataFrame([(0, [3e38], 1), (1, [3e38], 1)], SCHEMA), F.col("id") == 0)


def test_query(spark):
    rows = [(i, v, lab if i % 7 or lab is None else (lab + 1) % 10) for i, v, lab in
            (tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect())]
    got = {tuple(r) for r in queries.op11_hard_negatives(spark, SF).collect()}
    assert got and got == brute(rows, lambda i: i % 100 == 0)
