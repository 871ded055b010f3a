"""SimHash near-duplicates through an inverted index of positional bytes.

``fingerprints`` gives each whole text a 64-bit SimHash of its word shingles. ``linked`` finds all
pairs of distinct fingerprints that differ in at most ``max_bits`` (3) bits. Such a pair agrees in at
least 8 - 3 = 5 of the 8 byte positions. Five positions always have three in one half of the
fingerprint, so the index lists each fingerprint under the eight triples of positional bytes within
a half (24 bits each: a list stays short where a single byte's would hold a 256th of all rows). The
join tallies the positional bytes a listed pair shares, keeps pairs reaching the guaranteed five and
verifies the bit distance; only surviving pairs leave it.

A list longer than ``hot`` fingerprints is not paired. Its members are listed anew under all five
positional bytes that the pair must share, and there each member announces itself at every word
within two flipped bits of it (of 24 bits that are still free): two members differ in at most three
bits exactly if one is within one flip and the other within two flips of some common word. All that
meet at such a word are linked to one of those within one flip, so a group of any density takes a
fixed number of rows per member and loses no link between components.

``components`` joins linked fingerprints by alternating large-star and small-star steps.

Defined results: null text is empty text; a text without words has fingerprint zero, linked like any
other; a component's id is the smallest doc_id in it, ignoring null ids (null if all are null);
repeated rows each get their row from ``classes``, and one of them stays in ``deduplicate``. Extra
columns pass through ``deduplicate`` (one named ``text_hash`` is not allowed).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salescope.llm.common import cut, with_columns

SEED = 42
SHINGLE = 3
MAX_BITS = 3
HOT = 512

_BIT = (np.arange(256)[:, None] >> np.arange(7, -1, -1)[None, :]) & 1  # bits of a byte, highest first
_AT = (np.arange(8) * 256)[None, :]


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of one text as a signed 64-bit number."""
    words = text.lower().split()  # bytes: A-Z only, and blanks \x20 and \x09-\x0D only
    if not words:
        return 0
    if len(words) < shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(p, SEED) for p in parts]), np.uint8).reshape(-1, 8)
    ones = np.bincount((hashes + _AT).ravel(), minlength=2048).reshape(8, 256) @ _BIT
    return int.from_bytes(np.packbits(2 * ones.ravel() > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(df: DataFrame, *, text: str = "text", shingle: int = SHINGLE, keep: bool = True) -> DataFrame:
    """All rows with ``fp`` (bigint, the 64 bits of the fingerprint); without ``keep``, without their text."""
    return with_columns(df, text, [("fp", "long")], lambda: lambda batch: ([fingerprint(t, shingle) for t in batch],), keep=keep)


def _byte(fp: Column, position: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * (7 - position)).bitwiseAND(F.lit(255))


def _mask(positions) -> int:
    m = sum(255 << 8 * (7 - p) for p in positions)
    return m - (1 << 64) if m >> 63 else m


def _listed(fps: DataFrame, subsets: list[tuple[int, ...]]) -> DataFrame:
    """(slot, part, fp): each fingerprint under the bytes at every subset of positions."""
    parts = F.array(*(F.struct(F.lit(i).alias("slot"), F.col("fp").bitwiseAND(F.lit(_mask(s))).alias("part")) for i, s in enumerate(subsets)))
    return fps.select("fp", F.explode(parts).alias("k")).select("k.slot", "k.part", "fp")


TRIPLES = [c for half in (range(4), range(4, 8)) for c in combinations(half, 3)]
FIVES = list(combinations(range(8), 5))


def _near(a: str, b: str, max_bits: int) -> Column:
    """The count filter and the verification of a pair."""
    shared = sum((F.when(_byte(F.col(a).bitwiseXOR(F.col(b)), p) == 0, 1).otherwise(0) for p in range(8)), F.lit(0))
    return (shared >= 8 - max_bits) & (F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= max_bits)


def linked(fps: DataFrame, *, max_bits: int = MAX_BITS, hot: int = HOT) -> DataFrame:
    """(a, b): links between the distinct fingerprints of ``fps`` (fp) that join the same components as
    all pairs within ``max_bits`` bits, every link being such a pair."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the index of byte triples is complete for at most 3 differing bits")
    index = _listed(fps.select("fp"), TRIPLES)
    sizes = index.groupBy("slot", "part").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = cut(sizes)
    short = index.join(sizes.where(F.col("n") <= hot).select("slot", "part"), ["slot", "part"], "left_semi")
    a, b = short.withColumnRenamed("fp", "a"), short.withColumnRenamed("fp", "b")
    pairs = a.join(b, (a.slot == b.slot) & (a.part == b.part) & (F.col("a") < F.col("b")) & _near("a", "b", max_bits)).select("a", "b")
    if sizes.where(F.col("n") > hot).limit(1).count():
        long = index.join(sizes.where(F.col("n") > hot).select("slot", "part"), ["slot", "part"], "left_semi").select("fp").distinct()
        pairs = pairs.union(_dense(long, max_bits))
    return pairs.distinct()


def _dense(fps: DataFrame, max_bits: int) -> DataFrame:
    """Links among fingerprints of long lists, a fixed number of rows for each."""
    inner, outer = (1, 2) if max_bits == 3 else (max_bits // 2, max_bits - max_bits // 2)
    fives = _listed(fps, FIVES)
    live = fives.groupBy("slot", "part").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("slot", "part")
    flips = {}
    for slot, five in enumerate(FIVES):
        free = [1 << 8 * (7 - p) + k for p in range(8) if p not in five for k in range(8)]
        flips[slot] = [(d, sum(c)) for d in range(outer + 1) for c in combinations(free, d)]

    def announce(frames):
        for f in frames:
            for slot, g in f.groupby("slot"):
                masks = np.array([m for _, m in flips[slot]], np.uint64).view(np.int64)
                depth = np.array([d for d, _ in flips[slot]], np.int32)
                for i in range(0, len(g), 500):
                    fp = g.fp.to_numpy()[i:i + 500]
                    yield pd.DataFrame({"slot": np.int32(slot), "word": (fp[:, None] ^ masks[None, :]).ravel(), "depth": np.tile(depth, len(fp)), "fp": np.repeat(fp, len(masks))})

    said = fives.join(live, ["slot", "part"], "left_semi").select("slot", "fp").mapInPandas(announce, "slot int, word long, depth int, fp long")
    centre = said.groupBy("slot", "word").agg(F.min(F.when(F.col("depth") <= inner, F.col("fp"))).alias("a"), F.collect_set("fp").alias("near"))  # at most 301 words are within two flips
    return (centre.where("a is not null and size(near) > 1").select("a", F.explode("near").alias("b")).where("a <> b")
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected component, for every node of ``links`` (a, b) but the
    roots themselves. Links are checkpointed after every round."""
    now = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("x"), F.col("m").alias("y"))
        small = small.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v"))
        now = cut(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        after = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = after


def classes(df: DataFrame, *, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, max_bits: int = MAX_BITS, hot: int = HOT) -> DataFrame:
    """One row for each row of ``df``: doc_id, ``text_hash`` (xxhash64 of the text), ``fp``, ``class_fp`` (names the
    class), ``component_id`` (the class's smallest doc_id) and ``first`` (this is the class's first row by doc_id,
    null ids last, then text_hash)."""
    rows = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = cut(fingerprints(rows.withColumn("text_hash", F.xxhash64("text")), shingle=shingle, keep=False))
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    each = cut(rows.groupBy("fp").agg(F.min(rank).alias("head")))
    roots = components(linked(each, max_bits=max_bits, hot=hot))
    members = each.join(roots.union(roots.select("root", "root").distinct()).toDF("fp", "class_fp"), "fp")
    heads = members.groupBy("class_fp").agg(F.min("head").alias("class_head"))
    named = each.join(members.join(heads, "class_fp").select("fp", "class_fp", "class_head"), "fp", "left").select(
        "fp", F.coalesce("class_fp", "fp").alias("class_fp"), F.coalesce("class_head", "head").alias("head"))
    named = cut(named)  # the join below then stands alone between two exchanges, where a hot fingerprint's rows can be split
    return rows.join(named, "fp").select("doc_id", "text_hash", "fp", "class_fp", F.col("head.doc_id").alias("component_id"), (rank == F.col("head")).alias("first"))


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, any others) of which one for each class stays: its first."""
    found = cut(classes(docs, **options))
    drop = found.where(~F.col("first")).select("doc_id", "text_hash").distinct().hint("shuffle_hash")
    hashed = docs.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    kept = hashed.join(drop, hashed.doc_id.eqNullSafe(drop.doc_id) & (hashed.text_hash == drop.text_hash), "left_anti")
    if found.where("first").groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["doc_id", "text_hash"])  # whole rows repeat
    return kept.drop("text_hash")


def fp_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
