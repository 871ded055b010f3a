"""Language-model scores from a probabilistic suffix tree over words.

Symbols are the lower-cased words of a text and one end per text; a text starts after an end. The
root holds the smoothed frequency of every symbol of the training texts. A context of one to
``depth`` symbols is a candidate if it and what follows it occur twice at least, whatever the size of
the corpus (``min_share`` above zero: also with at least that share of all training symbols). A
candidate is retained if its next-symbol distribution diverges from that of its longest retained
suffix: by ``divergence`` per occurrence and ``evidence`` in all (natural units). Its distribution is
smoothed with its suffix's, which gets the weight of the uncounted occurrences and of one more for
every counted follower. A symbol is scored by the longest retained context before it.

Sequences are known by 64-bit keys, a polynomial in hashes of their symbols. Counts, tests and the
tree are tables by key. A retained context changes the log probability of what follows by log(rest /
total), and by a further term if the follower is counted after it, so a text's score is the sum over
its sequences of one value each: the sequence's term as a follower and its own as a context. Tasks ask
for these values by packets of keys, one for each range of keys, and get sums by text back. Only the values of frequent sequences
(``SENT`` of all symbols) go to the tasks, which add them up themselves; and a bitmap, larger for
more text up to a bound, by which sequences without a value are passed over. A fuller bitmap passes
over fewer, and changes no result.

Defined results: null text is empty and consists of its end; without training texts every symbol
has probability one at the root; a symbol that training texts lack has the root's rest. Repeated rows
each get their row; columns other than id and text take no part and are dropped, whatever their names.
A text is held by one task as a whole, with some tens of bytes for each of its symbols.

The tables of a fit lie in a folder of their own under the checkpoint folder. Each is dropped when the
next one stands; the values stay, since scores are read from them.
"""

from __future__ import annotations

import ctypes
import gc
import time
from dataclasses import dataclass
from functools import partial
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salescope.llm.common import parts
from salescope.session import checkpoint_dir

DEPTH = 3
MIN_SHARE = 0.0
DIVERGENCE = 0.01
EVIDENCE = 20.0
SENT = 2e-6  # share of all symbols from which on a sequence's value is sent to the tasks
_BASE = 0x9E3779B97F4A7C15
_BITS = (26, 28)  # a bitmap has 2 to one of these bits, 8 to 32 MB, by the size of the texts: each broadcast is a file at the driver and at every executor
_SLOTS = 20  # first bits of a key by which its place among the frequent ones is found
_BLOCK = 2_000_000  # bytes of text taken at once
_PIECE_BYTES = 500_000  # of a long word, hashed at once
_RANGE = 12_000_000  # bytes of text for each range of keys: about two million symbols, whose keys a task holds at once
_HELD = 2_000_000  # keys that a task adds up before it sends their counts
_ROW = 50_000  # values in a packed row
_SPREAD = 500_000  # rows that a task packs by ranges at once
_VALUES = 1_000_000  # values that a task holds at once when texts ask for them
_ASKED = 500_000  # sequences for whose values a task asks at once
_WAVES = 2  # parts of the texts scored one after another: the questions of one lie on disk at a time


def _mix(x: np.ndarray) -> np.ndarray:
    """Numbers scattered over 64 bits."""
    x = x + np.uint64(_BASE)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_END = _mix(np.array([1 << 40], np.uint64))[0]
_SIGNS = _mix(np.arange(256, dtype=np.uint64))
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # the first k of eight bytes
_ROUNDS = 8  # times eight bytes of a word are taken; the rest of a longer one is a sum


def _hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of the texts, as hashes: an end, then each text's words and its end; and each text's number of
    symbols. A word's hash starts from its length and takes in eight bytes at a time; what a word has after ``_ROUNDS``
    of these is taken in as the sum of its signs' numbers, each times a number of its place."""
    held = b" ".join(texts).lower() + b" " * 8  # bytes: A-Z only, blanks \x20 and \x09-\x0D only
    joined = np.frombuffer(held, np.uint8)[:len(held) - 7]
    blank = (joined == 32) | ((joined >= 9) & (joined <= 13))
    edges = np.flatnonzero(np.diff(blank.view(np.int8), prepend=1, append=1))
    starts, ends = edges[::2], edges[1::2]
    eights = np.ndarray(len(held) - 7, np.dtype("<u8"), held, strides=(1,))  # at every byte
    left = ends - starts
    words = _mix(left.astype(np.uint64)) ^ (eights[starts] & _FIRST[np.minimum(left, 8)])
    words = _mix(words)
    longer = np.flatnonzero(left > 8)
    for taken in range(8, 8 * _ROUNDS, 8):
        if not len(longer):
            break
        words[longer] = _mix(words[longer] ^ (eights[starts[longer] + taken] & _FIRST[np.minimum(left[longer] - taken, 8)]))
        longer = longer[left[longer] > taken + 8]
    for word in longer:
        total = np.uint64(0)
        for at in range(starts[word] + 8 * _ROUNDS, ends[word], _PIECE_BYTES):
            signs = joined[at:min(at + _PIECE_BYTES, ends[word])]
            total += (_SIGNS[signs] * _mix(np.arange(at - starts[word], at - starts[word] + len(signs), dtype=np.uint64))).sum(dtype=np.uint64)
        words[word] = _mix(words[word:word + 1] ^ total)[0]
    bounds = np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(starts, bounds)  # words of the texts so far
    own = np.diff(upto, prepend=0) + 1
    out = np.full(len(words) + len(texts) + 1, _END)
    out[1 + np.arange(len(words)) + np.repeat(np.arange(len(texts)), own - 1)] = words
    return out, own


@dataclass
class Model:
    values: DataFrame  #: (key, n, root, v): log10 at the root, of single symbols; what a sequence adds to a text's score
    packed: DataFrame  #: (bucket, key, root, v): the same, by ranges of keys, as sorted arrays; NaN for no root
    buckets: int
    bitmap: np.ndarray  #: of the keys of ``values``: a key's bit is its first bits, so a range of keys has a stretch of the bitmap
    tokens: int
    distinct: int
    depth: int

    @property
    def scale(self) -> float:
        return self.tokens + 0.5 * (self.distinct + 1)


def _keys(texts: list[bytes], length: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Each text's number of symbols. For each length up to ``length``: keys of the sequences that end at each place of
    the texts, each text after an end, and whether they lie within a text; an end may be their first and their last
    symbol only."""
    ids, sizes = _hashes(texts)
    inner = ids != _END
    found = [(ids, np.ones(len(ids), bool))]
    for k in range(1, length):
        key, valid = found[-1]
        longer = np.concatenate([ids[:1], key[:-1] * np.uint64(_BASE) + ids[1:]])
        found.append((longer, np.concatenate([[False], valid[:-1] & (inner[:-1] | (k == 1))])))
    return sizes, found


class _Tables:
    """Tables written to a folder of their own under the shared checkpoint folder. What a table was made from is
    dropped once it stands: tables by ``drop``, shuffle files by Spark, which is asked to look for unused ones."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{checkpoint_dir(spark)}/suffix-tree-{uuid4().hex}"

    def put(self, name: str, df: DataFrame) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def split(self, name: str, df: DataFrame, by: str) -> DataFrame:
        """As ``put``, with a folder for each value of a column."""
        df.write.option("compression", "zstd").partitionBy(by).parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        for _ in range(2):  # frames that are no longer used hold their shuffle files, and are let go in two turns
            gc.collect()
            jvm.System.gc()
            time.sleep(0.2)


def _ranges(key: np.ndarray, buckets: int) -> np.ndarray:
    """The range of each key, of ``buckets`` even ones."""
    return ((key.view(np.uint64) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _stretches(ranges: np.ndarray):
    """(range, start, end) of sorted ranges."""
    starts = np.flatnonzero(np.diff(ranges, prepend=-1))
    return list(zip(ranges[starts].tolist(), starts.tolist(), np.append(starts[1:], len(ranges)).tolist()))


def _power(size: int) -> int:
    """The power of 2 that a bitmap has as bits for so many bytes of text: the least up to 2 GB, then more with it."""
    return min(max((size // 1_000_000_000).bit_length() + _BITS[0] - 1, _BITS[0]), _BITS[1])


def _bits(key: np.ndarray, power: int) -> tuple[int, bytes]:
    """The stretch of the bitmap from the first byte with one of the keys' bits to the last, and where it starts."""
    at = np.unique(key.view(np.uint64) >> np.uint64(64 - power)).astype(np.int64)
    start = int(at[0]) // 8 if len(at) else 0
    marked = np.zeros((int(at[-1]) // 8 + 1 - start) * 8 if len(at) else 0, bool)
    marked[at - start * 8] = True
    return start, np.packbits(marked, bitorder="little").tobytes()


def _bitmap(stretches: DataFrame, power: int) -> np.ndarray:
    """Bits at the first bits of keys, from (start, bits) of ranges of keys; little more than its own size is gathered.
    The stretches are a table, since what they are made from would be worked on by one task after another here."""
    out = np.zeros((1 << power) // 8, np.uint8)
    for r in stretches.select("start", "bits").toLocalIterator():
        out[r.start:r.start + len(r.bits)] |= np.frombuffer(r.bits, np.uint8)
    return out


def _listed(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys >> np.uint64(62 - len(bitmap).bit_length())
    return (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


class _Places:
    """Places of keys among sorted ones, found by their first bits: most slots have one key or none."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys, keys[-1:])  # a place after the last, that is no other key's
        slots = keys >> np.uint64(64 - _SLOTS)
        self.first = np.searchsorted(slots, np.arange(1 << _SLOTS, dtype=np.uint64)).astype(np.int32)
        self.more = np.append(slots[1:] == slots[:-1], [False, False])[:len(self.keys)]  # the next place is of the same slot

    def of(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each key, and whether it is there."""
        near = self.first[(asked >> np.uint64(64 - _SLOTS)).astype(np.int64)]
        hit = self.keys[near] == asked
        left = np.flatnonzero(~hit & self.more[near])
        while len(left):
            near[left] += 1
            hit[left] = self.keys[near[left]] == asked[left]
            left = left[~hit[left] & self.more[near[left]]]
        return near, hit


def _summed(key, n, *others):
    """Each key once, with the sum of its counts (``n`` None: how often it stands there) and its other numbers."""
    order = np.argsort(key) if others or n is not None else None
    key = np.sort(key) if order is None else key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[:len(key)])
    n = np.diff(np.append(first, len(key))) if n is None else np.add.reduceat(n[order], first) if len(first) else n
    return key[first], n.astype(np.int64), *(x[order[first]] for x in others)


def _count(docs: DataFrame, text: str, length: int, shorter: Broadcast | None, least: float, buckets: int, *, often: Broadcast | None = None, give: str = "all") -> DataFrame:
    """(bucket, key, n, ctx, suf), packed by ranges of suf: sequences of ``length`` symbols that occur at least ``least`` times, with the keys of the
    sequences without their last and without their first symbol. Those with parts not in ``shorter``, or not in ``often`` themselves, are passed over.
    ``give``: "counts": (key, n) alone; "bits": (start, bits), their stretches of a bitmap as ``shorter``. Tasks add up what they hold and send it packed, one row for each
    of ``buckets`` ranges of keys; a range is added up as a whole."""
    whole, power = give == "all", len(shorter.value).bit_length() + 2 if give == "bits" else 0
    columns = ["key", "n", "ctx", "suf"] if whole else ["key", "n"]

    def run(batches):
        held: list[tuple[np.ndarray, ...]] = []

        def counted():
            key, *others = (np.concatenate(x) for x in zip(*held))
            held.clear()
            made = _summed(key, None, *others)
            found = _stretches(_ranges(made[0], buckets))
            for i in range(0, len(found), 8):  # few at once: a batch is held outside the heap
                here = found[i:i + 8]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in here], pa.int64()), *(pa.array([x[a:b].tobytes() for _, a, b in here], pa.binary()) for x in made)], ["bucket", *columns])

        for _, own in parts(batches, text, _BLOCK):
            _, found = _keys(own, length)
            key, valid = found[-1]
            if length == 1:
                held.append((key[1:],))  # the first place is the end before the first text
            else:
                near = found[-2][0]
                places = np.flatnonzero(valid)
                listed = _listed(shorter.value, near)
                places = places[listed[places] & listed[places - 1]]
                if often is not None:
                    places = places[_listed(often.value, key[places])]
                held.append((key[places], near[places - 1], near[places]) if whole else (key[places],))
            if sum(len(h[0]) for h in held) >= _HELD:
                yield from counted()
        if held:
            yield from counted()
        _released()

    def bucket(table: pa.Table) -> pa.Table:
        _released()
        made = _summed(*(np.frombuffer(b"".join(table[c].to_pylist()), np.int64) for c in columns))
        enough = made[1] >= least
        if give == "bits":
            start, bits = _bits(made[0][enough], power)
            return pa.table({"start": [start], "bits": pa.array([bits], pa.binary())})
        found = {c: x[enough] for c, x in zip(columns, made)}
        return _pack(found, "suf", buckets) if whole else pa.table(found)

    given = {"all": _fields(*columns), "bits": "start long, bits binary", "counts": "key long, n long"}[give]
    return docs.select(text).mapInArrow(run, _fields(*columns)).groupBy("bucket").applyInArrow(bucket, given)


def _pack(made: dict[str, np.ndarray], by: str, buckets: int) -> pa.Table:
    """(bucket, the columns of ``made`` as arrays): numbers by ranges of the keys in ``by``."""
    ranges = _ranges(made[by], buckets)
    order = np.argsort(ranges, kind="stable")
    found = _stretches(ranges[order])
    packed = {c: x[order] for c, x in made.items()}
    return pa.table({"bucket": pa.array([k for k, _, _ in found], pa.int64()), **{c: pa.array([x[a:b].tobytes() for _, a, b in found], pa.binary()) for c, x in packed.items()}})


def _fields(*columns: str) -> str:
    return ", ".join(["bucket long", *(f"{c} binary" for c in columns)])


def _spread(rows: DataFrame, by: str, buckets: int) -> DataFrame:
    """The numbers of ``rows`` packed by ranges of the keys in the column ``by``. Null is NaN."""
    kinds = {f.name: pa.float64() if f.dataType == T.DoubleType() else pa.int64() for f in rows.schema}

    def run(batches):
        held: list[dict[str, np.ndarray]] = []

        def packed():
            made = _pack({c: np.concatenate([h[c] for h in held]) for c in kinds}, by, buckets)
            held.clear()
            return made.to_batches(max_chunksize=16)

        for batch in batches:
            held.append({c: batch.column(i).cast(kind).to_numpy(zero_copy_only=False) for i, (c, kind) in enumerate(kinds.items())})
            if sum(len(h[by]) for h in held) >= _SPREAD:
                yield from packed()
        if held:
            yield from packed()

    return rows.mapInArrow(run, _fields(*kinds))


def _released() -> None:
    """Arrow and the C library let go of what they keep of the work before: workers stay for later tasks, several to an executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def _numbers(table: pa.Table, **kinds) -> list[np.ndarray]:
    """Columns of packed numbers of a range, each put together."""
    return [np.frombuffer(b"".join(table[c].drop_null().to_pylist()), kind) for c, kind in kinds.items()]


def _flat(spread: DataFrame) -> DataFrame:
    """(key, n, root, v) of packets, one row each; NaN reads as null."""
    kinds = {"key": np.int64, "n": np.int64, "root": np.float64, "v": np.float64}

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                made = _numbers(pa.table(batch.slice(i, 1).columns, list(kinds)), **kinds)
                yield pa.RecordBatch.from_arrays([pa.array(x, from_pandas=True) for x in made], list(kinds))

    return spread.select(*kinds).mapInArrow(run, "key long, n long, root double, v double")


def _packed(spread: DataFrame, buckets: int, power: int) -> DataFrame:
    """(bucket, key, root, v, start, bits): (key, root, v), packed anyhow, by ``buckets`` ranges in rows of ``_ROW`` values of keys, as arrays sorted by key, and the keys' stretch of the bitmap."""
    kinds = {"key": np.uint64, "root": np.float64, "v": np.float64}

    def bucket(table: pa.Table) -> pa.Table:
        _released()
        made = _numbers(table, **kinds)
        order = np.argsort(made[0])
        start, bits = _bits(made[0], power)
        cuts = range(0, max(len(order), 1), _ROW)
        rows = {c: pa.array([x[order[i:i + _ROW]].tobytes() for i in cuts], pa.binary()) for c, x in zip(kinds, made)}
        return pa.table({"bucket": [table["bucket"][0].as_py()] * len(cuts), **rows, "start": [start] * len(cuts), "bits": pa.array([bits, *[b""] * (len(cuts) - 1)], pa.binary())})

    def run(batches):
        for batch in batches:
            yield from _pack(dict(zip(kinds, _numbers(pa.table(batch.columns, list(kinds)), **kinds))), "key", buckets).to_batches(max_chunksize=16)

    spread = spread.select(*kinds).mapInArrow(run, _fields(*kinds))
    return spread.groupBy("bucket").applyInArrow(bucket, "bucket long, key binary, root binary, v binary, start long, bits binary")


def _retain(longer: DataFrame, level: DataFrame, divergence: float, evidence: float, sent: float, buckets: int) -> DataFrame:
    """Divergence tests of the contexts ``level`` (key, n, p, term, root), packed by ranges of keys, with the followers ``longer``, as counted, by ranges of suffixes,
    then of contexts: (kind, bucket, key, n, p, term, root, v), packed by ranges of keys. Kind 0: the followers with p and term; kind 1: the contexts
    with root and v, their term and their own, if they have a value or occur ``sent`` times. A task holds all followers of a context."""

    def beside(table: pa.Table) -> pa.Table:
        _released()
        key, n, ctx, suf, own, p = _numbers(table, key=np.int64, n=np.int64, ctx=np.int64, suf=np.int64, own=np.int64, p=np.float64)
        order = np.argsort(own)
        own, p = own[order], p[order]
        at = np.minimum(np.searchsorted(own, suf), max(len(own) - 1, 0))
        has = own[at] == suf if len(own) else np.zeros(len(suf), bool)
        return _pack({"key": key[has], "n": n[has], "ctx": ctx[has], "parent": p[at[has]]}, "ctx", buckets)

    def test(table: pa.Table) -> pa.Table:
        _released()
        key, n, ctx, parent = _numbers(table, key=np.int64, n=np.int64, ctx=np.int64, parent=np.float64)
        own, seen, root, before = _numbers(table, own=np.int64, seen=np.int64, root=np.float64, term=np.float64)
        root = root if len(root) else np.full(len(own), np.nan)  # no level but the first has any
        order = np.argsort(own)
        own, seen, root, v = own[order], seen[order], root[order], before[order]
        order = np.argsort(ctx)
        key, n, ctx, parent = key[order], n[order], ctx[order], parent[order]
        p, term = parent.copy(), np.zeros(len(key))
        if len(key) and len(own):
            first = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]]))
            followers = np.diff(np.append(first, len(ctx)))
            counted = np.add.reduceat(n, first)
            at = np.minimum(np.searchsorted(own, ctx[first]), len(own) - 1)
            uncounted = np.maximum(seen[at] - counted, 0)
            rest = uncounted + followers + 1.0
            whole = counted + rest
            here = np.repeat(np.arange(len(first)), followers)
            smoothed = (n + rest[here] * parent) / whole[here]
            gain = np.add.reduceat(n * np.log(smoothed / parent), first) + uncounted * np.log(rest / whole)
            kept = (own[at] == ctx[first]) & (gain >= evidence) & (gain >= divergence * seen[at])
            left = np.log10(rest / whole)
            v[at[kept]] += left[kept]
            p = np.where(kept[here], smoothed, parent)
            term = np.where(kept[here], np.log10(smoothed / parent) - left[here], 0.0)
        below = _pack({"key": key, "n": n, "p": p, "term": term}, "key", buckets)
        has = ~np.isnan(root) | (v != 0) | (seen >= sent)
        values = _pack({"key": own[has], "n": seen[has], "root": root[has], "v": v[has]}, "key", buckets)
        made = [t.append_column("kind", pa.array([kind] * t.num_rows, pa.int32())) for kind, t in ((0, below), (1, values))]
        return pa.concat_tables(made, promote_options="default").select(["kind", "bucket", "key", "n", "p", "term", "root", "v"])

    rows = longer.unionByName(level.select("bucket", F.col("key").alias("own"), "p"), allowMissingColumns=True)
    followers = rows.groupBy("bucket").applyInArrow(beside, _fields("key", "n", "ctx", "parent"))
    contexts = level.select("bucket", F.col("key").alias("own"), F.col("n").alias("seen"), "root", "term")
    rows = followers.unionByName(contexts, allowMissingColumns=True)
    return rows.groupBy("bucket").applyInArrow(test, f"kind int, {_fields('key', 'n', 'p', 'term', 'root', 'v')}")


def fit(docs: DataFrame, *, text: str = "text", depth: int = DEPTH, min_share: float = MIN_SHARE, divergence: float = DIVERGENCE, evidence: float = EVIDENCE) -> Model:
    """The tree of the training texts."""
    tables = _Tables(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length(text)).alias("bytes")).first().bytes or 0
    buckets, power = 1 + size // _RANGE, _power(size)
    count = partial(_count, docs, text, buckets=buckets)
    single = tables.put("single", count(1, None, 1, give="counts"))
    size = single.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    tokens, distinct = size.n or 0, size.v
    least, sent = max(2.0, min_share * tokens), SENT * tokens
    p = (F.col("n") + 0.5) / F.lit(tokens + 0.5 * (distinct + 1))
    level = _spread(single.select("key", "n", p.alias("p"), F.log10(p).alias("term"), F.log10(p).alias("root")), "key", buckets)
    send = docs.sparkSession.sparkContext.broadcast  # one file at the driver and at every executor until destroyed
    known = _spread(single.where(F.col("n") >= least).select("key", F.lit(0.0).alias("root"), F.lit(0.0).alias("v")), "key", buckets)
    often = send(_bitmap(tables.put("bits-1", _packed(known, 12, power).select("start", "bits")), power))
    tables.drop("bits-1")
    for length in range(2, depth + 2):
        # Most sequences occur once: they are left out by their keys, before their parts are shuffled. What is left is all of the next level.
        near, often = often, send(_bitmap(tables.put(f"bits-{length}", count(length, often, least, give="bits")), power))
        tables.drop(f"bits-{length}")
        longer = tables.put(f"longer-{length}", count(length, near, least, often=often))
        near.destroy()
        tables.drop()
        # The values of the level before lie with this level.
        made = tables.split(f"tree/of={length}", _retain(longer, level, divergence, evidence, sent, buckets), "kind")
        tables.drop("single" if length == 2 else f"tree/of={length - 1}/kind=0", f"longer-{length}")
        level = made.where(F.col("kind") == 0).select("bucket", "key", "n", "p", "term", "root")
    often.destroy()
    nothing = level.limit(0).select("bucket", F.col("key").alias("suf"), "key", "n", F.col("key").alias("ctx"))
    tables.split(f"tree/of={depth + 2}", _retain(nothing, level, divergence, evidence, sent, buckets), "kind")  # contexts that nothing follows
    tables.drop(f"tree/of={depth + 1}/kind=0")
    spread = docs.sparkSession.read.schema(level.select("bucket", "key", "n", "root", F.col("root").alias("v")).schema).parquet(f"{tables.root}/tree")
    values = _flat(spread)
    buckets = max(48, 1 + int(spread.agg(F.sum(F.octet_length("key")).alias("bytes")).first().bytes or 0) // 8 // _VALUES)
    packed = tables.put("packed", _packed(spread, buckets, power))
    bitmap = _bitmap(packed, power)
    tables.drop()
    return Model(values, packed.drop("start", "bits"), buckets, bitmap, tokens, distinct, depth)


def _shuffled(key: np.ndarray) -> bytes:
    """Sorted keys as their differences, first bytes first: those that are zero stand together."""
    return np.diff(key, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _sorted(packet: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(packet, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def score(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_tokens, n_known, base_score, score) for each row of ``docs``. Tasks add up the frequent
    sequences of a block of texts and ask for the values of the others: one packet for each range of keys, which has
    each key once and the texts that have it. The answers, sums by text, meet in the block's own group.
    The rows of a partition of ``docs`` must come in the same order when it is read again, as those of files do."""
    spark = docs.sparkSession
    frequent = model.values.where(F.col("n") >= max(2.0, SENT * model.tokens)).orderBy("key").toPandas()  # at most 1 / SENT rows of each length
    order = np.argsort(keys := frequent.key.to_numpy(np.int64).view(np.uint64))
    root, value = (frequent[c].to_numpy(np.float64)[order] for c in ("root", "v"))
    sent = spark.sparkContext.broadcast((_Places(keys[order]), np.nan_to_num(root), value, model.bitmap))
    length, buckets, lacking = model.depth + 1, model.buckets, float(np.log10(0.5 / model.scale))
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    kinds = (("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType()))
    out = T.StructType([source.schema["doc_id"], source.schema["text_hash"], *(T.StructField(n, t) for n, t in kinds)])
    fields = "bucket long, block long, kind int, key binary, root binary, v binary"
    names = ["bucket", "block", "kind", "key", "root", "v"]

    def ask(batches):
        """Of each block of texts: its rows with their sums over frequent sequences (kind 1); and packets (kind 2): the
        keys of others that may have a value, the text of each of their places, and which places are a key's first."""
        sure, root, value, bitmap = sent.value
        block = TaskContext.get().partitionId() << 32
        heads, asked = [], []

        def packets():
            nonlocal block
            table = pa.Table.from_batches(heads)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as stream:
                stream.write_table(table)
            yield [(block % buckets, sink.getvalue().to_pybytes(), b"", b"")], 1
            key, text_at = (np.concatenate(x) for x in zip(*asked))
            order = np.argsort(key)
            key, text_at = key[order], text_at[order]
            first = np.concatenate([[True], key[1:] != key[:-1]])[:len(key)]
            found = _stretches(_ranges(key, buckets))
            for i in range(0, len(found), 16):
                yield [(k, _shuffled(key[a:b][first[a:b]]), text_at[a:b].tobytes(), np.packbits(first[a:b]).tobytes()) for k, a, b in found[i:i + 16]], 2
            heads.clear()
            asked.clear()
            block += 1

        def rows(made):
            for own, kind in made:
                bucket, *packed = zip(*own)
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array([block] * len(own), pa.int64()), pa.array([kind] * len(own), pa.int32()), *(pa.array(x, pa.binary()) for x in packed)], names)

        for batch, texts in parts(batches, "text", _BLOCK):
            n, before = len(texts), sum(h.num_rows for h in heads)
            if heads and (before + n > 1 << 16 or sum(len(x[0]) for x in asked) >= _ASKED):
                yield from rows(packets())
                before = 0
            for at in range(0, n, 1 << 16):  # a block has at most so many texts
                if at:
                    yield from rows(packets())
                    before = 0
                here = texts[at:at + (1 << 16)]
                sizes, found = _keys(here, length)
                owner = np.concatenate([[0], np.repeat(np.arange(len(here)), sizes)])
                known, base, tree = np.zeros(len(here), np.int64), np.zeros(len(here)), np.zeros(len(here))
                for k, (key, valid) in enumerate(found):
                    places = 1 + np.flatnonzero(valid[1:])
                    places = places[_listed(bitmap, key[places])]
                    own_keys, text_at = key[places], owner[places]
                    if len(value):
                        near, hit = sure.of(own_keys)
                        near, own_texts = near[hit], text_at[hit]
                        tree += np.bincount(own_texts, value[near], len(here))
                        if k == 0:
                            known += np.bincount(own_texts, minlength=len(here))
                            base += np.bincount(own_texts, root[near], len(here))
                        own_keys, text_at = own_keys[~hit], text_at[~hit]
                    asked.append((own_keys, (before + text_at).astype(np.uint16)))
                piece = batch.slice(at, len(here))
                heads.append(pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), *(pa.array(x) for x in (sizes, known, base, tree))], out.names))
        if heads:
            yield from rows(packets())
        _released()

    def answer(table: pa.Table) -> pa.Table:
        """The packets' sums by text (kind 2: texts, (known, root), value), and rows as they came."""
        _released()
        key, root, v = _numbers(table.filter(pc.equal(table["kind"], 0)), key=np.uint64, root=np.float64, v=np.float64)
        order = np.argsort(key)
        key, root, v = key[order], root[order], v[order]
        made = []
        for batch in table.to_batches(max_chunksize=16):
            for r in batch.to_pylist():
                if r["kind"] == 1:
                    made.append(r)
                elif r["kind"] == 2 and len(key):
                    asked, text_at = _sorted(r["key"]), np.frombuffer(r["root"], np.uint16)
                    near = np.searchsorted(key, asked)
                    near[near == len(key)] = 0
                    which = np.cumsum(np.unpackbits(np.frombuffer(r["v"], np.uint8), count=len(text_at))) - 1
                    hit = key[near] == asked
                    is_known = hit & ~np.isnan(root[near])
                    sums = [np.bincount(text_at, x[which]) for x in (is_known.astype(float), np.where(is_known, root[near], 0.0), np.where(hit, v[near], 0.0), hit.astype(float))]
                    some = np.flatnonzero(sums[3])
                    made.append(r | {"key": some.astype(np.uint16).tobytes(), "root": np.concatenate([sums[0][some], sums[1][some]]).tobytes(), "v": sums[2][some].tobytes()})
        return pa.Table.from_pylist([{n: r[n] for n in names} for r in made], table.schema)

    def total(table: pa.Table) -> pa.Table:
        _released()
        made = table.to_pylist()
        rows = pa.ipc.open_stream(next(r["key"] for r in made if r["kind"] == 1)).read_all()
        n_tokens, known, base, tree = (rows[c].to_numpy().copy() for c in out.names[2:])
        for r in made:
            if r["kind"] == 2:
                at, (also, rare) = np.frombuffer(r["key"], np.uint16), np.frombuffer(r["root"], np.float64).reshape(2, -1)
                known[at] += np.rint(also).astype(np.int64)
                base[at] += rare
                tree[at] += np.frombuffer(r["v"], np.float64)
        rest = (n_tokens - known) * lacking
        return pa.table([rows[0], rows[1], n_tokens, known, base + rest, tree + rest], out.names)

    tables = _Tables(spark)
    given = model.packed.select("bucket", F.lit(None).cast("long").alias("block"), F.lit(0).alias("kind"), "key", "root", "v")
    for wave in range(_WAVES):
        asked = source.where(F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(_WAVES)) == wave).mapInArrow(ask, fields)
        answers = given.unionByName(asked).groupBy("bucket").applyInArrow(answer, fields)
        tables.put(f"scores/wave={wave}", answers.groupBy("block").applyInArrow(total, out))
        del asked, answers
        tables.drop()
    sent.destroy()
    return spark.read.schema(out).parquet(f"{tables.root}/scores").select(*out.names)


def fit_and_score(docs: DataFrame, train, **options) -> tuple[DataFrame, Model]:
    """Scores of all rows by a tree of the rows for which the column ``train`` holds."""
    model = fit(docs.where(train).select("text"), **options)
    return score(docs, model), model
