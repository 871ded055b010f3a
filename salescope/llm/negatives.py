"""Hard negatives of anchor vectors, by exact integer scores from subset-sum tables (the method of Four Russians).

Each component x of a vector becomes the integer ``floor(scale * x)``; a score is the inner product of two rows'
integers. ``mine`` finds for each anchor its positives (the best other rows of its label) and, for each of these, the
best rows of another label whose score lies between ``low`` and ``high`` percent of the positive's.

Scores: the dimensions are taken in groups of eight. For each anchor and group a table holds the sums of all 256
subsets of the anchor's eight integers. A candidate is packed once: bit b of its eight integers of a group (in two's
complement) is one byte, so its row is one byte for each bit plane and group. Looking each byte up in the group's table
and adding the planes up, shifted, from the sign's plane down, gives the full exact score.

Candidates are packed as they are read; equal rows (same id, label and integers) become one. All anchors meet all
candidates in a grid of cells: anchors are dealt into groups of about ``ANCHORS`` and candidates into stripes, both by
hash, and a cell is one group and one stripe. A cell reads its anchors first (they come first in the sort), then
streams its candidates and keeps the best few of each anchor or positive, so neither the driver nor a task holds
more than a group of anchors and their tables (8 KB for each anchor of 64 dimensions). What the stripes keep is
ranked again for each anchor. Positives take one pass over rows of the anchors' own labels; negatives another one,
between the bounds that the positives give.

Defined results: rows with a null id, label or vector, or a null or non-finite component, take no part, neither as
anchors nor as candidates. Shorter vectors read as if zeros followed. Higher scores come first, then smaller ids.
Of rows with one id but different content each is a candidate; the anchor is the one with the smallest label, then
the smallest packed bytes, and a row with the anchor's id is never its partner. Of several with one id and score the
first few places count it once. An anchor without positives, and a positive without negatives in its bounds, gives no
row. Other columns are left out. Scores must fit 64 bits: if the largest integers and the number of dimensions do not
guarantee that, ``mine`` raises an error before it starts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from salescope.llm.common import cut

ANCHORS = 512
CHUNK = 1024  # candidates scored at once
PACKED = "id bigint, label bigint, planes binary"


def packed(rows: DataFrame, id_col: str, label: str, vector: str, scale: int) -> tuple[DataFrame, int, int]:
    """Usable rows as (id, label, planes), equal ones once; bits of an integer and groups of dimensions."""
    usable = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = usable.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).where(fine)
    most = usable.select(F.size("v").alias("dims"), F.array_max(F.transform("v", lambda x: F.abs(F.rint(x * scale) * 1.0))).alias("top"))
    dims, top = most.agg(F.max("dims"), F.max("top")).first()
    dims, top = dims or 0, (top or 0) + 1
    if dims * top * top * 200 >= 2.0 ** 63:  # scores times the percentages that they are compared by
        raise ValueError(f"scores of {dims} components up to {top} do not fit 64 bits")
    bits, groups = int(top).bit_length() + 1, -(-dims // 8) or 1

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.arange(bits, dtype=np.int64)
        for batch in batches:
            v = batch.column(2)
            starts = v.offsets.to_numpy().astype(np.int64)
            sizes = np.diff(starts)
            flat = v.values.to_numpy(zero_copy_only=False)[starts[0]:starts[-1]]
            place = np.arange(len(flat)) - np.repeat(starts[:-1] - starts[0], sizes)
            ints = np.zeros((batch.num_rows, groups * 8), np.int64)
            ints[np.repeat(np.arange(batch.num_rows), sizes), place] = np.floor(flat * scale).astype(np.int64)
            out = np.empty((batch.num_rows, bits, groups), np.uint8)
            for b in shift.tolist():
                out[:, b] = np.packbits((ints >> b & 1).astype(np.uint8).reshape(-1, groups, 8), axis=2, bitorder="little")[:, :, 0]
            width = bits * groups
            ends = np.arange(batch.num_rows + 1, dtype=np.int32) * width
            planes = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(out.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), planes], ["id", "label", "planes"])

    return usable.mapInArrow(pack, PACKED).distinct(), bits, groups


def subset_sums(ints: np.ndarray, kind: type) -> np.ndarray:
    """Tables of anchors' integers (anchor x 8 * groups): group x 256 x anchor."""
    anchors, dims = ints.shape
    eights = ints.T.reshape(dims // 8, 8, anchors)
    table = np.zeros((dims // 8, 256, anchors), kind)
    for k in range(8):
        table[:, 1 << k:2 << k] = table[:, :1 << k] + eights[:, k, None]
    return table


def integers(planes: np.ndarray) -> np.ndarray:
    """Packed rows (row x plane x group) as integers again (row x 8 * groups)."""
    rows, bits, groups = planes.shape
    flags = np.unpackbits(planes[..., None], axis=3, bitorder="little").reshape(rows, bits, groups * 8).astype(np.int64)
    weights = 1 << np.arange(bits, dtype=np.int64)
    weights[-1] = -weights[-1]
    return np.tensordot(flags, weights, (1, 0))


def scores(table: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Exact inner products (candidate x anchor) of packed candidates with the anchors of a table."""
    rows, bits, groups = planes.shape
    total = np.zeros((rows, table.shape[2]), table.dtype)
    looked = np.empty_like(total)
    for b in range(bits - 1, -1, -1):
        for g in range(groups):
            np.take(table[g], planes[:, b, g], axis=0, out=looked)
            total += looked
        if b == bits - 1:
            np.negative(total, out=total)  # the sign's plane
        if b:
            total <<= 1
    return total


class Best:
    """The ``most`` best (score, id) pairs of each of ``slots`` lists, each pair once."""

    def __init__(self, slots: int, most: int):
        self.most = most
        self.slot, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))
        self.least = np.full(slots, np.iinfo(np.int64).min)  # a full list's last score

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        slot, score, ids = np.concatenate([self.slot, slot]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        fresh = np.ones(len(slot), bool)
        fresh[1:] = (slot[1:] != slot[:-1]) | (score[1:] != score[:-1]) | (ids[1:] != ids[:-1])
        slot, score, ids = slot[fresh], score[fresh], ids[fresh]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        kept = rank < self.most
        self.slot, self.score, self.id, rank = slot[kept], score[kept], ids[kept], rank[kept]
        full = rank == self.most - 1
        self.least[self.slot[full]] = self.score[full]


def _frames(batches: Iterator[pa.RecordBatch], bits: int, groups: int) -> Iterator[tuple]:
    """A sorted partition as (cell, is_candidate, id, label, planes, low, high), at most CHUNK rows of one kind each."""
    for batch in batches:
        cell, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
        edges = np.flatnonzero((cell[1:] != cell[:-1]) | (kind[1:] != kind[:-1])) + 1
        edges = np.unique(np.concatenate([edges, np.arange(0, batch.num_rows, CHUNK), [batch.num_rows]]))
        for at, to in zip(edges[:-1].tolist(), edges[1:].tolist()):
            part = batch.slice(at, to - at)
            planes = np.frombuffer(b"".join(part.column(4).to_pylist()), np.uint8).reshape(-1, bits, groups)
            yield (int(cell[at]), bool(kind[at]), part.column(2).to_numpy(), part.column(3).to_numpy(), planes, part.column(5), part.column(6))


def _grid(candidates: DataFrame, anchors: DataFrame, bits: int, groups: int, most: int, per_anchor: int, own_label: bool) -> DataFrame:
    """The best rows of each anchor's lists in each cell: (anchor, place of the list, score, id).

    ``anchors`` have ``lows`` and ``highs``, the inclusive bounds of ``per_anchor`` lists at most."""
    n_anchors, n_rows = anchors.count(), candidates.count()
    cores = candidates.sparkSession.sparkContext.defaultParallelism
    n_groups = -(-n_anchors // ANCHORS) or 1
    stripes = max(-(-n_rows // (1 << 18)), min(-(-n_rows // (1 << 12)), -(-4 * cores // n_groups)), 1)
    by_hash = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "id", "planes"), F.lit(n))
    empty = F.array().cast("array<bigint>")
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    left = anchors.select("*", by_hash(n_groups, 1).alias("g")).select("*", all_of(stripes).alias("s"))
    left = left.select((F.col("g") * stripes + F.col("s")).alias("cell"), F.lit(False).alias("candidate"), "id", "label", "planes", "lows", "highs")
    right = candidates.select("*", by_hash(stripes, 2).alias("s")).select("*", all_of(n_groups).alias("g"))
    right = right.select((F.col("g") * stripes + F.col("s")).alias("cell"), F.lit(True).alias("candidate"), "id", "label", "planes", empty.alias("lows"), empty.alias("highs"))
    tasks = min(n_groups * stripes, 64 * cores)
    cells = left.union(right).repartitionById(tasks, (F.col("cell") % tasks).cast("int")).sortWithinPartitions("cell", "candidate", "label")
    biggest = (1 << bits) ** 2 * groups * 8
    kind = np.int32 if biggest < 2 ** 31 else np.int64

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, best, tables, of_label = None, [], None, None, (None, None)

        def prepare():
            ids, labels, planes = (np.concatenate([h[k] for h in held]) for k in range(3))
            order = np.argsort(labels, kind="stable")
            ids, labels, planes = ids[order], labels[order], planes[order]
            lows = [x for h in held for x in h[3]]
            highs = [x for h in held for x in h[4]]
            low, high = np.full((len(ids), per_anchor), 1), np.full((len(ids), per_anchor), 0)  # unused lists take nothing
            for row, o in enumerate(order.tolist()):
                low[row, :len(lows[o])], high[row, :len(highs[o])] = lows[o], highs[o]
            return ids, labels, low, high, subset_sums(integers(planes), kind)

        def kept() -> Iterator[pa.RecordBatch]:
            if best is not None and len(best.slot):
                columns = [tables[0][best.slot // per_anchor], best.slot % per_anchor, best.score, best.id]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["anchor", "place", "score", "id"])

        for cell, candidate, ids, labels, planes, lows, highs in _frames(batches, bits, groups):
            if cell != here:
                yield from kept()
                here, held, best, tables, of_label = cell, [], None, None, (None, None)
            if not candidate:
                held.append((ids, labels, planes, lows.to_pylist(), highs.to_pylist()))
                continue
            if not held:
                continue
            if tables is None:
                tables = prepare()
                best = Best(len(tables[0]) * per_anchor, most)
            anchor_ids, anchor_labels, low, high, table = tables
            for mine in np.unique(labels).tolist() if own_label else [None]:
                if own_label:  # anchors of this label alone
                    first, last = np.searchsorted(anchor_labels, [mine, mine + 1])
                    rows = np.flatnonzero(labels == mine)
                else:
                    first, last, rows = 0, len(anchor_ids), np.arange(len(ids))
                if first == last:
                    continue
                if of_label[0] != (first, last):
                    of_label = ((first, last), np.ascontiguousarray(table[:, :, first:last]))
                points = scores(of_label[1], planes[rows])
                partner = ids[rows][:, None] != anchor_ids[None, first:last]
                if not own_label:
                    partner &= labels[rows][:, None] != anchor_labels[None, first:last]
                slots, found, whose = [], [], []
                least = best.least.reshape(-1, per_anchor)[first:last]
                for place in range(per_anchor):
                    floor = np.maximum(low[first:last, place], least[:, place])
                    r, a = np.nonzero((points >= floor) & (points <= high[first:last, place]) & partner)
                    slots.append((a + first) * per_anchor + place)
                    found.append(points[r, a].astype(np.int64))
                    whose.append(ids[rows][r])
                if any(len(s) for s in slots):
                    best.add(np.concatenate(slots), np.concatenate(found), np.concatenate(whose))
        yield from kept()

    return cells.mapInArrow(work, "anchor bigint, place bigint, score bigint, id bigint")


def _top(found: DataFrame, keys: list[str], most: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def mine(rows: DataFrame, is_anchor: Column, *, id_col: str = "vec_id", label: str = "label", vector: str = "embedding",
         scale: int = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """The hard negatives of each anchor and positive: (anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score). ``is_anchor`` is a condition over ``id`` and ``label`` of the usable rows."""
    every, bits, groups = packed(rows, id_col, label, vector, scale)
    every = cut(every)
    same_id = F.min(F.struct("label", "planes")).alias("one")
    anchors = every.where(is_anchor).groupBy("id").agg(same_id).select("id", "one.label", "one.planes")
    top, bottom = (1 << 63) - 1, -(1 << 63)
    anywhere = anchors.withColumns({"lows": F.array(F.lit(bottom)), "highs": F.array(F.lit(top))})
    near = _top(_grid(every, anywhere, bits, groups, positives, 1, True).drop("place"), ["anchor"], positives)
    near = cut(near.select("anchor", (F.col("rank") - 1).cast("bigint").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    # in integers: the smallest score with 100 * score >= low * positive, the greatest with 100 * score <= high * positive
    least = F.expr(f"-((-(positive_score * {low}L) - pmod(-(positive_score * {low}L), 100L)) div 100L)")
    most = F.expr(f"(positive_score * {high}L - pmod(positive_score * {high}L, 100L)) div 100L")
    bounds = near.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("place", least.alias("low"), most.alias("high")))).alias("b"))
    bound = anchors.join(bounds, anchors.id == bounds.anchor).select("id", "label", "planes", F.col("b.low").alias("lows"), F.col("b.high").alias("highs"))
    far = _top(_grid(every, bound, bits, groups, negatives, positives, False), ["anchor", "place"], negatives)
    joined = far.join(near, ["anchor", "place"])
    return joined.select(F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"),
                         F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
