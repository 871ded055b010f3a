"""Benchmark decontamination by greedy string tiling.

Texts are lower-cased and cut into words: runs of letters, digits and combining marks, and each sign
by itself in scripts that put no blanks between words. A benchmark
item and a document that share a seed of five consecutive words are compared: running Karp-Rabin
hashes find their longest common runs of words that no tile covers yet, the longest are marked as
tiles, and so on with shorter runs down to five words. Tiles may lie in any order, so a passage with
its sentences rearranged is covered as well as a verbatim one. A document is contaminated by an item
if tiles cover at least 0.8 of the item's words. An item shorter than a seed is one tile: it must stand
in the document as a whole, an item of a single word must be the whole document.

Seeds of the item's words bound that coverage from above, so a pair below the threshold by its seeds
alone is not tiled. The benchmark is the stated query set: it goes to the tasks in blocks of about
``block_bytes`` of text, each read against all documents; no row of the documents is shuffled. Every
block is a pass of its own: only one block is on the driver and the executors at a time, and the rows
with the matches so far are checkpointed between passes.

Defined results: null texts and texts without words match nothing; items of equal words are each
reported, also rows that repeat; repeated documents each get their
result; without items or documents the result is empty. Extra columns pass through; a column
named like the output is replaced.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salescope.llm.common import cut, with_columns

LEAST = 5
COVERAGE = 0.8
BLOCK_BYTES = 16 << 20
_CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(128)) + bytes(range(128, 256))
_UNSPACED = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
_WORD = regex.compile(rf"(?V1)[[{_UNSPACED}]&&[\p{{L}}\p{{N}}]]\p{{M}}*+|[[\p{{L}}\p{{M}}\p{{N}}]--[{_UNSPACED}]]++|\p{{M}}++")
_BASE = 0x9E3779B97F4A7C15
_ODD, _BACK = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))


def words(text: bytes) -> list[bytes]:
    if text.isascii():
        return text.translate(_CLEAN).split()
    return [w.encode() for w in _WORD.findall(text.decode("utf-8", "replace").lower())]


def _runs(ids: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hash of each run of ``length`` ids: the polynomial of the ids, rolled from position to position
    (modulo 2**64; equal hashes are compared word by word)."""
    powers = np.cumprod(np.full(len(ids) + 1, _ODD, np.uint64)) * _BACK
    inverse = np.cumprod(np.full(len(ids) + 1, _BACK, np.uint64)) * _ODD
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(ids) * powers[:-1], dtype=np.uint64)])
    return (sums[length:] - sums[:-length]) * inverse[:len(ids) - length + 1]


def _mixed(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.uint64) + np.uint64(1)
    x = (x ^ (x >> np.uint64(15))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


def _free(marked: np.ndarray, length: int) -> np.ndarray:
    """Starts of runs of ``length`` words that no tile covers."""
    covered = np.concatenate([[0], np.cumsum(marked)])
    return np.flatnonzero(covered[length:] == covered[:-length])


def tiles(doc: np.ndarray, item: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Greedy tiling of two sequences of word ids (0 in ``doc`` equals nothing): (start in doc, start in item, length),
    longest first; of equal lengths the first in the item, then in the document."""
    out: list[tuple[int, int, int]] = []
    in_doc, in_item = doc == 0, np.zeros(len(item), bool)
    size = min(len(item), len(doc))
    while size >= least:
        a, b = _free(in_doc, size), _free(in_item, size)
        found = []
        if len(a) and len(b):
            hashed: dict[int, list[int]] = {}
            for h, j in zip(_runs(item, size)[b].tolist(), b.tolist()):
                hashed.setdefault(h, []).append(j)
            runs = _runs(doc, size)[a]
            same = np.isin(runs, np.fromiter(hashed, np.uint64, len(hashed)))
            for i, h in zip(a[same].tolist(), runs[same].tolist()):
                found += [(j, i) for j in hashed[h] if np.array_equal(doc[i:i + size], item[j:j + size])]
        # The search length falls from the longest possible by halves; a run found is as long as it extends.
        longer = []
        for j, i in found:
            n = size
            while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and not in_doc[i + n] and not in_item[j + n]:
                n += 1
            longer.append((-n, j, i))
        for n, j, i in sorted(longer):
            n = -n
            if not in_doc[i:i + n].any() and not in_item[j:j + n].any():
                in_doc[i:i + n] = in_item[j:j + n] = True
                out.append((i, j, n))
        if size == least and not found:
            break
        if not found or not _any_left(longer, in_doc, in_item):
            size = max(least, size // 2) if size > least else 0
    return out


def _any_left(longer, in_doc, in_item) -> bool:
    return any(not in_doc[i] and not in_item[j] for _, j, i in longer)


class Index:
    """Seeds of one block of the benchmark."""

    def __init__(self, items: Iterable[tuple[object, bytes, int]], least: int):
        """``items``: key, text and how many rows of the benchmark have both."""
        self.least = least
        self.vocab: dict[bytes, int] = {}
        groups: dict[tuple[int, ...], list] = {}
        for key, text, n in items:
            ids = tuple(self.vocab.setdefault(w, len(self.vocab) + 1) for w in words(text))
            if ids:
                groups.setdefault(ids, []).extend([key] * n)
        self.short: dict[int, dict[tuple[int, ...], list]] = {}
        for ids in [g for g in groups if len(g) < least]:
            self.short.setdefault(len(ids), {})[ids] = groups.pop(ids)
        self.keys = list(groups.values())
        self.items = [np.array(ids, np.int64) for ids in groups]
        if self.items:
            seeds = [_seeds(i, least) for i in self.items]
            all_seeds = np.concatenate(seeds)
            order = np.argsort(all_seeds, kind="stable")
            self.hashes, self.first = np.unique(all_seeds[order], return_index=True)
            self.last = np.append(self.first[1:], len(all_seeds))
            self.item = np.repeat(np.arange(len(seeds)), [len(s) for s in seeds])[order]
            self.at = np.concatenate([np.arange(len(s)) for s in seeds])[order]

    def batch(self, batch: list[bytes], coverage: float) -> list[list[tuple]]:
        """For each text the matches: (key, coverage, tiles)."""
        out: list[list[tuple]] = [[] for _ in batch]
        if not self.items and not self.short:
            return out
        size = 0
        ids: list[int] = []
        starts, rows = [], []
        get = self.vocab.get
        for row, text in enumerate(batch):
            starts.append(len(ids))
            rows.append(row)
            ids += [get(w, 0) for w in words(text)]
            ids.append(0)
            size += len(text)
            if size > 4_000_000 or row == len(batch) - 1:
                self._scan(np.array(ids, np.int64), starts, rows, coverage, out)
                size, ids, starts, rows = 0, [], [], []
        return out

    def _scan(self, ids, starts, rows, coverage, out) -> None:
        for n, items in self.short.items():
            self._whole(n, items, ids, np.append(starts, len(ids)), rows, out)
        if len(ids) < self.least or not self.items:
            return
        known = np.concatenate([[0], np.cumsum(ids == 0)])
        at = np.flatnonzero(known[self.least:] == known[:-self.least])
        hashes = _seeds_at(ids, at, self.least)
        slot = np.searchsorted(self.hashes, hashes)
        slot[slot == len(self.hashes)] = 0
        hit = self.hashes[slot] == hashes
        at, slot = at[hit], slot[hit]
        if not len(at):
            return
        bounds = np.append(starts, len(ids))
        owner = np.searchsorted(bounds, at, side="right") - 1
        for d in np.unique(owner):
            mine = np.unique(slot[owner == d])
            doc = ids[bounds[d]:bounds[d + 1] - 1]
            covered: dict[int, set[int]] = {}
            for s in mine:
                for k in range(self.first[s], self.last[s]):
                    covered.setdefault(int(self.item[k]), set()).update(range(self.at[k], self.at[k] + self.least))
            for i, seen in sorted(covered.items()):
                n = len(self.items[i])
                if len(seen) / n >= coverage:
                    found = tiles(doc, self.items[i], self.least)
                    share = sum(t[2] for t in found) / n
                    if share >= coverage:
                        out[rows[d]] += [(key, share, found) for key in self.keys[i]]


    def _whole(self, n: int, items: dict, ids, bounds, rows, out) -> None:
        """Items of ``n`` words, fewer than a seed has: their first place in each document."""
        known = np.concatenate([[0], np.cumsum(ids == 0)])
        at = np.flatnonzero(known[n:] == known[:-n])
        hashes = {int(h) for h in _seeds_at(np.array(list(items), np.int64).ravel(), np.arange(len(items)) * n, n)}
        at = at[np.isin(_seeds_at(ids, at, n), np.fromiter(hashes, np.uint64, len(hashes)))]
        owner = np.searchsorted(bounds, at, side="right") - 1
        seen = set()
        for i, d in zip(at.tolist(), owner.tolist()):
            item = tuple(ids[i:i + n].tolist())
            if item in items and (d, item) not in seen and (n > 1 or bounds[d + 1] - 1 - bounds[d] == 1):
                seen.add((d, item))
                out[rows[d]] += [(key, 1.0, [(i - int(bounds[d]), 0, n)]) for key in items[item]]


def _seeds(ids: np.ndarray, least: int) -> np.ndarray:
    return _seeds_at(ids, np.arange(len(ids) - least + 1), least)


def _seeds_at(ids: np.ndarray, at: np.ndarray, least: int) -> np.ndarray:
    total = np.zeros(len(at), np.uint64)
    for k in range(least):
        total = total * _ODD + _mixed(ids[at + k])
    return total


def matches(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text",
            least: int = LEAST, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES, out: str = "matches") -> DataFrame:
    """All rows of ``docs`` with ``out``: array of (item_id, coverage, tiles: array of (doc_word, item_word, words)),
    in order of item_id."""
    key_type = benchmark.schema[item_id].dataType
    kind = T.ArrayType(T.StructType([T.StructField("item_id", key_type), T.StructField("coverage", T.DoubleType()), T.StructField(
        "tiles", T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("doc_word", "item_word", "words")])))]))
    items = benchmark.select(F.col(item_id).alias("k"), F.col(item_text).cast("binary").alias("t")).where("t is not null")
    items = cut(items.groupBy("k", "t").agg(F.count(F.lit(1)).alias("n")))
    total = items.agg(F.sum(F.length("t") + 64)).first()[0] or 0
    blocks = max(1, -(-2 * total // block_bytes))  # equal rows count once, so blocks by hash are about half full
    kept = [c for c in docs.columns if c.lower() != out.lower()]
    so_far = "__tiles"
    result = docs.select(*(F.col(f"`{c}`") for c in kept))
    for b in range(blocks):
        part = [(r.k, bytes(r.t), r.n) for r in items.where(F.pmod(F.xxhash64("k", "t"), F.lit(blocks)) == b).collect()]
        sent = docs.sparkSession.sparkContext.broadcast(part)

        def start(sent=sent):
            index = Index(sent.value, least)

            def rows(batch):
                return ([[{"item_id": k, "coverage": c, "tiles": [dict(zip(("doc_word", "item_word", "words"), t)) for t in ts]} for k, c, ts in m]
                         for m in index.batch(batch, coverage)],)

            return rows

        result = with_columns(result, text, [("__block", kind.simpleString())], start)
        found = F.concat(so_far, "__block") if b else F.col("__block")
        result = result.select(*(F.col(f"`{c}`") for c in kept), found.alias(so_far))
        if b + 1 < blocks:
            result = cut(result)
            sent.unpersist()
    return result.select(*(F.col(f"`{c}`") for c in kept), F.array_sort(so_far).alias(out))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that no benchmark item contaminates."""
    return matches(docs, benchmark, out="__matches", **options).where("size(__matches) = 0").drop("__matches")
