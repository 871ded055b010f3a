"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Folding (``fold``) lower-cases, undoes compatibility forms, maps look-alike letters of other
scripts and digits or signs standing for letters to the Latin letter, and turns every other sign
into one blank, so that each word starts after a blank. The lexicon holds word beginnings with
weights. One automaton finds its entries and the exception phrases in a single pass; an entry
inside an exception phrase counts nothing, and of the entries that start at one word only the
heaviest counts. The sum of weights is divided by the number of words, and a logistic curve maps it
to a score.

``fit`` learns the lexicon, further exception phrases and the curve from labelled documents. It
uses at most ``max_rows`` of them (those with the smallest hash of doc_id, a documented bound); every
other step covers all rows.

Defined results: null text scores as empty text; text without a match scores the curve's value at
zero; null or other labels than 0/1 are ignored, and a document labelled repeatedly takes the
largest label; without labelled rows the lexicon is empty and every score is 0. Extra columns pass
through; existing columns named ``score`` or ``predicted`` are replaced.
"""

from __future__ import annotations

import heapq
import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salescope.llm.common import cut, parts, with_columns

MAX_ROWS = 12_000
MAX_ENTRIES = 5_000
STEMS = range(4, 8)
THRESHOLD = 0.3

#: Phrases in which an insult is no insult; parameters of the operator.
EXCEPTIONS = ("trash can", "trash bin", "trash collection", "class clown", "clown fish", "circus clown",
              "stupid question", "sore loser", "pond scum", "soap scum")

LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t",
    "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ո": "n", "ց": "g",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
    "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ɑ": "a", "ⅼ": "l",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
_FOLDED = str.maketrans(LOOKALIKES | SUBSTITUTES)
_GAPS = re.compile(r"[\W_]+")
#: A sign for a letter counts only where a letter follows: "idiot!" ends with a sign, "!diot" does not.
_LOOSE = re.compile(r"[@$!0-9]++(?![^\W\d_])")


def fold(text: str) -> str:
    """Folded words, each preceded by one blank, and one blank at the end."""
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return " " + _GAPS.sub(" ", _LOOSE.sub(" ", text).translate(_FOLDED)).strip() + " "


@dataclass(frozen=True)
class Model:
    weights: dict[str, float] = field(default_factory=dict)  #: folded word beginning -> weight
    exceptions: tuple[str, ...] = ()
    slope: float = 0.0
    offset: float = -math.inf  #: an empty model scores 0


class Matcher:
    """One automaton over the entries and the exception phrases."""

    def __init__(self, model: Model):
        self.auto = ahocorasick.Automaton()
        for stem, weight in model.weights.items():
            self.auto.add_word(" " + stem, (len(stem) + 1, weight))
        for phrase in model.exceptions:
            key = fold(phrase)
            if key.strip():
                self.auto.add_word(key, (len(key), None))
        self.any = len(self.auto) > 0
        if self.any:
            self.auto.make_automaton()

    def density(self, text: str) -> tuple[float, int]:
        """Sum of the weights per hundred words; number of matched words."""
        folded = fold(text)
        if not self.any:
            return 0.0, 0
        best: dict[int, float] = {}
        spans = []
        for end, (length, weight) in self.auto.iter(folded):
            start = end - length + 1
            if weight is None:
                spans.append((start, end))
            elif weight > best.get(start, 0.0):
                best[start] = weight
        for start, end in spans:
            for at in [p for p in best if start <= p < end]:
                del best[at]
        return 100.0 * sum(best.values()) / (folded.count(" ") - 1 or 1), len(best)


def _value(density: float, slope: float, offset: float) -> float:
    z = slope * math.log1p(density) + offset
    return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def score(df: DataFrame, model: Model, *, text: str = "text", prefix: str = "") -> DataFrame:
    """All rows with ``score`` (0 to 1), ``n_matched`` and ``predicted`` (score >= 0.3), named with ``prefix``."""
    sent = df.sparkSession.sparkContext.broadcast(model)  # at most MAX_ENTRIES entries

    def start():
        model = sent.value
        find = Matcher(model)

        def rows(batch: list[bytes]):
            got = [find.density(t.decode("utf-8", "replace")) for t in batch]
            scores = [_value(d, model.slope, model.offset) for d, _ in got]
            return scores, [n for _, n in got], [int(s >= THRESHOLD) for s in scores]

        return rows

    return with_columns(df, text, [(f"{prefix}score", "double"), (f"{prefix}n_matched", "int"), (f"{prefix}predicted", "int")], start)


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows that are not predicted toxic, with their own columns."""
    return score(docs, model, prefix="__toxicity_").where("__toxicity_predicted = 0").select(*(f"`{c}`" for c in docs.columns))


def _stems(word: str) -> set[str]:
    return {word[:n] for n in STEMS if n < len(word)} | ({word + " "} if len(word) >= 3 else set())


def _sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(text, toxic) of at most ``max_rows`` labelled documents, chosen by a hash of the id; equal texts once."""
    one = (labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(one), "doc_id")  # 16 bytes a row are sent
    return cut(found.groupBy("text").agg(F.max("toxic").alias("toxic")))


def _counted(sample: DataFrame, features) -> DataFrame:
    """(feature, count of documents), each task adding up its own first."""

    def run(batches):
        seen: Counter[str] = Counter()
        for _, own in parts(batches, "text"):
            for t in own:
                seen.update(features(fold(t.decode("utf-8", "replace")).split()))
        for part in _blocks(seen.items()):
            yield pa.RecordBatch.from_pydict({"feature": [k for k, _ in part], "n": [n for _, n in part]})

    return sample.select("text").mapInArrow(run, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def _bound(toxic: float, clean: int, all_toxic: int, all_clean: int) -> float:
    """Lower confidence bound of the log ratio of the smoothed document shares."""
    ratio = math.log((toxic + 0.5) / (all_toxic + 1)) - math.log((clean + 0.5) / (all_clean + 1))
    return ratio - 1.64 * math.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))


def _choose(found: dict[str, list[int]], clean: dict[str, int], all_toxic: int, all_clean: int, least: int, most: int) -> dict[str, float]:
    """Entries in order of their bound, a document counting half as much with every entry that already
    matches it: words that only accompany an insult, as in groups of copies, are not chosen."""
    share: Counter[int] = Counter()
    value = lambda f: _bound(n, clean.get(f, 0), all_toxic, all_clean) if (n := sum(0.5 ** share[d] for d in found[f])) >= least else -1.0
    heap = [(-value(f), len(f), f) for f in found]
    heapq.heapify(heap)
    chosen: dict[str, float] = {}
    while heap and len(chosen) < most:
        _, size, f = heapq.heappop(heap)
        now = value(f)
        if now <= 1.0:
            continue
        if heap and -now > heap[0][0]:
            heapq.heappush(heap, (-now, size, f))
            continue
        if any(f.strip()[:n] in chosen for n in STEMS if n < len(f)):
            continue  # a chosen beginning matches there already
        chosen[f] = _bound(len(found[f]), clean.get(f, 0), all_toxic, all_clean)
        share.update(found[f])
    return chosen


def fit(docs: DataFrame, labels: DataFrame, *, max_rows: int = MAX_ROWS, max_entries: int = MAX_ENTRIES,
        exceptions: tuple[str, ...] = EXCEPTIONS) -> Model:
    """Lexicon, exceptions and curve from ``labels`` (doc_id, toxic) of ``docs`` (doc_id, text).

    A word beginning weighs the lower bound of the log ratio of its document shares under the two
    labels. A pair of neighbouring words in which an entry occurs becomes an exception where it is
    as frequent among clean documents as among toxic ones.
    """
    least = 3
    sample = _sample(docs, labels, max_rows)
    size = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    if not toxic or not clean:
        return Model(exceptions=tuple(exceptions))
    stems = lambda words: set().union(*map(_stems, words))

    def listed(batches):
        for batch, own in parts(batches, "text"):
            seen: dict[str, list[int]] = {}
            for t, d in zip(own, batch.column(1).to_pylist()):
                for f in stems(fold(t.decode("utf-8", "replace")).split()):
                    seen.setdefault(f, []).append(d)
            for part in _blocks(seen.items()):
                yield pa.RecordBatch.from_pydict({"feature": [k for k, _ in part], "docs": [v for _, v in part]})

    rows = (sample.where("toxic = 1").select("text", F.xxhash64("text").alias("d")).mapInArrow(listed, "feature string, docs array<long>")
            .groupBy("feature").agg(F.flatten(F.collect_list("docs")).alias("docs"))
            .where(F.size("docs") >= least).orderBy(F.size("docs").desc(), "feature").limit(10 * max_entries).collect())
    found = {r.feature: r.docs for r in rows}
    named = docs.sparkSession.sparkContext.broadcast(frozenset(found))
    rows = _counted(sample.where("toxic = 0"), lambda words: stems(words) & named.value).collect()  # one row an entry at most
    weights = _choose(found, {r.feature: r.n for r in rows}, toxic, clean, least, max_entries)
    model = Model(weights, tuple(exceptions))

    sent = docs.sparkSession.sparkContext.broadcast(model)

    def hit_pairs(words):
        global _MATCHER  # one automaton per worker process and model
        if _MATCHER is None or _MATCHER[0] is not sent.value:
            _MATCHER = (sent.value, Matcher(sent.value))
        hit = [_MATCHER[1].density(w)[1] > 0 for w in words]
        return {f"{words[i]} {words[i + 1]}" for i in range(len(words) - 1) if hit[i] or hit[i + 1]}

    both = [_counted(sample.where(F.col("toxic") == k), hit_pairs).withColumnRenamed("n", name) for k, name in ((0, "clean"), (1, "toxic"))]
    common = (both[0].where(F.col("clean") >= least).join(both[1], "feature", "left")
              .where(F.col("clean") / clean >= F.coalesce("toxic", F.lit(0)) / toxic))
    learned = [r.feature for r in common.orderBy(F.desc("clean"), "feature").limit(max_entries).collect()]
    model = Model(weights, (*exceptions, *learned))

    # The curve: Newton steps for a logistic of the density, over one histogram of the sample.
    bins = F.round(F.log1p("density") * 20).cast("int")
    sent2 = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        find = Matcher(sent2.value)
        return lambda batch: ([find.density(t.decode("utf-8", "replace"))[0] for t in batch],)

    hist = with_columns(sample, "text", [("density", "double")], start).groupBy(bins.alias("x"), "toxic").count().collect()
    x = np.array([r.x / 20 for r in hist])
    y = np.array([float(r.toxic) for r in hist])
    n = np.array([float(r["count"]) for r in hist])
    design = np.stack([x, np.ones_like(x)], 1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve((design * (n * p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(2), design.T @ (n * (y - p)) - 0.01 * beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return Model(weights, model.exceptions, float(max(beta[0], 0.0)), float(beta[1]))


_MATCHER: tuple[Model, Matcher] | None = None


def _blocks(items, size: int = 50_000):
    items = list(items)
    for i in range(0, len(items), size):
        yield items[i:i + size]
