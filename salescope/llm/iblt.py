"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in SQL functions only.

A text's paragraphs are hashed: its lines, long ones cut after sentences; what is still long is cut after
the words whose hash is 0 modulo ``WORD_CUT``, then after such characters (``SIGN_CUT``, text without
blanks), then at fixed lengths (repeated words). The places depend on the content, so what a version
keeps of a long line keeps its digests. The set of digests goes
into a sketch of three rows of cells, each digest into one cell of each row. A cell holds a count,
the digests and their check hashes, both folded by exclusive or. The cells of one version subtract
from another's, what both have cancels, and peeling recovers the rest: a cell with one digest left
(count one, digest and check agree) gives it away and it is taken out of its other cells, until all
cells are empty. If cells remain, the sketch was too small and a larger one is tried on the digests
that it did not give away.

The fingerprint is a sketch of fixed size, written out. Versions are compared by sketches sized to
them: digests are dealt by their hash into groups of about ``GROUP`` per pair of versions, each with
a sketch of its own, so the work grows with the number of paragraphs. A group that fails is tried
again with twice the cells; one that fails ``TRIES`` times is compared digest by digest.

The likeness of two texts is the share of their digests that both have: 1 - differing / all.

``successors`` puts the next row beside each row: rows are dealt into ranges of the id, found by
approximate quantiles, and each range gets a copy of the next one's first row, so no range has to
wait for another and no task sees all rows.

Defined results: null text is empty and has one empty paragraph; repeated paragraphs count once; null
ids come first, rows of equal id follow in order of their text's hash, the last row is followed by
the first, and a single row by itself. Extra columns pass through ``sketched``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GROUP = 6
CELLS = 4
FIXED = 6
TRIES = 6
ROUNDS = 6
RANGE_ROWS = 1000
MOST_RANGES = 10_000
LONG = 160
WORD_CUT = 8
SIGN_CUT = 32
SLICE = 100
ROWS = ("first", "second", "third")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body over a value that is computed once: the end of a fold over nothing. An element of a transformed array would
    be copied with all it holds at every level, and ``getItem`` would derive its type from all of the body for every value."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda s, _: s, body)


def paragraphs(text: Column) -> Column:
    """Lines, and the parts of those of more than ``LONG`` characters."""
    def long(pieces: Column, finer: Callable[[Column], Column]) -> Column:
        return F.flatten(F.transform(pieces, lambda x: F.when(F.char_length(x) <= LONG, F.array(x)).otherwise(finer(x))))

    def after(units: Column, n: int) -> Column:
        marked = F.transform(units, lambda u: F.concat(u, F.when(F.pmod(F.xxhash64(u), F.lit(n)) == 0, F.lit("\n")).otherwise(F.lit(""))))
        return F.filter(F.split(F.array_join(marked, ""), "\n"), lambda x: x != "")  # a line holds no line end

    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    sentences = long(lines, lambda x: F.split(x, "(?<=[.!?]) "))
    by_words = long(sentences, lambda x: after(F.split(x, "(?<= )"), WORD_CUT))
    by_signs = long(by_words, lambda x: after(F.split(x, ""), SIGN_CUT))
    return long(by_signs, lambda x: F.regexp_extract_all(x, F.lit(f"(?s).{{1,{SLICE}}}"), F.lit(0)))


def digests(text: Column) -> Column:
    """The set of paragraph digests of a text."""
    return F.array_distinct(F.transform(paragraphs(text), lambda p: F.xxhash64(p)))


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(11))


def _placed(values: Column, size: Column) -> Column:
    """Digests with their cell in each of the three rows of ``size`` cells, and their check hash."""
    def one(v: Column) -> Column:
        return _let(F.xxhash64(v, size), lambda h: F.struct(
            v.alias("v"), *(F.pmod(F.shiftright(h, 20 * j), size).cast("int").alias(ROWS[j]) for j in range(3)), _check(v).alias("h")))

    return F.transform(values, one)


def _cell(n: Column, v: Column, h: Column) -> Column:
    return F.struct(n.alias("n"), v.alias("v"), h.alias("h"))


def _zero() -> Column:
    return _cell(F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long"))


def _merged(x: Column, y: Column, n: Column) -> Column:
    """A cell with another, or a digest and its check hash, folded in; ``n`` is the new count."""
    return _cell(n, x["v"].bitwiseXOR(y["v"]), x["h"].bitwiseXOR(y["h"]))


def sketch(values: Column, size: Column) -> Column:
    """The cells of a set of digests: three rows of ``size`` cells."""
    def row(placed: Column, name: str) -> Column:
        return F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.aggregate(
            placed, _zero(), lambda c, p: F.when(p[name] == i, _merged(c, p, c["n"] + 1)).otherwise(c)))

    return _let(_placed(values, size), lambda placed: F.array(*(row(placed, name) for name in ROWS)))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda r, q: F.zip_with(r, q, lambda x, y: _cell(x["n"] - y["n"], x["v"].bitwiseXOR(y["v"]), x["h"].bitwiseXOR(y["h"]))))


def peel(cells: Column, size: Column) -> Column:
    """Struct of ``cells``, those that remain, and ``found``, the recovered digests with the side they are on (1 or -1).

    Every digest is in one cell of each row, so what a whole row folds to, less those found in a round, is a cell of all that
    are left: if it holds one, that is found as well, and if it is empty, so are all cells. Otherwise those found are taken
    out cell by cell. ``open`` ends the rounds."""
    def pure(c: Column) -> Column:
        return (F.abs(c["n"]) == 1) & (_check(c["v"]) == c["h"])

    def once(cs: Column, side: int) -> Column:
        """The digests of one side, as plain numbers: structs would be compared pair by pair."""
        own = F.array_distinct(F.transform(F.filter(cs, lambda c: c["n"] == side), lambda c: c["v"]))
        return F.transform(own, lambda v: _cell(F.lit(side), v, _check(v)))

    def taken(rows: Column, found: Column) -> Column:
        def row(placed: Column, j: int) -> Column:
            return F.transform(rows[j], lambda cell, i: F.aggregate(
                placed, cell, lambda c, p: F.when(p["at"][ROWS[j]] == i, _merged(c, p["at"], c["n"] - p["n"])).otherwise(c)))

        at = F.zip_with(_placed(found["v"], size), found["n"], lambda q, n: F.struct(q.alias("at"), n.alias("n")))
        return _let(at, lambda placed: F.array(*(row(placed, j) for j in range(3))))

    def step(s: Column) -> Column:
        def left(found: Column) -> Column:
            whole = F.aggregate(s["cells"][0], _zero(), lambda x, c: _merged(x, c, x["n"] + c["n"]))
            return F.aggregate(found, whole, lambda x, c: _merged(x, c, x["n"] - c["n"]))

        def after(found: Column, rest: Column) -> Column:
            last = F.when(pure(rest), F.array(rest)).otherwise(F.array().cast("array<struct<n:int,v:bigint,h:bigint>>"))
            end = pure(rest) | (rest == _zero())
            cells = F.when(end, F.array_repeat(F.array_repeat(_zero(), size), 3)).otherwise(taken(s["cells"], found))
            return F.struct(cells.alias("cells"), F.concat(s["found"], found, last).alias("found"), (~end & (F.size(found) > 0)).alias("open"))

        sure = _let(F.filter(F.flatten(s["cells"]), pure), lambda cs: F.concat(once(cs, 1), once(cs, -1)))
        return _let(sure, lambda found: _let(left(found), lambda rest: after(found, rest)))

    empty = F.array().cast("array<struct<n:int,v:bigint,h:bigint>>")
    start = F.struct(cells.alias("cells"), empty.alias("found"), F.lit(True).alias("open"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda s, _: F.when(s["open"], step(s)).otherwise(s))


def _differing_group(a: Column, b: Column) -> Column:
    """Number of digests that only one side has, by sketches; where one fails, larger ones of those it did not give away."""
    def attempt(s: Column, k: Column) -> Column:
        def after(p: Column) -> Column:
            clear = F.forall(F.flatten(p["cells"]), lambda c: c == _zero())
            of = lambda side: F.transform(F.filter(p["found"], lambda c: c["n"] == side), lambda c: c["v"])
            rest = lambda: _let(F.struct(F.array_except(s["a"], of(1)).alias("a"), F.array_except(s["b"], of(-1)).alias("b")), lambda r: F.struct(
                r["a"].alias("a"), r["b"].alias("b"), (s["n"] + F.size(s["a"]) - F.size(r["a"]) + F.size(s["b"]) - F.size(r["b"])).alias("n"), F.lit(True).alias("open")))
            return F.when(clear, F.struct(s["a"].alias("a"), s["b"].alias("b"), (s["n"] + F.size(p["found"])).alias("n"), F.lit(False).alias("open"))).otherwise(rest())

        return _let(F.lit(CELLS) * F.pow(F.lit(2), k).cast("int"), lambda size: _let(
            peel(subtract(sketch(s["a"], size), sketch(s["b"], size)), size), after))

    start = F.struct(a.alias("a"), b.alias("b"), F.lit(0).alias("n"), F.lit(True).alias("open"))
    tried = F.aggregate(F.sequence(F.lit(0), F.lit(TRIES - 1)), start, lambda s, k: F.when(s["open"], attempt(s, k)).otherwise(s))
    plain = lambda s: F.size(F.array_except(s["a"], s["b"])) + F.size(F.array_except(s["b"], s["a"]))
    return _let(tried, lambda s: s["n"] + F.when(s["open"], plain(s)).otherwise(F.lit(0)))


def _sides(groups: Column) -> Column:
    """Three numbers of parts, dealt one after the other, that make ``groups`` groups or few more."""
    first = F.ceil(F.cbrt(groups.cast("double")))
    both = _let(first, lambda x: F.array(x, F.ceil(F.sqrt(groups / x))))
    return _let(both, lambda x: F.array(x[0], x[1], F.ceil(groups / (x[0] * x[1]))))


def differing(a: Column, b: Column) -> Column:
    """Number of digests that only one of two sets has."""
    groups = F.ceil((F.size(a) + F.size(b)) / F.lit(float(GROUP)))

    def dealt(x: Column, sides: Column, step: int) -> Column:
        """Groups are dealt in three steps. A part that is the same on both sides needs no sketch: its cells would cancel."""
        side = sides[step]

        def part(values: Column, i: Column) -> Column:
            return F.filter(values, lambda v: F.pmod(F.shiftright(v, 20 * step), side) == i)

        def both(y: Column) -> Column:
            return F.when(y["a"] == y["b"], F.lit(0)).otherwise(dealt(y, sides, step + 1) if step < 2 else _differing_group(y["a"], y["b"]))

        counts = F.transform(F.sequence(F.lit(0).cast("long"), side - 1), lambda i: _let(F.struct(part(x["a"], i).alias("a"), part(x["b"], i).alias("b")), both))
        return F.aggregate(counts, F.lit(0), lambda s, n: s + n)

    many = _let(F.struct(a.alias("a"), b.alias("b")), lambda x: _let(_sides(groups), lambda sides: dealt(x, sides, 0)))
    return F.when(a == b, F.lit(0)).when(groups <= 1, _differing_group(a, b)).otherwise(many)


def likeness(a: Column, b: Column) -> Column:
    return F.lit(1.0) - differing(a, b) / (F.size(a) + F.size(b))


def fingerprint(values: Column) -> Column:
    """The sketch of fixed size as text: the number of digests, then count, digests and checks of every cell."""
    cells = sketch(values, F.lit(FIXED))
    return F.concat(F.lower(F.hex(F.size(values))), F.lit(":"), F.array_join(F.transform(F.flatten(cells), lambda c: F.lower(F.concat(
        F.hex(c["n"]), F.lit("-"), F.lpad(F.hex(c["v"]), 16, "0"), F.lpad(F.hex(c["h"]), 16, "0")))), "."))


def sketched(df: DataFrame, *, text: str = "text", out: str = "fingerprint") -> DataFrame:
    return df.withColumn(out, fingerprint(digests(F.col(text))))


def successors(docs: DataFrame, *, rows: int = RANGE_ROWS, digested: bool = False) -> DataFrame:
    """(doc_id, text, next_text) for every row of ``docs`` (doc_id, text): the text of the row that follows by doc_id;
    with ``digested`` also ``own`` and ``next``, the digests of both texts, made once for each text."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("h", F.xxhash64("text"))
    known = docs.agg(F.count(F.lit(1)).alias("n")).first().n
    ranges = max(1, min(MOST_RANGES, known // rows))
    cuts = []
    if ranges > 1:
        shares = [i / ranges for i in range(1, ranges)]
        cuts = sorted(set(docs.agg(F.percentile_approx("doc_id", shares, 10 * ranges).alias("q")).first().q or []))
    place = F.lit(0)
    if cuts:
        # The number of cuts at or below the id, found in steps of the square root of their number.
        width = max(1, int(len(cuts) ** 0.5))
        coarse, all_cuts = F.lit(cuts[::width]), F.lit(cuts)
        below = lambda cs: F.size(F.filter(cs, lambda c: c <= F.col("doc_id")))
        place = F.when(F.col("doc_id").isNull(), 0).otherwise(_let(below(coarse), lambda k: F.when(k == 0, 0).otherwise(
            (k - 1) * width + below(F.slice(all_cuts, (k - 1) * width + 1, F.lit(width))))))
    dealt = docs.withColumn("range", place.cast("int"))
    order = F.struct(F.col("doc_id").isNotNull().alias("has_id"), "doc_id", "h")
    heads = dealt.groupBy("range").agg(F.min(order).alias("head"))  # a row for each range
    heads = heads.withColumn("before", F.lag("range").over(Window.partitionBy(F.lit(0)).orderBy("range")))
    last = heads.agg(F.max("range").alias("last"))
    heads = heads.crossJoin(F.broadcast(last)).select(F.coalesce("before", "last").alias("before"), F.col("head.doc_id").alias("doc_id"), F.col("head.h").alias("h"))
    first = dealt.select("doc_id", "h", "text").join(F.broadcast(heads.withColumnRenamed("doc_id", "head_id").withColumnRenamed("h", "head_h")),
                                                     F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("h") == F.col("head_h")))
    copies = first.select("doc_id", "text", "h", F.col("before").alias("range"), F.lit(True).alias("copy")).dropDuplicates(["range"])
    both = dealt.select("doc_id", "text", "h", "range", F.lit(False).alias("copy")).unionByName(copies)
    carried = {"text": "next_text"} | ({"own": "next"} if digested else {})
    if digested:
        both = both.withColumn("own", digests(F.col("text")))
    near = Window.partitionBy("range").orderBy("copy", F.col("doc_id").isNotNull(), "doc_id", "h")
    both = both.select("*", *(F.lead(name).over(near).alias(after) for name, after in carried.items()))
    return both.where(~F.col("copy")).select("doc_id", *carried, *carried.values())
