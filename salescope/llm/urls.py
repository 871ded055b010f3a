"""URL filter: rules for hosts and paths, and for the rest a logistic regression on hashed character n-grams.

``fit`` learns from a table of labelled URLs: host and path are cut into all runs of three to five characters (host and
path marked apart, with a sign at both ends, all digits read as 0), the runs are hashed into 2^16 counters, and a logistic regression with a
squared penalty is fitted on their presence. ``judge`` gives each URL its host and path, the rule that decides it, the
probability that it is to be blocked, and the verdict.

Host: behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: from there up to ``?``, ``#``
or the end. A rule (host, path, verdict) fits its host and all hosts below it, where the URL's path starts with the
rule's; the longest rule (host and path together) wins, of equally long ones that with the longer host, then "block".
Where no rule fits, the verdict is "block" from a probability of ``threshold`` on.

Rules are written into the expression, so ``MOST_RULES`` bounds their number; more raise an error. Training reads the
whole labelled table through Spark; its model is one vector of 2^16 weights, whatever the size of the table.

Defined results: null URLs and those without ``://`` have an empty host and path; the model judges these as it does
others (no rule fits an empty host or path). Equal rows give equal rows. Other columns pass through; columns named
like a new one are replaced. An empty table of URLs gives no rows; labelled URLs of a single class, or none, raise an
error, as nothing can be learned from them. Long URLs are read whole, in time linear in their length.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1 << 16
SIZES = (3, 4, 5)
PENALTY = 0.001
THRESHOLD = 0.5
MOST_RULES = 200


@dataclass(frozen=True)
class Rule:
    verdict: str  # "allow" or "block"
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def _behind(url: Column) -> Column:
    """What follows the first ``://`` up to ``?``, ``#`` or the end; empty without one."""
    whole = F.coalesce(url, F.lit(""))
    return F.regexp_extract(whole, r"(?s)^.*?://([^?#]*)", 1)


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_behind(url), r"(?s)^([^/]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(_behind(url), r"(?s)^[^/]*(.*)$", 1)


def _grams(text: Column, mark: str) -> Column:
    """All runs of SIZES characters of a text between two signs, marked with where it stands."""
    # Character by character, so that each run is put together from its own few characters in a long text too.
    chars = F.split(F.concat(F.lit("\x02"), F.translate(text, "123456789", "000000000"), F.lit("\x03")), "")

    def of(size: int) -> Column:
        shifted = [F.slice(chars, F.lit(k + 1), F.greatest(F.size(chars) - (size - 1), F.lit(0))) for k in range(size)]
        return F.transform(F.arrays_zip(*(s.alias(f"c{k}") for k, s in enumerate(shifted))),
                           lambda z: F.concat(F.lit(mark), *(z[f"c{k}"] for k in range(size))))

    return F.concat(*(of(size) for size in SIZES))


def _features(df: DataFrame) -> DataFrame:
    """``df`` (with _host and _path) and its hashed n-grams as a vector."""
    grams = df.withColumn("_grams", F.concat(_grams(F.col("_host"), "h"), _grams(F.col("_path"), "p")))
    return HashingTF(numFeatures=DIMENSIONS, binary=True, inputCol="_grams", outputCol="_features").transform(grams).drop("_grams")


def fit(labelled: DataFrame, url: str = "url", blocked: str = "blocked") -> LogisticRegressionModel:
    """Model of the URLs to be blocked, from rows with a URL and 0 or 1; rows with a null in either are left out."""
    rows = labelled.select(F.col(url).alias("_url"), F.col(blocked).cast("double").alias("_label")).dropna()
    rows = rows.select(host(F.col("_url")).alias("_host"), path(F.col("_url")).alias("_path"), "_label")
    if rows.select("_label").distinct().count() != 2:
        raise ValueError("labelled URLs of both classes are needed")
    learner = LogisticRegression(featuresCol="_features", labelCol="_label", predictionCol="_predicted", probabilityCol="_probability",
                                 rawPredictionCol="_raw", regParam=PENALTY, elasticNetParam=0.0, standardization=False, maxIter=100, tol=1e-8)
    return learner.fit(_features(rows))


def matching(rules: Sequence[Rule], host_: Column, path_: Column) -> Column:
    """The deciding rule as a struct (name, verdict), null where none fits."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES} are taken")
    best = sorted(rules, key=lambda r: (-len(r.name), -len(r.host), r.verdict != "block", r.name))
    made = [F.when(((host_ == r.host) | F.endswith(host_, F.lit("." + r.host))) & F.startswith(path_, F.lit(r.path)),
                   F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))) for r in best]
    return F.coalesce(*made) if made else F.lit(None).cast("struct<name:string,verdict:string>")


def judge(urls: DataFrame, model: LogisticRegressionModel, rules: Sequence[Rule] = (), url: str = "url", threshold: float = THRESHOLD) -> DataFrame:
    """``urls`` with ``host``, ``path``, ``rule``, ``block_probability`` and ``verdict``."""
    new = ("host", "path", "rule", "block_probability", "verdict")
    if url.lower() in new:
        raise ValueError(f"the URL column {url!r} cannot be replaced")
    rows = urls.select(F.struct(*(F.col(f"`{c}`") for c in urls.columns if c.lower() not in new)).alias("_row"))
    rows = rows.select("_row", host(F.col("_row")[url]).alias("_host"), path(F.col("_row")[url]).alias("_path"))
    scored = model.transform(_features(rows)).withColumn("_p", vector_to_array("_probability")[1])
    rule = matching(rules, F.col("_host"), F.col("_path"))
    scored = scored.withColumn("_rule", rule)
    own = F.when(F.col("_p") >= threshold, "block").otherwise("allow")
    return scored.select("_row.*", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule.name").alias("rule"),
                         F.col("_p").alias("block_probability"), F.coalesce("_rule.verdict", own).alias("verdict"))
