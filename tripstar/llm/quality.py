"""Quality classifier: a sparse rule ensemble over text statistics, compiled into Spark column expressions.

1. Statistics of a text (shares of capitals, symbols, digits, marks, distinct words and lines, lengths) are
   built-in column expressions over the whole text.
2. A small forest is fitted on labelled rows; every path from a root to a node is a rule, a conjunction of
   intervals of statistics.
3. A lasso logistic regression over the rules (0/1) gives most of them the weight 0.
4. The others become one column: logistic(intercept + sum of weights of the rules that hold). Scoring is a plain
   projection: no join, no shuffle, no Python, and only the statistics that surviving rules use are computed.

Fitting uses a bounded sample of the labelled rows, at most :data:`MAX_LABELLED`, the first by a hash of doc_id
(all of them while there are fewer); rows with crc32(doc_id as text) mod 5 = 0 are never used. Scores depend on
the text alone: labels, lang, source and doc_id are no inputs.

Null text: empty. Null doc_id: not held out, never learnt from. Repeated or contradicting labels: their mean, at
least 0.5 is label 1; null labels don't count. Without labels of both kinds every score is the smoothed share of
label 1, (ones + 1) / (labels + 2).
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripstar.llm.base import written

#: Bound of the labelled sample; forest and lasso settings; a score from here on predicts label 1 (contract).
MAX_LABELLED = 12_000
TREES, DEPTH, SEED, LASSO = 24, 3, 42, 0.001
CUT = 0.3
_PRE = "__q_"


def statistics(text: Column) -> dict[str, Column]:
    """Name → expression of each statistic of a text."""
    def only(pattern: str) -> Column:   # characters left when all others are removed
        return F.length(F.regexp_replace(text, F.lit(pattern), F.lit(""))).cast("double")

    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    n_words = F.greatest(F.size(words), F.lit(1)).cast("double")
    lines = F.split(text, "\n")
    n_lines = F.greatest(F.size(lines), F.lit(1)).cast("double")
    return {
        "log_words": F.log1p(F.size(words).cast("double")),
        "chars_per_word": n / n_words,
        "capitals": only(r"[^\p{Lu}]+") / n,
        "digits": only(r"[^0-9]+") / n,
        "symbols": only(r"[^#$%&*|<>=@^~_+/\\{}\[\]]+") / n,
        "cries": only(r"[^!?]+") / n_words,
        "stops": only(r"[^.,;:]+") / n_words,
        "distinct_words": F.size(F.array_distinct(words)).cast("double") / n_words,
        "chars_per_line": n / n_lines,
        "distinct_lines": F.size(F.array_distinct(lines)).cast("double") / n_lines,
    }


#: The statistics in the order that rules number them.
NAMES = [
    "log_words", "chars_per_word", "capitals", "digits", "symbols", "cries", "stops", "distinct_words",
    "chars_per_line", "distinct_lines"]


@dataclass(frozen=True)
class Rule:
    """A conjunction of ``low < statistic <= high``."""

    bounds: tuple[tuple[int, float, float], ...]   # (statistic, low, high)

    def column(self) -> Column:
        out = None
        for i, low, high in self.bounds:
            c = F.col(_PRE + NAMES[i])
            for test in ([c > low] if low > -math.inf else []) + ([c <= high] if high < math.inf else []):
                out = test if out is None else out & test
        return out


@dataclass
class Ensemble:
    """Intercept and weighted rules; ``expression`` is the score as a column over the statistics."""

    intercept: float
    rules: list[tuple[Rule, float]]

    def expression(self) -> Column:
        z = F.lit(float(self.intercept))
        for rule, weight in self.rules:
            z = z + F.when(rule.column(), F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

    def used(self) -> set[str]:
        return {NAMES[i] for rule, _ in self.rules for i, _, _ in rule.bounds}


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def paths(tree: str) -> list[Rule]:
    """The rules of one tree, from its printed form: the path to every node but the root."""
    found, stack = [], []   # stack: (indent, statistic, low, high)
    for line in tree.splitlines():
        m = re.match(r"( *)(If|Else) \(feature (\d+) (<=|>) ([-+.\dEe]+)\)", line)
        if not m:
            continue
        indent, i, at = len(m[1]), int(m[3]), float(m[5])
        stack = [s for s in stack if s[0] < indent]
        stack.append((indent, i, *((-math.inf, at) if m[4] == "<=" else (at, math.inf))))
        bounds: dict[int, tuple[float, float]] = {}
        for _, k, low, high in stack:
            a, b = bounds.get(k, (-math.inf, math.inf))
            bounds[k] = (max(a, low), min(b, high))
        found.append(Rule(tuple((k, *bounds[k]) for k in sorted(bounds))))
    return found


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """label and the statistics of the documents learnt from."""
    own = (labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id")))
           .groupBy(F.col("doc_id").cast("long").alias("_id"))
           .agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
           .orderBy(F.xxhash64("_id"), "_id").limit(limit))
    own = written(own, "labels")     # at most ``limit`` rows
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce("text", F.lit("")).alias("_text"))
    rows = rows.join(F.broadcast(own), "_id")
    stats = rows.select("_id", "label", *[c.alias(_PRE + n) for n, c in statistics(F.col("_text")).items()])
    # the same rows in the same partitions whatever the input's layout: the same forest
    return written(stats, "statistics").repartition(8, "_id").sortWithinPartitions("_id", "label")


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> Ensemble:
    sample = written(labelled_sample(docs, labels, limit), "sample")
    n, ones = sample.agg(F.count("*"), F.sum("label")).first()
    ones = ones or 0.0
    if ones in (0.0, float(n)):
        p = (ones + 1) / (n + 2)
        return Ensemble(math.log(p / (1 - p)), [])
    ready = VectorAssembler(inputCols=[_PRE + x for x in NAMES], outputCol="features").transform(sample).select(
        "label", "features", *[_PRE + x for x in NAMES])
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, maxBins=64,
                                    featureSubsetStrategy="onethird", minInstancesPerNode=5).fit(ready)
    rules = list(dict.fromkeys(r for t in forest.trees for r in paths(t.toDebugString)))
    if not rules:
        p = (ones + 1) / (n + 2)
        return Ensemble(math.log(p / (1 - p)), [])
    table = sample.select("label", F.array(*[r.column().cast("double") for r in rules]).alias("r"))
    from pyspark.ml.functions import array_to_vector
    model = LogisticRegression(regParam=LASSO, elasticNetParam=1.0, maxIter=60, standardization=False).fit(
        table.select("label", array_to_vector("r").alias("features")))
    weights = model.coefficients.toArray().tolist()
    return Ensemble(float(model.intercept), [(r, w) for r, w in zip(rules, weights) if abs(w) > 1e-9])


def with_score(docs: DataFrame, model: Ensemble, score: str = "__quality_score") -> DataFrame:
    """All columns of docs and the score."""
    if not model.rules:
        return docs.withColumn(score, F.lit(1 / (1 + math.exp(-model.intercept))))
    stats = statistics(F.coalesce(F.col("text"), F.lit("")))
    used = [n for n in NAMES if n in model.used()]
    out = docs.select("*", *[stats[n].alias(_PRE + n) for n in used])
    return out.withColumn(score, model.expression()).drop(*[_PRE + n for n in used])


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents (all columns) that the classifier doesn't reject."""
    out = with_score(docs, fit(docs, labels))
    return out.filter(F.col("__quality_score") >= CUT).drop("__quality_score")
