"""Hand-labelled pairs: confidences, bad tuples, scores over a grid of parameters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions import text as T

from .measures import valid
from .pairs import KEY
from .ranking import area, precision_recall

AGGREGATES = ("avg-below", "median", "min", "max", "average", "max+average")


def aggregate(kind: str, prefix: str = "", below: float = 1.0) -> Column:
    """A tuple's confidence by an aggregate; 0 for relations of communication, -1 for an unknown aggregate."""
    c = lambda name: F.col(prefix + name)
    value = {
        "max+average": c("most") + c("mean"), "median": c("median"), "min": c("least"), "max": c("most"), "average": c("mean"),
        "avg-below": F.when(c("mean") < below, 0.0).otherwise(c("mean")),
    }.get(kind, F.lit(-1.0))
    return F.when(T.has_word(c("rel"), T.COMMUNICATION), 0.0).otherwise(value)


def bad_tuple(names: str, arg1: Column, rel: Column, arg2: Column) -> Column:
    """Whether any of the comma-separated finders hits: pronouns, numbers, stoprels; unknown names find nothing."""
    stop = [*T.PREPOSITIONS, *(f"be {p}" for p in T.PREPOSITIONS)]
    finders = {
        "pronouns": arg1.isin(*T.PRONOUNS) | arg2.isin(*T.PRONOUNS),
        "numbers": T.has_number(arg1) | T.has_number(arg2),
        "stoprels": rel.isin(*stop) | T.has_word(rel, T.COMMUNICATION) | T.special(rel, " "),
    }
    return reduce(lambda a, b: a | b, [finders[n] for n in names.split(",") if n in finders], F.lit(False))


def with_confidences(pairs: DataFrame, confidences: DataFrame) -> DataFrame:
    """Pairs with c1_* and c2_*, the confidences of both tuples, looked up whatever the case and blanks around; pairs of an
    unknown tuple drop. confidences: arg1, rel, arg2, median, least, most, mean, one row a tuple."""
    norm = lambda c: F.lower(F.trim(F.col(c)))
    out = pairs
    for p, (a, r, b) in (("c1_", KEY[:3]), ("c2_", KEY[3:])):
        side = confidences.select(norm("arg1").alias("k1"), norm("rel").alias("k2"), norm("arg2").alias("k3"), *[F.col(c).alias(p + c) for c in ("rel", "median", "least", "most", "mean")])
        out = out.join(side, (norm(a) == F.col("k1")) & (norm(r) == F.col("k2")) & (norm(b) == F.col("k3"))).drop("k1", "k2", "k3")
    return out


def with_counts_of(tagged: DataFrame, combined: DataFrame, bad: str = "") -> DataFrame:
    """Tagged pairs with their counts; those without a valid pair, or with a bad second tuple, drop."""
    known = combined.where(valid() & ~bad_tuple(bad, F.col("s1"), F.col("sr"), F.col("s2")))
    return tagged.join(known, KEY)


def best_partners(combined: DataFrame, query: dict[str, str], k: int, bad: str = "") -> DataFrame:
    """The k best valid pairs whose first tuple is exactly the asked one."""
    hit = reduce(lambda a, b: a & b, [F.lower(F.trim(F.col(c))) == query[c].strip().lower() for c in KEY[:3]])
    return combined.where(hit & valid() & ~bad_tuple(bad, F.col("s1"), F.col("sr"), F.col("s2"))).orderBy(F.desc(F.round("und_first", 9)), *KEY[3:]).limit(k)


def scores(counted: DataFrame, kind: str, deltas: list[float], alphas: list[float], keep: list[str]) -> DataFrame:
    """keep, delta, alpha, score: cp, scp or pmi of every pair under every smoothing and decay.

    Smoothing is constant over a pair's windows, so one aggregation serves the whole grid: sums of the decayed counts
    (or squares, or logs) for each alpha, divided afterwards. counted: keep, window, und, nf, ns."""
    u, n = F.col("und").cast("double"), F.count("*")
    value = {"cp": u, "scp": u * u}.get(kind)
    w = lambda a: F.pow(F.lit(a), F.col("window"))
    if kind == "pmi":  # ln(u / n) = ln u - ln n; a count of zero makes it minus infinity
        sums = [F.when(F.min("und") <= 0, F.lit(float("-inf"))).otherwise(F.sum(F.when(u > 0, F.ln(u)) * w(a)) / F.sum(w(a))) for a in alphas]
    else:
        sums = [F.sum(value * w(a)) / F.sum(w(a)) for a in alphas]
    each = F.array(*[F.struct(F.lit(float(a)).alias("alpha"), s.alias("s")) for a, s in zip(alphas, sums, strict=True)])
    grid = counted.groupBy(*keep).agg(F.max("nf").alias("nf"), F.max("ns").alias("ns"), n.alias("n_"), each.alias("each"))
    grid = grid.withColumn("a_", F.explode("each")).withColumn("delta", F.explode(F.array(*[F.lit(float(d)) for d in deltas])))
    f, s, d, total = F.col("nf"), F.col("ns"), F.col("delta"), F.col("a_.s")
    positive = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    score = {"cp": positive(total, f + d), "scp": positive(total, (f + d) * (s + d)), "pmi": total - F.ln(f + s + 2 * d)}[kind]
    return grid.select(*keep, "delta", F.col("a_.alpha").alias("alpha"), score.alias("score"))


def grid_search(counted: DataFrame, confidences: DataFrame, kind: str, deltas: list[float], alphas: list[float], aggs: list[str], thresholds: list[float]) -> DataFrame:
    """delta, alpha, agg, threshold, auc. A pair scores 0 where a confidence is below the threshold; the rows of agg
    "none" do without. counted: pair, window, und, nf, ns, label, item (breaks ties)."""
    keep = [*KEY, "item", "label"]
    s = with_confidences(scores(counted, kind, deltas, alphas, keep), confidences)
    cells = [F.struct(F.lit("none").alias("agg"), F.lit(0.0).alias("threshold"), F.lit(True).alias("pass"))]
    for a in aggs:
        low = F.least(aggregate(a, "c1_"), aggregate(a, "c2_"))
        cells += [F.struct(F.lit(a).alias("agg"), F.lit(float(t)).alias("threshold"), (low >= t).alias("pass")) for t in thresholds]
    rows = s.withColumn("x", F.explode(F.array(*cells))).select("item", "label", "delta", "alpha", "x.agg", "x.threshold", F.when(F.col("x.pass"), F.round("score", 9)).otherwise(0.0).alias("score"))
    group = ["delta", "alpha", "agg", "threshold"]
    return area(precision_recall(rows, group), group)


def weighted(score: str, f: float = 0.0, s: float = 0.0, r: float = 1.0, agg: str = "average") -> Column:
    """The score and both confidences, weighted."""
    return f * aggregate(agg, "c1_") + s * aggregate(agg, "c2_") + r * F.col(score)
