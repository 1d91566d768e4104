"""From directed counts to association measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pairs import KEY

FLIP = dict(zip(KEY, KEY[3:] + KEY[:3], strict=True))


def cumulative(directed: DataFrame, first: int, last: int, beyond: bool = False) -> DataFrame:
    """Pair, window in first..last, cnt of all windows up to it (those from `first` on); with `beyond`, counts of later
    windows stay as they are.

    A pair's counts meet in one array of at most last + 1 places; no self-join."""
    wide = directed.groupBy(*KEY).agg(*[F.sum(F.when(F.col("window") == w, F.col("cnt")).otherwise(0)).alias(f"w{w}") for w in range(first, last + 1)])
    places = F.array(*[F.struct(F.lit(w).cast("bigint").alias("window"), sum((F.col(f"w{x}") for x in range(first, w + 1)), F.lit(0)).alias("cnt")) for w in range(first, last + 1)])
    rows = wide.select(*KEY, F.explode(places).alias("e")).select(*KEY, "e.window", "e.cnt")
    return rows.unionByName(directed.where(F.col("window") > last).select(*KEY, "window", "cnt")) if beyond else rows


def frequency_filter(directed: DataFrame, window: int = 10, least: int = 3) -> DataFrame:
    """Pairs of alphanumeric fields whose largest cumulative count over 0..window-1 is above `least`."""
    clean = directed
    for c in KEY:
        clean = clean.where(F.col(c).rlike("^[a-zA-Z0-9]+.*"))
    top = F.sum(F.when(F.col("window") < window, F.col("cnt")).otherwise(0))
    raw = F.max(F.when(F.col("window") >= window, F.col("cnt")).otherwise(0))
    return clean.groupBy(*KEY).agg(F.greatest(top, raw).alias("top")).where(F.col("top") > least)


def frequent(directed: DataFrame, window: int, least: int, inclusive: bool = False) -> DataFrame:
    """The cumulated counts (windows below `window`, later ones as they are) of pairs of alphanumeric fields whose largest
    one is above `least`, or reaches it."""
    clean = directed
    for c in KEY:
        clean = clean.where(F.col(c).rlike("^[a-zA-Z0-9]+.*"))
    rows = cumulative(clean, 0, window - 1, True)
    top = rows.groupBy(*KEY).agg(F.max("cnt").alias("top")).where(F.col("top") >= least if inclusive else F.col("top") > least)
    return rows.join(top.select(*KEY), KEY, "left_semi")


def undirected(cumulated: DataFrame, least: int = 1) -> DataFrame:
    """Pair, window, dir, und: counts of the pair and of both orders; missing orders are made up.

    A pair of a tuple with itself keeps its directed count, once."""
    flipped = cumulated.select(*[F.col(FLIP[c]).alias(c) for c in KEY], "window", F.lit(0).cast("bigint").alias("dir"), F.col("cnt").alias("rev"))
    straight = cumulated.select(*KEY, "window", F.col("cnt").alias("dir"), F.lit(0).cast("bigint").alias("rev"))
    own = (F.col("f1") == F.col("s1")) & (F.col("fr") == F.col("sr")) & (F.col("f2") == F.col("s2"))
    both = straight.unionByName(flipped).groupBy(*KEY, "window").agg(F.sum("dir").alias("dir"), F.sum("rev").alias("rev"))
    both = both.select(*KEY, "window", "dir", F.when(own, F.col("dir")).otherwise(F.col("dir") + F.col("rev")).alias("und"))
    return both if least <= 1 else both.join(both.groupBy(*KEY).agg(F.max("und").alias("m")).where(F.col("m") >= least).select(*KEY), KEY, "left_semi")


def wide(directed: DataFrame, last: int) -> DataFrame:
    """Pair, dir, und: arrays of the cumulative counts over windows 1..last of the pair, and of both its orders.

    One aggregation of the directed counts and their mirror images: a pair travels as one row through everything that
    follows, and its windows are exploded (see `windows`) only where they are asked for. A pair of a tuple with itself
    keeps its directed counts."""
    mirrored = directed.select(*[F.col(FLIP[c]).alias(c) for c in KEY], "window", F.lit(0).cast("bigint").alias("dir"), F.col("cnt").alias("rev"))
    both = directed.select(*KEY, "window", F.col("cnt").alias("dir"), F.lit(0).cast("bigint").alias("rev")).unionByName(mirrored)
    up_to = lambda c: F.array(*[F.coalesce(F.sum(F.when((F.col("window") >= 1) & (F.col("window") <= w), F.col(c))), F.lit(0)).cast("bigint") for w in range(1, last + 1)])
    own = (F.col("f1") == F.col("s1")) & (F.col("fr") == F.col("sr")) & (F.col("f2") == F.col("s2"))
    counts = both.groupBy(*KEY).agg(up_to("dir").alias("dir"), up_to("rev").alias("rev"))
    return counts.select(*KEY, "dir", F.when(own, F.col("dir")).otherwise(F.zip_with("dir", "rev", lambda x, y: x + y)).alias("und"))


def windows(pairs: DataFrame) -> DataFrame:
    """One row for each window of wide pairs: window, dir, und, and the other columns."""
    rest = [c for c in pairs.columns if c not in ("dir", "und")]
    each = pairs.select(*rest, F.posexplode(F.arrays_zip("dir", "und")).alias("at_", "e_"))
    keys = [c for c in rest if c in KEY]
    return each.select(*keys, (F.col("at_") + 1).cast("bigint").alias("window"), "e_.dir", "e_.und", *[c for c in rest if c not in KEY])


def combined_wide(counted: DataFrame, delta: float = 10.0, alpha: float = 0.9, k: int | None = None) -> DataFrame:
    """What `combined` gives of the measures, from wide pairs with nf and ns: smoothing is constant over a pair's windows,
    so the decayed sums are taken of counts and squares, and divided once."""
    size = F.size("und")
    weights = F.transform(F.sequence(F.lit(1), size), lambda w: F.pow(F.lit(alpha), w))
    total = F.aggregate("w_", F.lit(0.0), lambda a, x: a + x)
    decay = lambda c, square=False: F.aggregate(F.zip_with(c, "w_", lambda x, w: (x * x if square else x) * w), F.lit(0.0), lambda a, x: a + x) / total
    rows = counted.withColumn("w_", weights)
    over = lambda value, n: F.when(n + delta > 0, value / (n + F.lit(delta))).otherwise(0.0)
    f, s = F.col("nf").cast("double"), F.col("ns").cast("double")
    at_k = F.array_max("und") if k is None else F.coalesce(F.get("und", F.lit(k - 1)), F.lit(0).cast("bigint"))
    return rows.select(
        *KEY, over(decay("dir"), f).alias("dir_first"), over(decay("dir"), s).alias("dir_second"), over(decay("und"), f).alias("und_first"), over(decay("und"), s).alias("und_second"),
        over(over(decay("und", True), f), s).alias("scp"), "nf", "ns", F.array_max("dir").alias("max_dir"), F.array_max("und").alias("max_und"), at_k.alias("und_k"),
    )


def stop_relations(tuples: DataFrame) -> DataFrame:
    return tuples.where(~F.col("rel").isin("be", "in", "to", "on"))


def not_reporting(tuples: DataFrame) -> DataFrame:
    """Without relations that start with say or tell."""
    return tuples.where(~F.col("rel").startswith("say") & ~F.col("rel").startswith("tell"))


def with_first_counts(pairs: DataFrame, tuples: DataFrame) -> DataFrame:
    """nf of the first tuple alone, of which one row counts where a tuple has several: its smallest count."""
    one = tuples.groupBy(F.col("a1").alias("f1"), F.col("rel").alias("fr"), F.col("a2").alias("f2")).agg(F.min("n").alias("nf"))
    return pairs.join(one, ["f1", "fr", "f2"], "left").fillna(0, ["nf"])


def legacy_lines(directed: DataFrame, last: int, least: int) -> DataFrame:
    """Pairs with their cumulative counts over windows 1..last as text, if the largest is `least` or more."""
    each = F.array(*[F.coalesce(F.sum(F.when((F.col("window") >= 1) & (F.col("window") <= w), F.col("cnt"))), F.lit(0)) for w in range(1, last + 1)])
    rows = directed.groupBy(*KEY).agg(each.alias("c"))
    return rows.where(F.array_max("c") >= least).select(*KEY, F.array_join(F.col("c").cast("array<string>"), ",").alias("counts"))


def with_counts(pairs: DataFrame, tuples: DataFrame, most: int | None = None) -> DataFrame:
    """nf, ns: counts of both tuples, 0 where a tuple is unknown. Two equi-joins;
    whether one is broadcast is up to the planner, by measured size."""
    t = tuples if most is None else tuples.where(F.col("n") < most)
    f = t.select(F.col("a1").alias("f1"), F.col("rel").alias("fr"), F.col("a2").alias("f2"), F.col("n").alias("nf"))
    s = t.select(F.col("a1").alias("s1"), F.col("rel").alias("sr"), F.col("a2").alias("s2"), F.col("n").alias("ns"))
    return pairs.join(f, ["f1", "fr", "f2"], "left").join(s, ["s1", "sr", "s2"], "left").fillna(0, ["nf", "ns"])


def conditional(c: Column, n: Column, delta: float) -> Column:
    return F.when(n + delta > 0, c / (n + F.lit(delta))).otherwise(0.0)


def decayed(value: Column, alpha: float) -> Column:
    """Weighted average over windows 1, 2, ...: sum of alpha ** k * v over sum of alpha ** k (an aggregate)."""
    w = F.pow(F.lit(alpha), F.col("window"))
    return F.sum(value * w) / F.sum(w)


def measures(counted: DataFrame, delta: float = 10.0) -> DataFrame:
    """Per pair and window: four conditionals, scp, pmi and its unsmoothed form."""
    d, u, f, s = (F.col(c).cast("double") for c in ("dir", "und", "nf", "ns"))
    log = lambda x: F.when(x > 0, F.ln(x))  # noqa: E731  null stands for minus infinity
    return counted.select(
        *KEY, "window", "dir", "und", "nf", "ns",
        conditional(d, f, delta).alias("dir_first"), conditional(d, s, delta).alias("dir_second"),
        conditional(u, f, delta).alias("und_first"), conditional(u, s, delta).alias("und_second"),
        (conditional(u, f, delta) * conditional(u, s, delta)).alias("scp"),
        log(u / (f + s + 2 * delta)).alias("pmi"), log(F.when(f + s > 0, u / (f + s))).alias("pmi_raw"),
    )


def combined(m: DataFrame, alpha: float = 0.9, k: int | None = None) -> DataFrame:
    """Per pair: the decayed averages, the counts, the largest window counts, and und_k, the undirected count at
    window k (the largest if k is None)."""
    names = ("dir_first", "dir_second", "und_first", "und_second", "scp")
    at_k = F.max("und") if k is None else F.coalesce(F.max(F.when(F.col("window") == k, F.col("und"))), F.lit(0).cast("bigint"))
    return m.groupBy(*KEY).agg(
        *[decayed(F.col(c), alpha).alias(c) for c in names],
        F.max("nf").alias("nf"), F.max("ns").alias("ns"), F.max("dir").alias("max_dir"), F.max("und").alias("max_und"), at_k.alias("und_k"),
    )


def named(c: DataFrame) -> DataFrame:
    """One row for each named conditional."""
    entries = [("dir.first.conditional", "dir_first"), ("dir.second.conditional", "dir_second"), ("undir.first.conditional", "und_first"), ("undir.second.conditional", "und_second")]
    return c.select(*KEY, F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(v).alias("value")) for n, v in entries])).alias("e")).select(*KEY, "e.name", "e.value")


def valid() -> Column:
    """No count of a pair above the counts of its tuples."""
    return (F.col("max_und") <= F.col("nf")) & (F.col("max_und") <= F.col("ns")) & (F.col("max_dir") <= F.col("nf")) & (F.col("max_dir") <= F.col("ns"))
