"""Top tuples, bins and samples, search, neighbourhoods, evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions import text as T
from pairloom.session import stored

from .measures import valid
from .pairs import KEY
from .records import gapless

FIRST, SECOND = KEY[:3], KEY[3:]


def valid_tuple(arg1: str, rel: str, arg2: str) -> Column:
    """No pronoun arguments, as they are written, and a relation of letters, digits and colons alone (so of one word)."""
    return ~F.col(arg1).isin(*T.PRONOUNS) & ~F.col(arg2).isin(*T.PRONOUNS) & ~T.special(F.col(rel))


def exportable(least: int, count: str, *args: str) -> Column:
    """The filter of releases: counted often enough, and arguments of letters, digits and colons alone."""
    return reduce(lambda x, y: x & y, [~T.special(F.col(a)) for a in args], F.col(count) >= least)


def top_tuples(c: DataFrame, k: int, least_pairs: int = 1, more_than: int = 0, types: bool = True) -> DataFrame:
    """Per first tuple: its pairs, those with a clean second tuple, and sums of the k best scp, P(S|F), P(F|S), each
    ranked by itself. Pairs of invalid counts, or of no undirected count above `more_than`, do not take part, nor do
    typed ones if `types` is false. scp is the product of the combined conditionals."""
    ranked = c.where(valid() & (F.col("max_und") > more_than)).withColumn("scp", F.col("und_first") * F.col("und_second"))
    if not types:
        ranked = ranked.where(~F.concat_ws(" ", *KEY).contains("type:"))
    for name in ("scp", "und_first", "und_second"):
        ranked = ranked.withColumn(f"r_{name}", F.row_number().over(Window.partitionBy(*FIRST).orderBy(F.desc(F.round(name, 9)), *SECOND)))
    best = lambda name: F.sum(F.when(F.col(f"r_{name}") <= k, F.col(name)))
    clean = F.sum(valid_tuple("s1", "sr", "s2").cast("bigint")).alias("n_clean")
    out = ranked.groupBy(*FIRST).agg(F.count("*").alias("n_pairs"), clean, best("scp").alias("scp"), best("und_first").alias("p_sf"), best("und_second").alias("p_fs"))
    return out.where(F.col("n_pairs") >= least_pairs)


def bins(scored: DataFrame, key: list[str], score: str, n: int) -> DataFrame:
    """Equal-frequency bins by descending score: rows of floor(count / n), so there can be n + 1.

    No task sees all rows (see `records.gapless`)."""
    ranked = gapless(scored, [-F.round(score, 9), *map(F.col, key)], "rank_")
    size = max(1, ranked.count() // n)
    return ranked.withColumn("bin", F.floor(F.col("rank_") / size).cast("bigint")).drop("rank_")


def sample_bins(binned: DataFrame, key: list[str], take: int, seed: int = 1) -> DataFrame:
    """`take` rows of each bin, by the order of a seeded hash."""
    w = Window.partitionBy("bin").orderBy(F.md5(F.concat_ws("|", F.lit(seed).cast("string"), *key).cast("binary")), *key)
    return binned.withColumn("turn_", F.row_number().over(w)).where(F.col("turn_") <= take).drop("turn_")


def phrase(column: str, query: str) -> Column:
    """The query as whole tokens of the column, whatever the case."""
    clean = "".join(ch if ch.isalnum() or ch == ":" else " " for ch in query.lower()).strip()
    return F.concat(F.lit(" "), F.lower(F.regexp_replace(column, "[^0-9a-zA-Z:]", " ")), F.lit(" ")).contains(f" {clean} ")


def search(pairs: DataFrame, query: dict[str, str], exact: bool = False, reporting: bool | None = True) -> DataFrame:
    """Conjunction of the non-empty fields of `query`; an empty query finds nothing.

    reporting: False drops pairs with a reporting relation, None those whose second relation is one."""
    asked = {c: q for c, q in query.items() if q.strip()}
    if not asked:
        return pairs.limit(0)
    out = pairs
    for c, q in asked.items():
        out = out.where(F.lower(F.col(c)) == q.lower() if exact else phrase(c, q))
    for c in () if reporting else ("sr",) if reporting is None else ("fr", "sr"):
        out = out.where(~T.has_word(F.col(c), T.REPORTING))
    return out


def same_tuple() -> Column:
    """A pair of a tuple with itself, whatever the case and blanks around."""
    norm = lambda c: F.lower(F.trim(F.col(c)))
    return (norm("f1") == norm("s1")) & (norm("fr") == norm("sr")) & (norm("f2") == norm("s2"))


def variable_type(arg1: str, arg2: str) -> Column:
    """The type of the first argument of the two that is a variable; empty if none is, or it has no type."""
    return F.when(F.col(arg1).contains("XVAR"), T.type_name(F.col(arg1))).when(F.col(arg2).contains("XVAR"), T.type_name(F.col(arg2))).otherwise("")


def prune_results(c: DataFrame, least: int = 1, equality: str = "both", types: str = "both") -> DataFrame:
    """Not a tuple with itself, no pronouns, frequent enough at window k (und_k), equality and type options, no
    quantities, agreeing types of variables, valid counts; each pair once.

    The type options look at the second tuple: both its arguments typed, or neither."""
    out = c.where(~same_tuple() & (F.col("und_k") >= least) & valid())
    args = ("f1", "f2", "s1", "s2")
    for a in args:
        out = out.where(~F.trim(F.col(a)).isin(*T.VIEW_PRONOUNS) & ~F.col(a).contains("Type:quantity"))
    has_var = F.concat_ws("|", *args).contains("XVAR")
    if equality == "equality":
        out = out.where(has_var)
    elif equality == "noequality":
        out = out.where(~has_var)
    typed = lambda a: F.col(a).rlike("[tT]ype:")
    if types == "type":
        out = out.where(typed("s1") & typed("s2"))
    elif types == "notype":
        out = out.where(~typed("s1") & ~typed("s2"))
    # Of a pair that is there twice, its most frequent row stays.
    first = Window.partitionBy(*KEY).orderBy(F.desc("und_k"), F.desc("max_und"), F.desc("nf"), F.desc("ns"), F.desc("und_first"))
    return out.where(variable_type("f1", "f2") == variable_type("s1", "s2")).withColumn("n_", F.row_number().over(first)).where("n_ = 1").drop("n_")


SORT_KEYS = {
    "conditional": "und_first", "fs": "max_dir", "sf": "max_und - max_dir", "fs+sf": "max_und",
    "kfs+sf": "und_k", "f": "nf", "s": "ns",
}


def rank(c: DataFrame, by: str = "conditional", k: int | None = None) -> DataFrame:
    """Descending by a sort key, ties by the pair; with rank numbers, the first k only if asked."""
    order = [F.desc(F.round(F.expr(SORT_KEYS.get(by, "und_first")).cast("double"), 9)), *[F.asc(x) for x in KEY]]
    top = c.orderBy(*order) if k is None else c.orderBy(*order).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order))) if k else top


def result_rows(c: DataFrame, k: int) -> DataFrame:
    """The k best rows as they are shown: rank, pair, counts at the asked window and at most, the measure with four
    places, counts in order and in reverse, counts of both tuples."""
    return rank(c, k=k).select(F.col("rank").cast("bigint").alias("rank"), *KEY, "und_k", "max_und", F.format_string("%.4f", "und_first").alias("measure"), F.col("max_dir").alias("fs"), (F.col("max_und") - F.col("max_dir")).alias("sf"), "nf", "ns")


def partners_by_bin(c: DataFrame, binned: DataFrame, k: int) -> DataFrame:
    """The k best valid pairs of every sampled first tuple, with its bin; to be written a folder a bin."""
    w = Window.partitionBy(*FIRST).orderBy(F.desc(F.round("und_first", 9)), *SECOND)
    return c.where(valid()).join(binned, FIRST).withColumn("n_", F.row_number().over(w)).where(F.col("n_") <= k).select("bin", *KEY, "und_first")


def scored_lines(top: DataFrame) -> DataFrame:
    """Scored tuples as TAB lines: pairs, clean ones, three sums, the tuple."""
    return top.select(F.concat_ws("\t", *[F.col(x).cast("string") for x in ("n_pairs", "n_clean", "scp", "p_sf", "p_fs")], *FIRST).alias("value"))


def collapse(c: DataFrame) -> DataFrame:
    """Second relations by their best measure."""
    return c.groupBy("sr").agg(F.max("und_first").alias("best"), F.count("*").alias("n_pairs"))


def top_relations(rec: DataFrame, k: int | None = 100) -> DataFrame:
    """Relations by the number of their documents; all of them if k is None."""
    ranked = rec.groupBy("rel").agg(F.count_distinct("docid").alias("n_docs"), F.count("*").alias("n_records")).orderBy(F.desc("n_docs"), "rel")
    return ranked if k is None else ranked.limit(k)


def page(df: DataFrame, order: list[str], k: int, start: int = 0) -> DataFrame:
    """k rows from number `start` (from 0) on, in an order."""
    return df.orderBy(*order).offset(start).limit(k)


def records_matching(rec: DataFrame, arg: str, rel: str | None = None) -> DataFrame:
    """Records with an argument's head or type, and optionally a relation."""
    a = arg.lower()
    hit = (F.lower("arg1") == a) | (F.lower("arg2") == a) | F.exists("arg1types", lambda t: F.lower(t) == a) | F.exists("arg2types", lambda t: F.lower(t) == a)
    return rec.where(hit if rel is None else hit & (F.col("rel") == rel))


# --- neighbourhoods of the pair graph ------------------------------------------------------


def window_lm(cum: DataFrame, delta: float = 0.05) -> DataFrame:
    """Smoothed P_k(t2 | t1) = (c + delta) / (Z + delta V) on edges t1, t2, window, cnt."""
    z = cum.groupBy("t1", "window").agg(F.sum("cnt").alias("z"))
    v = cum.select("t1").distinct().agg(F.count("*").alias("v"))  # one row
    return cum.join(z, ["t1", "window"]).crossJoin(F.broadcast(v)).withColumn("p", (F.col("cnt") + delta) / (F.col("z") + delta * F.col("v"))).drop("z", "v")


def symmetric_lm(lm: DataFrame, alpha: float = 0.5) -> DataFrame:
    """scp of every edge: decayed P(t2 | t1) times decayed P(t1 | t2), for edges in both directions."""
    w = F.pow(F.lit(alpha), F.col("window"))
    p = lm.groupBy("t1", "t2").agg((F.sum(F.col("p") * w) / F.sum(w)).alias("p"))
    back = p.select(F.col("t2").alias("t1"), F.col("t1").alias("t2"), F.col("p").alias("q"))
    return p.join(back, ["t1", "t2"]).select("t1", "t2", (F.col("p") * F.col("q")).alias("scp"))


def one_hop(edges: DataFrame, seed: str) -> DataFrame:
    """Successors and predecessors of the seed; an unknown seed has none."""
    return edges.where((F.col("t1") == seed) | (F.col("t2") == seed)).distinct()


def two_hop(edges: DataFrame, seed: str, k: int) -> DataFrame:
    """Edges of the other ends of the seed's k best edges that do not touch the seed."""
    hop = one_hop(edges, seed).orderBy(F.desc(F.round("scp", 12)), "t1", "t2").limit(k)
    ends = hop.select(F.when(F.col("t1") == seed, F.col("t2")).otherwise(F.col("t1")).alias("via")).where(F.col("via") != seed).distinct()
    away = edges.where((F.col("t1") != seed) & (F.col("t2") != seed))
    via1 = away.join(F.broadcast(ends), away.t1 == ends.via).select("via", "t1", "t2", "scp")  # k rows at most
    via2 = away.join(F.broadcast(ends), away.t2 == ends.via).select("via", "t1", "t2", "scp")
    return via1.unionByName(via2).distinct()


def dump_edges(edges: DataFrame, more_than: int = 25) -> DataFrame:
    """Edges whose counts over all windows sum to more than a threshold: t1, t2, and the counts by window as text."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("window", "cnt"))), lambda x: x["cnt"].cast("string")), "\t")
    return edges.groupBy("t1", "t2").agg(F.sum("cnt").alias("n"), listed.alias("counts")).where(F.col("n") > more_than)


def lookup_edges(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """Counts of asked (t1, t2, window); zero where there are none."""
    return asked.join(edges, ["t1", "t2", "window"], "left").fillna(0, ["cnt"])


def report(edges: DataFrame, seed: str, k: int = 25) -> DataFrame:
    """Lines of a neighbourhood: the seed, its edges, and the edges of its k best neighbours."""
    sep = "_NSEP_"
    line = lambda kind: F.concat_ws(sep, F.lit(kind), "t1", "t2", F.format_number("scp", 6))
    top = edges.sparkSession.range(1).select(F.lit("seed").alias("kind"), F.lit(f"seed{sep}{seed}").alias("value"))
    one = one_hop(edges, seed).select(F.lit("onehop").alias("kind"), line("onehop").alias("value"))
    two = two_hop(edges, seed, k).select(F.lit("twohop").alias("kind"), line("twohop").alias("value"))
    return top.unionByName(one).unionByName(two)


def document_tuples(rec: DataFrame, docids: list, most_docs: int = 100) -> DataFrame:
    """Records of the first `most_docs` of the asked documents."""
    return rec.where(F.col("docid").isin(sorted(docids)[:most_docs]))


# --- evaluation ------------------------------------------------------------------------


def precision_recall(scored: DataFrame, group: list[str], block: int = 100_000) -> DataFrame:
    """Points of the ranking by score (ties by item): recall and precision after every item.

    Without a group the ranking is of all rows: they are numbered by ranges, and hits are summed by blocks of numbers."""
    if not group:
        ranked = stored(gapless(scored.select("item", "label", "score"), [-F.col("score"), F.col("item")], "at_"), "ranked").withColumn("block_", F.floor(F.col("at_") / block))
        sums = ranked.groupBy("block_").agg(F.sum("label").alias("sum_"))  # one row a block
        before = sums.select("block_", F.coalesce(F.sum("sum_").over(Window.orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_"), F.sum("sum_").over(Window.partitionBy()).alias("all_"))
        own = F.sum("label").over(Window.partitionBy("block_").orderBy("at_").rowsBetween(Window.unboundedPreceding, 0))
        hits = F.col("before_") + F.col("own_")
        return ranked.withColumn("own_", own).join(before, "block_").select("item", (F.col("at_") + 1).alias("n"), (hits / F.col("all_")).alias("recall"), (hits / (F.col("at_") + 1)).alias("precision"))
    w = Window.partitionBy(*group).orderBy(F.desc("score"), "item")
    n = F.row_number().over(w)
    hits = F.sum("label").over(w.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("label").over(Window.partitionBy(*group))
    return scored.select(*group, "item", n.alias("n"), (hits / total).alias("recall"), (hits / n).alias("precision"))


def area(points: DataFrame, group: list[str]) -> DataFrame:
    """Trapezoid area under the points, from recall 0 and precision 1."""
    w = Window.partitionBy(*group).orderBy("n")
    r0, p0 = F.coalesce(F.lag("recall").over(w), F.lit(0.0)), F.coalesce(F.lag("precision").over(w), F.lit(1.0))
    return points.select(*group, ((F.col("recall") - r0) * (F.col("precision") + p0) / 2).alias("a")).groupBy(*group).agg(F.sum("a").alias("auc"))


def error_modes(scored: DataFrame, k: int = 100) -> DataFrame:
    """The lowest-scored positives and the highest-scored negatives."""
    w = Window.partitionBy("label").orderBy(F.when(F.col("label") == 1, F.col("score")).otherwise(-F.col("score")), "item")
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def confidence(rec: DataFrame) -> DataFrame:
    """Per tuple: median (sorted element n / 2), least, most and mean confidence of its records.

    Equal confidences of a tuple are counted first, so that only its different ones are sorted in one task."""
    key = ["arg1", "rel", "arg2"]
    seen = rec.groupBy(*key, "confidence").agg(F.count("*").alias("n_"))
    w = Window.partitionBy(*key)
    ranked = seen.withColumn("upto_", F.sum("n_").over(w.orderBy("confidence").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all_", F.sum("n_").over(w))
    at = F.floor(F.col("all_") / 2) + 1
    median = F.max(F.when((F.col("upto_") >= at) & (F.col("upto_") - F.col("n_") < at), F.col("confidence")))
    mean = F.sum(F.col("confidence") * F.col("n_")) / F.sum(F.when(F.col("confidence").isNotNull(), F.col("n_")))
    return ranked.groupBy(*key).agg(median.alias("median"), F.min("confidence").alias("least"), F.max("confidence").alias("most"), mean.alias("mean"))


def examples(rec: DataFrame, k: int = 5) -> DataFrame:
    """Per tuple up to k examples by falling confidence (ties by rid), none sharing a hash with a record before it.

    A tuple's records are first thinned to one for each set of hashes, its best, so that near-duplicates meet before
    the fold; what one fold holds is the distinct sets of a tuple."""
    best = F.min_by(F.struct("rid", "sentence"), F.struct((-F.col("confidence")).alias("c"), "rid"))
    thin = rec.groupBy("arg1", "rel", "arg2", F.array_sort("hashes").alias("hashes"), F.when(F.size("hashes") == 0, F.col("rid")).alias("own")).agg(F.max("confidence").alias("confidence"), best.alias("x"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), F.col("x.rid").alias("rid"), "hashes", F.col("x.sentence").alias("sentence"))))
    folded = thin.groupBy("arg1", "rel", "arg2").agg(order.alias("xs"))
    return folded.select("arg1", "rel", "arg2", F.explode(F.slice(F.expr("""aggregate(xs, named_struct('h', cast(array() as array<int>), 'out', cast(array() as array<string>)),
        (a, x) -> named_struct('h', array_union(a.h, x.hashes), 'out', IF(arrays_overlap(a.h, x.hashes), a.out, array_append(a.out, x.sentence)))).out"""), 1, k)).alias("sentence"))


def release_pairs(cum: DataFrame, grid: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """A pair's counts on a grid of windows, as comma-separated text."""
    at = lambda name: F.concat_ws(",", *[F.coalesce(F.sum(F.when(F.col("window") == w, F.col(name))), F.lit(0)).cast("string") for w in grid])
    return cum.groupBy(*KEY).agg(at("und").alias("undirected"), at("dir").alias("directed"))


def release_pairs_with_heads(cum: DataFrame, heads: DataFrame, grid: tuple[int, ...], least: int = 0) -> DataFrame:
    """The released form: pairs of clean arguments whose largest undirected count is `least` or more, the most frequent
    heads of the first tuple's arguments, and counts on a grid of windows. heads: pair, place, head, n."""
    w = Window.partitionBy(*KEY, "place").orderBy(F.desc("n"), "head")
    listed = heads.withColumn("r_", F.row_number().over(w)).groupBy(*KEY, "place").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r_", "head", "n"))), lambda x: F.concat_ws(":", x["head"], x["n"].cast("string"))), ",").alias("heads"))
    both = listed.groupBy(*KEY).agg(*[F.max(F.when(F.col("place") == p, F.col("heads"))).alias(c) for p, c in (("f1", "heads1"), ("f2", "heads2"))])
    often = cum.groupBy(*KEY).agg(F.max("und").alias("top")).where(exportable(least, "top", "f1", "f2", "s1", "s2")).select(*KEY)
    return release_pairs(cum, grid).join(often, KEY, "left_semi").join(both, KEY, "left")


def top_heads(heads: DataFrame, key: list[str], k: int = 5) -> DataFrame:
    """The k most frequent heads of a key as text; ties by head. heads: key, head, n."""
    w = Window.partitionBy(*key).orderBy(F.desc("n"), "head")
    top = heads.withColumn("r_", F.row_number().over(w)).where(F.col("r_") <= k)
    return top.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r_", "head", "n"))), lambda x: F.concat_ws(":", x["head"], x["n"].cast("string"))), ",").alias("heads"))
