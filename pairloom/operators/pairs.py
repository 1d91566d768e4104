"""Ordered pairs of tuples within a window, their counts, and coreference."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .records import generalise, ordinals, representations, said_preposition, subsumes

KEY = ["f1", "fr", "f2", "s1", "sr", "s2"]
#: The arguments of a coreferring pair by (1=1, 2=2, 1=2, 2=1); None keeps the argument, and what is not listed is all X.
TABLE = {
    (1, 0, 0, 0): ("X", None, "X", None), (0, 0, 1, 0): ("X", None, None, "X"), (0, 1, 0, 0): (None, "X", None, "X"),
    (0, 0, 0, 1): (None, "X", "X", None), (1, 1, 0, 0): ("X", "Y", "X", "Y"), (0, 0, 1, 1): ("X", "Y", "Y", "X"),
    (0, 1, 1, 0): ("X", "X", None, "X"), (1, 0, 0, 1): ("X", "X", "X", None), (1, 0, 1, 0): ("X", None, "X", "X"), (0, 1, 0, 1): (None, "X", "X", "X"),
}


def numbered(rec: DataFrame) -> DataFrame:
    """The records that take part, with their ordinals (numbered after the filter)."""
    return ordinals(said_preposition(rec))


def band_join(rec: DataFrame, window: int) -> DataFrame:
    """Record pairs (aliases o, i) with 0 < i.idx - o.idx <= window that do not say the same.

    An equi-join on (docid, bucket of `window` ordinals): a document however long
    is spread over its buckets, and a bucket meets itself and the next one."""
    # The join multiplies rows, which sizes of its inputs do not show: keep all partitions.
    n = int(rec.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    o = rec.withColumn("bucket", F.floor(F.col("idx") / window)).repartition(n, "docid", "bucket").alias("o")
    i = rec.withColumn("bucket", F.explode(F.array(F.floor(F.col("idx") / window), F.floor(F.col("idx") / window) - 1))).repartition(n, "docid", "bucket").alias("i")
    gap = F.col("i.idx") - F.col("o.idx")
    other = (F.col("o.sentid") != F.col("i.sentid")) | ~subsumes("o", "i", "arg1_start" in rec.columns)
    return o.join(i, (F.col("o.docid") == F.col("i.docid")) & (F.col("o.bucket") == F.col("i.bucket")) & (gap > 0) & (gap <= window) & other)


def places(rec: DataFrame) -> list[str]:
    """The columns of places in the sentence, where a record has them."""
    return [c for c in rec.columns if c.endswith(("_start", "_end"))]


def nearest(rec: DataFrame, window: int = 10) -> DataFrame:
    """docid, outer record, pair key, dist: a pair counts once for an outer record, at its smallest distance."""
    # Representations are made once a record, below the join.
    ready = rec.withColumn("r1", representations(F.col("arg1"), F.col("arg1types"))).withColumn("r2", representations(F.col("arg2"), F.col("arg2types")))
    slim = ready.select("docid", "rid", "sentid", "idx", "arg1", "rel", "arg2", "r1", "r2", *places(rec))
    b = band_join(slim, window).select(
        F.col("o.docid").alias("docid"), F.col("o.bucket").alias("bucket"), F.col("o.rid").alias("rid"), F.col("o.rel").alias("fr"), F.col("i.rel").alias("sr"),
        (F.col("i.idx") - F.col("o.idx")).alias("dist"), F.explode("o.r1").alias("f1"), F.col("o.r2").alias("o2"), F.col("i.r1").alias("i1"), F.col("i.r2").alias("i2"),
    )
    out = b.withColumn("f2", F.explode("o2")).withColumn("s1", F.explode("i1")).withColumn("s2", F.explode("i2"))
    # The join is partitioned by (docid, bucket): grouping by them too needs no further shuffle.
    return out.groupBy("docid", "bucket", "rid", *KEY).agg(F.min("dist").alias("dist")).drop("bucket")


def directed(near: DataFrame) -> DataFrame:
    """Pair, window, cnt."""
    return near.groupBy(*KEY, F.col("dist").alias("window")).agg(F.count("*").alias("cnt"))


def unigrams(rec: DataFrame) -> DataFrame:
    """a1, rel, a2, n: records of each tuple. Equal records are counted before they are generalised."""
    kinds = rec.groupBy("arg1", "arg1types", "rel", "arg2", "arg2types").agg(F.count("*").alias("n"))
    return generalise(kinds).groupBy("a1", "rel", "a2").agg(F.sum("n").alias("n"))


def bits(rec: DataFrame) -> list[Column]:
    """1=1, 2=2, 1=2, 2=1 over the chains of the pair's arguments: one key each, or an array of keys that need to meet."""
    sets = rec.schema["chain1"].dataType.typeName() == "array"
    equal = lambda a, b: F.coalesce(F.arrays_overlap(a, b) if sets else F.col(a) == F.col(b), F.lit(False))
    return [equal("o.chain1", "i.chain1"), equal("o.chain2", "i.chain2"), equal("o.chain1", "i.chain2"), equal("o.chain2", "i.chain1")]


def coref_single(rec: DataFrame, window: int = 10) -> DataFrame:
    """The first equality that holds, of 1=1, 1=2, 2=1, 2=2, written as XVAR."""
    b = bits(rec)
    case = F.when(b[0], "11").when(b[2], "12").when(b[3], "21").when(b[1], "22")
    p = band_join(rec, window).withColumn("eq", case).where("eq is not null")
    arg = lambda col, hits: F.when(F.col("eq").isin(*hits), "XVAR").otherwise(F.col(col))
    return p.select(
        F.col("o.docid").alias("docid"), "eq", arg("o.arg1", ("11", "12")).alias("f1"), F.col("o.rel").alias("fr"), arg("o.arg2", ("21", "22")).alias("f2"),
        arg("i.arg1", ("11", "21")).alias("s1"), F.col("i.rel").alias("sr"), arg("i.arg2", ("12", "22")).alias("s2"), (F.col("i.idx") - F.col("o.idx")).alias("dist"),
    )


def coref_multiple(rec: DataFrame, window: int = 10) -> DataFrame:
    """All equalities at once, with XVAR and YVAR."""
    b = bits(rec)
    names = ("o.arg1", "o.arg2", "i.arg1", "i.arg2")
    p = band_join(rec, window).where(reduce(lambda x, y: x | y, b))

    def out(k: int) -> Column:
        case = None
        for key, row in TABLE.items():
            hit = reduce(lambda x, y: x & y, [c if v else ~c for c, v in zip(b, key, strict=True)])
            value = F.concat(F.lit(f"{row[k]}VAR:"), F.lower(names[k])) if row[k] else F.lower(names[k])
            case = F.when(hit, value) if case is None else case.when(hit, value)
        return case.otherwise(F.concat(F.lit("XVAR:"), F.lower(names[k])))

    return p.select(F.col("o.docid").alias("docid"), out(0).alias("f1"), F.col("o.rel").alias("fr"), out(1).alias("f2"), out(2).alias("s1"), F.col("i.rel").alias("sr"), out(3).alias("s2"), (F.col("i.idx") - F.col("o.idx")).alias("dist"))


def _variables(b: list[Column], multiple: bool) -> list[Column]:
    """The variable of each of the four arguments, or null, given the equalities."""
    if not multiple:
        x = F.lit("XVAR")
        first = F.when(b[0], "11").when(b[2], "12").when(b[3], "21").when(b[1], "22")
        return [F.when(first.isin(*hits), x) for hits in (("11", "12"), ("21", "22"), ("11", "21"), ("12", "22"))]
    state = F.concat(*[F.when(c, "1").otherwise("0") for c in b])
    known = {"".join(map(str, bits_)): row for bits_, row in TABLE.items()}
    out = []
    for k in range(4):
        case = F.when(state == "0000", F.lit(None).cast("string"))
        for bits_, row in known.items():
            case = case.when(state == bits_, F.lit(f"{row[k]}VAR" if row[k] else None).cast("string"))
        out.append(case.otherwise("XVAR"))
    return out


def variable_type(first: str, second: str) -> Column:
    """The type in name:type:value of one of two arguments, the first that has one; else null."""
    found = lambda c: F.nullif(F.regexp_extract(c, "^[^:]*:[tT][yY][pP][eE]:([^:]+)$", 1), F.lit(""))
    return F.coalesce(found(first), found(second))


def equality_nearest(rec: DataFrame, window: int = 10, multiple: bool = False) -> DataFrame:
    """docid, rid, pair key, dist: generalised pairs whose arguments corefer, with variables in their place.

    One variable stands for a head, and goes before a type; with `multiple`, XVAR and YVAR go before every argument
    they stand for. Pairs of two different types of variables drop; a pair counts once for an outer record."""
    ready = rec.withColumn("r1", representations(F.col("arg1"), F.col("arg1types"))).withColumn("r2", representations(F.col("arg2"), F.col("arg2types")))
    slim = ready.select("docid", "rid", "sentid", "idx", "arg1", "rel", "arg2", "r1", "r2", "chain1", "chain2", *places(rec))
    b = bits(slim)
    p = band_join(slim, window).where(reduce(lambda x, y: x | y, b)).select(
        F.col("o.docid").alias("docid"), F.col("o.bucket").alias("bucket"), F.col("o.rid").alias("rid"), F.col("o.rel").alias("fr"), F.col("i.rel").alias("sr"),
        (F.col("i.idx") - F.col("o.idx")).alias("dist"), F.explode("o.r1").alias("f1"), F.col("o.r2").alias("o2"), F.col("i.r1").alias("i1"), F.col("i.r2").alias("i2"),
        *[v.alias(f"v{k}") for k, v in enumerate(_variables(b, multiple))],
    )
    out = p.withColumn("f2", F.explode("o2")).withColumn("s1", F.explode("i1")).withColumn("s2", F.explode("i2"))
    for k, c in enumerate(("f1", "f2", "s1", "s2")):
        named = F.concat_ws(":", f"v{k}", c) if multiple else F.when(F.col(c).startswith("type:"), F.concat_ws(":", f"v{k}", c)).otherwise(F.col(f"v{k}"))
        out = out.withColumn(c, F.when(F.col(f"v{k}").isNull(), F.col(c)).otherwise(named))
    agree = F.coalesce(variable_type("f1", "f2") == variable_type("s1", "s2"), F.lit(True))
    return out.where(agree).groupBy("docid", "bucket", "rid", *KEY).agg(F.min("dist").alias("dist")).drop("bucket")


def equality_unigrams(rec: DataFrame, near: DataFrame) -> DataFrame:
    """a1, rel, a2, n: plain tuples count once a record, those with variables once a pair they are in."""
    side = lambda k: near.groupBy(*[F.col(c).alias(n) for c, n in zip(KEY[k : k + 3], ("a1", "rel", "a2"), strict=True)]).agg(F.count("*").alias("n"))
    return unigrams(rec).unionByName(side(0)).unionByName(side(3)).groupBy("a1", "rel", "a2").agg(F.sum("n").alias("n"))


def head_counts(near: DataFrame, rec: DataFrame, most: int = 5) -> DataFrame:
    """Pair, place (f1, f2), head, n: the raw heads of the outer record, the `most` most frequent (ties by head)."""
    heads = near.join(rec.select("docid", "rid", "arg1", "arg2"), ["docid", "rid"])
    each = heads.select(*KEY, F.explode(F.array(F.struct(F.lit("f1").alias("place"), F.col("arg1").alias("head")), F.struct(F.lit("f2").alias("place"), F.col("arg2").alias("head")))).alias("h"))
    n = each.groupBy(*KEY, "h.place", "h.head").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*KEY, "place").orderBy(F.desc("n"), "head")
    return n.withColumn("r_", F.row_number().over(w)).where(F.col("r_") <= most).drop("r_")


def chains_of(spans: DataFrame, mentions: DataFrame, most_words: int = 5, bucket: int = 256) -> DataFrame:
    """Chain keys whose mention contains a span: docid, span_id, chains. Mentions of too many words do not take part.

    Places are bucketed, so that a long document is spread over its buckets."""
    m = mentions.where(F.size(F.split("text", " ")) <= most_words).select("docid", "chain_id", F.col("start").alias("m_start"), F.col("end").alias("m_end"))
    m = m.withColumn("bucket_", F.explode(F.sequence(F.floor(F.col("m_start") / bucket), F.floor(F.col("m_end") / bucket))))
    hit = spans.withColumn("bucket_", F.floor(F.col("start") / bucket)).join(m, ["docid", "bucket_"]).where((F.col("m_start") <= F.col("start")) & (F.col("end") <= F.col("m_end")))
    return hit.groupBy("docid", "span_id").agg(F.array_sort(F.collect_set("chain_id")).alias("chains"))


def merge_mentions(docs: DataFrame, mentions: DataFrame, most_records: int = 100) -> DataFrame:
    """Documents with the mentions of a mention document of the same id, the first of each side."""
    first = lambda df, by: df.withColumn("rn_", F.row_number().over(Window.partitionBy("docid").orderBy(by))).where("rn_ = 1").drop("rn_")
    right = first(mentions.where(F.col("n_records") <= most_records), "mention_key").select(F.col("docid"), "mention_key")
    return first(docs, "doc_key").join(right, "docid", "left").select("docid", "doc_key", F.coalesce("mention_key", F.lit("")).alias("mention_key"))


def merge_disjoint(rows: DataFrame, most_hashes: int = 100) -> DataFrame:
    """Corpus counts of pairs with near-duplicates left out: in the order of docid,
    a row joins its group only if its hashes are disjoint from those joined so far.

    rows: key, docid, hashes (array<int>), cnt. A fold over one key's documents."""
    folded = rows.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("docid", "cnt", "hashes"))).alias("xs"))
    return folded.select("key", F.expr(f"""aggregate(xs, named_struct('n', 0L, 'h', cast(array() as array<int>), 'kept', 0),
        (a, x) -> IF(arrays_overlap(a.h, x.hashes), a, named_struct('n', a.n + x.cnt, 'h', IF(size(a.h) < {most_hashes}, array_union(a.h, x.hashes), a.h), 'kept', a.kept + 1)))""").alias("r")).select("key", F.col("r.n").alias("n"), F.col("r.kept").alias("n_docs"))


def merge_tuples(tuples: DataFrame) -> DataFrame:
    return tuples.groupBy("a1", "rel", "a2").agg(F.sum("n").alias("n"))


def verb_only(pairs: DataFrame) -> DataFrame:
    """Pairs keyed by the verbs of their relations, counted anew."""
    from pairloom.functions.text import verb_of

    v = pairs.withColumn("fr", verb_of(F.col("fr"))).withColumn("sr", verb_of(F.col("sr")))
    return v.groupBy(*KEY, "window").agg(F.sum("cnt").alias("cnt"))


def verb_only_tuples(tuples: DataFrame) -> DataFrame:
    """Tuples keyed by the verbs of their relations, counted anew."""
    from pairloom.functions.text import verb_of

    return tuples.withColumn("rel", verb_of(F.col("rel"))).groupBy("a1", "rel", "a2").agg(F.sum("n").alias("n"))
