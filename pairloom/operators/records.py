"""Record-level operators: pruning, filters, offsets, generalisation, ordinals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions import text as T
from pairloom.session import stored


def sentence_offsets(rows: DataFrame) -> DataFrame:
    """docid, sentid, offset: running length of the sentences before, plus one each. Where the records of a sentence
    differ in its text, the last one's counts."""
    last = F.max_by("sentence", F.struct("extrid", "rid")) if {"extrid", "rid"} <= set(rows.columns) else F.max("sentence")
    one = rows.groupBy("docid", "sentid").agg(last.alias("sentence"))
    w = Window.partitionBy("docid").orderBy("sentid").rowsBetween(Window.unboundedPreceding, -1)
    return one.select("docid", "sentid", F.coalesce(F.sum(F.length("sentence") + 1).over(w), F.lit(0)).alias("offset"))


def trim_sentences(rows: DataFrame, most_spaces: int = 75) -> DataFrame:
    return rows.where(T.spaces(F.col("sentence")) <= most_spaces)


def prune(rec: DataFrame, most_words: int = 7) -> DataFrame:
    """Alphanumeric heads, short relations, be and have rewritten, numbered by place."""
    kept = rec.where(T.alnum(F.col("arg1")) & T.alnum(F.col("rel")) & T.alnum(F.col("arg2")) & (F.size(T.tokens(F.col("rel"))) <= most_words))
    w = Window.partitionBy("docid").orderBy("sentid", "extrid", "rid")
    return kept.withColumn("rel", T.rewrite_be_have(F.col("rel"))).withColumn("position", F.row_number().over(w))


def drop_reporting(rec: DataFrame) -> DataFrame:
    """Opt-in: without reporting, "be" and "had" relations."""
    return rec.where(~T.has_word(F.col("rel"), T.REPORTING_FORMS) & ~F.col("rel").isin("be", "had", "had had"))


def said_preposition(rec: DataFrame) -> DataFrame:
    """Drop records whose first preposition is not a word of the sentence."""
    first = F.try_element_at(F.filter(T.tokens(F.col("rel")), lambda t: t.isin(*T.HINT_PREPOSITIONS)), F.lit(1))
    return rec.where(first.isNull() | F.array_contains(T.tokens(F.col("sentence")), first))


def representations(head: Column, types: Column) -> Column:
    """Lower-cased head and types without blanks; a time type displaces the number type."""
    reps = F.array_distinct(F.filter(F.transform(F.concat(F.array(head), types), lambda x: F.lower(F.trim(x))), lambda x: x != ""))
    timed = F.array_contains(reps, "type:time_unit") | F.array_contains(reps, "type:time_period")
    return F.when(timed, F.array_remove(reps, "type:number")).otherwise(reps)


def ordinals(rec: DataFrame) -> DataFrame:
    """idx: dense number of (sentid, extrid) inside the document."""
    return rec.withColumn("idx", F.dense_rank().over(Window.partitionBy("docid").orderBy("sentid", "extrid")).cast("bigint"))


def generalise(rec: DataFrame) -> DataFrame:
    """One row for each tuple of representations: a1, rel, a2."""
    return rec.withColumn("a1", F.explode(representations(F.col("arg1"), F.col("arg1types")))).withColumn("a2", F.explode(representations(F.col("arg2"), F.col("arg2types"))))


def _field(of: str | Column, name: str) -> Column:
    """A column of an alias, or a field of a struct."""
    return F.col(f"{of}.{name}") if isinstance(of, str) else of[name]


def span_inside(o: str | Column, i: str | Column) -> Column:
    """All three parts of one record stand inside those of the other, either way."""
    within = lambda x, y: reduce(lambda p, q: p & q, [(_field(x, f"{c}_start") >= _field(y, f"{c}_start")) & (_field(x, f"{c}_end") <= _field(y, f"{c}_end")) for c in ("arg1", "rel", "arg2")])
    return within(o, i) | within(i, o)


def subsumes(o: str | Column, i: str | Column, spans: bool = False, case: bool = False) -> Column:
    """Two records say the same: equal or switched arguments, one text or word set inside the other, or (with `spans`)
    one's places inside the other's. `case` makes arguments of different case different."""
    a1, r, a2, b1, q, b2 = (_field(x, c) for x in (o, i) for c in ("arg1", "rel", "arg2"))
    low = (lambda c: c) if case else F.lower
    same = (low(a1) == low(b1)) & (low(a2) == low(b2))
    switched = (low(a1) == low(b2)) & (low(a2) == low(b1))
    x, y = F.concat_ws(" ", a1, T.strip_be(r), a2), F.concat_ws(" ", b1, T.strip_be(q), b2)
    wx, wy = (F.filter(F.split(F.concat_ws(" ", *p), " "), lambda t: t != "be") for p in ((a1, r, a2), (b1, q, b2)))
    inside = (F.size(F.array_except(wx, wy)) == 0) | (F.size(F.array_except(wy, wx)) == 0)
    said = same | switched | x.contains(y) | y.contains(x) | inside
    return said | span_inside(o, i) if spans else said


#: What `alike` compares of two records.
SAYS = ["low1", "low2", "said", "words"]


def says() -> dict[str, Column]:
    """The columns of SAYS of a record: lower-cased arguments, its text, and its words but "be"."""
    words = F.filter(F.split(F.concat_ws(" ", "arg1", "rel", "arg2"), " "), lambda t: t != "be")
    return dict(zip(SAYS, (F.lower("arg1"), F.lower("arg2"), F.concat_ws(" ", "arg1", T.strip_be(F.col("rel")), "arg2"), words), strict=True))


def alike(o: str | Column, i: str | Column, spans: bool = False) -> Column:
    """`subsumes` of two records that have the columns of SAYS: nothing is split or replaced once a pair."""
    (a1, a2, x, wx), (b1, b2, y, wy) = ([_field(z, c) for c in SAYS] for z in (o, i))
    all_in = lambda p, q: F.forall(p, lambda w: F.array_contains(q, w))
    said = ((a1 == b1) & (a2 == b2)) | ((a1 == b2) & (a2 == b1)) | x.contains(y) | y.contains(x) | all_in(wx, wy) | all_in(wy, wx)
    return said | span_inside(o, i) if spans else said


def tuple_subsumes(first: tuple[str, str, str], second: tuple[str, str, str]) -> Column:
    """Of two tuples: one text inside the other, or all words of the first but "be" among those of the second."""
    x, y = (F.concat_ws(" ", F.col(a), T.strip_be(F.col(r)), F.col(b)) for a, r, b in (first, second))
    wx, wy = (F.filter(F.split(t, " "), lambda w: w != "be") for t in (x, y))
    return x.contains(y) | y.contains(x) | (F.size(F.array_except(wx, wy)) == 0)


def drop_redundant(rec: DataFrame) -> DataFrame:
    """Opt-in: inside a sentence, of any two records (of different extrid) that are not different the shorter goes, and
    both where they are equally long. One anti-join is the fix-point: of those left no two are alike."""
    length = lambda x: F.length(F.concat(f"{x}.arg1", f"{x}.rel", f"{x}.arg2"))
    spans = "arg1_start" in rec.columns
    alike = (F.col("o.docid") == F.col("i.docid")) & (F.col("o.sentid") == F.col("i.sentid")) & (F.col("o.extrid") != F.col("i.extrid")) & subsumes("o", "i", spans, case=True)
    return rec.alias("o").join(rec.alias("i"), alike & (length("i") >= length("o")), "left_anti")


def gapless(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with numbers from 0 in an ascending order, without a task that sees all rows: rows fall into ranges, are numbered
    inside their range, and shifted by the counts of the ranges before. Bounds come from a sample, which only balances the
    ranges (a row finds its own by binary search); ranges are stored with the rows, so that both readers agree on them."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyed = stored(df.withColumn("key_", F.struct(*[o.alias(f"k{i}") for i, o in enumerate(order)])), "numbered")
    ranged = stored(keyed.repartitionByRange(parts, "key_").withColumn("range_", F.spark_partition_id()), "ranges")
    local = ranged.withColumn("place_", F.row_number().over(Window.partitionBy("range_").orderBy("key_")))
    counts = ranged.groupBy("range_").agg(F.count("*").alias("n_"))  # one row a range
    before = counts.select("range_", F.coalesce(F.sum("n_").over(Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base_"))
    return local.join(before, "range_").withColumn(name, (F.col("base_") + F.col("place_") - 1).cast("bigint")).drop("key_", "range_", "place_", "base_")


def size_histogram(rec: DataFrame) -> DataFrame:
    """Documents by their number of records, in steps of ten up to a hundred."""
    n = rec.groupBy("docid").agg(F.count("*").alias("n"))
    return n.groupBy(F.least(F.lit(100), F.greatest(F.lit(10), F.ceil(F.col("n") / 10) * 10)).cast("bigint").alias("bin")).agg(F.count("*").alias("n_docs"))
