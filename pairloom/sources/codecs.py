"""Text forms of records, documents, mentions, tuples and pairs, and text and Parquet ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators.records import gapless
from pairloom.functions.text import counts_of_text, counts_text, first_rest, number_or, window_counts_of_text, window_counts_text

# The separators of the text forms.
SPAN = "_SPAN_"
DOCID, RECORD = "_DOCID_SEP_", "_RECORD_SEP_"
TDOC = "_TDOC_SEP_"
KEYVAL, VAL, MENTION, MFIELD = "_KEYVAL_SEP_", "_VALSEP_", "_MSEP_", "_MFIELD_SEP_"
SENT = "_SENT_SEP_"
PAIR, PAIR_COUNTS, UNDIRECTED, MEASURES = "_RG_SEP_", "_RGC_SEP_", "_URGC_", "_MSEP_"
AFFINITY, WINDOWED, TAGGED = "_affsep_", "_WSEP_", "_TRGC_SEP_"


def _part(line: Column, sep: str, k: int) -> Column:
    return F.try_element_at(F.split(line, sep, -1), F.lit(k))


APP = ("docid", "sentid", "sentence", "arg1", "arg1head", "arg1types", "rel", "relhead", "arg2", "arg2head", "arg2types")


def format_app_lines(apps: DataFrame) -> DataFrame:
    """The lines that `parse_app_lines` reads."""
    text = lambda c: F.array_join(c, ",") if c.endswith("types") else F.col(c).cast("string")
    return apps.select(F.concat_ws("|", *map(text, APP)).alias("value"))


def parse_app_lines(lines: DataFrame, *more: str, stand_in: bool = False) -> DataFrame:
    """'|' lines of eleven fields and more; shorter ones, and those without a sentence number, drop, or with `stand_in`
    become rows of "NA" and sentence -1."""
    p = F.split("value", "\\|", -1)
    good = (F.size(p) >= 11) & F.get(p, 1).try_cast("int").isNotNull()
    if stand_in:
        lines = lines.withColumn("value", F.when(good, F.col("value")).otherwise("NA|-1" + "|NA" * 9))
    types = lambda i: F.filter(F.split(F.get(p, i), ","), lambda t: t != "")
    rows = lines.where(F.size(p) >= 11)
    out = rows.select(
        F.get(p, 0).alias("docid"), F.get(p, 1).try_cast("int").alias("sentid"), F.get(p, 2).alias("sentence"), F.get(p, 3).alias("arg1"), F.get(p, 4).alias("arg1head"), types(5).alias("arg1types"),
        F.get(p, 6).alias("rel"), F.get(p, 7).alias("relhead"), F.get(p, 8).alias("arg2"), F.get(p, 9).alias("arg2head"), types(10).alias("arg2types"), *more,
    )
    return out.where("sentid is not null")


def _span(field: Column) -> Column:
    """text_SPAN_start-end as a struct; null if malformed."""
    pattern = f"^(.*?){SPAN}(\\d+)-(\\d+)$"
    get = lambda g: F.regexp_extract(field, pattern, g)
    return F.when(field.rlike(pattern), F.struct(get(1).alias("text"), get(2).cast("int").alias("start"), get(3).cast("int").alias("end")))


_SPANNED = ("arg1", "rel", "arg2", "arg1Head", "relHead", "arg2Head")


def parse_records(lines: DataFrame) -> DataFrame:
    """TAB lines: docid, sentid, sentence, extrid, hashes, six spans, two type lists, confidence (-1 if absent).
    Lines with a missing or malformed field drop."""
    p = F.split("value", "\t", -1)
    types = lambda k: F.filter(F.split(F.coalesce(F.try_element_at(p, F.lit(k)), F.lit("")), ","), lambda t: t != "")
    rows = lines.where(F.size(p) > 10)
    out = rows.select(
        F.get(p, 0).alias("docid"), F.get(p, 1).try_cast("int").alias("sentid"), F.get(p, 2).alias("sentence"), F.get(p, 3).try_cast("int").alias("extrid"),
        F.array_distinct(F.filter(F.transform(F.split(F.get(p, 4), ","), lambda h: h.try_cast("int")), lambda h: h.isNotNull())).alias("hashes"),
        *[_span(F.get(p, 5 + i)).alias(n) for i, n in enumerate(_SPANNED)],
        types(12).alias("arg1Types"), types(13).alias("arg2Types"), F.coalesce(F.try_element_at(p, F.lit(14)).try_cast("double"), F.lit(-1.0)).alias("confidence"),
    )
    ok = F.col("sentid").isNotNull() & F.col("extrid").isNotNull()
    for n in _SPANNED:
        ok = ok & F.col(n).isNotNull()
    return out.where(ok)


def format_records(rec: DataFrame) -> DataFrame:
    """The lines that `parse_records` reads."""
    span = lambda n: F.format_string(f"%s{SPAN}%d-%d", f"{n}.text", f"{n}.start", f"{n}.end")
    listed = lambda c: F.array_join(c, ",")
    return rec.select(F.concat_ws("\t", "docid", F.col("sentid").cast("string"), "sentence", F.col("extrid").cast("string"), listed(F.col("hashes").cast("array<string>")), *[span(n) for n in _SPANNED], listed("arg1Types"), listed("arg2Types"), F.col("confidence").cast("string")).alias("value"))


def parse_documents(lines: DataFrame) -> DataFrame:
    """Document lines as record lines: docid, position, value. Lines without exactly two parts, or without records, drop."""
    p = F.split("value", DOCID, -1)
    rows = lines.where((F.size(p) == 2) & (F.element_at(p, 2) != ""))
    return rows.select(F.get(p, 0).alias("docid"), F.posexplode(F.split(F.get(p, 1), RECORD, -1)).alias("position", "value"))


def format_documents(records: DataFrame) -> DataFrame:
    """docid, position, value (a record's line) as one line a document, the form that holds a document in a row."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("position", "value"))), lambda r: r["value"])
    return records.groupBy("docid").agg(F.array_join(lines, RECORD).alias("records")).select("docid", F.concat(F.col("docid").cast("string"), F.lit(DOCID), F.col("records")).alias("value"))


def format_mention_documents(documents: DataFrame, offsets: DataFrame, mentions: DataFrame) -> DataFrame:
    """Document lines with sentence offsets and mentions. documents: docid, value; offsets: docid, sentid, offset;
    mentions: docid, key_text, key_start, text, start."""
    field = lambda t, s: F.concat(F.col(t), F.lit(MFIELD), F.col(s).cast("string"))
    chains = mentions.groupBy("docid", field("key_text", "key_start").alias("key")).agg(F.array_sort(F.collect_list(F.struct("start", "text"))).alias("xs"))
    values = F.array_join(F.transform("xs", lambda x: F.concat(x["text"], F.lit(MFIELD), x["start"].cast("string"))), MENTION)
    each = chains.groupBy("docid").agg(F.array_join(F.array_sort(F.collect_list(F.concat("key", F.lit(VAL), values))), KEYVAL).alias("mentions"))
    places = offsets.groupBy("docid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sentid", "offset"))), lambda x: x["offset"].cast("string")), ",").alias("offsets"))
    rows = documents.join(places, "docid", "left").join(each, "docid", "left")
    return rows.select("docid", F.concat_ws(TDOC, "value", F.coalesce("offsets", F.lit("")), F.coalesce("mentions", F.lit(""))).alias("value"))


def parse_mentions(lines: DataFrame) -> DataFrame:
    """Documents with mentions: docid, chain_id (place of the chain), key_text, key_start, text, start, end.

    A chain is a key mention and the list of its mentions. Malformed mentions drop, chains with a malformed key drop,
    and of chains with one key the last counts."""
    doc, mentions = _part(F.col("value"), TDOC, 1), _part(F.col("value"), TDOC, 3)
    chains = F.transform(F.split(mentions, KEYVAL, -1), lambda c, i: F.struct(i.alias("i"), F.get(F.split(c, VAL, -1), 0).alias("key"), F.get(F.split(c, VAL, -1), 1).alias("list")))
    rows = lines.select(F.split(doc, DOCID)[0].alias("docid"), chains.alias("chains"))
    last = F.filter("chains", lambda c: c["list"].isNotNull() & ~F.exists("chains", lambda d: (d["i"] > c["i"]) & (d["key"] == c["key"]) & d["list"].isNotNull()))
    number = lambda m: F.trim(F.get(F.split(m, MFIELD, -1), 1)).try_cast("int")
    good = lambda m: (F.size(F.split(m, MFIELD, -1)) == 2) & number(m).isNotNull()
    each = rows.select("docid", F.explode(last).alias("c")).where(good(F.col("c.key"))).select("docid", "c.i", "c.key", F.explode(F.split("c.list", MENTION, -1)).alias("m")).where(good(F.col("m")))
    text = lambda m: F.get(F.split(m, MFIELD, -1), 0)
    return each.select("docid", F.col("i").alias("chain_id"), text("key").alias("key_text"), number("key").alias("key_start"), text("m").alias("text"), number("m").alias("start"), (number("m") + F.length(text("m"))).alias("end"))


def parse_offsets(lines: DataFrame) -> DataFrame:
    """docid, position, offset of the sentences of documents with mentions."""
    doc, offsets = _part(F.col("value"), TDOC, 1), _part(F.col("value"), TDOC, 2)
    return lines.select(F.split(doc, DOCID)[0].alias("docid"), F.posexplode(F.split(offsets, ",")).alias("position", "o")).select("docid", "position", F.col("o").try_cast("int").alias("offset")).where("offset is not null")


def format_tuples(tuples: DataFrame) -> DataFrame:
    """a1, rel, a2, hashes, sentences, ids, heads1, heads2, n as TAB lines."""
    return tuples.select(F.struct(*TUPLE).alias("t"), "n").select(F.concat_ws("\t", tuple_text("t"), F.col("n").cast("string")).alias("value"))


def parse_tuples(lines: DataFrame) -> DataFrame:
    """The inverse; lines without a count or with fewer than six fields drop; hashes that are no numbers are -1."""
    body, n = (F.regexp_extract("value", "^(.*)\t([0-9]+)$", k) for k in (1, 2))
    rows = lines.select(tuple_of_text(body).alias("t"), n.try_cast("bigint").alias("n"))
    return rows.where("n is not null and t is not null").select("t.*", "n")


TUPLE = ("a1", "rel", "a2", "hashes", "sentences", "ids", "heads1", "heads2")


def tuple_text(t: str) -> Column:
    """A struct a1, rel, a2, hashes, sentences, ids, heads1, heads2 as TAB fields."""
    c = lambda n: F.col(f"{t}.{n}")
    return F.concat_ws("\t", c("a1"), c("rel"), c("a2"), F.array_join(c("hashes").cast("array<string>"), ","), F.array_join(c("sentences"), SENT), F.array_join(c("ids"), ","), counts_text(c("heads1")), counts_text(c("heads2")))


def tuple_of_text(text: Column) -> Column:
    """The inverse; null for fewer than six fields."""
    p = F.split(text, "\t", -1)
    at = lambda k: F.coalesce(F.get(p, k), F.lit(""))
    listed = lambda c, sep: F.filter(F.split(c, sep), lambda t: t != "")
    fields = F.struct(
        at(0).alias("a1"), at(1).alias("rel"), at(2).alias("a2"), F.transform(listed(at(3), ","), lambda h: F.coalesce(h.try_cast("int"), F.lit(-1))).alias("hashes"),
        listed(at(4), SENT).alias("sentences"), listed(at(5), ",").alias("ids"), counts_of_text(at(6)).alias("heads1"), counts_of_text(at(7)).alias("heads2"),
    )
    return F.when(F.size(p) >= 6, fields)


def lean_text(a1: str, rel: str, a2: str, hashes: str, sentences: str, ids: str) -> Column:
    """The short form of a tuple: ten hashes, one sentence and ten ids at most, without heads."""
    return F.concat_ws("\t", a1, rel, a2, F.array_join(F.slice(F.col(hashes).cast("array<string>"), 1, 10), ","), F.array_join(F.slice(sentences, 1, 1), SENT), F.array_join(F.slice(ids, 1, 10), ","))


HEADS = ("f1_heads", "f2_heads", "s1_heads", "s2_heads")


def _pair_text() -> Column:
    pair = F.concat(tuple_text("first"), F.lit(PAIR), tuple_text("second"))
    return F.concat_ws(PAIR_COUNTS, pair, window_counts_text(F.col("counts")), F.concat_ws("\t", *[counts_text(F.col(h)) for h in HEADS]))


def _read_pair(lines: DataFrame, text: Column) -> DataFrame:
    """lines plus first, second, counts and the four maps of heads; lines with a missing part drop."""
    parts = F.split(text, PAIR_COUNTS, -1)
    rows = lines.where(F.size(parts) > 2).withColumn("parts_", parts)
    both, heads = F.split(F.get("parts_", 0), PAIR, -1), F.split(F.get("parts_", 2), "\t", -1)
    rows = rows.where((F.size(both) > 1) & (F.size(heads) >= 4)).withColumns({"first": tuple_of_text(F.get(both, 0)), "second": tuple_of_text(F.get(both, 1)), "counts": window_counts_of_text(F.get("parts_", 1))})
    rows = rows.withColumns({h: counts_of_text(F.get(heads, k)) for k, h in enumerate(HEADS)})
    return rows.where(F.col("first").isNotNull() & F.col("second").isNotNull()).drop("parts_")


def format_pairs(pairs: DataFrame) -> DataFrame:
    """first, second, counts (window to count) and four maps of heads as lines."""
    return pairs.select(_pair_text().alias("value"))


def parse_pairs(lines: DataFrame) -> DataFrame:
    return _read_pair(lines, F.col("value")).drop("value")


def format_measures(pairs: DataFrame) -> DataFrame:
    """The columns of pairs, biterm (window to undirected count), nf, ns."""
    und = F.concat(_pair_text(), F.lit(UNDIRECTED), window_counts_text(F.col("biterm")))
    return pairs.select(F.concat_ws(MEASURES, und, F.col("nf").cast("string"), F.col("ns").cast("string")).alias("value"))


def parse_measures(lines: DataFrame) -> DataFrame:
    """Pairs with undirected counts; nf and ns are 0 where a line has none, so lines of undirected counts alone will do."""
    whole = F.split("value", MEASURES, -1)
    und = F.split(F.get(whole, 0), UNDIRECTED, -1)
    count = lambda k: number_or(F.get(whole, k), "bigint", 0)
    rows = lines.where(F.size(und) > 1).withColumns({"text_": F.get(und, 0), "biterm": window_counts_of_text(F.get(und, 1)), "nf": count(1), "ns": count(2)})
    return _read_pair(rows, F.col("text_")).drop("value", "text_")


def format_affinities(rows: DataFrame, names: tuple[str, ...] = ("und_first", "dir_first", "und_second", "dir_second")) -> DataFrame:
    """For each name a struct windows (array of double), combined (double)."""
    one = lambda n: F.concat(F.array_join(F.col(f"{n}.windows").cast("array<string>"), ","), F.lit(WINDOWED), F.format_string("%.8f", f"{n}.combined"))
    return rows.select(F.concat_ws(AFFINITY, *[one(n) for n in names]).alias("value"))


def parse_affinities(lines: DataFrame, names: tuple[str, ...] = ("und_first", "dir_first", "und_second", "dir_second")) -> DataFrame:
    """The inverse. Lines without four parts of two fields drop; windows that are no numbers are left out."""
    parts = F.split("value", AFFINITY, -1)
    rows = lines.where((F.size(parts) == 4) & F.forall(parts, lambda p: F.get(F.split(p, WINDOWED, -1), 1).try_cast("double").isNotNull()))
    numbers = lambda p: F.filter(F.transform(F.split(F.split(p, WINDOWED)[0], ","), lambda x: x.try_cast("double")), lambda x: x.isNotNull())
    return rows.select(*[F.struct(numbers(F.get(parts, k)).alias("windows"), F.get(F.split(F.get(parts, k), WINDOWED), 1).try_cast("double").alias("combined")).alias(n) for k, n in enumerate(names)])


KEY = ("f1", "fr", "f2", "s1", "sr", "s2")
_LABELS = ("first_bad", "second_bad", "label")


def _read_tagged(lines: DataFrame, text: Column) -> DataFrame:
    p = F.split(text, "\t", -1)
    rows = lines.where(F.size(p) >= 9)
    return rows.withColumns({c: F.get(p, k) for k, c in enumerate(KEY)} | {c: number_or(F.get(p, 6 + k), "int", 0) for k, c in enumerate(_LABELS)})


def parse_hand_labels(lines: DataFrame) -> DataFrame:
    """TAB lines of a labelled table: a tuple with its instances, three labels, the other tuple, counts, a conditional.
    Lines of fewer than eighteen fields drop; labels that are no numbers are 0."""
    p = F.split("value", "\t", -1)
    fields = dict(zip(KEY, (0, 2, 3, 8, 10, 11), strict=True))
    rows = lines.where(F.size(p) >= 18)
    numbers = {c: number_or(F.get(p, k), "int", 0) for c, k in zip((*_LABELS, "biterm", "bigram", "nf", "ns"), (5, 6, 7, 13, 14, 15, 16), strict=True)}
    return rows.select(*[F.get(p, k).alias(c) for c, k in fields.items()], *[v.alias(c) for c, v in numbers.items()], number_or(F.get(p, 17), "double", 0).alias("conditional"))


def parse_tagged(lines: DataFrame) -> DataFrame:
    """TAB lines of six tuple fields and three labels."""
    return _read_tagged(lines, F.col("value")).drop("value")


def _tagged_text() -> Column:
    return F.concat_ws("\t", *KEY, *[F.col(c).cast("string") for c in _LABELS])


def format_tagged(rows: DataFrame) -> DataFrame:
    return rows.select(_tagged_text().alias("value"))


def format_tagged_counts(rows: DataFrame, score: str | None = None) -> DataFrame:
    """Tagged pairs with biterm and counts (window to count), nf, ns, and a score before them if named."""
    text = F.concat_ws(TAGGED, _tagged_text(), window_counts_text(F.col("biterm")), window_counts_text(F.col("counts")), F.col("nf").cast("string"), F.col("ns").cast("string"))
    return rows.select((F.concat_ws("\t", F.col(score).cast("string"), text) if score else text).alias("value"))


def parse_tagged_counts(lines: DataFrame, scored: bool = False) -> DataFrame:
    """The inverse; lines without exactly five parts, or with counts (or a score) that are no numbers, drop."""
    rows = lines
    if scored:
        rows = rows.withColumn("score", F.get(first_rest(F.col("value")), 0).try_cast("double")).where("score is not null").withColumn("value", F.get(first_rest(F.col("value")), 1))
    parts = F.split("value", TAGGED, -1)
    rows = rows.where(F.size(parts) == 5).withColumns({"text_": F.get(parts, 0), "biterm": window_counts_of_text(F.get(parts, 1)), "counts": window_counts_of_text(F.get(parts, 2)), "nf": F.get(parts, 3).try_cast("int"), "ns": F.get(parts, 4).try_cast("int")})
    return _read_tagged(rows.where("nf is not null and ns is not null"), F.col("text_")).drop("value", "text_")


def parse_annotated(lines: DataFrame) -> DataFrame:
    """Nine TAB fields: place of the tuple, four confidences, label, tuple. Lines with a missing number drop."""
    p = F.split("value", "\t", -1)
    numbers = {c: F.get(p, k + 1).try_cast("double") for k, c in enumerate(("median", "most", "least", "mean"))} | {"label": F.get(p, 5).try_cast("int")}
    rows = lines.where(F.size(p) >= 9).select(F.get(p, 0).alias("place"), *[v.alias(c) for c, v in numbers.items()], F.get(p, 6).alias("arg1"), F.get(p, 7).alias("rel"), F.get(p, 8).alias("arg2"))
    return rows.dropna(subset=list(numbers))


def parse_scored_tuples(lines: DataFrame) -> DataFrame:
    """Six TAB fields: a score, two more numbers, a tuple."""
    p = F.split("value", "\t", 6)
    return lines.where(F.size(p) == 6).select(F.get(p, 0).try_cast("double").alias("score"), F.get(p, 3).alias("arg1"), F.get(p, 4).alias("rel"), F.get(p, 5).alias("arg2")).where("score is not null")


def _typed(arg: Column) -> Column:
    return F.when(arg.contains(":"), F.concat(F.lit("type:"), F.split(arg, ":")[0])).otherwise(arg)


def graph_edges(pairs: DataFrame, last: int = 10) -> DataFrame:
    """t1, t2, window 1..last, cnt: cumulative counts of the graph of parsed pairs. Arguments with a colon become their types."""
    name = lambda t: F.concat_ws("|", _typed(F.col(f"{t}.a1")), F.col(f"{t}.rel"), _typed(F.col(f"{t}.a2")))
    each = pairs.select(name("first").alias("t1"), name("second").alias("t2"), F.explode("counts").alias("at", "cnt"))
    return _cumulated(each, last)


def graph_edges_flat(lines: DataFrame, last: int = 10) -> DataFrame:
    """The same from TAB lines of two tuples with the counts in field 8; arguments stay as they are."""
    p = F.split("value", "\t", -1)
    rows = lines.where(F.size(p) > 8).select(F.array_join(F.slice(p, 1, 3), "|").alias("t1"), F.array_join(F.slice(p, 4, 3), "|").alias("t2"), F.explode(window_counts_of_text(F.get(p, 8))).alias("at", "cnt"))
    return _cumulated(rows, last)


def _cumulated(each: DataFrame, last: int) -> DataFrame:
    sums = [F.struct(F.lit(w).alias("window"), F.coalesce(F.sum(F.when(F.col("at") <= w, F.col("cnt"))), F.lit(0)).alias("cnt")) for w in range(1, last + 1)]
    return each.groupBy("t1", "t2").agg(F.array(*sums).alias("x")).select("t1", "t2", F.explode("x").alias("x")).select("t1", "t2", "x.window", "x.cnt")


def typed_variants(tuples: DataFrame) -> DataFrame:
    """arg1, rel, arg2, arg1_types, arg2_types: each tuple with its first, its second, and both arguments as types;
    variants of an argument without a type are left out."""
    kind = lambda c: F.concat(F.lit("type:"), F.split(F.col(c), ":")[0])
    has = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    v = lambda ok, a, b: F.when(ok, F.struct(a.alias("arg1"), F.col("rel"), b.alias("arg2")))
    a, b, x, y = F.col("arg1"), F.col("arg2"), kind("arg1_types"), kind("arg2_types")
    all_ = F.array(v(has("arg1_types"), x, b), v(has("arg2_types"), a, y), v(has("arg1_types") & has("arg2_types"), x, y))
    return tuples.select(F.explode(F.filter(all_, lambda t: t.isNotNull())).alias("t")).select("t.arg1", "t.rel", "t.arg2")


def read_app_directory(spark: SparkSession, path: str, recursive: bool = False, stand_in: bool = False) -> DataFrame:
    """A file a document: app lines with the document id of the file's first line, and an extrid that numbers all lines
    and goes on over files. Bad lines drop, or with `stand_in` are rows of "NA" in their places."""
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    lines = reader.text(path).withColumns({"file": F.input_file_name(), "line": F.monotonically_increasing_id()})
    ids = lines.groupBy("file").agg(F.min_by(F.split("value", "\\|")[0], "line").alias("first_id"))
    rows = parse_app_lines(gapless(lines, [F.col("file"), F.col("line")], "extrid"), "file", "extrid", stand_in=stand_in).join(ids, "file")
    return rows.withColumn("docid", F.col("first_id")).drop("first_id", "file")


def project_fields(spark: SparkSession, path: str, fields: list[int], sep: str = ",", joined: str = " ") -> DataFrame:
    """Some fields of delimited lines, joined."""
    p = F.split("value", sep, -1)
    return spark.read.text(path).select(F.concat_ws(joined, *[F.get(p, k) for k in fields]).alias("value"))


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """'|' files of eight fields; one malformed line rejects its whole file, blank lines are skipped."""
    rows = spark.read.text(path).where(F.trim("value") != "").withColumn("file", F.input_file_name())
    p = F.split("value", "\\|", -1)
    bad = rows.where(F.size(p) != 8).select("file").distinct()
    names = ("arg1", "arg1_norm", "arg1_types", "rel", "rel_norm", "arg2", "arg2_norm", "arg2_types")
    return rows.join(bad, "file", "left_anti").select("file", *[F.lower(F.trim(F.get(p, i))).alias(n) for i, n in enumerate(names)])


def grep(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Lines that match a regular expression."""
    return spark.read.text(path).where(F.col("value").rlike(pattern))


def write_text(lines: DataFrame, path: str) -> None:
    """One text line a row; column value."""
    lines.select("value").write.text(path)


def pairs_index(combined: DataFrame, least_und: int = 0, verbs_only: bool = False) -> DataFrame:
    """The nine fields of an indexed pair: id, six of the tuples, its counts and its measures as text."""
    rows = combined.where(F.col("max_und") >= least_und)
    if verbs_only:  # both relations of one token
        rows = rows.where((F.size(F.split("fr", " ")) <= 1) & (F.size(F.split("sr", " ")) <= 1))
    counts = F.concat_ws(MEASURES, *[F.col(c).cast("string") for c in ("max_dir", "max_und", "und_k", "nf", "ns")])
    affinities = F.concat_ws(AFFINITY, *[F.format_string("%.8f", c) for c in ("und_first", "dir_first", "und_second", "dir_second")])
    return rows.select(F.xxhash64(*KEY).alias("id"), *KEY, counts.alias("serialize"), affinities.alias("affinities"))


def records_index(records: DataFrame) -> DataFrame:
    """The twelve fields of an indexed record."""
    listed = lambda c: F.array_join(c, ",").alias(c)
    text = lambda c: F.col(c).cast("string").alias(c)
    return records.select(F.xxhash64("docid", "sentid", "extrid").alias("id"), text("docid"), "sentid", "extrid", "sentence", "arg1", listed("arg1types"), "rel", "arg2", listed("arg2types"), "confidence", F.lower("rel").alias("rel_lower"))


def write_index(rows: DataFrame, path: str, by: str = "fr", then: str = "s1") -> None:
    """A search index: Parquet files in the order of a relation and one column more, so that statistics of files and row
    groups prune. Ranges take both columns and the rest of the row, so a common relation is spread over many files."""
    order = [by, *[c for c in (then, "id") if c in rows.columns]]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)


def read_pairs_index(spark: SparkSession, path: str) -> DataFrame:
    """The index with its counts and measures as columns; filters on the six fields reach the files."""
    p, a = F.split("serialize", MEASURES, -1), F.split("affinities", AFFINITY, -1)
    rows = spark.read.parquet(path)
    numbers = {c: F.get(p, k).cast("bigint") for k, c in enumerate(("max_dir", "max_und", "und_k", "nf", "ns"))}
    measures = {c: F.get(a, k).cast("double") for k, c in enumerate(("und_first", "dir_first", "und_second", "dir_second"))}
    return rows.withColumns(numbers | measures).drop("serialize", "affinities")
