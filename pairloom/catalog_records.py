"""Registered queries over record lines, documents, mentions, payloads and indexes, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.catalog import QUERIES, SQL, _BAND, _KEY, _VALID, _VERB, W, _comb, _comb_sql, _dir, _hash_sql, _num, _num_sql, _query, _r, _rec_sql, _und_counts
from pairloom.functions import text as T
from pairloom.operators import counting as N
from pairloom.operators import extraction as X
from pairloom.operators import measures as M
from pairloom.operators import pairs as P
from pairloom.operators import ranking as K
from pairloom.operators import records as R
from pairloom.operators import tuning as U
from pairloom.session import shared_path as folder
from pairloom.session import stored
from pairloom.sources import codecs as C
from pairloom.sources.adapters import RAW_SQL, raw_records, records



# --- places in sentences, app lines, record lines ----------------------------------------------


def _lcs(s: str, a: str) -> str:
    """Place of the longest common substring, as a struct (n, p): its length, and minus its first place from 0."""
    subs = f"flatten(list_transform(range(1, length({a}) + 1), lambda i: list_transform(range(1, length({a}) - i + 2), lambda l: {{'n': CAST(l AS INTEGER), 'p': CAST(1 - strpos({s}, substring({a}, CAST(i AS INTEGER), CAST(l AS INTEGER))) AS INTEGER)}})))"
    return f"list_sort(list_filter({subs}, lambda x: x.p < 1))[-1]"


_PLACED = f"""placed AS (SELECT * EXCLUDE (x1, x2, x3), coalesce(-x1.p, 0) AS arg1_start, coalesce(-x1.p + x1.n, 0) AS arg1_end, coalesce(-x2.p, 0) AS rel_start, coalesce(-x2.p + x2.n, 0) AS rel_end, coalesce(-x3.p, 0) AS arg2_start, coalesce(-x3.p + x3.n, 0) AS arg2_end
    FROM (SELECT *, {_lcs('sentence', 'arg1')} AS x1, {_lcs('sentence', 'rel')} AS x2, {_lcs('sentence', 'arg2')} AS x3 FROM rec))"""
_SPANS = "arg1_start, arg1_end, rel_start, rel_end, arg2_start, arg2_end"


def _apps(s, d) -> DataFrame:
    return records(s, d).withColumns({"arg1head": F.col("arg1"), "relhead": F.col("rel"), "arg2head": F.col("arg2")})


def _spans(df: DataFrame) -> list:
    return [F.col(f"{c}.{e}").cast("int").alias(f"{c}_{e}") for c in ("arg1", "rel", "arg2") for e in ("start", "end")]


def _placed(s, d) -> DataFrame:
    """Numbered records with the places of their parts."""
    r = records(s, d)
    for c in ("arg1", "rel", "arg2"):
        r = r.withColumn("span_", T.common_span(F.col("sentence"), F.col(c))).withColumns({f"{c}_start": F.col("span_.start").cast("int"), f"{c}_end": F.col("span_.end").cast("int")}).drop("span_")
    return r


def _app_records(s, d):
    lines = C.format_app_lines(_apps(s, d)).withColumn("extrid", F.lit(0))
    got = X.located(C.parse_app_lines(lines, "extrid"))
    return got.select("docid", F.col("sentid").cast("bigint").alias("sentid"), "sentence", *_spans(got), F.col("arg1Head.text").alias("head"), F.size("hashes").cast("bigint").alias("n_hashes"), "confidence")


_query("app_records", _rec_sql(f"SELECT CAST(docid AS VARCHAR) AS docid, sentid, sentence, {_SPANS}, arg1 AS head, 1 AS n_hashes, CAST(-1 AS DOUBLE) AS confidence FROM placed", _PLACED))(_app_records)
_query("app_lines_with_stand_ins", _rec_sql("SELECT CASE WHEN rid % 5 = 0 THEN 'NA' ELSE CAST(docid AS VARCHAR) END AS docid, CAST(CASE WHEN rid % 5 = 0 THEN -1 ELSE sentid END AS INTEGER) AS sentid, CASE WHEN rid % 5 = 0 THEN 'NA' ELSE rel END AS rel, count(*) AS n FROM rec GROUP BY ALL"))(
    lambda s, d: C.parse_app_lines(C.format_app_lines(_apps(s, d).withColumn("sentid", F.when(F.col("rid") % 5 != 0, F.col("sentid").cast("string")).otherwise("bad"))), stand_in=True).groupBy("docid", "sentid", "rel").agg(F.count("*").alias("n"))
)


def _files(s, d, rows: DataFrame) -> str:
    """Record texts as a folder of files, one a document (column file), in nested folders."""
    path = folder(s, "files")
    rows.repartitionByRange("file").sortWithinPartitions("file", "position").select("file", "value").write.partitionBy("file").text(path)
    return path


def _directory(s, d):
    lines = C.format_app_lines(a := _apps(s, d).where("docid % 5 = 0")).selectExpr("value", "split(value, '[|]')[0] AS file", "split(value, '[|]')[1] AS position")
    got = C.read_app_directory(s, _files(s, d, lines), recursive=True)
    n = got.agg(F.max("extrid") - F.min("extrid") + 1).first()[0]
    return got.groupBy("docid").agg(F.count("*").alias("n"), F.lit(n).alias("numbered"), F.count_distinct("sentid").alias("sentences"))


_query("app_directory", _rec_sql("SELECT CAST(docid AS VARCHAR) AS docid, count(*) AS n, (SELECT count(*) FROM rec WHERE docid % 5 = 0) AS numbered, count(DISTINCT sentid) AS sentences FROM rec WHERE docid % 5 = 0 GROUP BY docid"))(_directory)


def _whole_records(s, d) -> DataFrame:
    """Records in the nested form, with confidences."""
    got = X.located(_apps(s, d))
    conf = records(s, d).select("docid", F.col("sentid").alias("s_"), F.col("extrid").alias("x_"), F.col("confidence").alias("c_"))
    return got.join(conf.withColumnRenamed("docid", "d_"), (F.col("docid") == F.col("d_")) & (F.col("sentid") == F.col("s_")) & (F.col("extrid") == F.col("x_"))).withColumn("confidence", F.col("c_")).drop("d_", "s_", "x_", "c_")


def _flat_record(df: DataFrame) -> DataFrame:
    return df.select(F.col("docid").cast("bigint").alias("docid"), F.col("sentid").cast("bigint").alias("sentid"), F.col("extrid").cast("bigint").alias("extrid"), "sentence", F.col("hashes")[0].alias("hash"), *_spans(df), F.col("rel.text").alias("rel"), F.col("arg2Head.text").alias("head"), F.array_join("arg1Types", ",").alias("types1"), F.array_join("arg2Types", ",").alias("types2"), "confidence")


_RECORD = f"SELECT docid, sentid, extrid, sentence, {_hash_sql('sentence')} AS hash, {_SPANS}, rel, arg2 AS head, array_to_string(arg1types, ',') AS types1, array_to_string(arg2types, ',') AS types2, confidence FROM placed"
_query("record_lines", _rec_sql(_RECORD, _PLACED))(lambda s, d: _flat_record(C.parse_records(C.format_records(_whole_records(s, d)))))


def _document_lines(s, d) -> DataFrame:
    r = _whole_records(s, d)
    lines = C.format_records(r).withColumns({"docid": F.split("value", "\t")[0], "position": F.struct(F.split("value", "\t")[1].cast("int").alias("s"), F.split("value", "\t")[3].cast("int").alias("x"))})
    return C.format_documents(lines)


_query("document_lines", _rec_sql(_RECORD, _PLACED))(lambda s, d: _flat_record(C.parse_records(C.parse_documents(_document_lines(s, d).select("value")).select("value"))))

# --- mentions and coreference ------------------------------------------------------------------
_OFFSETS = """offs AS (SELECT docid, sentid, CAST(coalesce(sum(length(sentence) + 1) OVER (PARTITION BY docid ORDER BY sentid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
    FROM (SELECT docid, sentid, arg_max(sentence, {'x': extrid, 'r': rid}) AS sentence FROM rec GROUP BY docid, sentid))"""
#: Mentions around the first argument, longer by up to three characters; five chains a document.
_MENTIONS = """ment AS (SELECT docid, rid % 5 AS chain_id, substring(sentence, 1, CAST(length(arg1) + rid % 4 AS INTEGER)) AS text, "offset" AS "start" FROM rec JOIN offs USING (docid, sentid) WHERE rid % 3 > 0)"""


def _mentions(s, d) -> DataFrame:
    r = records(s, d)
    m = r.join(R.sentence_offsets(r), ["docid", "sentid"]).where("rid % 3 > 0")
    return m.select("docid", (F.col("rid") % 5).alias("chain_id"), F.expr("substring(sentence, 1, cast(length(arg1) + rid % 4 as int))").alias("text"), F.col("offset").alias("start"))


_query("record_offsets", _rec_sql("SELECT * FROM offs", _OFFSETS))(lambda s, d: R.sentence_offsets(records(s, d)))


def _mention_lines(s, d):
    m = _mentions(s, d)
    key = m.groupBy("docid", "chain_id").agg(F.min(F.struct("start", "text")).alias("k"))
    m = m.join(key, ["docid", "chain_id"]).select("docid", F.col("k.text").alias("key_text"), F.col("k.start").alias("key_start"), "text", "start")
    docs = _document_lines(s, d).withColumn("docid", F.col("docid").cast("bigint"))
    # A chain written twice: the first time with a mention that must go.
    lines = C.format_mention_documents(docs, R.sentence_offsets(records(s, d)), m).withColumn("value", F.regexp_replace("value", f"({C.TDOC}[0-9,]*{C.TDOC})([^_]+{C.MFIELD}[0-9]+)(?={C.VAL})", f"$1$2{C.VAL}gone{C.MFIELD}1{C.KEYVAL}bad{C.KEYVAL}$2"))
    got = C.parse_mentions(lines)
    return got.select(F.col("docid").cast("bigint").alias("docid"), "key_text", F.col("key_start").cast("bigint").alias("key_start"), "text", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"))


_query("mention_lines", _rec_sql("""SELECT m.docid, k.text AS key_text, k."start" AS key_start, m.text, m."start", m."start" + length(m.text) AS "end" FROM ment m JOIN (SELECT docid, chain_id, min({'start': "start", 'text': text}) AS k FROM ment GROUP BY ALL) USING (docid, chain_id)""", _OFFSETS, _MENTIONS))(_mention_lines)


def _keyed(s, d) -> DataFrame:
    r = _placed(s, d)
    r = r.join(R.sentence_offsets(records(s, d)), ["docid", "sentid"]).drop("chain1", "chain2")
    m = _mentions(s, d).withColumn("end", F.col("start") + F.length("text"))
    moved = r.withColumns({f"arg{k}_{e}": F.col(f"arg{k}_{e}") + F.col("offset") for k in (1, 2) for e in ("start", "end")})
    return P.numbered(X.mention_keys(moved.drop("offset"), m).drop(*P.places(moved)))


#: Every argument's keys: its own text and place, and all mentions of the chains that have one around it.
_KEYED = """heads AS (SELECT docid, rid, 1 AS k, lower(arg1) AS head, arg1_start + "offset" AS s, arg1_end + "offset" AS e FROM placed JOIN offs USING (docid, sentid) UNION ALL SELECT docid, rid, 2, lower(arg2), arg2_start + "offset", arg2_end + "offset" FROM placed JOIN offs USING (docid, sentid)),
chainkeys AS (SELECT docid, chain_id, list(DISTINCT lower(text) || ':' || "start" || '-' || ("start" + length(text))) AS keys FROM ment WHERE len(string_split(text, ' ')) <= 5 GROUP BY ALL),
hits AS (SELECT DISTINCT h.docid, rid, k, chain_id FROM heads h JOIN ment m ON h.docid = m.docid AND m."start" <= h.s AND h.e <= m."start" + length(m.text) WHERE len(string_split(m.text, ' ')) <= 5),
sets AS (SELECT docid, rid, list_distinct(flatten(list(keys) FILTER (k = 1))) AS c1, list_distinct(flatten(list(keys) FILTER (k = 2))) AS c2 FROM (SELECT docid, rid, k, [head || ':' || s || '-' || e] AS keys FROM heads UNION ALL SELECT docid, rid, k, keys FROM hits JOIN chainkeys USING (docid, chain_id)) GROUP BY docid, rid),
num2 AS (SELECT num.*, c1, c2 FROM num JOIN sets USING (docid, rid))"""
_ANY = lambda a, b: f"list_has_any(o.c{a}, i.c{b})"
_EQ2 = f"CASE WHEN {_ANY(1, 1)} THEN '11' WHEN {_ANY(1, 2)} THEN '12' WHEN {_ANY(2, 1)} THEN '21' WHEN {_ANY(2, 2)} THEN '22' END"
_BAND2 = _BAND.replace("FROM num o JOIN num i", "FROM num2 o JOIN num2 i")
_query(
    "coref_mentions_single",
    _num_sql(f"""SELECT docid, eq, CASE WHEN eq IN ('11', '12') THEN 'XVAR' ELSE x1 END AS f1, fr, CASE WHEN eq IN ('21', '22') THEN 'XVAR' ELSE x2 END AS f2, CASE WHEN eq IN ('11', '21') THEN 'XVAR' ELSE y1 END AS s1, sr, CASE WHEN eq IN ('12', '22') THEN 'XVAR' ELSE y2 END AS s2, dist
    FROM (SELECT o.docid, {_EQ2} AS eq, o.arg1 AS x1, o.rel AS fr, o.arg2 AS x2, i.arg1 AS y1, i.rel AS sr, i.arg2 AS y2, i.idx - o.idx AS dist {_BAND2}) WHERE eq IS NOT NULL""", _PLACED, _OFFSETS, _MENTIONS, _KEYED),
)(lambda s, d: P.coref_single(_keyed(s, d), W))


def _multiple_sql() -> str:
    names = ("x1", "x2", "y1", "y2")

    def case(k: int) -> str:
        arms = " ".join(f"WHEN bits = '{''.join(map(str, key))}' THEN " + (f"'{row[k]}VAR:' || lower({names[k]})" if row[k] else f"lower({names[k]})") for key, row in P.TABLE.items())
        return f"CASE {arms} ELSE 'XVAR:' || lower({names[k]}) END"

    bits = " || ".join(f"CASE WHEN {_ANY(a, b)} THEN '1' ELSE '0' END" for a, b in ((1, 1), (2, 2), (1, 2), (2, 1)))
    return _num_sql(f"""SELECT docid, {case(0)} AS f1, fr, {case(1)} AS f2, {case(2)} AS s1, sr, {case(3)} AS s2, dist FROM (SELECT o.docid, {bits} AS bits, o.arg1 AS x1, o.rel AS fr, o.arg2 AS x2, i.arg1 AS y1, i.rel AS sr, i.arg2 AS y2, i.idx - o.idx AS dist {_BAND2}) WHERE bits <> '0000'""", _PLACED, _OFFSETS, _MENTIONS, _KEYED)


_query("coref_mentions_multiple", _multiple_sql())(lambda s, d: P.coref_multiple(_keyed(s, d), W))

# --- what says the same ----------------------------------------------------------------------------
_INSIDE = lambda x, y: "(" + " AND ".join(f"{x}.{c}_start >= {y}.{c}_start AND {x}.{c}_end <= {y}.{c}_end" for c in ("arg1", "rel", "arg2")) + ")"
_SAID = """((o.arg1 = i.arg1 AND o.arg2 = i.arg2) OR (o.arg1 = i.arg2 AND o.arg2 = i.arg1) OR contains(o.say, i.say) OR contains(i.say, o.say) OR list_has_all(o.bag, i.bag) OR list_has_all(i.bag, o.bag))"""
_SAYS = "says AS (SELECT placed.*, arg1 || ' ' || regexp_replace(rel, '^be ', '') || ' ' || arg2 AS say, list_filter(string_split(arg1 || ' ' || rel || ' ' || arg2, ' '), lambda t: t <> 'be') AS bag FROM placed)"


def _beside(r: DataFrame) -> DataFrame:
    return r.alias("o").join(r.alias("i"), (F.col("o.docid") == F.col("i.docid")) & (F.col("o.sentid") == F.col("i.sentid")) & (F.col("o.rid") < F.col("i.rid")))


_query("span_subsumption", _rec_sql(f"SELECT o.docid, o.rid, i.rid AS other, {_INSIDE('o', 'i')} OR {_INSIDE('i', 'o')} AS inside, {_INSIDE('o', 'i')} OR {_INSIDE('i', 'o')} OR {_SAID} AS alike FROM says o JOIN says i ON o.docid = i.docid AND o.sentid = i.sentid AND o.rid < i.rid", _PLACED, _SAYS))(
    lambda s, d: _beside(_placed(s, d)).select("o.docid", "o.rid", F.col("i.rid").alias("other"), R.span_inside("o", "i").alias("inside"), R.subsumes("o", "i", True, True).alias("alike"))
)
_query("drop_redundant", _rec_sql(f"""SELECT o.docid, o.rid FROM says o WHERE NOT EXISTS (SELECT 1 FROM says i WHERE o.docid = i.docid AND o.sentid = i.sentid AND o.extrid <> i.extrid AND length(i.arg1 || i.rel || i.arg2) >= length(o.arg1 || o.rel || o.arg2) AND ({_INSIDE('o', 'i')} OR {_INSIDE('i', 'o')} OR {_SAID}))""", _PLACED, _SAYS))(
    lambda s, d: R.drop_redundant(_placed(s, d)).select("docid", "rid")
)
_WORDS = lambda c: f"list_filter(string_split({c}, ' '), lambda w: w <> 'be')"
_query("tuple_subsumption", _num_sql(f"""SELECT {_KEY}, contains(x, y) OR contains(y, x) OR list_has_all({_WORDS('y')}, {_WORDS('x')}) AS subsumed FROM (SELECT DISTINCT {_KEY}, f1 || ' ' || regexp_replace(fr, '^be ', '') || ' ' || f2 AS x, s1 || ' ' || regexp_replace(sr, '^be ', '') || ' ' || s2 AS y FROM dir)""", upto="near"))(
    lambda s, d: _dir(s, d).select(*P.KEY).distinct().select(*P.KEY, R.tuple_subsumes(P.KEY[:3], P.KEY[3:]).alias("subsumed"))
)

# --- filters that meet what they drop -----------------------------------------------------------------
_query(
    "record_prune",
    _rec_sql("""SELECT docid, rid, array_to_string(list_transform(string_split(rel, ' '), lambda t: CASE WHEN t IN ('has', 'have', 'had', 'having') THEN 'had' WHEN t IN ('be', 'is', 'was', 'are', 'were') THEN 'be' ELSE t END), ' ') AS rel,
    row_number() OVER (PARTITION BY docid ORDER BY sentid, extrid, rid) AS position FROM raw WHERE regexp_matches(arg1, '[a-zA-Z0-9]') AND regexp_matches(rel, '[a-zA-Z0-9]') AND regexp_matches(arg2, '[a-zA-Z0-9]') AND len(string_split(rel, ' ')) <= 7""", RAW_SQL),
)(lambda s, d: R.prune(raw_records(s, d)).select("docid", "rid", "rel", F.col("position").cast("bigint").alias("position")))
_query("drop_reporting", _rec_sql("SELECT docid, rid FROM raw WHERE rel NOT IN ('be', 'had', 'had had') AND NOT list_has_any(string_split(rel, ' '), ['say', 'said', 'saying', 'tell', 'told', 'speak', 'spoke'])", RAW_SQL))(lambda s, d: R.drop_reporting(raw_records(s, d)).select("docid", "rid"))


def _raw_tuples(s, d) -> DataFrame:
    return raw_records(s, d).groupBy(F.col("arg1").alias("a1"), "rel", F.col("arg2").alias("a2")).agg(F.count("*").alias("n"))


_RAWT = "rawt AS (SELECT arg1 AS a1, rel, arg2 AS a2, count(*) AS n FROM raw GROUP BY ALL)"
_query("stop_relations", _rec_sql("SELECT * FROM rawt WHERE rel NOT IN ('be', 'in', 'to', 'on')", RAW_SQL, _RAWT))(lambda s, d: M.stop_relations(_raw_tuples(s, d)))
_query("not_reporting", _rec_sql("SELECT * FROM rawt WHERE NOT starts_with(rel, 'say') AND NOT starts_with(rel, 'tell')", RAW_SQL, _RAWT))(lambda s, d: M.not_reporting(_raw_tuples(s, d)))
_query("valid_tuples", _rec_sql(f"SELECT * FROM rawt WHERE a1 NOT IN {T.PRONOUNS} AND a2 NOT IN {T.PRONOUNS} AND NOT regexp_matches(rel, '[^0-9a-zA-Z:]')", RAW_SQL, _RAWT))(lambda s, d: _raw_tuples(s, d).where(K.valid_tuple("a1", "rel", "a2")))
_query("exported_tuples", _rec_sql("SELECT a1, rel, a2, n FROM rawt WHERE n >= 5 AND NOT regexp_matches(a1, '[^0-9a-zA-Z:]') AND NOT regexp_matches(a2, '[^0-9a-zA-Z:]')", RAW_SQL, _RAWT))(lambda s, d: _raw_tuples(s, d).where(K.exportable(5, "n", "a1", "a2")))
_query("typed_tuples", _rec_sql("SELECT *, starts_with(b1, 'Type:') OR starts_with(a2, 'Type:') AS typed FROM (SELECT *, CASE WHEN n % 2 = 0 THEN 'Type:' || a1 ELSE a1 END AS b1 FROM rawt)", RAW_SQL, _RAWT))(
    lambda s, d: (t := _raw_tuples(s, d).withColumn("b1", F.expr("CASE WHEN n % 2 = 0 THEN concat('Type:', a1) ELSE a1 END"))).withColumn("typed", T.typed("b1", "a2"))
)
_query("top_relations_100", _rec_sql("SELECT rel || ' ' || (rid % 60) AS rel, count(DISTINCT docid) AS n_docs, count(*) AS n_records FROM rec GROUP BY 1 ORDER BY n_docs DESC, rel LIMIT 100"))(
    lambda s, d: K.top_relations(records(s, d).withColumn("rel", F.concat_ws(" ", "rel", (F.col("rid") % 60).cast("string"))), 100)
)
#: Pairs with pronouns, variables, quantities, and pairs that meet twice.
_ODD = """odd AS (SELECT * REPLACE (CASE s1 WHEN 'k3' THEN 'he' WHEN 'k5' THEN 'Type:quantity' WHEN 'k4' THEN 'XVAR:type:number' WHEN 'k6' THEN 'k2' ELSE s1 END AS s1, CASE WHEN f2 = 'low' THEN 'XVAR:type:time_unit' WHEN f2 = 'mid' THEN 'XVAR:type:number:Number' ELSE f2 END AS f2) FROM comb)"""


def _odd(s, d) -> DataFrame:
    s1 = F.expr("CASE s1 WHEN 'k3' THEN 'he' WHEN 'k5' THEN 'Type:quantity' WHEN 'k4' THEN 'XVAR:type:number' WHEN 'k6' THEN 'k2' ELSE s1 END")
    f2 = F.expr("CASE f2 WHEN 'low' THEN 'XVAR:type:time_unit' WHEN 'mid' THEN 'XVAR:type:number:Number' ELSE f2 END")
    return _comb(s, d).withColumns({"s1": s1, "f2": f2})


_TYPE = lambda a: f"replace(regexp_extract({a}, '^(.*?)[tT]ype:(.*)$', 2), ':Number', '')"
_VTYPE = lambda a, b: f"CASE WHEN contains({a}, 'XVAR') THEN {_TYPE(a)} WHEN contains({b}, 'XVAR') THEN {_TYPE(b)} ELSE '' END"
_TYPED = lambda a: f"regexp_matches({a}, '[tT]ype:')"
_PRUNED = lambda more: f"""SELECT {_KEY}, max(und_k) AS und_k FROM odd WHERE NOT (f1 = s1 AND fr = sr AND f2 = s2) AND und_k >= 3 AND {_VALID} AND {' AND '.join(f"trim({a}) NOT IN {T.VIEW_PRONOUNS} AND NOT contains({a}, 'Type:quantity')" for a in ('f1', 'f2', 's1', 's2'))} AND {_VTYPE('f1', 'f2')} = {_VTYPE('s1', 's2')}{more} GROUP BY {_KEY}"""
_HASVAR = "contains(concat_ws('|', f1, f2, s1, s2), 'XVAR')"
for _name, _args, _more in (
    ("prune_results", {"types": "notype"}, f" AND NOT {_TYPED('s1')} AND NOT {_TYPED('s2')}"), ("prune_results_typed", {"types": "type"}, f" AND {_TYPED('s1')} AND {_TYPED('s2')}"),
    ("prune_results_equality", {"equality": "equality"}, f" AND {_HASVAR}"), ("prune_results_plain", {"equality": "noequality"}, f" AND NOT {_HASVAR}"),
):
    _query(_name, _comb_sql(_PRUNED(_more), _ODD))(lambda s, d, a=_args: K.prune_results(_odd(s, d), 3, **a).select(*P.KEY, "und_k"))
_query("verb_only_tuples", _rec_sql(f"SELECT a1, {_VERB('rel')} AS rel, a2, CAST(sum(n) AS BIGINT) AS n FROM rawt GROUP BY ALL", RAW_SQL, _RAWT))(lambda s, d: P.verb_only_tuples(_raw_tuples(s, d)))

# --- hashes, folds, samples ------------------------------------------------------------------------------
_SENT_HASHES = f"list_sort(list_distinct(list_transform(list_concat([sentence], list_filter(string_split_regex(lower(sentence), '[.,!?:;]+'), lambda c: len(string_split(rtrim(c, ' '), ' ')) >= 5)), lambda c: {_hash_sql('c')})))"


def _lines(s, d) -> DataFrame:
    from pairloom.sources.adapters import sentences

    return sentences(s, d)


def _lines_sql(body: str) -> str:
    from pairloom.sources.adapters import SENT_SQL

    return f"WITH {SENT_SQL} {body}"


_query("clause_hashes", _lines_sql(f"SELECT docid, sentid, array_to_string({_SENT_HASHES}, ',') AS hashes FROM sent"))(
    lambda s, d: _lines(s, d).select("docid", "sentid", F.array_join(F.array_sort(T.sentence_hashes(F.col("sentence"))).cast("array<string>"), ",").alias("hashes"))
)
_query(
    "merge_pairs_disjoint",
    _rec_sql(f"""SELECT key, CAST(r.n AS BIGINT) AS n, r.kept AS n_docs FROM (SELECT key, list_reduce(list({{'n': cnt, 'h': [{_hash_sql('sentence')}, CAST(docid % 3 AS INTEGER)], 'kept': 1}} ORDER BY docid), lambda a, x: CASE WHEN list_has_any(a.h, x.h) THEN a ELSE {{'n': a.n + x.n, 'h': CASE WHEN len(a.h) < 100 THEN list_distinct(list_concat(a.h, x.h)) ELSE a.h END, 'kept': a.kept + 1}} END) AS r FROM
    (SELECT concat_ws(chr(9), arg1, rel, arg2) AS key, docid, count(*) AS cnt, min(sentence) AS sentence FROM rec GROUP BY 1, 2) GROUP BY key)"""),
)(
    lambda s, d: P.merge_disjoint(
        records(s, d).groupBy(F.concat_ws("\t", "arg1", "rel", "arg2").alias("key"), "docid").agg(F.count("*").alias("cnt"), F.min("sentence").alias("sentence"))
        .withColumn("hashes", F.array_distinct(F.concat(T.sentence_hashes(F.col("sentence")), F.array((F.col("docid") % 3).cast("int"))))).select("key", "docid", "cnt", "hashes")
    )
)
_query(
    "example_records",
    _rec_sql(f"""SELECT arg1, rel, arg2, unnest(r.out[1:5]) AS sentence FROM (SELECT arg1, rel, arg2, list_reduce(list({{'h': [{_hash_sql("sentence || ' ' || (docid % 9)")}], 'out': [sentence]}} ORDER BY confidence DESC, rid), lambda a, x: {{'h': list_distinct(list_concat(a.h, x.h)), 'out': CASE WHEN list_has_any(a.h, x.h) THEN a.out ELSE list_concat(a.out, x.out) END}}) AS r FROM rec GROUP BY ALL)"""),
)(lambda s, d: K.examples(records(s, d).withColumn("hashes", T.sentence_hashes(F.concat_ws(" ", "sentence", (F.col("docid") % 9).cast("string"))))))
_query(
    "bin_sample",
    _comb_sql("""SELECT f1, fr, f2, scp, bin FROM (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY md5(concat_ws('|', '1', f1, fr, f2)), f1, fr, f2) AS turn FROM (SELECT *, CAST((row_number() OVER (ORDER BY round(scp, 9) DESC, f1, fr, f2) - 1) // greatest(1, count(*) OVER () // 10) AS BIGINT) AS bin FROM top)) WHERE turn <= 5""",
              f"top AS (SELECT f1, fr, f2, round(sum(scp) FILTER (r <= 5), 6) AS scp FROM (SELECT *, row_number() OVER (PARTITION BY f1, fr, f2 ORDER BY round(scp, 9) DESC, s1, sr, s2) AS r FROM (SELECT * REPLACE (und_first * und_second AS scp) FROM comb WHERE {_VALID} AND max_und > 0)) GROUP BY f1, fr, f2)"),
)(lambda s, d: K.sample_bins(K.bins(_r(K.top_tuples(_comb(s, d), 5), "scp"), list(K.FIRST), "scp", 10), list(K.FIRST), 5).select(*K.FIRST, "scp", "bin"))

# --- pairs and tuples with their payload ---------------------------------------------------------------
NEAR = 3
_TEXT = lambda e, order="v": f"string_agg(v || ':' || n, ',' ORDER BY {order})"
_PAYLOAD = f"""numh AS (SELECT num.*, [{_hash_sql("sentence || ' ' || (docid % 9)")}] AS hashes, docid || '-' || sentid || '-' || extrid AS name FROM num),
gh AS (SELECT *, unnest(r2) AS g2 FROM (SELECT *, unnest(r1) AS g1 FROM numh)),
tp AS (SELECT docid, g1 AS a1, rel, g2 AS a2, count(*) AS n, arg_min(hashes, {{'i': idx, 'r': rid}}) AS hashes, list(name ORDER BY idx, rid)[1:5] AS ids FROM gh GROUP BY ALL),
th1 AS (SELECT docid, a1, rel, a2, list({{'v': v, 'n': n}} ORDER BY v) AS heads1 FROM (SELECT docid, g1 AS a1, rel, g2 AS a2, arg1 AS v, count(*) AS n FROM gh GROUP BY ALL) GROUP BY docid, a1, rel, a2),
pn AS (SELECT o.docid, o.rid, o.g1 AS f1, o.rel AS fr, o.g2 AS f2, i.g1 AS s1, i.rel AS sr, i.g2 AS s2, any_value(o.arg1) AS h1, min({{'d': i.idx - o.idx, 'r': i.rid, 'h': i.arg2}}) AS x {_BAND.replace('FROM num o JOIN num i', 'FROM gh o JOIN gh i').replace(f'BETWEEN 1 AND {W}', f'BETWEEN 1 AND {NEAR}')} GROUP BY ALL),
pc AS (SELECT docid, {_KEY}, list({{'v': v, 'n': n}} ORDER BY v) AS counts FROM (SELECT docid, {_KEY}, CAST(x.d AS VARCHAR) AS v, count(*) AS n FROM pn GROUP BY ALL) GROUP BY docid, {_KEY}),
ph1 AS (SELECT docid, {_KEY}, list({{'v': v, 'n': n}} ORDER BY v) AS f1_heads FROM (SELECT docid, {_KEY}, h1 AS v, count(*) AS n FROM pn GROUP BY ALL) GROUP BY docid, {_KEY}),
ph4 AS (SELECT docid, {_KEY}, list({{'v': v, 'n': n}} ORDER BY v) AS s2_heads FROM (SELECT docid, {_KEY}, x.h AS v, count(*) AS n FROM pn GROUP BY ALL) GROUP BY docid, {_KEY}),
pp AS (SELECT pc.*, f1_heads, s2_heads, f.hashes AS h1, s.hashes AS h2, f.ids AS ids1, s.ids AS ids2 FROM pc JOIN ph1 USING (docid, {_KEY}) JOIN ph4 USING (docid, {_KEY}) JOIN tp f ON f.docid = pc.docid AND f.a1 = f1 AND f.rel = fr AND f.a2 = f2 JOIN tp s ON s.docid = pc.docid AND s.a1 = s1 AND s.rel = sr AND s.a2 = s2)"""


def _fold(by: str, columns: dict[str, str], skip: str = "") -> str:
    """A left fold in the order of docid; columns: name to the expression of its next value over a and x."""
    start = ", ".join(f"'{c}': {c}" for c in columns)
    step = "{" + ", ".join(f"'{c}': {e}" for c, e in columns.items()) + "}"
    step = f"CASE WHEN {skip} THEN a ELSE {step} END" if skip else step
    return f"SELECT {by}, list_reduce(list({{{start}}} ORDER BY docid), lambda a, x: {step}) AS r FROM {{source}} GROUP BY {by}"


_UNION = lambda c, most: f"CASE WHEN len(a.{c}) < {most} THEN list_distinct(list_concat(a.{c}, x.{c})) ELSE a.{c} END"
_HEADS = lambda c: f"CASE WHEN len(list_distinct(list_transform(a.{c}, lambda e: e.v))) < 5 THEN list_concat(a.{c}, x.{c}) ELSE a.{c} END"
_MERGED = "merged AS (" + _fold(_KEY, {"n_docs": "a.n_docs + 1", "h1": _UNION("h1", 100), "h2": _UNION("h2", 100), "ids1": _UNION("ids1", 5), "counts": "list_concat(a.counts, x.counts)", "f1_heads": _HEADS("f1_heads"), "s2_heads": _HEADS("s2_heads")}, "list_has_any(a.h1, x.h1) OR list_has_any(a.h2, x.h2)").replace("{source}", "(SELECT *, 1 AS n_docs FROM pp)") + ")"
_SUMMED = lambda c: f"(SELECT {_KEY}, string_agg(v || ':' || n, ',' ORDER BY v) AS {c} FROM (SELECT {_KEY}, e.v AS v, CAST(sum(e.n) AS BIGINT) AS n FROM (SELECT {_KEY}, unnest(r.{c}) AS e FROM merged) GROUP BY ALL) GROUP BY {_KEY})"
_PAIRS_OUT = f"SELECT {_KEY}, r.n_docs AS n_docs, counts, f1_heads, s2_heads, array_to_string(list_sort(r.h1), ',') AS h1, array_to_string(list_sort(r.ids1), ',') AS ids1 FROM merged JOIN {_SUMMED('counts')} USING ({_KEY}) JOIN {_SUMMED('f1_heads')} USING ({_KEY}) JOIN {_SUMMED('s2_heads')} USING ({_KEY}) WHERE list_sum(list_transform(r.counts, lambda e: e.n)) > 1"


def _hashed(s, d) -> DataFrame:
    return _num(s, d).withColumn("hashes", T.sentence_hashes(F.concat_ws(" ", "sentence", (F.col("docid") % 9).cast("string"))))


def _shown(pairs: DataFrame) -> DataFrame:
    listed = lambda c: F.array_join(F.array_sort(c).cast("array<string>"), ",").alias(c)
    return pairs.select(*P.KEY, F.col("n_docs").cast("int").alias("n_docs"), *[X.entries_text(c).alias(c) for c in ("counts", "f1_heads", "s2_heads")], listed("h1"), listed("ids1"))


_query("extract_pairs", _num_sql(_PAIRS_OUT, _PAYLOAD, _MERGED))(lambda s, d: _shown(X.extract(_hashed(s, d), NEAR, 1)[0]()))
_TMERGED = "tmerged AS (" + _fold("a1, rel, a2", {"n": "a.n + x.n", "h": "a.h", "ids": "a.ids", "heads1": _HEADS("heads1")}).replace("{source}", "(SELECT *, hashes AS h FROM tp JOIN th1 USING (docid, a1, rel, a2))") + ")"
_TUPLES_OUT = """SELECT a1, rel, a2, CAST(r.n AS BIGINT) AS n, array_to_string(r.h, ',') AS hashes, array_to_string(r.ids, ',') AS ids, heads1 FROM tmerged JOIN (SELECT a1, rel, a2, string_agg(v || ':' || n, ',' ORDER BY v) AS heads1 FROM (SELECT a1, rel, a2, e.v AS v, CAST(sum(e.n) AS BIGINT) AS n FROM (SELECT a1, rel, a2, unnest(r.heads1) AS e FROM tmerged) GROUP BY ALL) GROUP BY a1, rel, a2) USING (a1, rel, a2)"""


def _tuples_shown(t: DataFrame) -> DataFrame:
    return t.select("a1", "rel", "a2", "n", F.array_join(F.col("hashes").cast("array<string>"), ",").alias("hashes"), F.array_join("ids", ",").alias("ids"), X.entries_text("heads1").alias("heads1"))


_query("extract_tuples", _num_sql(_TUPLES_OUT, _PAYLOAD, _TMERGED))(lambda s, d: _tuples_shown(X.extract(_hashed(s, d), NEAR)[1]()))
_query("merge_outputs", _num_sql("SELECT a1, rel, a2, CAST(sum(n) AS BIGINT) AS n FROM tp GROUP BY ALL", _PAYLOAD))(
    lambda s, d: P.merge_tuples((t := X.tuple_payload(_hashed(s, d))).where("docid % 2 = 0").groupBy("a1", "rel", "a2").agg(F.sum("n").alias("n")).unionByName(t.where("docid % 2 = 1").groupBy("a1", "rel", "a2").agg(F.sum("n").alias("n"))))
)


def _map(c: str):
    return F.map_from_entries(F.transform(c, lambda e: F.struct(e["v"], e["n"].cast("int"))))


def _pair_form(pairs: DataFrame) -> DataFrame:
    """Extracted pairs in the form of the text codec, with real payload."""
    none = F.create_map().cast("map<string,int>")
    side = lambda k, a, r, b: F.struct(F.col(a).alias("a1"), F.col(r).alias("rel"), F.col(b).alias("a2"), F.col(f"h{k}").alias("hashes"), F.col(f"sentences{k}").alias("sentences"), F.col(f"ids{k}").alias("ids"), none.alias("heads1"), none.alias("heads2"))
    counts = F.map_from_entries(F.transform("counts", lambda e: F.struct(e["v"].cast("int"), e["n"].cast("int"))))
    return pairs.select(side(1, *P.KEY[:3]).alias("first"), side(2, *P.KEY[3:]).alias("second"), counts.alias("counts"), *[_map(c).alias(c) for c in C.HEADS])


def _pair_lines(s, d) -> DataFrame:
    got = C.parse_pairs(C.format_pairs(_pair_form(X.extract(_hashed(s, d), NEAR, 1)[0]())))
    names = dict(zip(P.KEY, ("first.a1", "first.rel", "first.a2", "second.a1", "second.rel", "second.a2"), strict=True))
    entries = lambda c: F.array_join(F.transform(F.array_sort(F.transform(F.map_entries(c), lambda e: F.struct(e["key"].cast("string").alias("k"), e["value"].alias("v")))), lambda e: F.concat_ws(":", e["k"], e["v"].cast("string"))), ",").alias(c)
    return got.select(*[F.col(c).alias(k) for k, c in names.items()], *[entries(c) for c in ("counts", "f1_heads", "s2_heads")], F.array_join(F.array_sort("first.hashes").cast("array<string>"), ",").alias("h1"), F.array_join(F.array_sort("first.ids"), ",").alias("ids1"))


_query("pair_lines", _num_sql(_PAIRS_OUT.replace("r.n_docs AS n_docs, ", ""), _PAYLOAD, _MERGED))(_pair_lines)


def _tuple_lines(s, d) -> DataFrame:
    t = X.extract(_hashed(s, d), NEAR)[1]()
    got = C.parse_tuples(C.format_tuples(t.withColumns({"heads1": _map("heads1"), "heads2": _map("heads2")})))
    entries = F.transform(F.array_sort(F.map_entries("heads1")), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))
    return got.select("a1", "rel", "a2", "n", F.array_join(F.col("hashes").cast("array<string>"), ",").alias("hashes"), F.array_join("ids", ",").alias("ids"), F.array_join(entries, ",").alias("heads1"))


_query("tuple_lines", _num_sql(_TUPLES_OUT, _PAYLOAD, _TMERGED))(_tuple_lines)
_LEAN = "concat_ws(chr(9), a1, rel, a2, array_to_string(hashes[1:10], ','), '', array_to_string(ids[1:10], ','))"
_query("lean_strings", _num_sql(f"SELECT docid, {_LEAN} AS lean, concat_ws(chr(9), a1, rel, a2) AS pretty FROM tp", _PAYLOAD))(
    lambda s, d: X.tuple_payload(_hashed(s, d), sentences=False).select("docid", C.lean_text("a1", "rel", "a2", "hashes", "sentences", "ids").alias("lean"), F.concat_ws("\t", "a1", "rel", "a2").alias("pretty"))
)

# --- adjacency, releases, index, rows ----------------------------------------------------------------------
_WINDOWS = (1, 2, 5, 10)
_query(
    "adjacency",
    _rec_sql(f"""SELECT t1, t2, CAST(w AS INTEGER) AS "window", CAST(count(*) FILTER (gap <= w) AS BIGINT) AS cnt FROM (SELECT t1, unnest(i.names) AS t2, gap FROM (SELECT unnest(o.names) AS t1, i, i.place - o.place AS gap FROM t o JOIN t i ON o.docid = i.docid AND i.place - o.place BETWEEN 1 AND {_WINDOWS[-1]})), (SELECT unnest({list(_WINDOWS)}) AS w) GROUP BY t1, t2, w""",
             "t AS (SELECT docid, row_number() OVER (PARTITION BY docid ORDER BY sentid, extrid, rid) AS place, [arg1 || '|' || rel || '|' || arg2, 'type:' || split_part(arg1types[1], ':', 1) || '|' || rel || '|' || arg2, arg1 || '|' || rel || '|' || 'type:' || split_part(arg2types[1], ':', 1), 'type:' || split_part(arg1types[1], ':', 1) || '|' || rel || '|' || 'type:' || split_part(arg2types[1], ':', 1)] AS names FROM rec)"),
)(
    lambda s, d: X.adjacent(
        (r := records(s, d).withColumns({"x": F.concat(F.lit("type:"), F.split(F.col("arg1types")[0], ":")[0]), "y": F.concat(F.lit("type:"), F.split(F.col("arg2types")[0], ":")[0])}))
        .select(F.col("docid").alias("file"), F.struct("sentid", "extrid", "rid").alias("position"), F.array(*[F.concat_ws("|", a, "rel", b) for a, b in (("arg1", "arg2"), ("x", "arg2"), ("arg1", "y"), ("x", "y"))]).alias("names")), _WINDOWS
    )
)
_RGRID = (1, 5, 10, 20, 30, 40, 50)
_at = lambda c: " || ',' || ".join(f"""CAST(coalesce(sum({c}) FILTER ("window" = {w}), 0) AS BIGINT)""" for w in _RGRID)
_TOP = lambda c, p: f"""(SELECT {_KEY}, string_agg(head || ':' || n, ',' ORDER BY r) AS {c} FROM (SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY n DESC, head) AS r FROM (SELECT {_KEY}, {p} AS head, count(*) AS n FROM near JOIN num USING (docid, rid) GROUP BY ALL)) WHERE r <= 5 GROUP BY {_KEY})"""
_query(
    "release_pairs",
    _num_sql(f"""SELECT {_KEY}, heads1, heads2, undirected, directed FROM (SELECT {_KEY}, {_at('und')} AS undirected, {_at('dir')} AS directed, max(und) AS top FROM und GROUP BY {_KEY}) LEFT JOIN {_TOP('heads1', 'arg1')} USING ({_KEY}) LEFT JOIN {_TOP('heads2', 'arg2')} USING ({_KEY}) WHERE top >= 3 AND {' AND '.join(f"NOT regexp_matches({a}, '[^0-9a-zA-Z:]')" for a in ('f1', 'f2', 's1', 's2'))}""", upto="und"),
)(lambda s, d: K.release_pairs_with_heads(M.undirected(M.cumulative(N.directed(c := N.counted(_num(s, d), W)), 1, W)), N.head_counts(c), _RGRID, 3))


def _index(s, d, **options) -> DataFrame:
    path = folder(s, "pairs-index")
    C.write_index(C.pairs_index(_comb(s, d), **options), path)
    return C.read_pairs_index(s, path)


_query("index_search", _comb_sql(f"SELECT {_KEY}, max_und, nf, ns, round(CAST(printf('%.8f', und_first) AS DOUBLE), 6) AS und_first FROM comb WHERE max_und >= 2 AND fr = 'click on' AND s1 = 'type:even'"))(
    lambda s, d: _r(_index(s, d, least_und=2).where("fr = 'click on' AND s1 = 'type:even'").select(*P.KEY, "max_und", "nf", "ns", "und_first"), "und_first")
)
_query("index_exact", _comb_sql(f"SELECT {_KEY}, und_k FROM comb WHERE lower(fr) = 'click on' AND lower(sr) = 'purchase' AND lower(f1) = 'k1'"))(
    lambda s, d: K.search(_index(s, d), {"fr": "Click on", "sr": "purchase", "f1": "K1"}, exact=True).select(*P.KEY, "und_k")
)
_query("index_verbs", _comb_sql(f"SELECT {_KEY}, max_dir, ns FROM comb WHERE NOT contains(fr, ' ') AND NOT contains(sr, ' ')"))(lambda s, d: _index(s, d, verbs_only=True).select(*P.KEY, "max_dir", "ns"))
_query("no_types", _comb_sql(f"""SELECT f1, fr, f2, count(*) AS n_pairs FROM comb WHERE {_VALID} AND max_und > 0 AND NOT contains(concat_ws(' ', {_KEY}), 'type:') GROUP BY ALL"""))(lambda s, d: K.top_tuples(_comb(s, d), 5, types=False).select(*K.FIRST, "n_pairs"))


def _records_index(s, d) -> DataFrame:
    path = folder(s, "records-index")
    C.write_index(C.records_index(records(s, d)), path, "rel", "arg1")
    return s.read.parquet(path).where("rel = 'purchase' AND arg1 = 'K3'").select(F.col("docid").cast("bigint").alias("docid"), "sentid", "extrid", "sentence", "arg2types")


_query("records_index", _rec_sql("SELECT docid, sentid, extrid, sentence, array_to_string(arg2types, ',') AS arg2types FROM rec WHERE rel = 'purchase' AND arg1 = 'K3'"))(_records_index)
_OWN = lambda a, b: f"CASE WHEN len(list_filter({a}, lambda e: NOT list_contains(list_transform({b}, lambda z: z.v), e.v))) > 0 THEN list_filter({a}, lambda e: NOT list_contains(list_transform({b}, lambda z: z.v), e.v)) ELSE {a} END"
_SHOW = lambda x: f"array_to_string(list_transform({x}, lambda e: e.v || ':' || e.n), ',')"
#: Second arguments that share half of the first ones' heads.
_TWO = """two AS (SELECT docid, rel, list({'v': v, 'n': n} ORDER BY v) AS e1, list({'v': CASE WHEN n % 2 = 0 THEN v ELSE v || 'x' END, 'n': n} ORDER BY CASE WHEN n % 2 = 0 THEN v ELSE v || 'x' END) AS e2 FROM (SELECT docid, rel, arg1 AS v, count(*) AS n FROM rec GROUP BY ALL) GROUP BY docid, rel)"""
_query("cross_heads", _rec_sql(f"SELECT docid, rel, {_SHOW(_OWN('e1', 'e2'))} AS own1, {_SHOW(_OWN('e2', 'e1'))} AS own2 FROM two", _TWO))(
    lambda s, d: records(s, d).groupBy("docid", "rel", F.col("arg1").alias("v")).agg(F.count("*").alias("n")).groupBy("docid", "rel")
    .agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("e1"), F.array_sort(F.collect_list(F.struct(F.expr("CASE WHEN n % 2 = 0 THEN v ELSE concat(v, 'x') END").alias("v"), "n"))).alias("e2"))
    .select("docid", "rel", F.array_join(F.transform(X.own_heads("e1", "e2"), lambda e: F.concat_ws(":", e["v"], e["n"].cast("string"))), ",").alias("own1"), F.array_join(F.transform(X.own_heads("e2", "e1"), lambda e: F.concat_ws(":", e["v"], e["n"].cast("string"))), ",").alias("own2"))
)
_query("result_rows", _comb_sql(f"""SELECT row_number() OVER (ORDER BY round(und_first, 9) DESC, {_KEY}) AS rank, {_KEY}, und_k, max_und, printf('%.4f', und_first) AS measure, max_dir AS fs, max_und - max_dir AS sf, nf, ns FROM comb WHERE {_VALID} AND fr = 'purchase' AND f1 = 'k2' ORDER BY rank LIMIT 50"""))(
    lambda s, d: K.result_rows(_comb(s, d).where(M.valid() & (F.col("fr") == "purchase") & (F.col("f1") == "k2")), 50)
)
_query("document_records", _rec_sql("SELECT docid, rid FROM rec WHERE docid % 2 = 0 AND docid < 200"))(lambda s, d: K.document_tuples(records(s, d), [x * 2 for x in range(150)]).select("docid", "rid"))
_query("cogroup_counts", _num_sql(f"""SELECT {_KEY}, "window", und, coalesce(n, 0) AS nf FROM und LEFT JOIN (SELECT a1, rel, a2, min(n) AS n FROM (SELECT * FROM uni UNION ALL SELECT a1, rel, a2, n + 1 FROM uni) GROUP BY ALL) u ON u.a1 = f1 AND u.rel = fr AND u.a2 = f2""", upto="und"))(
    lambda s, d: M.windows(M.with_first_counts(M.wide(N.directed(c := N.counted(_num(s, d), W)), W), (u := N.unigrams(c)).unionByName(u.withColumn("n", F.col("n") + 1)))).select(*P.KEY, "window", "und", "nf")
)
_query("rows_by_conditional", _comb_sql(f"SELECT row_number() OVER (ORDER BY round(und_first, 9) DESC, {_KEY}) - 1 AS place, {_KEY} FROM comb"))(lambda s, d: R.gapless(_comb(s, d).select(*P.KEY, "und_first"), [-F.round("und_first", 9), *map(F.col, P.KEY)], "place").drop("und_first"))
_query("scored_tuple_lines", _comb_sql(f"""SELECT f1 || ' | ' || fr || ' | ' || f2 AS tuple, count(*) AS n, CAST(sum(CASE WHEN s1 NOT IN {T.PRONOUNS} AND s2 NOT IN {T.PRONOUNS} AND NOT regexp_matches(sr, '[^0-9a-zA-Z:]') THEN 1 ELSE 0 END) AS BIGINT) AS n_clean FROM comb WHERE {_VALID} AND max_und > 0 GROUP BY f1, fr, f2"""))(
    lambda s, d: K.scored_lines(K.top_tuples(_comb(s, d), 5)).select(F.array_join(F.slice(F.split("value", "\t"), 6, 3), " | ").alias("tuple"), F.split("value", "\t")[0].cast("bigint").alias("n"), F.split("value", "\t")[1].cast("bigint").alias("n_clean"))
)
_query("binned_partners", _comb_sql(f"""SELECT bin, {_KEY}, round(und_first, 6) AS und_first FROM (SELECT *, row_number() OVER (PARTITION BY f1, fr, f2 ORDER BY round(und_first, 9) DESC, s1, sr, s2) AS r FROM comb JOIN bins USING (f1, fr, f2) WHERE {_VALID}) WHERE r <= 3""",
                                       "bins AS (SELECT f1, fr, f2, CAST((row_number() OVER (ORDER BY m DESC, f1, fr, f2) - 1) // greatest(1, count(*) OVER () // 5) AS BIGINT) AS bin FROM (SELECT f1, fr, f2, max(nf) AS m FROM comb GROUP BY ALL))"))(
    lambda s, d: _r(K.partners_by_bin((c := stored(_comb(s, d), "combined")), K.bins(c.groupBy(*K.FIRST).agg(F.max("nf").alias("m")), list(K.FIRST), "m", 5).select(*K.FIRST, "bin"), 3), "und_first")
)
_query("legacy_lines", _num_sql(f"""SELECT {_KEY}, array_to_string(list_transform(range(1, 6), lambda w: coalesce(list_sum(list_transform(list_filter(c, lambda e: e.w <= w), lambda e: e.n)), 0)), ',') AS counts FROM (SELECT {_KEY}, list({{'w': "window", 'n': cnt}}) AS c FROM dir WHERE "window" <= 5 GROUP BY {_KEY}) WHERE list_sum(list_transform(c, lambda e: e.n)) >= 4""", upto="near"))(
    lambda s, d: M.legacy_lines(_dir(s, d).where('window <= 5'), 5, 4)
)
_query("measure_curves", _comb_sql(f"""SELECT kind, item, n, round(h / t, 6) AS recall, round(h / n, 6) AS precision FROM (SELECT kind, item, row_number() OVER w AS n, sum(label) OVER (w ROWS UNBOUNDED PRECEDING) AS h, sum(label) OVER (PARTITION BY kind) AS t FROM (SELECT 'cp' AS kind, * FROM (SELECT item, label, round(cp, 9) AS score FROM m3) UNION ALL SELECT 'scp', item, label, round(scp, 12) FROM m3) WINDOW w AS (PARTITION BY kind ORDER BY score DESC, item))""",
                                      f"""m3 AS (SELECT concat_ws('|', {_KEY}) AS item, CASE WHEN (max(nf) + 2 * max(ns) + max(und)) % 3 = 0 THEN 1 ELSE 0 END AS label, sum(und * pow(0.5, "window")) / sum(pow(0.5, "window")) / (max(nf) + 10) AS cp, sum(CAST(und AS DOUBLE) * und * pow(0.5, "window")) / sum(pow(0.5, "window")) / ((max(nf) + 10) * (max(ns) + 10)) AS scp FROM cnt2 WHERE fr = 'purchase' GROUP BY {_KEY})"""))(
    lambda s, d: _r(
        K.precision_recall(
            (c := (u := stored(_und_counts(s, d).where("fr = 'purchase'"), "counts")).withColumn("item", F.concat_ws("|", *P.KEY)).join(u.groupBy(*P.KEY).agg(F.expr("CAST((max(nf) + 2 * max(ns) + max(und)) % 3 = 0 AS int)").alias("label")), P.KEY))
            .transform(lambda c: U.scores(c, "cp", [10.0], [0.5], ["item", "label"]).select(F.lit("cp").alias("kind"), "item", "label", F.round("score", 9).alias("score")).unionByName(U.scores(c, "scp", [10.0], [0.5], ["item", "label"]).select(F.lit("scp").alias("kind"), "item", "label", F.round("score", 12).alias("score")))),
            ["kind"],
        ).withColumn("n", F.col("n").cast("bigint")), "recall", "precision",
    )
)
_query("weighted_scores", _comb_sql(f"SELECT {_KEY}, round(0.25 * nf / 100 + 0.5 * ns / 100 + 2 * und_first, 6) AS score FROM comb"))(
    lambda s, d: _r((c := _comb(s, d)).withColumns({f"c{k}_{x}": (F.col(n) / 100 if x == "mean" else F.lit(0.0)) for k, n in ((1, "nf"), (2, "ns")) for x in ("mean", "median", "least", "most")} | {"c1_rel": F.lit("go"), "c2_rel": F.lit("go")}).select(*P.KEY, U.weighted("und_first", 0.25, 0.5, 2.0, "average").alias("score")), "score")
)


# --- further parameters of operators above -------------------------------------------------------------
_query("cumulative_beyond", _num_sql(f"""SELECT {_KEY}, w AS "window", CAST(coalesce(sum(cnt) FILTER ("window" <= w), 0) AS BIGINT) AS cnt FROM dir, range(1, 6) t(w) GROUP BY {_KEY}, w UNION ALL SELECT {_KEY}, "window", cnt FROM dir WHERE "window" > 5""", upto="near"))(lambda s, d: M.cumulative(_dir(s, d), 1, 5, True))
_FREQ = f"""fc AS (SELECT {_KEY}, w AS "window", CAST(coalesce(sum(cnt) FILTER ("window" <= w), 0) AS BIGINT) AS cnt FROM dir, range(0, 5) t(w) GROUP BY {_KEY}, w UNION ALL SELECT {_KEY}, "window", cnt FROM dir WHERE "window" > 4)"""
for _name, _op, _inclusive in (("frequent_above", ">", False), ("frequent_from", ">=", True)):
    _query(_name, _num_sql(f"""SELECT {_KEY}, "window", cnt FROM (SELECT *, max(cnt) OVER (PARTITION BY {_KEY}) AS top FROM fc) WHERE top {_op} 3""", _FREQ, upto="near"))(lambda s, d, i=_inclusive: M.frequent(_dir(s, d), 5, 3, i))
_query("undirected_frequent", _num_sql(f"""SELECT {_KEY}, "window", dir, und FROM (SELECT *, max(und) OVER (PARTITION BY {_KEY}) AS top FROM und) WHERE top >= 5""", upto="und"))(lambda s, d: M.undirected(M.cumulative(_dir(s, d), 1, W), 5))
_query("measures_of_rare_tuples", _num_sql(f"""SELECT {_KEY}, "window", und, coalesce(f.n, 0) AS nf, coalesce(s.n, 0) AS ns FROM und LEFT JOIN (SELECT * FROM uni WHERE n < 100) f ON f.a1 = f1 AND f.rel = fr AND f.a2 = f2 LEFT JOIN (SELECT * FROM uni WHERE n < 100) s ON s.a1 = s1 AND s.rel = sr AND s.a2 = s2""", upto="und"))(
    lambda s, d: M.with_counts(M.undirected(M.cumulative(N.directed(c := N.counted(_num(s, d), W)), 1, W)), N.unigrams(c), 100).select(*P.KEY, "window", "und", "nf", "ns")
)
_query("search_without_reporting", _rec_sql("SELECT a1, rel, a2, n FROM rawt WHERE NOT list_has_any(string_split(rel, ' '), ['say', 'tell', 'ask', 'report', 'describe']) AND lower(a2) = 'mid'", RAW_SQL, _RAWT))(
    lambda s, d: K.search(_raw_tuples(s, d).select(F.col("a1").alias("f1"), F.col("rel").alias("fr"), F.col("a2").alias("f2"), "n", F.col("rel").alias("sr")), {"f2": "MID"}, True, False).select(F.col("f1").alias("a1"), F.col("fr").alias("rel"), F.col("f2").alias("a2"), "n")
)
_query("grid_top10", f"WITH g AS ({SQL['confidence_grid']}) SELECT * FROM g ORDER BY auc DESC, delta, alpha, agg, threshold LIMIT 10")(lambda s, d: QUERIES["confidence_grid"](s, d).orderBy(F.desc("auc"), "delta", "alpha", "agg", "threshold").limit(10))
_query("records_page", _rec_sql("SELECT docid, sentid, extrid, rel FROM rec WHERE lower(arg1) = 'k3' OR lower(arg2) = 'k3' ORDER BY docid, sentid, extrid LIMIT 25 OFFSET 50"))(lambda s, d: K.page(K.records_matching(records(s, d), "K3"), ["docid", "sentid", "extrid"], 25, 50).select("docid", "sentid", "extrid", "rel"))
_query("top_relations_of", _rec_sql("SELECT rel, count(DISTINCT docid) AS n_docs, count(*) AS n_records FROM rec WHERE lower(arg1) = 'k3' OR list_contains(list_transform(arg2types, lambda t: lower(t)), 'k3') GROUP BY rel ORDER BY n_docs DESC, rel LIMIT 3"))(lambda s, d: K.top_relations(K.records_matching(records(s, d), "k3"), 3))

# --- maps, keys, text helpers --------------------------------------------------------------------------
_HALVES = "halves AS (SELECT docid, arg1, sentid % 2 AS half, count(*) AS n FROM rec GROUP BY ALL)"


def _halves(s, d) -> DataFrame:
    n = records(s, d).groupBy("docid", (F.col("sentid") % 2).alias("half"), "arg1").agg(F.count("*").cast("int").alias("n"))
    part = lambda k: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("half") == k, F.struct("arg1", "n"))))).alias(f"m{k}")
    return n.groupBy("docid").agg(part(0), part(1))


_query("map_sums", _rec_sql("SELECT docid, arg1, sum(n) + CASE WHEN arg1 = 'K3' THEN 2 ELSE 0 END AS n FROM (SELECT docid, arg1, n FROM halves UNION ALL SELECT DISTINCT docid, 'K3', 0 FROM halves) GROUP BY docid, arg1", _HALVES))(
    lambda s, d: _halves(s, d).select("docid", F.explode(T.bumped(T.map_sum(F.col("m0"), F.col("m1")), F.lit("K3"), 2)).alias("arg1", "n")).withColumn("n", F.col("n").cast("bigint"))
)
_query("map_sums_until", _rec_sql("SELECT docid, arg1, CAST(sum(n) AS BIGINT) AS n FROM halves JOIN (SELECT docid, count(*) FILTER (half = 0) AS keys FROM halves GROUP BY docid) USING (docid) WHERE half = 0 OR keys < 7 GROUP BY docid, arg1", _HALVES))(
    lambda s, d: _halves(s, d).select("docid", F.explode(T.map_sum_until(F.col("m0"), F.col("m1"), 7)).alias("arg1", "n")).withColumn("n", F.col("n").cast("bigint"))
)
_query("keys", _rec_sql("SELECT rid, concat_ws(chr(9), arg1, rel, arg2) AS key, lower(trim(arg1)) || ',' || lower(trim(rel)) || ',' || lower(trim(arg2)) AS loose, least(arg1, arg2) AS first, greatest(arg1, arg2) AS second FROM rec"))(
    lambda s, d: records(s, d).select("rid", T.tuple_key("arg1", "rel", "arg2").alias("key"), T.loose_key("arg1", "rel", "arg2").alias("loose"), T.in_order("arg1", "arg2").alias("o")).select("rid", "key", "loose", "o.first", "o.second")
)
_query("escaped_lines", _lines_sql("""SELECT docid, sentid, replace(replace(replace(replace(sentence, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS line FROM sent WHERE regexp_matches(sentence, '[&<>"]')"""))(
    lambda s, d: _lines(s, d).where(F.col("sentence").rlike('[&<>"]')).select("docid", "sentid", T.escape_html(F.col("sentence")).alias("line"))
)
_query("paired_elements", _rec_sql("SELECT rid, unnest([arg1, rel]) AS a, unnest([rel, arg2]) AS b FROM rec"))(lambda s, d: records(s, d).select("rid", F.explode(T.paired(F.array("arg1", "rel"), F.array("rel", "arg2"))).alias("x")).select("rid", "x.a", "x.b"))
_query("text_chunks", "SELECT doc_id, i, substring(text, CAST(i * 100 + 1 AS INTEGER), 100) AS chunk FROM (SELECT doc_id, text, unnest(range(0, length(text) // 100 + 1)) AS i FROM documents WHERE text IS NOT NULL)")(
    lambda s, d: s.read.parquet(f"{d}/documents.parquet").where("text is not null").select("doc_id", F.posexplode(T.chunks(F.col("text"), 100)).alias("i", "chunk")).withColumn("i", F.col("i").cast("bigint"))
)
_query("without_stand_ins", _rec_sql("SELECT rel, count(*) AS n FROM rec WHERE rid % 5 <> 0 GROUP BY rel"))(
    lambda s, d: C.parse_app_lines(C.format_app_lines(_apps(s, d).withColumn("sentid", F.when(F.col("rid") % 5 != 0, F.col("sentid").cast("string")).otherwise("bad"))), stand_in=True).where("arg1 <> 'NA'").groupBy("rel").agg(F.count("*").alias("n"))
)
_query("field_helpers", _rec_sql("SELECT rid, split_part(sentence, ' ', 1) AS first, CASE WHEN contains(sentence, ' ') THEN substring(sentence, strpos(sentence, ' ') + 1) END AS rest, string_split(sentence, ' ')[4] AS fourth, coalesce(TRY_CAST(substring(arg1, 2) AS INTEGER), 4) AS number FROM rec"))(
    lambda s, d: records(s, d).select("rid", F.get(T.first_rest(F.col("sentence"), " "), 0).alias("first"), F.get(T.first_rest(F.col("sentence"), " "), 1).alias("rest"), T.nth_field(F.col("sentence"), " ", 3).alias("fourth"), T.number_or(F.expr("substring(arg1, 2)"), "int", 4).alias("number"))
)

# --- lines and files ---------------------------------------------------------------------------------------


def _text_folder(s, lines: DataFrame, label: str) -> str:
    path = folder(s, label)
    C.write_text(lines, path)
    return path


_query("grep_lines", _rec_sql("SELECT sentence AS value FROM rec WHERE regexp_matches(sentence, 'K[13] (click|view)')"))(lambda s, d: C.grep(s, _text_folder(s, records(s, d).select(F.col("sentence").alias("value")), "lines"), "K[13] (click|view)"))
_query("projected_fields", _rec_sql("SELECT arg2 || ' ' || arg1 AS value FROM rec"))(lambda s, d: C.project_fields(s, _text_folder(s, records(s, d).select(F.concat_ws(",", "arg1", "rel", "arg2").alias("value")), "fields"), [2, 0]))


def _triple_files(s, d):
    r = records(s, d)
    line = F.concat_ws("|", "arg1", "arg1", F.col("arg1types")[0], "rel", "rel", "arg2", "arg2", F.col("arg2types")[0])
    bad = (F.col("docid") % 7 == 0) & (F.col("sentid") == 1)
    lines = r.where("docid % 3 = 0").select(F.when(bad, F.lit("too|few")).otherwise(line).alias("value"), F.col("docid").cast("string").alias("file"), F.struct("sentid", "extrid").alias("position"))
    got = C.read_triples(s, f"{_files(s, d, lines)}/*")
    return got.groupBy(F.regexp_extract("file", "file=([0-9]+)", 1).alias("docid"), "arg1", "rel").agg(F.count("*").alias("n"))


_query("triple_files", _rec_sql("SELECT CAST(docid AS VARCHAR) AS docid, lower(arg1) AS arg1, lower(rel) AS rel, count(*) AS n FROM rec WHERE docid % 3 = 0 AND docid % 7 <> 0 GROUP BY ALL"))(_triple_files)
_query("annotated_lines", _rec_sql("SELECT rid, confidence AS median, confidence + 1 AS most, 0.5 AS least, confidence AS mean, CAST(rid % 2 AS INTEGER) AS label, rel FROM rec WHERE rid % 3 > 0"))(
    lambda s, d: C.parse_annotated(records(s, d).select(F.concat_ws("\t", F.col("rid").cast("string"), F.col("confidence").cast("string"), (F.col("confidence") + 1).cast("string"), F.lit("0.5"), F.col("confidence").cast("string"), F.when(F.col("rid") % 3 > 0, (F.col("rid") % 2).cast("string")).otherwise("x"), "arg1", "rel", "arg2").alias("value")))
    .select(F.col("place").cast("bigint").alias("rid"), "median", F.round("most", 6).alias("most"), "least", "mean", "label", "rel")
)
_query("scored_lines_read", _comb_sql("SELECT f1, fr, f2, count(*) AS n FROM comb GROUP BY ALL"))(
    lambda s, d: C.parse_scored_tuples(_comb(s, d).groupBy(*K.FIRST).agg(F.count("*").alias("n")).select(F.concat_ws("\t", F.col("n").cast("string"), F.lit("0"), F.lit("0"), *K.FIRST).alias("value"))).select(F.col("arg1").alias("f1"), F.col("rel").alias("fr"), F.col("arg2").alias("f2"), F.col("score").cast("bigint").alias("n"))
)
_query("hand_label_lines", _comb_sql("SELECT f1, fr, f2, s1, sr, s2, CAST(nf % 2 AS INTEGER) AS label, CAST(max_und AS INTEGER) AS biterm, CAST(nf AS INTEGER) AS nf, CAST(ns AS INTEGER) AS ns FROM comb"))(
    lambda s, d: C.parse_hand_labels(_comb(s, d).select(F.concat_ws("\t", "f1", F.lit("i"), "fr", "f2", F.lit("i"), F.lit("0"), F.lit("1"), (F.col("nf") % 2).cast("string"), "s1", F.lit("i"), "sr", "s2", F.lit("i"), F.col("max_und").cast("string"), F.lit("x"), F.col("nf").cast("string"), F.col("ns").cast("string"), F.lit("0.5")).alias("value"))).select(*P.KEY, "label", "biterm", "nf", "ns")
)
_query("flat_graph", _num_sql("""SELECT f1 || '|' || fr || '|' || f2 AS t1, s1 || '|' || sr || '|' || s2 AS t2, CAST(w AS BIGINT) AS "window", CAST(sum(CASE WHEN "window" <= w THEN cnt ELSE 0 END) AS BIGINT) AS cnt FROM dir, range(1, 6) t(w) GROUP BY ALL""", upto="near"))(
    lambda s, d: C.graph_edges_flat(_dir(s, d).groupBy(*P.KEY).agg(T.window_counts_text(F.map_from_entries(F.collect_list(F.struct(F.col("window").cast("int"), F.col("cnt").cast("int"))))).alias("c")).select(F.concat_ws("\t", *P.KEY, F.lit("ids"), F.lit("ids"), "c").alias("value")), 5).withColumns({"window": F.col("window").cast("bigint"), "cnt": F.col("cnt").cast("bigint")})
)
_query("affinity_lines", _comb_sql("SELECT CAST(max_dir AS DOUBLE) AS first, CAST(nf AS DOUBLE) AS whole, count(*) AS n FROM comb GROUP BY ALL"))(
    lambda s, d: C.parse_affinities(C.format_affinities(_comb(s, d).select(*[F.struct(F.array(F.col("max_dir").cast("double"), F.lit(1.5)).alias("windows"), F.col("nf").cast("double").alias("combined")).alias(n) for n in ("und_first", "dir_first", "und_second", "dir_second")])))
    .groupBy(F.col("dir_second.windows")[0].alias("first"), F.col("und_first.combined").alias("whole")).agg(F.count("*").alias("n"))
)
