"""The registered queries of the co-occurrence engine, and their DuckDB SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions import text as T
from pairloom.operators import counting as N
from pairloom.operators import measures as M
from pairloom.operators import pairs as P
from pairloom.operators import ranking as K
from pairloom.operators import records as R
from pairloom.operators import tuning as U
from pairloom.session import stored
from pairloom.sources import codecs as C
from pairloom.sources.adapters import REC_SQL, SENT_SQL, records, sentences

W, DELTA, ALPHA, AT = 10, 10.0, 0.9, 5
_KEY = ", ".join(P.KEY)
_PREP = "('in', 'on', 'at', 'over', 'by', 'after', 'near', 'of')"

# --- SQL building blocks ---------------------------------------------------------------------
_NUM = f"""said AS (SELECT * FROM (SELECT *, list_filter(string_split(rel, ' '), lambda t: t IN {_PREP})[1] AS prep FROM rec) WHERE prep IS NULL OR list_contains(string_split(sentence, ' '), prep)),
num AS (SELECT *, dense_rank() OVER (PARTITION BY docid ORDER BY sentid, extrid) AS idx,
    list_distinct(list_transform(list_concat([arg1], arg1types), lambda x: lower(trim(x)))) AS r1,
    CASE WHEN list_contains(arg2types, 'Type:time_unit') THEN [lower(arg2), 'type:time_unit'] ELSE [lower(arg2), 'type:number'] END AS r2,
    arg1 || ' ' || regexp_replace(rel, '^be ', '') || ' ' || arg2 AS say, list_filter(string_split(arg1 || ' ' || rel || ' ' || arg2, ' '), lambda t: t <> 'be') AS bag FROM said)"""
_SUBS = """((lower(o.arg1) = lower(i.arg1) AND lower(o.arg2) = lower(i.arg2)) OR (lower(o.arg1) = lower(i.arg2) AND lower(o.arg2) = lower(i.arg1))
    OR contains(o.say, i.say) OR contains(i.say, o.say) OR list_has_all(o.bag, i.bag) OR list_has_all(i.bag, o.bag))"""
_BAND = f"FROM num o JOIN num i ON o.docid = i.docid AND i.idx - o.idx BETWEEN 1 AND {W} AND (o.sentid <> i.sentid OR NOT {_SUBS})"
_NEAR = f"""g AS (SELECT *, unnest(r2) AS g2 FROM (SELECT *, unnest(r1) AS g1 FROM num)),
near AS (SELECT o.docid, o.rid, o.g1 AS f1, o.rel AS fr, o.g2 AS f2, i.g1 AS s1, i.rel AS sr, i.g2 AS s2, min(i.idx - o.idx) AS dist {_BAND.replace('FROM num o JOIN num i', 'FROM g o JOIN g i')} GROUP BY ALL),
dir AS (SELECT {_KEY}, dist AS "window", count(*) AS cnt FROM near GROUP BY ALL),
uni AS (SELECT g1 AS a1, rel, g2 AS a2, count(*) AS n FROM g GROUP BY ALL)"""
_CUM = f"""cum AS (SELECT {_KEY}, w AS "window", CAST(coalesce(sum(cnt) FILTER ("window" <= w), 0) AS BIGINT) AS cnt FROM dir, range(1, {W + 1}) t(w) GROUP BY {_KEY}, w)"""
_UND = f"""both_ AS (SELECT {_KEY}, "window", cnt AS dir, 0 AS rev FROM cum UNION ALL SELECT s1, sr, s2, f1, fr, f2, "window", 0, cnt FROM cum),
und AS (SELECT {_KEY}, "window", CAST(sum(dir) AS BIGINT) AS dir, CAST(CASE WHEN f1 = s1 AND fr = sr AND f2 = s2 THEN sum(dir) ELSE sum(dir) + sum(rev) END AS BIGINT) AS und FROM both_ GROUP BY {_KEY}, "window")"""
_MEAS = f"""cnt2 AS (SELECT und.*, coalesce(f.n, 0) AS nf, coalesce(s.n, 0) AS ns FROM und LEFT JOIN uni f ON f.a1 = f1 AND f.rel = fr AND f.a2 = f2 LEFT JOIN uni s ON s.a1 = s1 AND s.rel = sr AND s.a2 = s2),
meas AS (SELECT *, dir / (nf + {DELTA}) AS dir_first, dir / (ns + {DELTA}) AS dir_second, und / (nf + {DELTA}) AS und_first, und / (ns + {DELTA}) AS und_second,
    und / (nf + {DELTA}) * (und / (ns + {DELTA})) AS scp, CASE WHEN und > 0 THEN ln(und / (nf + ns + 2 * {DELTA})) END AS pmi, CASE WHEN und > 0 AND nf + ns > 0 THEN ln(und / (nf + ns)) END AS pmi_raw FROM cnt2)"""
_AVG = lambda c: f'sum({c} * pow({ALPHA}, "window")) / sum(pow({ALPHA}, "window")) AS {c}'
_COMB = f"""comb AS (SELECT {_KEY}, {', '.join(_AVG(c) for c in ('dir_first', 'dir_second', 'und_first', 'und_second', 'scp'))}, max(nf) AS nf, max(ns) AS ns, max(dir) AS max_dir, max(und) AS max_und, coalesce(max(und) FILTER ("window" = {AT}), 0) AS und_k FROM meas GROUP BY {_KEY})"""
_VALID = "(max_und <= nf AND max_und <= ns AND max_dir <= nf AND max_dir <= ns)"
_EDGE = f"""edge AS (SELECT concat_ws(' ', f1, fr, f2) AS t1, concat_ws(' ', s1, sr, s2) AS t2, "window", cnt FROM cum WHERE cnt > 0),
lm AS (SELECT t1, t2, "window", cnt, (cnt + 0.05) / (z + 0.05 * v) AS p FROM edge JOIN (SELECT t1, "window", sum(cnt) AS z FROM edge GROUP BY ALL) USING (t1, "window"), (SELECT count(DISTINCT t1) AS v FROM edge)),
pw AS (SELECT t1, t2, sum(p * pow(0.5, "window")) / sum(pow(0.5, "window")) AS p FROM lm GROUP BY ALL),
sym AS (SELECT a.t1, a.t2, a.p * b.p AS scp FROM pw a JOIN pw b ON a.t1 = b.t2 AND a.t2 = b.t1)"""
_SCORED = "scored AS (SELECT d.doc_id AS item, l.toxic AS label, round(crc_score, 6) AS score FROM (SELECT doc_id, ((doc_id * 7919) % 1009) / 1009.0 AS crc_score FROM documents) d JOIN labels l USING (doc_id))"

_UPTO = {"rec": REC_SQL, "num": _NUM, "near": _NEAR, "cum": _CUM, "und": _UND, "meas": _MEAS, "comb": _COMB}


def _sql(upto: str, body: str, *more: str) -> str:
    names = list(_UPTO)
    return "WITH " + ",\n".join([_UPTO[n] for n in names[: names.index(upto) + 1]] + list(more)) + "\n" + body


def _rec_sql(body: str, *more: str) -> str:
    return _sql("rec", body, *more)


def _num_sql(body: str, *more: str, upto: str = "num") -> str:
    return _sql(upto, body, *more)


def _comb_sql(body: str, *more: str) -> str:
    return _sql("comb", body, *more)


def _hash_sql(text: str) -> str:
    """The 32-bit hash of the letters and digits of a text."""
    h = f"list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(regexp_replace(lower({text}), '[^a-z0-9]', '', 'g'), ''), lambda z: CAST(ascii(z) AS BIGINT))), lambda p, q: (p * 31 + q) % 4294967296)"
    return f"CAST(CASE WHEN {h} >= 2147483648 THEN {h} - 4294967296 ELSE {h} END AS INTEGER)"


# --- Spark building blocks -----------------------------------------------------------------
def _num(s: SparkSession, d: str) -> DataFrame:
    return P.numbered(records(s, d))


def _dir(s, d):
    return N.directed(N.counted(_num(s, d), W))


def _wide(s, d):
    return M.wide(_dir(s, d), W)


def _wide_counts(s, d):
    c = N.counted(_num(s, d), W)
    return M.with_counts(M.wide(N.directed(c), W), N.unigrams(c))


def _und(s, d):
    return M.windows(_wide(s, d))


def _meas(s, d):
    return M.measures(M.windows(_wide_counts(s, d)), DELTA)


def _comb(s, d):
    return M.combined_wide(_wide_counts(s, d), DELTA, ALPHA, AT)


def _edges(s, d):
    c = M.cumulative(_dir(s, d), 1, W).where("cnt > 0")
    return c.select(F.concat_ws(" ", "f1", "fr", "f2").alias("t1"), F.concat_ws(" ", "s1", "sr", "s2").alias("t2"), "window", "cnt")


def _sym(s, d):
    return stored(K.symmetric_lm(K.window_lm(_edges(s, d))), "edges")  # neighbourhoods read them several times


def _scored(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("item"), F.round((F.col("doc_id") * 7919) % 1009 / F.lit(1009.0), 6).alias("score"))
    labels = s.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").alias("item"), F.col("toxic").alias("label"))
    return docs.join(labels, "item")


def _r(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in cols})


SEED = "k1 click on low"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _cols(*c: str) -> str:
    return ", ".join(f"round({x}, 6) AS {x}" for x in c)


_query("ordinal", _sql("num", "SELECT docid, rid, idx FROM num"))(lambda s, d: _num(s, d).select("docid", "rid", "idx"))
_query("inferred_prep_filter", _sql("num", "SELECT docid, rid, rel FROM said"))(lambda s, d: R.said_preposition(records(s, d)).select("docid", "rid", "rel"))
_query("generalise_args", _sql("near", "SELECT docid, rid, g1 AS a1, rel, g2 AS a2 FROM g"))(lambda s, d: R.generalise(_num(s, d)).select("docid", "rid", "a1", "rel", "a2"))
_query("subsumption_filter", _sql("num", f"SELECT o.docid, o.rid, i.rid AS other, {_SUBS} AS subsumed FROM num o JOIN num i ON o.docid = i.docid AND o.sentid = i.sentid AND o.rid < i.rid"))(
    lambda s, d: _num(s, d).alias("o").join(_num(s, d).alias("i"), (F.col("o.docid") == F.col("i.docid")) & (F.col("o.sentid") == F.col("i.sentid")) & (F.col("o.rid") < F.col("i.rid"))).select("o.docid", "o.rid", F.col("i.rid").alias("other"), R.subsumes("o", "i").alias("subsumed"))
)
_query("nearest_dedup", _sql("near", f"SELECT docid, rid, {_KEY}, dist FROM near"))(lambda s, d: P.nearest(_num(s, d), W))
_query("directed_pairs", _sql("near", "SELECT * FROM dir"))(_dir)
_query("unigrams", _sql("near", "SELECT * FROM uni"))(lambda s, d: P.unigrams(_num(s, d)))
_query("merge_tuples", _sql("near", "SELECT a1, rel, a2, n FROM uni"))(
    lambda s, d: P.merge_tuples(R.generalise(_num(s, d)).groupBy("docid", "a1", "rel", "a2").agg(F.count("*").alias("n")))
)
_query("cumulative_windows", _sql("cum", "SELECT * FROM cum"))(lambda s, d: M.cumulative(_dir(s, d), 1, W))
_query(
    "frequency_filter",
    _sql("near", f"""SELECT {_KEY}, CAST(greatest(coalesce(sum(cnt) FILTER ("window" < {W}), 0), coalesce(max(cnt) FILTER ("window" >= {W}), 0)) AS BIGINT) AS top FROM dir GROUP BY {_KEY} HAVING top > 3"""),
)(lambda s, d: M.frequency_filter(_dir(s, d), W, 3))
_query("undirected_pairs", _sql("und", f"""SELECT {_KEY}, "window", dir, und FROM und"""))(_und)
_query("measures_join", _sql("meas", f"""SELECT {_KEY}, "window", dir, und, nf, ns FROM cnt2"""))(lambda s, d: _und_counts(s, d).select(*P.KEY, "window", "dir", "und", "nf", "ns"))
_C4 = ("dir_first", "dir_second", "und_first", "und_second")
_query("conditionals", _sql("meas", f"""SELECT {_KEY}, "window", {_cols(*_C4)} FROM meas"""))(lambda s, d: _r(_meas(s, d).select(*P.KEY, "window", *_C4), *_C4))
_query("scp", _sql("meas", f"""SELECT {_KEY}, "window", {_cols('scp')} FROM meas"""))(lambda s, d: _r(_meas(s, d).select(*P.KEY, "window", "scp"), "scp"))
_query("pmi", _sql("meas", f"""SELECT {_KEY}, "window", {_cols('pmi', 'pmi_raw')} FROM meas"""))(lambda s, d: _r(_meas(s, d).select(*P.KEY, "window", "pmi", "pmi_raw"), "pmi", "pmi_raw"))
_query("combined_alpha", _sql("comb", f"SELECT {_KEY}, {_cols(*_C4, 'scp')} FROM comb"))(lambda s, d: _r(_comb(s, d).select(*P.KEY, *_C4, "scp"), *_C4, "scp"))
_query("named_measures", _sql("comb", " UNION ALL ".join(f"SELECT {_KEY}, '{n}' AS name, round({c}, 6) AS value FROM comb" for n, c in (("dir.first.conditional", "dir_first"), ("dir.second.conditional", "dir_second"), ("undir.first.conditional", "und_first"), ("undir.second.conditional", "und_second")))))(
    lambda s, d: _r(M.named(_comb(s, d)), "value")
)
_query("valid_counts", _sql("comb", f"SELECT {_KEY}, max_und, nf, ns FROM comb WHERE {_VALID}"))(lambda s, d: _comb(s, d).where(M.valid()).select(*P.KEY, "max_und", "nf", "ns"))
_EQ = "CASE WHEN o.chain1 = i.chain1 THEN '11' WHEN o.chain1 = i.chain2 THEN '12' WHEN o.chain2 = i.chain1 THEN '21' WHEN o.chain2 = i.chain2 THEN '22' END"
_query(
    "coref_single",
    _sql("num", f"""SELECT docid, eq, CASE WHEN eq IN ('11', '12') THEN 'XVAR' ELSE x1 END AS f1, fr, CASE WHEN eq IN ('21', '22') THEN 'XVAR' ELSE x2 END AS f2,
    CASE WHEN eq IN ('11', '21') THEN 'XVAR' ELSE y1 END AS s1, sr, CASE WHEN eq IN ('12', '22') THEN 'XVAR' ELSE y2 END AS s2, dist
    FROM (SELECT o.docid, {_EQ} AS eq, o.arg1 AS x1, o.rel AS fr, o.arg2 AS x2, i.arg1 AS y1, i.rel AS sr, i.arg2 AS y2, i.idx - o.idx AS dist {_BAND}) WHERE eq IS NOT NULL"""),
)(lambda s, d: P.coref_single(_num(s, d), W))


def _multi_sql() -> str:
    b = ["coalesce(o.chain1 = i.chain1, false)", "coalesce(o.chain2 = i.chain2, false)", "coalesce(o.chain1 = i.chain2, false)", "coalesce(o.chain2 = i.chain1, false)"]
    names = ("x1", "x2", "y1", "y2")

    def case(k: int) -> str:
        arms = " ".join(f"WHEN bits = '{''.join(map(str, key))}' THEN " + (f"'{row[k]}VAR:' || lower({names[k]})" if row[k] else f"lower({names[k]})") for key, row in P.TABLE.items())
        return f"CASE {arms} ELSE 'XVAR:' || lower({names[k]}) END"

    text = " || ".join(f"CASE WHEN {x} THEN '1' ELSE '0' END" for x in b)
    return _sql("num", f"""SELECT docid, {case(0)} AS f1, fr, {case(1)} AS f2, {case(2)} AS s1, sr, {case(3)} AS s2, dist
    FROM (SELECT o.docid, {text} AS bits, o.arg1 AS x1, o.rel AS fr, o.arg2 AS x2, i.arg1 AS y1, i.rel AS sr, i.arg2 AS y2, i.idx - o.idx AS dist {_BAND}) WHERE bits <> '0000'""")


_query("coref_multiple", _multi_sql())(lambda s, d: P.coref_multiple(_num(s, d), W))
_query(
    "merge_mentions",
    "SELECT o_orderkey AS docid, o_orderkey AS doc_key, coalesce(m.k, '') AS mention_key FROM orders LEFT JOIN (SELECT l_orderkey, min(l_returnflag || l_linestatus) AS k FROM lineitem GROUP BY 1 HAVING count(*) <= 4) m ON l_orderkey = o_orderkey",
)(
    lambda s, d: P.merge_mentions(
        s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("docid"), F.col("o_orderkey").alias("doc_key")),
        (li := s.read.parquet(f"{d}/lineitem.parquet")).groupBy(F.col("l_orderkey").alias("docid")).agg(F.count("*").alias("n_records"), F.min(F.concat("l_returnflag", "l_linestatus")).alias("mention_key")),
        4,
    )
)
_VERB = lambda c: f"coalesce(nullif(array_to_string(list_filter(string_split({c}, ' '), lambda t: t <> 'be' AND t NOT IN {T.PREPOSITIONS}), ' '), ''), {c})"
_query("verb_only", _sql("near", f"""SELECT f1, {_VERB('fr')} AS fr, f2, s1, {_VERB('sr')} AS sr, s2, "window", CAST(sum(cnt) AS BIGINT) AS cnt FROM dir GROUP BY ALL"""))(lambda s, d: P.verb_only(_dir(s, d)))
_query("sentence_offsets", f"""WITH {SENT_SQL} SELECT docid, sentid, CAST(coalesce(sum(length(sentence) + 1) OVER (PARTITION BY docid ORDER BY sentid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM sent""")(
    lambda s, d: R.sentence_offsets(sentences(s, d))
)
_query("trim_sentences", f"WITH {SENT_SQL} SELECT docid, sentid FROM sent WHERE length(sentence) - length(replace(sentence, ' ', '')) <= 75")(lambda s, d: R.trim_sentences(sentences(s, d)).select("docid", "sentid"))
_query(
    "sentence_hashes",
    _sql("rec", """SELECT docid, rid, CAST(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS INTEGER) AS hash FROM (
    SELECT docid, rid, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(regexp_replace(lower(sentence), '[^a-z0-9]', '', 'g'), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, c: (a * 31 + c) % 4294967296) AS h FROM rec)"""),
)(lambda s, d: records(s, d).select("docid", "rid", T.java_hash(T.plain(F.col("sentence"))).alias("hash")))
_query("spans", _sql("rec", """SELECT docid, rid, CASE WHEN strpos(sentence, rel) > 0 THEN strpos(sentence, rel) - 1 ELSE 0 END AS span_start, CASE WHEN strpos(sentence, rel) > 0 THEN strpos(sentence, rel) - 1 + length(rel) ELSE 0 END AS span_end FROM rec"""))(
    lambda s, d: records(s, d).withColumn("span", T.find_span(F.col("sentence"), F.col("rel"))).select("docid", "rid", F.col("span.start").cast("bigint").alias("span_start"), F.col("span.end").cast("bigint").alias("span_end"))
)
_query(
    "head_counts_top5",
    _sql("rec", """SELECT rel, string_agg(head || ':' || n, ',' ORDER BY r) AS heads FROM (SELECT *, row_number() OVER (PARTITION BY rel ORDER BY n DESC, head) AS r FROM (SELECT rel, arg1 AS head, count(*) AS n FROM rec GROUP BY ALL)) WHERE r <= 5 GROUP BY rel"""),
)(lambda s, d: K.top_heads(records(s, d).groupBy("rel", F.col("arg1").alias("head")).agg(F.count("*").alias("n")), ["rel"]))
_GRID = (1, 5, 10)
_at = lambda c: " || ',' || ".join(f"""CAST(coalesce(sum({c}) FILTER ("window" = {w}), 0) AS BIGINT)""" for w in _GRID)
_query("release_export_pairs", _sql("und", f"SELECT {_KEY}, {_at('und')} AS undirected, {_at('dir')} AS directed FROM und GROUP BY {_KEY}"))(lambda s, d: K.release_pairs(_und(s, d), _GRID))
_query(
    "release_export_tuples",
    _sql("near", """SELECT a1, rel, a2, any_value(n) AS n, string_agg(head || ':' || c, ',' ORDER BY r) AS heads FROM (SELECT *, row_number() OVER (PARTITION BY a1, rel, a2 ORDER BY c DESC, head) AS r FROM
    (SELECT g1 AS a1, rel, g2 AS a2, arg1 AS head, count(*) AS c FROM g GROUP BY ALL)) JOIN uni USING (a1, rel, a2) WHERE r <= 5 GROUP BY a1, rel, a2"""),
)(lambda s, d: K.top_heads((g := R.generalise(_num(s, d))).groupBy("a1", "rel", "a2", F.col("arg1").alias("head")).agg(F.count("*").alias("n")), ["a1", "rel", "a2"]).join(P.unigrams(_num(s, d)), ["a1", "rel", "a2"]))
_CLEAN = f"(s1 NOT IN {T.PRONOUNS} AND s2 NOT IN {T.PRONOUNS} AND NOT regexp_matches(sr, '[^0-9a-zA-Z:]'))"
_query(
    "top_tuples",
    _sql("comb", f"""SELECT f1, fr, f2, count(*) AS n_pairs, CAST(sum(CASE WHEN {_CLEAN} THEN 1 ELSE 0 END) AS BIGINT) AS n_clean, round(sum(scp) FILTER (r1 <= 5), 6) AS scp, round(sum(und_first) FILTER (r2 <= 5), 6) AS p_sf, round(sum(und_second) FILTER (r3 <= 5), 6) AS p_fs
    FROM (SELECT *, {', '.join(f'row_number() OVER (PARTITION BY f1, fr, f2 ORDER BY round({c}, 9) DESC, s1, sr, s2) AS r{i}' for i, c in ((1, 'scp'), (2, 'und_first'), (3, 'und_second')))}
    FROM (SELECT * REPLACE (und_first * und_second AS scp) FROM comb WHERE {_VALID} AND max_und > 0)) GROUP BY f1, fr, f2"""),
)(lambda s, d: _r(K.top_tuples(_comb(s, d), 5), "scp", "p_sf", "p_fs"))
_query("equal_bins", _sql("comb", """SELECT f1, fr, f2, CAST((row_number() OVER (ORDER BY round(m, 9) DESC, f1, fr, f2) - 1) // greatest(1, count(*) OVER () // 10) AS BIGINT) AS bin FROM (SELECT f1, fr, f2, max(nf) AS m FROM comb GROUP BY ALL)"""))(
    lambda s, d: K.bins(_comb(s, d).groupBy(*K.FIRST).agg(F.max("nf").alias("m")), K.FIRST, "m", 10).select(*K.FIRST, "bin")
)
_FIND = "fr = 'click on' AND s1 = 'type:even'"
_query("search_pairs", _sql("comb", f"SELECT {_KEY}, {_cols('und_first')} FROM comb WHERE {_FIND}"))(lambda s, d: _r(K.search(_comb(s, d), {"fr": "click on", "s1": "type:even"}).select(*P.KEY, "und_first"), "und_first"))
_TYPE = lambda a: f"replace(regexp_extract({a}, '^(.*?)[tT]ype:(.*)$', 2), ':Number', '')"
_VTYPE = lambda a, b: f"CASE WHEN contains({a}, 'XVAR') THEN {_TYPE(a)} WHEN contains({b}, 'XVAR') THEN {_TYPE(b)} ELSE '' END"
_SORTS = {"fs": "max_dir", "sf": "max_und - max_dir", "fs+sf": "max_und", "kfs+sf": "und_k", "f": "nf", "s": "ns"}
_query("sort_keys", _sql("comb", " UNION ALL ".join(f"SELECT '{n}' AS sort_by, rank, {_KEY}, value FROM (SELECT *, CAST({e} AS BIGINT) AS value, row_number() OVER (ORDER BY {e} DESC, {_KEY}) AS rank FROM comb) WHERE rank <= 20" for n, e in _SORTS.items())))(
    lambda s, d: (lambda c: reduce(DataFrame.unionByName, [K.rank(c, n, 20).select(F.lit(n).alias("sort_by"), F.col("rank").cast("bigint").alias("rank"), *P.KEY, F.expr(e).cast("bigint").alias("value")) for n, e in _SORTS.items()]))(stored(_comb(s, d), "combined"))
)
_query("flagship", _sql("comb", f"""SELECT rank, {_KEY}, {_cols('und_first')}, nf, ns FROM (SELECT *, row_number() OVER (ORDER BY round(und_first, 9) DESC, {_KEY}) AS rank FROM comb) WHERE rank <= 20"""))(
    lambda s, d: _r(K.rank(_comb(s, d), k=20).select(F.col("rank").cast("bigint").alias("rank"), *P.KEY, "und_first", "nf", "ns"), "und_first")
)
_query("collapse_by_relation", _sql("comb", "SELECT sr, round(max(und_first), 6) AS best, count(*) AS n_pairs FROM comb GROUP BY sr"))(lambda s, d: _r(K.collapse(_comb(s, d)), "best"))
_query("top_relations", _sql("rec", "SELECT rel, count(DISTINCT docid) AS n_docs, count(*) AS n_records FROM rec GROUP BY rel"))(lambda s, d: K.top_relations(records(s, d), None))
_query("doc_lookup", _sql("rec", "SELECT DISTINCT docid FROM rec WHERE rel = 'purchase' AND (lower(arg1) = 'k3' OR list_contains(arg1types, 'Type:k3'))"))(lambda s, d: K.records_matching(records(s, d), "k3", "purchase").select("docid").distinct())
_query("window_lm", _sql("cum", """SELECT t1, t2, "window", cnt, round(p, 6) AS p FROM lm""", _EDGE))(lambda s, d: _r(K.window_lm(_edges(s, d)), "p"))
_query("symmetric_lm", _sql("cum", "SELECT t1, t2, round(scp, 9) AS scp FROM sym", _EDGE))(lambda s, d: _r(_sym(s, d), "scp", places=9))
_query("one_hop", _sql("cum", f"SELECT DISTINCT t1, t2, round(scp, 9) AS scp FROM sym WHERE t1 = '{SEED}' OR t2 = '{SEED}'", _EDGE))(lambda s, d: _r(K.one_hop(_sym(s, d), SEED), "scp", places=9))
_query(
    "two_hop",
    _sql("cum", f"""SELECT DISTINCT via, t1, t2, round(scp, 9) AS scp FROM sym JOIN ends ON t1 = via OR t2 = via WHERE t1 <> '{SEED}' AND t2 <> '{SEED}'""", _EDGE, f"""ends AS (SELECT DISTINCT via FROM (SELECT CASE WHEN t1 = '{SEED}' THEN t2 ELSE t1 END AS via FROM sym WHERE t1 = '{SEED}' OR t2 = '{SEED}' ORDER BY round(scp, 12) DESC, t1, t2 LIMIT 10) WHERE via <> '{SEED}')"""),
)(lambda s, d: _r(K.two_hop(_sym(s, d), SEED, 10), "scp", places=9))
_PR = "pr AS (SELECT item, n, h / t AS recall, h / n AS precision FROM (SELECT item, row_number() OVER w AS n, sum(label) OVER (w ROWS UNBOUNDED PRECEDING) AS h, sum(label) OVER () AS t FROM scored WINDOW w AS (ORDER BY score DESC, item)))"
_query("pr_curve", f"WITH {_SCORED}, {_PR} SELECT item, n, round(recall, 6) AS recall, round(precision, 6) AS precision FROM pr")(
    lambda s, d: _r(K.precision_recall(_scored(s, d), [], 64), "recall", "precision")
)
_query(
    "auc_grid",
    f"""WITH {_SCORED}, grid AS (SELECT unnest([0, 1, 2, 3, 4]) AS gid), x AS (SELECT gid, item, label, round(score * (gid + 1) - floor(score * (gid + 1)), 6) AS score FROM scored, grid),
    pr AS (SELECT gid, n, h / t AS recall, h / n AS precision FROM (SELECT gid, row_number() OVER w AS n, sum(label) OVER (w ROWS UNBOUNDED PRECEDING) AS h, sum(label) OVER (PARTITION BY gid) AS t FROM x WINDOW w AS (PARTITION BY gid ORDER BY score DESC, item)))
    SELECT gid, round(sum(a), 6) AS auc FROM (SELECT gid, (recall - coalesce(lag(recall) OVER v, 0)) * (precision + coalesce(lag(precision) OVER v, 1)) / 2 AS a FROM pr WINDOW v AS (PARTITION BY gid ORDER BY n)) GROUP BY gid""",
)(
    lambda s, d: _r(
        K.area(K.precision_recall(_scored(s, d).withColumn("gid", F.explode(F.array(*map(F.lit, range(5))))).withColumn("score", F.round(F.col("score") * (F.col("gid") + 1) - F.floor(F.col("score") * (F.col("gid") + 1)), 6)), ["gid"]), ["gid"]), "auc"
    )
)
_query("error_modes", f"WITH {_SCORED} SELECT item, label, score, place FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY CASE WHEN label = 1 THEN score ELSE -score END, item) AS place FROM scored) WHERE place <= 100")(
    lambda s, d: K.error_modes(_scored(s, d)).select("item", "label", "score", F.col("place").cast("bigint").alias("place"))
)
_query("confidence_agg", _sql("rec", "SELECT arg1, rel, arg2, list_sort(list(confidence))[count(*) // 2 + 1] AS median, min(confidence) AS least, max(confidence) AS most, round(avg(confidence), 6) AS mean FROM rec GROUP BY arg1, rel, arg2"))(
    lambda s, d: _r(K.confidence(records(s, d)), "mean")
)
_query("doc_size_histogram", _sql("rec", "SELECT CAST(least(100, greatest(10, ceil(n / 10) * 10)) AS BIGINT) AS bin, count(*) AS n_docs FROM (SELECT docid, count(*) AS n FROM rec GROUP BY docid) GROUP BY 1"))(lambda s, d: R.size_histogram(records(s, d)))


# --- coreference with generalisation ---------------------------------------------------------
_VT = lambda a, b: f"coalesce(nullif(regexp_extract({a}, '^[^:]*:[tT][yY][pP][eE]:([^:]+)$', 1), ''), nullif(regexp_extract({b}, '^[^:]*:[tT][yY][pP][eE]:([^:]+)$', 1), ''))"
_GBAND = _BAND.replace("FROM num o JOIN num i", "FROM g o JOIN g i")


def _equality_sql(multiple: bool) -> str:
    """enear: what equality_nearest returns."""
    names = ("x1", "x2", "y1", "y2")
    if multiple:
        bits = " || ".join(f"CASE WHEN {x} THEN '1' ELSE '0' END" for x in ("o.chain1 = i.chain1", "o.chain2 = i.chain2", "o.chain1 = i.chain2", "o.chain2 = i.chain1"))
        key, none = bits, "'0000'"

        def out(k: int) -> str:
            arms = " ".join(f"WHEN eq = '{''.join(map(str, b))}' THEN " + (f"'{row[k]}VAR:' || {names[k]}" if row[k] else names[k]) for b, row in P.TABLE.items())
            return f"CASE {arms} ELSE 'XVAR:' || {names[k]} END"
    else:
        key, none = f"coalesce({_EQ}, '')", "''"
        hits = (("11", "12"), ("21", "22"), ("11", "21"), ("12", "22"))

        def out(k: int) -> str:
            return f"CASE WHEN eq IN {hits[k]} THEN CASE WHEN {names[k]} LIKE 'type:%' THEN 'XVAR:' || {names[k]} ELSE 'XVAR' END ELSE {names[k]} END"

    return f"""raw AS (SELECT o.docid, o.rid, {key} AS eq, o.g1 AS x1, o.rel AS fr, o.g2 AS x2, i.g1 AS y1, i.rel AS sr, i.g2 AS y2, i.idx - o.idx AS dist {_GBAND}),
named AS (SELECT docid, rid, dist, {out(0)} AS f1, fr, {out(1)} AS f2, {out(2)} AS s1, sr, {out(3)} AS s2 FROM raw WHERE eq <> {none}),
enear AS (SELECT docid, rid, {_KEY}, min(dist) AS dist FROM named WHERE coalesce({_VT('f1', 'f2')} = {_VT('s1', 's2')}, true) GROUP BY docid, rid, {_KEY})"""


_EDIR = f"""SELECT {_KEY}, dist AS "window", count(*) AS cnt FROM enear GROUP BY ALL"""
_query("equality_single", _sql("near", _EDIR, _equality_sql(False)))(lambda s, d: P.directed(P.equality_nearest(_num(s, d), W)))
_query("equality_multiple", _sql("near", _EDIR, _equality_sql(True)))(lambda s, d: P.directed(P.equality_nearest(_num(s, d), W, True)))
_query("equality_unigrams", _sql("near", "SELECT a1, rel, a2, CAST(sum(n) AS BIGINT) AS n FROM (SELECT a1, rel, a2, n FROM uni UNION ALL SELECT f1, fr, f2, count(*) FROM enear GROUP BY ALL UNION ALL SELECT s1, sr, s2, count(*) FROM enear GROUP BY ALL) GROUP BY ALL", _equality_sql(False)))(
    lambda s, d: P.equality_unigrams(_num(s, d), P.equality_nearest(_num(s, d), W))
)
_query(
    "pair_head_counts",
    _sql("near", f"""SELECT {_KEY}, place, head, n FROM (SELECT *, row_number() OVER (PARTITION BY {_KEY}, place ORDER BY n DESC, head) AS r FROM (SELECT {_KEY}, place, head, count(*) AS n FROM
    (SELECT near.*, 'f1' AS place, arg1 AS head FROM near JOIN num USING (docid, rid) UNION ALL SELECT near.*, 'f2', arg2 FROM near JOIN num USING (docid, rid)) GROUP BY {_KEY}, place, head)) WHERE r <= 5"""),
)(lambda s, d: N.head_counts(N.counted(_num(s, d), W)))
_query(
    "mention_containment",
    """WITH sp AS (SELECT user_id AS docid, event_id AS span_id, event_id % 50 AS a, event_id % 50 + event_id % 7 + 1 AS b FROM events), me AS (SELECT user_id AS docid, event_id % 5 AS chain_id, event_id % 40 AS a, event_id % 40 + 5 + event_id % 9 AS b FROM events WHERE event_id % 3 > 0)
    SELECT sp.docid, span_id, array_to_string(list_sort(list(DISTINCT chain_id)), ',') AS chains FROM sp JOIN me ON sp.docid = me.docid AND me.a <= sp.a AND sp.b <= me.b GROUP BY ALL""",
)(
    lambda s, d: P.chains_of(
        (e := s.read.parquet(f"{d}/events.parquet")).select(F.col("user_id").alias("docid"), F.col("event_id").alias("span_id"), (F.col("event_id") % 50).alias("start"), (F.col("event_id") % 50 + F.col("event_id") % 7 + 1).alias("end")),
        e.select(F.col("user_id").alias("docid"), (F.col("event_id") % 5).alias("chain_id"), F.when(F.col("event_id") % 3 > 0, "a b").otherwise("a b c d e f").alias("text"), (F.col("event_id") % 40).alias("start"), (F.col("event_id") % 40 + 5 + F.col("event_id") % 9).alias("end")),
    ).select("docid", "span_id", F.array_join(F.col("chains").cast("array<string>"), ",").alias("chains"))
)

# --- more filters and text functions ---------------------------------------------------------
_SHOW = lambda a: f"replace(CASE WHEN regexp_matches({a}, '[tT]ype:') THEN regexp_extract({a}, '^(.*?)[tT]ype:', 1) || '[' || {_TYPE(a)} || ']' ELSE {a} END, 'XVAR', 'X')"
_query("display_tuples", _sql("near", f"SELECT a1, rel, a2, {_SHOW('a1')} AS shown1, {_SHOW('a2')} AS shown2 FROM uni"))(lambda s, d: P.unigrams(_num(s, d)).select("a1", "rel", "a2", T.display(F.col("a1")).alias("shown1"), T.display(F.col("a2")).alias("shown2")))
_query("text_blocks", "SELECT doc_id, i, substring(text, CAST(i * n + 1 AS INTEGER), n) AS block FROM (SELECT doc_id, text, CAST(floor(length(text) / 9.0 + 0.5) AS INTEGER) AS n, unnest(range(0, 10)) AS i FROM documents WHERE text IS NOT NULL)")(
    lambda s, d: s.read.parquet(f"{d}/documents.parquet").where("text is not null").select("doc_id", F.posexplode(T.blocks(F.col("text"), 9)).alias("i", "block")).withColumn("i", F.col("i").cast("bigint"))
)

# --- text forms ------------------------------------------------------------------------------


def _whole(s, d):
    """Pairs in the nested form: structs, counts by window, heads."""
    t = lambda a, r, b: F.struct(F.col(a).alias("a1"), F.col(r).alias("rel"), F.col(b).alias("a2"), F.array(F.lit(7), F.lit(-3)).alias("hashes"), F.array(F.lit("one here"), F.lit("two")).alias("sentences"), F.array(F.lit("1-2")).alias("ids"), F.create_map(a, F.lit(2)).alias("heads1"), F.create_map(b, F.lit(3)).alias("heads2"))
    heads = [F.create_map(c, F.lit(1)).alias(f"{c}_heads") for c in ("f1", "f2", "s1", "s2")]
    nested = _und(s, d).groupBy(*P.KEY).agg(*[F.map_from_entries(F.collect_list(F.struct(F.col("window").cast("int"), F.col(c).cast("int")))).alias(n) for c, n in (("dir", "counts"), ("und", "biterm"))])
    return nested.select(t("f1", "fr", "f2").alias("first"), t("s1", "sr", "s2").alias("second"), "counts", "biterm", *heads)


def _flat(df: DataFrame, *more: str) -> DataFrame:
    names = zip(P.KEY, ("first.a1", "first.rel", "first.a2", "second.a1", "second.rel", "second.a2"), strict=True)
    return df.select(*[F.col(c).alias(n) for n, c in names], *more)


_query("tuple_codec", _sql("near", "SELECT * FROM uni"))(
    lambda s, d: C.parse_tuples(C.format_tuples(P.unigrams(_num(s, d)).select("a1", "rel", "a2", F.array(F.lit(1)).alias("hashes"), F.array(F.lit("x y")).alias("sentences"), F.array(F.lit("id")).alias("ids"), F.create_map("a1", F.lit(1)).alias("heads1"), F.create_map("a2", F.lit(1)).alias("heads2"), "n"))).select("a1", "rel", "a2", "n")
)
_query("pair_codec", _sql("und", f"""SELECT {_KEY}, "window", dir FROM und"""))(
    lambda s, d: _flat(C.parse_pairs(C.format_pairs(_whole(s, d))), F.explode("counts").alias("window", "dir")).withColumns({"window": F.col("window").cast("bigint"), "dir": F.col("dir").cast("bigint")})
)
_query("measures_codec", _sql("und", f"SELECT {_KEY}, max(und) AS max_und, 5 AS nf, 9 AS ns, f1 || ':1' AS heads FROM und GROUP BY {_KEY}"))(
    lambda s, d: _flat(C.parse_measures(C.format_measures(_whole(s, d).withColumn("nf", F.lit(5)).withColumn("ns", F.lit(9)))), F.array_max(F.map_values("biterm")).cast("bigint").alias("max_und"), F.col("nf").cast("int").alias("nf"), F.col("ns").cast("int").alias("ns"), F.concat_ws(":", F.map_keys("f1_heads")[0], F.map_values("f1_heads")[0].cast("string")).alias("heads"))
)
_GT = lambda a: f"CASE WHEN contains({a}, ':') THEN 'type:' || split_part({a}, ':', 1) ELSE {a} END"
_GRAPH = f"""graph AS (SELECT {_GT('f1')} || '|' || fr || '|' || {_GT('f2')} AS t1, {_GT('s1')} || '|' || sr || '|' || {_GT('s2')} AS t2, w AS "window", CAST(sum(CASE WHEN "window" <= w THEN cnt ELSE 0 END) AS BIGINT) AS cnt FROM dir, range(1, {W + 1}) t(w) GROUP BY 1, 2, 3)"""


def _graph(s, d):
    one = _dir(s, d).groupBy(*P.KEY).agg(F.map_from_entries(F.collect_list(F.struct(F.col("window").cast("int"), F.col("cnt").cast("int")))).alias("counts"))
    return C.graph_edges(one.select(F.struct(F.col("f1").alias("a1"), F.col("fr").alias("rel"), F.col("f2").alias("a2")).alias("first"), F.struct(F.col("s1").alias("a1"), F.col("sr").alias("rel"), F.col("s2").alias("a2")).alias("second"), "counts"), W).withColumn("window", F.col("window").cast("bigint"))


_query("graph_edges", _sql("near", "SELECT * FROM graph", _GRAPH))(_graph)
_query("dump_edges", _sql("near", """SELECT t1, t2, CAST(sum(cnt) AS BIGINT) AS n, string_agg(cnt, chr(9) ORDER BY "window") AS counts FROM graph GROUP BY t1, t2 HAVING sum(cnt) > 25""", _GRAPH))(lambda s, d: K.dump_edges(_graph(s, d)))
_ENDS = ("k1|click on|low", "k2|purchase|mid", "type:Type|click on|high", "nobody|went|away")
_query("lookup_edges", _sql("near", """SELECT t1, t2, w AS "window", coalesce(cnt, 0) AS cnt FROM (SELECT t1, t2, w FROM (SELECT unnest(%s) AS t1), (SELECT unnest(%s) AS t2), range(1, 11) r(w)) LEFT JOIN (SELECT t1, t2, "window" AS w, cnt FROM graph WHERE t1 IN %s AND t2 IN %s) USING (t1, t2, w)""" % (list(_ENDS), list(_ENDS), _ENDS, _ENDS), _GRAPH))(
    lambda s, d: K.lookup_edges(_graph(s, d), s.range(1).select(F.explode(F.array(*map(F.lit, _ENDS))).alias("t1")).select("t1", F.explode(F.array(*map(F.lit, _ENDS))).alias("t2")).select("t1", "t2", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(10).cast("bigint"))).alias("window")))
)
_query(
    "neighbourhood_report",
    _sql("cum", f"""SELECT 'seed' AS kind, 'seed_NSEP_{SEED}' AS value UNION ALL SELECT 'onehop', 'onehop_NSEP_' || t1 || '_NSEP_' || t2 || '_NSEP_' || format('{{:.6f}}', scp) FROM (SELECT DISTINCT t1, t2, scp FROM sym WHERE t1 = '{SEED}' OR t2 = '{SEED}')
    UNION ALL SELECT 'twohop', 'twohop_NSEP_' || t1 || '_NSEP_' || t2 || '_NSEP_' || format('{{:.6f}}', scp) FROM (SELECT DISTINCT via, t1, t2, scp FROM sym JOIN ends ON t1 = via OR t2 = via WHERE t1 <> '{SEED}' AND t2 <> '{SEED}')""", _EDGE,
         f"""ends AS (SELECT DISTINCT via FROM (SELECT CASE WHEN t1 = '{SEED}' THEN t2 ELSE t1 END AS via FROM sym WHERE t1 = '{SEED}' OR t2 = '{SEED}' ORDER BY round(scp, 12) DESC, t1, t2 LIMIT 10) WHERE via <> '{SEED}')"""),
)(lambda s, d: K.report(_sym(s, d), SEED, 10))
_query("typed_variants", _sql("rec", "SELECT x[1] AS arg1, rel, x[2] AS arg2 FROM (SELECT rel, unnest([['type:' || split_part(t1, ':', 1), arg2], [arg1, 'type:' || split_part(t2, ':', 1)], ['type:' || split_part(t1, ':', 1), 'type:' || split_part(t2, ':', 1)]]) AS x FROM (SELECT *, arg1types[1] AS t1, arg2types[1] AS t2 FROM rec))"))(
    lambda s, d: C.typed_variants(records(s, d).withColumns({"arg1_types": F.col("arg1types")[0], "arg2_types": F.col("arg2types")[0]}))
)

# --- hand-labelled pairs -----------------------------------------------------------------------
_CONF = "conf AS (SELECT lower(arg1) AS arg1, any_value(rel) AS rel, lower(arg2) AS arg2, list_sort(list(confidence))[count(*) // 2 + 1] AS median, min(confidence) AS least, max(confidence) AS most, avg(confidence) AS mean FROM rec GROUP BY lower(arg1), rec.rel, lower(arg2))"
_AGG = lambda p: {"median": f"{p}median", "min": f"{p}least", "max": f"{p}most", "average": f"{p}mean", "max+average": f"{p}most + {p}mean", "avg-below": f"CASE WHEN {p}mean < 1 THEN 0 ELSE {p}mean END"}
_query("confidence_select", _sql("rec", " UNION ALL ".join(f"SELECT arg1, rel, arg2, '{k}' AS agg, round({e}, 6) AS value FROM conf" for k, e in _AGG("").items()), _CONF))(
    lambda s, d: _r(K.confidence(records(s, d)).select(F.lower("arg1").alias("arg1"), "rel", F.lower("arg2").alias("arg2"), F.explode(F.array(*[F.struct(F.lit(a).alias("agg"), U.aggregate(a).alias("value")) for a in U.AGGREGATES])).alias("x")).select("arg1", "rel", "arg2", "x.agg", "x.value"), "value")
)
_BAD = f"(a1 IN {T.PRONOUNS} OR a2 IN {T.PRONOUNS} OR regexp_matches(a1, '[0-9]') OR regexp_matches(a2, '[0-9]') OR rel IN {T.PREPOSITIONS} OR (rel LIKE 'be %' AND rel[4:] IN {T.PREPOSITIONS}) OR list_has_any(string_split(rel, ' '), ['say', 'tell']) OR regexp_matches(rel, '[^0-9a-zA-Z ]'))"
_query("bad_tuples", _sql("near", f"SELECT a1, rel, a2, {_BAD} AS bad FROM uni"))(lambda s, d: P.unigrams(_num(s, d)).select("a1", "rel", "a2", U.bad_tuple("pronouns,numbers,stoprels", F.col("a1"), F.col("rel"), F.col("a2")).alias("bad")))
_query("best_partners", _sql("comb", f"SELECT {_KEY}, round(und_first, 6) AS und_first FROM comb WHERE f1 = 'type:even' AND fr = 'click on' AND f2 = 'type:number' AND {_VALID} ORDER BY round(und_first, 9) DESC, s1, sr, s2 LIMIT 25"))(
    lambda s, d: _r(U.best_partners(_comb(s, d), {"f1": "Type:even ", "fr": "click on", "f2": "type:number"}, 25).select(*P.KEY, "und_first"), "und_first")
)
#: A stand-in for hand labels: a fixed function of the counts.
_LABEL = "(nf + 2 * ns + max_und) % 3"


def _tagged(counts):
    return counts.groupBy(*P.KEY).agg(F.max("nf").alias("nf"), F.max("ns").alias("ns"), F.max("und").alias("max_und")).select(*P.KEY, F.expr(f"CAST({_LABEL} = 0 AS int)").alias("label"))


def _und_counts(s, d):
    return M.windows(_wide_counts(s, d))


def _labelled(s, d):
    item = F.concat_ws("|", *P.KEY).alias("item")
    counts = M.windows(stored(_wide_counts(s, d), "counts"))
    return counts.join(_tagged(counts), P.KEY).select(*P.KEY, "window", "und", "nf", "ns", "label", item)


_query("fill_counts", _sql("comb", f"SELECT {_KEY}, CAST({_LABEL} = 0 AS INTEGER) AS label, nf, ns, max_und FROM comb WHERE {_VALID} AND NOT regexp_matches(s1, '[0-9]') AND NOT regexp_matches(s2, '[0-9]')"))(
    lambda s, d: (lambda c: U.with_counts_of(_tagged(M.windows(c)), M.combined_wide(c, DELTA, ALPHA, AT), "numbers"))(stored(_wide_counts(s, d), "counts")).select(*P.KEY, "label", "nf", "ns", "max_und")
)
_query("tagged_codec", _sql("und", f"SELECT {_KEY}, 1 AS label, max(und) AS max_und FROM und GROUP BY {_KEY}"))(
    lambda s, d: C.parse_tagged_counts(C.format_tagged_counts(_flat(_whole(s, d), "biterm", "counts", F.lit(0).alias("first_bad"), F.lit(0).alias("second_bad"), F.lit(1).alias("label"), F.lit(3).alias("nf"), F.lit(4).alias("ns"), F.lit(0.5).alias("score")), "score"), True)
    .select(*P.KEY, "label", F.array_max(F.map_values("biterm")).cast("bigint").alias("max_und"))
)
_ALPHAS, _DELTAS, _AGGS, _CUTS = [0.5, 0.9], [10.0, 1000.0], ["median", "max+average"], [0.0, 0.02, 0.5]
_GRIDSQL = f"""sums AS (SELECT alpha, concat_ws('|', {_KEY}) AS item, {_KEY}, max(nf) AS nf, max(ns) AS ns, max(und) AS max_und, sum(CAST(und AS DOUBLE) * und * pow(alpha, "window")) / sum(pow(alpha, "window")) AS total FROM cnt2, (SELECT unnest({_ALPHAS}) AS alpha) GROUP BY alpha, {_KEY}),
sc AS (SELECT sums.*, delta, total / ((nf + delta) * (ns + delta)) AS score, CASE WHEN {_LABEL} = 0 THEN 1 ELSE 0 END AS label, {', '.join(f'{p}.{c} AS {p}_{c}' for p in ('c1', 'c2') for c in ('median', 'most', 'mean'))}
    FROM sums JOIN conf c1 ON c1.arg1 = f1 AND c1.rel = fr AND c1.arg2 = f2 JOIN conf c2 ON c2.arg1 = s1 AND c2.rel = sr AND c2.arg2 = s2, (SELECT unnest({_DELTAS}) AS delta)),
cells AS ({" UNION ALL ".join(["SELECT item, label, delta, alpha, 'none' AS agg, 0.0 AS threshold, round(score, 9) AS score FROM sc"] + [f"SELECT item, label, delta, alpha, '{a}', {t}, CASE WHEN least({_AGG('c1_')[a]}, {_AGG('c2_')[a]}) >= {t} THEN round(score, 9) ELSE 0 END FROM sc" for a in _AGGS for t in _CUTS])}),
pts AS (SELECT *, h / t AS recall, h / n AS precision FROM (SELECT delta, alpha, agg, threshold, row_number() OVER w AS n, sum(label) OVER (w ROWS UNBOUNDED PRECEDING) AS h, sum(label) OVER (PARTITION BY delta, alpha, agg, threshold) AS t FROM cells WINDOW w AS (PARTITION BY delta, alpha, agg, threshold ORDER BY score DESC, item)))"""
_query(
    "confidence_grid",
    _sql("meas", """SELECT CAST(delta AS DOUBLE) AS delta, CAST(alpha AS DOUBLE) AS alpha, agg, CAST(threshold AS DOUBLE) AS threshold, round(sum(a), 6) AS auc FROM (SELECT delta, alpha, agg, threshold, (recall - coalesce(lag(recall) OVER v, 0)) * (precision + coalesce(lag(precision) OVER v, 1)) / 2 AS a FROM pts WINDOW v AS (PARTITION BY delta, alpha, agg, threshold ORDER BY n)) GROUP BY ALL""", _CONF, _GRIDSQL),
)(lambda s, d: _r(U.grid_search(_labelled(s, d), K.confidence(records(s, d)), "scp", _DELTAS, _ALPHAS, _AGGS, _CUTS), "auc"))
_query("grid_scores", _sql("meas", f"""SELECT {_KEY}, CAST(delta AS DOUBLE) AS delta, CAST(alpha AS DOUBLE) AS alpha, round(CASE WHEN least_und > 0 THEN sl - ln(nf + ns + 2 * delta) END, 6) AS score FROM
    (SELECT {_KEY}, alpha, max(nf) AS nf, max(ns) AS ns, min(und) AS least_und, sum(CASE WHEN und > 0 THEN ln(und) END * pow(alpha, "window")) / sum(pow(alpha, "window")) AS sl FROM cnt2, (SELECT unnest({_ALPHAS}) AS alpha) GROUP BY alpha, {_KEY}), (SELECT unnest({_DELTAS}) AS delta)"""))(
    lambda s, d: _r(U.scores(_und_counts(s, d), "pmi", _DELTAS, _ALPHAS, P.KEY).withColumn("score", F.when(F.col("score") > float("-inf"), F.col("score"))), "score")
)


from pairloom import catalog_records  # noqa: E402, F401  (registers its queries, over the pieces above)
