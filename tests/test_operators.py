"""Micro-fixtures of the co-occurrence operators."""

import glob
import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from pairloom import catalog
from pairloom.functions import text as T
from pairloom.operators import counting as N
from pairloom.operators import extraction as X
from pairloom.operators import measures as M
from pairloom.operators import pairs as P
from pairloom.operators import ranking as K
from pairloom.operators import records as R
from pairloom.operators import tuning as U
from pairloom.sources import codecs

SF = "/root/testdata/sf0.001"
REC = "docid string, sentid int, extrid int, rid long, sentence string, arg1 string, arg1types array<string>, rel string, arg2 string, arg2types array<string>"


def test_java_hash(spark):
    assert spark.range(1).select(T.java_hash(F.lit("abc"))).first()[0] == 96354
    assert spark.range(1).select(T.java_hash(F.lit("polygenelubricants"))).first()[0] == -2147483648


def test_cumulative_fixture(spark):
    key = {c: "x" for c in P.KEY}
    rows = spark.createDataFrame([(*key.values(), w, c) for w, c in ((1, 1), (2, 1), (3, 2))], ", ".join(f"{c} string" for c in P.KEY) + ", window long, cnt long")
    got = {r.window: r.cnt for r in M.cumulative(rows, 1, 5).collect()}
    assert got == {1: 1, 2: 2, 3: 4, 4: 4, 5: 4}


def test_decayed_average(spark):
    rows = spark.createDataFrame([(1, 0.1), (2, 0.2), (3, 0.3)], "window int, v double")
    assert round(rows.agg(M.decayed(F.col("v"), 0.9)).first()[0], 6) == 0.192989


def test_time_type_displaces_number(spark):
    df = spark.createDataFrame([("May", ["Type:time_unit", "Type:number", " "])], "h string, t array<string>")
    assert sorted(df.select(R.representations(F.col("h"), F.col("t"))).first()[0]) == ["may", "type:time_unit"]


def test_only_first_preposition_counts(spark):
    rows = [("d", 1, 0, 1, "a sat in b", "a", [], "sat in on", "b", []), ("d", 2, 0, 2, "a sat b", "a", [], "sat in", "b", [])]
    assert [r.rid for r in R.said_preposition(spark.createDataFrame(rows, REC)).collect()] == [1]


def test_nearest_counts_once(spark):
    rows = [("d", i, 0, i, f"{a} r {b}", a, [], "r", b, []) for i, (a, b) in enumerate((("a", "b"), ("c", "e"), ("c", "e")))]
    got = P.nearest(P.numbered(spark.createDataFrame(rows, REC)), 10)
    assert sorted((r.rid, r.s1, r.dist) for r in got.collect()) == [(0, "c", 1), (1, "c", 1)]


def test_coref_table_has_sixteen_rows():
    assert len(P.TABLE) == 10  # the other six: none, and all X


def test_disjoint_merge_keeps_first(spark):
    rows = spark.createDataFrame([("k", "d2", [2, 3], 5), ("k", "d1", [1, 2], 2), ("k", "d3", [9], 1)], "key string, docid string, hashes array<int>, cnt long")
    assert P.merge_disjoint(rows).first().asDict() == {"key": "k", "n": 3, "n_docs": 2}


def test_span_containment(spark):
    spans = spark.createDataFrame([("d", 1, 2, 5), ("d", 2, 0, 9)], "docid string, span_id int, start int, end int")
    mentions = spark.createDataFrame([("d", 7, "abc d", 1, 6), ("d", 8, "a b c d e f", 0, 20)], "docid string, chain_id int, text string, start int, end int")
    assert [(r.span_id, r.chains) for r in P.chains_of(spans, mentions).collect()] == [(1, [7])]


def test_empty_query_finds_nothing(spark):
    df = spark.createDataFrame([("a", "b")], "f1 string, fr string")
    assert K.search(df, {"f1": " "}).count() == 0
    assert K.search(df, {"f1": "A"}).count() == 1


def test_record_codec_round_trip(spark):
    line = "\t".join(["doc", "3", "Ann sat down", "4", "1,2,2", "Ann_SPAN_0-1", "sat_SPAN_1-2", "down_SPAN_2-3", "Ann_SPAN_0-1", "sat_SPAN_1-2", "down_SPAN_2-3", "x", "Type:a,Type:b", "", "0.5"])
    line = line.replace("\tx\t", "\t")
    rec = codecs.parse_records(spark.createDataFrame([(line,), ("bad\tline",)], "value string"))
    assert rec.count() == 1
    again = codecs.parse_records(codecs.format_records(rec))
    assert again.collect() == rec.collect() or again.drop("confidence").collect() == rec.drop("confidence").collect()


def test_app_lines(spark):
    lines = spark.createDataFrame([("d|1|s|a|a|T:x,T:y|r|r|b|b|",), ("short|1",)], "value string")
    row = codecs.parse_app_lines(lines).collect()
    assert len(row) == 1 and row[0].arg1types == ["T:x", "T:y"] and row[0].arg2types == []


def test_tuple_codec(spark):
    t = spark.createDataFrame([("a", "r", "b", [1], ["s one"], ["i1"], {"h": 2}, {"g": 1}, 3)], "a1 string, rel string, a2 string, hashes array<int>, sentences array<string>, ids array<string>, heads1 map<string,int>, heads2 map<string,int>, n long")
    assert codecs.parse_tuples(codecs.format_tuples(t)).collect() == t.collect()


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "value string").select(f(F.col("value"))).first()[0]


def test_text_functions(spark):
    assert one(spark, "be sit in", T.verb_of) == "sit" and one(spark, "be in", T.verb_of) == "be in"
    assert one(spark, "XVAR:type:person:Number", T.type_name) == "person" and one(spark, "plain", T.type_name) == ""
    assert one(spark, "XVAR:type:person", T.display) == "X:[person]"
    assert one(spark, "a\tb\tc", T.first_rest) == ["a", "b\tc"] and one(spark, "abc", T.first_rest) is None
    assert one(spark, " XVAR:he ", T.pronoun) and not one(spark, "her", T.pronoun)
    assert one(spark, "12x", lambda c: T.number_or(c, "int", 4)) == 4
    assert one(spark, "a|b", lambda c: T.nth_field(c, "[|]", 5)) is None


@pytest.mark.parametrize("n", range(10))
def test_blocks(spark, n):
    got = one(spark, "123456789", lambda c: T.blocks(c, n))
    size = int(9 / n + 0.5) if n else 9
    assert got == (["123456789"[i * size : (i + 1) * size] for i in range(n + 1)] if n else ["123456789"])


def test_window_counts(spark):
    assert one(spark, "1:2,10:3,1:5", T.window_counts_of_text) == {1: 5, 10: 3}
    assert one(spark, "1:2,x", T.window_counts_of_text) == {} and one(spark, "", T.window_counts_of_text) == {}
    assert one(spark, "1:2,10:3", lambda c: T.window_counts_text(T.window_counts_of_text(c))) == "1:2,10:3"
    assert one(spark, "a_CSEP_1_ESEP_bad_ESEP_a_CSEP_4_ESEP_b_CSEP_x", T.counts_of_text) == {"a": 4}


EQ = REC + ", chain1 string, chain2 string"


def test_equality_pairs(spark):
    rows = [("d", 1, 0, 1, "s", "Ann", ["Type:person"], "met", "Bob", [], "c1", "c2"), ("d", 2, 0, 2, "s", "She", ["Type:person", "Type:city"], "left", "Rome", [], "c1", None)]
    rec = P.numbered(spark.createDataFrame(rows, EQ))
    single = {(r.f1, r.f2, r.s1, r.s2) for r in P.equality_nearest(rec).collect()}
    assert single == {("XVAR", "bob", "XVAR", "rome"), ("XVAR", "bob", "XVAR:type:person", "rome"), ("XVAR", "bob", "XVAR:type:city", "rome"), ("XVAR:type:person", "bob", "XVAR", "rome"), ("XVAR:type:person", "bob", "XVAR:type:person", "rome")}
    many = {(r.f1, r.s1) for r in P.equality_nearest(rec, 10, True).collect()}
    assert ("XVAR:ann", "XVAR:she") in many and ("XVAR:type:person", "XVAR:type:city") not in many and len(many) == 5
    n = {(r.a1, r.rel): r.n for r in P.equality_unigrams(rec, P.equality_nearest(rec)).collect()}
    assert n["XVAR", "met"] == 3 and n["ann", "met"] == 1


def test_chains_may_be_sets(spark):
    rows = [("d", 1, 0, 1, "s", "a", [], "met", "b", [], ["c1", "c9"], []), ("d", 2, 0, 2, "s", "e", [], "left", "f", [], ["c2"], ["c9"])]
    rec = P.numbered(spark.createDataFrame(rows, REC + ", chain1 array<string>, chain2 array<string>"))
    assert [(r.eq, r.f1, r.s2) for r in P.coref_single(rec).collect()] == [("12", "XVAR", "XVAR")]


def test_pair_codec_drops_bad_lines(spark):
    t = "a\tr\tb\t1,x\ts one_SENT_SEP_s two\ti1\th_CSEP_2\tg_CSEP_1"
    good = f"{t}_RG_SEP_{t}_RGC_SEP_1:2,3:4_RGC_SEP_a_CSEP_1\t\t\tq_CSEP_5"
    lines = spark.createDataFrame([(good,), (f"{t}_RGC_SEP_1:2_RGC_SEP_\t\t\t",), ("a\tb",), ("",)], "value string")
    got = codecs.parse_pairs(lines).collect()
    assert len(got) == 1 and got[0].counts == {1: 2, 3: 4} and got[0].first.hashes == [1, -1] and got[0].s2_heads == {"q": 5} and got[0].f2_heads == {}
    whole = codecs.parse_measures(spark.createDataFrame([(good + "_URGC_1:3_MSEP_7_MSEP_8",), (good + "_URGC_1:3",)], "value string"))
    assert sorted((r.nf, r.ns, r.biterm[1]) for r in whole.collect()) == [(0, 0, 3), (7, 8, 3)]
    assert codecs.parse_measures(codecs.format_measures(whole)).count() == 2


def test_label_codecs(spark):
    counts = ",".join(f"{w}:{10 * w}" for w in range(50))
    line = f"a\tr\tb\tc\tq\td\t0\tx\t1_TRGC_SEP_{counts}_TRGC_SEP__TRGC_SEP_10_TRGC_SEP_10"
    got = codecs.parse_tagged_counts(spark.createDataFrame([(line,), ("short",)], "value string"))
    row = got.first()
    assert got.count() == 1 and row.biterm[49] == 490 and row.counts == {} and (row.first_bad, row.second_bad, row.label, row.nf) == (0, 0, 1, 10)
    assert codecs.parse_tagged_counts(codecs.format_tagged_counts(got.withColumn("score", F.lit(0.25)), "score"), True).first().score == 0.25
    assert codecs.parse_annotated(spark.createDataFrame([("first\t.1\t.4\t.0\t.2\t1\ta\tr\tb",), ("first\tx",)], "value string")).count() == 1
    assert codecs.parse_scored_tuples(spark.createDataFrame([("2.5\t0\t0\ta\tr\tb",), ("z\t0\t0\ta\tr\tb",)], "value string")).first().score == 2.5
    hand = "\t".join(["a", "a1", "r", "b", "b1", "1", "z", "1", "c", "c1", "q", "d", "d1", "5", "3", "9", "8", "0.5"])
    assert codecs.parse_hand_labels(spark.createDataFrame([(hand,)], "value string")).first().asDict() == {
        "f1": "a", "fr": "r", "f2": "b", "s1": "c", "sr": "q", "s2": "d", "first_bad": 1, "second_bad": 0, "label": 1, "biterm": 5, "bigram": 3, "nf": 9, "ns": 8, "conditional": 0.5,
    }
    aff = spark.createDataFrame([(([0.5, 0.25], 0.3),) * 4], "und_first struct<windows:array<double>,combined:double>, dir_first struct<windows:array<double>,combined:double>, und_second struct<windows:array<double>,combined:double>, dir_second struct<windows:array<double>,combined:double>")
    assert codecs.parse_affinities(codecs.format_affinities(aff)).collect() == aff.collect()


def test_graph_forms(spark):
    lines = spark.createDataFrame([("a\tr\tb\tc\tq\td\tx\ty\t1:2,3:1",)], "value string")
    assert [r.cnt for r in codecs.graph_edges_flat(lines, 4).orderBy("window").collect()] == [2, 2, 3, 3]
    rows = spark.createDataFrame([("ann", "saw", "rome", "person:x", " ")], "arg1 string, rel string, arg2 string, arg1_types string, arg2_types string")
    assert [tuple(r) for r in codecs.typed_variants(rows).collect()] == [("type:person", "saw", "rome")]


def test_app_directory(spark, tmp_path):
    for name, ids in (("one", "ab"), ("two", "cc")):
        (tmp_path / name).write_text("\n".join(f"{d}|{i}|s|a|a||r|r|b|b|" for i, d in enumerate(ids)) + "\nbad line\n")
    got = codecs.read_app_directory(spark, str(tmp_path)).collect()
    assert sorted(r.docid for r in got) == ["a", "a", "c", "c"] and len({r.extrid for r in got}) == 4
    assert sorted(r.value for r in codecs.project_fields(spark, str(tmp_path / "one"), [0, 1], "[|]").collect()) == ["a 0", "b 1", "bad line"]


def test_examples_share_no_hash(spark):
    rows = [("a", "r", "b", i, f"s{i}", c, h) for i, (c, h) in enumerate(((0.5, [1]), (0.9, [1, 2]), (0.4, [2, 3]), (0.3, [3]), (0.2, [4])))]
    df = spark.createDataFrame(rows, "arg1 string, rel string, arg2 string, rid long, sentence string, confidence double, hashes array<int>")
    assert sorted(r.sentence for r in K.examples(df).collect()) == ["s1", "s4"]


def test_confidence_aggregates(spark):
    df = spark.createDataFrame([("like", 0.2, 0.1, 0.9, 0.4), ("say so", 0.2, 0.1, 0.9, 0.4)], "rel string, median double, least double, most double, mean double")
    assert [round(r[0], 6) for r in df.select(U.aggregate("max+average")).collect()] == [1.3, 0.0]
    assert [r[0] for r in df.select(U.aggregate("avg-below")).collect()] == [0.0, 0.0] and df.select(U.aggregate("?")).first()[0] == -1.0


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", ["ordinal", "directed_pairs", "undirected_pairs", "flagship", "coref_multiple", "sentence_hashes", "top_tuples", "auc_grid", "merge_mentions", "equality_single", "equality_unigrams", "prune_results", "sort_keys", "confidence_grid", "measures_codec", "graph_edges", "bad_tuples"])
def test_sql_twin(spark, con, name):
    a, b = catalog.QUERIES[name](spark, SF).toPandas(), con.sql(catalog.SQL[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    assert sorted(map(repr, a[cols].itertuples(index=False, name=None))) == sorted(map(repr, b[cols].itertuples(index=False, name=None)))


def test_top_relations_query_keeps_all(spark, monkeypatch):
    rec = spark.range(300).select(F.col("id").cast("string").alias("docid"), F.concat(F.lit("r"), F.col("id") % 150).alias("rel"))
    monkeypatch.setattr(catalog, "records", lambda s, d: rec)
    assert catalog.QUERIES["top_relations"](spark, SF).count() == 150 and K.top_relations(rec).count() == 100


def test_longest_common_place(spark):
    rows = [("the old man sat down", "old man"), ("the old man sat down", "old men"), ("abc xbc", "bc"), ("abc", "zz"), ("abc", " "), ("sat down the man sat up", "man sat  up"), ("aXbYaXb", "aXbZ")]
    got = [tuple(r[0]) for r in spark.createDataFrame(rows, "s string, a string").select(T.common_span(F.col("s"), F.col("a"))).collect()]

    def brute(s, a):
        a = a.strip()
        best = max(((n, -i) for i in range(len(s)) for n in range(1, len(s) - i + 1) if s[i : i + n] in a), default=None)
        return (-best[1], -best[1] + best[0]) if best else (0, 0)

    assert got == [brute(*r) for r in rows]


def test_clauses_count_a_leading_blank(spark):
    text = "One two three four five. the dog ran off, no"
    got = spark.createDataFrame([(text,)], "s string").select(T.sentence_hashes(F.col("s"))).first()[0]

    def java(t):
        h = 0
        for c in re.sub("[^a-z0-9]", "", t.lower()):
            h = (31 * h + ord(c)) % 2**32
        return h - 2**32 if h >= 2**31 else h

    assert got == [java(text), java("One two three four five"), java(" the dog ran off")]


def test_mentions_of_documents(spark):
    line = "d1_DOCID_SEP_rec_TDOC_SEP_0,10_TDOC_SEP_Ann_MFIELD_SEP_3_VALSEP_she_MFIELD_SEP_20_MSEP_bad_MSEP_Ann_MFIELD_SEP_3_KEYVAL_SEP_Bob_MFIELD_SEP_x_VALSEP_he_MFIELD_SEP_9_KEYVAL_SEP_alone_KEYVAL_SEP_Ann_MFIELD_SEP_3_VALSEP_her_MFIELD_SEP_ 40"
    rows = codecs.parse_mentions(spark.createDataFrame([(line,), ("d2_DOCID_SEP_rec",)], "value string")).collect()
    assert [(r.docid, r.key_text, r.key_start, r.text, r.start, r.end) for r in rows] == [("d1", "Ann", 3, "her", 40, 43)]  # of two chains with one key the last counts
    offsets = codecs.parse_offsets(spark.createDataFrame([(line,)], "value string")).collect()
    assert [(r.position, r.offset) for r in offsets] == [(0, 0), (1, 10)]


def test_documents_round_trip(spark):
    df = spark.createDataFrame([("a", 1, "x\ty"), ("a", 0, "first"), ("b", 0, "only")], "docid string, position int, value string")
    lines = codecs.format_documents(df)
    assert sorted((r.docid, r.position, r.value) for r in codecs.parse_documents(lines.select("value")).collect()) == [("a", 0, "first"), ("a", 1, "x\ty"), ("b", 0, "only")]
    assert codecs.parse_documents(spark.createDataFrame([("no separator",), ("a_DOCID_SEP_",)], "value string")).count() == 0


def test_app_lines_stand_in(spark):
    lines = spark.createDataFrame([("d|1|s|a|a|T:x|r|r|b|b|",), ("short|1",), ("d|x|s|a|a||r|r|b|b|",)], "value string")
    assert sorted((r.docid, r.sentid) for r in codecs.parse_app_lines(lines, stand_in=True).collect()) == [("NA", -1), ("NA", -1), ("d", 1)]


def test_app_directory_numbers_without_gaps(spark, tmp_path):
    for name, lines in (("a/one", ["d1|1|s|a|a||r|r|b|b|", "bad"]), ("b/two", ["d2|1|s|a|a||r|r|b|b|"] * 3)):
        (tmp_path / name).parent.mkdir()
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    got = codecs.read_app_directory(spark, str(tmp_path), recursive=True, stand_in=True).collect()
    assert sorted(r.extrid for r in got) == [0, 1, 2, 3, 4] and sorted(r.docid for r in got) == ["d1", "d1", "d2", "d2", "d2"]


def test_mention_keys(spark):
    rec = spark.createDataFrame([("d", 1, "Ann", 0, 3, "Bob", 10, 13), ("d", 2, "she", 20, 23, "him", 30, 33), ("d", 3, "Ann", 0, 3, "x", 900, 901)], "docid string, rid int, arg1 string, arg1_start int, arg1_end int, arg2 string, arg2_start int, arg2_end int")
    mentions = spark.createDataFrame([("d", 1, "Ann A", 0, 5), ("d", 1, "she", 20, 23), ("d", 2, "Bob", 10, 13), ("d", 3, "Bob", 10, 13), ("d", 3, "him", 30, 33), ("d", 4, "a b c d e f", 899, 910)], "docid string, chain_id int, text string, start int, end int")
    got = {r.rid: (set(r.chain1), set(r.chain2)) for r in X.mention_keys(rec, mentions).collect()}
    assert got[1][0] & got[2][0] and got[1][1] & got[2][1] and not got[1][0] & got[2][1]
    assert got[1][0] == got[3][0] and got[3][1] == {"x:900-901"}


def test_merge_needs_both_sides_disjoint(spark):
    side = lambda *h: (list(h), ["i%d" % x for x in h], ["s"])
    heads = [("h", 1)]
    rows = [(d, "a", "r", "b", "c", "q", "e", side(*f), side(*s), [("1", 2)], heads, [(f"g{d}", 1)], heads, heads) for d, f, s in (("d1", (1,), (5,)), ("d2", (2,), (5,)), ("d3", (1,), (6,)), ("d4", (3,), (7,)), ("d5", (9,), (3,)))]
    spec = "docid string, f1 string, fr string, f2 string, s1 string, sr string, s2 string, " + ", ".join(f"{p} struct<hashes:array<int>,ids:array<string>,sentences:array<string>>" for p in ("first", "second")) + ", " + ", ".join(f"{c} array<struct<v:string,n:bigint>>" for c in ("counts", "f1_heads", "f2_heads", "s1_heads", "s2_heads"))
    got = X.merge_pairs(spark.createDataFrame(rows, spec), more_than=3, most=2).first()
    assert got.n_docs == 3 and got.h1 == [1, 3, 9] and got.h2 == [5, 7, 3] and [tuple(e) for e in got.counts] == [("1", 6)]
    assert [tuple(e) for e in got.f1_heads] == [("h", 3)] and [e.v for e in got.f2_heads] == ["gd1", "gd4"]  # heads and ids stop growing at two
    assert got.ids1 == ["i1", "i3"]
    assert X.merge_pairs(spark.createDataFrame(rows, spec), more_than=6).count() == 0


def test_redundant_records_of_one_length_both_go(spark):
    rows = [("d", 1, 0, 1, "s", "Ann", [], "met", "Bob", []), ("d", 1, 1, 2, "s", "Bob", [], "met", "Ann", []), ("d", 1, 2, 3, "s", "Eve", [], "saw", "Tom", []), ("d", 1, 3, 4, "s", "Eve", [], "saw", "Tom Smith", [])]
    assert [r.rid for r in R.drop_redundant(spark.createDataFrame(rows, REC)).collect()] == [4]


def test_gapless_numbers(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 7)
    got = R.gapless(df, [-F.col("k"), F.col("id")], "at").collect()
    want = sorted(range(1000), key=lambda i: (-(i % 7), i))
    assert [r.id for r in sorted(got, key=lambda r: r["at"])] == want and sorted(r["at"] for r in got) == list(range(1000))


def test_gapless_numbers_of_equal_and_missing_keys(spark, monkeypatch):
    """Ranges are found without a comparison with every bound for each row, and hold all rows of a key."""
    df = spark.range(500).select("id", F.when(F.col("id") % 5 > 0, F.col("id") % 3).alias("k"))
    whole = R.gapless(df, [F.col("k")], "at")
    assert ">=" not in whole._jdf.queryExecution().optimizedPlan().toString()
    got = {r["at"]: r.k for r in whole.collect()}
    assert [got[i] for i in range(500)] == sorted((r.k for r in df.collect()), key=lambda k: (k is not None, k or 0))


def test_confidences_are_counted_before_they_are_sorted(spark):
    rng = random.Random(3)
    rows = [("a", rng.choice("xyz"), "b", rng.choice([None, 0.1, 0.2, 0.2, 0.7, 0.9])) for _ in range(300)] + [("a", "w", "b", None)]
    whole = K.confidence(spark.createDataFrame(rows, "arg1 string, rel string, arg2 string, confidence double"))
    assert whole._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 2
    for r in whole.collect():
        mine = sorted((c for _, rel, _, c in rows if rel == r.rel), key=lambda c: (c is not None, c or 0))
        known = [c for c in mine if c is not None]
        assert r.median == mine[len(mine) // 2] and r.least == (min(known) if known else None) and r.most == (max(known) if known else None)
        assert r["mean"] == (pytest.approx(sum(known) / len(known)) if known else None)


def test_pairs_travel_as_one_row_up_to_their_windows(spark):
    """The windows of a pair are made after its counts are joined, not shuffled one by one."""
    plan = catalog.QUERIES["cogroup_counts"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")


def test_index_reaches_the_files(spark, tmp_path):
    c = spark.range(2000).select(*[F.concat(F.lit(k), (F.col("id") % 9).cast("string")).alias(k) for k in P.KEY], *[F.col("id").alias(x) for x in ("max_dir", "max_und", "und_k", "nf", "ns")], *[(F.col("id") / 7).alias(x) for x in ("und_first", "dir_first", "und_second", "dir_second")])
    path = str(tmp_path / "index")
    codecs.write_index(codecs.pairs_index(c, 5), path)
    got = codecs.read_pairs_index(spark, path).where("fr = 'fr3' AND s1 = 's13'")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(fr,fr3)" in plan and "EqualTo(s1,s13)" in plan
    assert sorted(r.nf for r in got.collect()) == [i for i in range(5, 2000) if i % 9 == 3]


def _random_records(spark, n=400, docs=3):
    rng = random.Random(5)
    pick = lambda *xs: rng.choice(xs)
    rows = [(f"d{rng.randrange(docs)}", rng.randrange(n // 8), rng.randrange(3), k, "s on", pick("Ann", "Bob", "ann", None), pick([], ["Type:a"], ["Type:a", "Type:b"]), pick("met", "sat on"), pick("Eve", "May"), pick([], ["Type:time_unit", "Type:number"], ["Type:number"])) for k in range(n)]
    return P.numbered(spark.createDataFrame(rows, REC))


def test_counts_by_kind_are_those_of_nearest_pairs(spark, monkeypatch):
    monkeypatch.setattr(N, "SPAN", 20)  # documents of several spans, records with one ordinal, missing arguments
    rec = _random_records(spark)
    c, near = N.counted(rec, 7), P.nearest(rec, 7)
    rows = lambda df, *cols: sorted(map(repr, df.select(*cols).collect()))
    assert rows(N.directed(c), *P.KEY, "window", "cnt") == rows(P.directed(near), *P.KEY, "window", "cnt")
    heads = P.head_counts(near, rec, 2)
    assert rows(N.head_counts(c, 2), *P.KEY, "place", "head", "n") == rows(heads, *P.KEY, "place", "head", "n") and heads.count() > 100


def test_counting_tasks_grow_with_the_records(spark, monkeypatch):
    """Small inputs do not send the vocabulary on from each of very many tasks."""
    seen, followers = [], N.followers
    monkeypatch.setattr(N, "followers", lambda *a, parts=None, **k: seen.append(parts) or followers(*a, parts=parts, **k))
    few = 2 * spark.sparkContext.defaultParallelism
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        rec = _random_records(spark)
        assert [N.parts_for(rec, n) for n in (0, 50 * N.TASK - 1, 10**9)] == [few, 50, 60]
        assert N.counted(rec, 7).counts.count() > 0 and seen == [few]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("name", ["frequent_above", "cumulative_beyond", "undirected_pairs", "two_hop", "binned_partners"])
def test_pairs_are_counted_once(spark, name):
    """What is counted from the events is stored: no later step counts it again."""
    whole = catalog.QUERIES[name](spark, SF)
    assert not [f for f in whole.inputFiles() if "events" in f] and whole.limit(1).count() == 1


def test_counts_by_kind_give_counts_of_tuples(spark):
    rec = _random_records(spark)
    rows = lambda df: sorted(map(repr, df.select("a1", "rel", "a2", "n").collect()))
    assert rows(N.unigrams(N.counted(rec, 3))) == rows(P.unigrams(rec))


@pytest.mark.parametrize("name", ["combined_alpha", "cogroup_counts", "measures_of_rare_tuples"])
def test_tuples_are_counted_with_the_pairs(spark, name):
    """Counts of tuples come from the kinds of records, too: the events are not read again for them."""
    assert not [f for f in catalog.QUERIES[name](spark, SF).inputFiles() if "events" in f]


def test_prepared_records_are_alike_where_they_subsume(spark):
    rows = [(a, r, b) for a in ("Ann", "ann", "be", "", None) for r in ("be", "be in", "in be", "sat on") for b in ("Eve", "ann", "Eve sat on", "")]
    rec = spark.createDataFrame(rows, "arg1 string, rel string, arg2 string").withColumns(R.says())
    both = rec.alias("o").join(rec.alias("i")).select(R.alike("o", "i").alias("x"), R.subsumes("o", "i").alias("y"))
    assert both.where("not x <=> y").count() == 0 and both.where("x").count() > 100 and both.where("not x").count() > 100


@pytest.mark.parametrize("most_hashes", [3, 100])
def test_merges_without_payload_rows(spark, monkeypatch, most_hashes):
    """Pairs and tuples of the corpus are those of the folds over every document's payload, also where hashes stop growing."""
    monkeypatch.setattr(X, "MOST_HASHES", most_hashes)
    rec = _random_records(spark, 500, 25).where("arg1 is not null").withColumn("hashes", F.expr("IF(rid % 11 = 0, cast(array() as array<int>), array_distinct(array(cast(rid % 9 as int), cast(rid % 7 as int))))"))
    rec = rec.localCheckpoint()
    tuples = X.tuple_payload(rec, 2)
    want, got = X.merge_pairs(X.pair_payload(rec, tuples, 4), 1, 2), X.corpus_pairs(rec, 4, 1, 2)
    rows = lambda df: sorted(map(repr, df.collect()))
    assert want.columns == got.columns and rows(want) == rows(got)
    assert X.merge_pairs(X.pair_payload(rec, tuples, 4)).where("n_docs > 3").count() > 0
    entries = lambda h: F.expr(f"transform({h}, e -> struct(e.head as v, e.n as n))").alias(h)
    folded = {}
    for t in sorted(tuples.select("docid", "a1", "rel", "a2", "n", "hashes", "ids", "sentences", entries("heads1"), entries("heads2")).collect(), key=lambda t: t.docid):
        a = folded.setdefault((t.a1, t.rel, t.a2), {"n": 0, "rest": (t.hashes, t.ids, t.sentences), "heads1": {}, "heads2": {}})
        a["n"] += t.n
        for h in ("heads1", "heads2"):
            if len(a[h]) < 2:
                for e in t[h]:
                    a[h][e.v] = a[h].get(e.v, 0) + e.n
    assert {(t.a1, t.rel, t.a2): {"n": t.n, "rest": (t.hashes, t.ids, t.sentences), **{h: {e.v: e.n for e in t[h]} for h in ("heads1", "heads2")}} for t in X.corpus_tuples(rec, 2).collect()} == folded
