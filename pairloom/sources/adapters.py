"""Views of the driver tables as extraction records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as records: docid, sentid, extrid, rid, sentence, arg1, arg1types, rel, arg2, arg2types, chain1, chain2, confidence."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    k = F.col("event_id")
    rel = F.when(F.col("event_type") == "click", "click on").when(F.col("event_type") == "error", "be error in").when(F.col("event_type") == "view", "have view of").otherwise(F.col("event_type"))
    said = F.when(k % 7 == 0, F.regexp_replace(rel, " (on|in|of)$", "")).otherwise(rel)
    arg1 = F.concat(F.lit("K"), (k % 7).cast("string"))
    arg2 = F.when(F.col("value") < 30, "low").when(F.col("value") < 120, "mid").otherwise("high")
    types2 = F.when(F.col("value") < 20, F.array(F.lit("Type:time_unit"), F.lit("Type:number"))).otherwise(F.array(F.lit("Type:number")))
    return e.withColumn("rn", rn).select(
        F.col("user_id").alias("docid"),
        F.floor((F.col("rn") + 1) / 2).cast("bigint").alias("sentid"),
        (F.col("rn") % 2).cast("bigint").alias("extrid"),
        F.col("event_id").alias("rid"),
        F.concat_ws(" ", arg1, said, arg2).alias("sentence"),
        arg1.alias("arg1"),
        F.array(F.when(k % 2 == 0, "Type:even").otherwise("Type:odd")).alias("arg1types"),
        rel.alias("rel"),
        arg2.alias("arg2"),
        types2.alias("arg2types"),
        F.when(k % 4 < 3, F.concat(F.lit("c"), (k % 3).cast("string"))).alias("chain1"),
        F.when(k % 5 < 3, F.concat(F.lit("c"), (k % 4).cast("string"))).alias("chain2"),
        F.round(F.col("value") / 500, 3).alias("confidence"),
    )


#: The same view for DuckDB.
REC_SQL = """rec AS (
  SELECT user_id AS docid, CAST((rn + 1) // 2 AS BIGINT) AS sentid, CAST(rn % 2 AS BIGINT) AS extrid, event_id AS rid,
    'K' || (event_id % 7) || ' ' || CASE WHEN event_id % 7 = 0 THEN regexp_replace(rel, ' (on|in|of)$', '') ELSE rel END || ' ' || arg2 AS sentence,
    'K' || (event_id % 7) AS arg1, [CASE WHEN event_id % 2 = 0 THEN 'Type:even' ELSE 'Type:odd' END] AS arg1types, rel, arg2,
    CASE WHEN value < 20 THEN ['Type:time_unit', 'Type:number'] ELSE ['Type:number'] END AS arg2types,
    CASE WHEN event_id % 4 < 3 THEN 'c' || (event_id % 3) END AS chain1, CASE WHEN event_id % 5 < 3 THEN 'c' || (event_id % 4) END AS chain2,
    round(value / 500, 3) AS confidence
  FROM (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn,
      CASE event_type WHEN 'click' THEN 'click on' WHEN 'error' THEN 'be error in' WHEN 'view' THEN 'have view of' ELSE event_type END AS rel,
      CASE WHEN value < 30 THEN 'low' WHEN value < 120 THEN 'mid' ELSE 'high' END AS arg2 FROM events)
)"""


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as records: docid, sentid, sentence."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return d.select(F.col("doc_id").alias("docid"), F.posexplode(F.split("text", "\n")).alias("sentid", "sentence")).withColumn("sentid", F.col("sentid").cast("bigint"))


SENT_SQL = """sent AS (
  SELECT doc_id AS docid, CAST(i - 1 AS BIGINT) AS sentid, lines[i] AS sentence
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))
)"""


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of which some meet the pruning rules: no letters, pronouns, reporting, stop and long relations."""
    r = records(spark, sf_dir)
    arg1 = F.expr("CASE WHEN rid % 23 = 1 THEN '--' WHEN rid % 29 = 2 THEN 'he' ELSE arg1 END")
    rel = F.expr("CASE WHEN rid % 11 = 3 THEN 'say that' WHEN rid % 11 = 4 THEN 'told' WHEN rid % 13 = 5 THEN 'be' WHEN rid % 17 = 7 THEN 'in' WHEN rid % 19 = 4 THEN 'has been seen to go in and out of' ELSE rel END")
    return r.withColumns({"arg1": arg1, "rel": rel})


RAW_SQL = """raw AS (SELECT * REPLACE (CASE WHEN rid % 23 = 1 THEN '--' WHEN rid % 29 = 2 THEN 'he' ELSE arg1 END AS arg1,
    CASE WHEN rid % 11 = 3 THEN 'say that' WHEN rid % 11 = 4 THEN 'told' WHEN rid % 13 = 5 THEN 'be' WHEN rid % 17 = 7 THEN 'in' WHEN rid % 19 = 4 THEN 'has been seen to go in and out of' ELSE rel END AS rel) FROM rec)"""
