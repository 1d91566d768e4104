"""Benchmark decontamination, by DataFrame and SQL functions alone.

Which benchmark items does a document contain, to 0.8 of their word shingles or
more? Items are partitioned by size, and each partition keeps a bottom-k MinHash
sketch of its items: the k smallest shingle hashes, with k one more than the
shingles that an item of the partition may miss. A document that contains an item
therefore holds at least one hash of its sketch, whatever the document's length:
candidates are complete, not probable. Documents probe the sketches with all
their shingles; candidates are then verified by the exact containment of the
shingles, compared as strings.

The sketch table is broadcast only if it has SKETCH_ROWS rows at most; beyond
that the same join is left to a shuffle.

Words are runs of letters and digits, lower-cased. An item of fewer words than a
shingle is one shingle of its own width, and documents are probed at that width.

Defined results: null and empty texts contain nothing, and null or empty items
are in nothing; repeated rows (equal id and text) give one result; repeated item
ids are told apart by their texts' shingles, and reported by id; a null doc_id
stays null; empty tables give an empty result; extra columns do not take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Sketch rows that may be broadcast (24 bytes each).
SKETCH_ROWS = 1_000_000
_BLANK = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; an empty array for none."""
    line = F.trim(F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), _BLANK, " "))
    return F.when(line == "", F.array().cast("array<string>")).otherwise(F.split(line, " "))


def _shingles(width: str, made: str) -> Column:
    """An array with `made` (an expression over the slice s) for every shingle of column `words`.

    The words are bound to a lambda variable first, so that they are made once
    and not once for each shingle."""
    of = made.format(s=f"slice(v, i, {width})")
    return F.expr(f"flatten(transform(array(words), v -> CASE WHEN size(v) >= {width} THEN transform(sequence(1, size(v) - {width} + 1), i -> {of}) ELSE array() END))")


def sketches(items: DataFrame, width: int, containment: float) -> DataFrame:
    """item, item_id, width, shingles (distinct strings), sketch (hashes)."""
    rows = items.select(F.col("item_id").cast("bigint").alias("item_id"), words(F.col("text")).alias("words")).where("size(words) > 0").distinct()
    rows = rows.withColumn("width", F.least(F.size("words"), F.lit(width)))
    rows = rows.withColumn("shingles", F.array_distinct(_shingles("width", "array_join({s}, ' ')"))).withColumn("hashes", F.array_sort(F.array_distinct(_shingles("width", "xxhash64({s})"))))
    # Size partition: 2 ** p <= shingles < 2 ** (p + 1); all its items have sketches of one size.
    rows = rows.withColumn("partition", F.floor(F.log2(F.size("shingles").cast("double")) + 1e-9).cast("int"))
    most = F.pow(F.lit(2.0), F.col("partition") + 1) - 1
    rows = rows.withColumn("k", (F.floor(most * (1 - containment) + 1e-9) + 1).cast("int"))
    return rows.select(F.xxhash64("item_id", "shingles").alias("item"), "item_id", "width", "shingles", F.slice("hashes", 1, F.col("k")).alias("sketch"))


def leaks(docs: DataFrame, items: DataFrame, width: int = 5, containment: float = 0.8) -> DataFrame:
    """doc_id, item_id, n_shingles (of the item), containment; and text_hash, for joins back."""
    index = written(sketches(items, width, containment), "sketches")
    probe = index.select("item", "width", F.explode("sketch").alias("h"))
    widths = sorted(r.width for r in index.select("width").distinct().collect())  # at most `width` values
    small = probe.limit(SKETCH_ROWS + 1).count() <= SKETCH_ROWS
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hashed = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("words"))
    found = None
    for w in widths:
        keys = F.broadcast(probe.where(F.col("width") == w).select("item", "h")) if small else probe.where(F.col("width") == w).select("item", "h")
        hits = hashed.select("doc_id", "text_hash", F.explode(_shingles(str(w), "xxhash64({s})")).alias("h")).join(keys, "h").select("doc_id", "text_hash", "item")
        found = hits if found is None else found.unionByName(hits)
    spec = "doc_id bigint, item_id bigint, n_shingles int, containment double, text_hash bigint"
    if found is None:
        return docs.sparkSession.createDataFrame([], spec)
    candidates = written(found.distinct(), "candidates")
    # One reading of a document's text, however many rows repeat it.
    named = candidates.withColumnsRenamed({"doc_id": "c_id", "text_hash": "c_hash"})
    texts = rows.withColumn("text_hash", F.xxhash64("text"))
    joined = texts.join(named, texts.doc_id.eqNullSafe(named.c_id) & (texts.text_hash == named.c_hash)).join(index.select("item", "item_id", "width", "shingles"), "item")
    held = joined.select("doc_id", "text_hash", "item_id", "width", "shingles", words(F.col("text")).alias("words")).withColumn("inside", F.size(F.array_intersect("shingles", _shingles("width", "array_join({s}, ' ')"))))
    share = F.col("inside") / F.size("shingles")
    return (
        held.where(share >= containment - 1e-9)
        .select("doc_id", "item_id", F.size("shingles").alias("n_shingles"), share.alias("containment"), "text_hash")
        .distinct()
    )


def drop_leaks(docs: DataFrame, items: DataFrame, width: int = 5, containment: float = 0.8) -> DataFrame:
    """The documents that contain no item, columns unchanged."""
    found = written(leaks(docs, items, width, containment).select(F.col("doc_id").alias("leak_id"), F.col("text_hash").alias("leak_hash")).distinct(), "leaks")
    return docs.join(found, docs["doc_id"].cast("bigint").eqNullSafe(found.leak_id) & (F.xxhash64(docs["text"].cast("string")) == found.leak_hash), "left_anti")


#: DuckDB SQL of the leaks, over whole tables.
LEAKS_SQL = r"""
WITH w AS (
  SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS words FROM benchmark
), i AS (
  SELECT DISTINCT item_id, least(len(words), 5) AS width, words FROM w WHERE len(words) > 0
), s AS (
  SELECT item_id, width, list_distinct([array_to_string(words[k:k + width - 1], ' ') for k in range(1, len(words) - width + 2)]) AS shingles FROM i
), d AS (
  SELECT DISTINCT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS words FROM documents
), g AS (
  SELECT DISTINCT doc_id, words, width, unnest([array_to_string(words[k:k + width - 1], ' ') for k in range(1, len(words) - width + 2)]) AS shingle
  FROM d, (SELECT DISTINCT width FROM s) WHERE len(words) >= width
), t AS (SELECT item_id, width, shingles, unnest(shingles) AS shingle FROM s)
SELECT DISTINCT doc_id, item_id, CAST(len(shingles) AS INTEGER) AS n_shingles, round(count(*) / len(shingles), 6) AS containment
FROM g JOIN t USING (width, shingle) GROUP BY doc_id, words, item_id, width, shingles
HAVING count(*) / len(shingles) >= 0.8 - 1e-9
"""
