"""Line dedup by overlapping three-line windows.

Every run of three consecutive lines, at least one not blank, is a window; lines are compared
without blanks at their ends. A window that stands elsewhere earlier, in order of doc_id and then
line, is a later occurrence, and the lines that later occurrences cover go.

Defined results: null and empty texts, and texts of fewer than three lines, lose nothing; rows
that share an id and a text count as one document and get equal rows; null ids come first; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import BLANKS, documents, row_key, union_length

WIDTH = 3


def dedup_lines(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_lines, n_removed, n_spans (maximal removed runs) and the kept text for each row of docs (doc_id, text)."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", row_key(F.col("doc_id"), F.col("text")).alias("k"))
    bare = F.transform(F.split("text", "\n"), lambda x: F.trim(x, F.lit(BLANKS)))
    lines = rows.select("k", "doc_id", bare.alias("lines"))
    # A window's key is 128 bits of its lines; null where all of them are blank.
    last = F.greatest(F.size("lines") - (width - 1), F.lit(0))
    key = F.transform(F.slice("lines", 1, last), lambda x, i: F.when(F.exists(F.slice("lines", i + 1, width), lambda y: y != ""), F.unhex(F.md5(F.array_join(F.slice("lines", i + 1, width), "\n")))))
    windows = lines.select("k", "doc_id", key.alias("keys")).select("k", "doc_id", F.posexplode_outer("keys").alias("at", "w")).where("w IS NOT NULL")

    # Repeated rows of one document share (doc_id, at), so they never make each other later.
    first = windows.groupBy("w").agg(F.min(F.struct("doc_id", "at", "k")).alias("first"), F.max(F.struct("doc_id", "at", "k")).alias("last"))
    first = first.where(~F.col("first").eqNullSafe(F.col("last"))).select("w", "first")
    later = windows.join(first, "w").where(~F.struct("doc_id", "at", "k").eqNullSafe(F.col("first")))
    starts = later.groupBy("k").agg(F.sort_array(F.collect_set("at")).alias("starts"))

    both = rows.join(starts, "k", "left").select("doc_id", F.split("text", "\n").alias("lines"), F.coalesce("starts", F.expr("cast(array() as array<int>)")).alias("starts"))
    end = lambda j: F.coalesce(F.get("starts", j - 1) + width, F.lit(0))
    gaps = F.filter(F.transform("starts", lambda s, j: F.struct(F.when(j == 0, F.lit(0)).otherwise(end(j)).alias("a"), s.alias("b"))), lambda g: g["b"] > g["a"])
    tail = F.coalesce(F.get("starts", F.size("starts") - 1) + width, F.lit(0))
    tail = F.slice("lines", tail + 1, F.greatest(F.size("lines") - tail, F.lit(0)))
    kept = F.concat(F.flatten(F.transform(gaps, lambda g: F.slice("lines", g["a"] + 1, g["b"] - g["a"]))), tail)
    runs = F.filter("starts", lambda s, j: (j == 0) | (s > end(j)))
    return both.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        union_length(F.col("starts"), width).cast("long").alias("n_removed"),
        F.size(runs).cast("long").alias("n_spans"),
        F.array_join(kept, "\n").alias("text"),
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_removed", "n_spans", F.sha2("text", 256).alias("kept_sha256"))


SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
t AS (SELECT doc_id, lines, list_transform(lines, lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS bare FROM d),
w AS (
  SELECT doc_id, i, array_to_string(list_slice(bare, i, i + 2), chr(10)) AS w FROM (SELECT doc_id, bare, unnest(range(1, len(bare) - 1)) AS i FROM t WHERE len(bare) >= 3)
  WHERE length(bare[i]) + length(bare[i + 1]) + length(bare[i + 2]) > 0
), later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS n FROM w) WHERE n > 1),
cov AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM later)),
runs AS (SELECT doc_id, count(*) AS n_removed, sum(CASE WHEN prev IS NULL OR p > prev + 1 THEN 1 ELSE 0 END) AS n_spans FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS prev FROM cov) GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY p) AS text FROM (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS p, unnest(lines) AS line FROM d)
  WHERE (doc_id, p) NOT IN (SELECT doc_id, p FROM cov) GROUP BY doc_id
)
SELECT doc_id, len(lines)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
