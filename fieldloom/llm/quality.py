"""Quality rules: a threshold table compiled into one projection, without user functions.

Defined results: a null or empty text has no words and fails the base rule; ratios of an empty
text are 0. Rows are judged one by one, so repeated rows get equal verdicts, an empty table gives
an empty result, and further columns of the input are ignored whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import BLANKS, documents, hashed_windows, split_words

WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Frequent function words of the languages covered; a text of prose has some of them.
STOP_WORDS = sorted(
    set(
        "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which you were her she a i we"
        " de la le et les des un une en du que est pour qui dans au par pas sur ce il elle ne se sont avec ou plus"
        " der die und das den von zu mit sich auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach"
        " el los del las por con una su para al lo como más o pero sus le ya este si porque esta entre cuando muy sin sobre y".split()
    )
)


@dataclass(frozen=True)
class Rule:
    """Keep a text while least <= value <= most; only texts of at_words words or more are judged."""

    name: str
    value: str
    least: float | None = None
    most: float | None = None
    at_words: int = 0


#: The values are names of ratio columns made by `ratios`.
RULES = (
    Rule("mean word length", "mean_word_chars", 2.0, 12.0),
    Rule("symbols to words", "symbol_ratio", None, 0.3),
    Rule("stop words to words", "stop_ratio", 0.02, None, at_words=50),
    Rule("repeated lines to lines", "dup_line_ratio", None, 0.5, at_words=20),
    Rule("exclamation to words", "shout_ratio", None, 0.4),
)


def counts(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that rules are made of, one row for each input row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, BLANKS, "") != "")
    df = docs.select("doc_id", text.alias("text")).select(
        "doc_id",
        split_words(F.col("text")).alias("words"),
        F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("text") - F.length(F.translate("text", "!", ""))).cast("long").alias("n_shouts"),
        lines.alias("lines"),
    )
    df = hashed_windows(df, "words", WINDOW, "windows")
    repeated = F.size(F.array_distinct("windows")) < F.size("windows")
    df = df.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_shouts",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.when(repeated, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("by_hash"),
    )
    # Texts without a repeated window, most of them, have null here and skip the sorting above.
    near = lambda x, j: F.coalesce((j > 0) & (F.get("by_hash", j - 1)["h"] == x["h"]), F.lit(False)) | F.coalesce(F.get("by_hash", j + 1)["h"] == x["h"], F.lit(False))
    starts = F.sort_array(F.array_compact(F.transform("by_hash", lambda x, j: F.when(near(x, j), x["i"]))))
    df = df.withColumn("starts", starts).drop("by_hash")
    gaps = F.transform("starts", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", j + 1) - p, F.lit(WINDOW))))
    covered = F.aggregate(gaps, F.lit(0), lambda total, x: total + x)
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("starts")


def ratios(df: DataFrame) -> DataFrame:
    """Adds the ratio columns that rules name; the denominator is 1 where a text has nothing."""
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    return df.withColumns(
        {
            "mean_word_chars": F.col("word_chars") / words,
            "symbol_ratio": F.col("n_symbols") / words,
            "stop_ratio": F.col("n_stop_words") / words,
            "shout_ratio": F.col("n_shouts") / words,
            "dup_line_ratio": F.col("n_dup_lines") / lines,
        }
    )


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """All rules as one boolean expression."""
    held = F.lit(True)
    for r in rules:
        value, good = F.col(r.value), F.lit(True)
        if r.least is not None:
            good = good & (value >= r.least)
        if r.most is not None:
            good = good & (value <= r.most)
        held = held & ((F.col("n_words") < r.at_words) | good if r.at_words else good)
    return held


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts, ratios, base_failed and kept for each row of docs (doc_id, text).

    The row is made once: a filter on the result isn't pushed below, where it would repeat every count in its condition.
    """
    judged = _judged(docs, rules)
    return judged.select(F.explode_outer(F.array(F.struct(*judged.columns))).alias("row")).select("row.*")


def _judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return ratios(counts(docs)).withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def filtered(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that pass, with all their columns."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc_id"), "text")
    passed = _judged(rows, rules).select(F.explode_outer(F.when(F.col("kept"), F.array("doc_id"))).alias("row"))
    return passed.where(F.col("row").isNotNull()).select("row.*")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return _judged(documents(spark, sf_dir)).select(*out)


SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, doc_id, text,
    list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM d
), win AS (
  SELECT rid, i, array_to_string(list_slice(words, i, i + 7), ' ') AS gram
  FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)
), rep AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM win) WHERE c > 1
), cov AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY rid
), c AS (
  SELECT doc_id, len(words)::BIGINT AS n_words,
    length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    length(regexp_replace(text, '[^!]', '', 'g'))::BIGINT AS n_shouts,
    len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    len(list_filter(words, lambda x: list_contains([{", ".join(f"'{w}'" for w in STOP_WORDS)}], lower(x))))::BIGINT AS n_stop_words,
    coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov USING (rid)
), b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / greatest(n_words, 1) BETWEEN 2.0 AND 12.0
  AND n_symbols / greatest(n_words, 1) <= 0.3
  AND (n_words < 50 OR n_stop_words / greatest(n_words, 1) >= 0.02)
  AND (n_words < 20 OR n_dup_lines / greatest(n_lines, 1) <= 0.5)
  AND n_shouts / greatest(n_words, 1) <= 0.4 AS kept
FROM b
"""
