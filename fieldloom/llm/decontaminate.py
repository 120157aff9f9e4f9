"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over all texts.

Texts are lower-cased (A-Z) and cut into words of ASCII letters and digits and of any other
non-ASCII characters. An item's windows are its 13-word runs, or the whole item where it is
shorter. A window's hash finds candidates; the words themselves confirm them.

Defined results: null texts have no words and are clean; an item without words has no window;
repeated documents get equal rows, repeated items count once; with an empty benchmark nothing is
hit. Columns other than the id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import ascii_lower, documents, hashed_windows, read_table, row_key, split_words, stored

WINDOW = 13
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: The same before A-Z are lower-cased.
CASED_SEPARATORS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: The window table is broadcast up to this size, item ids included; beyond, it is joined by shuffle.
BROADCAST_BYTES = 64 << 20


def normal_words(text: Column) -> Column:
    return split_words(ascii_lower(text), SEPARATORS)


def benchmark_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row for each different window: size, hash h, its words joined, and the ids of its items."""
    words = items.select("item_id", normal_words(F.col("text")).alias("words")).where(F.size("words") > 0)
    size = F.least(F.size("words"), F.lit(window))
    spans = words.select("item_id", size.alias("size"), F.explode_outer(F.transform(F.sequence(F.lit(1), F.size("words") - size + 1), lambda i: F.slice("words", i, size))).alias("span"))
    return spans.groupBy("size", F.array_join("span", " ").alias("gram")).agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))


def _hashes(df: DataFrame, sizes: list[int]) -> tuple[DataFrame, Column]:
    """df with hash arrays of each size, and the expression of all (size, at, h) structs."""

    def structs(n: int) -> Column:
        return F.transform(f"h{n}", lambda h, i: F.struct(F.lit(n).alias("size"), i.alias("at"), h.alias("h")))

    for n in sizes:
        df = hashed_windows(df, "words", n, f"h{n}")
    arrays = [structs(n) for n in sizes]
    return df, F.concat(*arrays) if len(arrays) > 1 else arrays[0]


def find_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """For each row of docs (doc_id, text): n_words, its confirmed hits (at, size, items), in order, and its text if asked for."""
    grams = stored(benchmark_windows(items, window), "windows")
    own_text = ["text"] * keep_text
    sizes = [r[0] for r in grams.select("size").distinct().orderBy("size").collect()]  # at most `window` rows
    rows = docs.select("doc_id", "text")
    if not sizes:
        return rows.select("doc_id", *own_text, F.size(normal_words(F.col("text"))).cast("long").alias("n_words"), F.expr("cast(array() as array<struct<at:int,size:int,items:array<string>>>)").alias("hits"))
    own, parts = _hashes(grams.withColumn("words", F.split("gram", " ")), sizes)
    grams = own.select("size", "gram", "items", F.explode_outer(parts).alias("p")).where((F.col("p.size") == F.col("size")) & (F.col("p.at") == 0)).select("size", "gram", "items", F.col("p.h").alias("h"))
    held = F.octet_length("gram") + 64 + F.aggregate("items", F.lit(0), lambda n, x: n + F.octet_length(x) + 16)
    if (grams.agg(F.sum(held.cast("long"))).first()[0] or 0) <= BROADCAST_BYTES:
        grams = F.broadcast(grams)

    keyed = rows.select("doc_id", "text", row_key(F.col("doc_id"), F.col("text")).alias("k"))
    # The outer forms: from the inner ones Catalyst infers a filter that repeats the whole expression below the scan.
    scanned, parts = _hashes(keyed.select("k", normal_words(F.col("text")).alias("words")), sizes)
    if len(sizes) == 1:
        scanned = scanned.select("k", F.posexplode_outer(f"h{sizes[0]}").alias("at", "h")).withColumn("size", F.lit(sizes[0]))
    else:
        scanned = scanned.select("k", F.explode_outer(parts).alias("p")).select("k", "p.*")
    found = scanned.join(grams, ["size", "h"]).groupBy("k").agg(F.collect_set(F.struct("at", "size", "gram", "items")).alias("found"))

    both = keyed.join(found, "k", "left").select("doc_id", *own_text, normal_words(F.col("text")).alias("words"), "found")
    true = F.filter("found", lambda x: F.array_join(F.slice("words", x["at"] + 1, x["size"]), " ") == x["gram"])
    hits = F.sort_array(F.transform(true, lambda x: F.struct(x["at"].alias("at"), x["size"].alias("size"), x["items"].alias("items"))))
    return both.select("doc_id", *own_text, F.size("words").cast("long").alias("n_words"), F.coalesce(hits, F.expr("array()")).alias("hits"))


def hit_words(hits: Column) -> Column:
    """Words inside any hit; hits are sorted by position."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    step = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["at"] + x["size"] - F.greatest(a["to"], x["at"]))).alias("n"), F.greatest(a["to"], x["at"] + x["size"]).alias("to"))
    return F.aggregate(hits, start, step, lambda a: a["n"].cast("long"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted ids), full_window (whether a window of full size occurs) and contaminated for each row of docs."""
    found = find_hits(docs, items, window)
    ids = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda x: x["items"]))))
    out = found.select("doc_id", "n_words", hit_words(F.col("hits")).alias("n_hit"), ids.alias("items"), F.exists("hits", lambda x: x["size"] >= window).alias("full_window"))
    return out.withColumn("n_items", F.size("items").cast("long")).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def runs_of(hits: Column) -> Column:
    """Maximal runs (a, b) of hit words; hits are sorted by position."""
    none = F.expr("cast(array() as array<struct<a:int,b:int>>)")

    def step(acc: Column, x: Column) -> Column:
        last, to = F.element_at(acc, -1), x["at"] + x["size"]
        joins = (F.size(acc) > 0) & (x["at"] <= F.coalesce(last["b"], F.lit(-1)))
        kept = F.slice(acc, 1, F.greatest(F.size(acc) - F.when(joins, 1).otherwise(0), F.lit(0)))
        return F.array_append(kept, F.struct(F.when(joins, last["a"]).otherwise(x["at"]).alias("a"), F.when(joins, F.greatest(last["b"], to)).otherwise(to).alias("b")))

    return F.aggregate(hits, none, lambda acc, x: F.when(F.size(acc) == 0, F.array(F.struct(x["at"].alias("a"), (x["at"] + x["size"]).alias("b")))).otherwise(step(acc, x)))


def remove_spans(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id and text of each row of docs, without the words that a hit covers and what separates each from the next word.

    The rest of a text stays as it is. Rows are taken one by one, whatever their ids; null texts stay null.
    """
    found = find_hits(docs, items, window, keep_text=True).withColumn("runs", runs_of(F.col("hits")))
    pieces, between = F.split("text", CASED_SEPARATORS), F.regexp_extract_all("text", F.lit(f"({CASED_SEPARATORS})"), 1)
    first = F.when(F.get(pieces, 0) == "", 1).otherwise(0)  # a text that begins with a separator has an empty piece before it
    covered = lambda i: F.exists("runs", lambda r: (i - first >= r["a"]) & (i - first < r["b"]))
    left = F.transform(pieces, lambda p, i: F.when(covered(i), F.lit("")).otherwise(F.concat(p, F.coalesce(F.get(between, i), F.lit("")))))
    return found.select("doc_id", F.when(F.size("hits") == 0, F.col("text")).otherwise(F.array_join(left, "")).alias("text"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


SQL = """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS words FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS words FROM benchmark
), g AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(words, i, i + n - 1), ' ') AS gram FROM (
    SELECT item_id, words, least(len(words), 13) AS n, unnest(range(1, len(words) - least(len(words), 13) + 2)) AS i FROM b WHERE len(words) > 0)
), sizes AS (SELECT DISTINCT n FROM g),
win AS (
  SELECT rid, n, i, array_to_string(list_slice(words, i, i + n - 1), ' ') AS gram FROM (
    SELECT rid, n, words, unnest(range(1, len(words) - n + 2)) AS i FROM d, sizes WHERE len(words) >= n)
), hit AS (SELECT rid, n, i, item_id FROM win JOIN g USING (n, gram)),
cov AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM hit) GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN cov USING (rid) LEFT JOIN its USING (rid)
"""
