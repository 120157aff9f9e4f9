"""A corpus pipeline from five of the text operators.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame,
which is written as Parquet and read again as the next one's docs. All but the last return the
columns of `documents`. Rows with null ids pass the stages as the operators' docstrings say; extra
columns of docs are kept, whatever their names, except by the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import decontaminate, minhash, mixing, quality, tokenfile
from fieldloom.llm.common import documents, read_table, row_key, stored

#: Shingles of five words, near from a similarity of 0.8.
SHINGLE, PERCENT = 5, 80
#: Decisions are broadcast up to this many ids (8 bytes each; keys of texts 16), and joined by shuffle beyond.
BROADCAST_IDS = 500_000


def _by_decision(docs: DataFrame, decided: DataFrame, how: str) -> DataFrame:
    """docs whose doc_id is (left_semi) or isn't (left_anti) among the ids decided."""
    ids = stored(decided.select("doc_id").where("doc_id IS NOT NULL").distinct(), "decided")
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", how).select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.filtered(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document of least id stays.

    Rows without id are in no group and stay, copies too. Rows that share an id are one document, whatever their
    texts: they stay or go together.
    """
    dropped = minhash.near_groups(docs, SHINGLE, PERCENT).where(~F.col("kept"))
    return _by_decision(docs, dropped, "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a full window of a benchmark item go, and those contaminated by shorter items. Each text is judged by itself: rows without id go too, and of rows that share an id only those go whose own text is contaminated."""
    found = decontaminate.contamination(docs.select(row_key(docs["text"]).alias("doc_id"), "text"), read_table(spark, sf_dir, "benchmark"))
    keys = stored(found.where("contaminated OR full_window").select(F.col("doc_id").alias("key")).distinct(), "decided")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), row_key(docs["text"]).alias("key"))
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys, "key", "left_anti").select("row.*")


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    return mixing.repeated(docs)


def token_file(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token file's index, read back from the file: doc_id, start, n_tokens and ids_crc32."""
    return tokenfile.read_corpus(spark, tokenfile.write_corpus(docs, tokenfile.vocabulary()))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mixed_sources),
    ("token file", token_file),
]

#: The tokenizer and the draws of the sampling have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
