"""Operators on collections of blocks: a block is a value of a block column, or a list of tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    "==": lambda a, b: a == b,
    ">=": lambda a, b: a >= b,
    ">": lambda a, b: a > b,
}


def extract_blocks(df: DataFrame, block: str, indices: list[int]) -> DataFrame:
    return df.where(F.col(block).isin(indices))


def extract_rows(df: DataFrame, index: str, wanted: list[int]) -> DataFrame:
    """Rows by index, in the order asked for (Position) and as often; an index that isn't there is an error, raised as rows are read."""
    asked = df.sparkSession.createDataFrame(list(enumerate(wanted)), f"Position long, _k {dict(df.dtypes)[index]}")
    found = F.broadcast(asked).join(df.withColumn("_there", F.lit(True)), F.col("_k") == F.col(index), "left")  # as long as the request
    there = F.when(F.col("_there").isNull(), F.raise_error(F.concat(F.lit("row out of range: "), F.col("_k").cast("string"))).cast("long")).otherwise(F.col("Position"))
    return found.withColumn("Position", there).select("Position", *df.columns)


def comparison(value: Column, how: str, pivots: list[float]) -> Column:
    """Whether a value compares with any of the pivots; != holds where it equals none."""
    if how == "!=":
        return ~value.isin(pivots)
    return reduce(lambda a, b: a | b, [COMPARE[how](value, F.lit(p)) for p in pivots])


def extract_geometry(points: DataFrame, field: str, how: str, pivots: list[float], mask_only: bool = False) -> DataFrame:
    """Points whose field compares; with mask_only all points and a Mask of 0 and 1."""
    test = F.coalesce(comparison(F.col(field), how, pivots), F.lit(False))
    return points.withColumn("Mask", test.cast("tinyint")) if mask_only else points.where(test)


def extract_cells(cells: DataFrame, points: DataFrame, field: str, how: str, pivots: list[float], every: bool = True) -> DataFrame:
    """Cells (cid, verts) of which all, or any, vertices (vid) compare."""
    test = F.coalesce(comparison(F.col(field), how, pivots), F.lit(False))
    flat = cells.select("cid", F.explode("verts").alias("vid")).join(points.select("vid", test.alias("ok")), "vid")
    good = flat.groupBy("cid").agg((F.min("ok") if every else F.max("ok")).alias("ok")).where("ok")
    return cells.join(good.select("cid"), "cid", "left_semi")


def extract_unique(df: DataFrame, field: str) -> DataFrame:
    """Sorted distinct values as Unique<field>."""
    return df.select(F.col(field).alias(f"Unique{field}")).distinct()


def extract_array_values(df: DataFrame, field: str, index: str, wanted: list[int]) -> DataFrame:
    return df.where(F.col(index).isin(wanted)).select(index, field)


def extract_arrays(df: DataFrame, positions: list[int]) -> DataFrame:
    return df.select(*[df.columns[i] for i in positions])


def for_each(df: DataFrame, block: str, body: Callable, schema: str) -> DataFrame:
    """Runs a body on each block at once (ForEach to EndFor): a function of one block's pandas frame."""
    return df.groupBy(block).applyInPandas(body, schema)


def aggregate_blocks(tables: list[DataFrame], block: str = "block_id") -> DataFrame:
    """All inputs as blocks of one table, numbered in order."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [t.withColumn(block, F.lit(i)) for i, t in enumerate(tables)])


def flatten(df: DataFrame, parent: str, child: str, out: str = "block_id") -> DataFrame:
    """Second-level blocks lifted to the top: a new id for each (parent, child), and ParentBlockId."""
    pairs = df.select(parent, child).distinct()
    from fieldloom.operators.tables import global_rank

    ids = global_rank(pairs, [F.col(parent), F.col(child)], out)
    return df.join(ids, [parent, child]).withColumn("ParentBlockId", F.col(parent))


def merge_block_tables(tables: list[DataFrame]) -> DataFrame:
    """All rows of all tables, in the columns of the first, by position."""
    return reduce(DataFrame.union, tables)


def grid_layout(points: DataFrame, block: str, columns: int, gap: float = 1.0) -> DataFrame:
    """Points moved so that their blocks stand on a grid of the given columns, cells as large as the largest block."""
    spans = points.groupBy(block).agg((F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"))
    cell = spans.agg(F.max("w").alias("_w"), F.max("h").alias("_h"))
    moved = points.crossJoin(F.broadcast(cell))  # one row
    return moved.withColumns({"x": F.col("x") + (F.col(block) % columns) * (F.col("_w") + gap), "y": F.col("y") + F.floor(F.col(block) / columns) * (F.col("_h") + gap)}).drop("_w", "_h")


def block_tuples(df: DataFrame, outer: str, inner: str) -> DataFrame:
    """A list of lists the other way round: the n-th inner blocks of all outer ones together; both numbered from 0 in order."""
    from fieldloom.operators.tables import global_rank

    ids = lambda c, out: global_rank(df.select(c).distinct(), [F.col(c)], out)
    return df.join(ids(inner, "block_id"), inner).join(ids(outer, "tuple_id"), outer)
