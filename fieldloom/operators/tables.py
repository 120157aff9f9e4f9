"""Column and table operators: selection, editing, casting, ranks and reshaping.

Nulls stay null in arithmetic; ranks put nulls first; empty tables give empty results.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Largest and smallest values of the integer kinds a field can be converted to.
INTEGER_RANGES = {"tinyint": (-128, 127), "smallint": (-32768, 32767), "int": (-(2**31), 2**31 - 1), "bigint": (-(2**63), 2**63 - 1)}


def data_set_to_table(df: DataFrame, arrays: list[str] | None = None) -> DataFrame:
    """The scalar arrays of a points, cells or field table as columns."""
    scalar = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    return df.select(*(scalar if arrays is None else arrays))


def select_columns(df: DataFrame, names: list[str] | None = None, pattern: str | None = None, first: int = 0, last: int | None = None) -> DataFrame:
    """Numeric columns that are named, full-match the pattern and stand in the index range."""
    wanted = df.columns[first : None if last is None else last + 1]
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    keep = [c for c in wanted if c in numeric and (names is None or c in names) and (pattern is None or re.fullmatch(pattern, c))]
    return df.select(*keep)


def select_point_data(df: DataFrame, names: list[str], renamed: str | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Chosen point arrays; a single one may be renamed."""
    out = df.select(*keys, *names)
    return out.withColumnRenamed(names[0], renamed) if renamed and len(names) == 1 else out


def add_constants(df: DataFrame, lines: str) -> DataFrame:
    """Constant columns from lines `name,v1,v2…`: numbers where all values are, text otherwise; several values make an array."""
    for line in filter(None, map(str.strip, lines.splitlines())):
        name, *values = [x.strip() for x in line.split(",")]
        try:
            made = [float(v) for v in values]
        except ValueError:
            made = values
        df = df.withColumn(name, F.lit(made[0]) if len(made) == 1 else F.array(*map(F.lit, made)))
    return df


def add_arrays(df: DataFrame, other: DataFrame, names: list[str], key: str) -> DataFrame:
    """Columns of another table with the same row key."""
    return df.join(other.select(key, *names), key, "left")


def remove_arrays(df: DataFrame, names: list[str]) -> DataFrame:
    return df.drop(*names)


def edit_array(df: DataFrame, name: str, renamed: str | None = None, kind: str | None = None) -> DataFrame:
    """Renames and casts one column."""
    made = df[name].cast(kind) if kind else df[name]
    return df.select(*[made.alias(renamed or name) if c == name else df[c] for c in df.columns])


def reindex(df: DataFrame, key: str, values: str, components: int) -> DataFrame:
    """Tuples of `components` values, in order, from an array column."""
    chunks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(values) / components).cast("int") - 1), lambda i: F.slice(values, i * components + 1, components))
    return df.select(key, F.posexplode(F.when(F.size(values) > 0, chunks)).alias("tuple_id", values))


def _with_range(df: DataFrame, name: str, by: list[str]) -> DataFrame:
    """Adds _lo and _hi, the range of a column within each group, by one small aggregate."""
    spans = df.groupBy(*by).agg(F.min(name).alias("_lo"), F.max(name).alias("_hi"))
    if by:
        return df.join(spans, by)
    return df.crossJoin(F.broadcast(spans))  # one row


def convert_point_data(df: DataFrame, name: str, kind: str, rescale: bool = False) -> DataFrame:
    """Casts a column; with rescale, its range is first stretched over that of an integer kind."""
    if not rescale or kind not in INTEGER_RANGES:
        return df.withColumn(name, F.col(name).cast(kind))
    low, high = INTEGER_RANGES[kind]
    share = F.try_divide(F.col(name) - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    return _with_range(df, name, []).withColumn(name, F.floor(share * float(high - low) + float(low)).cast(kind)).drop("_lo", "_hi")


def normalize(df: DataFrame, name: str, by: list[str] | None = None, out: str | None = None) -> DataFrame:
    """(v - min) / (max - min) + 1e-6; a constant field gives 1e-6."""
    share = F.coalesce(F.try_divide(F.col(name) - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.when(F.col(name).isNotNull(), 0.0))
    return _with_range(df, name, by or []).withColumn(out or name, share + 1e-6).drop("_lo", "_hi")


def dictionary_encode(df: DataFrame, name: str) -> DataFrame:
    """Adds <name>Int: the index of each text among the sorted distinct ones."""
    codes = global_rank(df.select(name).distinct(), [F.col(name)], f"{name}Int")
    return df.join(codes.withColumnRenamed(name, "_k"), df[name].eqNullSafe(F.col("_k"))).drop("_k")


def global_rank(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Adds the rank of each row in one global order without gathering rows in one task.

    Rows are range-partitioned and sorted; the rows of each partition are counted, and ranks are the
    counts before plus the place within. The order must be total for a deterministic result.
    """
    from fieldloom.session import written

    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(ranged.withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}), "ranked")
    parts = placed.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    before = F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))  # one row for each partition
    starts = parts.withColumn("_before", F.coalesce(before, F.lit(0))).select("_part", "_before", "_first")
    ranked = placed.join(F.broadcast(starts), "_part")
    return ranked.withColumn(out, F.col("_before") + F.col("_place") - F.col("_first")).drop("_part", "_place", "_before", "_first")


def identify_by_field(df: DataFrame, name: str, key: str, descending: bool = False, start_at_one: bool = False, out: str = "PointScalarFieldName") -> DataFrame:
    """Rank of each value; equal values go by key."""
    first = F.col(name).desc() if descending else F.col(name).asc()
    ranked = global_rank(df, [first, F.col(key).asc()], out)
    return ranked.withColumn(out, F.col(out) + 1) if start_at_one else ranked


def order_array(df: DataFrame, name: str, key: str) -> DataFrame:
    """Adds <name>_Order."""
    return identify_by_field(df, name, key, out=f"{name}_Order")


def randomize_identifiers(df: DataFrame, name: str, seed: int = 0) -> DataFrame:
    """Replaces ids by a seeded permutation of the distinct ones, compacted to 0..k-1."""
    codes = global_rank(df.select(name).distinct(), [F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(name).cast("string"))), F.col(name)], "_new")
    return df.join(codes, name).withColumn(name, F.col("_new")).drop("_new")


def identifiers(df: DataFrame, order: list[Column], out: str = "PointIdentifiers") -> DataFrame:
    """Globally unique ids 0..n-1 in a given order."""
    return global_rank(df, order, out)


def embed(points: DataFrame, table: DataFrame, key: str, x: str, y: str, z: str | None = None) -> DataFrame:
    """Points with x, y, z replaced by columns of a table with the same key (z is 0 without one)."""
    own = table.select(key, F.col(x).alias("x"), F.col(y).alias("y"), (F.col(z) if z else F.lit(0.0)).alias("z"))
    return points.drop("x", "y", "z").join(own, key)


def project_from_fields(points: DataFrame, u: str, v: str) -> DataFrame:
    return points.withColumns({"x": F.col(u).cast("double"), "y": F.col(v).cast("double"), "z": F.lit(0.0)})


def texture_coordinates(df: DataFrame, u: str, v: str | None = None, repeat: bool = False) -> DataFrame:
    """Texture coordinates from one or two fields: min-max shares, or the fields themselves where they repeat."""
    for name, out in ((u, "tex_u"), (v, "tex_v")):
        if name is None:
            df = df.withColumn(out, F.lit(0.0))
        elif repeat:
            df = df.withColumn(out, F.col(name).cast("double"))
        else:
            share = F.try_divide(F.col(name) - F.col("_lo"), F.col("_hi") - F.col("_lo"))
            df = _with_range(df, name, []).withColumn(out, F.coalesce(share, F.lit(0.0))).drop("_lo", "_hi")
    return df


def heat_map(matrix: DataFrame, i: str, j: str, d: str) -> DataFrame:
    """Cells of a heat map from long-form distances: Distance and Proximity = exp(-d)."""
    return matrix.select(F.col(i).alias("i"), F.col(j).alias("j"), F.col(d).alias("Distance"), F.exp(-F.col(d)).alias("Proximity"))


def curve_edges(points: DataFrame, by: list[str], order: str, key: str, close: bool = False) -> DataFrame:
    """Polyline edges between points that follow each other in an order, within each curve."""
    w = W.partitionBy(*by).orderBy(order, key)
    following = F.lead(key).over(w)
    if close:
        following = F.coalesce(following, F.first(key).over(w))
    return points.select(*by, F.col(key).alias("a"), following.alias("b")).where("b IS NOT NULL AND a <> b")


def surface_quads(points: DataFrame, u: str, v: str, key: str) -> DataFrame:
    """Quads of the grid that points form by two arrays: corners p00, p10, p11, p01."""
    axis = lambda c, out: global_rank(points.select(c).distinct(), [F.col(c)], out)
    grid = points.join(axis(u, "iu"), u).join(axis(v, "iv"), v).select(F.col(key).alias("p"), "iu", "iv")
    corner = lambda du, dv, out: grid.select((F.col("iu") - du).alias("iu"), (F.col("iv") - dv).alias("iv"), F.col("p").alias(out))
    quads = grid.withColumnRenamed("p", "p00")
    return reduce(lambda q, c: q.join(corner(*c), ["iu", "iv"]), ((1, 0, "p10"), (1, 1, "p11"), (0, 1, "p01")), quads)
