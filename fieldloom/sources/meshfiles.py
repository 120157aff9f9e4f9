"""Mesh files: OFF is read and written, OBJ and VRML are written; derived tables are kept as parquet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_off(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(points vid, x, y, z; cells cid, verts) of an ASCII OFF file; blank and comment lines don't count."""
    from fieldloom.operators.tables import global_rank

    lines = spark.read.text(path).withColumn("_at", F.monotonically_increasing_id()).where(~F.trim("value").rlike("^(?:#.*)?$"))
    ranked = global_rank(lines, [F.col("_at")], "n").select("n", F.split(F.trim("value"), r"\s+").alias("w"))
    head = ranked.where("n = 1").first()
    nv, nc = int(head.w[0]), int(head.w[1])
    coordinate = [F.get("w", i).cast("float").alias(c) for i, c in enumerate("xyz")]
    points = ranked.where(F.col("n").between(2, nv + 1)).select((F.col("n") - 2).alias("vid"), *coordinate)
    rest = ranked.where(F.col("n").between(nv + 2, nv + nc + 1))
    cells = rest.select((F.col("n") - nv - 2).alias("cid"), F.transform(F.slice("w", 2, F.get("w", 0).cast("int")), lambda x: x.cast("long")).alias("verts"))
    return points, cells


def off_lines(points: DataFrame, cells: DataFrame) -> DataFrame:
    """(n, value): the numbered lines of an OFF file."""
    spark = points.sparkSession
    nv, nc = points.count(), cells.count()
    head = spark.createDataFrame([(0, "OFF"), (1, f"{nv} {nc} 0")], "n long, value string")
    body = points.select((F.col("vid") + 2).alias("n"), F.concat_ws(" ", "x", "y", "z").alias("value"))
    faces = cells.select((F.col("cid") + nv + 2).alias("n"), F.concat_ws(" ", F.size("verts").cast("string"), F.array_join(F.col("verts").cast("array<string>"), " ")).alias("value"))
    return head.unionByName(body).unionByName(faces)


def obj_lines(points: DataFrame, cells: DataFrame) -> DataFrame:
    """(n, value): the numbered lines of an OBJ file; its vertices count from 1."""
    nv = points.count()
    body = points.select(F.col("vid").alias("n"), F.concat_ws(" ", F.lit("v"), "x", "y", "z").alias("value"))
    faces = cells.select((F.col("cid") + nv).alias("n"), F.concat(F.lit("f "), F.array_join(F.transform("verts", lambda v: (v + 1).cast("string")), " ")).alias("value"))
    return body.unionByName(faces)


def wrl_lines(points: DataFrame, cells: DataFrame) -> DataFrame:
    """(n, value): the numbered lines of a VRML scene with one face set; with columns tex_u and tex_v, texture coordinates too."""
    spark = points.sparkSession
    nv, nc = points.count(), cells.count()
    line = lambda n, text: spark.createDataFrame([(n, text)], "n long, value string")
    parts = [line(0, "#VRML V2.0 utf8"), line(1, "Shape { geometry IndexedFaceSet { solid FALSE coord Coordinate { point ["), points.select((F.col("vid") + 2).alias("n"), F.concat(F.concat_ws(" ", "x", "y", "z"), F.lit(",")).alias("value"))]
    at = 2 + nv
    if {"tex_u", "tex_v"} <= set(points.columns):
        parts += [line(at, "] } texCoord TextureCoordinate { point ["), points.select((F.col("vid") + at + 1).alias("n"), F.concat(F.concat_ws(" ", "tex_u", "tex_v"), F.lit(",")).alias("value"))]
        at += 1 + nv
    parts += [line(at, "] } coordIndex ["), cells.select((F.col("cid") + at + 1).alias("n"), F.concat(F.array_join(F.col("verts").cast("array<string>"), ", "), F.lit(", -1,")).alias("value")), line(at + 1 + nc, "] } }")]
    return reduce(DataFrame.unionByName, parts)


def write_lines(lines: DataFrame, path: str) -> None:
    """One text file, its lines in order: the format has no parts."""
    lines.repartitionByRange(1, "n").sortWithinPartitions("n").select("value").write.text(path)
