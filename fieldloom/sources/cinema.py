"""Catalogs of data products: a `<name>.cdb` folder with a `data.csv` of one row for each product."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_catalog(spark: SparkSession, database: str, file_columns: tuple[str, ...] = ("FILE",)) -> DataFrame:
    """The catalog's rows, numbers inferred, FILE columns prefixed by the database's path."""
    if not database.rstrip("/").endswith(".cdb"):
        raise ValueError(f"not a .cdb database: {database}")
    base = database.rstrip("/")
    df = spark.read.option("header", True).option("inferSchema", True).csv(f"{base}/data.csv")
    for c in file_columns:
        if c not in df.columns or dict(df.dtypes)[c] != "string":
            raise ValueError(f"no text column {c} in {base}/data.csv")
        df = df.withColumn(c, F.concat(F.lit(base + "/"), F.col(c)))
    return df


def read_products(catalog: DataFrame, file_column: str = "FILE") -> DataFrame:
    """The rows of all parquet, csv and json products of a catalog, each with its catalog columns, which the rows' own columns override.

    Rows and products meet on the whole path, as Spark names files. The paths of a catalog, one for each product, are
    listed in the driver, as a scan of so many files needs.
    """
    spark = catalog.sparkSession
    paths = [r[0] for r in catalog.select(file_column).distinct().collect()]
    parts = []
    for kind in ("parquet", "csv", "json"):
        own = [p for p in paths if p.lower().endswith("." + kind)]
        if own:
            reader = spark.read.option("header", True).option("inferSchema", True) if kind == "csv" else spark.read
            parts.append(reader.format(kind).load(own).withColumn("_file", whole_path(F.col("_metadata.file_path"))))
    unknown = [p for p in paths if not p.lower().endswith((".parquet", ".csv", ".json"))]
    if unknown:
        raise ValueError(f"products of no known kind: {sorted(unknown)[:5]}")
    if not parts:
        return catalog
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    keys = catalog.select(*[c for c in catalog.columns if c not in rows.columns or c == file_column], whole_path(F.col(file_column)).alias("_file"))
    return rows.drop(file_column).join(F.broadcast(keys) if len(paths) <= 10_000 else keys, "_file").drop("_file")


def whole_path(path: Column) -> Column:
    """A path as Spark's file sources name it: file: before local ones, single slashes, %-codes decoded, no data folder of a parquet product."""
    plain = F.regexp_replace(F.url_decode(F.regexp_replace(path, "[+]", "%2B")), "^(file):/+", "$1:/")
    plain = F.when(plain.startswith("/"), F.concat(F.lit("file:"), plain)).otherwise(plain)
    return F.regexp_replace(plain, r"(\.(?:parquet|csv|json))/part-[^/]*$", "$1")


def product_name(keys: list[str]) -> Column:
    """The file name of a product: its key values joined by `_`; several values of a key by `;`."""
    return F.concat_ws("_", *[F.col(k).cast("string") for k in keys])


def write_product(df: DataFrame, database: str, values: dict[str, object], kind: str = "parquet") -> None:
    """Writes one product and its catalog row: a row of the same keys is replaced, others stay.

    The file stands under data/, named by the values joined by `_`. A key that the catalog lacks, or a catalog key that
    the values lack, is an error. Files of replaced rows are overwritten, never others removed. One writer at a time.
    """
    spark, base = df.sparkSession, database.rstrip("/")
    if not base.endswith(".cdb"):
        raise ValueError(f"not a .cdb database: {database}")
    keys = list(values)
    name = "_".join(";".join(map(str, v)) if isinstance(v, (list, tuple)) else str(v) for v in values.values())
    text = [";".join(map(str, v)) if isinstance(v, (list, tuple)) else str(v) for v in values.values()]
    row = spark.createDataFrame([(*text, f"data/{name}.{kind}")], ", ".join(f"`{c}` string" for c in [*keys, "FILE"]))
    old = existing_catalog(spark, base)
    if old is not None:
        if set(old.columns) != {*keys, "FILE"}:
            raise ValueError(f"the catalog has other columns: {old.columns}")
        row = upsert(old, row, keys).select(*old.columns)
    df.write.mode("overwrite").format(kind).save(f"{base}/data/{name}.{kind}")
    rows = row.collect()  # the catalog is read before it is written over
    spark.createDataFrame(rows, row.schema).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{base}/data.csv")


def existing_catalog(spark: SparkSession, base: str) -> DataFrame | None:
    """The rows of a database's data.csv as text, or None where there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/data.csv")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.option("header", True).csv(f"{base}/data.csv")


def substitute(statement: str, values: dict[str, list]) -> str:
    """Replaces {var} and {var[i]} by field data values."""

    def found(m: re.Match) -> str:
        return str(values[m[1]][int(m[2] or 0)])

    return re.sub(r"\{(\w+)(?:\[(\d+)\])?\}", found, statement)


def query(spark: SparkSession, statement: str, tables: list[DataFrame], values: dict[str, list] | None = None, exclude: str | None = None) -> DataFrame:
    """A SELECT over InputTable0, InputTable1, …: scalar columns without spaces in their names, but for excluded ones."""
    for i, df in enumerate(tables):
        keep = [c for c, kind in df.dtypes if " " not in c and not kind.startswith(("array", "map", "struct")) and not (exclude and re.fullmatch(exclude, c))]
        df.select(*keep).createOrReplaceTempView(f"InputTable{i}")
    return spark.sql(substitute(statement, values or {}))


def upsert(catalog: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The catalog without rows of the same keys, and the new rows."""
    return catalog.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows, allowMissingColumns=True)
