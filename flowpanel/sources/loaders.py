"""Loaders, reshapes and sinks.

File layout the loaders accept:

* wide OD matrices, one CSV per year (``od_matrix_{year}.csv``): first column
  the origin, one numeric column per destination (S1, S2, P10);
* a long OD table (Parquet/CSV) with origin, destination, year and value;
* a panel table keyed by (entity, year).

All readers go through ``spark.read`` so a list of files is one scan; the year
of a wide file comes from ``_metadata.file_name``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.scalar import sanitize_name


def read_csv(spark: SparkSession, paths, schema=None) -> DataFrame:
    """Header CSV, UTF-8 (a BOM in the first header cell is stripped by Spark)."""
    r = spark.read.option("header", True).option("encoding", "UTF-8")
    if schema is not None:
        r = r.schema(schema)
    else:
        r = r.option("inferSchema", True)
    return r.csv(paths)


def read_wide_od(spark: SparkSession, paths, origin_col: str | None = None) -> DataFrame:
    """S2 + P10: yearly wide OD matrices → long ``(src, dst, year, value)``.

    One scan over all files; files must share the column order (else read per
    file and :func:`union_by_name`).  The year is the
    number in ``od_matrix_{year}``.
    """
    wide = read_csv(spark, paths).withColumn(
        "year", F.regexp_extract(F.col("_metadata.file_path"), r"od_matrix_(\d{4})", 1).cast("int"))
    origin = origin_col or wide.columns[0]
    dests = [c for c in wide.columns if c not in (origin, "year")]
    wide = wide.select(F.col(origin).alias("src"), "year",
                       *[F.col(f"`{c}`").cast("double").alias(c) for c in dests])
    return unpivot_od(wide, ["src", "year"], dests)


def _exists(spark: SparkSession, path: str) -> bool:
    """Does the path exist in the file system that Spark reads?"""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def read_yearly_od(spark: SparkSession, folder: str, years, origin_col: str | None = None) -> DataFrame:
    """The wide matrices ``od_matrix_{year}.csv`` of the asked years as long rows; a year
    without a file is skipped.  Raises if none of them exists."""
    found = [p for y in years if _exists(spark, p := f"{folder.rstrip('/')}/od_matrix_{y}.csv")]
    if not found:
        raise FileNotFoundError(f"no od_matrix_*.csv of the years {list(years)} in {folder}")
    return union_by_name([read_wide_od(spark, p, origin_col) for p in found])


def write_wide_od(od: DataFrame, folder: str, value: str = "value") -> list[int]:
    """One wide CSV matrix per year, a row per origin and a column per destination (entities of a
    dimension: bounded); returns the years written."""
    keys = [r[0] for r in od.select("dst").distinct().orderBy("dst").collect()]
    years = [r[0] for r in od.select("year").distinct().orderBy("year").collect()]
    wide = od_wide(od, keys, value)
    for y in years:
        wide.where(F.col("year") == y).drop("year").write.option("header", True).csv(f"{folder.rstrip('/')}/od_matrix_{y}.csv")
    return years


def read_dimension(spark: SparkSession, path: str) -> DataFrame:
    """S3: a dimension (entities and their names) from JSON, one object per line or one array."""
    lines = spark.read.json(path)
    return lines if "_corrupt_record" not in lines.columns else spark.read.option("multiLine", True).json(path)


def od_wide(od: DataFrame, dst_values, value: str = "value") -> DataFrame:
    """Long → wide OD matrix per (src, year), one column per destination."""
    return (od.groupBy("src", "year").pivot("dst", list(dst_values)).agg(F.first(value))
            .select("src", "year", *[F.col(str(v)) for v in dst_values]))


def unpivot_od(wide: DataFrame, ids, value_cols, var: str = "dst",
               value: str = "value", drop_null: bool = True) -> DataFrame:
    """P10: melt a wide matrix to long rows; NULL cells dropped (absent flows)."""
    long = wide.unpivot(list(ids), [F.col(f"`{c}`") for c in value_cols], var, value)
    if drop_null:
        long = long.where(F.col(value).isNotNull())
    return long.withColumn(var, F.col(var).cast("int")) if all(
        str(c).lstrip("-").isdigit() for c in value_cols) else long


def rename(df: DataFrame, mapping: dict) -> DataFrame:
    """Rename the mapped columns that exist."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def sanitize_columns(df: DataFrame) -> DataFrame:
    """Space → ``_`` and ``%`` → ``pct`` in every column name."""
    return df.toDF(*[sanitize_name(c) for c in df.columns])


def alias_fallback(df: DataFrame, target: str, candidates) -> DataFrame:
    """Provide ``target`` from the first candidate column that exists."""
    if target in df.columns:
        return df
    for c in candidates:
        if c in df.columns:
            return df.withColumn(target, F.col(c))
    return df.withColumn(target, F.lit(None).cast("double"))


def lookup(df: DataFrame, dim: DataFrame, on: str, dim_key: str, dim_val: str, out: str) -> DataFrame:
    """Dictionary lookup column, NULL if unknown (left join on the dimension).

    The dimension is small and bounded (one row per entity); AQE broadcasts it.
    """
    d = dim.select(F.col(dim_key).alias(f"_k_{out}"), F.col(dim_val).alias(out))
    return df.join(d, df[on] == d[f"_k_{out}"], "left").drop(f"_k_{out}")


def load_od(od: DataFrame, dim: DataFrame, key: str, name: str, kind: str = "flow",
            default_year: int | None = None) -> DataFrame:
    """Long OD table with names (P13), a kind literal (P14), value alias
    and rows without a value dropped (P8)."""
    od = alias_fallback(od, "value", ["flow", "revenue"])
    if default_year is not None:
        od = od.withColumn("year", F.coalesce(F.col("year"), F.lit(default_year)))
    out = lookup(od, dim, "src", key, name, "src_name")
    out = lookup(out, dim, "dst", key, name, "dst_name")
    return out.withColumn("kind", F.lit(kind)).dropna(subset=["value"])


def load_panel(panel: DataFrame, dim: DataFrame, key: str, name: str) -> DataFrame:
    """Sanitised names (P2) plus the entity name looked up."""
    p = sanitize_columns(panel)
    return lookup(p, dim, key, key, name, f"{key}_name")


def union_by_name(frames) -> DataFrame:
    """Bag union of frames with different columns (missing → NULL)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    """Numeric columns from the schema (no job), minus exclusions."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and f.name not in exclude]


def select_existing(df: DataFrame, wanted) -> DataFrame:
    """Project the listed columns that exist, in the listed order."""
    return df.select(*[c for c in wanted if c in df.columns])


def columns_by_keyword(df: DataFrame, keywords, per_keyword: int = 2, cap: int = 10) -> list[str]:
    """Numeric columns whose name contains a keyword, first ``per_keyword`` per
    keyword, de-duplicated in first-seen order, at most ``cap``."""
    num = numeric_columns(df)
    out: list[str] = []
    for k in keywords:
        for c in [c for c in num if k in c][:per_keyword]:
            if c not in out:
                out.append(c)
    return out[:cap]


def profile_by(df: DataFrame, ts_col: str, distinct_cols, names) -> DataFrame:
    """S5 + A5: rows per year, distinct counts and first/last day, one aggregate."""
    return df.groupBy(F.year(ts_col).alias("year")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.countDistinct(c).alias(n) for c, n in zip(distinct_cols, names)],
        F.to_date(F.min(ts_col)).alias("first_day"),
        F.to_date(F.max(ts_col)).alias("last_day"))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by=None) -> None:
    """Result-table sink, written by the executors (no driver collect)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.format(fmt).option("header", True).save(path)
