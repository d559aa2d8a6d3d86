"""CSV and parquet tables with fixed schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contestry.operators.dataset import STAT_SUFFIXES


def _text(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


# The columns of the raw files, all read as text and typed later.
RAW_CONTESTS = _text(
    "contest_id", "date", "r_id", "b_id", "winner_id", "method", "finish_round", "total_rounds",
    "division", "title_fight", "match_time_sec",
    *[f"{side}_{suffix}" for side in "rb" for suffix in STAT_SUFFIXES.values()],
)
RAW_COMPETITORS = _text("id", "name", "height", "reach", "stance", "dob")
RAW_QUOTES = _text(
    "contest_url", "load_order", "competitor_1", "competitor_2", "competitor_1_url", "competitor_2_url",
    "odds_1", "odds_2",
)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Columns by name, whatever their order in the file; extra columns are dropped."""
    header = spark.read.option("header", True).option("inferSchema", False).csv(path)
    present = {c.strip(): c for c in header.columns}
    return header.select(
        *[
            (F.col(f"`{present[f.name]}`") if f.name in present else F.lit(None).cast("string")).alias(f.name)
            for f in schema.fields
        ]
    )


def write_csv(df: DataFrame, path: str) -> None:
    df.select(*[F.col(c).cast("string").alias(c) for c in df.columns]).write.option("header", True).mode(
        "overwrite"
    ).csv(path)


def typed_quotes(raw: DataFrame) -> DataFrame:
    return raw.withColumns(
        {
            "load_order": F.col("load_order").try_cast("int"),
            "odds_1": F.col("odds_1").try_cast("double"),
            "odds_2": F.col("odds_2").try_cast("double"),
        }
    )


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def write_table(df: DataFrame, path: str, *partition_by: str, order_by: Sequence[str] = ()) -> None:
    """Replace a table, in a fixed row order if asked.  ``path`` must not be one ``df`` reads.

    The order is a range sort over all tasks, so files follow each other and a
    later filter on the leading column skips most of them.
    """
    ordered = df.sort(*order_by) if order_by else df
    writer = ordered.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


# The row order of the stored tables.
ORDER = {
    "competitors": ("competitor_id",),
    "contests": ("date", "contest_id"),
    "side_stats": ("contest_id", "side"),
}


def schema_report(df: DataFrame, source: str) -> DataFrame:
    """Per column: type, row count, non-null count, smallest and largest value as text."""
    counted = df.agg(
        F.count("*").alias("n_rows"),
        *[
            F.struct(
                F.count(c).alias("n_values"),
                F.min(c).cast("string").alias("smallest"),
                F.max(c).cast("string").alias("largest"),
            ).alias(c)
            for c in df.columns
        ],
    )
    rows = [
        F.struct(
            F.lit(source).alias("source"),
            F.lit(i).alias("position"),
            F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("type"),
            F.col("n_rows"),
            F.col(f"`{f.name}`.n_values").alias("n_values"),
            F.col(f"`{f.name}`.smallest").alias("smallest"),
            F.col(f"`{f.name}`.largest").alias("largest"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    return counted.select(F.inline(F.array(*rows)))


def profile(df: DataFrame, source: str) -> DataFrame:
    """Per column: type, rows, non-null values, about how many differ, smallest and largest as text.

    One aggregate a table, whatever its size: counts are exact, the number of different
    values comes from a mergeable sketch (about 2 % off).  Columns without an order (maps,
    variants) have counts only; a table without columns has no rows here.
    """

    def summary(place: int, field: T.StructField) -> Column:
        c = F.col(f"`{field.name}`")
        ends = [F.lit(None), F.lit(None)] if isinstance(field.dataType, (T.MapType, T.VariantType)) else [F.min(c), F.max(c)]
        key = F.to_json(F.struct(c)) if isinstance(field.dataType, (T.MapType, T.VariantType)) else c
        differ = F.approx_count_distinct(F.when(c.isNotNull(), F.xxhash64(key)), 0.02)
        return F.struct(
            F.lit(source).alias("source"), F.lit(place).alias("position"), F.lit(field.name).alias("column"),
            F.lit(field.dataType.simpleString()).alias("type"), F.count("*").alias("n_rows"), F.count(c).alias("n_values"),
            differ.alias("n_different"), ends[0].cast("string").alias("smallest"), ends[1].cast("string").alias("largest"),
        )

    found = [summary(place, field) for place, field in enumerate(df.schema.fields)]
    # one row, one struct a column of the table
    return df.agg(F.array(*found).alias("columns")).select(F.inline("columns"))
