"""Record files (A2, A3, A7): JSON lines / JSON array / CSV readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_records(spark: SparkSession, path: str, fmt: str, schema: StructType | str) -> DataFrame:
    """A2: ``jsonl`` (blank lines skipped), ``json`` (one array document per file) or ``csv`` (header)."""
    if fmt == "jsonl":
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if fmt == "json":
        return spark.read.schema(schema).option("multiLine", True).json(path)
    if fmt == "csv":
        return (spark.read.schema(schema).option("header", True).option("multiLine", True)
                .option("escape", '"').option("encoding", "UTF-8").csv(path))
    raise ValueError(f"Unsupported format: {fmt}")


def read_problems(spark: SparkSession, path: str, split: str = "train", fmt: str = "jsonl",
                  schema: StructType | str = "question string, answer string") -> DataFrame:
    """A1: the rows of one split, a file or folder ``<path>/<split>``; a missing split raises."""
    return read_records(spark, f"{path.rstrip('/')}/{split}", fmt, schema)


def write_records(df: DataFrame, path: str, fmt: str, mode: str = "overwrite") -> None:
    """A3: UTF-8 JSON lines or CSV with header; non-ASCII text is written as is."""
    if fmt == "jsonl":
        df.write.mode(mode).option("encoding", "UTF-8").json(path)
    elif fmt == "csv":
        df.write.mode(mode).option("header", True).option("escape", '"').option("encoding", "UTF-8").csv(path)
    else:
        raise ValueError(f"Unsupported format: {fmt}")


def training_precheck(df: DataFrame, required: list[str], expected: int) -> DataFrame:
    """Required columns present, no nulls in them, and row count equal to the expected count."""
    missing = [c for c in required if c not in df.columns]
    present = [c for c in required if c in df.columns]
    null_rows = F.count_if(F.greatest(*[F.col(c).isNull() for c in present])) if present else F.lit(0)
    agg = df.agg(F.count(F.lit(1)).alias("n"), null_rows.alias("nulls"))
    return agg.select(F.explode(F.array(
        F.struct(F.lit("required_columns").alias("check"), F.lit(not missing).alias("ok"),
                 F.lit(",".join(missing)).alias("detail")),
        F.struct(F.lit("null_fields").alias("check"), (F.col("nulls") == 0).alias("ok"),
                 F.col("nulls").cast("string").alias("detail")),
        F.struct(F.lit("row_count").alias("check"), (F.col("n") == expected).alias("ok"),
                 F.concat(F.lit(f"expected {expected}, got "), F.col("n").cast("string")).alias("detail")),
    )).alias("c")).select("c.*")
