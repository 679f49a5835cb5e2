"""K1-K5 sinks.  Every sink writes partitions in parallel; nothing is
collected on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.gating import present_outputs


def append_missing_outputs(new: DataFrame, existing: DataFrame | None, path: str, keys: list[str]) -> DataFrame:
    """K1: append only outputs whose (keys, provider, kind) has no non-empty
    text yet; a non-empty output is never overwritten, and one provider's
    outputs never hide another's.  Returns what was written."""
    at = keys + ["provider"] if existing is not None and "provider" in existing.columns else keys
    todo = new if existing is None else new.join(present_outputs(existing, at), at + ["kind"], "left_anti")
    todo = todo.filter(F.col("text").isNotNull() & (F.length("text") > 0))
    todo.write.mode("append").partitionBy("provider").parquet(path)
    return todo


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "append") -> None:
    """K2/K3: splits and contents as Parquet (dynamic partition overwrite keeps
    other providers untouched when ``mode='overwrite'``)."""
    w = df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_scores_csv(df: DataFrame, path: str, decimals: int = 4) -> None:
    """K4: CSV with header; doubles formatted with a fixed number of decimals
    only here, at the sink."""
    cols = [F.format_string(f"%.{decimals}f", F.col(f.name)).alias(f.name) if f.dataType.simpleString() == "double"
            else F.col(f.name) for f in df.schema.fields]
    df.select(*cols).write.mode("overwrite").option("header", True).csv(path)


def write_summary_maps(df: DataFrame, path: str) -> None:
    """K5: per provider, one JSON object per book (``book -> summary``),
    written as JSON lines under ``provider=<name>`` folders; non-ASCII text is
    kept as is.  One line per book keeps a large provider spread over tasks."""
    df.select("provider", F.to_json(F.create_map(F.col("book").cast("string"), F.col("summary"))).alias("value")) \
        .write.mode("overwrite").partitionBy("provider").text(path)
