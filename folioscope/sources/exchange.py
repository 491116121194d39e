"""Import of matrices and export of small results."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def npy(spark: SparkSession, path: str) -> DataFrame:
    """row and vector of .npy files with two dimensions, to be joined by row number with the table that they belong to."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                m = np.load(io.BytesIO(content), allow_pickle=False)
                for s in range(0, len(m), 4096):
                    yield pd.DataFrame({"row": np.arange(s, min(s + 4096, len(m))), "vector": [v.astype(np.float32) for v in m[s : s + 4096]]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "row long, vector array<float>")


def numbered(df: DataFrame, vectors: DataFrame, position: str) -> DataFrame:
    """df with the vector of its position; lengths that differ are an error, not a shift."""
    n, m = df.count(), vectors.count()
    if n != m:
        raise ValueError(f"{n} rows but {m} vectors")
    return df.join(vectors, F.col(position) == F.col("row")).drop("row")


def to_csv(df: DataFrame, path: str, *order: str) -> None:
    """One CSV file with a header, for people; arrays are joined by |."""
    flat = df.select(*(F.array_join(c, "|").alias(c) if t.startswith("array<string") else F.to_json(c).alias(c) if t.startswith(("struct", "array", "map")) else F.col(c) for c, t in df.dtypes))
    (flat.orderBy(*order) if order else flat).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def summary(tables: dict[str, DataFrame], most: int = 1000) -> DataFrame:
    """One row with a JSON array for each table; tables of over `most` rows are refused."""
    out = None
    for name, df in tables.items():
        rows = df.limit(most + 1).agg(F.to_json(F.collect_list(F.struct(*df.columns))).alias(name), F.count("*").alias("_n"))
        checked = rows.select(F.when(F.col("_n") > most, F.raise_error(F.lit(f"{name} has over {most} rows"))).otherwise(F.col(name)).alias(name))
        out = checked if out is None else out.crossJoin(checked)
    return out


def markdown(df: DataFrame, *order: str, most: int = 200) -> DataFrame:
    """One row, the table as Markdown text, its first `most` rows in order; a last line counts the others."""
    cell = lambda c: F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit(""))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, df.columns)), F.lit(" |"))
    top = df.orderBy(*order).limit(most).select(F.struct(*order).alias("o"), line.alias("l"))
    head = f"| {' | '.join(df.columns)} |\n|{'-|' * len(df.columns)}\n"
    n = df.agg(F.count("*").alias("n"))
    rest = F.when(F.col("n") > most, F.concat(F.lit("\n\n… and "), F.col("n") - most, F.lit(" more rows"))).otherwise("")
    return top.agg(F.concat(F.lit(head), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "l"))), lambda x: x["l"]), "\n")).alias("text")).crossJoin(F.broadcast(n)).select(F.concat("text", rest).alias("text"))
