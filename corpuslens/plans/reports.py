"""Export of the report tables, one directory per sheet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.operators import entities, lineage, prompts, sqltext


def scanner_sheets(nodes: DataFrame, explanations: DataFrame | None = None) -> dict[str, DataFrame]:
    """Overview, Variables, DataFrames, Transformations, Source_Target, SQL_Analysis."""
    frames = entities.dataframes(nodes)
    queries = sqltext.distinct_queries(entities.sql_entries(nodes))
    tables = sqltext.query_tables(sqltext.sql_tokens(queries))
    return {
        "Overview": entities.overview(nodes),
        "Variables": entities.variable_report(nodes),
        "DataFrames": entities.dataframe_report(nodes),
        "Transformations": entities.transformation_report(nodes),
        "Source_Target": lineage.mapping(frames, sqltext.query_edges(queries, tables)),
        "SQL_Analysis": sqltext.query_report(queries, tables, explanations),
    }


def older_sheets(nodes: DataFrame, files: DataFrame, answers: DataFrame | None = None) -> dict[str, DataFrame]:
    """Entities, and Transformations: each query of each file with its explanation."""
    used = entities.used_queries(nodes, files)
    explained = used.withColumn("explanation", F.lit(None).cast("string")) if answers is None else (
        prompts.attach_explanations(used, "sql", "sql", answers))
    return {
        "Entities": entities.entity_report(nodes, files),
        "Transformations": explained.select("path", "sql", "explanation"),
    }


def write_sheets(sheets: dict[str, DataFrame], folder: str, format: str = "parquet") -> None:
    """Each sheet is written by its own tasks; nothing passes through the driver."""
    for name, rows in sheets.items():
        rows.write.mode("overwrite").format(format).save(f"{folder}/{name}")


def read_sheets(spark: SparkSession, folder: str, names: list[str], format: str = "parquet") -> DataFrame:
    """(sheet, rows, chars) of written sheets; chars are those of all their cells."""
    counts = []
    for name in names:
        sheet = spark.read.format(format).load(f"{folder}/{name}")
        cells = reduce(lambda x, y: x + y, [F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) for c in sheet.columns])
        counts.append(sheet.agg(F.count("*").alias("rows"), F.coalesce(F.sum(cells), F.lit(0)).cast("bigint").alias("chars")).select(
            F.lit(name).alias("sheet"), "rows", "chars"))
    return reduce(DataFrame.unionByName, counts)


def write_lineage(export: DataFrame, folder: str) -> None:
    """The nested export as JSON lines, one for each record."""
    export.write.mode("overwrite").json(folder)
