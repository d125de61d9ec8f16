"""Source-to-target mapping and the data-flow graph of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens import fixed_values as fv
from corpuslens.functions.text import shorten

MAPPING_COLUMNS = ["source_type", "source", "target_type", "target", "operation", "filename"]


def _key(path, name) -> Column:
    return F.concat(F.col(path), F.lit(":"), F.col(name))


def dataframe_edges(frames: DataFrame) -> DataFrame:
    """file -> DataFrame for sources, DataFrame -> DataFrame for transformations."""
    is_source = F.col("df_type") == "source"
    return frames.select(
        F.when(is_source, "file").otherwise("dataframe").alias("source_type"),
        F.when(is_source, F.col("source")).otherwise(_key("path", "source")).alias("source"),
        F.lit("dataframe").alias("target_type"), _key("path", "name").alias("target"),
        F.col("method").alias("operation"), F.col("path").alias("filename"), "seq",
    )


def mapping(frames: DataFrame, query_edge_rows: DataFrame) -> DataFrame:
    """All lineage edges, one row per DataFrame and per table used by a query."""
    return dataframe_edges(frames).select(*MAPPING_COLUMNS).unionByName(query_edge_rows.select(*MAPPING_COLUMNS))


def vertices(frames: DataFrame, query_edge_rows: DataFrame) -> DataFrame:
    """id, type, df_type.  DataFrames come first, then the ends of edges in order;
    the first type seen for an id wins.

    A minimum per id combines map-side, so an id that every file mentions (the
    same input path, say) does not gather its rows in one task.
    """
    none = F.lit(None).cast("string")
    order = lambda section, file, seq, end: F.struct(
        F.lit(section).alias("section"), F.col(file).alias("file"), F.col(seq).alias("seq"), F.lit(end).alias("end"))
    known = frames.select(
        _key("path", "name").alias("id"), F.lit("dataframe").alias("type"), "df_type",
        order(0, "path", "seq", 0).alias("order"))
    ends = lambda edges, section: edges.select(F.explode(F.array(*[
        F.struct(F.col(side).alias("id"), F.col(f"{side}_type").alias("type"), order(section, "filename", "seq", end).alias("order"))
        for end, side in enumerate(("source", "target"))
    ])).alias("e")).select("e.id", "e.type", none.alias("df_type"), "e.order")
    return (
        known.unionByName(ends(dataframe_edges(frames), 1))
        .unionByName(ends(query_edge_rows.withColumn("seq", F.lit(0)), 2))
        .groupBy("id").agg(F.min_by(F.struct("type", "df_type"), "order").alias("first"))
        .select("id", "first.type", "first.df_type")
    )


def unique_edges(frames: DataFrame, query_edge_rows: DataFrame) -> DataFrame:
    """One edge per (source, target); the last operation and file win."""
    rows = dataframe_edges(frames).withColumn("section", F.lit(1)).unionByName(
        query_edge_rows.withColumn("seq", F.lit(0)).withColumn("section", F.lit(2)))
    return (
        rows.groupBy("source", "target")
        .agg(F.max_by(F.struct("operation", "filename"), F.struct("section", "filename", "seq")).alias("last"))
        .select("source", "target", "last.operation", "last.filename")
    )


def label(text: Column) -> Column:
    return shorten(text, fv.LABEL_MAX, fv.LABEL_KEEP, fv.LABEL_TAIL)


def vertex_labels(vertex_rows: DataFrame) -> DataFrame:
    return vertex_rows.select("id", label(F.col("id")).alias("label"))


def edge_labels(edge_rows: DataFrame) -> DataFrame:
    return edge_rows.select("source", "target", F.col("operation").alias("label"))
