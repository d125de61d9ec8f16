"""One nested JSON document for each project, written in pieces by many tasks.

A document is a head, an entry for each analysed file, and a tail; each is a line of
its own, and line ends are white space in JSON.  Pieces are ordered by ranges of
(project, place), so a project with a third of all files is spread over many tasks, and
each task writes its run of lines.  The files of a project's folder, in the order of
their task and count, are its document; `parts` is the manifest of that order.  No
task and no row ever holds a whole document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.operators.project_lineage import lineage_entries, lineage_headers
from corpuslens.sources import listing
from corpuslens.sources.files import qualified

HEAD, ENTRY, TAIL = 0, 1, 2
NO_PROJECT = "__none__"
_PLACE = ["project", "section", "seq", "file"]
_HEAD_MEMBERS = ["project", "code_lineage", "technical_stack", "dependencies", "data_flow", "components", "legacy_aspects", "modernization_opportunities"]


def json_text(value: Column) -> Column:
    """A value of any type as JSON; strings too, which `to_json` does not take alone."""
    listed = F.to_json(F.array(value))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def json_elements(texts: Column) -> Column:
    """A list of texts as a JSON list, in which texts that are JSON objects stay objects."""
    is_object = lambda e: F.coalesce(e.rlike(r"^\s*\{") & F.try_parse_json(e).isNotNull(), F.lit(False))
    return F.concat(F.lit("["), F.array_join(F.transform(texts, lambda e: F.when(is_object(e), e).otherwise(json_text(e))), ","), F.lit("]"))


def json_object(members: dict[str, Column]) -> Column:
    """An object of members that are JSON already, in that order."""
    parts = []
    for name, value in members.items():
        parts += [F.lit(("," if parts else "{") + f'"{name}":'), value]
    return F.concat(*parts, F.lit("}"))


def lineage_pieces(structures: DataFrame, analyses: DataFrame) -> DataFrame:
    """project, section, seq, file, text: head, entries by place in the listing, and tail of every project.

    analyses need `seq`, their place in the listing; projects without a structure have no document.
    """
    headers = lineage_headers(structures, analyses)
    flow = F.col("header.data_flow")
    members = {n: json_text(F.col(f"header.{n}")) for n in _HEAD_MEMBERS}
    members["data_flow"] = json_object({n: json_elements(F.coalesce(flow[n], F.array().cast("array<string>"))) for n in ("sources", "transformations", "sinks")})
    whole = json_object(members)
    head = F.concat(F.substring(whole, F.lit(1), F.length(whole) - 1), F.lit(',"file_analyses":['))
    tail = F.concat(F.lit('],"metadata":'), json_text(F.col("header.metadata")), F.lit("}"))
    place = lambda section: [F.lit(section).alias("section"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast("string").alias("file")]
    heads = headers.select("project", *place(HEAD), head.alias("text"))
    tails = headers.select("project", *place(TAIL), tail.alias("text"))

    entries = lineage_entries(analyses).join(analyses.select("project", "file", F.col("seq").cast("long").alias("seq")), ["project", "file"])
    # one row for each project that has a structure: right side of a join that adaptive execution splits
    firsts = entries.groupBy("project").agg(F.min(F.struct("seq", "file")).alias("first")).join(structures.select("project"), "project", "left_semi")
    e = F.col("entry")
    body = json_object({
        n: F.coalesce(F.to_json(e[n]), F.lit("{}")) if n == "external_communications" else json_text(e[n])
        for n in entries.schema["entry"].dataType.names})
    comma = F.when(F.struct("seq", "file") == F.col("first"), F.lit("")).otherwise(F.lit(","))
    rows = entries.join(firsts, "project").select("project", F.lit(ENTRY).alias("section"), "seq", "file", F.concat(comma, body).alias("text"))
    return heads.unionByName(rows).unionByName(tails)


def write_documents(spark: SparkSession, pieces: DataFrame, folder: str, stage: str, lines_per_file: int = 100_000) -> None:
    """Write pieces(project, section, seq, file, text) below `folder`/project=...; `stage` holds them while ranges are found.

    A null or empty project is the project `__none__`.
    """
    named = F.coalesce(F.nullif("project", F.lit("")), F.lit(NO_PROJECT))
    pieces.withColumn("project", named).write.mode("overwrite").parquet(stage)
    # never null, so that the writer takes the order as it is
    staged = spark.read.parquet(stage).withColumn("project", named)
    staged.repartitionByRange(*_PLACE).sortWithinPartitions(*_PLACE).select("project", "text").write.mode("overwrite").option(
        "maxRecordsPerFile", lines_per_file).partitionBy("project").text(folder)


def _placed(files: DataFrame, path: str) -> DataFrame:
    """Adds project, task and count, from the path of a written file."""
    name = r"/project=([^/]+)/part-(\d+)-[^/]*?(?:\.?-?c(\d+))?(?:\.[a-z]+)*$"
    part = lambda k: F.regexp_extract(path, name, k)
    return files.withColumn("project", F.url_decode(F.replace(part(1), F.lit("+"), F.lit("%2B")))).withColumn(
        "task", part(2).cast("int")).withColumn("count", F.coalesce(part(3).try_cast("int"), F.lit(0)))


def _listed(spark: SparkSession, folder: str) -> DataFrame:
    """path, size of the written files, by path relative to the folder: listed by tasks, since there is a
    folder for each project.  A folder that cannot be listed fails the task."""
    found = listing.listed(spark, folder, f"{folder.rstrip('/')}_listing", "part-*")
    return found.select(F.when(F.col("error").isNull(), F.col("path")).otherwise(F.raise_error("error")).alias("path"), "size")


def parts(spark: SparkSession, folder: str) -> DataFrame:
    """project, part, path, bytes, first_byte: the files whose contents, in the order of `part`, are a project's document."""
    base = qualified(spark, folder).rstrip("/")
    files = _listed(spark, folder).select(F.concat(F.lit(f"{base}/"), "path").alias("path"), F.col("size").alias("bytes"))
    order = W.partitionBy("project").orderBy("task", "count")
    return _placed(files, "path").select(
        "project", (F.row_number().over(order) - 1).alias("part"), "path", "bytes",
        (F.sum("bytes").over(order) - F.col("bytes")).alias("first_byte"))


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """project, line, text of all documents; a row of work is one file, a run of lines."""
    read = listing.read_listed(spark, folder, _listed(spark, folder))
    whole = F.when(F.col("read_ok"), F.col("content")).otherwise(F.raise_error(F.concat_ws(": ", "path", "error")))
    split = _placed(read.select(F.concat(F.lit("/"), "path").alias("path"), whole.alias("value")), "path").select(
        "project", "task", "count", F.split(F.regexp_replace("value", r"\n$", ""), "\n").alias("own"))
    order = W.partitionBy("project").orderBy("task", "count")
    sizes = split.select("project", "task", "count", F.size("own").alias("n"))
    firsts = sizes.select("project", "task", "count", (F.sum("n").over(order) - F.col("n")).alias("first"))
    return split.join(firsts, ["project", "task", "count"]).select(
        "project", "first", F.posexplode("own").alias("at", "text")).select("project", (F.col("first") + F.col("at")).alias("line"), "text")
