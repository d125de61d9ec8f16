"""Projects and model answers rendered from `part`, and language marks of `pages`.

The checks are closed forms over the part key (k) and size (s): m = k % 13 picks
the kind of file, k % 4 the form of the answer about it.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from corpuslens import fixed_values as fv
from corpuslens.functions.text import sorted_join
from corpuslens.operators import answers, project, project_lineage, prompts
from corpuslens.plans import documents, reports
from corpuslens.plans.catalog import query
from corpuslens.sources import corpora
from corpuslens.sources.workspace import run_folder, written


def _files(spark, sf):
    return corpora.project_files(spark, sf)


def _answers(spark, sf):
    return corpora.file_answers(spark, sf)


Q = "chr(39)"
PF = f"""WITH pf AS (SELECT p_partkey AS k, p_size AS s, p_partkey % 13 AS m, {corpora.PROJECT} AS project, {corpora.PROJECT_PATH} AS path,
 {corpora.PROJECT_FILE_NAME} AS name, p_partkey % 17 <> 5 AS has FROM part),
 lg AS (SELECT *, CASE m WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' WHEN 2 THEN 'json' WHEN 3 THEN 'requirements' WHEN 4 THEN 'dockerfile'
   WHEN 5 THEN 'makefile' WHEN 6 THEN 'ignore' WHEN 7 THEN 'tsx' WHEN 10 THEN 'sql' WHEN 11 THEN 'go'
   WHEN 8 THEN CASE WHEN NOT has THEN 'unknown' ELSE ['python', 'javascript', 'bash', 'perl', 'ruby'][s % 5 + 1] END
   WHEN 9 THEN CASE WHEN NOT has THEN 'unknown' ELSE ['php', 'html', 'unknown', 'jsx', 'java', 'cpp'][s % 6 + 1] END
   ELSE 'unknown' END AS language,
   CASE WHEN m IN (0, 1, 2, 7, 10, 11) THEN 'extension' WHEN m IN (3, 4, 5, 6) THEN 'name' WHEN m = 8 AND has THEN 'shebang'
   WHEN m = 9 AND has AND s % 6 <> 2 THEN 'content' ELSE 'default' END AS decided_by,
   CASE m WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 3 THEN 11 WHEN 2 THEN 12 ELSE 0 END AS pattern FROM pf),
 tr AS (SELECT *, CASE WHEN pattern > 0 THEN 1 WHEN m IN (7, 11) THEN 2 WHEN has AND m IN (4, 5, 6, 10, 12) AND s * 60 > 1000 THEN 3 END AS tier FROM lg),
 cn AS (SELECT *, count(*) FILTER (WHERE tier = 1) OVER (PARTITION BY project) AS n1,
   count(*) FILTER (WHERE tier <= 2) OVER (PARTITION BY project) AS n2 FROM tr),
 kr AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY tier, pattern, k) AS rank FROM cn
   WHERE tier = 1 OR (tier = 2 AND n1 < 10) OR (tier = 3 AND n2 < 10)),
 kf AS (SELECT * FROM kr WHERE rank <= 20),
 dp AS (SELECT project, path, unnest(['Flask', 'numpy', 'flask']) AS dependency, unnest([true, false, false]) AS is_import_tail, 'py' AS src FROM kf WHERE m = 0 AND has
   UNION ALL SELECT project, path, unnest(['react', concat('lodash', s)]), NULL, 'js' FROM kf WHERE m = 1 AND has
   UNION ALL SELECT project, path, unnest([concat('dep', s), 'jest']), NULL, 'json' FROM kf WHERE m = 2 AND has AND k % 2 = 0
   UNION ALL SELECT project, path, unnest(['pandas', concat('lib', s), 'raw']), NULL, 'req' FROM kf WHERE m = 3 AND has),
 ds AS (SELECT DISTINCT project, dependency FROM dp),
 dr AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY dependency) AS rank FROM ds)
"""


# --- sources and languages --------------------------------------------------------
@query("s4_attach_contents", PF + "SELECT path, has AS read_ok FROM pf")
def s4(spark, sf):
    files = _files(spark, sf)
    return project.attach_contents(files.select("project", "seq", "path"), project.read_files(files).select("path", "content")).select(
        "path", "read_ok")


@query("l1_language_by_extension", PF + """SELECT path, CASE m WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.json' WHEN 3 THEN '.txt' WHEN 7 THEN '.tsx'
 WHEN 10 THEN '.sql' WHEN 11 THEN '.go' WHEN 12 THEN '.gz' ELSE '' END AS ext, CASE WHEN decided_by = 'extension' THEN language END AS language FROM lg""")
def l1(spark, sf):
    return project.language_by_extension(_files(spark, sf)).select("path", "ext", F.col("ext_language").alias("language"))


@query("l2_language_by_name", PF + "SELECT path, CASE WHEN m IN (3, 4, 5, 6) THEN language END AS language FROM lg")
def l2(spark, sf):
    return _files(spark, sf).select("path", project.language_by_name().alias("language"))


@query("l3_language_by_shebang", PF + "SELECT path, CASE WHEN m = 8 AND has THEN language END AS language FROM lg")
def l3(spark, sf):
    return _files(spark, sf).select("path", project.language_by_shebang().alias("language"))


HEAD = "html[:1000]"


@query("l4_language_by_content", f"""SELECT page_id, CASE WHEN contains({HEAD}, '<?php') THEN 'php'
 WHEN contains(lower({HEAD}), '<html') OR contains(lower({HEAD}), '<!doctype html') THEN 'html'
 WHEN contains({HEAD}, 'import React') OR contains({HEAD}, concat('from ', {Q}, 'react', {Q})) THEN 'jsx'
 WHEN contains({HEAD}, 'package ') AND contains({HEAD}, 'import ') AND contains({HEAD}, chr(123)) THEN 'java'
 WHEN contains({HEAD}, '#include') AND (contains({HEAD}, '.h') OR contains({HEAD}, '.hpp')) THEN 'cpp' END AS language FROM pages""")
def l4(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet").withColumnRenamed("html", "content").select(
        "page_id", project.language_by_content().alias("language"))


@query("l5_detect_language", PF + "SELECT path, language, decided_by FROM lg")
def l5(spark, sf):
    return project.detect_language(_files(spark, sf)).select("path", "language", "decided_by")


@query("l5_whole_content", PF + "SELECT path, language, decided_by FROM lg")
def l5_whole(spark, sf):
    return project.detect_language(_files(spark, sf), probe=None).select("path", "language", "decided_by")


@query("l5_given_language", PF + """SELECT path, CASE WHEN k % 3 = 0 THEN 'cobol' ELSE language END AS language,
 CASE WHEN k % 3 = 0 THEN 'given' ELSE decided_by END AS decided_by FROM lg""")
def l5_given(spark, sf):
    files = _files(spark, sf).withColumn("told", F.expr("CASE seq % 3 WHEN 0 THEN 'cobol' WHEN 1 THEN 'unknown' ELSE '' END"))
    return project.detect_language(files, given="told").select("path", "language", "decided_by")


COUNTS = """SELECT project, language, n, row_number() OVER (PARTITION BY project ORDER BY n DESC, first_seen) AS rank FROM (
 SELECT project, language, count(*) AS n, min(k) AS first_seen FROM lg WHERE has AND language <> 'unknown' GROUP BY project, language) c"""


@query("l6_language_summary", PF + f"SELECT project, language, n, CAST(rank AS INT) AS rank FROM ({COUNTS}) c")
def l6(spark, sf):
    return project.language_summary(_files(spark, sf))


ENTRY = "CASE WHEN has THEN concat(path, ' (', language, ')') ELSE path END"


@query("l7_file_list", PF + f"""SELECT project, CAST(rank AS INT) AS rank, entry, total FROM (SELECT project, {ENTRY} AS entry,
 row_number() OVER (PARTITION BY project ORDER BY k) AS rank, count(*) OVER (PARTITION BY project) AS total FROM lg) l WHERE rank <= 100""")
def l7(spark, sf):
    return project.file_list(_files(spark, sf))


@query("l7_whole_file_list", PF + f"SELECT project, {ENTRY} AS entry, count(*) OVER (PARTITION BY project) AS total FROM lg")
def l7_whole(spark, sf):
    return project.file_list(_files(spark, sf), limit=None).drop("rank")


TOP = """SELECT project, language, n, rank FROM (SELECT project, language, n, row_number() OVER (PARTITION BY project ORDER BY n DESC, first_seen) AS rank
 FROM (SELECT project, language, count(*) AS n, min(k) AS first_seen FROM lg WHERE has GROUP BY project, language) c) r WHERE rank <= 5"""


@query("l8_main_languages", PF + f"SELECT project, language, n, CAST(rank AS INT) AS rank FROM ({TOP}) t")
def l8(spark, sf):
    return project.main_languages(_files(spark, sf))


@query("l8_all_languages", PF + f"SELECT project, language, n, CAST(rank AS INT) AS rank FROM ({TOP.replace('WHERE rank <= 5', '')}) t")
def l8_all(spark, sf):
    return project.main_languages(_files(spark, sf), limit=None)


# --- key files, dependencies, frameworks ---------------------------------------------
@query("l9_key_files", PF + "SELECT project, path, CAST(tier AS INT) AS tier, CAST(rank AS INT) AS rank FROM kf")
def l9(spark, sf):
    return project.key_files(_files(spark, sf))


@query("l9_all_key_files", PF + "SELECT project, path, CAST(tier AS INT) AS tier FROM kr")
def l9_all(spark, sf):
    return project.key_files(_files(spark, sf), limit=None).drop("rank")


@query("l14_all_dependencies", PF + """SELECT DISTINCT project, dependency FROM (
 SELECT project, unnest(['Flask', 'numpy', 'flask']) AS dependency FROM kr WHERE m = 0 AND has
 UNION ALL SELECT project, unnest(['react', concat('lodash', s)]) FROM kr WHERE m = 1 AND has
 UNION ALL SELECT project, unnest([concat('dep', s), 'jest']) FROM kr WHERE m = 2 AND has AND k % 2 = 0
 UNION ALL SELECT project, unnest(['pandas', concat('lib', s), 'raw']) FROM kr WHERE m = 3 AND has) d""")
def l14_all(spark, sf):
    files, key = _files(spark, sf), project.key_files(_files(spark, sf), limit=None)
    return project.dependencies(files, key)


def _keyed(spark, sf):
    files = _files(spark, sf)
    return files, project.key_files(files)


@query("l10_python_dependencies", PF + "SELECT project, path, dependency, is_import_tail FROM dp WHERE src = 'py'")
def l10(spark, sf):
    return project.python_dependencies(*_keyed(spark, sf))


@query("l11_javascript_dependencies", PF + "SELECT project, path, dependency FROM dp WHERE src = 'js'")
def l11(spark, sf):
    return project.javascript_dependencies(*_keyed(spark, sf))


@query("l12_package_json", PF + "SELECT project, path, dependency FROM dp WHERE src = 'json'")
def l12(spark, sf):
    return project.package_json_dependencies(*_keyed(spark, sf))


@query("l13_requirements", PF + "SELECT project, path, dependency FROM dp WHERE src = 'req'")
def l13(spark, sf):
    return project.requirements_dependencies(*_keyed(spark, sf))


# the same over all key files
PF_ALL = PF.replace("kf AS (SELECT * FROM kr WHERE rank <= 20)", "kf AS (SELECT * FROM kr)")


def _all_keyed(spark, sf):
    files = _files(spark, sf)
    return files, project.key_files(files, limit=None)


@query("l10_all_python_dependencies", PF_ALL + "SELECT project, path, dependency, is_import_tail FROM dp WHERE src = 'py'")
def l10_all(spark, sf):
    return project.python_dependencies(*_all_keyed(spark, sf))


@query("l11_all_javascript_dependencies", PF_ALL + "SELECT project, path, dependency FROM dp WHERE src = 'js'")
def l11_all(spark, sf):
    return project.javascript_dependencies(*_all_keyed(spark, sf))


@query("l12_all_package_json", PF_ALL + "SELECT project, path, dependency FROM dp WHERE src = 'json'")
def l12_all(spark, sf):
    return project.package_json_dependencies(*_all_keyed(spark, sf))


@query("l13_all_requirements", PF_ALL + "SELECT project, path, dependency FROM dp WHERE src = 'req'")
def l13_all(spark, sf):
    return project.requirements_dependencies(*_all_keyed(spark, sf))


@query("l14_dependencies", PF + "SELECT project, dependency FROM ds")
def l14(spark, sf):
    return project.dependencies(_files(spark, sf))


@query("l15_frameworks", PF + """SELECT path, language, CASE m WHEN 0 THEN 'flask|numpy' ELSE 'react' END AS frameworks FROM lg WHERE has AND m IN (0, 1)""")
def l15(spark, sf):
    return project.frameworks(_files(spark, sf)).withColumn("frameworks", F.array_join("frameworks", "|"))


@query("l15_document_frameworks", f"""SELECT doc_id, array_to_string(f, '|') AS frameworks FROM (SELECT doc_id,
 list_filter({fv.FRAMEWORKS['python']}, lambda x: contains(lower(text), x)) AS f FROM documents) d WHERE len(f) > 0""")
def l15_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(
        F.concat(F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), F.col("text").alias("content"))
    return project.frameworks(docs).select(
        F.regexp_replace("path", r"\.py$", "").cast("bigint").alias("doc_id"), F.array_join("frameworks", "|").alias("frameworks"))


@query("l16_file_facts", PF + """SELECT path, name AS file_name, CASE m WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.json' WHEN 3 THEN '.txt' WHEN 7 THEN '.TSX'
 WHEN 10 THEN '.sql' WHEN 11 THEN '.go' WHEN 12 THEN '.gz' ELSE '' END AS file_extension FROM pf""")
def l16(spark, sf):
    return project.file_facts(_files(spark, sf))


STATS = """SELECT project, count(*) AS total_files, (SELECT string_agg(concat(language, '=', n), '|' ORDER BY language) FROM (
 SELECT language, count(*) AS n FROM lg x WHERE x.project = lg.project AND has GROUP BY language) c) AS languages FROM lg GROUP BY project"""


@query("l17_file_stats", PF + STATS)
def l17(spark, sf):
    return project.file_stats(_files(spark, sf)).select(
        "project", "total_files",
        F.array_join(F.transform(F.array_sort(F.map_entries("languages")), lambda e: F.concat(
            e["key"], F.lit("="), e["value"].cast("string"))), "|").alias("languages"))


# --- project answers -------------------------------------------------------------------
PA = PF + f""", pk AS ({corpora.PROJECT_KEYS}), pa AS (SELECT *, x % 3 <> 2 AS is_json FROM pk),
 d20 AS (SELECT project, string_agg(concat(dependency, '/Unknown/library'), '|' ORDER BY dependency) AS deps FROM dr WHERE rank <= 20 GROUP BY project),
 d10 AS (SELECT project, string_agg(concat(dependency, '/Unknown/Unknown'), '|' ORDER BY dependency) AS deps FROM dr WHERE rank <= 10 GROUP BY project),
 tl AS (SELECT project, string_agg(language, '|' ORDER BY rank) AS langs FROM ({TOP}) t GROUP BY project),
 en AS (SELECT project, string_agg(path, '|' ORDER BY rank) AS entries FROM kf WHERE rank <= 5 GROUP BY project)
"""
DEPS = """CASE WHEN is_json AND x % 2 = 1 THEN 'flask/web/framework|numpy//library' WHEN is_json THEN coalesce(d20.deps, '') ELSE coalesce(d10.deps, '') END"""


def _flat_deps():
    return F.array_join(F.transform("dependencies", lambda d: F.concat_ws("/", d["name"], d["purpose"], d["type"])), "|").alias("dependencies")


@query("l18_dependency_defaults", PA + f"""SELECT pa.project, {DEPS} AS dependencies,
 CASE WHEN is_json THEN 'Unknown' ELSE 'Could not determine the overall purpose of the codebase.' END AS purpose
 FROM pa LEFT JOIN d20 ON d20.project = pa.project LEFT JOIN d10 ON d10.project = pa.project""")
def l18(spark, sf):
    return project_lineage.dependency_defaults(corpora.project_answers(spark, sf), _files(spark, sf)).select(
        "project", _flat_deps(), "code_lineage.purpose")


STRUCTURE = f"""SELECT pa.project, CASE WHEN is_json THEN 'json' ELSE 'default' END AS parsed_from,
 CASE WHEN is_json THEN concat('web ', pa.k) ELSE 'Unknown' END AS project_type,
 CASE WHEN is_json THEN 'python|sql' ELSE coalesce(langs, '') END AS main_languages,
 CASE WHEN NOT is_json THEN 'Could not determine' WHEN x % 2 = 0 THEN 'mvc' END AS architecture,
 CASE WHEN is_json THEN 'main.py' ELSE coalesce(entries, '') END AS entry_points, {DEPS} AS dependencies,
 CASE WHEN is_json THEN concat('fine ', pa.k) ELSE 'Analysis could not be completed in structured format. Please see raw response.' END AS summary,
 CAST(CASE WHEN is_json THEN 2 ELSE 0 END AS INT) AS n_components
 FROM pa LEFT JOIN d20 ON d20.project = pa.project LEFT JOIN d10 ON d10.project = pa.project
 LEFT JOIN tl ON tl.project = pa.project LEFT JOIN en ON en.project = pa.project"""


@query("r13_project_structure", PA + STRUCTURE)
def r13(spark, sf):
    return project_lineage.project_structures(corpora.project_answers(spark, sf), _files(spark, sf)).select(
        "project", "parsed_from", "project_type", F.array_join("main_languages", "|").alias("main_languages"), "architecture",
        F.array_join("entry_points", "|").alias("entry_points"), _flat_deps(), "summary", F.size("key_components").alias("n_components"))


# the same without limits
_no_limits = lambda sql: re.sub(r"rank <= \d+", "true", sql)
NO_LIMITS = dict(key_files=None, entry_files=None, guessed=None, default_dependencies=None, top_languages=None)


@query("l18_whole_dependencies", _no_limits(PA + f"""SELECT pa.project, {DEPS} AS dependencies,
 CASE WHEN is_json THEN 'Unknown' ELSE 'Could not determine the overall purpose of the codebase.' END AS purpose
 FROM pa LEFT JOIN d20 ON d20.project = pa.project LEFT JOIN d10 ON d10.project = pa.project"""))
def l18_whole(spark, sf):
    return project_lineage.dependency_defaults(corpora.project_answers(spark, sf), _files(spark, sf), **NO_LIMITS).select(
        "project", _flat_deps(), "code_lineage.purpose")


@query("r13_whole_structure", _no_limits(PA + STRUCTURE))
def r13_whole(spark, sf):
    return project_lineage.project_structures(corpora.project_answers(spark, sf), _files(spark, sf), **NO_LIMITS).select(
        "project", "parsed_from", "project_type", F.array_join("main_languages", "|").alias("main_languages"), "architecture",
        F.array_join("entry_points", "|").alias("entry_points"), _flat_deps(), "summary", F.size("key_components").alias("n_components"))


NL = "chr(10)"


PROJECT_PROMPTS = PA + f""", parts AS (SELECT pk.project,
 (SELECT count(*) FROM lg l WHERE l.project = pk.project) AS total,
 (SELECT string_agg(entry, {NL} ORDER BY rank) FROM (SELECT project, {ENTRY} AS entry, row_number() OVER (PARTITION BY project ORDER BY k) AS rank FROM lg) e
   WHERE e.project = pk.project AND rank <= 100) AS files,
 (SELECT string_agg(concat('- ', language, ': ', n, ' files'), {NL} ORDER BY rank) FROM ({COUNTS}) c WHERE c.project = pk.project) AS langs,
 (SELECT string_agg(concat('- ', path), {NL} ORDER BY rank) FROM kf WHERE kf.project = pk.project AND rank <= 10) AS keys,
 (SELECT string_agg(concat('- ', dependency), {NL} ORDER BY rank) FROM dr WHERE dr.project = pk.project AND rank <= 20) AS deps FROM pk),
 txt AS (SELECT project, concat({NL}, 'Analyze the structure of this project based on the file list and key information below:', {NL}, {NL},
  'File List (showing ', least(total, 100), ' of ', total, ' files):', {NL}, files, {NL}, {NL}, 'Language Distribution:', {NL}, coalesce(langs, ''), {NL}, {NL},
  'Key Files:', {NL}, coalesce(keys, ''), {NL}, {NL}, 'Detected Dependencies:', {NL}, coalesce(deps, ''), {NL}, {corpora.render(fv.PROJECT_PROMPT_TAIL)}) AS prompt FROM parts)
 SELECT project, sha256(prompt) AS prompt_hash, CAST(length(prompt) AS INT) AS n_chars FROM txt"""


@query("r3_project_prompts", PROJECT_PROMPTS)
def r3(spark, sf):
    return prompts.project_prompts(_files(spark, sf)).select("project", "prompt_hash", F.length("prompt").alias("n_chars"))


@query("r3_whole_prompts", _no_limits(PROJECT_PROMPTS).replace("least(total, 100)", "total"))
def r3_whole(spark, sf):
    rows = prompts.project_prompts(_files(spark, sf), listed_files=None, key_files=None, dependencies=None)
    return rows.select("project", "prompt_hash", F.length("prompt").alias("n_chars"))


# --- file answers -------------------------------------------------------------------------
AN = f"""WITH an AS (SELECT p_partkey AS k, p_size AS s, p_partkey % 4 AS a, {corpora.PROJECT} AS project, {corpora.PROJECT_PATH} AS file,
 {corpora.ANSWER_WORD} AS word, {corpora.ANSWER} AS raw, p_partkey % 17 <> 5 AS has FROM part)
"""
KIND = "['filter', 'map', 'reduce', 'sort', 'join', 'group', 'other'][k % 7 + 1]"


@query("r4_parse_json", AN + """SELECT file, CASE WHEN a = 0 THEN 'json' ELSE 'text' END AS parsed_from,
 CAST(CASE WHEN a = 0 THEN s ELSE -1 END AS INT) AS score, CASE WHEN a = 0 THEN concat('f', k) END AS function_name, CASE WHEN a = 0 THEN concat('Loads ', k, '.') END AS summary FROM an""")
def r4(spark, sf):
    return answers.parse_json(_answers(spark, sf)).select(
        "file", "parsed_from", F.coalesce("answer.code_quality.score", F.lit(-1)).alias("score"),
        F.get(F.col("answer.functions.important_functions"), F.lit(0))["name"].alias("function_name"), "answer.summary")


HEADERS = "['" + "', '".join(fv.SECTION_HEADERS) + "']"
R5_NAMES = ["strength", "weakness", "function", "class", "variable", "api", "security", "summary"]
R5_ORACLE = " UNION ALL ".join(f"""SELECT file, '{n}' AS section, CASE WHEN st = 0 OR strpos(body, chr(10)) = 0 THEN ''
 ELSE trim(substr(body, strpos(body, chr(10)) + 1), concat(' ', chr(10))) END AS text FROM (SELECT file, st,
 trim(substr(raw, st, coalesce(list_min(list_filter(list_transform({HEADERS}, lambda h: CASE WHEN h = '{n}' OR strpos(substr(lower(raw), st + {len(n)}), h) = 0 THEN NULL
   ELSE strpos(substr(lower(raw), st + {len(n)}), h) + {len(n)} - 1 END), lambda e: e IS NOT NULL)), length(raw) + 1)), concat(' ', chr(10))) AS body
 FROM (SELECT file, raw, strpos(lower(raw), '{n}') AS st FROM an) x) y""" for n in R5_NAMES)


@query("r5_sections", AN + R5_ORACLE)
def r5(spark, sf):
    pairs = F.array(*[F.struct(F.lit(n).alias("section"), F.col(f"section_{n}").alias("text")) for n in R5_NAMES])
    return answers.sections(_answers(spark, sf), "raw", R5_NAMES).select("file", F.explode(pairs).alias("p")).select("file", "p.section", "p.text")


@query("r6_list_items", AN + """SELECT file, CASE a WHEN 1 THEN concat('clear ', k, '|short|no tests|`load_', k, '` reads|severity high: key')
 WHEN 2 THEN concat('`run_', k, '` runs|"second" helps|`v_', k, '` holds size|no name here|', chr(39), 'Loader', chr(39), ' does it|"/v1/items" GET|', word, '|plain ', k, '|old hash')
 ELSE '' END AS items FROM an""")
def r6(spark, sf):
    return _answers(spark, sf).select("file", F.array_join(answers.list_items("raw"), "|").alias("items"))


@query("r7_quality_score", AN + "SELECT file, CAST(CASE WHEN a = 1 THEN s ELSE 0 END AS INT) AS score FROM an WHERE a <> 0")
def r7(spark, sf):
    rows = answers.parse_json(_answers(spark, sf)).filter("parsed_from = 'text'")
    return rows.select("file", answers.quality_score(F.col("raw")).alias("score"))


def _structured(spark, sf):
    return answers.structured(_answers(spark, sf))


@query("r8_strengths", AN + """SELECT file, CASE a WHEN 0 THEN 'fast|small' WHEN 1 THEN concat('clear ', k, '|short') ELSE '' END AS strengths,
 CASE a WHEN 1 THEN 'no tests' ELSE '' END AS weaknesses FROM an""")
def r8(spark, sf):
    return _structured(spark, sf).select(
        "file", F.array_join("code_quality.strengths", "|").alias("strengths"),
        F.array_join("code_quality.weaknesses", "|").alias("weaknesses"))


@query("r9_named_items", AN + """SELECT file, CASE a WHEN 2 THEN concat('v_', k, '|unknown|Loader') ELSE '' END AS variables,
 CASE a WHEN 0 THEN concat('f', k) WHEN 2 THEN concat('run_', k, '|second|v_', k, '|unknown|Loader') ELSE '' END AS functions,
 CAST(CASE a WHEN 0 THEN s WHEN 2 THEN s ELSE 0 END AS INT) AS function_count,
 CASE a WHEN 2 THEN 'Loader' ELSE '' END AS classes, CAST(CASE a WHEN 2 THEN 3 ELSE 0 END AS INT) AS class_count,
 CASE a WHEN 2 THEN '/v1/items|unknown|unknown' ELSE '' END AS apis FROM an""")
def r9(spark, sf):
    names = lambda c: F.coalesce(F.array_join(F.transform(c, lambda v: v["name"]), "|"), F.lit(""))
    return _structured(spark, sf).select(
        "file", names("variables.important_variables").alias("variables"),
        names("functions.important_functions").alias("functions"), F.col("functions.count").alias("function_count"),
        names("classes.important_classes").alias("classes"), F.coalesce("classes.count", F.lit(0)).alias("class_count"),
        names("external_communications.apis").alias("apis"))


@query("r10_security_summary", AN + f"""SELECT file, CASE a WHEN 0 THEN concat('Filter rows:filter|', word, ':', {KIND}) WHEN 2 THEN concat(word, ':', {KIND}, '|plain ', k, ':other') ELSE '' END AS steps,
 CASE a WHEN 0 THEN concat('v', s) WHEN 1 THEN 'severity high: key' WHEN 2 THEN 'old hash' ELSE '' END AS vulnerabilities,
 CASE a WHEN 0 THEN 'medium' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity,
 CASE a WHEN 0 THEN concat('Loads ', k, '.') WHEN 1 THEN concat('Loads ', k, '.') WHEN 2 THEN concat('All fine ', k, '.') ELSE 'No summary available.' END AS summary FROM an""")
def r10(spark, sf):
    return _structured(spark, sf).select(
        "file", F.array_join(F.transform("data_transformations", lambda t: F.concat_ws(":", t["description"], t["type"])), "|").alias("steps"),
        F.array_join("security.vulnerabilities", "|").alias("vulnerabilities"), "security.severity", "summary")


R11_ORACLE = "SELECT doc_id, CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + f" THEN '{kind}'" for kind, words in fv.TRANSFORMATION_KINDS
) + " ELSE 'other' END AS kind FROM documents"


@query("r11_transformation_kind", R11_ORACLE)
def r11(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", answers.transformation_kind(F.col("text")).alias("kind"))


@query("r4_enhanced_answers", PF + """SELECT path AS file, CASE WHEN has THEN language END AS language, name AS file_name,
 CASE WHEN has AND m = 0 THEN 'flask|numpy' WHEN has AND m = 1 THEN 'react' END AS frameworks FROM lg""")
def r4_enhanced(spark, sf):
    return answers.enhanced(_structured(spark, sf), _files(spark, sf)).select(
        "file", "language", "file_name", F.array_join("frameworks", "|").alias("frameworks"))


# repeated keys and NaN are read, single quotes and a missing brace are not
LENIENT = """CASE p_partkey % 4 WHEN 0 THEN concat(chr(123), '"summary": "old", "summary": "new ', p_partkey, '"', chr(125))
 WHEN 1 THEN concat(chr(123), '"loss": NaN, "summary": "nan ', p_partkey, '"', chr(125))
 WHEN 2 THEN concat(chr(123), chr(39), 'summary', chr(39), ': 1', chr(125)) ELSE concat(chr(123), '"summary": "cut"') END"""


@query("r4_lenient_json", """SELECT p_partkey AS k, CASE WHEN p_partkey % 4 < 2 THEN 'json' ELSE 'text' END AS parsed_from,
 CASE p_partkey % 4 WHEN 0 THEN concat('new ', p_partkey) WHEN 1 THEN concat('nan ', p_partkey) END AS summary FROM part""")
def r4_lenient(spark, sf):
    raw = spark.read.parquet(f"{sf}/part.parquet").selectExpr("p_partkey AS k", f"{LENIENT} AS raw")
    return answers.parse_json(raw).select("k", "parsed_from", "answer.summary")


# members of another type than asked for
OFF_TYPE = r"""CASE p_partkey % 4 WHEN 0 THEN concat('{"code_quality": {"score": ', p_size, '.5, "strengths": "clear ', p_partkey, '"}, "summary": ["a", "b"]}')
 WHEN 1 THEN concat('{"functions": {"count": "', p_size, '", "important_functions": ["f', p_partkey, '", {"name": "g", "parameters": "x"}]}}')
 WHEN 2 THEN concat('{"code_quality": {"score": "high", "strengths": ["a", ', p_size, ', {"x":1}]}, "functions": {"important_functions": {"name": "h"}}, "summary": 7}')
 ELSE '{"functions": ["a"], "code_quality": "good", "summary": null}' END"""


@query("r4_off_type_members", """SELECT p_partkey AS k, CAST(CASE WHEN p_partkey % 4 = 0 THEN p_size ELSE -1 END AS INT) AS score,
 CASE p_partkey % 4 WHEN 0 THEN concat('clear ', p_partkey) WHEN 2 THEN concat('a|', p_size, '|{"x":1}') ELSE '' END AS strengths,
 CAST(CASE WHEN p_partkey % 4 = 1 THEN p_size ELSE -1 END AS INT) AS count,
 CASE p_partkey % 4 WHEN 1 THEN concat('f', p_partkey, '|g:x') WHEN 2 THEN 'h' ELSE '' END AS functions,
 CASE p_partkey % 4 WHEN 0 THEN '["a","b"]' WHEN 2 THEN '7' ELSE '' END AS summary FROM part""")
def r4_off_type(spark, sf):
    raw = spark.read.parquet(f"{sf}/part.parquet").selectExpr("p_partkey AS k", f"{OFF_TYPE} AS raw")
    joined = lambda c: F.coalesce(F.array_join(c, "|"), F.lit(""))
    return answers.parse_json(raw).select(
        "k", F.coalesce("answer.code_quality.score", F.lit(-1)).alias("score"), joined("answer.code_quality.strengths").alias("strengths"),
        F.coalesce("answer.functions.count", F.lit(-1)).alias("count"),
        joined(F.transform("answer.functions.important_functions", lambda f: F.concat_ws(":", f["name"], F.array_join(f["parameters"], ",")))).alias("functions"),
        F.coalesce("answer.summary", F.lit("")).alias("summary"))


# --- lineage graph and export -----------------------------------------------------------------
def _analyses(spark, sf):
    """Answers about files that were read, with the file's language; a query computes only the columns it reads."""
    known = project.detect_language(project.read_files(_files(spark, sf))).select(F.col("path").alias("file"), "language")
    return _structured(spark, sf).join(known, "file")


def written_structures(spark, sf):
    """Structures of all projects, written once."""
    return written(
        spark, ("project_structures", sf),
        lambda: project_lineage.project_structures(corpora.project_answers(spark, sf), _files(spark, sf)), "project", redistribute=True)


@query("r13_project_result", PA + f"""SELECT pa.project, md5({corpora.PROJECT_ANSWER}) AS raw_digest, is_json AS has_time, is_json AS has_stats,
 CASE WHEN is_json THEN concat('web ', pa.k) ELSE 'Unknown' END AS project_type,
 (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM lg WHERE has AND lg.project = pa.project) c) AS files_with_language FROM pa""")
def r13_result(spark, sf):
    rows = project_lineage.project_results(written_structures(spark, sf))
    n = F.aggregate(F.map_values("language_stats"), F.lit(0).cast("long"), lambda x, y: x + y)
    time = F.coalesce(F.col("project_structure.analysis_timestamp").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$"), F.lit(False))
    return rows.select(
        "project", F.md5("raw_response").alias("raw_digest"), time.alias("has_time"),
        F.col("project_structure.file_stats").isNotNull().alias("has_stats"), "project_structure.project_type", n.alias("files_with_language"))


def _graph(spark, sf):
    return project_lineage.graph_nodes(written_structures(spark, sf), _analyses(spark, sf))


GN = PA + """, fl AS (SELECT path AS file, language, name FROM lg WHERE has), js AS (SELECT * FROM pa WHERE is_json),
 raw_nodes AS (
 SELECT project, 0 AS sec, 0 AS i, -1 AS j, 'project_root' AS id, CASE WHEN is_json THEN concat('web ', k) ELSE 'Unknown' END AS label, 'project' AS type, 30 AS size, NULL AS purpose, NULL AS description, NULL AS language, NULL AS dep_type FROM pa
 UNION ALL SELECT pa.project, 5, rank - 1, -1, concat('dependency_', rank - 1), dependency, 'dependency', 8, 'Unknown', NULL, NULL, CASE WHEN is_json THEN 'library' ELSE 'Unknown' END
   FROM pa JOIN dr ON dr.project = pa.project WHERE rank <= CASE WHEN NOT is_json THEN 10 WHEN x % 2 = 1 THEN 0 ELSE 20 END
 UNION ALL SELECT project, 1, 0, -1, 'component_0', 'core', 'component', 20, 'main', NULL, NULL, NULL FROM js
 UNION ALL SELECT project, 1, 0, 0, NULL, name, 'file', 10, NULL, NULL, language, NULL FROM js JOIN fl ON file = first_file
 UNION ALL SELECT project, 1, 1, -1, 'component_1', 'Component 1', 'component', 20, '', NULL, NULL, NULL FROM js
 UNION ALL SELECT project, 1, 1, 0, NULL, name, 'file', 10, NULL, NULL, language, NULL FROM js JOIN fl ON file = last_file
 UNION ALL SELECT project, 2, unnest([0, 1, 2]), -1, unnest(['source_0', 'source_1', 'source_2']), unnest(['s3', 'db', 'Source 2']), 'data_source', 15, NULL, NULL, NULL, NULL FROM js WHERE x % 5 <> 0
 UNION ALL SELECT project, 3, unnest([0, 1]), -1, unnest(['transform_0', 'transform_1']), unnest(['clean', 'agg']), 'data_transformation', 12, NULL, unnest(['', 'sum it']), NULL, NULL FROM js WHERE x % 4 <> 0
 UNION ALL SELECT project, 4, unnest([0, 1]), -1, unnest(['sink_0', 'sink_1']), unnest(['lake', 'mart']), 'data_sink', 15, NULL, NULL, NULL, NULL FROM js
 UNION ALL SELECT project, 5, unnest([0, 1]), -1, unnest(['dependency_0', 'dependency_1']), unnest(['flask', 'numpy']), 'dependency', 8, unnest(['web', '']), NULL, NULL, unnest(['framework', 'library']) FROM js WHERE x % 2 = 1),
 gn AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY sec, i, j) - 1 AS idx FROM raw_nodes),
 byid AS (SELECT project, coalesce(id, concat('file_', idx)) AS id, idx, sec, i FROM gn),
 ge AS (SELECT project, 0 AS src, idx AS dst, CASE sec WHEN 1 THEN 'contains' WHEN 2 THEN 'data_input' ELSE 'depends_on' END AS type, sec FROM gn WHERE sec IN (1, 2, 5) AND j = -1
 UNION ALL SELECT f.project, c.idx, f.idx, 'contains', 1 FROM gn f JOIN byid c ON c.project = f.project AND c.id = concat('component_', f.i) WHERE f.j >= 0
 UNION ALL SELECT t.project, coalesce(p.idx, s.idx), t.idx, 'data_flow', 3 FROM gn t LEFT JOIN byid p ON p.project = t.project AND p.id = concat('transform_', t.i - 1)
   LEFT JOIN byid s ON s.project = t.project AND s.id = 'source_0' WHERE t.sec = 3 AND coalesce(p.idx, s.idx) IS NOT NULL
 UNION ALL SELECT t.project, coalesce(p.idx, s.idx), t.idx, 'data_flow', 4 FROM gn t LEFT JOIN byid p ON p.project = t.project AND p.id = 'transform_1'
   LEFT JOIN byid s ON s.project = t.project AND s.id = 'source_0' WHERE t.sec = 4 AND coalesce(p.idx, s.idx) IS NOT NULL)
"""
EDGE = "SELECT project, CAST(src AS INT) AS source_index, CAST(dst AS INT) AS target_index, type FROM ge"
NODE_COLUMNS = "label, type, CAST(size AS INT) AS size, purpose, description, language, dep_type"


@query("g5_project_vertices", GN + f"SELECT project, {NODE_COLUMNS} FROM gn")
def g5(spark, sf):
    return project_lineage.node_table(_graph(spark, sf)).drop("node_index", "id")


@query("g6_component_files", GN + "SELECT project, label, language FROM gn WHERE type = 'file'")
def g6(spark, sf):
    return _graph(spark, sf).filter("type = 'file'").select("project", "label", "language")


@query("g7_project_edges", GN + EDGE)
def g7(spark, sf):
    return project_lineage.containment_edges(_graph(spark, sf))


@query("g8_transformation_chain", GN + EDGE + " WHERE sec = 3")
def g8(spark, sf):
    return project_lineage.transformation_edges(_graph(spark, sf))


@query("g9_sink_edges", GN + EDGE + " WHERE sec = 4")
def g9(spark, sf):
    return project_lineage.sink_edges(_graph(spark, sf))


@query("g10_node_index", GN + "SELECT project, CAST(idx AS INT) AS node_index, coalesce(id, concat('file_', idx)) AS id, label FROM gn")
def g10(spark, sf):
    return project_lineage.node_table(_graph(spark, sf)).select("project", "node_index", "id", "label")


@query("g11_graph_metadata", PA + f"""SELECT project, project_type, main_languages, coalesce(architecture, 'Unknown') AS architecture, summary FROM ({STRUCTURE}) s""")
def g11(spark, sf):
    return project_lineage.graph_metadata(written_structures(spark, sf)).withColumn(
        "main_languages", F.array_join("main_languages", "|"))


# every eleventh analysis failed: it is counted, but has no record
EXPORT = f"""SELECT s.project, 'header' AS record, NULL AS file, s.project_type AS type, coalesce(s.architecture, 'Unknown') AS architecture, CAST(s.n_components AS BIGINT) AS n_components, f.total_files,
 coalesce(n, 0) AS total_files_analyzed, dependencies, NULL AS language, s.summary, NULL AS functions FROM ({STRUCTURE}) s
 JOIN (SELECT project, count(*) AS total_files FROM pf GROUP BY project) f ON f.project = s.project
 LEFT JOIN (SELECT project, count(*) AS n FROM pf WHERE has GROUP BY project) a ON a.project = s.project
 UNION ALL SELECT project, 'file', path, NULL, NULL, 0, 0, 0, NULL, language,
 CASE k % 4 WHEN 0 THEN concat('Loads ', k, '.') WHEN 1 THEN concat('Loads ', k, '.') WHEN 2 THEN concat('All fine ', k, '.') ELSE 'No summary available.' END,
 CASE k % 4 WHEN 0 THEN concat('f', k) WHEN 2 THEN concat('run_', k, '|second|v_', k, '|unknown|Loader') ELSE '' END FROM lg WHERE has AND k % 11 <> 3"""


def _export(spark, sf):
    failed = F.when(F.col("seq") % 11 == 3, F.lit("Error during LLM analysis: timeout"))
    errors = _answers(spark, sf).select("file", failed.alias("error"))
    return project_lineage.lineage_export(written_structures(spark, sf), _analyses(spark, sf).join(errors, "file"))


HEADER_SHAPE = """struct<project: struct<type: string, architecture: string, summary: string>, components: array<struct<name: string>>,
 dependencies: array<struct<name: string, purpose: string, type: string>>,
 metadata: struct<total_files_analyzed: bigint, file_stats: struct<total_files: bigint>>>""".replace("\n", " ")
FILE_SHAPE = "struct<file_path: string, language: string, summary: string, functions: array<struct<name: string>>>"


def _records(export):
    h, f = F.col("h"), F.col("f")
    joined = lambda array, part: F.array_join(F.transform(array, part), "|")
    count = lambda c: F.when(F.col("record") == "header", c).otherwise(0).cast("bigint")
    return export.select(
        "project", "record", "file", F.when(F.col("record") == "header", F.from_json("document", HEADER_SHAPE)).alias("h"),
        F.when(F.col("record") == "file", F.from_json("document", FILE_SHAPE)).alias("f")).select(
        "project", "record", F.coalesce(f["file_path"], "file").alias("file"), h["project"]["type"].alias("type"),
        h["project"]["architecture"].alias("architecture"), count(F.size(h["components"])).alias("n_components"),
        count(h["metadata"]["file_stats"]["total_files"]).alias("total_files"),
        count(h["metadata"]["total_files_analyzed"]).alias("total_files_analyzed"),
        joined(h["dependencies"], lambda d: F.concat_ws("/", d["name"], d["purpose"], d["type"])).alias("dependencies"),
        f["language"].alias("language"), F.coalesce(f["summary"], h["project"]["summary"]).alias("summary"),
        joined(f["functions"], lambda x: x["name"]).alias("functions"))


@query("r14_lineage_export", PA + EXPORT)
def r14(spark, sf):
    return _records(_export(spark, sf))


@query("s8_lineage_documents", PA + f"SELECT project, record, file, functions, summary FROM ({EXPORT}) e")
def s8(spark, sf):
    folder = run_folder(spark, "lineage_documents", sf)
    reports.write_lineage(_export(spark, sf), folder)
    rows = _records(spark.read.schema("project string, record string, file string, document string").json(folder))
    return rows.select("project", "record", "file", "functions", "summary")


# the lines of each document as they were written: head, entries in the order of the listing, tail
DOCUMENT_LINES = f""", e AS ({EXPORT}), o AS (SELECT path, k FROM lg),
 n AS (SELECT project, count(*) FILTER (WHERE record = 'file') AS files FROM e GROUP BY project)
 SELECT project, CAST(0 AS BIGINT) AS line, 'head' AS record, NULL AS file, type, architecture, n_components, dependencies, NULL AS language, summary, NULL AS functions,
   0 AS total_files, 0 AS total_files_analyzed FROM e WHERE record = 'header'
 UNION ALL SELECT project, row_number() OVER (PARTITION BY project ORDER BY k), 'entry', file, NULL, NULL, 0, NULL, language, e.summary, functions, 0, 0
   FROM e JOIN o ON o.path = e.file WHERE record = 'file'
 UNION ALL SELECT e.project, files + 1, 'tail', NULL, NULL, NULL, 0, NULL, NULL, NULL, NULL, total_files, total_files_analyzed
   FROM e JOIN n ON n.project = e.project WHERE record = 'header'"""


def _documents(spark, sf):
    """Folder of the written documents."""
    failed = F.when(F.col("seq") % 11 == 3, F.lit("Error during LLM analysis: timeout"))
    errors = _answers(spark, sf).select("file", failed.alias("error"))
    pieces = documents.lineage_pieces(written_structures(spark, sf), _analyses(spark, sf).join(errors, "file"))
    folder = run_folder(spark, "whole_documents", sf)
    documents.write_documents(spark, pieces, folder, run_folder(spark, "document_pieces", sf), lines_per_file=1000)
    return folder


@query("s8_whole_documents", PA.rstrip() + DOCUMENT_LINES)
def s8_whole(spark, sf):
    rows = documents.lines(spark, _documents(spark, sf))
    text = F.col("text")
    record = F.when(text.startswith("]"), "tail").when(F.col("line") == 0, "head").otherwise("entry")
    # the lines as objects of their own
    whole = F.when(record == "head", F.concat(text, F.lit("]}"))).when(
        record == "tail", F.concat(F.lit('{"x":['), text)).otherwise(F.regexp_replace(text, "^,", ""))
    rows = rows.select("project", F.col("line").cast("bigint").alias("line"), record.alias("record"), whole.alias("whole")).select(
        "project", "line", "record", F.from_json("whole", HEADER_SHAPE).alias("h"), F.from_json("whole", FILE_SHAPE).alias("f"))
    h, f, joined = F.col("h"), F.col("f"), lambda array, part: F.array_join(F.transform(array, part), "|")
    only = lambda kind, c: F.when(F.col("record") == kind, c)
    number = lambda kind, c: F.coalesce(only(kind, c), F.lit(0)).cast("bigint")
    return rows.select(
        "project", "line", "record", f["file_path"].alias("file"), h["project"]["type"].alias("type"), h["project"]["architecture"].alias("architecture"),
        number("head", F.size(h["components"])).alias("n_components"),
        joined(h["dependencies"], lambda d: F.concat_ws("/", d["name"], d["purpose"], d["type"])).alias("dependencies"),
        f["language"].alias("language"), F.coalesce(f["summary"], h["project"]["summary"]).alias("summary"),
        joined(f["functions"], lambda x: x["name"]).alias("functions"),
        number("tail", h["metadata"]["file_stats"]["total_files"]).alias("total_files"),
        number("tail", h["metadata"]["total_files_analyzed"]).alias("total_files_analyzed"))


@query("s8_document_parts", PA + f"""SELECT project, true AS contiguous, CAST(2 + count(*) FILTER (WHERE record = 'file') AS BIGINT) AS lines
 FROM ({EXPORT}) e GROUP BY project""")
def s8_parts(spark, sf):
    """The manifest: parts follow each other without a gap, and together are the document's lines."""
    folder = _documents(spark, sf)
    parts = documents.parts(spark, folder).groupBy("project").agg(
        (F.sum("bytes") == F.max(F.col("first_byte") + F.col("bytes"))).alias("contiguous"), F.sum("bytes").alias("bytes"))
    written = documents.lines(spark, folder).groupBy("project").agg(F.count("*").alias("lines"), F.sum(F.octet_length("text") + 1).alias("chars"))
    return parts.join(written, "project").select("project", (F.col("contiguous") & (F.col("bytes") == F.col("chars"))).alias("contiguous"), "lines")
