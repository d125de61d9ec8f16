"""Query of the secret scan."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.llm import secrets
from corpuslens.llm.queries import query
from corpuslens.llm.staging import table

_Q = lambda s: s.replace("'", "''")


def _spans(order: int, rule: secrets.Rule) -> str:
    """SQL: spans of one rule from the pieces between its matches."""
    checked = f"length(regexp_extract(m[i], '{_Q(rule.pattern)}', {rule.group})) >= {rule.least}"
    return f"""SELECT r, {order} AS o, '{rule.kind}' AS kind, b, b + length(x) AS e FROM (
 SELECT r, m[i] AS x, m, i, list_sum(list_transform(p[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0) AS b
 FROM (SELECT r, m, p, unnest(range(1, len(m) + 1)) AS i FROM (SELECT r, regexp_extract_all(t, '{_Q(rule.pattern)}') AS m,
   regexp_split_to_array(t, '{_Q(rule.pattern)}') AS p FROM d WHERE regexp_matches(t, '{_Q(rule.pattern)}')))) WHERE {checked}"""


_JOIN = "string_agg(concat(kind, ':', CAST(b AS BIGINT), ':', CAST(e AS BIGINT)), ',' ORDER BY b, o)"
ORACLE = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
 s AS ({' UNION ALL '.join(_spans(i, rule) for i, rule in enumerate(secrets.RULES))}),
 g AS (SELECT r, count_if(o = 0) AS n_assign, count_if(o = 1) AS n_access, count_if(o = 2) AS n_hex,
   {_JOIN} FILTER (WHERE o < 3) AS base, {_JOIN} AS spans FROM s GROUP BY r)
 SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access,
   CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
 FROM d LEFT JOIN g USING (r)"""


@query("op1_secret_scan", ORACLE)
def op1(spark, sf):
    """Documents are the versions, the path is the doc_id; they arrive in two batches.

    The second batch finds the ledger of the first: of its texts only those are scanned that
    the first did not hold.
    """
    documents = table(spark, sf, "documents")
    late = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1
    first, ledger = secrets.scan_versions(spark, documents.filter(~late), path="doc_id")
    second, _ = secrets.scan_versions(spark, documents.filter(late), ledger=ledger, path="doc_id")
    found = first.unionByName(second)
    is_base = lambda f: f["kind"].isin([r.kind for r in secrets.BASE_RULES])
    n = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long")
    spans = lambda c: F.array_join(F.transform(c, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")
    return found.select(
        F.col("path").alias("doc_id"), n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(spans(F.filter("findings", is_base)).cast("binary"), 256).alias("base_sha256"), spans(F.col("findings")).alias("spans"))
