"""Queries of the near-duplicate operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pustaka.llm.near_duplicates import similar_groups, similar_pairs
from pustaka.session import read


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_pairs(read(spark, sf_dir, "submissions")).toDF("submission_id_a", "submission_id_b")


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(read(spark, sf_dir, "submissions")).withColumnRenamed("id", "submission_id")


QUERIES = {"p2_found": p2_found, "p2_groups": p2_groups}

_PAIRS = r"""
WITH RECURSIVE s AS (SELECT submission_id AS id, list_sort(list_distinct(regexp_extract_all(lower(question), '[\p{L}\p{N}]+'))) AS w FROM submissions WHERE question IS NOT NULL),
d AS (SELECT id, w, len(w) AS n FROM s WHERE len(w) >= 10),
df AS (SELECT t, count(*) AS c FROM (SELECT unnest(w) AS t FROM d) GROUP BY t),
r AS (SELECT id, n, u.t, row_number() OVER (PARTITION BY id ORDER BY df.c, u.t) AS k FROM (SELECT id, n, unnest(w) AS t FROM d) u JOIN df USING (t)),
p AS (SELECT id, n, t FROM r WHERE k <= n - (4 * n + 4) // 5 + 1),
c AS (SELECT DISTINCT a.id AS ia, b.id AS ib FROM p a JOIN p b ON a.t = b.t AND a.id < b.id AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
f AS (SELECT ia, ib, a.w = b.w AS same, b.w AS wb, a.w AS wa FROM c JOIN d a ON a.id = ia JOIN d b ON b.id = ib WHERE 9 * len(list_intersect(a.w, b.w)) >= 4 * (a.n + b.n))"""

ORACLE = {
    "p2_found": _PAIRS + " SELECT ia AS submission_id_a, ib AS submission_id_b FROM f",
    "p2_groups": _PAIRS
    + """, e AS (SELECT ia AS x, ib AS y, same, wb AS w FROM f UNION ALL SELECT ib, ia, same, wa FROM f),
g AS (SELECT id AS x, id AS y FROM d UNION SELECT g.x, e.y FROM g JOIN e ON g.y = e.x),
m AS (SELECT x, min(y) AS group_id FROM g GROUP BY x), l AS (SELECT x, count(DISTINCT w) FILTER (NOT same) AS n_links FROM e GROUP BY x)
SELECT m.x AS submission_id, group_id, coalesce(n_links, 0) AS n_links FROM m LEFT JOIN l USING (x)""",
}
