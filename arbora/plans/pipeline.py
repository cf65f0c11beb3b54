"""Queries of the general training-data operators (problems 1, 2 and 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arbora.operators import heavy_keys, hierarchy
from arbora.plans.registry import Registry
from arbora.session import fresh_path
from arbora.sources.tables import table
from arbora.streaming import capture

R = Registry()

_LINKS = """WITH RECURSIVE link AS (
  SELECT target AS child, min(source) AS parent FROM edges
  WHERE lower(trim(kind)) = 'contains' AND source IS NOT NULL AND target IS NOT NULL GROUP BY target),
node AS (SELECT child AS id FROM link UNION SELECT parent FROM link),
up AS (
  SELECT id AS node_id, id AS cur, 0 AS steps, [id] AS seen, false AS looped FROM node
  UNION ALL
  SELECT u.node_id, l.parent, u.steps + 1, list_append(u.seen, l.parent), list_contains(u.seen, l.parent)
  FROM up u JOIN link l ON l.child = u.cur WHERE NOT u.looped),
top AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY steps DESC) AS rn FROM up),
found AS (
  SELECT node_id,
    CASE WHEN looped THEN (SELECT min(x) FROM (SELECT unnest(list_slice(seen, list_position(seen, cur), len(seen))) AS x)) ELSE cur END AS root_id,
    CASE WHEN looped THEN -1 ELSE steps END AS depth, looped, seen
  FROM top WHERE rn = 1)
"""


@R.add("p1_found", _LINKS + "SELECT node_id, root_id, CAST(depth AS INTEGER) AS depth FROM found")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.forest(hierarchy.contains_links(table(spark, sf_dir, "edges")))


@R.add("p1_hierarchy", _LINKS + """, below AS (
  SELECT unnest(list_slice(seen, 2, len(seen))) AS node_id FROM found WHERE NOT looped),
n AS (SELECT node_id, count(*) AS n FROM below GROUP BY node_id)
SELECT f.node_id, root_id, CAST(depth AS INTEGER) AS depth,
  CASE WHEN looped THEN NULL ELSE list_aggregate(list_reverse(seen), 'string_agg', ' > ') END AS path,
  CAST(coalesce(n.n, 0) AS BIGINT) AS n_descendants
FROM found f LEFT JOIN n ON n.node_id = f.node_id""")
def p1_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.hierarchy(hierarchy.contains_links(table(spark, sf_dir, "edges")))


@R.add("p1_descendants", _LINKS + """
SELECT unnest(list_slice(seen, 2, len(seen))) AS ancestor_id, node_id,
       CAST(unnest(range(1, len(seen))) AS INTEGER) AS distance FROM found WHERE NOT looped""")
def p1_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.descendants(hierarchy.forest(hierarchy.contains_links(table(spark, sf_dir, "edges")), paths=True))


@R.add("p2_found", """WITH seen AS (
  SELECT path, content_hash, row_number() OVER (PARTITION BY path ORDER BY scanned_at DESC, scan_id DESC) AS rn FROM file_scans WHERE path IS NOT NULL),
owned AS (
  SELECT f.path, f.content_hash, f.indexed_at, (SELECT max_by(r.status, r.started_at) FROM sync_runs r WHERE r.started_at <= f.indexed_at) AS status FROM files f),
had AS (
  SELECT path, content_hash, row_number() OVER (PARTITION BY path ORDER BY indexed_at DESC, lower(trim(content_hash)) DESC) AS rn FROM owned WHERE status = 'ok')
SELECT s.path FROM seen s LEFT JOIN had h ON h.path = s.path AND h.rn = 1
WHERE s.rn = 1 AND s.content_hash IS NOT NULL
  AND (h.path IS NULL OR regexp_replace(lower(trim(h.content_hash)), '^(sha-?256[:=]|0x)', '') <> regexp_replace(lower(trim(s.content_hash)), '^(sha-?256[:=]|0x)', ''))""")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = capture.changed_paths(spark, table(spark, sf_dir, "file_scans"), table(spark, sf_dir, "files"),
                                 table(spark, sf_dir, "sync_runs"), fresh_path(spark, "capture"))
    return rows.select("path")


@R.add("p4_found", """SELECT target, lower(trim(kind)) AS kind FROM edges GROUP BY 1, 2
HAVING count(*) >= 0.01 * (SELECT count(*) FROM edges)""")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy_keys.heavy_keys(table(spark, sf_dir, "edges")).select("target", "kind")


@R.add("p4_per_key", """SELECT target, lower(trim(kind)) AS kind, count(*) AS n_rows, count(DISTINCT source) AS n_sources,
  count(line) AS n_lines, min(line) AS first_line, max(line) AS last_line FROM edges GROUP BY 1, 2""")
def p4_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy_keys.per_target_kind(table(spark, sf_dir, "edges"))
