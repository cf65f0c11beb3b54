"""Queries of incremental maintenance and of extraction from texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbora.extract import frameworks, imports, languages, symbols
from arbora.operators import store
from arbora.operators.graph import file_dependencies
from arbora.plans import sample_sources
from arbora.plans.graph_queries import _CHANGED, E_SQL, F_SQL, N_SQL, changed, edges, files, nodes, refs
from arbora.plans.registry import Registry
from arbora.session import fresh_path
from arbora.sources.tables import norm_hash, table
from arbora.streaming import changes, sync

R = Registry()
_HASH = "regexp_replace(lower(trim({c})), '^(sha-?256[:=]|0x)', '')"
SEEN_SQL = f"""seen AS (SELECT path, modified_at, size, {_HASH.format(c='content_hash')} AS content_hash FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY scanned_at DESC, scan_id DESC) AS rn FROM file_scans) WHERE rn = 1 AND content_hash IS NOT NULL)"""


def seen(s: SparkSession, d: str) -> DataFrame:
    newest = table(s, d, "file_scans").groupBy("path").agg(F.max(F.struct("scanned_at", "scan_id", "modified_at", "size", "content_hash")).alias("r")).filter("r.content_hash IS NOT NULL")
    return newest.select("path", "r.modified_at", "r.size", norm_hash(F.col("r.content_hash")).alias("content_hash"))


@R.add("change_detect", f"""WITH {F_SQL}, {SEEN_SQL} SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'removed'
 WHEN a.modified_at IS DISTINCT FROM b.modified_at OR (a.size IS DISTINCT FROM b.size AND a.content_hash IS DISTINCT FROM {_HASH.format(c='b.content_hash')}) THEN 'modified' ELSE 'unchanged' END AS action FROM seen a FULL JOIN f b ON a.path = b.path""")
def change_detect(s: SparkSession, d: str) -> DataFrame:
    return changes.detect(seen(s, d), files(s, d).withColumn("content_hash", norm_hash()))


_ACTION = "CASE WHEN event_type = 'view' THEN 'added' WHEN event_type IN ('click', 'signup') THEN 'modified' WHEN event_type = 'error' THEN 'removed' END"
_COALESCED = f"""SELECT path, CASE max(r) WHEN 3 THEN 'removed' WHEN 2 THEN 'modified' ELSE 'added' END AS action, count(*) AS n FROM (SELECT CAST(user_id AS VARCHAR) AS path,
 CASE {_ACTION} WHEN 'removed' THEN 3 WHEN 'modified' THEN 2 WHEN 'added' THEN 1 END AS r FROM events) WHERE r IS NOT NULL GROUP BY 1"""
R.add("coalesce_events", _COALESCED)(lambda s, d: changes.coalesce(changes.file_events(table(s, d, "events"))))
R.add("stream_coalesce", _COALESCED)(lambda s, d: changes.stream_coalesced(s, f"{d}/events*.parquet", fresh_path(s, "stream")))
R.add("debounce_sessions", """WITH a AS (SELECT CAST(user_id AS VARCHAR) AS path, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
 b AS (SELECT *, sum(CASE WHEN before IS NULL OR epoch_us(ts) - epoch_us(before) > 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS burst FROM a)
 SELECT path, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM b GROUP BY path, burst""")(
    lambda s, d: changes.debounce(changes.file_events(table(s, d, "events")), 3600))


_SCOPED = """WITH {base}, {c}, dep AS (SELECT DISTINCT a.file_path AS path FROM e JOIN n a ON a.id = e.source JOIN n b ON b.id = e.target WHERE b.file_path IN (SELECT path FROM c) AND a.file_path <> b.file_path)
 SELECT DISTINCT id FROM unresolved_refs WHERE (SELECT count(*) FROM c) >= greatest(1, floor((SELECT count(DISTINCT path) FROM files) / 10)) OR file_path IN (SELECT path FROM c) OR file_path IN (SELECT path FROM dep) OR reference_name IN (SELECT name FROM n WHERE file_path IN (SELECT path FROM c))"""
_FEW = "c AS (SELECT path FROM f WHERE ('0x' || substr(md5(path), 1, 7))::BIGINT % 50 = 0)"


def _scoped(s: SparkSession, d: str, c: DataFrame) -> DataFrame:
    dep = file_dependencies(edges(s, d), nodes(s, d), None).join(c.withColumnRenamed("path", "dst"), "dst", "left_semi").select(F.col("src").alias("path"))
    n_files = table(s, d, "files").agg(F.count_distinct("path").alias("n")).scalar()
    return changes.scoped_refs(refs(s, d), c, dep, nodes(s, d), n_files)


R.add("scoped_refs", _SCOPED.format(base=f"{N_SQL}, {E_SQL}", c=_CHANGED))(lambda s, d: _scoped(s, d, changed(s, d)))
# One file in fifty has changed: below the tenth from which all references count.
R.add("scoped_refs_few", _SCOPED.format(base=f"{N_SQL}, {E_SQL}, {F_SQL}", c=_FEW))(
    lambda s, d: _scoped(s, d, files(s, d).filter("CAST(conv(substr(md5(path), 1, 7), 16, 10) AS BIGINT) % 50 = 0").select("path")))
R.add("metadata_upsert", """SELECT key, value FROM (SELECT lower(trim(status)) AS key, CAST(run_id AS VARCHAR) AS value, row_number() OVER (PARTITION BY lower(trim(status)) ORDER BY started_at DESC, run_id DESC) AS rn FROM sync_runs
 WHERE status IS NOT NULL) WHERE rn = 1""")(lambda s, d: (lambda kv: store.upsert(kv.filter("at < 0"), kv, "key", "at").select("key", "value"))(
    table(s, d, "sync_runs").filter("status IS NOT NULL").select(F.lower(F.trim("status")).alias("key"), F.col("run_id").cast("string").alias("value"), "started_at", "run_id")
    .groupBy("key", "started_at").agg(F.max("run_id").cast("string").alias("value")).withColumnRenamed("started_at", "at")))


R.add("upsert_latest", f"WITH {F_SQL} SELECT path, indexed_at, node_count FROM f")(lambda s, d: files(s, d).select("path", "indexed_at", "node_count"))
R.add("store_batch", """SELECT path, indexed_at, content_hash, node_count, NOT (before_path IS NOT NULL AND before_hash IS NOT DISTINCT FROM content_hash AND before_count IS NOT DISTINCT FROM node_count) AS written FROM (
 SELECT *, lag(path) OVER w AS before_path, lag(content_hash) OVER w AS before_hash, lag(node_count) OVER w AS before_count FROM (SELECT DISTINCT path, indexed_at, content_hash, node_count FROM files)
 WINDOW w AS (PARTITION BY path ORDER BY indexed_at, content_hash, node_count))""")(lambda s, d: changes.effective_writes(table(s, d, "files")))


@R.add("delete_cascade", f"""WITH {N_SQL}, {E_SQL}, {_CHANGED}, gone AS (SELECT id FROM n WHERE file_path IN (SELECT path FROM c))
 SELECT 'edge' AS sort, CAST(id AS VARCHAR) AS key FROM e WHERE coalesce(source, '') NOT IN (SELECT id FROM gone) AND coalesce(target, '') NOT IN (SELECT id FROM gone)
 UNION ALL SELECT 'node', id FROM n WHERE coalesce(file_path, '') NOT IN (SELECT path FROM c)
 UNION ALL SELECT 'ref', CAST(id AS VARCHAR) FROM unresolved_refs WHERE coalesce(from_node_id, '') NOT IN (SELECT id FROM gone) AND coalesce(file_path, '') NOT IN (SELECT path FROM c)""")
def delete_cascade(s: SparkSession, d: str) -> DataFrame:
    n, e, _, r = store.delete_files(changed(s, d), nodes(s, d), edges(s, d), files(s, d), refs(s, d))
    part = lambda df, name: df.select(F.lit(name).alias("sort"), F.col("id").cast("string").alias("key"))
    return part(n, "node").unionByName(part(e, "edge")).unionByName(part(r, "ref"))


_LANGS = "CASE lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in languages.ENDINGS.items()) + " END"
R.add("detect_language", f"SELECT DISTINCT path, {_LANGS} AS detected FROM files")(lambda s, d: table(s, d, "files").select("path").distinct().withColumn("detected", languages.language(F.col("path"))))
R.add("config_files", "SELECT DISTINCT path, regexp_matches(path, '(/Cargo\\.toml|/package\\.json|/pyproject\\.toml|/setup\\.py|/requirements\\.txt|\\.csproj)$') OR regexp_matches(path, '/(tsconfig|jsconfig)[^/]*$') AS is_config FROM files")(
    lambda s, d: table(s, d, "files").select("path").distinct().withColumn("is_config", languages.is_config_file(F.col("path"))))
_JS = """SELECT DISTINCT path, unnest(regexp_extract_all(text, 'from\\s+["'']([^"'']+)["'']', 1)) AS module FROM documents WHERE regexp_matches(path, '\\.(m?[jt]s|[jt]sx)$') AND text IS NOT NULL"""
R.add("script_imports", _JS)(lambda s, d: imports.script_imports(table(s, d, "documents")))
R.add("python_imports", "SELECT DISTINCT path, unnest(regexp_extract_all(text, '(?m)^(?:from|import)\\s+([\\w.]+)', 1)) AS module FROM documents WHERE path LIKE '%.py' AND text IS NOT NULL")(
    lambda s, d: imports.python_imports(table(s, d, "documents")))
R.add("go_imports", "SELECT DISTINCT path, unnest(regexp_extract_all(text, '(?m)^import\\s+\"([^\"]+)\"', 1)) AS module FROM documents WHERE path LIKE '%.go' AND text IS NOT NULL")(
    lambda s, d: imports.go_imports(table(s, d, "documents")))
_PROBES = ", ".join(f"{{'place': {i}, 'tail': '{x}'}}" for i, x in enumerate(imports.PROBES))
#: Every script file imports the next one of its folder, with its ending and without.
_NEXT = """i AS (SELECT path, unnest(['./' || regexp_extract(nxt, '[^/]*$'), './' || regexp_replace(regexp_extract(nxt, '[^/]*$'), '\\.[^.]*$', ''), '../' || regexp_extract(folder, '[^/]*$') || '/' || regexp_extract(nxt, '[^/]*$')]) AS module, folder FROM (
 SELECT path, regexp_replace(path, '/[^/]*$', '') AS folder, lead(path) OVER (PARTITION BY regexp_replace(path, '/[^/]*$', '') ORDER BY path) AS nxt FROM (SELECT DISTINCT path FROM files WHERE regexp_matches(path, '\\.(m?[jt]s|[jt]sx)$'))) WHERE nxt IS NOT NULL)"""


def _next_imports(s: SparkSession, d: str) -> DataFrame:
    folder, base = F.regexp_replace("path", r"/[^/]*$", ""), F.regexp_extract("nxt", r"[^/]*$", 0)
    scripts = table(s, d, "files").filter(F.col("path").rlike(r"\.(m?[jt]s|[jt]sx)$")).select("path").distinct().withColumn("folder", folder)
    pairs = scripts.withColumn("nxt", F.lead("path").over(Window.partitionBy("folder").orderBy("path"))).filter("nxt IS NOT NULL")
    return pairs.select("path", F.explode(F.array(F.concat(F.lit("./"), base), F.concat(F.lit("./"), F.regexp_replace(base, r"\.[^.]*$", "")),
                                                  F.concat(F.lit("../"), F.regexp_extract("folder", r"[^/]*$", 0), F.lit("/"), base))).alias("module"))


R.add("import_probe", f"""WITH {_NEXT}, t AS (SELECT path, module, folder, unnest([{_PROBES}]) AS p FROM i),
 h AS (SELECT path, module, CASE WHEN module LIKE './%' THEN folder || substr(module, 2) ELSE regexp_replace(folder, '/[^/]*$', '') || substr(module, 3) END || p.tail AS target, p.place AS place FROM t)
 SELECT path, module, target FROM (SELECT *, row_number() OVER (PARTITION BY path, module ORDER BY place) AS rn FROM h WHERE target IN (SELECT path FROM files)) WHERE rn = 1""")(
    lambda s, d: imports.probe(_next_imports(s, d), table(s, d, "files")))
R.add("extract_symbols")(lambda s, d: symbols.extracted(table(s, d, "documents")))


def _with_samples(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("path", "text").unionByName(s.createDataFrame(sample_sources.SOURCES, "path string, text string"))


# The documents hold no framework code: what comes out are the rows of the sample texts.
R.add("extract_declarations", sample_sources.values(sample_sources.DECLARATIONS, "file_path, line, kind, name, framework"))(lambda s, d: frameworks.extracted_declarations(_with_samples(s, d)))
R.add("extract_routes", sample_sources.values(sample_sources.ROUTES, "file_path, line, verb, path, handler, framework"))(
    lambda s, d: frameworks.extracted_routes(_with_samples(s, d)).drop("route_id"))


@R.add("sync_cycle", f"""WITH {F_SQL}, {SEEN_SQL}, diff AS (SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'removed'
  WHEN a.modified_at IS DISTINCT FROM b.modified_at OR (a.size IS DISTINCT FROM b.size AND a.content_hash IS DISTINCT FROM {_HASH.format(c='b.content_hash')}) THEN 'modified' ELSE 'unchanged' END AS action FROM seen a FULL JOIN f b ON a.path = b.path)
 SELECT path, action, action <> 'removed' AS stored FROM diff""")
def sync_cycle(s: SparkSession, d: str) -> DataFrame:
    """Every path with its action and whether the index holds it after the cycle."""
    c = sync.cycle(seen(s, d), table(s, d, "documents").select("path", "text"), nodes(s, d), edges(s, d), files(s, d).withColumn("content_hash", norm_hash()), refs(s, d), 0)
    return c.diff.join(c.files.select("path", F.lit(True).alias("stored")).distinct(), "path", "left").select("path", "action", F.coalesce("stored", F.lit(False)).alias("stored"))
