"""Queries over the stored graph: catalogue, lookups, joins, traversals, rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbora.operators import graph as G
from arbora.plans.pipeline import _LINKS as LINKS_SQL
from arbora.plans.registry import Registry
from arbora.sources import tables as T

R = Registry()
NODE_COLS = ["id", "kind", "name", "qualified_name", "file_path", "language", "start_line", "end_line", "signature", "docstring", "is_exported", "is_async"]
N_SQL = f"n AS (SELECT DISTINCT {', '.join(NODE_COLS)} FROM nodes)"
E_SQL = "e AS (SELECT DISTINCT id, source, target, lower(trim(kind)) AS kind, line, col, provenance FROM edges)"
F_SQL = """f AS (SELECT path, content_hash, language, size, modified_at, indexed_at, node_count FROM (
  SELECT *, row_number() OVER (PARTITION BY path ORDER BY indexed_at DESC, content_hash DESC, node_count DESC, modified_at DESC, size DESC, language DESC) AS rn FROM files) WHERE rn = 1)"""
LANG = "regexp_replace(lower(trim(language)), '[^a-z0-9+#]', '', 'g')"
TEST_SQL = """(lower({p}) LIKE '%/\\_\\_tests\\_\\_/%' ESCAPE '\\' OR contains(lower({p}), '/tests/') OR contains(lower({p}), '/test/') OR contains(lower({p}), '/spec/')
  OR regexp_matches(lower(regexp_extract({p}, '[^/]*$')), '^test[_.]|\\.test\\.|\\.spec\\.|_test\\.go$'))"""
DEG_SQL = """deg AS (SELECT n.id, coalesce(i.c, 0) AS in_degree, coalesce(o.c, 0) AS out_degree, coalesce(i.c, 0) + coalesce(o.c, 0) AS degree FROM (SELECT DISTINCT id FROM nodes) n
  LEFT JOIN (SELECT target AS id, count(*) AS c FROM e GROUP BY 1) i ON i.id = n.id LEFT JOIN (SELECT source AS id, count(*) AS c FROM e GROUP BY 1) o ON o.id = n.id)"""


def nodes(s: SparkSession, d: str) -> DataFrame:
    return T.table(s, d, "nodes").select(*NODE_COLS).distinct()


def edges(s: SparkSession, d: str) -> DataFrame:
    return T.table(s, d, "edges").select("id", "source", "target", T.norm_kind().alias("kind"), "line", "col", "provenance").distinct()


def files(s: SparkSession, d: str) -> DataFrame:
    """The newest row of every path."""
    cols = ["indexed_at", "content_hash", "node_count", "modified_at", "size", "language"]
    return T.table(s, d, "files").groupBy("path").agg(F.max(F.struct(*cols)).alias("r")).select("path", "r.*")


def refs(s: SparkSession, d: str) -> DataFrame:
    return T.table(s, d, "unresolved_refs")


def count() -> F.Column:
    return F.count(F.lit(1)).alias("n")


#: Query nodes: those of all kinds whose id has a hash divisible by 50.
_ASKED = "('0x' || substr(md5({c}), 1, 7))::BIGINT % 50 = 0"


def seeds(s: SparkSession, d: str) -> DataFrame:
    """(seed): the query nodes."""
    return nodes(s, d).filter("CAST(conv(substr(md5(id), 1, 7), 16, 10) AS BIGINT) % 50 = 0").select(F.col("id").alias("seed"))


# ------------------------------------------------------------------ catalogue


@R.add("graph_stats", f"""WITH {N_SQL}, {E_SQL} SELECT (SELECT count(DISTINCT id) FROM nodes) AS n_nodes, (SELECT count(*) FROM e) AS n_edges,
 (SELECT count(DISTINCT path) FROM files) AS n_files, (SELECT count(*) FROM unresolved_refs) AS n_refs""")
def graph_stats(s: SparkSession, d: str) -> DataFrame:
    parts = [("n_nodes", T.table(s, d, "nodes").agg(F.countDistinct("id").alias("v"))), ("n_edges", edges(s, d).agg(F.count(F.lit(1)).alias("v"))),
             ("n_files", T.table(s, d, "files").agg(F.countDistinct("path").alias("v"))), ("n_refs", refs(s, d).agg(F.count(F.lit(1)).alias("v")))]
    rows = None
    for name, df in parts:
        one = df.select(F.lit(name).alias("k"), "v")
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy().pivot("k", [p[0] for p in parts]).agg(F.first("v"))


R.add("nodes_by_kind", f"WITH {N_SQL} SELECT kind, count(*) AS n FROM n GROUP BY 1")(lambda s, d: nodes(s, d).groupBy("kind").agg(count()))
R.add("edges_by_kind", f"WITH {E_SQL} SELECT kind, count(*) AS n FROM e GROUP BY 1")(lambda s, d: edges(s, d).groupBy("kind").agg(count()))
R.add("files_by_language", f"WITH {F_SQL} SELECT {LANG} AS language, count(*) AS n FROM f GROUP BY 1")(
    lambda s, d: files(s, d).groupBy(T.norm_language().alias("language")).agg(count()))
R.add("distinct_names", "SELECT DISTINCT name FROM nodes")(lambda s, d: T.table(s, d, "nodes").select("name").distinct())


def _clusters(depth: int):
    def run(s: SparkSession, d: str) -> DataFrame:
        parts = F.split("path", "/")
        key = F.array_join(F.slice(parts, 1, F.least(F.lit(depth + 1), F.size(parts) - 1)), "/")
        return files(s, d).groupBy(key.alias("cluster")).agg(
            F.sum("node_count").alias("n_nodes"), count(), F.array_join(F.sort_array(F.collect_set(T.norm_language())), ",").alias("languages"))

    return run


for _d in (2, 3):
    R.add(f"clusters_depth{_d}", f"""WITH {F_SQL} SELECT array_to_string(list_slice(string_split(path, '/'), 1, least({_d + 1}, len(string_split(path, '/')) - 1)), '/') AS cluster,
 sum(node_count)::BIGINT AS n_nodes, count(*) AS n, array_to_string(list_sort(list(DISTINCT {LANG})), ',') AS languages FROM f GROUP BY 1""")(_clusters(_d))


@R.add("stats_merged", f"""WITH {N_SQL}, {E_SQL}, {F_SQL} SELECT 'node' AS section, kind AS key, count(*) AS n FROM n GROUP BY kind UNION ALL SELECT 'edge', kind, count(*) FROM e GROUP BY kind
 UNION ALL SELECT 'file', {LANG}, count(*) FROM f GROUP BY 2""")
def stats_merged(s: SparkSession, d: str) -> DataFrame:
    part = lambda df, name, key: df.groupBy(key.alias("key")).agg(count()).select(F.lit(name).alias("section"), "key", "n")
    return part(nodes(s, d), "node", F.col("kind")).unionByName(part(edges(s, d), "edge", F.col("kind"))).unionByName(part(files(s, d), "file", T.norm_language()))


R.add("files_grouped", f"WITH {F_SQL} SELECT {LANG} AS language, path, node_count FROM f")(
    lambda s, d: files(s, d).select(T.norm_language().alias("language"), "path", "node_count"))
R.add("stale_files", f"WITH {F_SQL} SELECT path, modified_at, row_number() OVER (PARTITION BY {LANG} ORDER BY modified_at, path) AS place FROM f")(
    lambda s, d: files(s, d).withColumn("place", F.row_number().over(Window.partitionBy(T.norm_language()).orderBy("modified_at", "path"))).select("path", "modified_at", "place"))
R.add("index_health", f"""WITH {F_SQL} SELECT count(*) > 0 AS non_empty, max(indexed_at) AS newest, max(indexed_at) < (SELECT max(scanned_at) FROM file_scans) - 86400000 AS stale FROM f""")(
    lambda s, d: files(s, d).agg((F.count(F.lit(1)) > 0).alias("non_empty"), F.max("indexed_at").alias("newest")).withColumn(
        "stale", F.col("newest") < T.table(s, d, "file_scans").agg(F.max("scanned_at")).scalar() - 86_400_000))

# ------------------------------------------------------------------ lookups and predicates

R.add("node_by_id", f"WITH {N_SQL} SELECT id, kind, name FROM n WHERE id = (SELECT min(id) FROM nodes WHERE kind = 'function')")(
    lambda s, d: nodes(s, d).join(T.table(s, d, "nodes").filter("kind = 'function'").agg(F.min("id").alias("id")), "id", "left_semi").select("id", "kind", "name"))
R.add("nodes_by_ids", f"WITH {N_SQL} SELECT id, kind, name FROM n WHERE id IN (SELECT from_node_id FROM unresolved_refs)")(
    lambda s, d: nodes(s, d).join(refs(s, d).select(F.col("from_node_id").alias("id")), "id", "left_semi").select("id", "kind", "name"))
R.add("ids_exist", "SELECT DISTINCT from_node_id AS id, from_node_id IN (SELECT id FROM nodes) AS present FROM unresolved_refs")(
    lambda s, d: refs(s, d).select(F.col("from_node_id").alias("id")).distinct().join(
        T.table(s, d, "nodes").select("id", F.lit(True).alias("p")).distinct(), "id", "left").select("id", F.coalesce("p", F.lit(False)).alias("present")))
R.add("nodes_by_file", f"WITH {N_SQL} SELECT file_path, id, row_number() OVER (PARTITION BY file_path ORDER BY start_line, id) AS place FROM n WHERE kind <> 'file'")(
    lambda s, d: nodes(s, d).filter("kind <> 'file'").withColumn("place", F.row_number().over(Window.partitionBy("file_path").orderBy("start_line", "id"))).select("file_path", "id", "place"))
R.add("nodes_by_kind_list", f"WITH {N_SQL} SELECT id, name FROM n WHERE kind IN ('class', 'struct')")(
    lambda s, d: nodes(s, d).filter(F.col("kind").isin("class", "struct")).select("id", "name"))
R.add("nodes_by_lower_name", f"WITH {N_SQL} SELECT r.id AS ref_id, min(n.id) AS id, count(*) AS bearers FROM unresolved_refs r JOIN n ON lower(n.name) = lower(r.reference_name) GROUP BY 1")(
    lambda s, d: refs(s, d).select(F.col("id").alias("ref_id"), F.lower("reference_name").alias("k")).join(
        nodes(s, d).groupBy(F.lower("name").alias("k")).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("bearers")), "k").select("ref_id", "id", "bearers"))
#: Paths as they are, and in the forms that tests have.
_FORMS = """CASE substr(md5(path), 1, 1) WHEN '0' THEN replace(path, '/src/', '/spec/') WHEN '1' THEN replace(path, '.', '_test.') WHEN '2' THEN replace(path, '.', 'Tests.') WHEN '3' THEN replace(path, '.', '.spec.')
 WHEN '4' THEN replace(replace(path, '/src/', '/__tests__/'), '/', '\\') WHEN '5' THEN replace(path, '.', 'Test.') ELSE path END"""
R.add("is_test_path_wide", f"""SELECT p AS path, regexp_matches(regexp_extract(l, '[^/]*$'), '^test[_.]|\\.(test|spec)\\.|_test\\.|(test\\.java|tests\\.cs|test\\.go)$') OR regexp_matches(l, '/(__tests__|tests|test|spec)/') AS is_test
 FROM (SELECT p, lower(replace(p, '\\', '/')) AS l FROM (SELECT DISTINCT {_FORMS} AS p FROM files WHERE path IS NOT NULL))""")(
    lambda s, d: T.table(s, d, "files").filter("path IS NOT NULL").selectExpr(_FORMS.replace("\\", "\\\\") + " AS path").distinct().withColumn("is_test", G.is_test_path_wide("path")))
R.add("nodes_by_qualified_name", f"WITH {N_SQL}, q AS (SELECT DISTINCT qualified_name FROM n WHERE kind = 'method') SELECT q.qualified_name, n.id, n.kind FROM q JOIN n ON n.qualified_name = q.qualified_name")(
    lambda s, d: nodes(s, d).filter("kind = 'method'").select("qualified_name").distinct().join(nodes(s, d).select("qualified_name", "id", "kind"), "qualified_name"))
R.add("exact_name_multi", f"""WITH {N_SQL}, q AS (SELECT DISTINCT lower(reference_name) AS k FROM unresolved_refs)
 SELECT k, id FROM (SELECT q.k, n.id, row_number() OVER (PARTITION BY q.k ORDER BY n.name, n.id) AS rn FROM q JOIN n ON lower(n.name) = q.k WHERE n.kind IN ('function', 'method', 'class')) WHERE rn <= 20""")(
    lambda s, d: refs(s, d).select(F.lower("reference_name").alias("k")).distinct().join(
        nodes(s, d).filter(F.col("kind").isin("function", "method", "class")).withColumn("k", F.lower("name")), "k").withColumn(
        "rn", F.row_number().over(Window.partitionBy("k").orderBy("name", "id"))).filter("rn <= 20").select("k", "id"))
R.add("filter_scan", f"WITH {N_SQL} SELECT id, name, 1.0::DOUBLE AS score FROM n WHERE kind IN ('function', 'method') AND {LANG} IN ('go', 'rust')")(
    lambda s, d: nodes(s, d).filter(F.col("kind").isin("function", "method") & T.norm_language().isin("go", "rust")).select("id", "name", F.lit(1.0).alias("score")))
R.add("file_list_prefix", f"WITH {F_SQL} SELECT path FROM f WHERE {LANG} = 'python' AND starts_with(path, '/w/orrery-core/')")(
    lambda s, d: files(s, d).filter((T.norm_language() == "python") & F.col("path").startswith("/w/orrery-core/")).select("path"))
R.add("file_list_contains", f"WITH {F_SQL} SELECT path FROM f WHERE contains(path, '/vendor')")(lambda s, d: files(s, d).filter(F.col("path").contains("/vendor")).select("path"))


def glob_regex(glob: str) -> str:
    """An anchored regular expression for ``*`` and ``?``; everything else is literal."""
    import re

    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob.lower()) + "$"


R.add("file_glob", f"WITH {F_SQL} SELECT path, len(string_split(path, '/')) - 1 AS depth FROM f WHERE regexp_matches(lower(path), '^.*/src/.*_.*\\.p.$')")(
    lambda s, d: files(s, d).filter(F.lower("path").rlike(glob_regex("*/src/*_*.p?"))).select("path", (F.size(F.split("path", "/")) - 1).cast("long").alias("depth")))
R.add("refs_keyset", "SELECT id, reference_name FROM unresolved_refs WHERE id > 100 ORDER BY id LIMIT 50")(
    lambda s, d: refs(s, d).filter("id > 100").orderBy("id").limit(50).select("id", "reference_name"))
R.add("refs_offset", "SELECT id, reference_name FROM unresolved_refs ORDER BY id LIMIT 50 OFFSET 25")(
    lambda s, d: refs(s, d).orderBy("id").offset(25).limit(50).select("id", "reference_name"))
R.add("refs_by_file", "SELECT file_path, count(*) AS n, count(DISTINCT reference_name) AS names FROM unresolved_refs GROUP BY 1")(
    lambda s, d: refs(s, d).groupBy("file_path").agg(count(), F.countDistinct("reference_name").alias("names")))
R.add("is_test_file", f"SELECT DISTINCT path, {TEST_SQL.format(p='path')} AS is_test FROM files")(
    lambda s, d: T.table(s, d, "files").select("path").distinct().withColumn("is_test", G.is_test_path("path")))
R.add("qualified_symbols", r"SELECT id, regexp_matches(reference_name, '^\S*\w(::|->|\.|/|#|\\)\w\S*$') AS qualified FROM unresolved_refs")(
    lambda s, d: refs(s, d).select("id", F.col("reference_name").rlike(r"^\S*\w(::|->|\.|/|#|\\)\w\S*$").alias("qualified")))
R.add("relative_paths", "SELECT DISTINCT path, regexp_replace(path, '^/w/[^/]+/', '') AS rel FROM files")(
    lambda s, d: T.table(s, d, "files").select("path").distinct().withColumn("rel", F.regexp_replace("path", "^/w/[^/]+/", "")))
R.add("code_slice", """WITH n AS (SELECT DISTINCT id, file_path, start_line, end_line FROM nodes WHERE kind IN ('function', 'method')),
 d AS (SELECT path, string_split(text, chr(10)) AS rows FROM documents WHERE path IS NOT NULL AND text IS NOT NULL)
 SELECT n.id, md5(array_to_string(list_slice(d.rows, n.start_line, n.end_line), chr(10))) AS code_md5 FROM n JOIN d ON d.path = n.file_path WHERE n.start_line <= len(d.rows)""")(
    lambda s, d: nodes(s, d).filter(F.col("kind").isin("function", "method")).select("id", "file_path", "start_line", "end_line").join(
        T.table(s, d, "documents").filter("path IS NOT NULL AND text IS NOT NULL").select(F.col("path").alias("file_path"), F.split("text", "\n").alias("rows")), "file_path").filter(
        "start_line <= size(rows)").select("id", F.md5(F.array_join(F.slice("rows", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")).alias("code_md5")))

# ------------------------------------------------------------------ joins


R.add("out_edges", f"WITH {N_SQL}, {E_SQL} SELECT e.id, e.target, e.kind FROM e WHERE e.source IN (SELECT id FROM n WHERE kind = 'class') AND e.kind IN ('calls', 'extends')")(
    lambda s, d: edges(s, d).filter(F.col("kind").isin("calls", "extends")).join(nodes(s, d).filter("kind = 'class'").select(F.col("id").alias("source")), "source", "left_semi").select("id", "target", "kind"))
R.add("in_edges", f"WITH {N_SQL}, {E_SQL} SELECT e.id, e.source, e.kind FROM e WHERE e.target IN (SELECT id FROM n WHERE kind = 'struct')")(
    lambda s, d: edges(s, d).join(nodes(s, d).filter("kind = 'struct'").select(F.col("id").alias("target")), "target", "left_semi").select("id", "source", "kind"))
R.add("edges_between", f"WITH {N_SQL}, {E_SQL}, k AS (SELECT id FROM n WHERE kind IN ('class', 'struct')) SELECT id, source, target, kind FROM e WHERE source IN (SELECT id FROM k) AND target IN (SELECT id FROM k)")(
    lambda s, d: (lambda k: edges(s, d).join(k.withColumnRenamed("id", "source"), "source", "left_semi").join(k.withColumnRenamed("id", "target"), "target", "left_semi").select("id", "source", "target", "kind"))(
        nodes(s, d).filter(F.col("kind").isin("class", "struct")).select("id")))
R.add("orphan_edges", f"WITH {E_SQL} SELECT id, source, target FROM e WHERE source NOT IN (SELECT id FROM nodes) OR target NOT IN (SELECT id FROM nodes)")(
    lambda s, d: (lambda k: edges(s, d).join(k.select(F.col("id").alias("source"), F.lit(1).alias("a")), "source", "left").join(k.select(F.col("id").alias("target"), F.lit(1).alias("b")), "target", "left").filter(
        "a IS NULL OR b IS NULL").select("id", "source", "target"))(T.table(s, d, "nodes").select("id").distinct()))
R.add("node_degree", f"WITH {E_SQL}, {DEG_SQL} SELECT id, in_degree, out_degree, degree FROM deg")(lambda s, d: G.degrees(nodes(s, d), edges(s, d)))
_CHANGED = "c AS (SELECT DISTINCT path FROM file_scans WHERE content_hash IS NULL)"


def changed(s: SparkSession, d: str) -> DataFrame:
    return T.table(s, d, "file_scans").filter("content_hash IS NULL").select("path").distinct()


R.add("dependent_files", f"""WITH {N_SQL}, {E_SQL}, {_CHANGED} SELECT DISTINCT a.file_path AS path FROM e JOIN n a ON a.id = e.source JOIN n b ON b.id = e.target
 WHERE b.file_path IN (SELECT path FROM c) AND a.file_path NOT IN (SELECT path FROM c)""")(
    lambda s, d: G.file_dependencies(edges(s, d), nodes(s, d), None).join(changed(s, d).withColumnRenamed("path", "dst"), "dst", "left_semi").join(
        changed(s, d).withColumnRenamed("path", "src"), "src", "left_anti").select(F.col("src").alias("path")).distinct())


@R.add("affected_nodes", f"""WITH {N_SQL}, {E_SQL}, {_CHANGED}, direct AS (SELECT id FROM n WHERE file_path IN (SELECT path FROM c))
 SELECT id, max(direct) AS direct FROM (SELECT id, true AS direct FROM direct UNION ALL SELECT e.source, false FROM e WHERE e.target IN (SELECT id FROM direct) AND e.source IN (SELECT id FROM n)) GROUP BY id""")
def affected_nodes(s: SparkSession, d: str) -> DataFrame:
    n, e = nodes(s, d), edges(s, d)
    direct = n.join(changed(s, d).withColumnRenamed("path", "file_path"), "file_path", "left_semi").select("id").distinct()
    near = e.join(direct.withColumnRenamed("id", "target"), "target", "left_semi").select(F.col("source").alias("id")).join(n.select("id"), "id", "left_semi")
    return direct.withColumn("direct", F.lit(True)).unionByName(near.withColumn("direct", F.lit(False))).groupBy("id").agg(F.max("direct").alias("direct"))


def _oracle(name: str, kinds: str, src: str, dst: str):
    """For each name: the names at the other end of edges of these kinds, ranked by degree, first eight."""
    listed = tuple(k.strip("' ") for k in kinds.split(","))

    def run(s: SparkSession, d: str) -> DataFrame:
        n, e = nodes(s, d), edges(s, d)
        deg = G.degrees(n, e).select("id", "degree")
        a = n.filter("kind <> 'file'").select(F.col("id").alias("a_id"), F.col("name").alias("symbol"))
        b = n.filter("kind <> 'file'").select("id", "name", "file_path").join(deg, "id")
        j = e.filter(F.col("kind").isin(*listed)).select(F.col(src).alias("id"), F.col(dst).alias("a_id")).distinct().join(a, "a_id").join(b, "id").filter("name <> symbol")
        j = j.select("symbol", "name", "file_path", "id", "degree").distinct()
        w = Window.partitionBy("symbol").orderBy(F.desc("degree"), "name", "file_path", "id")
        return j.withColumn("place", F.row_number().over(w)).filter("place <= 8").select("symbol", "id", "place")

    R.add(name, f"""WITH {N_SQL}, {E_SQL}, {DEG_SQL}, j AS (SELECT DISTINCT a.name AS symbol, b.name, b.file_path, b.id, deg.degree FROM e JOIN n a ON a.id = e.{dst} JOIN n b ON b.id = e.{src} JOIN deg ON deg.id = b.id
 WHERE e.kind IN ({kinds}) AND a.kind <> 'file' AND b.kind <> 'file' AND a.name <> b.name)
 SELECT symbol, id, place FROM (SELECT symbol, id, row_number() OVER (PARTITION BY symbol ORDER BY degree DESC, name, file_path, id) AS place FROM j) WHERE place <= 8""")(run)


_oracle("top_callers_of_name", "'calls', 'references', 'imports'", "source", "target")
_oracle("top_callees_of_name", "'calls', 'references', 'imports'", "target", "source")
_oracle("top_implementers_of_name", "'implements', 'extends'", "source", "target")
R.add("locate_names", f"""WITH {N_SQL}, {E_SQL}, {DEG_SQL} SELECT name, id, place FROM (SELECT n.name, n.id, row_number() OVER (PARTITION BY n.name ORDER BY deg.degree DESC, n.file_path, n.id) AS place
 FROM n JOIN deg ON deg.id = n.id WHERE n.kind <> 'file') WHERE place <= 8""")(
    lambda s, d: nodes(s, d).filter("kind <> 'file'").select("id", "name", "file_path").join(G.degrees(nodes(s, d), edges(s, d)), "id").withColumn(
        "place", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("degree"), "file_path", "id"))).filter("place <= 8").select("name", "id", "place"))

# ------------------------------------------------------------------ traversals


def _reach_sql(step: str, depth: int, seed: str = f"SELECT id AS seed FROM n WHERE {_ASKED.format(c='id')}", known: bool = True) -> str:
    here = " AND dst IN (SELECT id FROM n)" if known else ""
    return f"""WITH RECURSIVE {N_SQL}, {E_SQL}, step AS (SELECT DISTINCT src, dst FROM ({step}) WHERE src IS NOT NULL AND dst IS NOT NULL{here}),
 r(seed, node, depth) AS (SELECT seed, seed, 0 FROM ({seed}) UNION SELECT r.seed, step.dst, r.depth + 1 FROM r JOIN step ON step.src = r.node WHERE r.depth < {depth})
 SELECT seed, node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY 1, 2"""


_OUT, _IN = "SELECT source AS src, target AS dst FROM e", "SELECT target AS src, source AS dst FROM e"
_USE = " WHERE kind IN ('calls', 'references', 'imports')"


def _add_reach(name: str, direction: str, kinds: tuple[str, ...] | None, depth: int) -> None:
    where = f" WHERE kind IN ({', '.join(repr(k) for k in kinds)})" if kinds else ""
    step = {"out": _OUT + where, "in": _IN + where, "both": f"{_OUT}{where} UNION {_IN}{where}"}[direction]

    def run(s: SparkSession, d: str) -> DataFrame:
        n = nodes(s, d)
        return G.reach(G.arcs(edges(s, d), direction, kinds), seeds(s, d), depth, n)

    R.add(name, _reach_sql(step, depth))(run)


_add_reach("bfs_out_2", "out", None, 2)
_add_reach("bfs_both_2", "both", None, 2)
_add_reach("bfs_contains_4", "out", ("contains",), 4)
_add_reach("callers_khop", "in", G.USE_KINDS, 2)
_add_reach("callees_khop", "out", G.USE_KINDS, 2)
_add_reach("impact_http_3", "in", None, 3)
_add_reach("neighborhood", "both", ("calls", "references", "extends", "implements"), 2)
_add_reach("dfs_reach", "out", ("contains", "calls"), 3)


def _one_hop(name: str, src: str, dst: str, kinds: tuple[str, ...] | None) -> None:
    where = f" WHERE e.kind IN ({', '.join(repr(k) for k in kinds)})" if kinds else ""

    def run(s: SparkSession, d: str) -> DataFrame:
        e = edges(s, d)
        e = e.filter(F.col("kind").isin(*kinds)) if kinds else e
        n = T.table(s, d, "nodes").select("id").distinct()
        return e.select(F.col(src).alias("seed"), F.col(dst).alias("node"), F.col("id").alias("edge_id"), "kind").join(
            n.withColumnRenamed("id", "node"), "node", "left_semi").join(n.withColumnRenamed("id", "seed"), "seed", "left_semi").select("seed", "node", "edge_id", "kind")

    R.add(name, f"WITH {E_SQL}, k AS (SELECT DISTINCT id FROM nodes) SELECT e.{src} AS seed, e.{dst} AS node, e.id AS edge_id, e.kind FROM e JOIN k a ON a.id = e.{src} JOIN k b ON b.id = e.{dst}{where}")(run)


_one_hop("callers_1hop", "target", "source", G.USE_KINDS)
_one_hop("callees_1hop", "source", "target", G.USE_KINDS)
_one_hop("find_usages", "target", "source", None)
_one_hop("children", "source", "target", ("contains",))


@R.add("impact_radius_2", f"""WITH RECURSIVE {N_SQL}, {E_SQL}, k AS (SELECT DISTINCT id FROM n), box AS (SELECT id FROM n WHERE kind IN ('class', 'interface', 'struct', 'trait', 'module', 'enum')),
 step AS (SELECT DISTINCT target AS src, source AS dst, 1 AS cost FROM e WHERE source IN (SELECT id FROM k)
  UNION SELECT DISTINCT source, target, 0 FROM e WHERE kind = 'contains' AND source IN (SELECT id FROM box) AND target IN (SELECT id FROM k)),
 r(seed, node, depth) AS (SELECT id, id, 0 FROM n WHERE {_ASKED.format(c='id')} UNION SELECT r.seed, step.dst, r.depth + step.cost FROM r JOIN step ON step.src = r.node WHERE r.depth + step.cost <= 2)
 SELECT seed, node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY 1, 2""")
def impact_radius_2(s: SparkSession, d: str) -> DataFrame:
    return G.impact(edges(s, d), nodes(s, d), seeds(s, d), 2)


@R.add("type_hierarchy", f"""WITH RECURSIVE {N_SQL}, {E_SQL}, step AS (SELECT DISTINCT source AS src, target AS dst FROM e WHERE kind IN ('extends', 'implements') AND target IN (SELECT id FROM n)),
 back AS (SELECT DISTINCT target AS src, source AS dst FROM e WHERE kind IN ('extends', 'implements') AND source IN (SELECT id FROM n)),
 u(seed, node) AS (SELECT id, id FROM n WHERE {_ASKED.format(c='id')} UNION SELECT u.seed, step.dst FROM u JOIN step ON step.src = u.node),
 v(seed, node) AS (SELECT id, id FROM n WHERE {_ASKED.format(c='id')} UNION SELECT v.seed, back.dst FROM v JOIN back ON back.src = v.node)
 SELECT seed, node, 'above' AS side FROM u WHERE seed <> node UNION ALL SELECT seed, node, 'below' FROM v WHERE seed <> node""")
def type_hierarchy(s: SparkSession, d: str) -> DataFrame:
    n, e, kinds = nodes(s, d), edges(s, d), ("extends", "implements")
    side = lambda way, name: G.reach(G.arcs(e, way, kinds), seeds(s, d), None, n).filter("seed <> node").select("seed", "node", F.lit(name).alias("side"))
    return side("out", "above").unionByName(side("in", "below"))


@R.add("ancestors", LINKS_SQL + "SELECT node_id AS node, unnest(list_slice(seen, 2, len(seen))) AS ancestor FROM found WHERE NOT looped")
def ancestors(s: SparkSession, d: str) -> DataFrame:
    """The containment chain above every node; none for nodes on or below a cycle."""
    from arbora.operators import hierarchy as H

    return H.descendants(H.forest(H.contains_links(edges(s, d)), paths=True)).select(F.col("node_id").alias("node"), F.col("ancestor_id").alias("ancestor"))


@R.add("sibling_anchors", f"""WITH {N_SQL}, {E_SQL}, link AS (SELECT target AS child, min(source) AS parent FROM e WHERE kind = 'contains' GROUP BY 1)
 SELECT seed, id, place FROM (SELECT a.child AS seed, b.child AS id, row_number() OVER (PARTITION BY a.child ORDER BY n.start_line, n.id) AS place
 FROM link a JOIN link b ON a.parent = b.parent AND a.child <> b.child JOIN n ON n.id = b.child WHERE a.child IN (SELECT id FROM n WHERE kind = 'method')) WHERE place <= 5""")
def sibling_anchors(s: SparkSession, d: str) -> DataFrame:
    """The first five other members of each method's container.

    Per container only its first six members can be anchors of any sibling, so the self join never emits
    all pairs of a large container.
    """
    n = nodes(s, d)
    link = edges(s, d).filter("kind = 'contains'").groupBy(F.col("target").alias("child")).agg(F.min("source").alias("parent"))
    member = link.join(n.select(F.col("id").alias("child"), "start_line", "kind"), "child")
    first = member.withColumn("r", F.row_number().over(Window.partitionBy("parent").orderBy("start_line", "child"))).filter("r <= 6").select("parent", F.col("child").alias("id"), "start_line")
    j = member.filter("kind = 'method'").select(F.col("child").alias("seed"), "parent").join(first, "parent").filter("seed <> id")
    return j.withColumn("place", F.row_number().over(Window.partitionBy("seed").orderBy("start_line", "id"))).filter("place <= 5").select("seed", "id", "place")


@R.add("shortest_path", f"""WITH RECURSIVE {N_SQL}, {E_SQL}, step AS (SELECT DISTINCT source AS src, target AS dst FROM e WHERE kind IN ('calls', 'references', 'contains') AND target IN (SELECT id FROM n)),
 pair AS (SELECT id AS seed, (SELECT target FROM e WHERE target IN (SELECT id FROM n) GROUP BY 1 ORDER BY count(*) DESC, target LIMIT 1) AS goal FROM n WHERE {_ASKED.format(c='id')}),
 r(seed, goal, node, path) AS (SELECT seed, goal, seed, [seed] FROM pair UNION SELECT r.seed, r.goal, step.dst, list_append(r.path, step.dst) FROM r JOIN step ON step.src = r.node WHERE len(r.path) <= 4 AND r.node <> r.goal),
 hit AS (SELECT *, row_number() OVER (PARTITION BY seed, goal ORDER BY len(path), path) AS rn FROM r WHERE node = goal)
 SELECT seed, goal, array_to_string(path, ' > ') AS path, CAST(len(path) - 1 AS INTEGER) AS length FROM hit WHERE rn = 1""")
def shortest_path(s: SparkSession, d: str) -> DataFrame:
    n = nodes(s, d)
    goal = edges(s, d).join(n.select(F.col("id").alias("target")), "target", "left_semi").groupBy("target").agg(count()).orderBy(F.desc("n"), "target").limit(1).select("target").scalar()
    pairs = seeds(s, d).select("seed", goal.alias("goal"))
    steps = G.arcs(edges(s, d), "out", ("calls", "references", "contains")).join(n.select(F.col("id").alias("dst")), "dst", "left_semi")
    return G.shortest_paths(steps, pairs, 4)


@R.add("connected_files", f"""WITH RECURSIVE {N_SQL}, {E_SQL}, p AS (SELECT DISTINCT a.file_path AS a, b.file_path AS b FROM e JOIN n a ON a.id = e.source JOIN n b ON b.id = e.target
  WHERE e.kind = 'renders' AND a.file_path <> b.file_path), both_ways AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
 r(node, other) AS (SELECT a, a FROM both_ways UNION SELECT r.node, both_ways.b FROM r JOIN both_ways ON both_ways.a = r.other) SELECT node, min(other) AS component FROM r GROUP BY 1""")
def connected_files(s: SparkSession, d: str) -> DataFrame:
    deps = G.file_dependencies(edges(s, d), nodes(s, d), ("renders",))
    return G.components(deps.select(F.col("src").alias("a"), F.col("dst").alias("b")))


@R.add("file_cycles", f"""WITH RECURSIVE {N_SQL}, {E_SQL}, p AS (SELECT DISTINCT a.file_path AS src, b.file_path AS dst FROM e JOIN n a ON a.id = e.source JOIN n b ON b.id = e.target
  WHERE e.kind = 'imports' AND a.file_path <> b.file_path), r(seed, node) AS (SELECT src, dst FROM p UNION SELECT r.seed, p.dst FROM r JOIN p ON p.src = r.node),
 m AS (SELECT a.seed, a.node FROM r a JOIN r b ON a.seed = b.node AND a.node = b.seed) SELECT seed AS node, least(min(node), seed) AS "group" FROM m GROUP BY seed""")
def file_cycles(s: SparkSession, d: str) -> DataFrame:
    return G.cyclic_groups(G.file_dependencies(edges(s, d), nodes(s, d), ("imports",)))


@R.add("file_graph", f"""WITH {N_SQL}, {E_SQL}, k AS (SELECT DISTINCT id FROM n), s AS (SELECT DISTINCT file_path AS seed, id FROM n WHERE file_path IS NOT NULL AND kind <> 'file')
 SELECT DISTINCT seed, e.id AS edge_id FROM s JOIN e ON (e.source = s.id) WHERE e.target IN (SELECT id FROM k)
 UNION SELECT DISTINCT seed, e.id FROM s JOIN e ON (e.target = s.id) WHERE e.source IN (SELECT id FROM k)""")
def file_graph(s: SparkSession, d: str) -> DataFrame:
    n, e = nodes(s, d), edges(s, d)
    f = n.filter("file_path IS NOT NULL AND kind <> 'file'").select("id", F.col("file_path").alias("seed")).distinct()
    k = n.select("id").distinct()
    one = lambda a, b: e.join(f.withColumnRenamed("id", a), a).join(k.withColumnRenamed("id", b), b, "left_semi").select("seed", F.col("id").alias("edge_id"))
    return one("source", "target").unionByName(one("target", "source")).distinct()


@R.add("bfs_tree_edges", f"""WITH RECURSIVE {N_SQL}, {E_SQL}, step AS (SELECT DISTINCT source AS src, target AS dst FROM e WHERE target IN (SELECT id FROM n)),
 r(seed, node, depth) AS (SELECT id, id, 0 FROM n WHERE {_ASKED.format(c='id')} UNION SELECT r.seed, step.dst, r.depth + 1 FROM r JOIN step ON step.src = r.node WHERE r.depth < 2),
 m AS (SELECT seed, node, min(depth) AS depth FROM r GROUP BY 1, 2)
 SELECT seed, node, edge_id FROM (SELECT m.seed, m.node, e.id AS edge_id, row_number() OVER (PARTITION BY m.seed, m.node ORDER BY CASE e.kind WHEN 'contains' THEN 0 WHEN 'calls' THEN 1 ELSE 2 END, e.id) AS rn
 FROM m JOIN e ON e.target = m.node JOIN m u ON u.seed = m.seed AND u.node = e.source AND u.depth = m.depth - 1 WHERE m.depth > 0) WHERE rn = 1""")
def bfs_tree_edges(s: SparkSession, d: str) -> DataFrame:
    n, e = nodes(s, d), edges(s, d)
    return G.tree_edges(e, G.reach(G.arcs(e, "out"), seeds(s, d), 2, n))


@R.add("connected_core", f"""WITH RECURSIVE {N_SQL}, {E_SQL}, step AS (SELECT DISTINCT src, dst FROM ({_OUT} UNION {_IN}) WHERE dst IN (SELECT id FROM n)),
 r(seed, node, depth) AS (SELECT id, id, 0 FROM n WHERE {_ASKED.format(c='id')} UNION SELECT r.seed, step.dst, r.depth + 1 FROM r JOIN step ON step.src = r.node WHERE r.depth < 2),
 m AS (SELECT seed, node, min(depth) AS depth FROM r GROUP BY 1, 2) SELECT seed, node, place FROM (SELECT seed, node, row_number() OVER (PARTITION BY seed ORDER BY depth, node) AS place FROM m) WHERE place <= 30""")
def connected_core(s: SparkSession, d: str) -> DataFrame:
    n = nodes(s, d)
    r = G.reach(G.arcs(edges(s, d), "both"), seeds(s, d), 2, n)
    return r.withColumn("place", F.row_number().over(Window.partitionBy("seed").orderBy("depth", "node"))).filter("place <= 30").select("seed", "node", "place")


@R.add("node_detail", f"""WITH {N_SQL}, {E_SQL}, {DEG_SQL} SELECT n.id, n.kind, n.name, deg.in_degree, deg.out_degree, coalesce(a.c, 0) AS callers, coalesce(b.c, 0) AS callees FROM n JOIN deg ON deg.id = n.id
 LEFT JOIN (SELECT target AS id, count(*) AS c FROM e WHERE kind = 'calls' GROUP BY 1) a ON a.id = n.id LEFT JOIN (SELECT source AS id, count(*) AS c FROM e WHERE kind = 'calls' GROUP BY 1) b ON b.id = n.id""")
def node_detail(s: SparkSession, d: str) -> DataFrame:
    n, e = nodes(s, d), edges(s, d)
    calls = G.degrees(n, e.filter("kind = 'calls'")).select("id", F.col("in_degree").alias("callers"), F.col("out_degree").alias("callees"))
    return n.select("id", "kind", "name").join(G.degrees(n, e).drop("degree"), "id").join(calls, "id")

# ------------------------------------------------------------------ rankings and families


def _top(metric: str):
    def run(s: SparkSession, d: str) -> DataFrame:
        return G.degrees(nodes(s, d), edges(s, d)).orderBy(F.desc(metric), "id").limit(50).select("id", F.col(metric).alias("score"))

    return run


for _m in ("degree", "in_degree", "out_degree"):
    R.add(f"top_nodes_{_m}", f"WITH {E_SQL}, {DEG_SQL} SELECT id, {_m} AS score FROM deg ORDER BY {_m} DESC, id LIMIT 50")(_top(_m))

_FAMILY = f"""fam AS (SELECT lower(n.name) AS symbol, n.id, deg.degree, row_number() OVER (PARTITION BY lower(n.name) ORDER BY n.name, n.id) AS rn FROM n JOIN deg ON deg.id = n.id WHERE n.kind IN ('function', 'method', 'class', 'struct')),
 family AS (SELECT symbol, id, degree FROM fam WHERE rn <= 32)"""


def family(s: SparkSession, d: str) -> DataFrame:
    """(symbol, id, degree): for each name, its first 32 bearers."""
    n = nodes(s, d).filter(F.col("kind").isin("function", "method", "class", "struct"))
    j = n.select("id", "name").join(G.degrees(nodes(s, d), edges(s, d)).select("id", "degree"), "id").withColumn("symbol", F.lower("name"))
    return j.withColumn("rn", F.row_number().over(Window.partitionBy("symbol").orderBy("name", "id"))).filter("rn <= 32").select("symbol", "id", "degree")


R.add("symbol_family", f"WITH {N_SQL}, {E_SQL}, {DEG_SQL}, {_FAMILY} SELECT symbol, id, row_number() OVER (PARTITION BY symbol ORDER BY degree DESC, id) AS place, count(*) OVER (PARTITION BY symbol) AS family_size FROM family")(
    lambda s, d: family(s, d).withColumn("place", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("degree"), "id"))).withColumn(
        "family_size", F.count(F.lit(1)).over(Window.partitionBy("symbol"))).select("symbol", "id", "place", "family_size"))


def _aggregated(name: str, own: str, other: str) -> None:
    def run(s: SparkSession, d: str) -> DataFrame:
        n, e = nodes(s, d), edges(s, d)
        f = family(s, d).select(F.col("symbol").alias("seed"), F.col("id").alias(own))
        pairs = e.filter(F.col("kind").isin(*G.USE_KINDS)).select(own, F.col(other).alias("id")).join(f, own).select("seed", "id")
        return G.ranked_neighbours(pairs, n, G.degrees(n, e), 80)

    R.add(name, f"""WITH {N_SQL}, {E_SQL}, {DEG_SQL}, {_FAMILY}, p AS (SELECT DISTINCT family.symbol AS seed, e.{other} AS id FROM family JOIN e ON e.{own} = family.id WHERE e.kind IN ('calls', 'references', 'imports'))
 SELECT seed, id, name, degree, rank FROM (SELECT p.seed, p.id, n.name, deg.degree, row_number() OVER (PARTITION BY p.seed ORDER BY {TEST_SQL.format(p='n.file_path')}, deg.degree DESC, n.name, n.id) AS rank
 FROM p JOIN n ON n.id = p.id JOIN deg ON deg.id = p.id) WHERE rank <= 80""")(run)


_aggregated("agg_callers", "target", "source")
_aggregated("agg_callees", "source", "target")


@R.add("agg_impact", f"""WITH {N_SQL}, {E_SQL}, {DEG_SQL}, {_FAMILY}, p AS (SELECT DISTINCT family.symbol AS seed, e.source AS id FROM family JOIN e ON e.target = family.id WHERE e.kind IN ('calls', 'references', 'implements', 'extends', 'instantiates', 'uses')),
 q AS (SELECT seed, id, 1 AS class FROM p WHERE (seed, id) NOT IN (SELECT symbol, id FROM family) UNION ALL SELECT symbol, id, 0 FROM family)
 SELECT seed, id, class, place FROM (SELECT q.seed, q.id, q.class, row_number() OVER (PARTITION BY q.seed ORDER BY q.class, deg.degree DESC, q.id) AS place FROM q JOIN n ON n.id = q.id JOIN deg ON deg.id = q.id WHERE n.kind NOT IN ('file', 'namespace')) WHERE place <= 100""")
def agg_impact(s: SparkSession, d: str) -> DataFrame:
    """Roots of each family and what depends on them directly, ranked; the first 100."""
    n, e = nodes(s, d), edges(s, d)
    f = family(s, d)
    roots = f.select(F.col("symbol").alias("seed"), "id")
    near = e.filter(F.col("kind").isin(*G.ANSWER_KINDS)).select("target", F.col("source").alias("near")).join(f.select("symbol", F.col("id").alias("target")), "target").select(
        F.col("symbol").alias("seed"), F.col("near").alias("id")).distinct().join(roots, ["seed", "id"], "left_anti")
    both = roots.withColumn("class", F.lit(0)).unionByName(near.withColumn("class", F.lit(1)))
    j = both.join(n.filter(~F.col("kind").isin("file", "namespace")).select("id"), "id").join(G.degrees(n, e).select("id", "degree"), "id")
    w = Window.partitionBy("seed").orderBy("class", F.desc("degree"), "id")
    return j.withColumn("place", F.row_number().over(w)).filter("place <= 100").select("seed", "id", "class", "place")


@R.add("line_clusters", f"""WITH {N_SQL}, a AS (SELECT file_path, start_line, end_line, max(end_line) OVER (PARTITION BY file_path ORDER BY start_line, end_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM n WHERE kind IN ('function', 'method')), b AS (SELECT *, sum(CASE WHEN before IS NULL OR start_line - before > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY file_path ORDER BY start_line, end_line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cluster FROM a)
 SELECT file_path, min(start_line) AS cluster_start, max(end_line) AS cluster_end, count(*) AS n FROM b GROUP BY file_path, cluster""")
def line_clusters(s: SparkSession, d: str) -> DataFrame:
    return G.line_clusters(nodes(s, d).filter(F.col("kind").isin("function", "method")).select("file_path", "start_line", "end_line"), ["file_path"], 2)


R.add("relationship_summary", f"""WITH {N_SQL}, {E_SQL} SELECT a.kind AS source_kind, e.kind, b.kind AS target_kind, count(*) AS n FROM e JOIN n a ON a.id = e.source JOIN n b ON b.id = e.target GROUP BY 1, 2, 3""")(
    lambda s, d: edges(s, d).join(nodes(s, d).select(F.col("id").alias("source"), F.col("kind").alias("source_kind")), "source").join(
        nodes(s, d).select(F.col("id").alias("target"), F.col("kind").alias("target_kind")), "target").groupBy("source_kind", "kind", "target_kind").agg(count()))
R.add("file_symbol_coverage", f"WITH {N_SQL} SELECT file_path, count(DISTINCT lower(name)) AS n_names, 20 * (count(DISTINCT lower(name)) - 1) AS bonus FROM n WHERE kind <> 'file' GROUP BY 1")(
    lambda s, d: nodes(s, d).filter("kind <> 'file'").groupBy("file_path").agg(F.countDistinct(F.lower("name")).alias("n_names")).withColumn("bonus", 20 * (F.col("n_names") - 1)))


@R.add("subgraph_edges", f"""WITH RECURSIVE {N_SQL}, {E_SQL}, step AS (SELECT DISTINCT src, dst FROM ({_OUT} UNION {_IN}) WHERE dst IN (SELECT id FROM n)),
 r(node, depth) AS (SELECT id, 0 FROM n WHERE {_ASKED.format(c='id')} UNION SELECT step.dst, r.depth + 1 FROM r JOIN step ON step.src = r.node WHERE r.depth < 1), k AS (SELECT DISTINCT node FROM r JOIN n ON n.id = r.node WHERE n.kind <> 'file')
 SELECT DISTINCT id, source, target, kind FROM e WHERE source IN (SELECT node FROM k) AND target IN (SELECT node FROM k)""")
def subgraph_edges(s: SparkSession, d: str) -> DataFrame:
    """Edges among what surrounds the modules, files left out, without dangling ones."""
    n, e = nodes(s, d), edges(s, d)
    k = G.reach(G.arcs(e, "both"), seeds(s, d), 1, n).select(F.col("node").alias("id")).distinct().join(n.filter("kind <> 'file'").select("id"), "id", "left_semi")
    return e.join(k.withColumnRenamed("id", "source"), "source", "left_semi").join(k.withColumnRenamed("id", "target"), "target", "left_semi").select("id", "source", "target", "kind").distinct()


R.add("files_depending_on_name", f"""WITH {N_SQL}, {E_SQL} SELECT b.name AS symbol, count(DISTINCT a.file_path) AS n_files, count(DISTINCT a.id) AS n_nodes FROM e JOIN n a ON a.id = e.source JOIN n b ON b.id = e.target
 WHERE b.kind <> 'file' AND a.file_path <> b.file_path GROUP BY 1""")(
    lambda s, d: edges(s, d).select("source", "target").join(nodes(s, d).select(F.col("id").alias("source"), F.col("file_path").alias("a")), "source").join(
        nodes(s, d).filter("kind <> 'file'").select(F.col("id").alias("target"), F.col("name").alias("symbol"), F.col("file_path").alias("b")), "target").filter("a <> b").groupBy("symbol").agg(
        F.countDistinct("a").alias("n_files"), F.countDistinct("source").alias("n_nodes")))


@R.add("recall_scoring", f"""WITH {N_SQL}, {E_SQL}, want AS (SELECT DISTINCT e.target AS case_id, e.source AS item FROM e WHERE e.kind = 'calls'), got AS (SELECT DISTINCT e.target AS case_id, e.source AS item FROM e JOIN n ON n.id = e.source WHERE e.kind = 'calls')
 SELECT want.case_id, count(*) AS required, count(got.item) AS present, round(count(got.item) / count(*), 6) AS recall, CASE WHEN count(got.item) / count(*) >= 0.8 THEN 'PASS' WHEN count(got.item) > 0 THEN 'PARTIAL' ELSE 'FAIL' END AS verdict
 FROM want LEFT JOIN got ON got.case_id = want.case_id AND got.item = want.item GROUP BY 1""")
def recall_scoring(s: SparkSession, d: str) -> DataFrame:
    """Of the callers that edges name, the share that the node table can show, with a verdict per symbol."""
    want = edges(s, d).filter("kind = 'calls'").select(F.col("target").alias("case_id"), F.col("source").alias("item")).distinct()
    got = want.join(nodes(s, d).select(F.col("id").alias("item")).distinct(), "item", "left_semi").withColumn("hit", F.lit(1))
    ratio = F.count("hit") / F.count(F.lit(1))
    return want.join(got, ["case_id", "item"], "left").groupBy("case_id").agg(F.count(F.lit(1)).alias("required"), F.count("hit").alias("present"), F.round(ratio, 6).alias("recall"),
                                                                          F.when(ratio >= 0.8, "PASS").when(F.count("hit") > 0, "PARTIAL").otherwise("FAIL").alias("verdict"))
