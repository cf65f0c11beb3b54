"""Queries of reference resolution over all unresolved references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.extract import imports as I
from arbora.operators import resolve as V
from arbora.plans.graph_queries import files, nodes, refs
from arbora.plans.registry import Registry
from arbora.sources.tables import table

R = Registry()
_ENDINGS = "CASE regexp_extract({p}, '\\.([A-Za-z]+)$', 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.ENDINGS.items()) + " ELSE 'unknown' END"
R_SQL = f"""r AS (SELECT id AS ref, reference_name AS name, lower(trim(reference_kind)) AS ref_kind, line AS ref_line, file_path AS ref_file, {_ENDINGS.format(p="coalesce(file_path, '')")} AS lang, from_node_id
 FROM unresolved_refs WHERE reference_name IS NOT NULL)"""
C_SQL = """c AS (SELECT DISTINCT id AS node, kind, name, qualified_name, file_path, start_line, regexp_replace(lower(trim(language)), '[^a-z0-9+#]', '', 'g') AS node_lang, coalesce(is_exported, false) AS exported FROM nodes)"""


def _in(names: list[str]) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


_FIRST, _REST, _DOT = "string_split(name, '.')[1]", "substr(name, instr(name, '.') + 1)", "instr(name, '.') > 0"
_CAP = "upper(substr({x}, 1, 1)) || substr({x}, 2)"
B_SQL = f"""b AS (SELECT ref, (lang IN ('typescript', 'javascript') AND (name IN {_in(V.JS_NAMES)} OR starts_with(name, 'console.') OR starts_with(name, 'Math.') OR starts_with(name, 'JSON.')))
 OR (lang = 'python' AND (name IN {_in(V.PY_NAMES)} OR name IN {_in(V.PY_METHODS)} OR ({_DOT} AND ({_FIRST} IN {_in(V.PY_TYPES)} OR ({_REST} IN {_in(V.PY_METHODS)} AND {_CAP.format(x=_FIRST)} NOT IN (SELECT name FROM c))))))
 OR (lang = 'go' AND (name IN {_in(V.GO_NAMES)} OR ({_DOT} AND {_FIRST} IN {_in(V.GO_PACKAGES)}))) OR (lang = 'csharp' AND name IN {_in(V.CS_NAMES)}) AS builtin FROM r)"""
K_SQL = f"""k AS (SELECT ref FROM r WHERE name IN (SELECT name FROM c) OR ({_DOT} AND ({_FIRST} IN (SELECT name FROM c) OR {_REST} IN (SELECT name FROM c) OR {_CAP.format(x=_FIRST)} IN (SELECT name FROM c)))
 OR (instr(name, '::') > 0 AND (string_split(name, '::')[1] IN (SELECT name FROM c) OR substr(name, instr(name, '::') + 2) IN (SELECT name FROM c)))
 OR (instr(name, '/') > 0 AND regexp_extract(name, '[^/]*$') IN (SELECT name FROM c)))"""
_BASE = f"WITH {R_SQL}, {C_SQL}"
_POINTS = """CASE WHEN c.node_lang = {r}.lang THEN 50 ELSE -80 END + CASE WHEN {r}.ref_kind = 'calls' AND c.kind IN ('function', 'method') THEN 25 WHEN {r}.ref_kind = 'instantiates' AND c.kind IN ('class', 'struct') THEN 25
 WHEN {r}.ref_kind = 'decorates' AND c.kind = 'function' THEN 25 WHEN {r}.ref_kind = 'decorates' AND c.kind = 'class' THEN 15 ELSE 0 END + CASE WHEN c.exported THEN 10 ELSE 0 END
 + CASE WHEN c.file_path = {r}.ref_file THEN 100 + CASE WHEN {r}.ref_line IS NULL THEN 0 ELSE 20 - least(abs(c.start_line - {r}.ref_line), 20) END ELSE 0 END"""
FILE_SQL = """pf AS (SELECT r.ref, f.path AS file_path, CASE WHEN f.path = r.name THEN 0.95 WHEN ends_with(f.path, '/' || r.name) THEN 0.85 ELSE 0.70 END AS confidence
  FROM r JOIN (SELECT DISTINCT path FROM files) f ON regexp_extract(f.path, '[^/]*$') = regexp_extract(r.name, '[^/]*$') WHERE instr(r.name, '/') > 0 OR (instr(r.name, '.') > 0 AND instr(r.name, '::') = 0)),
 pg AS (SELECT *, sum(CASE WHEN confidence >= 0.85 THEN 1 ELSE 0 END) OVER (PARTITION BY ref) AS ends, count(*) OVER (PARTITION BY ref) AS total, max(confidence) OVER (PARTITION BY ref) AS best FROM pf),
 w1 AS (SELECT ref, node, confidence::DOUBLE AS confidence FROM pg JOIN (SELECT file_path, node FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY start_line, node) AS rn FROM c) WHERE rn = 1) x ON x.file_path = pg.file_path
  WHERE confidence = 0.95 OR (confidence = 0.85 AND ends = 1) OR (confidence = 0.70 AND total = 1))"""
QUAL_SQL = """qa AS (SELECT r.ref, min(c.node) AS node FROM r JOIN c ON c.qualified_name = r.name WHERE instr(r.name, '::') > 0 OR instr(r.name, '.') > 0 GROUP BY 1),
 w2 AS (SELECT ref, node, 0.95::DOUBLE AS confidence FROM qa UNION ALL SELECT r.ref, min(c.node), 0.85::DOUBLE FROM r JOIN c ON c.name = string_split(r.name, '::')[-1] AND ends_with(c.qualified_name, r.name)
  WHERE (instr(r.name, '::') > 0 OR instr(r.name, '.') > 0) AND r.ref NOT IN (SELECT ref FROM qa) GROUP BY 1)"""
CALL_SQL = f"""rc AS (SELECT *, CASE WHEN instr(name, '::') > 0 THEN string_split(name, '::')[1] WHEN instr(name, '.') > 0 THEN regexp_extract(name, '^(.*)\\.[^.]*$', 1) END AS receiver,
  CASE WHEN instr(name, '::') > 0 THEN substr(name, instr(name, '::') + 2) WHEN instr(name, '.') > 0 THEN regexp_extract(name, '^.*\\.([^.]*)$', 1) END AS member FROM r),
 ra AS (SELECT * FROM rc WHERE receiver <> '' AND member <> ''), mem AS (SELECT * FROM c WHERE kind IN ('function', 'method')),
 da AS (SELECT ra.ref, min(mem.node) AS node FROM ra JOIN c o ON o.name = ra.receiver AND o.kind IN ('class', 'struct', 'interface') JOIN mem ON mem.file_path = o.file_path AND mem.name = ra.member GROUP BY 1),
 db AS (SELECT ra.ref, min(mem.node) AS node FROM ra JOIN c o ON o.name = {_CAP.format(x='ra.receiver')} AND o.name <> ra.receiver JOIN mem ON mem.file_path = o.file_path AND mem.name = ra.member WHERE ra.ref NOT IN (SELECT ref FROM da) GROUP BY 1),
 dc AS (SELECT ref, node FROM (SELECT ra.ref, c.node, row_number() OVER (PARTITION BY ra.ref ORDER BY {_POINTS.format(r='ra')} DESC, c.node) AS rn FROM ra JOIN mem c ON c.name = ra.member
  WHERE ra.ref NOT IN (SELECT ref FROM da) AND ra.ref NOT IN (SELECT ref FROM db)) WHERE rn = 1),
 w3 AS (SELECT ref, node, 0.85::DOUBLE AS confidence FROM da UNION ALL SELECT ref, node, 0.75 FROM db UNION ALL SELECT ref, node, 0.65 FROM dc)"""
EXACT_SQL = f"""xa AS (SELECT r.ref, c.node, count(*) OVER (PARTITION BY r.ref) AS bearers, c.node_lang = r.lang AS same, {_POINTS.format(r='r')} AS score FROM r JOIN c ON c.name = r.name),
 w4 AS (SELECT ref, node, CASE WHEN bearers = 1 THEN CASE WHEN same THEN 0.9 ELSE 0.5 END ELSE round(least(0.9, 0.4 + score / 100.0 * 0.5), 6) END::DOUBLE AS confidence
  FROM (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY score DESC, node) AS rn FROM xa) WHERE rn = 1)"""
FUZZY_SQL = """w5 AS (SELECT ref, node, CASE WHEN same THEN 0.5 ELSE 0.3 END::DOUBLE AS confidence FROM (SELECT r.ref, c.node, c.node_lang = r.lang AS same, row_number() OVER (PARTITION BY r.ref ORDER BY c.node) AS rn
  FROM r JOIN c ON lower(c.name) = lower(r.name) WHERE c.kind IN ('function', 'method', 'class')) WHERE rn = 1)"""


def r(s: SparkSession, d: str) -> DataFrame:
    return V.prepared(refs(s, d))


def c(s: SparkSession, d: str) -> DataFrame:
    return V.candidates(nodes(s, d))


_Q = lambda x: x.replace("'", "''")
_SCRIPT, _PY, _GO, _PHP = (f"regexp_matches(path, '{x}')" for x in (I._SCRIPT, "\\.py$", "\\.go$", "\\.php$"))
_ALL_OF = lambda *ps: "list_concat(" + ", ".join(f"regexp_extract_all(text, '{_Q(x)}', 1)" for x in ps) + ")" if len(ps) > 1 else f"regexp_extract_all(text, '{_Q(ps[0])}', 1)"
IMPORT_SQL = f"""src AS (SELECT path, text FROM documents WHERE path IS NOT NULL AND text IS NOT NULL),
 bl AS (SELECT path, regexp_replace(trim(regexp_replace(unnest(string_split(x, ',')), '[()\\s]+', ' ', 'g')), '^type ', '') AS x FROM (
  SELECT path, unnest(CASE WHEN {_SCRIPT} THEN {_ALL_OF(I.NAMED, I.REQUIRED)} WHEN {_PY} THEN {_ALL_OF(I.PY_FROM)} ELSE [] END) AS x FROM src)),
 bw AS (SELECT path, trim(unnest(CASE WHEN {_SCRIPT} THEN {_ALL_OF(I.DEFAULT, I.NAMESPACE)} WHEN {_PY} THEN {_ALL_OF(I.PY_IMPORT)} WHEN {_GO} THEN {_ALL_OF(I.GO_IMPORT)} WHEN {_PHP} THEN {_ALL_OF(I.PHP_USE)} ELSE [] END)) AS x FROM src),
 bound AS (SELECT DISTINCT path, local, original FROM (SELECT path, regexp_extract(x, '([\\w$]+)$', 1) AS local, regexp_extract(x, '^([\\w$]+)', 1) AS original FROM bl
  UNION ALL SELECT path, CASE WHEN regexp_extract(x, '\\sas\\s+(\\w+)$', 1) <> '' THEN regexp_extract(x, '\\sas\\s+(\\w+)$', 1) WHEN {_GO} AND regexp_matches(x, '^\\w') THEN regexp_extract(x, '^(\\w+)', 1)
   WHEN {_GO} THEN regexp_extract(replace(x, '"', ''), '[^/]*$') WHEN {_PHP} THEN regexp_extract(x, '[^\\\\]*$') ELSE x END, CASE WHEN {_PHP} THEN regexp_extract(x, '(\\w+)(?:\\s+as\\s+\\w+)?$', 1) END FROM bw) WHERE local <> ''),
 bh AS (SELECT r.ref, b.local, coalesce(b.original, b.local) AS name FROM r JOIN bound b ON b.path = r.ref_file AND b.local = r.name),
 bs AS (SELECT h.ref, min(c.node) AS node FROM bh h JOIN c ON c.name = h.name AND c.exported GROUP BY 1),
 w0 AS (SELECT ref, node, 0.9::DOUBLE AS confidence FROM bs UNION ALL SELECT h.ref, min(c.node), 0.7::DOUBLE FROM bh h JOIN c ON c.name = h.local WHERE h.ref NOT IN (SELECT ref FROM bs) GROUP BY 1)"""


def bound(s: SparkSession, d: str) -> DataFrame:
    return I.bindings(table(s, d, "documents"))


def resolved(s: SparkSession, d: str) -> DataFrame:
    return V.resolve(refs(s, d), nodes(s, d), files(s, d), bound(s, d))


R.add("import_bindings", f"{_BASE}, {IMPORT_SQL} SELECT path, local, original FROM bound")(bound)
# Every name that a file imports, as a reference of that file.
R.add("match_import", f"{_BASE}, {IMPORT_SQL}, u AS (SELECT DISTINCT path || '#' || local AS ref, local, path, coalesce(original, local) AS name FROM bound), us AS (SELECT u.ref, min(c.node) AS node FROM u JOIN c ON c.name = u.name AND c.exported GROUP BY 1)"
      " SELECT ref, node, 0.9::DOUBLE AS confidence FROM us UNION ALL SELECT u.ref, min(c.node), 0.7::DOUBLE FROM u JOIN c ON c.name = u.local WHERE u.ref NOT IN (SELECT ref FROM us) GROUP BY 1")(
    lambda s, d: V.match_import(bound(s, d).select(F.concat_ws("#", "path", "local").alias("ref"), F.col("local").alias("name"), F.col("path").alias("ref_file")).distinct(), c(s, d), bound(s, d)))
R.add("builtin_filter", f"{_BASE}, {B_SQL} SELECT ref, builtin FROM b")(lambda s, d: V.is_builtin(c(s, d), r(s, d)))
R.add("known_prefilter", f"{_BASE}, {K_SQL} SELECT ref FROM k")(lambda s, d: V.is_known(c(s, d), r(s, d)))
#: References made from the tables: every file by its path, its last two parts and its name; every node by its qualified name, or without its first part.
_FILES_R = """r AS (SELECT path || '#' || k AS ref, CASE k WHEN 0 THEN path WHEN 1 THEN array_to_string(list_slice(string_split(path, '/'), -2, -1), '/') ELSE regexp_extract(path, '[^/]*$') END AS name
 FROM (SELECT DISTINCT path FROM files WHERE path IS NOT NULL), (SELECT unnest([0, 1, 2]) AS k))"""
_NODES_R = "r AS (SELECT node AS ref, CASE WHEN substr(md5(node), 1, 1) < '8' THEN qualified_name ELSE regexp_replace(qualified_name, '^[^:]*::', '') END AS name FROM c WHERE qualified_name <> '' QUALIFY row_number() OVER (PARTITION BY node ORDER BY qualified_name) = 1)"


def _file_refs(s: SparkSession, d: str) -> DataFrame:
    forms = [F.col("path"), F.array_join(F.slice(F.split("path", "/"), -2, 2), "/"), F.substring_index("path", "/", -1)]
    return files(s, d).filter("path IS NOT NULL").select("path").distinct().select("path", F.posexplode(F.array(*forms)).alias("k", "name")).select(F.concat_ws("#", "path", "k").alias("ref"), "name")


def _node_refs(s: SparkSession, d: str) -> DataFrame:
    whole = c(s, d).filter("qualified_name <> ''").groupBy("node").agg(F.min("qualified_name").alias("q"))
    return whole.select(F.col("node").alias("ref"), F.when(F.substring(F.md5("node"), 1, 1) < "8", F.col("q")).otherwise(F.regexp_replace("q", "^[^:]*::", "")).alias("name"))


R.add("match_file_path", f"WITH {C_SQL}, {_FILES_R}, {FILE_SQL} SELECT * FROM w1")(lambda s, d: V.match_file_path(_file_refs(s, d), c(s, d), files(s, d)))
R.add("match_qualified", f"WITH {C_SQL}, {_NODES_R}, {QUAL_SQL} SELECT * FROM w2")(lambda s, d: V.match_qualified(_node_refs(s, d), c(s, d)))
R.add("match_method_call", f"{_BASE}, {CALL_SQL} SELECT * FROM w3")(lambda s, d: V.match_method_call(r(s, d), c(s, d)))
R.add("match_exact_name", f"{_BASE}, {EXACT_SQL} SELECT * FROM w4")(lambda s, d: V.match_exact_name(r(s, d), c(s, d)))
R.add("match_fuzzy_lower", f"{_BASE}, {FUZZY_SQL} SELECT * FROM w5")(lambda s, d: V.match_fuzzy_lower(r(s, d), c(s, d)))
R.add("best_candidate", f"{_BASE}, xa AS (SELECT r.ref, c.node, {_POINTS.format(r='r')} AS score FROM r JOIN c ON c.name = r.name) SELECT ref, node, CAST(score AS INTEGER) AS score FROM (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY score DESC, node) AS rn FROM xa) WHERE rn = 1")(
    lambda s, d: V.scored(r(s, d), c(s, d)).withColumn("score", F.col("score").cast("int")))
R.add("edge_kind_map", f"""SELECT id, CASE WHEN lower(trim(reference_kind)) = 'inherits' THEN 'extends' WHEN lower(trim(reference_kind)) IN ('calls', 'imports', 'contains', 'extends', 'implements', 'uses', 'instantiates', 'exports', 'renders', 'resolves')
 THEN lower(trim(reference_kind)) ELSE 'references' END AS kind FROM unresolved_refs""")(lambda s, d: refs(s, d).select("id", V.edge_kind(F.lower(F.trim("reference_kind"))).alias("kind")))
_ALL = ", ".join([B_SQL, K_SQL, IMPORT_SQL, "keep AS (SELECT * FROM r WHERE ref IN (SELECT ref FROM b WHERE NOT builtin) AND (ref IN (SELECT ref FROM k) OR EXISTS (SELECT 1 FROM bound WHERE bound.path = r.ref_file AND (bound.local = r.name OR starts_with(r.name, bound.local || '.')))))"])
_WAYS = ", ".join([FILE_SQL, QUAL_SQL, CALL_SQL, EXACT_SQL, FUZZY_SQL])
RESOLVED = f"""{_BASE}, {_ALL}, {_WAYS}, w AS (SELECT ref, node, confidence, 'file_path' AS method, 0 AS place FROM w1 UNION ALL SELECT *, 'qualified', 1 FROM w2 UNION ALL SELECT *, 'method_call', 2 FROM w3
 UNION ALL SELECT *, 'exact_name', 3 FROM w4 UNION ALL SELECT *, 'fuzzy_lower', 4 FROM w5),
 zn AS (SELECT ref, node, confidence, method, 1 AS late FROM w WHERE ref IN (SELECT ref FROM keep) QUALIFY row_number() OVER (PARTITION BY ref ORDER BY place, node) = 1),
 z AS (SELECT * FROM (SELECT * FROM zn WHERE confidence >= 0.3 UNION ALL SELECT ref, node, confidence, 'import', 0 FROM w0 WHERE ref IN (SELECT ref FROM keep))
  QUALIFY row_number() OVER (PARTITION BY ref ORDER BY CASE WHEN late = 0 AND confidence >= 0.9 THEN 0 ELSE 1 END, confidence DESC, late DESC) = 1),
 resolved AS (SELECT z.ref, r.from_node_id AS source, z.node AS target, CASE WHEN r.ref_kind = 'inherits' THEN 'extends' WHEN r.ref_kind IN ('calls', 'imports', 'contains', 'extends', 'implements', 'uses', 'instantiates', 'exports', 'renders', 'resolves')
  THEN r.ref_kind ELSE 'references' END AS kind, z.confidence, z.method FROM z JOIN r ON r.ref = z.ref)"""
R.add("resolve_cascade", f"{RESOLVED} SELECT * FROM resolved")(lambda s, d: resolved(s, d))
R.add("commit_resolved", f"{RESOLVED} SELECT ref, source, target, kind FROM resolved WHERE source IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes)")(
    lambda s, d: (lambda k: resolved(s, d).join(k.withColumnRenamed("id", "source"), "source", "left_semi").join(k.withColumnRenamed("id", "target"), "target", "left_semi").select(
        "ref", "source", "target", "kind"))(nodes(s, d).select("id").distinct()))
R.add("refs_left", f"{RESOLVED} SELECT id, reference_name FROM unresolved_refs WHERE id NOT IN (SELECT ref FROM resolved)")(
    lambda s, d: refs(s, d).join(resolved(s, d).select(F.col("ref").alias("id")), "id", "left_anti").select("id", "reference_name"))

_WORDS = _in([x[0] for x in V.CONVENTIONS])
_LAST = "regexp_extract(name, '([A-Z][a-z]+)$', 1)"
_HOME = "CASE " + " ".join(f"WHEN {_LAST} = '{w}' THEN contains(coalesce(file_path, ''), '{f}')" for w, f, _ in V.CONVENTIONS) + " END"
_SURE = "CASE " + " ".join(f"WHEN {_LAST} = '{w}' THEN {c}" for w, _, c in V.CONVENTIONS) + " END"
R.add("convention_lookup", f"""{_BASE}, t AS (SELECT name, node, {_HOME} AS home, {_SURE} AS sure, row_number() OVER (PARTITION BY name ORDER BY NOT {_HOME}, node) AS rn FROM c WHERE kind IN ('class', 'struct', 'interface') AND {_LAST} IN {_WORDS})
 SELECT m.node AS ref, t.node, CASE WHEN t.home THEN t.sure ELSE 0.70 END::DOUBLE AS confidence FROM c m JOIN t ON t.name = string_split(m.qualified_name, '::')[1] WHERE t.rn = 1 AND m.kind = 'method'""")(
    lambda s, d: V.by_convention(c(s, d).filter("kind = 'method'").select(F.col("node").alias("ref"), F.substring_index("qualified_name", "::", 1).alias("name")), c(s, d)))

_ARITY = "CASE WHEN regexp_extract(m.signature, '^\\(([^)]*)\\)', 1) = '' THEN 0 ELSE len(string_split(regexp_extract(m.signature, '^\\(([^)]*)\\)', 1), ',')) END"
_METHODS = f"""SELECT DISTINCT e.source AS owner, m.name, {_ARITY} AS arity FROM (SELECT DISTINCT source, target FROM edges WHERE lower(trim(kind)) = 'contains') e JOIN nodes m ON m.id = e.target
 JOIN nodes o ON o.id = e.source WHERE m.kind = 'method' AND m.signature IS NOT NULL AND o.kind"""


def methods(s: SparkSession, d: str, owners: tuple[str, ...]) -> DataFrame:
    """(owner, name, arity) of the methods that these kinds of nodes contain."""
    from arbora.operators.hierarchy import contains_links
    from arbora.sources.tables import table

    inside = F.regexp_extract("signature", r"^\(([^)]*)\)", 1)
    link = contains_links(table(s, d, "edges")).distinct()
    m = nodes(s, d).filter("kind = 'method' AND signature IS NOT NULL").select(F.col("id").alias("child"), "name", F.when(inside == "", 0).otherwise(F.size(F.split(inside, ","))).alias("arity"))
    o = nodes(s, d).filter(F.col("kind").isin(*owners)).select(F.col("id").alias("parent")).distinct()
    return link.join(m, "child").join(o, "parent", "left_semi").select(F.col("parent").alias("owner"), "name", "arity").distinct()


@R.add("structural_implements", f"""WITH i AS ({_METHODS} = 'struct'), t AS ({_METHODS} IN ('class', 'struct')), need AS (SELECT owner, count(*) AS n FROM i GROUP BY 1)
 SELECT t.owner AS type_id, i.owner AS iface_id, (CASE WHEN max(need.n) >= 2 THEN 0.75 ELSE 0.55 END)::DOUBLE AS confidence FROM i JOIN t ON t.name = i.name AND t.arity = i.arity AND t.owner <> i.owner JOIN need ON need.owner = i.owner GROUP BY 1, 2 HAVING count(*) = max(need.n)""")
def structural_implements(s: SparkSession, d: str) -> DataFrame:
    return V.structural_implements(methods(s, d, ("struct",)).withColumnRenamed("owner", "iface_id"), methods(s, d, ("class", "struct")).withColumnRenamed("owner", "type_id"))
