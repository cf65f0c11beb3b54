"""Queries of ranked search; the query set is every unresolved reference whose id is divisible by 50, every other one with its kind as a second word."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbora.operators import context as X
from arbora.operators import search as S
from arbora.plans.graph_queries import E_SQL, N_SQL, TEST_SQL, edges, nodes, refs
from arbora.plans.registry import Registry

R = Registry()
Q_SQL = "q AS (SELECT id AS qid, CASE WHEN id % 100 = 0 THEN reference_name || ' ' || lower(trim(reference_kind)) ELSE reference_name END AS query FROM unresolved_refs WHERE id % 50 = 0 AND reference_name IS NOT NULL)"
_FOLD = f"translate(lower(coalesce({{c}}, '')), '{S.MARKED}', '{S.PLAIN}')"
_TOKENS = "list_filter(regexp_split_to_array({x}, '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
P_SQL = "p AS (SELECT node, col, token, count(*) AS tf FROM (" + " UNION ALL ".join(
    f"SELECT id AS node, '{c}' AS col, unnest({_TOKENS.format(x=_FOLD.format(c=c))}) AS token FROM n" for c in S.WEIGHTS) + ") GROUP BY 1, 2, 3)"
T_SQL = ("t AS (SELECT DISTINCT qid, array_to_string(" + _TOKENS.format(x=_FOLD.format(c="w")) + """, ' ') AS term FROM (SELECT qid, unnest(regexp_split_to_array(
 regexp_replace(replace(query, '::', ' '), '["*():^]', '', 'g'), '\\s+')) AS w FROM q) WHERE w NOT IN ('', 'AND', 'OR', 'NOT', 'NEAR') AND len(""" + _TOKENS.format(x=_FOLD.format(c="w")) + ") > 0)")
J_SQL = "j AS (" + " UNION ALL ".join(f"SELECT id AS node, '{c}' AS col, ' ' || array_to_string({_TOKENS.format(x=_FOLD.format(c=c))}, ' ') AS s FROM n" for c in S.WEIGHTS if c != "id") + ")"
_WEIGHT = "CASE col " + " ".join(f"WHEN '{c}' THEN {w}" for c, w in S.WEIGHTS.items()) + " END"
H_SQL = f"{J_SQL}, h AS (SELECT t.qid, t.term, j.node, sum({_WEIGHT} * (len(j.s) - len(replace(j.s, ' ' || t.term, ''))) / (len(t.term) + 1)) AS tf FROM t JOIN j ON contains(j.s, ' ' || t.term) GROUP BY 1, 2, 3)"
BM_SQL = f"""size AS (SELECT node, sum(tf) AS size FROM p GROUP BY 1), stats AS (SELECT avg(size) AS mean, count(*) AS total FROM size), df AS (SELECT term, count(DISTINCT node) AS df FROM h GROUP BY 1),
 scored AS (SELECT h.qid, h.node, round(sum(greatest(ln((stats.total - df.df + 0.5) / (df.df + 0.5)), 1e-6) * h.tf * 2.2 / (h.tf + 1.2 * (0.25 + 0.75 * size.size / stats.mean))), 6) AS score
  FROM h JOIN df ON df.term = h.term JOIN size ON size.node = h.node, stats GROUP BY 1, 2)"""
_ALL = f"WITH {N_SQL}, {Q_SQL}, {P_SQL}, {T_SQL}, {H_SQL}"


def queries(s: SparkSession, d: str) -> DataFrame:
    return refs(s, d).filter("id % 50 = 0 AND reference_name IS NOT NULL").selectExpr(
        "id AS qid", "CASE WHEN id % 100 = 0 THEN reference_name || ' ' || lower(trim(reference_kind)) ELSE reference_name END AS query")


R.add("postings", f"WITH {N_SQL}, {P_SQL} SELECT node, col, token, tf FROM p")(lambda s, d: S.postings(nodes(s, d)))
R.add("doc_freq", f"WITH {N_SQL}, {P_SQL} SELECT token, count(DISTINCT node) AS df FROM p WHERE col <> 'id' GROUP BY 1")(
    lambda s, d: S.postings(nodes(s, d)).filter("col <> 'id'").select("token", "node").distinct().groupBy("token").agg(F.count(F.lit(1)).alias("df")))
R.add("term_idf", f"{_ALL} SELECT t.term, round(greatest(1.0, ln((SELECT count(*) FROM n) / (coalesce(max(c.df), 0) + 1.0)) + 1.0), 6) AS idf FROM (SELECT DISTINCT term FROM t) t LEFT JOIN (SELECT term, count(DISTINCT node) AS df FROM h GROUP BY 1) c ON c.term = t.term GROUP BY 1")(
    lambda s, d: (lambda n, t: t.select("term").distinct().join(S.term_hits(t, S.texts(n)).select("term", "node").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("df")), "term", "left").withColumn(
        "total", n.agg(F.count(F.lit(1)).alias("t")).scalar()).select("term", F.round(F.greatest(F.lit(1.0), F.log(F.col("total") / (F.coalesce("df", F.lit(0)) + 1.0)) + 1.0), 6).alias("idf")))(
        nodes(s, d), S.query_terms(queries(s, d))))
R.add("bm25_top", f"{_ALL}, {BM_SQL} SELECT qid, node, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, node) AS rank FROM scored) WHERE rank <= 10")(
    lambda s, d: S.bm25(queries(s, d), nodes(s, d), 10))
R.add("like_tiers", f"""WITH {N_SQL}, {Q_SQL}, x AS (SELECT qid, n.id AS node, CASE WHEN len(query) < 2 THEN NULL WHEN n.name = query THEN 1.0 WHEN starts_with(lower(n.name), lower(query)) THEN 0.9
 WHEN contains(lower(n.name), lower(query)) THEN 0.8 WHEN contains(lower(coalesce(n.qualified_name, '')), lower(query)) THEN 0.7 END::DOUBLE AS score FROM q, n) SELECT qid, node, score FROM x WHERE score IS NOT NULL""")(
    lambda s, d: S.like_tiers(queries(s, d), nodes(s, d)).drop("size"))
R.add("fuzzy_names", f"""WITH {N_SQL}, {Q_SQL} SELECT qid, name, CAST(levenshtein(lower(query), lower(name)) AS INTEGER) AS distance FROM q, (SELECT DISTINCT name FROM n) WHERE len(query) >= 3
 AND levenshtein(lower(query), lower(name)) <= CASE WHEN len(query) <= 4 THEN 1 ELSE 2 END""")(lambda s, d: S.fuzzy_names(queries(s, d), nodes(s, d).select("name")))
_SUPPLEMENT = """word AS (SELECT DISTINCT qid, lower(w) AS key FROM (SELECT qid, unnest(regexp_split_to_array(query, '\\s+')) AS w FROM q) WHERE len(w) >= 2),
 named AS (SELECT lower(name) AS key, id AS node FROM n QUALIFY row_number() OVER (PARTITION BY lower(name) ORDER BY id) <= 20),
 extra AS (SELECT DISTINCT qid, node FROM word JOIN named ON named.key = word.key)"""
R.add("exact_supplement", f"WITH {N_SQL}, {Q_SQL}, {_SUPPLEMENT} SELECT qid, node FROM extra")(lambda s, d: S.exact_names(queries(s, d), nodes(s, d)))
_KIND = "CASE lower(trim(kind)) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in S.KIND_BONUS.items()) + " ELSE 0 END"
R.add("kind_bonus", f"WITH {N_SQL} SELECT id, {_KIND} AS bonus FROM n")(lambda s, d: nodes(s, d).select("id", S.kind_bonus().alias("bonus")))
_LONG = "list_filter(regexp_split_to_array(lower({q}), '\\s+'), lambda t: len(t) >= 2)"
_WHOLE, _CUT, _TIGHT = _LONG.format(q="query"), _LONG.format(q="regexp_replace(query, '[_.-]', ' ', 'g')"), "lower(regexp_replace(query, '\\s', '', 'g'))"
_NAME = f"""CASE WHEN lower(name) = {_TIGHT} THEN 80 WHEN len({_WHOLE}) > 1 AND list_contains({_WHOLE}, lower(name)) THEN 60
 WHEN starts_with(lower(name), {_TIGHT}) THEN CAST(round(10 + 30 * len({_TIGHT}) / len(name)) AS INTEGER)
 WHEN len({_CUT}) > 1 AND len(list_filter({_CUT}, lambda t: NOT contains(lower(name), t))) = 0 THEN 15 WHEN contains(lower(name), {_TIGHT}) THEN 10 ELSE 0 END"""
_ASKED = "CASE substr(md5(id), 1, 1) WHEN '0' THEN name WHEN '1' THEN kind || ' ' || name WHEN '2' THEN substr(name, 1, 4) WHEN '3' THEN substr(name, 3, 3) WHEN '4' THEN substr(name, 4, 3) || '_' || substr(name, 1, 3) ELSE split_part(qualified_name, '::', 1) END"
R.add("name_match_bonus", f"WITH {N_SQL} SELECT id, {_NAME} AS bonus FROM (SELECT id, name, {_ASKED} AS query FROM n WHERE qualified_name <> '')")(
    lambda s, d: nodes(s, d).filter("qualified_name <> ''").selectExpr("id", "name", f"{_ASKED} AS query").select("id", S.name_match_bonus("name", "query").alias("bonus")))
_TERMS = "list_sort(list_distinct(list_filter(regexp_split_to_array(lower(trim(regexp_replace(regexp_replace({q}, '([A-Z])', ' \\1', 'g'), '[_.]', ' ', 'g'))), '\\s+'), lambda t: len(t) >= 3)))"
R.add("search_terms", f"SELECT id, array_to_string({_TERMS.format(q='reference_name')}, ' ') AS terms FROM unresolved_refs")(
    lambda s, d: refs(s, d).select("id", F.array_join(S.search_terms(F.col("reference_name")), " ").alias("terms")))
_PATH = f"""CASE WHEN len({_TERMS.format(q='query')}) = 0 THEN 0 ELSE
 coalesce(list_sum(list_transform({_TERMS.format(q='query')}, lambda t: CASE WHEN contains(lower(regexp_extract(file_path, '[^/]*$')), t) THEN 10 WHEN contains(lower(regexp_replace(file_path, '/?[^/]*$', '')), t) THEN 5 WHEN contains(lower(file_path), t) THEN 3 ELSE 0 END)), 0)
 - CASE WHEN NOT regexp_matches(lower(query), 'test|spec') AND {TEST_SQL.format(p='file_path')} THEN 15 ELSE 0 END END"""
R.add("path_relevance", f"SELECT id, CAST({_PATH} AS INTEGER) AS points FROM (SELECT id, reference_name AS query, file_path FROM unresolved_refs)")(
    lambda s, d: refs(s, d).select("id", F.col("reference_name").alias("query"), "file_path").select("id", S.path_relevance("file_path", "query").cast("int").alias("points")))


_LIKE = """ls AS (SELECT qid, n.id AS node, CASE WHEN n.name = query THEN 1.0 WHEN starts_with(lower(n.name), lower(query)) THEN 0.9 WHEN contains(lower(n.name), lower(query)) THEN 0.8
  WHEN contains(lower(coalesce(n.qualified_name, '')), lower(query)) THEN 0.7 END::DOUBLE AS score, len(n.name) AS size FROM q, n WHERE len(query) >= 2 AND qid NOT IN (SELECT qid FROM base)),
 inside AS (SELECT qid, node, score FROM ls WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, size, node) <= 10)"""
_FUZZY = """fz AS (SELECT qid, name, levenshtein(lower(query), lower(name)) AS distance FROM q, (SELECT DISTINCT name FROM n) WHERE len(query) >= 3 AND qid NOT IN (SELECT qid FROM base) AND qid NOT IN (SELECT qid FROM inside)
  AND levenshtein(lower(query), lower(name)) <= CASE WHEN len(query) <= 4 THEN 1 ELSE 2 END QUALIFY row_number() OVER (PARTITION BY qid ORDER BY distance, name) <= 50),
 five AS (SELECT name, id AS node FROM n QUALIFY row_number() OVER (PARTITION BY name ORDER BY id) <= 5),
 near AS (SELECT qid, node, 1.0 / (1 + distance) AS score FROM fz JOIN five ON five.name = fz.name QUALIFY row_number() OVER (PARTITION BY qid ORDER BY distance, fz.name, node) <= 10)"""


SEARCH_SQL = f"""{BM_SQL}, base AS (SELECT qid, node, score FROM scored QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, node) <= 100), {_LIKE}, {_FUZZY},
 hits AS (SELECT * FROM base UNION ALL SELECT * FROM inside UNION ALL SELECT * FROM near), {_SUPPLEMENT},
 everything AS (SELECT * FROM hits UNION ALL SELECT x.qid, x.node, m.score FROM extra x JOIN (SELECT qid, max(score) AS score FROM hits GROUP BY 1) m ON m.qid = x.qid WHERE NOT EXISTS (SELECT 1 FROM hits h2 WHERE h2.qid = x.qid AND h2.node = x.node)),
 searched AS (SELECT qid, node, score, rank FROM (SELECT qid, node, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, node) AS rank FROM (
  SELECT b.qid, b.node, round(b.score + {_KIND} + {_NAME} + {_PATH}, 6) AS score FROM everything b JOIN n ON n.id = b.node JOIN q ON q.qid = b.qid)) WHERE rank <= 10)"""


@R.add("search_composite", f"{_ALL}, {SEARCH_SQL} SELECT qid, node, score, rank FROM searched")
def search_composite(s: SparkSession, d: str) -> DataFrame:
    return S.search(queries(s, d), nodes(s, d), 10)


# ------------------------------------------------------------------ context of a question

#: The search runs over all nodes but files, the rest over all nodes.
_BEFORE = f"WITH RECURSIVE {N_SQL.replace('n AS (', 'nall AS (', 1)}, n AS (SELECT * FROM nall WHERE kind <> 'file'), {Q_SQL}, {P_SQL}, {T_SQL}, {H_SQL}, {SEARCH_SQL}"
_TEST = TEST_SQL.format(p="file_path")
_ROOTS = f"""hit AS (SELECT h.qid, h.node, h.score + 20 * (count(*) OVER (PARTITION BY h.qid, n.file_path) - 1) AS score, n.file_path FROM searched h JOIN n ON n.id = h.node),
 roots AS (SELECT qid, node, score, rank FROM (SELECT qid, node, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, node) AS rank FROM (
  SELECT qid, node, round(score * CASE WHEN {_TEST} THEN 0.3 ELSE 1.0 END, 6) AS score FROM hit)) WHERE rank <= 3)"""


def _context_sql(depth: int, most: int) -> str:
    return f"""{E_SQL}, step AS (SELECT DISTINCT src, dst FROM (SELECT source AS src, target AS dst FROM e UNION SELECT target, source FROM e) WHERE dst IN (SELECT id FROM nall)),
 around(qid, node, depth) AS (SELECT qid, node, 0 FROM roots UNION SELECT around.qid, step.dst, around.depth + 1 FROM around JOIN step ON step.src = around.node WHERE around.depth < {depth}),
 ctx AS (SELECT qid, node, depth, place FROM (SELECT m.qid, m.node, m.depth, row_number() OVER (PARTITION BY m.qid ORDER BY m.depth, {_TEST}, kind = 'file', {_KIND} DESC, name, m.node) AS place
  FROM (SELECT qid, node, min(depth) AS depth FROM around GROUP BY 1, 2) m JOIN nall ON nall.id = m.node) WHERE place <= {most})"""


R.add("context_roots", f"{_BEFORE}, {_ROOTS} SELECT * FROM roots")(lambda s, d: X.roots(queries(s, d), nodes(s, d)))
R.add("context_nodes", f"{_BEFORE}, {_ROOTS}, {_context_sql(1, 20)} SELECT qid, node, CAST(depth AS INTEGER) AS depth, place FROM ctx")(lambda s, d: X.context(queries(s, d), nodes(s, d), edges(s, d)))
R.add("explore_files", f"""{_BEFORE}, {_ROOTS}, {_context_sql(2, 200)},
 per AS (SELECT c.qid, file_path, round(sum((1.0 + {_KIND}) / (1 + c.depth)), 6) AS points, count(*) AS n_nodes FROM ctx c JOIN nall ON nall.id = c.node WHERE file_path IS NOT NULL GROUP BY 1, 2),
 rel AS (SELECT per.qid, file_path, n_nodes, round((points + {_PATH}) * CASE WHEN {_TEST} THEN 0.7 ELSE 1.0 END * CASE WHEN regexp_matches(lower(file_path), 'icon|i18n|locale') THEN 0.5 ELSE 1.0 END, 6) AS relevance FROM per JOIN q ON q.qid = per.qid)
 SELECT qid, file_path, relevance, n_nodes, place FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY relevance DESC, file_path) AS place FROM rel) WHERE place <= 12""")(
    lambda s, d: X.explore(queries(s, d), nodes(s, d), edges(s, d)))
