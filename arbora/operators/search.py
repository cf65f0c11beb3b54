"""Ranked symbol search: postings, BM25, substring and fuzzy matching, score adjustments.

Searches take a set of queries (qid, query) and run against all nodes at once.  Prefixes are looked up in the
vocabulary (each token once, under its prefixes of the lengths asked for), substrings by the rarest of
their pieces of two or three letters and near names by pieces of a third, all by equi-joins followed by the exact test, so no query meets a name with
which it shares nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.session import materialise, sent

#: Column weights of the ranking (fixed values); the id counts for the length of a row only.
WEIGHTS = {"id": 0.0, "name": 20.0, "qualified_name": 5.0, "docstring": 1.0, "signature": 2.0}
K1, B = 1.2, 0.75
#: Points by kind of node.
KIND_BONUS = {
    "function": 10, "method": 10, "interface": 9, "trait": 9, "route": 9, "protocol": 9, "class": 8, "component": 8, "type_alias": 6, "struct": 6, "enum": 5,
    "module": 4, "namespace": 4, "constant": 3, "enum_member": 3, "property": 3, "field": 3, "variable": 2, "import": 1, "export": 1,
}
#: Latin letters with marks and what they are folded to, position by position.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿđøł"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyydol"


def fold(c: Column) -> Column:
    return F.translate(F.lower(c), MARKED, PLAIN)


def tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits, marks folded."""
    return F.filter(F.split(fold(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def postings(nodes: DataFrame) -> DataFrame:
    """(node, col, token, tf) over the indexed columns."""
    cols = F.array(*[F.struct(F.lit(c).alias("col"), tokens(F.col(c)).alias("toks")) for c in WEIGHTS])
    each = nodes.select(F.col("id").alias("node"), F.explode(cols).alias("x")).select("node", "x.col", F.explode("x.toks").alias("token"))
    return each.groupBy("node", "col", "token").agg(F.count(F.lit(1)).alias("tf"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(qid, term): the distinct words of each query; the tokens of a word stand in a row, the last as a prefix.

    ``::`` parts words, ``"*():^`` are dropped, the operators AND, OR, NOT and NEAR are no words.
    """
    words = F.filter(F.split(F.regexp_replace(F.regexp_replace("query", "::", " "), r'["*():^]', ""), r"\s+"), lambda w: ~w.isin("", "AND", "OR", "NOT", "NEAR"))
    return queries.select("qid", F.explode(words).alias("w")).select("qid", F.array_join(tokens(F.col("w")), " ").alias("term")).filter("term <> ''").distinct()


def texts(nodes: DataFrame) -> DataFrame:
    """(row, node, size, cols): of each row the number of all its tokens, and weight and tokens of the columns that are searched."""
    cols = F.array(*[F.struct(F.lit(w).alias("weight"), F.col(c).alias("toks")) for c, w in WEIGHTS.items() if c != "id"])
    size = sum((F.size(c) for c in WEIGHTS), F.lit(0))
    return nodes.select(F.col("id").alias("node"), *[tokens(F.col(c)).alias(c) for c in WEIGHTS]).select(F.monotonically_increasing_id().alias("row"), "node", size.alias("size"), cols.alias("cols"))


def term_hits(terms: DataFrame, held: DataFrame) -> DataFrame:
    """(term, node, tf): weighted hits of each term, whose last token is a prefix, in ``texts`` rows.

    What the terms mean is looked up among the distinct tokens and pairs of neighbouring tokens, by equal prefixes of the
    lengths that terms have; the rows then meet only what is meant, before any shuffle while that is small.
    """
    one = terms.select("term").distinct().withColumn("words", F.split("term", " ")).select("term", F.size("words").alias("k"), F.col("words")[0].alias("t0"), F.get("words", F.lit(1)).alias("cut"))
    # As many letters of the last token count; of longer phrases the second token counts whole (0).
    one = materialise(one.withColumn("l", F.when(F.col("k") == 1, F.length("term")).when(F.col("k") == 2, F.length("cut")).otherwise(0)), "one")
    single, phrase = one.filter("k = 1"), one.filter("k > 1")
    lengths: dict[bool, list[int]] = {False: [], True: []}
    for r in one.select((F.col("k") > 1).alias("long"), "l").distinct().collect():
        lengths[r["long"]].append(r["l"])
    cols = held.select("row", "node", F.posexplode("cols").alias("i", "c")).select("row", "node", "i", "c.weight", "c.toks")
    parts = [held.select(F.lit("").alias("term"), "node", F.lit(0.0).alias("tf")).filter("false")]
    if lengths[False]:
        words = cols.select("node", "weight", F.explode("toks").alias("token"))
        cuts = words.select("token").distinct().withColumn("l", F.explode(F.lit(sorted(lengths[False])))).filter("l <= length(token)").withColumn("term", F.substring("token", F.lit(1), F.col("l")))
        meant = materialise(cuts.join(sent(single.select("term")), "term", "left_semi").select("term", "token"), "meant")
        parts.append(words.join(sent(meant), "token").groupBy("term", "node").agg(F.sum("weight").alias("tf")))
    if lengths[True]:
        at = cols.select("*", F.posexplode(F.arrays_zip(F.col("toks").alias("t0"), F.slice("toks", F.lit(2), F.size("toks")).alias("t1"))).alias("pos", "z")).select(
            "row", "node", "i", "weight", "toks", "pos", "z.t0", "z.t1").filter("t1 IS NOT NULL")
        pairs = at.select("t0", "t1").join(sent(phrase.select("t0").distinct()), "t0", "left_semi").distinct().withColumn("l", F.explode(F.lit(sorted(lengths[True])))).filter("l <= length(t1)")
        cut = F.when(F.col("l") == 0, F.col("t1")).otherwise(F.substring("t1", F.lit(1), F.col("l")))
        meant2 = materialise(pairs.withColumn("cut", cut).join(sent(phrase), ["t0", "l", "cut"]).select("term", "k", "t0", "t1"), "meant2")
        met = at.join(sent(meant2), ["t0", "t1"]).filter((F.col("k") == 2) | F.startswith(F.array_join(F.slice("toks", F.col("pos") + 1, F.col("k")), " "), F.col("term")))
        # A phrase counts as often as it stands in the column without sharing a token with itself.
        place = F.sort_array(F.collect_list("pos"))
        told = F.aggregate("places", F.struct(F.lit(0).alias("free"), F.lit(0).alias("n")), lambda a, p: F.when(p >= a["free"], F.struct((p + F.col("k")).alias("free"), (a["n"] + 1).alias("n"))).otherwise(a))["n"]
        parts.append(met.groupBy("term", "k", "row", "node", "i", "weight").agg(place.alias("places")).groupBy("term", "node").agg(F.sum(F.col("weight") * told).alias("tf")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def bm25(queries: DataFrame, nodes: DataFrame, top: int) -> DataFrame:
    """(qid, node, score, rank): the ``top`` best nodes per query.

    A node that meets only the commonest term of a query is among the best only if it is among the best of that term, so of
    that term the ``top`` best are taken, once for all queries, and of the others all; these are scored over all terms.
    """
    held = materialise(texts(nodes), "texts")
    size = materialise(held.groupBy("node").agg(F.sum("size").alias("size")).filter("size > 0"), "sizes")
    mean, total = size.agg(F.avg("size"), F.count(F.lit(1))).first()
    terms = materialise(query_terms(queries), "terms")
    hits = materialise(term_hits(terms, held), "hits")
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.greatest(F.log((F.lit(total) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.lit(mean)))
    weighed = materialise(hits.join(df, "term").join(size, "node").select("term", "node", part.alias("part")), "weighed")
    asked = terms.join(df, "term")
    common = asked.groupBy("qid").agg(F.max(F.struct("df", "term")).alias("c")).select("qid", "c.term")
    first = best(weighed.select("term", "node", F.round("part", 6).alias("p")), "term", [F.desc("p"), F.col("node")], top)
    wanted = common.join(first, "term").select("qid", "node").unionByName(asked.join(common, ["qid", "term"], "left_anti").join(weighed, "term").select("qid", "node")).distinct()
    scored = wanted.join(terms, "qid").join(weighed, ["term", "node"]).groupBy("qid", "node").agg(F.round(F.sum("part"), 6).alias("score"))
    return best(scored, "qid", [F.desc("score"), F.col("node")], top)


def _grams(c: Column, n: int) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(n))))


def like_tiers(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """(qid, node, score): 1.0 equal, 0.9 prefix, 0.8 inside the name, 0.7 inside the qualified name, without regard to case
    (1.0 with it); for queries of two letters or more.

    A query meets the names that hold the rarest of its pieces; one with a piece that no name holds meets none.
    """
    n = nodes.select(F.col("id").alias("node"), "name", F.lower("name").alias("ln"), F.lower(F.coalesce("qualified_name", F.lit(""))).alias("lq")).withColumn("both", F.concat_ws("\n", "ln", "lq"))
    q = queries.select("qid", "query", F.lower("query").alias("lw")).filter("length(lw) >= 2")
    parts = []
    for size, some in ((2, q.filter("length(lw) = 2")), (3, q.filter("length(lw) > 2"))):
        asked = materialise(some.select("lw").distinct().withColumn("cut", F.explode(_grams(F.col("lw"), size))), "asked")
        at = n.withColumn("pos", F.explode(F.sequence(F.lit(1), F.greatest(F.length("both") - size + 1, F.lit(1))))).withColumn("cut", F.substring("both", F.col("pos"), F.lit(size)))
        first = F.expr("instr(both, cut) = pos")  # a name counts once for each of its pieces
        held = at.join(sent(asked.select("cut").distinct()), "cut", "left_semi").filter(first).groupBy("cut").agg(F.count(F.lit(1)).alias("n"))
        rare = asked.join(held, "cut", "left").groupBy("lw").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "cut")).alias("r")).filter("r.n > 0").select("lw", "r.cut")
        met = at.join(sent(materialise(rare, "rare")), "cut").filter(first & (F.contains("ln", "lw") | F.contains("lq", "lw"))).drop("cut", "pos", "both")
        parts.append(some.join(met, "lw"))
    score = (F.when(F.col("name") == F.col("query"), 1.0).when(F.col("ln").startswith(F.col("lw")), 0.9)
             .when(F.col("ln").contains(F.col("lw")), 0.8).when(F.col("lq").contains(F.col("lw")), 0.7))
    return parts[0].unionByName(parts[1]).select("qid", "node", score.alias("score"), F.length("name").alias("size")).filter("score IS NOT NULL")


def fuzzy_names(queries: DataFrame, names: DataFrame) -> DataFrame:
    """(qid, name, distance): names within one edit of queries of up to four letters, within two of longer ones.

    Of a name cut into three pieces one survives two edits unchanged and at most two places away, so pieces
    of names and shifted pieces of queries meet in an equi-join.  Names of two letters meet queries of three by
    the letters left when one is taken out.
    """
    every = names.select("name", F.lower("name").alias("ln")).distinct().withColumn("len", F.length("ln"))
    n = every.filter("len >= 3")
    third = F.floor(F.col("len") / 3).cast("int")
    pieces = F.array(*[F.struct(F.lit(i).alias("i"), F.substring(F.col("ln"), F.lit(1) + third * i, third if i < 2 else F.col("len") - 2 * third).alias("seg")) for i in range(3)])
    left = n.select("name", "ln", "len", F.explode(pieces).alias("p")).select("name", "ln", "len", "p.i", "p.seg")
    asked = queries.select("qid", F.lower("query").alias("lw"))
    q = asked.select("lw").distinct().filter("length(lw) >= 3").withColumn("len", F.explode(F.sequence(F.length("lw") - 2, F.length("lw") + 2))).filter("len >= 3")
    size = F.when(F.col("i") < 2, third).otherwise(F.col("len") - 2 * third)
    right = q.withColumn("i", F.explode(F.array(*[F.lit(i) for i in range(3)]))).withColumn("shift", F.explode(F.array(*[F.lit(k) for k in range(-2, 3)]))).withColumn(
        "at", F.lit(1) + third * F.col("i") + F.col("shift")).filter("at >= 1").withColumn("seg", F.substring(F.col("lw"), F.col("at"), size)).select("lw", "len", "i", "seg").distinct()
    limit = F.when(F.length("lw") <= 4, 1).otherwise(2)
    # Measured up to two edits (-1 beyond) and before the pairs are moved.
    j = right.join(left, ["len", "i", "seg"]).withColumn("distance", F.levenshtein("lw", "ln", 2)).filter((F.col("distance") >= 0) & (F.col("distance") <= limit)).select("lw", "name", "distance").distinct()
    near = j.join(asked, "lw").select("qid", "name", "distance")
    less = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.concat(F.substring("lw", F.lit(1), i - 1), F.substring("lw", i + 1, F.lit(3)))))
    short = queries.select("qid", F.lower("query").alias("lw")).filter("length(lw) = 3").select("qid", F.explode(less).alias("ln")).join(every.filter("len = 2"), "ln").select("qid", "name", F.lit(1).alias("distance"))
    return near.unionByName(short)


def kind_bonus(kind: str = "kind") -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in KIND_BONUS.items() for x in kv])[F.lower(F.trim(F.col(kind)))], F.lit(0))


def name_match_bonus(name: str, query: str) -> Column:
    """Points for how the name meets the query: equal, one of its words, prefix, all parts inside, inside."""
    n, q = F.lower(F.col(name)), F.lower(F.regexp_replace(F.col(query), r"\s", ""))
    long_enough = lambda c: F.filter(F.split(F.lower(c), r"\s+"), lambda t: F.length(t) >= 2)
    words, parts = long_enough(F.col(query)), long_enough(F.regexp_replace(F.col(query), r"[_.\-]", " "))
    return (F.when(n == q, 80).when((F.size(words) > 1) & F.array_contains(words, n), 60).when(n.startswith(q), F.round(10.0 + 30.0 * F.length(q) / F.length(n)).cast("int"))
            .when((F.size(parts) > 1) & F.forall(parts, lambda t: n.contains(t)), 15).when(n.contains(q), 10).otherwise(0))


def search_terms(query: Column) -> Column:
    """Distinct lower-case terms of three letters or more, cut before capitals and at ``_`` and ``.``."""
    spaced = F.regexp_replace(F.regexp_replace(query, r"([A-Z])", " $1"), r"[_.]", " ")
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(F.trim(spaced)), r"\s+"), lambda t: F.length(t) >= 3)))


def path_relevance(path: str, query: str) -> Column:
    from arbora.operators.graph import is_test_path

    p = F.lower(F.col(path))
    name = F.substring_index(p, "/", -1)
    folder = F.substring(p, F.lit(1), F.length(p) - F.length(name) - 1)
    terms = search_terms(F.col(query))
    points = F.aggregate(terms, F.lit(0), lambda a, t: a + F.when(name.contains(t), 10).when(folder.contains(t), 5).when(p.contains(t), 3).otherwise(0))
    about_tests = F.lower(F.col(query)).rlike("test|spec")
    return F.when(F.size(terms) == 0, 0).otherwise(points - F.when(~about_tests & is_test_path(path), 15).otherwise(0))


def best(rows: DataFrame, by: str, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows per ``by``, with their rank (each task sends k rows a key at most)."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= k)


def exact_names(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """(qid, node): nodes named like a word of the query without regard to case, the twenty smallest ids per word."""
    words = queries.select("qid", F.explode(F.array_distinct(F.split("query", r"\s+"))).alias("word")).filter("length(word) >= 2").select("qid", F.lower("word").alias("key"))
    wanted = nodes.select(F.lower("name").alias("key"), F.col("id").alias("node")).join(sent(words.select("key").distinct()), "key", "left_semi")
    named = best(wanted, "key", [F.col("node")], 20)
    return words.join(named, "key").select("qid", "node").distinct()


def kept(nodes: DataFrame) -> DataFrame:
    """What a search reads of the nodes, written once."""
    return materialise(nodes.select("id", "kind", "name", "qualified_name", "docstring", "signature", "file_path"), "nodes")


def search(queries: DataFrame, nodes: DataFrame, limit: int = 10) -> DataFrame:
    """(qid, node, score, rank): BM25, else substrings, else near names; nodes that bear a word of the query as their
    name join with the best score; then the bonuses by kind, name and path."""
    return search_kept(queries, kept(nodes), limit)


def search_kept(queries: DataFrame, nodes: DataFrame, limit: int = 10) -> DataFrame:
    """``search`` over nodes that are read several times at no other cost."""
    base = materialise(bm25(queries, nodes, max(5 * limit, 100)).select("qid", "node", "score"), "ranked")
    rest = queries.join(base.select("qid").distinct(), "qid", "left_anti")
    like = materialise(best(like_tiers(rest, nodes), "qid", [F.desc("score"), F.col("size"), F.col("node")], limit).select("qid", "node", "score"), "inside")
    rest2 = rest.join(like.select("qid").distinct(), "qid", "left_anti")
    names = materialise(best(fuzzy_names(rest2, nodes.select("name")), "qid", [F.col("distance"), F.col("name")], max(2 * limit, 50)).drop("rank"), "names")
    bearers = best(nodes.select("name", F.col("id").alias("node")).join(sent(names.select("name").distinct()), "name", "left_semi"), "name", [F.col("node")], 5).drop("rank")
    near = best(names.join(bearers, "name"), "qid", [F.col("distance"), F.col("name"), F.col("node")], limit).select("qid", "node", (1.0 / (1 + F.col("distance"))).alias("score"))
    hits = materialise(base.unionByName(like).unionByName(near), "found")
    top = hits.groupBy("qid").agg(F.max("score").alias("score"))
    more = exact_names(queries, nodes).join(top, "qid").join(hits.select("qid", "node"), ["qid", "node"], "left_anti").select("qid", "node", "score")
    j = hits.unionByName(more).join(nodes.select(F.col("id").alias("node"), "kind", "name", "file_path"), "node").join(queries, "qid")
    total = F.round(F.col("score") + kind_bonus() + name_match_bonus("name", "query") + path_relevance("file_path", "query"), 6)
    return best(j.select("qid", "node", total.alias("score")), "qid", [F.desc("score"), F.col("node")], limit)


# ------------------------------------------------------------------ parsing one query on the driver


@dataclass
class ParsedQuery:
    text: str = ""
    kinds: list[str] = field(default_factory=list)
    languages: list[str] = field(default_factory=list)
    paths: list[str] = field(default_factory=list)
    names: list[str] = field(default_factory=list)


def parse_query(raw: str, kinds: frozenset[str] = frozenset(KIND_BONUS) | {"file", "constructor", "type"}, languages: frozenset[str] = frozenset(
        {"python", "javascript", "typescript", "java", "csharp", "go", "rust", "c", "cpp", "php", "ruby", "swift", "kotlin", "dart", "lua", "scala", "vue", "svelte"})) -> ParsedQuery:
    """``kind:``, ``lang:``, ``path:`` and ``name:`` tokens (values may be quoted); all else is text.  Never fails."""
    out, words = ParsedQuery(), []
    for m in re.finditer(r'(\w+):"([^"]*)"|"([^"]*)"|(\S+)', raw):
        key, value = (m[1], m[2]) if m[1] else ("", m[3]) if m[3] is not None else m[4].partition(":")[::2] if ":" in m[4] else ("", m[4])
        key = key.lower()
        if key == "kind" and value.lower() in kinds:
            out.kinds.append(value.lower())
        elif key in ("lang", "language") and re.sub(r"[^a-z0-9]", "", value.lower()) in languages:
            out.languages.append(re.sub(r"[^a-z0-9]", "", value.lower()))
        elif key == "path" and value:
            out.paths.append(value)
        elif key == "name" and value:
            out.names.append(value)
        else:
            words.append(m[0].strip('"'))
    out.text = " ".join(words)
    return out


def stem_variants(word: str) -> list[str]:
    w, out = word.lower(), []
    if w.endswith("caching"):
        out.append(w[:-7] + "cache")
    if w.endswith("ing") and len(w) > 4:
        out.append(w[:-3])
    if w.endswith("s") and len(w) > 3:
        out.append(w[:-1])
    if w.endswith("ed") and len(w) > 4:
        out += [w[:-2], w[:-2] + "e"]
    return out
