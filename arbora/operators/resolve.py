"""Reference resolution: imports first, then five ways to match a name, the first that matches; the surer of both wins.

Scores depend on few features of a node, so the nodes of one name are first folded to the best per feature
combination (language, kind group, exported); a reference to a frequent name then meets a handful of rows
instead of all bearers of the name.  Bearers in the reference's own file are joined by (name, file).
Ties are broken by the smaller id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.session import materialise

# Names that stand for the language or its standard library.
JS_NAMES = ("console window document global process Promise Array Object String Number Boolean Date Math JSON RegExp Error Map Set setTimeout setInterval clearTimeout "
            "clearInterval fetch require module exports __dirname __filename useState useEffect useContext useReducer useCallback useMemo useRef useLayoutEffect "
            "useImperativeHandle useDebugValue").split()
JS_PREFIXES = ("console.", "Math.", "JSON.")
PY_NAMES = "print len range str int float list dict set tuple open input type isinstance hasattr getattr setattr super self cls None True False".split()
PY_TYPES = "list dict set tuple str int float bool bytes bytearray frozenset object super".split()
PY_METHODS = ("append extend insert remove pop clear sort reverse copy update keys values items get add discard union intersection difference split join strip replace lower upper "
              "startswith endswith find index count format encode decode read write readline readlines close flush").split()
GO_NAMES = ("make new len cap append copy delete close panic recover print println nil true false iota int int8 int16 int32 int64 uint uint8 uint16 uint32 uint64 uintptr float32 "
            "float64 string bool byte rune any error").split()
GO_PACKAGES = ("fmt os io net http log math sort sync time path bytes strings strconv errors context json xml csv html template regexp reflect runtime testing flag bufio crypto encoding "
               "filepath hash mime rand signal sql syscall unicode unsafe atomic").split()
CS_NAMES = ("bool byte sbyte char decimal double float int uint long ulong short ushort nint nuint string object void var dynamic unmanaged delegate Boolean Byte SByte Char Decimal Double "
            "Single Int16 Int32 Int64 UInt16 UInt32 UInt64 IntPtr UIntPtr String Object Task ValueTask Void").split()
#: The language that a file ending stands for when references are matched.
ENDINGS = {"ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "py": "python", "go": "go", "rs": "rust", "java": "java", "rb": "ruby", "php": "php", "cs": "csharp"}
CALLABLE = ("function", "method")
TYPES = ("class", "struct", "interface")


def path_language(path: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in ENDINGS.items() for x in kv])[F.regexp_extract(path, r"\.([A-Za-z]+)$", 1)], F.lit("unknown"))


def capitalised(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, F.lit(2), F.length(c)))


def prepared(refs: DataFrame) -> DataFrame:
    """(ref, name, ref_kind, line, file_path, lang) of the references."""
    return refs.select(F.col("id").alias("ref"), F.col("reference_name").alias("name"), F.lower(F.trim("reference_kind")).alias("ref_kind"), F.col("line").alias("ref_line"),
                       F.col("file_path").alias("ref_file"), path_language(F.coalesce("file_path", F.lit(""))).alias("lang"), "from_node_id").filter("name IS NOT NULL")


def candidates(nodes: DataFrame) -> DataFrame:
    from arbora.sources.tables import norm_language

    return nodes.select(F.col("id").alias("node"), "kind", "name", "qualified_name", "file_path", F.col("start_line"), norm_language().alias("node_lang"), F.coalesce("is_exported", F.lit(False)).alias("exported")).distinct()


def is_builtin(known: DataFrame, r: DataFrame) -> DataFrame:
    """(ref, builtin): references to names of the language itself.  ``known`` (name) are the indexed names."""
    name, dot = F.col("name"), F.instr("name", ".")
    first, rest = F.substring_index("name", ".", 1), F.when(dot > 0, F.substring(F.col("name"), dot + 1, F.length("name")))
    j = r.withColumn("cap", F.when(dot > 0, capitalised(first))).join(known.select(F.col("name").alias("cap"), F.lit(True).alias("cap_known")).distinct(), "cap", "left")
    js = F.col("lang").isin("typescript", "javascript") & (name.isin(*JS_NAMES) | name.startswith(JS_PREFIXES[0]) | name.startswith(JS_PREFIXES[1]) | name.startswith(JS_PREFIXES[2]))
    py = (F.col("lang") == "python") & (name.isin(*PY_NAMES) | name.isin(*PY_METHODS) | ((dot > 0) & (first.isin(*PY_TYPES) | (rest.isin(*PY_METHODS) & F.col("cap_known").isNull()))))
    go = (F.col("lang") == "go") & (name.isin(*GO_NAMES) | ((dot > 0) & first.isin(*GO_PACKAGES)))
    cs = (F.col("lang") == "csharp") & name.isin(*CS_NAMES)
    return j.select("ref", F.coalesce(js | py | go | cs, F.lit(False)).alias("builtin"))


def is_known(known: DataFrame, r: DataFrame) -> DataFrame:
    """(ref): references of which the name or one of its parts is an indexed name."""
    dot, sep, slash = F.instr("name", "."), F.instr("name", "::"), F.instr("name", "/")
    rest = lambda at, n: F.substring(F.col("name"), at + n, F.length("name"))
    keys = F.array_compact(F.array(
        F.col("name"), F.when(dot > 0, F.substring_index("name", ".", 1)), F.when(dot > 0, rest(dot, 1)), F.when(dot > 0, capitalised(F.substring_index("name", ".", 1))),
        F.when(sep > 0, F.substring_index("name", "::", 1)), F.when(sep > 0, rest(sep, 2)), F.when(slash > 0, F.substring_index("name", "/", -1))))
    return r.select("ref", F.explode(F.array_distinct(keys)).alias("name")).join(known.select("name").distinct(), "name", "left_semi").select("ref").distinct()


def _first_in_file(n: DataFrame) -> DataFrame:
    return n.groupBy("file_path").agg(F.min(F.struct("start_line", "node")).alias("m")).select("file_path", F.col("m.node").alias("node"))


def match_file_path(r: DataFrame, n: DataFrame, paths: DataFrame) -> DataFrame:
    """(ref, node, confidence): the reference names a file: .95 by path, .85 by a unique ending, .70 by a unique file name.

    Every path is entered once under each of its endings, counted per ending, so a frequent file name is one row.
    """
    first = _first_in_file(n)
    parts = F.split("path", "/")
    ends = paths.select("path").distinct().select("path", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("at", "name"))
    key = ends.filter("name <> ''").groupBy("name").agg(F.count(F.lit(1)).alias("files"), F.min("path").alias("file_path"))
    q = r.filter((F.instr("name", "/") > 0) | ((F.instr("name", ".") > 0) & (F.instr("name", "::") == 0))).select("ref", "name")
    whole = q.join(key, "name").select("ref", "file_path", F.when(F.col("file_path") == F.col("name"), 0.95).when(F.col("files") == 1, 0.85).alias("confidence")).filter("confidence IS NOT NULL")
    left = q.join(whole.select("ref"), "ref", "left_anti").select("ref", F.substring_index("name", "/", -1).alias("name"))
    base = left.join(key.filter("files = 1"), "name").select("ref", "file_path", F.lit(0.70).alias("confidence"))
    return whole.unionByName(base).join(first, "file_path").select("ref", "node", "confidence")


def match_qualified(r: DataFrame, n: DataFrame) -> DataFrame:
    """(ref, node, confidence): .95 by equal qualified name, .85 where a qualified name ends in it."""
    q = r.filter((F.instr("name", "::") > 0) | (F.instr("name", ".") > 0)).select("ref", F.col("name").alias("wanted")).withColumn("last", F.substring_index("wanted", "::", -1))
    exact = q.join(n.select("node", F.col("qualified_name").alias("wanted")), "wanted").groupBy("ref").agg(F.min("node").alias("node")).withColumn("confidence", F.lit(0.95))
    ending = q.join(n.select("node", F.col("name").alias("last"), "qualified_name"), "last").filter(F.col("qualified_name").endswith(F.col("wanted"))).groupBy("ref").agg(
        F.min("node").alias("node")).withColumn("confidence", F.lit(0.85))
    return exact.unionByName(ending.join(exact.select("ref"), "ref", "left_anti"))


def _folded(n: DataFrame, key: str) -> DataFrame:
    """The smallest node per key and combination of the features that a score looks at."""
    group = F.when(F.col("kind").isin(*CALLABLE), F.col("kind")).when(F.col("kind").isin("class", "struct"), F.col("kind")).otherwise("other")
    return n.groupBy(key, "node_lang", group.alias("kind"), "exported").agg(F.min("node").alias("node"))


def _points(lang: Column) -> Column:
    k, r = F.col("kind"), F.col("ref_kind")
    by_kind = (F.when((r == "calls") & k.isin(*CALLABLE), 25).when((r == "instantiates") & k.isin("class", "struct"), 25).when((r == "decorates") & (k == "function"), 25)
               .when((r == "decorates") & (k == "class"), 15).otherwise(0))
    return F.when(lang, 50).otherwise(-80) + by_kind + F.when(F.col("exported"), 10).otherwise(0)


def scored(r: DataFrame, n: DataFrame) -> DataFrame:
    """(ref, node, score): the best bearer of the name for each reference (ref, name, ...)."""
    same_lang = F.col("node_lang") == F.col("lang")
    anywhere = r.join(_folded(n, "name"), "name").select("ref", "node", _points(same_lang).alias("score"))
    near = F.when(F.col("ref_line").isNull(), 0).otherwise(20 - F.least(F.abs(F.col("start_line") - F.col("ref_line")), F.lit(20)))
    here = r.join(n.withColumn("ref_file", F.col("file_path")), ["name", "ref_file"]).select("ref", "node", (_points(same_lang) + 100 + near).alias("score"))
    w = Window.partitionBy("ref").orderBy(F.desc("score"), "node")
    return anywhere.unionByName(here).withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def match_exact_name(r: DataFrame, n: DataFrame) -> DataFrame:
    """(ref, node, confidence): one bearer .9 (.5 in another language); of many the best by score."""
    bearers = n.groupBy("name").agg(F.count(F.lit(1)).alias("bearers"), F.first("node_lang").alias("only_lang"))
    j = scored(r, n).join(r.select("ref", "name", "lang"), "ref").join(bearers, "name")
    one = F.when(F.col("only_lang") == F.col("lang"), 0.9).otherwise(0.5)
    return j.select("ref", "node", F.when(F.col("bearers") == 1, one).otherwise(F.round(F.least(F.lit(0.9), 0.4 + F.col("score") / 100.0 * 0.5), 6)).alias("confidence"))


def split_call(r: DataFrame) -> DataFrame:
    """Receiver before the first ``::`` or else the last ``.``; the member after it."""
    sep = F.instr("name", "::")
    receiver = F.when(sep > 0, F.substring(F.col("name"), F.lit(1), sep - 1)).when(F.instr("name", ".") > 0, F.regexp_extract("name", r"^(.*)\.[^.]*$", 1))
    member = F.when(sep > 0, F.substring(F.col("name"), sep + 2, F.length("name"))).when(F.instr("name", ".") > 0, F.regexp_extract("name", r"^.*\.([^.]*)$", 1))
    return r.withColumn("receiver", receiver).withColumn("member", member).filter("receiver <> '' AND member <> ''")


def match_method_call(r: DataFrame, n: DataFrame) -> DataFrame:
    """(ref, node, confidence): member in the file of the receiver's type .85, of its capitalised form .75, else the best member of that name .65."""
    q = split_call(r)
    members = n.filter(F.col("kind").isin(*CALLABLE)).groupBy(F.col("name").alias("member"), "file_path").agg(F.min("node").alias("node"))

    def by(owner: DataFrame, key: Column, confidence: float) -> DataFrame:
        o = owner.select(F.col("name").alias("owner"), "file_path").distinct()
        return q.select("ref", "member", key.alias("owner")).join(o, "owner").join(members, ["member", "file_path"]).groupBy("ref").agg(F.min("node").alias("node")).withColumn("confidence", F.lit(confidence))

    direct = by(n.filter(F.col("kind").isin(*TYPES)), F.col("receiver"), 0.85)
    q2 = capitalised(F.col("receiver"))
    cap = by(n, F.when(q2 != F.col("receiver"), q2), 0.75).join(direct.select("ref"), "ref", "left_anti")
    done = direct.unionByName(cap)
    left = q.join(done.select("ref"), "ref", "left_anti").withColumn("name", F.col("member"))
    last = scored(left, n.filter(F.col("kind").isin(*CALLABLE))).select("ref", "node", F.lit(0.65).alias("confidence"))
    return done.unionByName(last)


def match_fuzzy_lower(r: DataFrame, n: DataFrame) -> DataFrame:
    """(ref, node, confidence): the name without regard to case; .5, or .3 in another language."""
    low = n.filter(F.col("kind").isin("function", "method", "class")).groupBy(F.lower("name").alias("low")).agg(F.min(F.struct("node", "node_lang")).alias("m"))
    return r.select("ref", "lang", F.lower("name").alias("low")).join(low, "low").select("ref", F.col("m.node").alias("node"), F.when(F.col("m.node_lang") == F.col("lang"), 0.5).otherwise(0.3).alias("confidence"))


def edge_kind(ref_kind: Column) -> Column:
    known = ("calls", "imports", "contains", "extends", "implements", "uses", "instantiates", "exports", "renders", "resolves")
    return F.when(ref_kind == "inherits", "extends").when(ref_kind.isin(*known), ref_kind).otherwise("references")


def match_import(r: DataFrame, n: DataFrame, bound: DataFrame) -> DataFrame:
    """(ref, node, confidence): the name is bound by an import of the file: .9 an exported bearer of the imported name, .7 any bearer of the local one.

    ``bound``: (path, local, original) of the import statements.
    """
    hit = r.select("ref", F.col("name").alias("local"), F.col("ref_file").alias("path")).join(bound, ["path", "local"]).select("ref", "local", F.coalesce("original", "local").alias("name"))
    sure = hit.join(n.filter("exported").groupBy("name").agg(F.min("node").alias("node")), "name").groupBy("ref").agg(F.min("node").alias("node")).withColumn("confidence", F.lit(0.9))
    rest = hit.join(sure.select("ref"), "ref", "left_anti").select("ref", F.col("local").alias("name"))
    some = rest.join(n.groupBy("name").agg(F.min("node").alias("node")), "name").groupBy("ref").agg(F.min("node").alias("node")).withColumn("confidence", F.lit(0.7))
    return sure.unionByName(some)


def import_named(r: DataFrame, bound: DataFrame) -> DataFrame:
    """(ref): references whose name, or its part before the first point, an import of their file binds."""
    keys = F.array_distinct(F.array("name", F.substring_index("name", ".", 1)))
    return r.select("ref", F.col("ref_file").alias("path"), F.explode(keys).alias("local")).join(bound.select("path", "local"), ["path", "local"], "left_semi").select("ref").distinct()


def resolve(refs: DataFrame, nodes: DataFrame, paths: DataFrame, bound: DataFrame) -> DataFrame:
    """(ref, source, target, kind, confidence, method).

    Of the five ways by name the first that matches counts, below .3 it does not; an import of .9 comes before it,
    a weaker one where it is surer.
    """
    n = materialise(candidates(nodes), "candidates")  # every way reads both
    r = prepared(refs)
    bound = materialise(bound, "bound")
    wanted = is_known(n, r).unionByName(import_named(r, bound)).distinct()
    live = materialise(r.join(is_builtin(n, r).filter("NOT builtin").select("ref"), "ref", "left_semi").join(wanted, "ref", "left_semi"), "live")
    ways = [("file_path", match_file_path(live, n, paths)), ("qualified", match_qualified(live, n)), ("method_call", match_method_call(live, n)),
            ("exact_name", match_exact_name(live, n)), ("fuzzy_lower", match_fuzzy_lower(live, n))]
    rows = None
    for place, (name, df) in enumerate(ways):
        one = df.select("ref", "node", F.col("confidence").cast("double").alias("confidence"), F.lit(name).alias("method"), F.lit(place).alias("place"))
        rows = one if rows is None else rows.unionByName(one)
    by_name = rows.groupBy("ref").agg(F.min(F.struct("place", "node", "confidence", "method")).alias("m")).filter("m.confidence >= 0.3").select("ref", "m.node", "m.confidence", "m.method", F.lit(1).alias("late"))
    by_import = match_import(live, n, bound).select("ref", "node", "confidence", F.lit("import").alias("method"), F.lit(0).alias("late"))
    first = F.when((F.col("late") == 0) & (F.col("confidence") >= 0.9), 1).otherwise(0)
    best = by_name.unionByName(by_import).groupBy("ref").agg(F.max(F.struct(first.alias("first"), "confidence", "late", "node", "method")).alias("m"))
    return best.join(r, "ref").select("ref", F.col("from_node_id").alias("source"), F.col("m.node").alias("target"), edge_kind(F.col("ref_kind")).alias("kind"),
                                      F.col("m.confidence").alias("confidence"), F.col("m.method").alias("method"))


def structural_implements(iface_methods: DataFrame, type_methods: DataFrame) -> DataFrame:
    """(type_id, iface_id, confidence): types whose methods (name, arity) cover all of an interface's.

    Relational division: an equi-join on (name, arity) and a count.  .75 for two methods or more, .55 for one.
    """
    need = iface_methods.select("iface_id", "name", "arity").distinct()
    size = need.groupBy("iface_id").agg(F.count(F.lit(1)).alias("needed"))
    have = type_methods.select("type_id", "name", "arity").distinct()
    got = need.join(have, ["name", "arity"]).filter("iface_id <> type_id").groupBy("type_id", "iface_id").agg(F.count(F.lit(1)).alias("n"))
    return got.join(size, "iface_id").filter("n = needed").select("type_id", "iface_id", F.when(F.col("needed") >= 2, 0.75).otherwise(0.55).alias("confidence"))


#: What a name's last word says about it: kinds, the folder it is expected in, confidence there; .70 elsewhere.
CONVENTIONS = (
    ("Service", "/services/", 0.85), ("Repository", "/repositories/", 0.85), ("Controller", "/controllers/", 0.85), ("Store", "/stores/", 0.85),
    ("Handler", "/handlers/", 0.80), ("Component", "/components/", 0.85), ("Module", "/modules/", 0.80), ("Guard", "/guards/", 0.85), ("Pipe", "/pipes/", 0.75), ("View", "/views/", 0.80), ("Job", "/jobs/", 0.80),
)


def by_convention(r: DataFrame, n: DataFrame) -> DataFrame:
    """(ref, node, confidence): types found by the last word of the name, first in the folder that the word stands for."""
    last = F.regexp_extract("name", r"([A-Z][a-z]+)$", 1)
    folder = F.create_map(*[F.lit(x) for w, f, _ in CONVENTIONS for x in (w, f)])
    sure = F.create_map(*[F.lit(x) for w, _, c in CONVENTIONS for x in (w, c)])
    home = F.contains(F.col("file_path"), folder[last])
    per = n.filter(F.col("kind").isin("class", "struct", "interface") & last.isin(*[c[0] for c in CONVENTIONS])).groupBy("name").agg(
        F.min(F.struct((~F.coalesce(home, F.lit(False))).alias("away"), "node")).alias("m"))
    return r.select("ref", "name").join(per, "name").select("ref", F.col("m.node").alias("node"), F.when(F.col("m.away"), 0.70).otherwise(sure[last]).alias("confidence"))
