"""Import statements, path aliases and the probing of relative imports."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Endings that are tried in this order behind a relative import without one.
PROBES = ("", ".ts", ".tsx", ".mts", ".js", ".jsx", ".mjs", ".d.ts", ".vue", ".svelte", "/index.ts", "/index.tsx", "/index.js", "/index.mjs")
JS_FROM = r"""from\s+["']([^"']+)["']"""


def script_imports(documents: DataFrame) -> DataFrame:
    """(path, module) of the scripts' import statements."""
    d = documents.filter(F.col("path").rlike(r"\.(m?[jt]s|[jt]sx)$") & F.col("text").isNotNull())
    return d.select("path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(JS_FROM), 1))).alias("module"))


def python_imports(documents: DataFrame) -> DataFrame:
    d = documents.filter(F.col("path").endswith(".py") & F.col("text").isNotNull())
    return d.select("path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?m)^(?:from|import)\s+([\w.]+)"), 1))).alias("module"))


def go_imports(documents: DataFrame) -> DataFrame:
    d = documents.filter(F.col("path").endswith(".go") & F.col("text").isNotNull())
    return d.select("path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r'(?m)^import\s+"([^"]+)"'), 1))).alias("module"))


#: The forms of import statements by language; group 1 is a list of names, or (alias, name) in the order given.
NAMED = r"""import\s*\{([^}]+)\}\s*from\s*['"][^'"]+['"]"""
DEFAULT = r"""import\s+([A-Za-z_$][A-Za-z0-9_$]*)\s+from\s*['"][^'"]+['"]"""
NAMESPACE = r"""import\s*\*\s+as\s+([A-Za-z_$][A-Za-z0-9_$]*)\s+from\s*['"][^'"]+['"]"""
REQUIRED = r"""(?:const|let|var)\s*\{([^}]+)\}\s*=\s*require\s*\(\s*['"][^'"]+['"]\s*\)"""
PY_FROM = r"(?m)^[ \t]*from[ \t]+\S+[ \t]+import[ \t]+([^\r\n#]+)"
PY_IMPORT = r"(?m)^[ \t]*import[ \t]+([^\r\n#,;]+)"
GO_IMPORT = r"""(?m)^(?:import\s+|[ \t]+)((?:\w+[ \t]+)?"[^"\n]+")[ \t]*\r?$"""
PHP_USE = r"(?m)^use\s+([\w\\]+(?:\s+as\s+\w+)?)\s*;"
_SCRIPT = r"\.(?:m?[jt]s|[jt]sx)$"


def bindings(documents: DataFrame) -> DataFrame:
    """(path, local, original): the names that import statements bind; original is null where the whole module is bound."""
    d = documents.filter("path IS NOT NULL AND text IS NOT NULL").select("path", "text")
    every = lambda *patterns: F.flatten(F.array(*[F.regexp_extract_all("text", F.lit(x), 1) for x in patterns]))
    items = lambda c: F.flatten(F.transform(c, lambda x: F.split(x, ",")))
    script, py, go, php = (F.col("path").rlike(x) for x in (_SCRIPT, r"\.py$", r"\.go$", r"\.php$"))
    last = lambda c, sign: F.substring_index(c, sign, -1)
    named = d.select("path", F.explode(F.when(script, items(every(NAMED, REQUIRED))).when(py, items(every(PY_FROM)))).alias("x")).withColumn("x", F.regexp_replace(F.trim(F.regexp_replace("x", r"[()\s]+", " ")), r"^type ", ""))
    lists = named.select("path", F.regexp_extract("x", r"([\w$]+)$", 1).alias("local"), F.regexp_extract("x", r"^([\w$]+)", 1).alias("original"))
    whole = d.select("path", F.explode(F.when(script, every(DEFAULT, NAMESPACE)).when(py, every(PY_IMPORT)).when(go, every(GO_IMPORT)).when(php, every(PHP_USE))).alias("x")).withColumn("x", F.trim("x"))
    alias = F.regexp_extract("x", r"\sas\s+(\w+)$", 1)
    local = (F.when(alias != "", alias).when(go & F.col("x").rlike(r"^\w"), F.regexp_extract("x", r"^(\w+)", 1)).when(go, last(F.regexp_replace("x", '"', ""), "/"))
             .when(php, last(F.col("x"), "\\")).otherwise(F.col("x")))
    original = F.when(php, F.regexp_extract("x", r"([\w]+)(?:\s+as\s+\w+)?$", 1))
    modules = whole.select("path", local.alias("local"), original.alias("original"))
    return lists.unionByName(modules).filter("local <> ''").distinct()


def joined(folder: Column, relative: Column) -> Column:
    """``folder/relative`` with ``.`` and up to eight ``..`` steps taken."""
    p = F.regexp_replace(F.concat(folder, F.lit("/"), relative), r"/\./", "/")
    for _ in range(8):
        p = F.regexp_replace(p, r"/[^/]+/\.\.(?=/|$)", "")
    return p


def probe(imports: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, module, target): the first file that a relative import can stand for."""
    rel = imports.filter(F.col("module").startswith("."))
    base = joined(F.regexp_replace("path", r"/[^/]*$", ""), F.col("module"))
    tries = rel.select("path", "module", F.posexplode(F.array(*[F.concat(base, F.lit(x)) for x in PROBES])).alias("place", "target"))
    hit = tries.join(paths.select(F.col("path").alias("target")).distinct(), "target", "left_semi")
    w = Window.partitionBy("path", "module").orderBy("place")
    return hit.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("path", "module", "target")


def read_jsonc(text: str) -> dict:
    """JSON with comments and trailing commas."""
    bare = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*[\s\S]*?\*/', lambda m: m[1] or "", text)
    return json.loads(re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', lambda m: m[1] or "", bare))


def path_aliases(config: str) -> list[tuple[str, list[str]]]:
    """(pattern, targets) of a project file's ``paths``, the longest literal part first."""
    options = read_jsonc(config).get("compilerOptions", {})
    base = options.get("baseUrl", ".").strip("./")
    pairs = [(k, [f"{base}/{t}".lstrip("/") if base else t.removeprefix("./") for t in v]) for k, v in options.get("paths", {}).items()]
    return sorted(pairs, key=lambda p: (-len(p[0].replace("*", "")), p[0]))


def apply_alias(module: str, aliases: list[tuple[str, list[str]]]) -> list[str]:
    for pattern, targets in aliases:
        m = re.fullmatch(re.escape(pattern).replace(r"\*", "(.*)"), module)
        if m:
            return [t.replace("*", m[1]) if m.groups() else t for t in targets]
    return ["src/" + module[2:]] if module.startswith("@/") else []
