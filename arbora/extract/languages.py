"""File endings, languages and the scan of a source tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The language of a file ending.
ENDINGS = {
    "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "py": "python", "pyi": "python", "go": "go", "rs": "rust", "java": "java", "cs": "csharp", "c": "c", "h": "cpp", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp",
    "php": "php", "rb": "ruby", "swift": "swift", "kt": "kotlin", "kts": "kotlin", "dart": "dart", "lua": "lua", "luau": "luau", "pas": "pascal", "dpr": "pascal", "scala": "scala",
    "sc": "scala", "svelte": "svelte", "vue": "vue", "cshtml": "razor", "razor": "razor", "liquid": "liquid", "dfm": "dfm",
}
SKIPPED_FOLDERS = ("node_modules", "target")
MAX_BYTES = 1 << 20
CONFIG_FILES = ("Cargo.toml", "package.json", "pyproject.toml", "setup.py", "requirements.txt")


def language_of(path: str) -> str | None:
    name = path.rsplit("/", 1)[-1]
    return ENDINGS.get(name.rsplit(".", 1)[-1].lower()) if "." in name else None


def language(path: Column) -> Column:
    """The language of a path, null if its ending is not known."""
    return F.create_map(*[F.lit(x) for kv in ENDINGS.items() for x in kv])[F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))]


def is_config_file(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    return name.isin(*CONFIG_FILES) | name.endswith(".csproj") | name.startswith("tsconfig") | name.startswith("jsconfig")


def scan_source_tree(spark: SparkSession, root: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """(path, language, size, modified_at, content_hash, text) of the source files under ``root``.

    Hidden and skipped folders, ignored patterns (globs), unknown endings, files above 1 MiB and texts that are
    not UTF-8 are left out; a byte-order mark is cut, line ends are kept.
    """
    from arbora.plans.graph_queries import glob_regex

    b = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace("path", "^file:(//)?", "")
    rel = F.substring(path, F.lit(len(root.rstrip("/")) + 1), F.length(path))
    keep = ~rel.rlike(r"/\.") & language(path).isNotNull() & (F.col("length") <= MAX_BYTES)
    for folder in SKIPPED_FOLDERS:
        keep = keep & ~rel.contains(f"/{folder}/")
    for g in ignore:
        keep = keep & ~F.lower(rel).rlike(glob_regex(g if g.startswith("*") else "*/" + g))
    rows = b.filter(keep & F.is_valid_utf8(F.col("content").cast("string")))
    text = F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "")
    return rows.select(path.alias("path"), language(path).alias("language"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified_at"),
                       F.sha2("content", 256).alias("content_hash"), text.alias("text"))
