"""Routes and bindings that web frameworks declare in source texts, and the algebra of their paths."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from arbora.extract.comments import balanced, strip_comments
from arbora.extract.languages import language_of

VERBS = "get|post|put|delete|patch|options|head|all|any"
ROUTES = "route_id string, file_path string, line int, verb string, path string, handler string, framework string"


def join_prefix(*parts: str) -> str:
    """Parts without their slashes, joined, with one in front."""
    return "/" + "/".join(p.strip("/") for p in parts if p and p.strip("/"))


def compose_nested(parent: str, child: str) -> str:
    """An absolute child stands alone; an empty one is its parent."""
    return child if child.startswith("/") else parent if not child else join_prefix(parent, child)


def file_route(path: str) -> str:
    """The address of a page file: ``[...x]`` -> ``*x``, ``[[x]]`` -> ``:x?``, ``[x]`` -> ``:x``, no ``index``."""
    p = re.sub(r"\.\w+$", "", path)
    p = re.sub(r"\[\.\.\.(\w+)\]", r"*\1", p)
    p = re.sub(r"\[\[(\w+)\]\]", r":\1?", p)
    p = re.sub(r"\[(\w+)\]", r":\1", p)
    return re.sub(r"/index$", "", "/" + p.strip("/")) or "/"


def expand_tokens(template: str, controller: str, action: str) -> str:
    """``[controller]`` in lower case without its suffix, ``[action]`` in kebab case."""
    kebab = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "-", action).lower()
    return template.replace("[controller]", re.sub(r"Controller$", "", controller).lower()).replace("[action]", kebab)


def group_prefixes(text: str, pattern: str) -> dict[str, str]:
    """Variables that stand for route groups with their full prefixes; groups of groups to a fixpoint."""
    raw = {m["var"]: (m["parent"], m["sub"]) for m in re.finditer(pattern, text)}
    out: dict[str, str] = {}
    for var in raw:
        parts, at, seen = [], var, set()
        while at in raw and at not in seen:
            seen.add(at)
            parts.append(raw[at][1])
            at = raw[at][0]
        out[var] = join_prefix(*reversed(parts))
    return out


def _tail(args: str) -> str:
    """The last identifier of the last argument."""
    last = re.split(r",(?![^(\[{]*[)\]}])", args)[-1]
    m = re.findall(r"[A-Za-z_$][\w$]*", re.sub(r"['\"].*?['\"]", "", last))
    return m[-1] if m else ""


def routes(path: str, text: str) -> list[tuple]:
    """(line, verb, address, handler, framework) of the routes in one text."""
    language = language_of(path)
    src = strip_comments(text, language or "c")
    out: list[tuple] = []
    line = lambda at: src.count("\n", 0, at) + 1

    def add(at: int, verb: str, address: str, handler: str, framework: str) -> None:
        out.append((line(at), "ANY" if verb.lower() in ("all", "any", "handle", "handlefunc", "use", "request") else verb.upper(), address or "/", handler, framework))

    if language in ("javascript", "typescript"):
        for m in re.finditer(rf"\b(?:app|router|server)\.({VERBS})\s*\(\s*['\"`]([^'\"`]*)['\"`]\s*,", src):
            end = balanced(src, src.index("(", m.start()))
            add(m.start(), m[1], m[2], _tail(src[m.end() : end - 1]) if end > 0 else "", "express")
        for c in re.finditer(r"@Controller\(\s*(?:['\"]([^'\"]*)['\"])?\s*\)[\s\S]*?class\s+\w+[^{]*\{", src):
            end = balanced(src, c.end() - 1)
            for m in re.finditer(r"@(Get|Post|Put|Delete|Patch|Options|Head|All)\(\s*(?:['\"]([^'\"]*)['\"])?\s*\)\s*(?:@\w+(?:\([^)]*\))?\s*)*(?:async\s+)?(\w+)\s*\(", src[c.end() : end if end > 0 else None]):
                add(c.end() + m.start(), m[1], join_prefix(c[1] or "", m[2] or ""), m[3], "nestjs")
        for m in re.finditer(r"@(MessagePattern|EventPattern|SubscribeMessage)\(\s*['\"]([^'\"]*)['\"]\s*\)\s*(?:async\s+)?(\w+)", src):
            add(m.start(), {"MessagePattern": "MESSAGE", "EventPattern": "EVENT", "SubscribeMessage": "WS"}[m[1]], m[2], m[3], "nestjs")
        for m in re.finditer(r"\bpath\s*:\s*['\"]([^'\"]*)['\"]\s*,[^{}]*?\bcomponent\s*:\s*(\w+)", src):
            add(m.start(), "GET", join_prefix(m[1]), m[2], "router")
        if m := re.search(r"(?:^|/)(?:pages|app)/(.+)\.(?:jsx?|tsx?)$", path):
            add(0, "GET", file_route(re.sub(r"/(?:page|route)$", "", m[1]) + ".x"), "default", "files")
    elif language == "python":
        for m in re.finditer(r"@(\w+)\.route\(\s*['\"]([^'\"]+)['\"]([^)]*)\)\s*(?:@[^\n]*\n\s*)*(?:async\s+)?def\s+(\w+)", src):
            for verb in re.findall(r"['\"](\w+)['\"]", m[3]) or ["GET"]:
                add(m.start(), verb, m[2], m[4], "flask")
        for m in re.finditer(rf"@(\w+)\.({VERBS})\(\s*['\"]([^'\"]*)['\"][^)]*\)\s*(?:@[^\n]*\n\s*)*(?:async\s+)?def\s+(\w+)", src):
            add(m.start(), m[2], m[3], m[4], "fastapi")
        for m in re.finditer(r"\b(?:path|re_path|url)\(\s*r?['\"]([^'\"]*)['\"]\s*,\s*(?:include\(\s*['\"]([\w.]+)['\"]|([\w.]+))", src):
            add(m.start(), "any", join_prefix(m[1]), (m[2] or m[3]).split(".")[-1], "django")
    elif language == "ruby":
        for m in re.finditer(r"(?m)^\s*(get|post|put|patch|delete)\s+['\"]([^'\"]+)['\"]\s*(?:,\s*to:|=>)\s*['\"]([\w/]+)#(\w+)['\"]", src):
            add(m.start(), m[1], join_prefix(m[2]), f"{m[3]}#{m[4]}", "rails")
    elif language in ("java", "kotlin"):
        kinds = r"@(Get|Post|Put|Delete|Patch|Request)Mapping(?:\(\s*(?:(?:value|path)\s*=\s*)?\{?\s*(?:\"([^\"]*)\")?[^)]*\))?"
        # A mapping on the class is a route of its own; it is not put before the routes of the methods.
        for m in re.finditer(kinds, src):
            method = re.compile(r"[\w<>\])\s]\s(\w+)\s*\([^;{}]*\)\s*(?:throws[^{;]*)?\{").search(src, m.end())
            add(m.start(), m[1], join_prefix(m[2] or ""), method[1] if method else "", "spring")
    elif language == "go":
        groups = group_prefixes(src, r"(?P<var>\w+)\s*:=\s*(?P<parent>\w+)\.Group\(\s*\"(?P<sub>[^\"]*)\"")
        for m in re.finditer(r"\b(\w+)\.(GET|POST|PUT|DELETE|PATCH|OPTIONS|HEAD|Any|Handle|HandleFunc|Get|Post|Put|Delete|Patch)\(\s*\"([^\"]*)\"\s*,", src):
            end = balanced(src, src.index("(", m.start()))
            add(m.start(), m[2], join_prefix(groups.get(m[1], ""), m[3]), _tail(src[m.end() : end - 1]) if end > 0 else "", "go")
    elif language == "php":
        for m in re.finditer(r"Route::(get|post|put|delete|patch|any|resource|apiResource)\(\s*['\"]([^'\"]+)['\"]\s*,\s*\[?\s*(\w+)(?:::class)?(?:\s*,\s*['\"](\w+)['\"])?", src):
            if m[1].lower().endswith("resource"):
                for verb, tail in (("get", ""), ("post", ""), ("get", "{id}"), ("put", "{id}"), ("delete", "{id}")):
                    add(m.start(), verb, join_prefix(m[2], tail), m[3], "laravel")
            else:
                add(m.start(), m[1], join_prefix(m[2]), m[4] or m[3], "laravel")
    elif language == "swift":
        for m in re.finditer(r"\b(?:app|routes?|\w+)\.(get|post|put|delete|patch)\(\s*((?:\"[^\"]*\"\s*,?\s*)*)(?:use:\s*([\w.]+))?", src):
            parts = re.findall(r"\"([^\"]*)\"", m[2])
            if parts or m[3]:
                add(m.start(), m[1], join_prefix(*parts), (m[3] or "").split(".")[-1], "vapor")
    elif language == "csharp":
        groups = group_prefixes(src, r"(?:var|\w+)\s+(?P<var>\w+)\s*=\s*(?P<parent>\w+)\.MapGroup\(\s*\"(?P<sub>[^\"]*)\"")
        for m in re.finditer(r"\b(\w+)\.Map(Get|Post|Put|Delete|Patch)\(\s*\"([^\"]*)\"\s*,", src):
            end = balanced(src, src.index("(", m.start()))
            add(m.start(), m[2], join_prefix(groups.get(m[1], ""), m[3]), _tail(src[m.end() : end - 1]) if end > 0 else "", "aspnet")
        for m in re.finditer(r"\bMapHub<\s*([\w.]+)\s*>\(\s*\"([^\"]*)\"", src):
            add(m.start(), "HUB", join_prefix(m[2]), m[1].split(".")[-1], "aspnet")
        for c in re.finditer(r"((?:\[(?:\"[^\"]*\"|[^\]\"])*\]\s*)*)(?:public\s+|sealed\s+|abstract\s+|partial\s+)*class\s+(\w+)[^{]*\{", src):
            base = re.search(r"\[Route\(\s*\"([^\"]*)\"", c[1])
            end = balanced(src, c.end() - 1)
            for m in re.finditer(r"\[Http(Get|Post|Put|Delete|Patch)(?:\(\s*\"([^\"]*)\"[^\]]*\))?\]\s*(?:\[(?:\"[^\"]*\"|[^\]\"])*\]\s*)*(?:public\s+|async\s+|virtual\s+)*[\w<>\[\]?, .]+\s+(\w+)\s*\(", src[c.end() : end if end > 0 else None]):
                add(c.end() + m.start(), m[1], expand_tokens(join_prefix(base[1] if base else "", m[2] or ""), c[2], m[3]), m[3], "aspnet")
    return out


def di_bindings(text: str) -> list[tuple[str, str]]:
    """(interface, implementation) registered with a container."""
    return re.findall(r"\bAdd(?:Scoped|Singleton|Transient)<\s*([\w.]+)\s*,\s*([\w.]+)\s*>", text)


def extracted_routes(documents: DataFrame) -> DataFrame:
    """Route rows of all source texts (path, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(f"route:{p}:{line}:{verb}:{address}", p, line, verb, address, handler, framework)
                    for p, t in zip(pdf["path"], pdf["text"], strict=True) for line, verb, address, handler, framework in routes(p, t)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ROUTES.split(", ")])

    return documents.filter("path IS NOT NULL AND text IS NOT NULL").select("path", "text").mapInPandas(run, ROUTES)


# ---------------------------------------------------------------- nested route tables


def _objects(text: str, at: int) -> list[str]:
    """The objects of the array that opens at ``at``."""
    end = balanced(text, at)
    out, i = [], at + 1
    while 0 < i < (end if end > 0 else len(text)):
        j = text.find("{", i, end)
        if j < 0:
            break
        stop = balanced(text, j)
        if stop < 0:
            break
        out.append(text[j + 1 : stop - 1])
        i = stop
    return out


def nested_routes(text: str, at: int, parent: str = "") -> list[tuple[str, str, list[str]]]:
    """(address, component or lazy import, guards) of a route table and the tables inside it."""
    out: list[tuple[str, str, list[str]]] = []
    for body in _objects(text, at):
        inner = re.search(r"\bchildren\s*:\s*\[", body)
        flat = body
        if inner:
            stop = balanced(body, inner.end() - 1)
            flat = body[: inner.start()] + (body[stop:] if stop > 0 else "")
        path = re.search(r"\bpath\s*:\s*['\"`]([^'\"`]*)['\"`]", flat)
        address = compose_nested(parent, path[1]) if path else parent
        target = re.search(r"\b(?:component|element)\s*:\s*<?\s*(\w+)", flat)
        lazy = re.search(r"import\(\s*['\"`]([^'\"`]+)['\"`]\s*\)(?:\s*\.then\(\s*\(?\w+\)?\s*=>\s*\w+\.(\w+))?", flat)
        guards = [g for part in re.findall(r"\b(?:canActivate|canMatch|canDeactivate|canLoad|resolve|beforeEnter)\s*:\s*[\[{]?([^\]}]*)", flat) for g in re.findall(r"[A-Za-z_]\w*(?!\s*:)\b", part)]
        name = target[1] if target and not (lazy and target[1] == "import") else (lazy[2] or lazy[1]) if lazy else ""
        if path and not (re.search(r"\bredirectTo\b|\bredirect\s*:", flat) and not name):
            out.append((address if address.startswith("/") else join_prefix(address), name, guards))
        if inner:
            out += nested_routes(body, inner.end() - 1, address)
    return out


def route_tables(text: str) -> list[tuple[int, str, str, list[str]]]:
    """(line, address, component, guards) of every router table in a script."""
    opener = r"(?:RouterModule\.for(?:Root|Child)\(|provideRouter\(|\bRoutes\s*=|\broutes\s*(?::[^=\n]+)?[=:])\s*\["
    return [(text.count("\n", 0, m.start()) + 1, *r) for m in re.finditer(opener, text) for r in nested_routes(text, m.end() - 1)]


# ---------------------------------------------------------------- declarations and uses

#: File names that make a folder of a routes tree an address.
PAGE_FILES = ("+page.svelte", "+page.ts", "+page.js", "+page.server.ts", "+page.server.js", "+layout.svelte", "+layout.ts", "+layout.js", "+layout.server.ts", "+layout.server.js", "+server.ts", "+server.js")


def page_route(path: str) -> str | None:
    """The address that a page file stands for by its place in the tree."""
    name = path.rsplit("/", 1)[-1]
    if name in PAGE_FILES and "routes/" in path:
        folder = path.split("routes/", 1)[1].rsplit("/", 1)[0] if "/" in path.split("routes/", 1)[1] else ""
        return file_route(re.sub(r"\([^)]*\)/?", "", folder) + "/index.x")
    m = re.search(r"(?:^|/)(?:pages|server/(?:api|routes))/(.+)\.(?:vue|ts|js|mjs)$", path)
    if m:
        prefix = "api/" if "/server/api/" in f"/{path}" else ""
        return file_route(prefix + re.sub(r"\.(?:get|post|put|delete|patch)$", "", m[1]) + ".x")
    return None


def declarations(path: str, text: str) -> list[tuple[int, str, str, str]]:
    """(line, kind, name, framework) of what frameworks add to a language."""
    src = strip_comments(text, language_of(path) or "c")
    line = lambda at: src.count("\n", 0, at) + 1
    out: list[tuple[int, str, str, str]] = []
    kinds = {"Component": "component", "Directive": "component", "Pipe": "class", "Injectable": "class", "NgModule": "module"}
    for m in re.finditer(r"@(Component|Directive|Pipe|Injectable|NgModule)\(", src):
        end = balanced(src, m.end() - 1)
        c = re.compile(r"(?:\s|@\w+(?:\([^)]*\))?|export|default|abstract)*class\s+(\w+)").match(src, end) if end > 0 else None
        if c:
            out.append((line(m.start()), kinds[m[1]], c[1], "angular"))
    if path.endswith((".jsx", ".tsx", ".js", ".ts")):
        for m in re.finditer(r"\b(?:function\s+([A-Z]\w*)\s*\([^)]*\)[^{;]*\{|const\s+([A-Z]\w*)\s*(?::[^=]+)?=\s*(?:\w+(?:\.\w+)?\(\s*)?(?:function\b[^{]*\{|\([^)]*\)\s*(?::[^=]+)?=>\s*[({]?))", src):
            if re.search(r"<[A-Za-z][\w.]*[\s/>]|<>", src[m.end() : m.end() + 2000]):
                out.append((line(m.start()), "component", m[1] or m[2], "react"))
        for m in re.finditer(r"\b(?:function\s+|const\s+)(use[A-Z]\w*)\s*(?:\(|=)", src):
            out.append((line(m.start()), "function", m[1], "vue" if "/composables/" in path else "react"))
        for m in re.finditer(r"\bconst\s+(\w+)\s*=\s*defineStore\(", src):
            out.append((line(m.start()), "class", m[1], "vue"))
    address = page_route(path)
    if address:
        out.append((1, "route", address, "svelte" if "+" in path else "vue"))
        for m in re.finditer(r"\bexport\s+(?:async\s+)?(?:function|const)\s+(GET|POST|PUT|DELETE|PATCH|OPTIONS|HEAD)\b", src) if "+server" in path else ():
            out.append((line(m.start()), "route", f"{m[1]} {address}", "svelte"))
    return out


def injected(text: str) -> list[str]:
    """Types that a class asks its container for: constructor parameters and ``inject(X)``."""
    out = []
    for m in re.finditer(r"\bconstructor\s*\(", text):
        end = balanced(text, m.end() - 1)
        out += re.findall(r":\s*([A-Z]\w*)", text[m.end() : end if end > 0 else m.end()])
    return list(dict.fromkeys(out + re.findall(r"\binject\(\s*([A-Z]\w*)", text)))


def workspace_members(text: str) -> tuple[list[str], list[tuple[str, str]]]:
    """(members, (name, path) dependencies) of a workspace's project file."""
    try:
        import tomllib

        data = tomllib.loads(text)
    except (ValueError, ImportError):
        return [], []
    deps = [(k, v["path"]) for part in ("dependencies", "dev-dependencies", "build-dependencies") for k, v in data.get(part, {}).items() if isinstance(v, dict) and "path" in v]
    return list(data.get("workspace", {}).get("members", [])), deps


DECLARATIONS = "file_path string, line int, kind string, name string, framework string"


def extracted_declarations(documents: DataFrame) -> DataFrame:
    """Framework declarations of all source texts (path, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, *r) for p, t in zip(pdf["path"], pdf["text"], strict=True) for r in declarations(p, t)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in DECLARATIONS.split(", ")])

    return documents.filter("path IS NOT NULL AND text IS NOT NULL").select("path", "text").mapInPandas(run, DECLARATIONS)
