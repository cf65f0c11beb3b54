import random

import numpy as np
import pytest

from arbora.llm import contamination as C
from arbora.llm import handwritten as H
from arbora.llm import packing as K
from arbora.llm import repetition as R

WORDS = [a + b for a in "bcdfghjklmnpqrstvwz" for b in ("ane", "ilo", "urt", "eep", "ost", "ima", "odal", "unge")]
DOC = "doc_id long, text string, repo string, host string, copy long, passage string"


def prose(seed, n):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, r, "x", 7, "y") for i, t, r in rows], DOC)


# ------------------------------------------------------------------ contamination

ITEM = "item_id long, text string, suite string, doc_id long"


def test_leaks(spark):
    own = prose(1, 60)
    w = own.split()
    shared = "Read this text and answer the question below in one short sentence. "
    items = spark.createDataFrame([(1, shared + own, "a", 0), (2, shared + prose(2, 50), "a", 0), (3, None, None, None), (4, "", "", 0), (1, shared + own, "a", 0), (None, prose(3, 30), "", 0), (5, shared, "", 0)], ITEM)
    changed = list(w[10:34])
    changed[5], changed[12] = "other", "thing"
    added = w[10:16] + ["more"] + w[16:24] + ["yet"] + w[24:32]
    rows = [(1, prose(9, 40) + "\n> **" + "** \n* ".join(w[5:30]).upper() + "!" + prose(8, 30), "r"), (2, " ".join(changed), "r"), (3, " ".join(added), "r"), (4, shared + prose(7, 80), "r"), (5, " ".join(w[20:36]), "r"),
            (6, " ".join(w[0:10]) + prose(6, 300) + " ".join(w[30:40]), "r"), (7, None, None), (8, "", "r"), (9, " ".join(reversed(w)), "r"), (None, own, "r"), (10, prose(5, 150_000) + " " + own, "r"), (1, own, "q"), (11, "x" * 1_000_000, "r")]
    got = {tuple(r) for r in C.found(docs(spark, rows), items).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (10, 1)}
    assert {tuple(r) for r in C.leaks(docs(spark, rows), items, map_seeds=100).select("doc_id", "item_id").collect()} == got
    assert C.found(docs(spark, rows), items.limit(0)).count() == 0 and C.found(docs(spark, []), items).count() == 0


def test_alignment_against_brute_force():
    rnd = np.random.default_rng(3)
    for _ in range(40):
        a, b = rnd.integers(0, 4, rnd.integers(1, 9)), rnd.integers(0, 4, rnd.integers(1, 9))
        grid, best = np.zeros((len(a) + 1, len(b) + 1), int), 0
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                grid[i, j] = max(0, grid[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -1), grid[i - 1, j] - 1, grid[i, j - 1] - 1)
                best = max(best, grid[i, j])
        assert C.aligned_words(a, b) >= best
    assert C.aligned_words(np.array([1, 2, 3, 4]), np.array([9, 1, 2, 8, 3, 4])) == 4


# ------------------------------------------------------------------ repetition


def brute_share(text):
    w = R.words(text)
    hit = [False] * len(w)
    for i in range(len(w) - 4):
        if any(w[j : j + 5] == w[i : i + 5] for j in range(i)):
            hit[i : i + 5] = [True] * 5
    for p in range(1, 5):
        i = p
        while i < len(w):
            j = i
            while j < len(w) and w[j] == w[j - p]:
                j += 1
            if j - i >= 2 * p:
                hit[i:j] = [True] * (j - i)
            i = max(j, i + 1)
    return sum(hit) / max(1, len(w))


def test_share_against_brute_force():
    import pandas as pd

    rnd = random.Random(2)
    texts = [" ".join(rnd.choice("ab cde fgh".split() + WORDS[: rnd.randrange(1, 40)]) for _ in range(rnd.randrange(0, 90))) for _ in range(60)]
    texts += ["go " * 50, "a b " * 30, "", "one two three", prose(1, 50) + ". " + prose(1, 50)]
    got = R.measure_slice(pd.DataFrame({"doc_id": range(len(texts)), "text": texts, "repo": "r"}), "all")
    assert np.allclose(got["share"], [brute_share(t) for t in texts])
    for which in ("failed", "passed"):
        part = R.measure_slice(pd.DataFrame({"doc_id": range(len(texts)), "text": texts, "repo": "r"}), which).dropna(subset=["share"])
        assert (part["failed"] == (which == "failed")).all() and np.allclose(part["share"], [brute_share(texts[i]) for i in part["doc_id"]])


def test_found_and_hosts(spark):
    sentence = prose(4, 20)
    rows = [(1, prose(1, 60), "a"), (2, ". ".join([sentence] * 4), "a"), (3, "".join(f"{sentence.upper()} {i},\n" for i in range(3)), "b"), (4, sentence + " " + sentence, "b"), (5, "very " * 30, "b"), (6, "very " * 45, None), (7, None, "a"), (8, "", "a"), (8, "   ", "a"),
            (9, prose(2, 100_000), "a"), (10, "spam eggs " * 50_000, "a"), (None, "very " * 45, "a"), (2, ". ".join([sentence] * 4), "a"), (11, "0x1f, 0x2e, 17, " * 80, "c")]
    assert {r[0] for r in R.found(docs(spark, rows)).collect()} == {2, 3, 4, 6, 10}
    hosts = {r["host"]: r for r in R.host_verdicts(R.measures(docs(spark, rows))).collect()}
    assert (hosts["a"]["n_docs"], hosts["a"]["n_failed"], hosts["c"]["n_failed"]) == (8, 4, 1)
    assert set(hosts) == {"a", "b", "c", ""} and 0 < hosts["a"]["failure_rate"] < hosts["c"]["failure_rate"] < 1
    assert R.found(docs(spark, [])).count() == 0 and R.repetition(docs(spark, [])).count() == 0


def test_a_document_that_only_its_host_brings_in(spark):
    hidden = " ".join(f"{w}{k * 100 + i}" for k in range(2) for i, w in enumerate(prose(21, 50).split()))  # running numbers hide the copy from every rule
    assert not R.screen_slice(__import__("pandas").DataFrame({"doc_id": [1], "text": [hidden], "repo": ["a"]}), 40)["failed"].any() and brute_share(hidden) > 0.3
    rows = [(1, hidden, "spam"), (2, hidden, "good")] + [(10 + i, prose(i, 20) + " " + "buy now " * 30, "spam") for i in range(6)] + [(100 + i, prose(100 + i, 60), f"h{i % 6}") for i in range(60)]
    assert {r[0] for r in R.found(docs(spark, rows)).collect()} == {1, *range(10, 16)}
    marked = {r["doc_id"]: (r["failed"], r["host_fails"], r["repetitive"]) for r in R.repetition(docs(spark, rows)).collect()}
    assert marked[1] == (False, True, True) and marked[2] == (False, False, False)


# ------------------------------------------------------------------ packing


def test_pack_random_vectors():
    rnd = np.random.default_rng(1)
    limits = K.Limits(100, 5, 60)
    t = rnd.integers(1, 101, 800)
    loss = np.minimum(rnd.integers(0, 61, 800), t)
    bins = K.pack(t, loss, limits)
    n = bins.max() + 1
    for sizes, limit in ((t, 100), (loss, 60), (np.ones(800, int), 5)):
        assert np.bincount(bins, sizes, n).max() <= limit
    assert len(np.unique(bins)) == n and n <= 1.1 * max(t.sum() / 100, loss.sum() / 60, 800 / 5) + 1
    assert len(K.pack(np.array([], int), np.array([], int), limits)) == 0


def test_pieces():
    limits = K.Limits(100, 5, 40)
    assert K.cut_pieces(100, 40, limits) == [(0, 100, 40)]
    for tokens, loss in ((250, 0), (250, 250), (101, 5), (90, 60), (1000, 333)):
        p = K.cut_pieces(tokens, loss, limits)
        assert sum(x[1] for x in p) == tokens and sum(x[2] for x in p) == loss and all(x[1] <= 100 and x[2] <= 40 for x in p)
        assert [x[0] for x in p] == list(np.cumsum([0, *[x[1] for x in p]])[:-1])


def test_token_counts_are_those_of_the_whole_text(monkeypatch):
    enc, sizes = K.encoder(K.DEFAULT_VOCABULARY)
    rnd = random.Random(4)
    texts = ["".join(rnd.choice(["a", "Zß", " ", "  ", "\n", "\n\n", "'s", "12", "…", "漢字", "\t", ".", "don't"]) for _ in range(rnd.randrange(1, 200))) for _ in range(60)]
    monkeypatch.setattr(K, "STRETCH", 20)
    for t in texts:
        ids = enc.encode_ordinary(t)
        starts = np.cumsum([0, *[len(enc.decode_single_token_bytes(i)) for i in ids]])[:-1]
        border = len(t[: t.find("\n\n")].encode()) if "\n\n" in t else 0
        assert K.token_counts(enc, sizes, t) == (len(ids), int((starts >= border).sum()))


def test_pack_documents(spark):
    enc, _ = K.encoder(K.DEFAULT_VOCABULARY)
    rows = [(i, prose(i, 30 + i) + "\n\n" + prose(100 + i, 20), "r") for i in range(60)] + [(60, prose(1, 3000), "r"), (61, None, "r"), (62, "", "r"), (3, "again <|endoftext|>", "r"), (4, prose(4, 34) + "\n\n" + prose(104, 20), "r"), (63, "x" * 300_000, None), (None, "no id", "r")]
    limits = K.Limits(512, 8, 400)
    got = K.pack_documents(docs(spark, rows), limits, shard_items=25).collect()
    per, parts = {}, {}
    for r in got:
        c = per.setdefault(r["container"], [0, 0, 0])
        c[0], c[1], c[2] = c[0] + r["n_tokens"], c[1] + 1, c[2] + r["n_loss"]
        parts.setdefault((r["doc_id"], r["text_hash"], r["copy"]), []).append((r["first_token"], r["n_tokens"]))
    assert all(t <= 512 and s <= 8 and m <= 400 for t, s, m in per.values())
    for i, p in parts.items():
        assert sorted(x[0] for x in p) == list(np.cumsum([0, *[n for _, n in sorted(p)]])[:-1]), i
    whole = {i for i, p in parts.items() if len(p) == 1}
    assert [sum(1 for d, _, c in parts if (d, c) == x) for x in ((3, 0), (4, 0), (4, 1))] == [2, 1, 1] and {d for d, _, _ in whole} >= set(range(60)) and {d for d, _, _ in parts} == set(range(61)) | {63}
    for d in (5, 60, 63):
        assert sum(n for (x, _, _), p in parts.items() if x == d for _, n in p) == len(enc.encode_ordinary(next(t for i, t, _ in rows if i == d)))
    again = K.pack_documents(docs(spark, rows[::-1]).repartition(3), limits, shard_items=25).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))
    assert K.pack_documents(docs(spark, []), limits).count() == 0


# ------------------------------------------------------------------ hand-written files

CODE = "import { a } from './x';\n\n// Sums rows.\nexport function sum(rows) {\n  let total = 0;\n  for (const row of rows) {\n    total += row.value;\n  }\n  return total;\n}\n"


@pytest.mark.parametrize(("path", "text", "want"), [
    ("/w/proj/src/a.js", CODE, ""), ("/w/proj/src/a.js", "// Copyright (c) the proj authors.\n// SPDX-License-Identifier: MIT\n" + CODE, ""), ("/w/proj/src/a.js", "/*\n * other v1.2.9 | (c) the other authors | released under the MIT licence\n */\n" + CODE, "foreign"),
    ("/w/proj/src/a.js", "// Code generated by foo. DO NOT EDIT.\n" + CODE, "notice"), ("/w/proj/src/a.js", CODE + "// Code generated by foo. DO NOT EDIT.\n", ""), ("/w/proj/src/a.js", "// the writer below puts 'Code generated by foo. DO NOT EDIT.' there\n" + CODE, ""),
    ("/w/proj/src/a.js", "/*! lib 8.3 */" + "function a(b,c){return b.d(c,1)}var e=f?g:h[2];" * 30, "minified"), ("/w/proj/src/a.py", "T = [\n" + "    0x31b9, 0x60d2, 0xad8b, 7,\n" * 30 + "]\n", "data"), ("/w/proj/src/a.js", 'const W = "' + prose(1, 200) + '";\n' + CODE, ""),
    ("/w/proj/src/a.cs", '{\n' + ",\n".join(f'  "k{i}": {{"a": {i}}}' for i in range(25)) + "\n}\n", "data"), ("/w/proj/src/a.js", "", ""), ("/w/proj/src/a.js", "\n" * 50_000, ""),
])
def test_judge(path, text, want):
    r = H.judge(path, text, "proj")
    got = {n for n, v in zip(("notice", "foreign", "minified", "data"), r[5:9], strict=True) if v}
    assert got == ({want} if want else set())


def test_canonical_layout():
    packed = "function a(b,c){for(let i=0;i<9;i++){d(b[i],c)}return b.d(c,1)}var e=f?g:h[2];"
    pretty = "function a(b, c) {\n  for (let i = 0; i < 9; i++) {\n    d(b[i], c) // calls\n  }\n  return b.d(c, 1)\n}\nvar e = f ? g : h[2];\n"
    assert H.emit(packed, False) == H.emit(pretty, False) == H.emit(H.emit(packed, False), False) and H.emit(packed, False).count("\n") == 6
    assert H.layout(packed, False)[:2] == (7.0, 0.0) and H.layout(pretty, False)[:2] == (1.0, 1.0)
    assert H.emit("x = [1,\n  2]\ny = f(x)  # why\n", True) == "x = [ 1 , 2 ]\ny = f ( x )"
    printed = "".join(f"  table.put(k{i}, {i});\n" for i in range(30))
    assert H.judge("/w/p/a.java", printed, "p")[-1] and not H.judge("/w/p/a.js", CODE * 3, "p")[-1]


@pytest.mark.parametrize("notice", ["Autogenerado por gramc, no modificar", "Datei automatisch erzeugt von x", "Généré automatiquement par outil", "本文件由 gen 自动生成", "Gerado por x, não editar"])
def test_notices_in_other_languages(notice):
    assert H.signed_by(f"/* {notice} */\n" + CODE, "p") == (True, False) and H.signed_by(f"// the tool writes '{notice}'\n" + CODE, "p") == (False, False)


def test_found_files(spark):
    f = "path string, content_hash string, size long, language string, data boolean"
    files = [(p, "ABC " if "lib" in p else "x", 1, "Go", True) for p in ("/w/r/lib.go", "/w/r/vendor/a/b.go", "/w/r/vendoring/b.go", "/w/r/dist/x.js", "/w/r/distance/x.js", "/w/r/a_pb2.py", "/w/r/pb_x.py", "/w/r/x.min.js", "/w/r/zz_generated.a_b.go", "/w/r/generated_report.go", "/w/r/hand.js", "/w/r/hand.js")]
    files += [(None, "abc", None, None, None), ("/w/r/nohash.go", None, None, None, None)]
    libs = spark.createDataFrame([("abc", "l", "1"), ("abc", "l", "1"), (None, None, None)], "content_hash string, library string, version string")
    d = spark.createDataFrame([("/w/r/hand.js", CODE, "z"), ("/w/r/hand.js", CODE, "z"), ("/w/r/pb_x.py", None, None), (None, "x", None), ("/w/r/nofile.js", "// Code generated by x. DO NOT EDIT.", "")], "path string, text string, notice string")
    got = {r[0] for r in H.found(spark.createDataFrame(files, f), d, libs).collect()}
    assert got == {"/w/r/lib.go", "/w/r/vendor/a/b.go", "/w/r/dist/x.js", "/w/r/a_pb2.py", "/w/r/x.min.js", "/w/r/zz_generated.a_b.go"}
    assert H.found(spark.createDataFrame([], f), d, libs).count() == 0 and H.found(spark.createDataFrame(files, f), d.limit(0), libs.limit(0)).count() == 5


def test_signatures_after_a_long_licence():
    from arbora.llm.handwritten import signed_by

    licence = "".join(f"// {x}\n" for x in ["MIT License", "", *(f"Permission is hereby granted, clause {i}" for i in "abcdefghijklmnopqrst"), "Apache License, Version 2.0"])
    code = "\npackage a\n"
    assert signed_by(licence + code, "mine") == (False, False)
    assert signed_by(licence + "\n// Code generated by protoc-gen-go. DO NOT EDIT." + code, "mine") == (True, False)
    assert signed_by("//\n// x\n" * 80 + "// Code generated by stringer. DO NOT EDIT." + code, "mine")[0]
    assert signed_by(licence + "// Copyright (c) 2020 The Other Authors" + code, "mine") == (False, True)
    assert signed_by(licence + "// leftpad v1.3.0" + code, "mine") == (False, True)
    assert signed_by(licence + "// mine v1.3.0\n// Requires Python 3.8" + code, "mine") == (False, False)
    assert signed_by(licence + code + "// Code generated by x. DO NOT EDIT.\n", "mine") == (False, False)
