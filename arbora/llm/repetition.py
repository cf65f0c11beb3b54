"""Repetition inside a single document, with verdicts on the hosts the documents come from.

1. Every document is screened by cheap rules on its text as it stands: the share of word pairs that occurred
   before, the share of lines that occurred before, and how far a fast compressor shrinks it.  None of them
   is the share that is asked for.
2. Rule failures are summed per host (the repository), the failure rates of the hosts are shrunk towards a
   beta prior fitted to all hosts (method of moments), and a host whose shrunk rate lies more than ``width``
   standard deviations of the prior above its mean fails.
3. The host verdicts are joined back.  A document that fails a rule, or whose host fails, goes to the exact
   check: more than ``share`` of at least ``min_words`` words in passages that occurred before.  Documents that
   fail a rule are measured while their text is at hand; those that only their host brings in are read again.

Words are runs of letters (numbers dropped, case folded), so case, punctuation, spacing and running numbers
do not matter.  A word is repeated if it lies in five words that occurred before in the document, or in a
run of one to four words said at least three times in a row (the first time is not counted).

Defined results: null, blank and short texts measure 0 and are never found; texts of any length are measured
whole; a null repository is the host ``''``; a repeated doc_id gives one found row; rows without an
id are left out; an empty table gives none;
other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm.batches import slices
from arbora.session import materialise, spread

PHRASE = 5
_WORD = re.compile(r"\b[^\W\d]\w*")
_ANY = re.compile(r"\w+")
_NO_DIGITS = {ord(c): None for c in "0123456789"}
#: The rules: a document fails that repeats more than these shares of its word pairs or lines, or shrinks below this ratio.
PAIR_LIMIT, LINE_LIMIT, RATIO_LIMIT = 0.12, 0.1, 0.3
_SCREENED = "doc_id long, host string, pair_share double, line_share double, ratio double, failed boolean"
_MEASURES = _SCREENED + ", n_words long, share double"
_PRIMES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def words(text: str) -> list[str]:
    return " ".join(_WORD.findall(text.lower())).translate(_NO_DIGITS).split()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def repeated_mask(codes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which words are repeats, and which of these stand in a run; codes of all documents one after another."""
    n = len(codes)
    hit = np.zeros(n, dtype=bool)
    if n >= PHRASE:
        h = _mixed(doc[: n - PHRASE + 1].astype(np.uint64) + np.uint64(1))
        for k in range(PHRASE):
            h = _mixed((h + codes[k : n - PHRASE + 1 + k]) * _PRIMES[k])
        whole = doc[: n - PHRASE + 1] == doc[PHRASE - 1 :]
        at = np.flatnonzero(whole)
        _, first, back = np.unique(h[at], return_index=True, return_inverse=True)
        again = at[first[back] != np.arange(len(at))]
        for k in range(PHRASE):
            hit[again + k] = True
    run = np.zeros(n, dtype=bool)
    for p in range(1, PHRASE):
        if n <= p:
            break
        same = np.concatenate([np.zeros(p, dtype=bool), (codes[p:] == codes[:-p]) & (doc[p:] == doc[:-p]), [False]])
        edge = np.flatnonzero(np.diff(same.astype(np.int8)))
        starts, ends = edge[::2] + 1, edge[1::2] + 1
        for a, b in zip(starts, ends, strict=True):
            if b - a >= 2 * p:
                run[a:b] = True
    return hit | run, run


def _rules(text: str) -> tuple[float, float, float]:
    """(share of word pairs that occurred before, share of line characters that occurred before, compressed size)."""
    if not text or text.isspace():
        return 0.0, 0.0, 1.0
    tokens = text.lower().split()
    pairs = 1 - len(set(zip(tokens, tokens[1:]))) / (len(tokens) - 1) if len(tokens) > 1 else 0.0
    seen: set[str] = set()
    total = again = 0
    for line in text.splitlines():
        key = line.strip()
        if key:
            total += len(key)
            again += len(key) if key in seen else 0
            seen.add(key)
    raw = text.encode("utf-8", "surrogatepass")
    return pairs, again / total if total else 0.0, len(zlib.compress(raw, 1)) / len(raw)


def screen_slice(pdf: pd.DataFrame, min_words: int) -> pd.DataFrame:
    """Rules only.  A text too short to hold ``min_words`` words fails none."""
    texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
    out = pd.DataFrame([_rules(t) for t in texts], columns=["pair_share", "line_share", "ratio"])
    out.insert(0, "doc_id", pdf["doc_id"])
    out.insert(1, "host", pdf["repo"].fillna("").astype(str))
    long_enough = np.array([len(t) >= 2 * min_words - 1 for t in texts], dtype=bool)
    out["failed"] = long_enough & ((out["pair_share"] > PAIR_LIMIT) | (out["line_share"] > LINE_LIMIT) | (out["ratio"] < RATIO_LIMIT))
    return out


def exact_slice(texts: list[str]) -> tuple[list[int], np.ndarray]:
    """Number of words and share of repeated words of each text."""
    split = [words(t) for t in texts]
    sizes = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
    codes = np.fromiter((hash(w) for s in split for w in s), dtype=np.int64, count=int(sizes.sum())).view(np.uint64)
    doc = np.repeat(np.arange(len(split)), sizes)
    hit, _ = repeated_mask(codes, doc)
    counts = [int(s) if s >= 40 else len(_ANY.findall(t)) if t else 0 for s, t in zip(sizes, texts, strict=True)]
    return counts, np.bincount(doc[hit], minlength=len(split)) / np.maximum(sizes, 1)


def measure_slice(pdf: pd.DataFrame, which: str, min_words: int = 40) -> pd.DataFrame:
    """The rules of all documents, the exact share of those that ``which`` names: all, failed, or passed (and only these)."""
    pdf = pdf.reset_index(drop=True)
    out = screen_slice(pdf, min_words)
    ask = np.ones(len(out), dtype=bool) if which == "all" else out["failed"].to_numpy(dtype=bool) == (which == "failed")
    at = np.flatnonzero(ask)
    counts, share = exact_slice([t if isinstance(t, str) else "" for t in pdf["text"].iloc[at]])
    out["n_words"], out["share"] = pd.array([None] * len(out), dtype="Int64"), np.nan
    out.loc[at, "n_words"], out.loc[at, "share"] = counts, share
    return out.iloc[at] if which == "passed" else out


def measures(documents: DataFrame, which: str = "all", min_words: int = 40) -> DataFrame:
    """Per row of documents: its rules and, for those asked for, n_words and share."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches):
            yield measure_slice(pdf, which, min_words)

    return documents.filter("doc_id IS NOT NULL").select("doc_id", "text", "repo").mapInPandas(run, _MEASURES)


def host_verdicts(measured: DataFrame, width: float = 1.0) -> DataFrame:
    """(host, n_docs, n_failed, failure_rate, host_fails): rates shrunk by a beta prior over all hosts."""
    hosts = measured.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed"))
    prior = hosts.agg((F.sum("n_failed") / F.sum("n_docs")).alias("m"), F.var_pop(F.col("n_failed") / F.col("n_docs")).alias("v"),
                      F.avg(1 / F.col("n_docs")).alias("inv"))
    # Between-host variance without the share that sampling explains; strength of the prior from the moments.
    base = F.col("m") * (1 - F.col("m"))
    between = F.greatest(F.col("v") - base * F.col("inv"), base / 1000)
    strength = F.when(base > 0, F.greatest(base / between - 1, F.lit(1.0))).otherwise(F.lit(1.0))
    p = prior.select(F.struct(F.col("m"), strength.alias("k"), F.sqrt(base / (strength + 1)).alias("sd")).alias("p")).scalar()
    rate = (F.col("n_failed") + F.col("p.m") * F.col("p.k")) / (F.col("n_docs") + F.col("p.k"))
    return hosts.withColumn("p", p).select("host", "n_docs", "n_failed", rate.alias("failure_rate"), (rate > F.col("p.m") + width * F.col("p.sd")).alias("host_fails"))


def repetition(documents: DataFrame, share: float = 0.3, min_words: int = 40, width: float = 1.0) -> DataFrame:
    """All documents with their rules, exact share, host verdict and ``repetitive``."""
    m = materialise(measures(spread(documents.select("doc_id", "text", "repo")), "all", min_words), "repetition")
    hosts = host_verdicts(m, width).select("host", "failure_rate", "host_fails")
    return m.join(hosts, "host").withColumn("suspect", F.col("failed") | F.col("host_fails")).withColumn(
        "repetitive", F.col("suspect") & (F.col("n_words") >= min_words) & (F.col("share") > share))


def found(documents: DataFrame, share: float = 0.3, min_words: int = 40, width: float = 1.0) -> DataFrame:
    """(doc_id) of repetitive documents: those that fail a rule or whose host fails, after the exact check."""
    texts = spread(documents.select("doc_id", "text", "repo"))
    m = materialise(measures(texts, "failed", min_words), "screened")
    # Written, so that the planner knows the size: where it is small enough the texts of these hosts are picked out of the scan without a shuffle.
    bad = materialise(host_verdicts(m, width).filter("host_fails").select("host"), "hosts")
    brought = texts.withColumn("host", F.coalesce("repo", F.lit(""))).join(bad, "host", "left_semi")
    again = measures(brought, "passed", min_words)
    return m.filter("failed").select("doc_id", "n_words", "share").unionByName(again.select("doc_id", "n_words", "share")).filter(
        (F.col("n_words") >= min_words) & (F.col("share") > share)).select("doc_id").distinct()
