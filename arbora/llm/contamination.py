"""Evaluation texts leaking into training text, by spaced-seed hashing.

The words of each test item's own passage (an opening sentence that several items share is cut off) and of
each document are hashed under fixed masks that skip some positions.  A seed's hash covers the six selected
words in order and not the mask, so a seed of the test side meets one of the training side across an
exchanged, an added or a lost word.

1. The seeds of the test set are a table.  Their hashes set bits of a map of ``BITS_PER_SEED`` bits a seed,
   which is built on the executors and has a bounded size; it alone is sent to all tasks.
2. One scan of the documents keeps the texts with seeds that the map knows, with the places of those seeds.
3. These meet the test seeds in a join by hash; every meeting is kept, also of seeds that repeat.
4. Text and test passages come together by document, and around every meeting the two word sequences are
   aligned (match +1, exchange, gap -1); the matched words of the best local alignment are counted.

A test set of more than ``MAP_SEEDS`` seeds is taken in blocks of items with a map and a scan each.

Defined results: null or blank texts match nothing; ids that repeat give one row per (doc_id, item_id); an
empty test set or an empty corpus gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm.batches import slices
from arbora.session import materialise, spread

#: Positions looked at are 1; six words each.
MASKS = ("111111", "1110111", "1101111", "1111011", "11011011", "1011111", "1111101")
WEIGHT = 6
BITS_PER_SEED, PROBES = 128, 4
#: Seeds of one map: it takes 2**30 bits (128 MB) at most.
MAP_SEEDS = 1 << 23
BUCKET = 32_768
CACHED_WORDS = 1_000_000
_WORD = re.compile(r"[^\W_]+(?:_+[^\W_]+)*")
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+|\n\s*\n")
_SPREAD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)
_TURNS = np.array([0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165], dtype=np.uint64)
_OFFSETS = [np.flatnonzero([c == "1" for c in m]) for m in MASKS]


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def opening(text: str | None) -> str:
    """The first sentence in normal form."""
    return " ".join(words(_SENTENCE_END.split(text.strip(), maxsplit=1)[0])) if text else ""


def own_passages(items: DataFrame) -> DataFrame:
    """(item_id, passage): the words after an opening sentence that another item has too."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            first = [opening(t) for t in pdf["text"]]
            rest = [" ".join(words(t)[len(f.split()):]) if t else "" for t, f in zip(pdf["text"], first, strict=True)]
            yield pd.DataFrame({"item_id": pdf["item_id"], "first": first, "rest": rest})

    parts = items.select("item_id", "text").dropDuplicates().mapInPandas(cut, "item_id long, first string, rest string")
    shared = parts.groupBy("first").agg(F.countDistinct("item_id").alias("n")).filter("n > 1").select("first", F.lit(True).alias("shared"))
    return parts.join(shared, "first", "left").select(
        "item_id", F.when(F.col("shared"), F.col("rest")).otherwise(F.concat_ws(" ", "first", "rest")).alias("passage"))


def _seeds(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(codes) - int(offsets[-1])
    h = np.zeros(max(n, 0), dtype=np.uint64)
    for k, o in enumerate(offsets):
        h = (h + codes[o : o + n]) * _SPREAD[k] if n > 0 else h
        h ^= h >> np.uint64(31)
    return h


class _Codes(dict):
    """Word -> 64-bit hash, the same on every worker; words met once are kept."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        code = self[word] = xxhash.xxh64_intdigest(word)
        return code

    def of(self, text: str | None) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words(text)), dtype=np.uint64)


_CODES = _Codes()


def _places(hashes: np.ndarray, probe: int, bits: int) -> np.ndarray:
    """The bit that a probe of each hash looks at."""
    return ((hashes * _TURNS[probe]) >> np.uint64(64 - bits)).astype(np.int64)


def item_seeds(passages: DataFrame) -> DataFrame:
    """(hash, item_id, at) of every seed of every passage."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for item, passage in zip(pdf["item_id"], pdf["passage"], strict=True):
                codes = _CODES.of(passage)
                parts = [_seeds(codes, o) for o in _OFFSETS]
                yield pd.DataFrame({"hash": np.concatenate(parts).view(np.int64), "item_id": item, "at": np.concatenate([np.arange(len(p)) for p in parts])}).drop_duplicates()

    return passages.mapInPandas(run, "hash long, item_id long, at int")


def seed_map(seeds: DataFrame, bits: int) -> np.ndarray:
    """A map of 2**bits bits in which the probes of all seeds are set; it is put together on the executors."""

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            h = pdf["hash"].to_numpy().view(np.uint64)
            at = np.concatenate([_places(h, k, bits) for k in range(PROBES)])
            yield pd.DataFrame({"bucket": at // BUCKET, "bit": at % BUCKET})

    rows = seeds.select("hash").mapInPandas(places, "bucket long, bit long").groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("map"))
    out = np.zeros(max(1 << bits, BUCKET) // 8, dtype=np.uint8)
    for r in rows.collect():  # of the map's bits, 128 MB at most
        out[r["bucket"] * BUCKET // 8 :][: BUCKET // 8] = np.frombuffer(r["map"], dtype=np.uint8)
    return out


def _known(hashes: np.ndarray, known: np.ndarray, bits: int) -> np.ndarray:
    """Which seeds all probes find in the map."""
    at = np.arange(len(hashes))
    for k in range(PROBES):
        place = _places(hashes[at], k, bits)
        at = at[(known[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0]
    return at


def touched(documents: DataFrame, known: np.ndarray, bits: int) -> DataFrame:
    """(uid, doc_id, text, hits) of the documents with seeds that the map knows; hits are (hash, at)."""
    shipped = documents.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 40
        for pdf in slices(batches):
            codes = [_CODES.of(t) for t in pdf["text"]]
            joined, doc = np.concatenate(codes), np.repeat(np.arange(len(codes)), [len(c) for c in codes])
            first = np.concatenate([[0], np.cumsum([len(c) for c in codes])])
            found = []
            for o in _OFFSETS:
                h = _seeds(joined, o)
                at = _known(h, shipped.value, bits)
                at = at[doc[at] == doc[at + o[-1]]]
                found.append((at, h[at]))
            at, h = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]).view(np.int64)
            order = np.argsort(at, kind="stable")
            at, h = at[order], h[order]
            owner = doc[at]
            for d in np.unique(owner):
                a, b = np.searchsorted(owner, d, "left"), np.searchsorted(owner, d, "right")
                hits = [{"hash": x, "at": y} for x, y in zip(h[a:b].tolist(), (at[a:b] - first[d]).tolist(), strict=True)]
                number += 1
                yield pd.DataFrame({"uid": [number], "doc_id": pdf["doc_id"].iloc[[d]].to_numpy(), "text": [pdf["text"].iloc[d]], "hits": [hits]})

    docs = spread(documents.select("doc_id", "text").filter("doc_id IS NOT NULL AND text IS NOT NULL"))
    return docs.mapInPandas(run, "uid long, doc_id long, text string, hits array<struct<hash: bigint, at: int>>")


def aligned_words(item: np.ndarray, text: np.ndarray) -> int:
    """Matched words of the best local alignment."""
    n, m = len(item), len(text)
    grid = np.zeros((n + 1, m + 1), dtype=np.int32)
    steps = np.arange(m + 1)
    for i in range(1, n + 1):
        same = np.where(text == item[i - 1], 1, -1)
        row = np.zeros(m + 1, dtype=np.int32)
        row[1:] = np.maximum(np.maximum(grid[i - 1, :-1] + same, grid[i - 1, 1:] - 1), 0)
        grid[i] = np.maximum(np.maximum.accumulate(row + steps) - steps, 0)
    i, j = np.unravel_index(int(grid.argmax()), grid.shape)
    count = 0
    while grid[i, j] > 0:
        hit = item[i - 1] == text[j - 1]
        if grid[i, j] == grid[i - 1, j - 1] + (1 if hit else -1):
            count += int(hit)
            i, j = i - 1, j - 1
        elif grid[i, j] == grid[i - 1, j] - 1:
            i -= 1
        else:
            j -= 1
    return count


def matched_words(item: np.ndarray, text: np.ndarray, meetings: list[tuple[int, int]]) -> int:
    """The most words that one alignment around a meeting (place in text, place in item) matches."""
    n = len(item)
    spans: list[list[int]] = []
    for a, b in sorted((p - q - n // 3 - 8, p - q + n + n // 3 + 8) for p, q in meetings):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    best = 0
    for a, b in spans:
        for lo in range(max(a, 0), max(min(b, len(text)), 1), 4 * n + 400):
            # Long stretches are cut into overlapping pieces; a passage is shorter than the overlap.
            part = text[lo : min(lo + 6 * n + 600, b)]
            if len(part):
                best = max(best, aligned_words(item, part))
    return best


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted: each document's text, then the items it meets."""
    uid, doc, text = None, None, np.zeros(0, dtype=np.uint64)
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            if r.text is not None:
                uid, doc, text = r.uid, r.doc_id, _CODES.of(r.text)
            elif r.uid == uid:
                out.append((int(doc), int(r.item_id), matched_words(_CODES.of(r.passage), text, [(m["at"], m["q"]) for m in r.meetings])))
        yield pd.DataFrame(out, columns=["doc_id", "item_id", "n_words"])


def _leaks_of(documents: DataFrame, passages: DataFrame, seeds: DataFrame, n_seeds: int) -> DataFrame:
    bits = max(15, (n_seeds * BITS_PER_SEED - 1).bit_length())
    hit = materialise(touched(documents, seed_map(seeds, bits), bits), "touched")
    meet = hit.select("uid", F.explode("hits").alias("h")).select("uid", "h.hash", F.col("h.at").alias("at")).join(seeds.withColumnRenamed("at", "q"), "hash")
    pairs = meet.groupBy("uid", "item_id").agg(F.collect_set(F.struct("at", "q")).alias("meetings")).join(passages, "item_id")
    empty = lambda *names: [F.lit(None).cast(kind).alias(n) for n, kind in (x.split(" ", 1) for x in names)]
    rows = hit.join(pairs.select("uid").distinct(), "uid", "left_semi").select("uid", "doc_id", "text", *empty("item_id bigint", "passage string", "meetings array<struct<at: int, q: int>>")).unionByName(
        pairs.select("uid", *empty("doc_id bigint", "text string"), "item_id", "passage", "meetings"))
    together = rows.repartition("uid").sortWithinPartitions("uid", F.col("text").isNull())
    return together.mapInPandas(_verify, "doc_id long, item_id long, n_words long")


def leaks(documents: DataFrame, items: DataFrame, least: int = 20, map_seeds: int = MAP_SEEDS) -> DataFrame:
    """(doc_id, item_id, n_words): the documents that hold at least ``least`` words of an item's own passage."""
    passages = materialise(own_passages(items).filter("item_id IS NOT NULL AND passage <> ''").dropDuplicates(["item_id"]), "passages")
    seeds = materialise(item_seeds(passages), "seeds")
    n_seeds = seeds.count()
    blocks = max(1, -(-n_seeds // map_seeds))
    out: DataFrame | None = None
    for k in range(blocks):
        own = seeds if blocks == 1 else seeds.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        part = _leaks_of(documents, passages, own, -(-n_seeds // blocks))
        out = part if out is None else out.unionByName(part)
    return out.filter(F.col("n_words") >= least).groupBy("doc_id", "item_id").agg(F.max("n_words").alias("n_words"))


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    return leaks(documents, items).select("doc_id", "item_id")
