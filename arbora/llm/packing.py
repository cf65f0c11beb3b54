"""Filling fixed-capacity containers with items: vector bin packing by the dot-product heuristic.

Every text is measured in tokens of a public tokenizer: all its tokens, and the loss-bearing ones (for
instruction data the first paragraph is the prompt, what follows it bears loss; a text of one paragraph
bears loss throughout; a token belongs to the part in which it begins).  A container has three limits: tokens, segments and loss-bearing tokens.  An item
larger than a container in tokens (or in loss-bearing tokens, which can only be if that limit is set lower)
is cut into pieces; its whole pieces fill containers of their own, the rest is an item like any other.

Items are spread by hash over shards of about ``shard_items`` items, and each task packs its shard: the open
container takes, of the items that still fit, the one whose size vector has the largest dot product with the
room left, until nothing fits.  A shard leaves a few containers with room, so the loss from sharding is
below one in a thousand; the working memory follows the shard, not the corpus.

Defined results: null and empty texts have no tokens and are left out, so are rows without an id; special-token strings are ordinary
text; a repeated row is an item of its own (``copy`` counts the repeats of one text under one id); an empty table
gives none.  Shards, order and ties hang on the rows alone, so every run gives the same containers.
"""

from __future__ import annotations

import base64
import functools
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm.batches import slices
from arbora.session import materialise, spread

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern that belongs to the vocabulary (a fixed, public value of its tokenizer).
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
PACKED = "container string, doc_id long, text_hash long, copy long, piece int, first_token long, n_tokens long, n_loss long"


@dataclass(frozen=True)
class Limits:
    tokens: int = 4096
    segments: int = 20
    loss: int = 4032  # the rest of a container is for prompts


@functools.cache
def encoder(path: str):
    """(encoder, length of each token in bytes)."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding(os.path.basename(path), pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}), sizes


#: Texts are tokenised in stretches of so many characters and on to the next place where the split pattern
#: always ends a piece (before a single blank or line end between two other characters), so that the tokens are
#: those of the whole text.
STRETCH = 50_000
_SEAM = re.compile(r"(?<=\S)[ \n](?=\S)")


def token_counts(enc, sizes: np.ndarray, text: str) -> tuple[int, int]:
    """(all tokens, tokens that begin after the first paragraph; all if there is but one)."""
    cut = text.find("\n\n")
    border = len(text[:cut].encode("utf-8", "replace")) if cut >= 0 else 0
    total = prompt = at = done = 0
    while at < len(text):
        seam = _SEAM.search(text, at + STRETCH)
        end = seam.start() if seam else len(text)
        tokens = enc.encode_ordinary(text[at:end])
        total += len(tokens)
        if done < border:
            starts = done + np.concatenate([[0], np.cumsum(sizes[tokens])])
            prompt += int(np.searchsorted(starts[:-1], border, "left"))
            done = int(starts[-1])
        at = end
    return total, total - prompt


def token_sizes(documents: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(doc_id, text_hash, n_tokens, n_loss) of every text with tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, sizes = encoder(vocabulary)
        for pdf in slices(batches):
            counts = [token_counts(enc, sizes, t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text_hash": pdf["text_hash"], "n_tokens": [c[0] for c in counts], "n_loss": [c[1] for c in counts]})

    texts = spread(documents.select("doc_id", "text").filter("doc_id IS NOT NULL AND text <> ''")).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return texts.mapInPandas(run, "doc_id long, text_hash long, n_tokens long, n_loss long").filter("n_tokens > 0")


def cut_pieces(tokens: int, loss: int, limits: Limits) -> list[tuple[int, int, int]]:
    """(first token, tokens, loss-bearing tokens) of the pieces of an item; loss-bearing tokens come last."""
    if tokens <= limits.tokens and loss <= limits.loss:
        return [(0, tokens, loss)]
    out, at = [], 0
    while at < tokens:
        size = min(limits.tokens, tokens - at)
        prompt = max(0, tokens - loss - at)
        if size - prompt > limits.loss:
            size = prompt + limits.loss
        out.append((at, size, max(0, size - prompt)))
        at += size
    return out


def pack(tokens: np.ndarray, loss: np.ndarray, limits: Limits) -> np.ndarray:
    """Container number of each item."""
    order = np.lexsort((loss, tokens))
    t, l = tokens[order], loss[order]
    # The dot product of an item with the room left is linear in its size: weights per container state.
    free = np.ones(len(t), dtype=bool)
    bins = np.empty(len(t), dtype=np.int64)
    ids = np.arange(len(t))
    number = 0
    left = len(t)
    while left:
        if left * 2 < len(free):
            keep = np.flatnonzero(free)
            t, l, ids, free = t[keep], l[keep], ids[keep], np.ones(len(keep), dtype=bool)
        room_t, room_s, room_l = limits.tokens, limits.segments, limits.loss
        while room_s and room_t:
            end = int(np.searchsorted(t, room_t, "right"))
            ok = free[:end] & (l[:end] <= room_l)
            score = np.where(ok, t[:end] * (room_t / limits.tokens**2) + l[:end] * (room_l / limits.loss**2) + room_s / limits.segments**2, -1.0)
            if not end or score[best := int(score.argmax())] < 0:
                break
            free[best] = False
            left -= 1
            bins[ids[best]] = number
            room_t, room_s, room_l = room_t - int(t[best]), room_s - 1, room_l - int(l[best])
        number += 1
    out = np.empty(len(tokens), dtype=np.int64)
    out[order] = bins
    return out


def pack_documents(documents: DataFrame, limits: Limits = Limits(), shard_items: int = 20_000, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(container, doc_id, copy, piece, first_token, n_tokens, n_loss): which part of which text goes where."""
    sizes = materialise(token_sizes(documents, vocabulary), "sizes")
    key = ["doc_id", "text_hash", "n_tokens", "n_loss"]
    copies = sizes.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).select(*key, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy"))
    shards = max(1, -(-sizes.count() // shard_items))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        items = pd.concat(parts, ignore_index=True).sort_values(["doc_id", "text_hash", "copy"], kind="stable")
        rows = [(d, h, c, k, *p) for d, h, n, m, c in items[[*key, "copy"]].itertuples(index=False) for k, p in enumerate(cut_pieces(n, m, limits))]
        out = pd.DataFrame(rows, columns=["doc_id", "text_hash", "copy", "piece", "first_token", "n_tokens", "n_loss"])
        number = pack(out["n_tokens"].to_numpy(), out["n_loss"].to_numpy(), limits)
        shard = TaskContext.get().partitionId()
        out.insert(0, "container", [f"{shard}-{b}" for b in number])
        yield out

    return copies.repartition(shards, F.xxhash64("doc_id", "text_hash", "copy")).mapInPandas(run, PACKED)


def fill_report(packed: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row: containers, items, tokens, the least number of containers that any packing needs under each
    limit alone, the share of room used, the fullest of each limit."""
    per = packed.groupBy("container").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("s"), F.sum("n_loss").alias("l"))
    need = lambda c, most: F.ceil(F.sum(c) / most).cast("long")
    return per.agg(F.count(F.lit(1)).alias("n_containers"), F.sum("s").alias("n_pieces"), F.sum("t").alias("n_tokens"), F.sum("l").alias("n_loss"),
                   need("t", limits.tokens).alias("least_by_tokens"), need("s", limits.segments).alias("least_by_segments"), need("l", limits.loss).alias("least_by_loss"),
                   F.round(F.sum("t") / (F.count(F.lit(1)) * limits.tokens), 4).alias("fill"),
                   F.max("t").alias("max_tokens"), F.max("s").alias("max_segments"), F.max("l").alias("max_loss"))
