"""Byte-pair encoding of whole texts with the ranks of a public vocabulary.

A text is split by the vocabulary's pattern. Within a piece a segment tree over its byte positions
holds, for every live part, the rank of merging it with its right neighbour; the root gives the
leftmost smallest rank. A merge removes one position and renews two leaves, each in logarithmic
time, so a piece of n bytes takes n log n steps however long it is. Pieces recur, so each Python
worker keeps the ids of those it met, up to a bound.

Defined cases: null and empty texts give an empty list; every byte has an id, so nothing is unknown;
special tokens' names are ordinary text.
"""

from __future__ import annotations

import base64
import itertools

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: The vocabulary files' place and, as text, the pattern that splits texts for byte_bpe_50k (fixed values).
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

NONE = 1 << 62
CACHE_MAX = 300_000
_STATE: dict[str, object] = {}


def load(data: bytes) -> dict[bytes, int]:
    """Ranks from the lines of a .tiktoken file."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    whole = ranks.get(piece)
    if whole is not None:
        return (whole,)
    n = len(piece)
    size = 1 << (n - 1).bit_length()
    end, left = list(range(1, n + 1)), list(range(-1, n - 1))
    tree = [NONE] * (2 * size)

    def key(i: int) -> int:
        j = end[i]
        r = ranks.get(piece[i : end[j]]) if j < n else None
        return NONE if r is None else r * n + i

    for i in range(n - 1):
        tree[size + i] = key(i)
    for k in range(size - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def put(i: int, v: int) -> None:
        k = size + i
        tree[k] = v
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            v = a if a < b else b
            if tree[k] == v:
                break
            tree[k] = v
            k >>= 1

    while tree[1] != NONE:
        i = tree[1] % n
        j = end[i]
        end[i] = end[j]
        if end[j] < n:
            left[end[j]] = i
        put(j, NONE)
        put(i, key(i))
        if left[i] >= 0:
            put(left[i], key(left[i]))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return tuple(out)


def encode(text: str | None, ranks: dict[bytes, int], pattern, cache: dict[str, tuple[int, ...]]) -> list[int]:
    if not text:
        return []
    parts = []
    for p in pattern.findall(text):
        ids = cache.get(p)
        if ids is None:
            if len(cache) >= CACHE_MAX:
                cache.clear()
            ids = cache[p] = encode_piece(p.encode(), ranks)
        parts.append(ids)
    return list(itertools.chain.from_iterable(parts))


def token_ids(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(key, ids) of every row; the vocabulary is read once on the driver and sent to the workers."""
    with open(vocabulary, "rb") as f:
        data = f.read()
    if len(data) > 64 << 20:
        raise ValueError("the vocabulary is too large to be sent to every worker")
    sent = df.sparkSession.sparkContext.broadcast(data)
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        if _STATE.get("of") != (vocabulary, pattern):
            _STATE.update(of=(vocabulary, pattern), ranks=load(sent.value), pattern=regex.compile(pattern), cache={})
        ranks, pat, cache = _STATE["ranks"], _STATE["pattern"], _STATE["cache"]
        for b in batches:
            lists = [encode(t, ranks, pat, cache) for t in b.column(1).to_pylist()]
            offsets = np.r_[0, np.cumsum([len(x) for x in lists])].astype(np.int32)
            flat = np.fromiter(itertools.chain.from_iterable(lists), dtype=np.int32, count=int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[key, "ids"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids ARRAY<INT>")
