"""Near-duplicate texts by a grouped prefix join over word shingles.

Two texts belong together when the Jaccard similarity of their sets of shingles is at least t. A
pair of sizes a <= b then shares at least alpha = t / (1 + t) * (a + b) shingles, so under any one
order of all shingles the first shared one stands at position <= a - alpha of the one and <= b -
alpha of the other. Steps:

1. Texts with equal shingle sets are one set: copies cost one representative, however many there are.
2. The order is by rarity: a count sketch of fixed size over all texts (SKETCH counters of one byte,
   exact to 15, then in eighths of a power of two), then the shingle's hash. A counter of 1 proves that
   a shingle is unique, so it needs no posting.
3. Sets with the same size and the same prefix are one group, whose prefix is posted once. A posting goes
   to the bucket of its shingle with the group's members and a parity bitmap of each; a shingle of more than
   HOT sets is spread over a grid of cells, of which each posting takes one row and column, and a group
   that its rarest shingle allows to be larger than HOT is split by the hash of its members.
4. Each bucket pairs up groups within the bounds of length and position, expands the pairs (and the
   groups themselves) to members, and drops those whose bitmaps prove too large a difference. No bound
   loses a pair.
5. Postings grow faster than the texts, since a set meets more buckets; buckets are therefore worked off in
   rounds, each of which writes about ROUND_BYTES a shingle at most and drops its shuffle files.
6. Where candidates outnumber their sets, sets of 16 bits a shingle, whose overlap is never below the true
   one, drop most first. The remaining pairs of members are verified on the whole sets; sets expand to their
   texts at the end.

Defined cases: null, empty and short texts (fewer than min_words words) are in no pair and their
own class; a repeated key is one text (the one with the smallest set hash); null keys are left out.
"""

from __future__ import annotations

import gc
import math
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moorgrid.llm.words import mix, shingle_sets
from moorgrid.operators.orphans import bloom, bloom_blocks, probe
from moorgrid.session import checkpoint, parallelism

SKETCH = 1 << 24
SKETCH_PART = 1 << 18
SKETCH_FLUSH = 1 << 21
MAP_WORDS = 8  # a bitmap of 512 bits
HOT = 4096  # sets in one cell of a shingle's grid
SLICE, FLUSH_DOCS, EXPAND = 1024, 8192, 1 << 21
FLUSH_POSTS = 1 << 21  # postings held at once, cells of hot shingles included
ROUND_BYTES, ROUND_LEAST = 8, 1 << 28  # bytes of postings a round may write: a shingle of all sets, and at least
HEAD = "kind INT, key STRING, grp BIGINT, n INT, payload BINARY"
BUCKET = "bucket INT, groups BINARY, sizes BINARY, many BINARY, sets BINARY, maps BINARY, toks BINARY, owners BINARY, places BINARY"
FIRST, SIDE, PLACE = np.uint32(1 << 31), 29, np.uint32((1 << 29) - 1)


def set_hash(s: np.ndarray, seed: int = 0) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes(), seed)).astype(np.int64))


def _sliced(batches):
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            yield b.slice(at, SLICE)


def need(a, b, t: float):
    """Fewest shared shingles of a pair of sizes a and b that reaches the similarity t."""
    return np.ceil(t * (a + b) / (1 + t) - 1e-9).astype(np.int64)


def _heads(k: int, min_words: int):
    """Pass 1: (key, set, size) of every text and the task's counts of shingles."""

    def counted(held):
        at, c = np.unique(np.concatenate(held), return_counts=True)
        cut = np.searchsorted(at, np.arange(0, SKETCH + 1, SKETCH_PART))
        rows = [(p, a, b) for p, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]
        data = [zlib.compress(np.diff(at[a:b], prepend=0).astype("<u4").tobytes() + c[a:b].astype("<u4").tobytes(), 1) for _, a, b in rows]
        m = len(rows)
        return pa.RecordBatch.from_arrays([pa.array([1] * m, pa.int32()), pa.nulls(m, pa.string()), pa.array([r[0] for r in rows], pa.int64()), pa.array([int(b - a) for _, a, b in rows], pa.int32()), pa.array(data, pa.binary())], names=["kind", "key", "grp", "n", "payload"])

    def run(batches):
        held, n_held, seen = [], 0, set()
        for b in _sliced(batches):
            names = b.column(0).to_pylist()
            which, start, s = shingle_sets(b.column(1).to_pylist(), k, min_words)
            place = (s & np.uint64(SKETCH - 1)).astype(np.uint32)
            groups = [set_hash(s[x:y]) for x, y in zip(start[:-1], start[1:])]
            if len(which):
                m = len(which)
                yield pa.RecordBatch.from_arrays([pa.array([0] * m, pa.int32()), pa.array([names[i] for i in which], pa.string()), pa.array(groups, pa.int64()), pa.array(np.diff(start).astype(np.int32)), pa.nulls(m, pa.binary())], names=["kind", "key", "grp", "n", "payload"])
            for g, x, y in zip(groups, start[:-1], start[1:]):
                if g not in seen:
                    seen.add(g)
                    held.append(place[x:y])
                    n_held += y - x
            if n_held > SKETCH_FLUSH:
                yield counted(held)
                held, n_held = [], 0
        if held:
            yield counted(held)

    return run


def _code(c: np.ndarray) -> np.ndarray:
    """Counts as one byte each, in their order: exact to 15, then in eighths of a power of two."""
    return np.where(c < 16, c, np.minimum(255, 16 + np.floor((np.log2(np.maximum(c, 16)) - 4) * 8))).astype(np.uint8)


COUNT_OF = np.r_[np.arange(16), np.ceil(2 ** (4 + (np.arange(16, 256) - 15) / 8))].astype(np.int64)  # the most that a code can stand for


def _add_sketches(batches):
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for part, n, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            x = np.frombuffer(zlib.decompress(data), dtype="<u4").reshape(2, n)
            if part not in total:
                total[part] = np.zeros(SKETCH_PART, dtype=np.int64)
            total[part][np.cumsum(x[0], dtype=np.int64) - part * SKETCH_PART] += x[1]
    for part, c in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([zlib.compress(_code(c).tobytes(), 1)], pa.binary())], names=["grp", "payload"])


def _sketch(head: DataFrame) -> np.ndarray:
    """Counters of all texts: SKETCH of one byte each (16 MiB), whatever the number of texts."""
    parts = head.where("kind = 1").select("grp", "n", "payload").repartition("grp").mapInArrow(_add_sketches, "grp BIGINT, payload BINARY").collect()
    out = np.zeros(SKETCH, dtype=np.uint8)
    for r in parts:
        out[r["grp"] * SKETCH_PART : (r["grp"] + 1) * SKETCH_PART] = np.frombuffer(zlib.decompress(r["payload"]), dtype=np.uint8)
    return out


def _bitmaps(s: np.ndarray, start: np.ndarray) -> np.ndarray:
    own = np.repeat(np.arange(len(start) - 1), np.diff(start))
    bit = ((s >> np.uint64(40)) & np.uint64(64 * MAP_WORDS - 1)).astype(np.int64)
    odd = np.bincount(own * (64 * MAP_WORDS) + bit, minlength=(len(start) - 1) * 64 * MAP_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64).reshape(-1, MAP_WORDS)


def _cells(tok: np.ndarray, salt: np.ndarray, count: np.ndarray):
    """(posting, token, side) of every cell that a posting goes to: one, or a row and column of a grid for hot shingles."""
    rows = np.maximum(1, -(-count // HOT))
    at = np.arange(len(tok))
    plain = rows == 1
    out = [(at[plain], tok[plain], np.zeros(plain.sum(), dtype=np.uint32))]
    if not plain.all():
        i = np.repeat(at[~plain], rows[~plain])
        r = rows[i]
        j = np.arange(len(i)) - np.repeat(np.cumsum(rows[~plain]) - rows[~plain], rows[~plain])
        own = (salt[i] % r.astype(np.uint64)).astype(np.int64)
        cell = np.minimum(own, j) * r + np.maximum(own, j) + 1
        side = np.where(own == j, 0, np.where(own < j, 1, 2)).astype(np.uint32)
        out.append((i, mix(tok[i] ^ (cell.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))), side))
    return [np.concatenate(x) for x in zip(*out)]


def _rounds(sets: int, shingles: int, t: float, buckets: int) -> list[tuple[int, int]]:
    """Ranges of buckets that are worked off one after the other: what each writes is bounded by the input."""
    posts = (1 - t) * shingles + sets  # prefixes, as if no shingle were unique
    per = posts / max(sets, 1)
    met = buckets * (1 - (1 - 1 / buckets) ** per)  # buckets that a set goes to
    size = 10 * posts + (24 + 8 * MAP_WORDS) * sets * met
    n = min(buckets, max(1, math.ceil(size / max(ROUND_LEAST, ROUND_BYTES * shingles))))
    cut = [buckets * i // n for i in range(n + 1)]
    return list(zip(cut[:-1], cut[1:]))


def _postings(sent, k: int, min_words: int, t: float, buckets: int, of: tuple[int, int] | None = None):
    """Pass 2: prefix postings of groups by bucket; of: the range of buckets that are wanted."""
    low, high = of or (0, buckets)

    def flush(groups: dict):
        ids = np.array(list(groups), dtype=np.int64)
        each = list(groups.values())  # (size, tokens, positions, counts, members, bitmaps)
        n_tok = [len(g[1]) for g in each]
        tok, pos, count = (np.concatenate([g[i] for g in each]) for i in (1, 2, 3))
        own = np.repeat(np.arange(len(each)), n_tok)
        first = np.zeros(len(tok), dtype=bool)
        first[np.cumsum([0, *n_tok])[:-1]] = True
        salt = mix(ids.view(np.uint64))[own]
        i, cell, side = _cells(tok, salt, count)
        place = pos[i].astype(np.uint32) | (side << np.uint32(SIDE)) | np.where(first[i], FIRST, np.uint32(0))
        own = own[i]
        m = mix(cell)
        where = (m % np.uint64(buckets)).astype(np.int64)
        if high - low < buckets:
            keep = np.flatnonzero((where >= low) & (where < high))
            m, where, own, place = m[keep], where[keep], own[keep], place[keep]
        short = (m >> np.uint64(32)).astype(np.uint32)
        order = np.argsort(where, kind="stable")
        cut = np.searchsorted(where[order], np.arange(buckets + 1))
        many = np.array([len(g[4]) for g in each], dtype=np.uint32)
        lo = np.cumsum(np.r_[0, many])
        sets, maps = np.array([x for g in each for x in g[4]], dtype=np.int64), np.stack([x for g in each for x in g[5]])
        sizes = np.array([g[0] for g in each], dtype=np.int32)
        single = bool((many == 1).all())
        out = []
        for b in np.flatnonzero(np.diff(cut)):
            at = order[cut[b] : cut[b + 1]]
            used, local = np.unique(own[at], return_inverse=True)
            member = used if single else np.concatenate([np.arange(lo[u], lo[u + 1]) for u in used])
            out.append((int(b), ids[used].tobytes(), sizes[used].tobytes(), many[used].tobytes(), sets[member].tobytes(), maps[member].tobytes(), short[at].tobytes(), local.astype(np.uint16).tobytes(), place[at].tobytes()))
        cols = list(zip(*out)) or [()] * 9
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=[x.split()[0] for x in BUCKET.split(", ")])

    def run(batches):
        code, groups, seen, posts = sent.value, {}, set(), 0
        for b in _sliced(batches):
            _, start, s = shingle_sets(b.column(0).to_pylist(), k, min_words)
            if len(start) < 2:
                continue
            maps, c = _bitmaps(s, start), code[(s & np.uint64(SKETCH - 1)).astype(np.int64)]
            own = np.repeat(np.arange(len(start) - 1, dtype=np.uint16), np.diff(start))
            order = np.argsort(c, kind="stable")
            order = order[np.argsort(own[order], kind="stable")]  # by text, then rarity, then hash
            for i, (x, y) in enumerate(zip(start[:-1].tolist(), start[1:].tolist())):
                g = set_hash(s[x:y])
                if g in seen:
                    continue
                seen.add(g)
                n = y - x
                head = order[x : x + n - math.ceil(t * n - 1e-9) + 1]
                pos = np.flatnonzero(c[head] > 1)
                if not len(pos):
                    continue  # every shingle of the prefix is unique
                tok, count = s[head], COUNT_OF[c[head]]
                # all members have the prefix's rarest shingle, so its count bounds the group
                split = -(-int(count.min()) // HOT)
                group = set_hash(tok, (n << 16) + (g % split if split > 1 else 0))
                if group in groups:
                    groups[group][4].append(g)
                    groups[group][5].append(maps[i])
                else:
                    groups[group] = (n, tok[pos], pos, count[pos], [g], [maps[i]])
                    posts += int((-(-count[pos] // HOT)).sum())
                if posts >= FLUSH_POSTS:
                    yield flush(groups)
                    groups, posts = {}, 0
            if len(groups) >= FLUSH_DOCS:
                yield flush(groups)
                groups, posts = {}, 0
        if groups:
            yield flush(groups)

    return run


def _crossed(lo_x, n_x, lo_y, n_y):
    """All pairs of members of paired groups."""
    n = n_x * n_y
    of = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    return lo_x[of] + at // n_y[of], lo_y[of] + at % n_y[of]


def _bucket_pairs(rows: list[tuple], t: float):
    """Candidate pairs of sets of one bucket."""
    grp = np.concatenate([np.frombuffer(r[0], dtype=np.int64) for r in rows])
    size = np.concatenate([np.frombuffer(r[1], dtype=np.int32) for r in rows]).astype(np.int64)
    many = np.concatenate([np.frombuffer(r[2], dtype=np.uint32) for r in rows]).astype(np.int64)
    sets = np.concatenate([np.frombuffer(r[3], dtype=np.int64) for r in rows])
    maps = np.concatenate([np.frombuffer(r[4], dtype=np.uint64).reshape(-1, MAP_WORDS) for r in rows])
    base = np.cumsum([0, *(len(r[0]) // 8 for r in rows)])
    tok = np.concatenate([np.frombuffer(r[5], dtype=np.uint32) for r in rows]).astype(np.int64)
    own = np.concatenate([np.frombuffer(r[6], dtype=np.uint16).astype(np.int64) + o for r, o in zip(rows, base)])
    place = np.concatenate([np.frombuffer(r[7], dtype=np.uint32) for r in rows])
    # one group from several tasks: its members are joined, its postings kept once
    _, head, name = np.unique(grp, return_index=True, return_inverse=True)
    of = np.repeat(name, many)
    order = np.lexsort((sets, of))
    of, sets, maps = of[order], sets[order], maps[order]
    new = np.r_[True, (of[1:] != of[:-1]) | (sets[1:] != sets[:-1])][: len(of)]
    of, sets, maps = of[new], sets[new], maps[new]
    lo = np.searchsorted(of, np.arange(len(head) + 1))
    keep = head[name[own]] == own
    tok, own, place = tok[keep], name[own[keep]], place[keep]
    size, many = size[head], np.diff(lo)
    pos, side = (place & PLACE).astype(np.int64), ((place >> np.uint32(SIDE)) & np.uint32(3)).astype(np.int64)
    found = []

    def checked(x, y, alpha):
        """Members of paired groups whose bitmaps allow alpha shared shingles."""
        a, b = _crossed(lo[x], many[x], lo[y], many[y])
        n = many[x] * many[y]
        alpha, both = np.repeat(alpha, n), np.repeat(size[x] + size[y], n)
        apart = np.zeros(len(a), dtype=np.int64)
        for w in range(MAP_WORDS):
            apart += np.bitwise_count(maps[a, w] ^ maps[b, w])
        ok = ((both - apart) // 2 >= alpha) & (sets[a] != sets[b])
        if ok.any():
            p, q = sets[a[ok]], sets[b[ok]]
            found.append(np.unique(np.stack([np.minimum(p, q), np.maximum(p, q)], axis=1), axis=0))

    own_pairs = np.unique(own[(place & FIRST) > 0])
    for g in own_pairs[many[own_pairs] > 1]:
        checked(np.array([g]), np.array([g]), need(size[[g]], size[[g]], t))
    a = size[own]
    order = np.lexsort((a, tok))
    tok, own, pos, side, a = tok[order], own[order], pos[order], side[order], a[order]
    c = t / (1 + t)
    most = np.floor((a - pos) / c - a + 1e-9).astype(np.int64)  # largest partner that this position allows
    key = (tok << 22) | np.minimum(a, (1 << 22) - 1)
    end = np.searchsorted(key, (tok << 22) | np.clip(most, 0, (1 << 22) - 1), side="right")
    end = np.where(most >= a, end, 0)
    n = np.maximum(end - np.arange(len(tok)) - 1, 0)
    start = np.flatnonzero(n)
    done = np.cumsum(n[start])
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(done, (done[i - 1] if i else 0) + EXPAND, side="right")))
        part = start[i:j]
        x = np.repeat(part, n[part])
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
        alpha = need(a[x], a[y], t)
        ok = (pos[x] <= a[x] - alpha) & (pos[y] <= a[y] - alpha) & ((side[x] == 0) | (side[x] != side[y]))
        x, y, alpha = x[ok], y[ok], alpha[ok]
        weight = np.cumsum(many[own[x]] * many[own[y]]) if len(x) else np.empty(0, dtype=np.int64)
        at = 0
        while at < len(x):
            to = max(at + 1, int(np.searchsorted(weight, (weight[at - 1] if at else 0) + EXPAND, side="right")))
            checked(own[x[at:to]], own[y[at:to]], alpha[at:to])
            at = to
        i = j
    return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), dtype=np.int64)


def _candidates(t: float):
    def run(batches):
        held: dict[int, list[tuple]] = {}
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                held.setdefault(r[0], []).append(r[1:])
        for bucket in list(held):
            p = _bucket_pairs(held.pop(bucket), t)
            yield pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], names=["ga", "gb"])

    return run


def _sets(k: int, min_words: int, short: bool = False):
    """(grp, items) of every set; short: 16 bits a shingle, equal values as often as they occur."""

    def run(batches):
        for b in _sliced(batches):
            _, start, s = shingle_sets(b.column(0).to_pylist(), k, min_words)
            each = [s[x:y] for x, y in zip(start[:-1], start[1:])]
            data = [np.sort((x >> np.uint64(24)).astype(np.uint16)).tobytes() if short else x.tobytes() for x in each]
            yield pa.RecordBatch.from_arrays([pa.array([set_hash(x) for x in each], pa.int64()), pa.array(data, pa.binary())], names=["grp", "items"])

    return run


def _shared(x: bytes, y: bytes, short: bool) -> tuple[int, int]:
    """(shared shingles, sizes of both); of short sets at least as many as are shared."""
    x, y = (np.frombuffer(b, dtype=np.uint16 if short else np.uint64) for b in (x, y))
    both = len(x) + len(y)
    if not short:
        return both - len(np.union1d(x, y)), both
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return int((y[at] == x).sum()), both


def _verify(t: float, short: bool = False):
    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                o, both = _shared(x, y, short)
                keep.append(o >= t * (both - o) - 1e-9)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], names=["ga", "gb"])

    return run


def _collect(spark) -> None:
    """Lets the driver's garbage go, and with it the shuffle files of what is no longer used."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def group_pairs(df: DataFrame, key: str, text: str, t: float = 0.8, k: int = 5, min_words: int = 0) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): members (key, grp) of every text with a shingle set; verified pairs (ga, gb) of groups."""
    spark = df.sparkSession
    docs = df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).where("key IS NOT NULL AND text IS NOT NULL")
    head = checkpoint(docs.mapInArrow(_heads(k, min_words), HEAD))
    members = head.where("kind = 0").groupBy("key").agg(F.min("grp").alias("grp"))
    n, total = head.where("kind = 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    sent = spark.sparkContext.broadcast(_sketch(head))
    buckets = max(parallelism(spark), math.ceil(n / 16384))
    cands = None
    for of in _rounds(n, total, t, buckets):
        posted = docs.select("text").mapInArrow(_postings(sent, k, min_words, t, buckets, of), BUCKET)
        got = checkpoint(posted.repartitionById(of[1] - of[0], F.col("bucket") - of[0]).mapInArrow(_candidates(t), "ga BIGINT, gb BIGINT"))
        cands = got if cands is None else cands.unionByName(got)
        del posted
        _collect(spark)
    cands = checkpoint(cands.distinct())

    def verified(links: DataFrame, short: bool) -> DataFrame:
        # texts of groups in a candidate pair: one key per group, found by a filter of bounded size
        wanted = links.select(F.explode(F.array("ga", "gb")).alias("grp")).distinct()
        reps = checkpoint(members.groupBy("grp").agg(F.min("key").alias("key")).join(wanted, "grp", "left_semi"))
        m = reps.count()
        if short and links.count() <= 2 * m:
            return links
        blocks = bloom_blocks(m)
        some = probe(docs, "key", bloom(reps, "key", blocks), blocks).where("maybe").select("text")
        sets = some.mapInArrow(_sets(k, min_words, short), "grp BIGINT, items BINARY").groupBy("grp").agg(F.first("items").alias("items"))
        sets = sets.join(wanted, "grp", "left_semi")
        left = links.join(sets.select(F.col("grp").alias("ga"), F.col("items").alias("x")), "ga")
        both = left.join(sets.select(F.col("grp").alias("gb"), F.col("items").alias("y")), "gb").select("ga", "gb", "x", "y")
        return checkpoint(both.mapInArrow(_verify(t, short), "ga BIGINT, gb BIGINT"))

    return members, verified(verified(cands, True), False)


def pairs(df: DataFrame, key: str, text: str, t: float = 0.8, k: int = 5, min_words: int = 0) -> DataFrame:
    """(a, b), a < b by code point: every pair of keys with similar texts."""
    members, links = group_pairs(df, key, text, t, k, min_words)
    members = checkpoint(members)
    a, b = members.select(F.col("key").alias("x"), F.col("grp").alias("ga")), members.select(F.col("key").alias("y"), F.col("grp").alias("gb"))
    across = links.join(a, "ga").join(b, "gb").select("x", "y")
    # copies: a large group's rows are spread over parts, each of which meets all of its copies
    copies = members.groupBy("grp").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("grp", F.ceil(F.col("m") / HOT).cast("int").alias("parts"))
    own = members.join(copies, "grp").select("grp", "key", "parts")
    one = own.select("grp", F.col("key").alias("x"), F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part"))
    all_parts = own.select("grp", F.col("key").alias("y"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    within = one.join(all_parts, ["grp", "part"]).where("x < y").select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(grp, root): the smallest group of each connected set of links, by label exchange with shortcuts."""
    edges = checkpoint(links.select("ga", "gb").unionByName(links.select(F.col("gb").alias("ga"), F.col("ga").alias("gb"))).distinct())
    label = edges.groupBy("ga").agg(F.min("gb").alias("m")).select(F.col("ga").alias("grp"), F.least("ga", "m").alias("root"))
    label = checkpoint(label)
    for _ in range(rounds):
        near = edges.join(label.select(F.col("grp").alias("gb"), F.col("root").alias("r")), "gb").groupBy("ga").agg(F.min("r").alias("r"))
        step = label.join(near, label["grp"] == near["ga"]).select("grp", "root", F.least("root", "r").alias("low"))
        jump = step.join(label.select(F.col("grp").alias("low"), F.col("root").alias("far")), "low", "left")
        after = checkpoint(jump.select("grp", F.col("root").alias("was"), F.least("low", F.coalesce("far", "low")).alias("root")))
        label = after.select("grp", "root")
        if not after.where("was <> root").limit(1).count():
            return label
    raise RuntimeError("components did not settle")


def classes(df: DataFrame, key: str, text: str, t: float = 0.8, k: int = 5, min_words: int = 0) -> DataFrame:
    """(key, class_id, n_links): one row per key; class_id is the smallest key of the class, n_links its similar keys."""
    members, links = group_pairs(df, key, text, t, k, min_words)
    members = checkpoint(members)
    size = members.groupBy("grp").agg(F.count(F.lit(1)).alias("size"))
    ends = links.select("ga", "gb").unionByName(links.select(F.col("gb").alias("ga"), F.col("ga").alias("gb")))
    reach = ends.join(size.withColumnRenamed("grp", "gb"), "gb").groupBy("ga").agg(F.sum("size").alias("others")).withColumnRenamed("ga", "grp")
    root = components(links)
    per_group = size.join(reach, "grp", "left").join(root, "grp", "left").select("grp", F.coalesce("root", "grp").alias("root"), (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    own = members.join(per_group, "grp")
    name = own.groupBy("root").agg(F.min("key").alias("class_id"))
    named = own.join(name, "root").select("key", "class_id", "n_links")
    every = df.select(F.col(key).cast("string").alias("key")).where("key IS NOT NULL").distinct()
    return every.join(named, "key", "left").select(F.col("key").alias(key), F.coalesce("class_id", "key").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
