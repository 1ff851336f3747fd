"""Lines that recur within one source's documents.

Lines are compared in lower case with white space reduced. For clustering, numbers and dates are
masked in each line, and names where the line shows them by capitals. A line has band keys from
minimum hashes of its masked words, plus one key of the line itself, so equal lines always meet.
All keys belong to one source. Steps:

1. Band keys (64-bit numbers) are counted over all documents. The keys that occur key_docs times enter
   a Bloom filter of a bounded size (8 MiB), whatever their number; a line none of whose keys passes it
   is dropped where it is read. With key_docs = 2, the default, such a line is alone in its cluster and
   on one page, so clusters are whole however thin their links are. With key_docs = min_docs every line
   that by itself is on min_docs pages is left, as each line has a key of its own: that is all that
   frequent_lines needs, and far less data.
2. The lines left are counted exactly: distinct documents per (source, line).
3. Lines of a source with the same set of masked words are one group, whatever their bands. Within
   each source, all groups that share a band key and whose masked words have the similarity
   MIN_LIKE are connected: a bucket is searched breadth first over an index of prefixes in order of
   rarity, and a group that is reached leaves the index, so a bucket of n groups like each other
   takes about n comparisons. Connected groups, and those of a line written in several ways, are a
   cluster.
4. Clusters in at least min_docs documents and at least min_share of the source's documents recur
   too often; so does, exactly, each of their lines that reaches both bounds by itself.

Defined cases: null texts and empty lines have no lines; a null source is a source of its own; a
repeated url is one document; rows with null url are left out; a line repeated in a document counts
once; texts without any line end are one line, however long.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moorgrid.llm.bits import filter_of, passes
from moorgrid.llm.near_dup import components
from moorgrid.llm.words import mix
from moorgrid.session import checkpoint

BANDS, ROWS, MIN_LIKE = 4, 3, 0.8  # a pair of likeness 0.8 shares a band with probability 0.94
LINES = "lid BIGINT, uid BIGINT, source STRING, line STRING, masked ARRAY<INT>, bands ARRAY<BIGINT>"
_MASKS: dict[str, str] = {}
_HASHES: dict[str, int] = {}


def lines_of(text: str | None) -> list[str]:
    """Lines as written, without the empty ones."""
    return [x for x in text.splitlines() if x.strip()] if text else []


def normal(line: str) -> str:
    return " ".join(line.lower().split())


def _mask(word: str) -> str:
    got = _MASKS.get(word)
    if got is None:
        if len(_MASKS) > 500_000:
            _MASKS.clear()
        core = word.strip(".,;:!?()[]\"'«»„“”")
        if any(c.isdigit() for c in core):
            got = "0"
        elif core[:1].isupper() and not core.isupper():
            got = "@"
        else:
            got = word.lower()
        _MASKS[word] = got
    return got


def _mask_hash(word: str) -> int:
    if len(_HASHES) > 500_000:
        _HASHES.clear()
    h = _HASHES[word] = xxhash.xxh3_64_intdigest(_mask(word))
    return h


def masked(line: str) -> list[int]:
    """Hashes of the words with numbers and names masked; the first word keeps its form, as capitals say nothing there."""
    ws = line.split()
    ws[0] = ws[0].lower()
    get = _HASHES.get
    return [get(w) or _mask_hash(w) for w in ws]


_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))


def line_id(source: str | None, norm: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{len(source) if source is not None else -1}:{source}:{norm}")


def keys_of(sources: list[str | None], norm: list[str], masks: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Line identifiers and band keys (one row per line)."""
    lid = np.array([line_id(s, n) for s, n in zip(sources, norm)], dtype=np.uint64)
    each = {s: xxhash.xxh3_64_intdigest(f"s{s}" if s is not None else "n") for s in set(sources)}
    src = np.array([each[s] for s in sources], dtype=np.uint64)
    flat = np.array([w for m in masks for w in m], dtype=np.uint64)
    at = np.cumsum([0, *map(len, masks)])[:-1]
    keys = np.empty((len(norm), BANDS + 1), dtype=np.uint64)
    keys[:, BANDS] = lid
    for b in range(BANDS):
        acc = src + np.uint64(b)
        for r in range(ROWS):
            low = np.minimum.reduceat(mix(flat ^ _SEEDS[b * ROWS + r]), at)
            acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + low)
        keys[:, b] = acc
    return lid, keys


def _read(b: pa.RecordBatch):
    """Distinct lines of each document of a batch: sources, urls, normal lines, masked words."""
    out = ([], [], [], [])
    for src, url, text in zip(*(c.to_pylist() for c in b.columns)):
        seen = {}
        for line in lines_of(text):
            n = normal(line)
            if n not in seen or (seen[n].isupper() and not line.isupper()):
                seen[n] = line
        for n, line in seen.items():
            out[0].append(src)
            out[1].append(url)
            out[2].append(n)
            out[3].append(masked(line))
    return out


def _slices(batches, rows: int = 1024):
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def url_id(url: str) -> int:
    """A signed 64-bit number for a url."""
    h = xxhash.xxh3_64_intdigest(url)
    return h - (1 << 64) if h >> 63 else h


KEY_BITS, PARTS, HELD = 48, 4096, 1 << 21


def _short(keys: np.ndarray) -> np.ndarray:
    """Keys as they are counted: keys that share their low bits count together, so a count is never too small."""
    return keys & np.uint64((1 << KEY_BITS) - 1)


def _keys(batches):
    """(part, keys): the task's keys, sorted, as differences; a key costs some four bytes instead of a row."""

    def packed(held):
        k = np.sort(np.concatenate(held))
        cut = np.searchsorted(k, np.arange(PARTS + 1, dtype=np.uint64) << np.uint64(KEY_BITS - PARTS.bit_length() + 1))
        at = np.flatnonzero(np.diff(cut))
        data = []
        for p in at:
            own = k[cut[p] : cut[p + 1]]
            d = np.diff(own, prepend=own[:1] - own[:1] + (np.uint64(p) << np.uint64(KEY_BITS - PARTS.bit_length() + 1)))
            data.append(zlib.compress(d.view(np.uint8).reshape(-1, 8)[:, : (KEY_BITS + 7) // 8 - 1].T.tobytes(), 1))
        return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(data, pa.binary())], names=["part", "keys"])

    held, n = [], 0
    for b in _slices(batches):
        src, _, norm, masks = _read(b)
        if norm:
            held.append(_short(keys_of(src, norm, masks)[1].ravel()))
            n += len(held[-1])
        if n >= HELD:
            yield packed(held)
            held, n = [], 0
    if held:
        yield packed(held)


def _often(least: int):
    """(band): keys that occur that often; all rows of a part are in one task."""

    def run(batches):
        held: dict[int, list[np.ndarray]] = {}
        width = (KEY_BITS + 7) // 8 - 1
        for b in batches:
            for part, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(width, -1)
                d = np.zeros((raw.shape[1], 8), dtype=np.uint8)
                d[:, :width] = raw.T
                start = np.uint64(part) << np.uint64(KEY_BITS - PARTS.bit_length() + 1)
                held.setdefault(part, []).append(start + np.cumsum(d.view(np.uint64).ravel(), dtype=np.uint64))
        for part in list(held):
            k, n = np.unique(np.concatenate(held.pop(part)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(k[n >= least].view(np.int64))], names=["band"])

    return run


def _select(sent):
    """Occurrences (lid, uid) of the lines left; each task describes each masked form of a line once."""

    def run(batches):
        filt, seen = sent.value, set()
        for b in _slices(batches):
            src, url, norm, masks = _read(b)
            if not norm:
                continue
            lid, keys = keys_of(src, norm, masks)
            keep = np.flatnonzero(passes(filt, _short(keys)).any(axis=1))
            if len(keep):
                form = [hash((int(lid[i]), *masks[i])) for i in keep]
                new = [f not in seen and not seen.add(f) for f in form]
                only = lambda x: [x[i] if n else None for i, n in zip(keep, new)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(lid[keep].view(np.int64)),
                        pa.array([url_id(url[i]) for i in keep], pa.int64()),
                        pa.array(only(src), pa.string()),
                        pa.array(only(norm), pa.string()),
                        pa.array([[w % (1 << 31) for w in m] if m is not None else None for m in only(masks)], pa.list_(pa.int32())),
                        pa.array(only(keys.view(np.int64)), pa.list_(pa.int64())),
                    ],
                    names=["lid", "uid", "source", "line", "masked", "bands"],
                )

    return run


def connected(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the first set of its component; sets of the similarity MIN_LIKE are connected."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    root = np.full(n, -1)
    if n == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([0, 0 if both >= MIN_LIKE * (size.sum() - both) - 1e-9 else 1])
    words, word = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(word, minlength=len(words))
    order = np.empty(len(words), dtype=np.int64)
    order[np.argsort(often, kind="stable")] = np.arange(len(words))
    own = [np.sort(w) for w in np.split(order[word], np.cumsum(size)[:-1])]  # rarest first
    prefix = [w[: len(w) - int(np.ceil(MIN_LIKE * len(w) - 1e-9)) + 1] for w in own]
    index: dict[int, list[int]] = {}
    for i, p in enumerate(prefix):
        for w in p.tolist():
            index.setdefault(w, []).append(i)
    as_sets = [set(w.tolist()) for w in own]
    for start in range(n):
        if root[start] >= 0:
            continue
        root[start], todo = start, [start]
        while todo:
            i = todo.pop()
            tried = set()
            for w in prefix[i].tolist():
                left = []
                for j in index[w]:
                    if root[j] >= 0:
                        continue
                    if j not in tried:
                        tried.add(j)
                        both = len(as_sets[i] & as_sets[j]) if MIN_LIKE * size[i] <= size[j] + 1e-9 and MIN_LIKE * size[j] <= size[i] + 1e-9 else 0
                        if both and both >= MIN_LIKE * (size[i] + size[j] - both) - 1e-9:
                            root[j] = start
                            todo.append(j)
                            continue
                    left.append(j)
                index[w] = left
    return root


def _link(batches):
    """Links (ga, gb) of the rows (band, gid, words), which come in order of their bands."""

    def links(band, gid, sets):
        out = ([], [])
        cut = np.flatnonzero(np.r_[True, band[1:] != band[:-1], True])
        for a, b in zip(cut[:-1], cut[1:]):
            if b - a > 1:
                root = connected(sets[a:b])
                at = np.flatnonzero(root != np.arange(b - a))
                out[0].extend(gid[a:b][root[at]].tolist())
                out[1].extend(gid[a:b][at].tolist())
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], names=["ga", "gb"])

    band, gid, sets = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), []
    for b in batches:
        values, at = b.column(2).flatten().to_numpy(), np.cumsum(b.column(2).value_lengths().to_numpy())[:-1]
        band = np.r_[band, b.column(0).to_numpy()]
        gid = np.r_[gid, b.column(1).to_numpy()]
        sets = [*sets, *np.split(values, at)] if b.num_rows else sets
        done = int(np.searchsorted(band, band[-1])) if len(band) else 0  # the last bucket may go on
        if done:
            yield links(band[:done], gid[:done], sets[:done])
            band, gid, sets = band[done:], gid[done:], sets[done:]
    yield links(band, gid, sets)


def repeated(df: DataFrame, url: str, source: str, text: str, min_docs: int = 5, min_share: float = 0.1, key_docs: int = 2) -> tuple[DataFrame, DataFrame]:
    """(lines, occurrences): lines (source, line, lid, n_docs, cluster, cluster_docs, n_source) of the clusters
    that recur too often, and where they occur (lid, uid); uid is url_id of the url."""
    docs = df.select(F.col(source).alias("source"), F.col(url).alias("url"), F.col(text).alias("text")).where("url IS NOT NULL")
    total = docs.select("source", F.xxhash64("url").alias("u")).distinct().groupBy("source").agg(F.count(F.lit(1)).alias("n_source"))
    texts = docs.where("text IS NOT NULL")
    often = texts.mapInArrow(_keys, "part INT, keys BINARY").repartition("part").mapInArrow(_often(min(key_docs, min_docs)), "band BIGINT")
    sent = df.sparkSession.sparkContext.broadcast(filter_of(checkpoint(often)))
    at = checkpoint(texts.mapInArrow(_select(sent), LINES))
    once = at.select("lid", "uid").distinct()
    per_line = once.groupBy("lid").agg(F.count(F.lit(1)).alias("n_docs"))
    # a line's written forms may have different masks; each brings its own group
    words = F.sort_array(F.array_distinct("masked"))
    gid = F.xxhash64(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")), words)
    at = at.where("line IS NOT NULL").select("lid", "source", "line", gid.alias("gid"), words.alias("words"), F.slice("bands", 1, BANDS).alias("bands"))
    what = at.groupBy("lid").agg(F.min(F.struct("source", "line")).alias("v"), F.collect_set("gid").alias("gids"))
    lines = checkpoint(what.join(per_line, "lid").select("lid", "v.source", "v.line", F.array_min("gids").alias("gid"), "gids", "n_docs"))
    groups = checkpoint(at.groupBy("gid").agg(F.min(F.struct("words", "bands")).alias("v")).select("gid", "v.words", "v.bands"))
    member = groups.select("gid", "words", F.explode(F.array_distinct("bands")).alias("band"))
    shared = member.groupBy("band").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("band")
    near = member.join(shared, "band").select("band", "gid", "words").repartition("band").sortWithinPartitions("band").mapInArrow(_link, "ga BIGINT, gb BIGINT")
    same = lines.where("size(gids) > 1").select(F.col("gid").alias("ga"), F.explode("gids").alias("gb")).where("ga <> gb")
    root = components(near.unionByName(same).select(F.least("ga", "gb").alias("ga"), F.greatest("ga", "gb").alias("gb")).distinct())
    named = lines.join(root, lines["gid"] == root["grp"], "left").select("lid", "source", "line", "n_docs", F.coalesce("root", "gid").alias("part"))
    first = named.groupBy("part").agg(F.min("lid").alias("cluster"))
    named = checkpoint(named.join(first, "part").drop("part"))
    per_cluster = once.join(named.select("lid", "cluster"), "lid").select("cluster", "uid").distinct().groupBy("cluster").agg(F.count(F.lit(1)).alias("cluster_docs"))
    often = named.join(per_cluster.where(F.col("cluster_docs") >= min_docs), "cluster")
    kept = often.join(total, often["source"].eqNullSafe(total["source"])).drop(total["source"]).where(F.col("cluster_docs") >= min_share * F.col("n_source"))
    return kept, once


def frequent_lines(kept: DataFrame, min_docs: int = 5, min_share: float = 0.1) -> DataFrame:
    """(source, line, n_docs, n_source): lines of frequent clusters that reach both bounds by themselves."""
    return kept.where((F.col("n_docs") >= min_docs) & (F.col("n_docs") >= min_share * F.col("n_source"))).select("source", "line", "n_docs", "n_source")


def _strip(batches):
    for b in batches:
        out = []
        for src, text, gone in zip(*(b.column(i).to_pylist() for i in range(1, 4))):
            if text is None or not gone:
                out.append(text)
                continue
            gone, rest = {g % (1 << 64) for g in gone}, []
            for line in text.splitlines():
                n = normal(line)
                if not n or line_id(src, n) not in gone:
                    rest.append(line)
            out.append("\n".join(rest))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["url", "text"])


def _with_id(batches):
    for b in batches:
        ids = pa.array([url_id(u) for u in b.column(0).to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([*b.columns, ids], names=["url", "source", "text", "uid"])


def cleaned(df: DataFrame, url: str, source: str, text: str, min_docs: int = 5, min_share: float = 0.1) -> DataFrame:
    """(url, text): one row per url, without the lines of clusters that recur too often."""
    kept, at = repeated(df, url, source, text, min_docs, min_share)
    gone = at.join(kept.select("lid").distinct(), "lid", "left_semi").groupBy("uid").agg(F.collect_set("lid").alias("gone"))
    docs = df.select(F.col(url).alias("url"), F.col(source).alias("source"), F.col(text).alias("text")).where("url IS NOT NULL")
    docs = docs.groupBy("url").agg(F.min(F.struct("source", "text")).alias("d")).select("url", "d.source", "d.text")
    named = docs.mapInArrow(_with_id, "url STRING, source STRING, text STRING, uid BIGINT")
    return named.join(gone, "uid", "left").select("url", "source", "text", "gone").mapInArrow(_strip, "url STRING, text STRING")
