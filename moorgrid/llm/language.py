"""Language of each page and of each of its segments by nearest centroids of character n-grams.

A segment (a sentence or a line; of more than LONG_WORDS words, each piece of WINDOW_WORDS) is a TF-IDF vector of hashed letter trigrams, normalised to length
one. Each language has several centroids, fitted on a bounded sample: the SAMPLE_PER_LANG pages with
the smallest key hashes of every claimed language, copies of a text once. Claims may be wrong and pages mixed, so pages
that lie nearer to another language's mean leave the sample, the segments of the others move to the
language whose trigram frequencies make them likeliest, and each language's segments are then
clustered (spherical k-means). A language of fewer than FEW_PAGES pages has no mean to trust: its
pages leave when they lie as near to a larger language's mean, to a mix of two or to filler as
pages of those do; what is left makes it a language like the others.
Filler text has centroids of its own. A segment takes the language of the centroid with the
largest cosine; it is rejected when that is filler, or when the cosine is below the distance bound
of the language. Segments too short to tell take the language of their neighbour in the page.

Defined cases: null and empty texts have no segments; a page without a decided segment has no
language; segments without a letter are undecided; a repeated key is one page; null keys are left
out; a page of one endless line is scanned whole, in pieces.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moorgrid.llm.residue_examples import filler as filler_lines

DIM, CENTROIDS, SAMPLE_PER_LANG, SAMPLE_CHARS, FEW_PAGES = 2048, 6, 200, 50_000, 8
SHORT_LETTERS, MARGIN, WEAK, BOUND_QUANTILE, BOUND_SHARE = 14, 0.02, 0.2, 0.01, 0.7
TEMPERATURE = 0.04
FEW_SHARE, WASTE, FEW_SEGMENTS = 0.85, 0.35, 48

_TABLE = np.zeros(0x110000, dtype=np.uint8)  # 1 letter, 2 digit, 0 other
for _o in range(0x110000):
    _c = chr(_o)
    if _c.isalnum():
        _TABLE[_o] = 1 if _c.isalpha() else 2
_BREAKS = np.array([10, 11, 12, 13, 0x85, 0x2028, 0x2029], dtype=np.uint32)
_STOPS = np.array([ord(c) for c in ".!?…。"], dtype=np.uint32)
_CLOSED_STOPS = np.array([ord(c) for c in "。！？｡"], dtype=np.uint32)  # no blank follows these
LONG_WORDS, WINDOW_WORDS = 30, 15
_BLANKS = np.array([9, 32, 0xA0], dtype=np.uint32)


class Segments:
    """Segments of many texts: their document, words, letters and trigram counts."""

    def __init__(self, texts: list[str | None]):
        own = [(t or "").lower() for t in texts]
        joined = "\n".join(own) + "\n\n"
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        kind = _TABLE[codes]
        end = np.isin(codes, _BREAKS)
        end[1:] |= np.isin(codes[1:], _BLANKS) & np.isin(codes[:-1], _STOPS)
        end[1:] |= np.isin(codes[:-1], _CLOSED_STOPS)
        word = (kind > 0) & ~np.r_[False, kind[:-1] > 0]
        at = np.flatnonzero(word)
        of = np.cumsum(end)[at]
        nth = np.arange(len(at)) - np.searchsorted(of, of)
        long = np.bincount(of)[of] > LONG_WORDS if len(of) else np.zeros(0, dtype=bool)
        end[at[long & (nth > 0) & (nth % WINDOW_WORDS == 0)]] = True
        seg = np.cumsum(end)
        letter = kind == 1
        c = np.where(letter, codes, 32).astype(np.uint32)
        mid = np.flatnonzero(letter[1:-1]) + 1
        h = (c[mid - 1] * np.uint32(0x9E3779B1)) ^ (c[mid] * np.uint32(0x85EBCA6B)) ^ (c[mid + 1] * np.uint32(0xC2B2AE35))
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(13)
        gram = (h & np.uint32(DIM - 1)).astype(np.int64)
        n = int(seg[-1]) + 1
        self.words = np.bincount(seg[word], minlength=n)
        self.letters = np.bincount(seg[mid], minlength=n)
        start = np.cumsum([0, *(len(t) + 1 for t in own)])[:-1]
        first = np.searchsorted(np.flatnonzero(end), start)  # number of ends before the document
        self.doc = np.searchsorted(first, np.arange(n), side="right") - 1
        keep = self.words > 0
        new = np.cumsum(keep) - 1
        self.seg, self.gram = new[seg[mid]], gram
        self.words, self.letters, self.doc = self.words[keep], self.letters[keep], self.doc[keep]
        self.n = int(keep.sum())

    def vectors(self, idf: np.ndarray, a: int, b: int) -> np.ndarray:
        """Unit vectors of the segments a to b."""
        lo, hi = np.searchsorted(self.seg, [a, b])
        m = np.bincount((self.seg[lo:hi] - a) * DIM + self.gram[lo:hi], minlength=(b - a) * DIM).reshape(b - a, DIM).astype(np.float32)
        m *= idf
        norm = np.sqrt(np.einsum("ij,ij->i", m, m))
        norm[norm == 0] = 1
        m /= norm[:, None]
        return m


def _kmeans(x: np.ndarray, start: np.ndarray, rounds: int = 10) -> np.ndarray:
    """Spherical k-means from given centres."""
    c = start.copy()
    for _ in range(rounds):
        c /= np.linalg.norm(c, axis=1, keepdims=True) + 1e-12
        own = (x @ c.T).argmax(axis=1)
        order = np.argsort(own, kind="stable")
        cut = np.searchsorted(own[order], np.arange(len(c) + 1))
        c = np.stack([x[order[a:b]].mean(axis=0) if b > a else c[i] for i, (a, b) in enumerate(zip(cut[:-1], cut[1:]))])
    return c / (np.linalg.norm(c, axis=1, keepdims=True) + 1e-12)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / (np.linalg.norm(v, axis=-1, keepdims=True) + 1e-12)


def fit(sample: list[tuple[str, str]]) -> dict:
    """The model from (language, text) pages; the class after the last language is filler."""
    pages: dict[str, list[str]] = {}
    for lang, text in sample:
        pages.setdefault(lang, []).append(text)
    langs = sorted(pages)
    if not langs:
        return {"langs": [], "idf": np.ones(DIM, dtype=np.float32), "centroids": np.zeros((0, DIM), dtype=np.float32), "of": np.zeros(0, dtype=int), "bound": np.zeros(0)}
    large = np.array([len(pages[x]) >= FEW_PAGES for x in langs])
    if not large.any():
        large[:] = True
    claim = np.array([i for i, x in enumerate(langs) for _ in pages[x]])
    s, waste = Segments([t for x in langs for t in pages[x]]), Segments(filler_lines())
    df = np.bincount(np.unique(s.seg * DIM + s.gram) % DIM, minlength=DIM)
    idf = np.log((1 + s.n) / (1 + df)).astype(np.float32) + 0.1
    filler = waste.vectors(idf, 0, waste.n)
    long = s.letters >= SHORT_LETTERS
    if not long.any():
        long[:] = True
    blocks = [s.vectors(idf, a, min(a + 2048, s.n))[long[a : a + 2048]] for a in range(0, s.n, 2048)]
    x, doc = np.concatenate(blocks) if blocks else np.zeros((0, DIM), dtype=np.float32), s.doc[long]
    del blocks
    # pages nearer to another claim's mean leave
    page = np.zeros((len(claim), DIM), dtype=np.float32)
    if len(x):
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        page[doc[first]] = np.add.reduceat(x, first, axis=0)
    page, waste_mean = _unit(page), _unit(filler.mean(axis=0))
    means = lambda ok: np.stack([_unit(page[ok & (claim == i)].mean(axis=0)) if (ok & (claim == i)).any() else np.zeros(DIM, dtype=np.float32) for i in range(len(langs))])
    good = large[claim]
    for _ in range(4):
        mean = means(good)
        good = large[claim] & ((page @ mean.T).argmax(axis=1) == claim)
    if not large.all():
        near = page @ mean.T
        floor = min(np.median(near[good & (claim == i), i]) for i in np.unique(claim[good])) * FEW_SHARE if good.any() else 2.0
        for z in sorted(np.flatnonzero(~large), key=lambda z: -len(pages[langs[z]])):
            few = np.flatnonzero((claim == z) & page.any(axis=1))
            mean = means(good)
            near = page[few] @ mean.T
            # how much of the page lies in the span of two other languages' means
            like = near.max(axis=1, initial=0)
            for i, j in combinations(np.flatnonzero(mean.any(axis=1)), 2):
                c, u, v = min(float(mean[i] @ mean[j]), 0.99), near[:, i], near[:, j]
                like = np.maximum(like, np.sqrt(np.maximum(u * u + v * v - 2 * c * u * v, 0) / (1 - c * c)))
            good[few] = (like < floor) & (page[few] @ waste_mean < WASTE)
        mean = means(good)
    has = np.bincount(claim[good], minlength=len(langs)) > 0
    if has.any():  # the languages that are left
        langs, mean, claim = [x for x, h in zip(langs, has) if h], mean[has], (np.cumsum(has) - 1)[claim]
    keep = good[doc] & ((x @ mean.T).max(axis=1) > x @ waste_mean)
    x, of_seg = x[keep], claim[doc[keep]]
    for _ in range(3):  # segments move to their likeliest language
        freq = np.zeros((len(langs), DIM), dtype=np.float32)
        for i in range(len(langs)):
            freq[i] = ((of_seg == i).astype(np.float32) @ x) / idf
        total = freq.sum(axis=0)
        p = (freq + 5 * total / max(float(total.sum()), 1e-9)) / (freq.sum(axis=1, keepdims=True) + 5)
        of_seg = (x @ (np.log(p + 1e-9) / idf).T).argmax(axis=1)
    cents, bound, few = [], [], []
    for i in range(len(langs)):
        own = x[of_seg == i]
        if not len(own):
            cents.append(mean[i : i + 1])
            bound.append(0.0)
            continue
        n = min(CENTROIDS, max(1, len(own) * CENTROIDS // FEW_SEGMENTS))
        c = _kmeans(own, np.stack([own[int(k * len(own) / n)] for k in range(n)]))
        cents.append(c)
        if len(own) < FEW_SEGMENTS:
            few.append(i)
        bound.append(float(np.quantile((own @ c.T).max(axis=1), BOUND_QUANTILE)) * BOUND_SHARE)
    for i in few:  # segments that made the centroids say little about the distance of others
        bound[i] = min([bound[i], *(b for j, b in enumerate(bound) if b and j not in few)])
    cents.append(np.stack([waste_mean, *filler[: CENTROIDS - 1]]))
    bound.append(0.0)
    return {"langs": langs, "idf": idf, "centroids": np.concatenate(cents).astype(np.float32), "of": np.repeat(np.arange(len(cents)), [len(y) for y in cents]), "bound": np.array(bound)}


def classify(s: Segments, model: dict, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Language number of every segment (-1: none) and its confidence."""
    n_lang = len(model["langs"])
    lang, conf = np.full(s.n, -1), np.zeros(s.n)
    if not n_lang:
        return lang, conf
    at = np.searchsorted(model["of"], np.arange(n_lang + 1))
    unsure = np.zeros(s.n, dtype=bool)
    for a in range(0, s.n, block):
        b = min(s.n, a + block)
        score = np.maximum.reduceat(s.vectors(model["idf"], a, b) @ model["centroids"].T, at, axis=1)
        best = score.argmax(axis=1)
        top = score[np.arange(b - a), best]
        e = np.exp((score - top[:, None]) / TEMPERATURE)
        conf[a:b] = 1 / e.sum(axis=1)
        second = np.partition(score, -2, axis=1)[:, -2]
        unsure[a:b] = (s.letters[a:b] < SHORT_LETTERS) | (top - second < MARGIN) | ((s.words[a:b] < 7) & (top < WEAK))
        lang[a:b] = np.where((best == n_lang) | (top < model["bound"][best]), -1, best)
    # undecided segments follow the last decided one of their document, else the next
    idx = np.arange(s.n)
    prev = np.maximum.accumulate(np.where(unsure, -1, idx))
    nxt = np.minimum.accumulate(np.where(unsure, s.n, idx)[::-1])[::-1]
    for pick in (nxt, prev):
        ok = unsure & (pick >= 0) & (pick < s.n)
        p = np.clip(pick, 0, max(s.n - 1, 0))
        ok &= s.doc[p] == s.doc
        lang[ok] = lang[p][ok]
    return lang, conf


def code(c: Column) -> Column:
    """The two-letter code of a claim; null where it claims nothing."""
    x = F.lower(F.regexp_extract(c, r"^\s*([A-Za-z]+)", 1))
    return F.when((x != "") & (x != "und"), x)


def claimed_sample(pages: DataFrame, labels: DataFrame, key: str, text: str, label: str, rows: int = SAMPLE_PER_LANG) -> list[tuple[str, str]]:
    """Up to rows pages of each claimed language, by the smallest hashes of their keys.

    Copies of a text count once for a language; pages of more than SAMPLE_CHARS characters take no part
    in the fit (they are classified like all others), so the sample is bounded in size as well. Keys and texts are chosen by their hashes, so only
    chosen texts are moved."""
    claims = labels.select(F.col(key).alias("k"), code(F.col(label)).alias("lang")).where("k IS NOT NULL AND lang IS NOT NULL").distinct()
    texts = pages.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull() & (F.length("t") <= SAMPLE_CHARS)).withColumns({"kh": F.xxhash64("k"), "th": F.xxhash64("t")})
    once = claims.join(texts.select("k", "kh", "th"), "k").groupBy("lang", "th").agg(F.min("kh").alias("kh"))
    w = Window.partitionBy("lang").orderBy("kh", "th")
    chosen = once.withColumn("r", F.row_number().over(w)).where(F.col("r") <= rows).drop("r")
    # at most rows texts for each language
    got = texts.join(F.broadcast(chosen), ["kh", "th"]).select("lang", "t").distinct().collect()
    return sorted((r["lang"], r["t"]) for r in got)


def _apply(sent, per_segment: bool):
    def run(batches):
        model = sent.value
        names = np.array([*model["langs"], ""], dtype=object)
        for b in batches:
            for off in range(0, b.num_rows, 256):
                keys, texts = (c.to_pylist() for c in b.slice(off, 256).columns)
                s = Segments(texts)
                if not s.n:
                    continue
                lang, conf = classify(s, model)
                if per_segment:
                    pos = np.arange(s.n) - np.searchsorted(s.doc, s.doc)
                    cols = [[keys[d] for d in s.doc], pos.astype(np.int32), names[lang], s.words, np.where(lang < 0, 0.0, conf)]
                else:
                    n_lang = len(model["langs"])
                    ok = lang >= 0
                    slot = s.doc[ok] * max(n_lang, 1) + lang[ok]
                    words = np.bincount(slot, weights=s.words[ok], minlength=len(keys) * max(n_lang, 1))
                    sure = np.bincount(slot, weights=s.words[ok] * conf[ok], minlength=len(words))
                    total = np.bincount(s.doc, weights=s.words, minlength=len(keys))
                    at = np.flatnonzero(words)
                    cols = [[keys[i // n_lang] for i in at], np.zeros(len(at), dtype=np.int32), names[at % max(n_lang, 1)], words[at].astype(np.int64), sure[at] / total[at // max(n_lang, 1)]]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1]), pa.array([x or None for x in cols[2]], pa.string()), pa.array(cols[3].astype(np.int64)), pa.array(cols[4].astype(np.float64))], names=["key", "segment", "lang", "n_words", "confidence"])

    return run


def detect(pages: DataFrame, labels: DataFrame, key: str, text: str, label: str, per_segment: bool = False) -> DataFrame:
    """(key, lang, n_words, confidence): the words of each language in a page; confidence is its weighted share.

    With per_segment: (key, segment, lang, n_words, confidence), lang null where a segment is in no language."""
    model = fit(claimed_sample(pages, labels, key, text, label))
    sent = pages.sparkSession.sparkContext.broadcast(model)
    rows = pages.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).where("key IS NOT NULL AND text IS NOT NULL AND text <> ''")
    got = rows.mapInArrow(_apply(sent, per_segment), "key STRING, segment INT, lang STRING, n_words BIGINT, confidence DOUBLE")
    keys = ["key", "segment"] if per_segment else ["key", "lang"]
    best = got.groupBy(*keys).agg(F.max(F.struct("n_words", "confidence", *(["lang"] if per_segment else []))).alias("v"))
    return best.select(F.col("key").alias(key), *(["segment", "v.lang"] if per_segment else ["lang"]), "v.n_words", "v.confidence")


def unclaimed(found: DataFrame, labels: DataFrame, key: str, label: str, min_words: int = 30) -> DataFrame:
    """(key, lang): languages of at least min_words words that no label of the page claims."""
    claims = labels.select(F.col(key), code(F.col(label)).alias("lang")).where(F.col("lang").isNotNull()).distinct()
    return found.where(F.col("n_words") >= min_words).select(key, "lang").join(claims, [key, "lang"], "left_anti")


def main_language(found: DataFrame, key: str) -> DataFrame:
    """(key, lang, confidence): the language of most words of each page."""
    top = found.groupBy(key).agg(F.max(F.struct("n_words", "confidence", "lang")).alias("v"))
    return top.select(key, "v.lang", "v.confidence", "v.n_words")
