"""Template residue, filler and error pages, localised by likelihood ratios of character n-grams.

Character n-gram models are fitted for filler, for error and script notices, for instructions to
the author and for text that talks about templates and errors, each from examples that
residue_examples combines out of common phrases, and for natural prose from all texts of the corpus
(a line that many of them share, digits as one class, counts once, so copies never weigh more than one
text). Residue in them is left out: a first model, whose prose skips the windows that mostly consist of
the examples' n-grams, judges all texts, and the model is fitted again without the lines that only
marked texts have. Counts of more than PROSE_GRAMS n-grams are scaled to that many, so a bound means the
same whatever the size; n-grams expected less than half a time then say nothing, nor do those that a single line has, as it may be the one that is judged. Two more models see only shapes (letters as one class), fitted on unfilled slots
beside the shapes of prose and of urls. A position's score is the logarithm of the ratio of a model
to prose, 0 for an n-gram that neither has; windows whose mean score passes a bound localise
residue, and the share of the text that they cover decides. A word repeated over and over is filler
whatever it is: a model of the text's own last words gives such n-grams the highest score.

* A slot or an instruction counts wherever it stands, unless it is quoted or its surroundings are
  likelier to be talk about templates than prose. Windows of the shape model propose slots; the
  syntax of a slot is then checked exactly, in urls as well; instructions and filler are looked for
  in the url's words by the same models.
* Filler counts when its windows cover FILLER_CHARS characters that are not talk about it either
  (from SURE_CHARS on it is no mere mention).
* A notice counts when the sentences that its windows cover to SENTENCE_SHARE, and that do not talk
  about such things, are NOTICE_SHARE of the page's text.

Defined cases: null and empty texts are no residue by text (their url may be); a repeated key is
one row and is residue if any of its rows is; null keys are left out; texts are scanned whole.
"""

from __future__ import annotations

import re
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moorgrid.llm import residue_examples as X

SIZE = 1 << 20
N = 5
PROSE_ROWS, PROSE_CHARS = 4000, 20_000
PROSE_GRAMS, URL_SHAPES_MOST = 4e6, 4e3  # larger counts are scaled to these
CAP = 4.0
FILLER_CHARS, SURE_CHARS, NOTICE_SHARE, SENTENCE_SHARE = 14, 60, 0.2, 0.5
WINDOW = {"filler": 16, "notice": 16, "instruction": 16}
BOUND = {"filler": 1.5, "notice": 0.5, "instruction": 1.6}
TALK_SPAN = 70
SEED_WINDOW, SEED_SHARE = 20, 0.6
SENTENCE_ENDS = ".!?\n\r"
_ENDS = np.array([ord(c) for c in SENTENCE_ENDS], dtype=np.uint32)

# Slot syntax (fixed values): a name between the marks of a template language.
NAME = r"[A-Za-z][\w.]*"
UPPER = r"(?![a-zß-öø-ÿа-яёіїєґ])[^\W\d_]"
SLOT = re.compile(
    r"\{\{\s*%(n)s\s*\}\}|\$\{\s*%(n)s\s*\}|\{%%\s*[^%%{}\n]{1,60}%%\}|<%%=?\s*[^%%<>\n]{1,60}%%>|%%\(%(n)s\)[sd]|\[\[%(n)s\]\]|<<%(n)s>>|\$\$%(n)s\$\$|@@%(n)s@@|__[A-Z][A-Z0-9_.]*__|%%%(n)s%%"
    r"|\[[A-Z][A-Z0-9_.]+\]|(?<![\w$%%])\{%(n)s\}|<(?:your|my|insert) [^<>\n]{1,40}>|\[(?:%(u)s)+(?:[\s'’-]+(?:%(u)s)+)+\]" % {"n": NAME, "u": UPPER}
)
URL_SLOT = re.compile(r"\{\{?[^{}/]*\}?\}|\$\{?\w+\}|%%?\(\w+\)s|\[\[?\w[\w.]*\]?\]|<<?[\w. %=]+>?>|__[A-Za-z]\w*?__|@@\w+@@|\$\$\w+\$\$|(?<![0-9a-f]):[a-z_]+:|%[A-Za-z_]{3,}%")
SHAPES = ["{{a}}", "{{ a }}", "{{a.a}}", "{{ a.a }}", "${a}", "${a.a}", "{% a a %}", "<%= a %>", "<%= a.a %>", "%(a)a", "%(a.a)a", "[[a]]", "[[a.a]]", "<<a>>", "<<a.a>>", "$$a$$", "$$a.a$$", "@@A@@", "__A__", "%a%", "[A]", "[A.A]", "[A A]", "[A A A]", "{a}", "{a.a}", "<a a>"]
URL_WORD = re.compile(r"[^\W_]+")
URL_GRAMS, URL_BOUND = 7, 3.2  # as many as in lorem ipsum; a url gives less context than a text
URL_SHAPES, URL_BASE = ["{a", "a}", "{{a", "a}}", "$a", ":a:"], 0.05
DIGIT = re.compile(r"\d")
RUN = re.compile(r"[^\W_]+")
REPEAT_SPAN = 18
QUOTES = "\"'«»“”„‘’"


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _hash(codes: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Hashes of the n-grams that start at each position; the last n - 1 positions repeat the last."""
    m = max(len(codes) - n + 1, 0)
    h = np.zeros(m, dtype=np.uint32)
    for j in range(n):
        h = h * np.uint32(0x01000193) + codes[j : j + m] * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return (h >> np.uint32(3)) & np.uint32((1 << bits) - 1)


def _plain(text: str) -> np.ndarray:
    """Code points in lower case with digits as one class and breaks as blanks."""
    c = _codes(text.lower()).copy()
    c[(c >= 48) & (c <= 57)] = 48
    c[c < 32] = 32
    return c


_SHAPE = np.full(0x110000, 97, dtype=np.uint8)
for _c in range(128):
    _SHAPE[_c] = _c if not chr(_c).isalnum() else 65 if chr(_c).isupper() else 97 if chr(_c).isalpha() else 48


def _shape(codes: np.ndarray) -> np.ndarray:
    """Marks as they are; runs of letters keep their first three, which is enough to see an edge."""
    return _SHAPE[codes].astype(np.uint32)


def _counts(texts: list[str], n: int, size: int, shape: bool = False) -> np.ndarray:
    out = np.zeros(size)
    for at in range(0, len(texts), 1024):
        each = [_hash(_shape(_codes(t)) if shape else _plain(t), n, size.bit_length() - 1) for t in texts[at : at + 1024]]
        out += np.bincount(np.concatenate(each), minlength=size)
    return out


SHAPE_N, SHAPE_SIZE = 3, 1 << 14


def _masked(text: str) -> dict[str, str]:
    """The distinct lines of a text by what they are with digits as one class, the smallest of equal ones."""
    out: dict[str, str] = {}
    for line in text.splitlines():
        k = DIGIT.sub("0", " ".join(line.lower().split()))
        if k and (k not in out or line < out[k]):
            out[k] = line
    return out


def examples(without: str | None = None) -> dict[str, list[str]]:
    """The examples of each model; without: the family that is left out."""
    return {"filler": X.filler(without), "notice": X.lines(X.NOTICES, without), "instruction": X.lines(X.INSTRUCTIONS, without), "talk": X.TALK.split("\n")}


def _seen(seeds: dict[str, list[str]]) -> np.ndarray:
    """Which n-grams the examples have."""
    return _counts([t for k, ls in seeds.items() if k != "talk" for t in ls], N, SIZE) > 0


def _within(s: np.ndarray, start: np.ndarray, w: int, bound: float) -> np.ndarray:
    """Positions inside a window of w scores of one piece whose mean passes the bound; a shorter piece is one window."""
    c = np.r_[0, np.cumsum(s, dtype=np.int32)]
    at = np.flatnonzero(c[w:] - c[:-w] >= bound * w) if len(s) >= w else np.empty(0, dtype=np.int64)
    at = at[at + w <= start[np.searchsorted(start, at, side="right")]] if len(at) else at
    few = np.flatnonzero((np.diff(start) < w) & (np.diff(start) > 0))
    few = few[c[start[few + 1]] - c[start[few]] >= bound * (start[few + 1] - start[few])]
    mark = np.bincount(np.r_[at, start[few]], minlength=len(s) + 1) - np.bincount(np.r_[at + w, start[few + 1]], minlength=len(s) + 1)
    return np.cumsum(mark[:-1]) > 0


def _line_counts(lines: list[str], seen: np.ndarray | None = None) -> list[np.ndarray]:
    """Counts of the lines' n-grams: those outside windows of the examples' n-grams (seen), all, and of shapes."""
    first, every, shape = np.zeros(SIZE), np.zeros(SIZE), np.zeros(SHAPE_SIZE)
    for at in range(0, len(lines), 16384):
        own = [f" {x} " for x in lines[at : at + 16384]]
        joined = "".join(own)
        codes, size = _plain(joined), np.array([len(x) for x in own])
        if len(codes) != len(joined):  # lower case of another length
            each = [_plain(x) for x in own]
            codes, size = np.concatenate(each), np.array([len(c) for c in each])
        h = _hash(codes, N, SIZE.bit_length() - 1)
        last = np.cumsum(size)
        keep = np.ones(len(codes), dtype=bool)
        for j in range(1, N):
            keep[np.maximum(last - j, last - size)] = False  # no n-gram over two lines
        h = h[keep[: len(h)]]
        every += np.bincount(h, minlength=SIZE)
        if seen is not None:
            start = np.r_[0, np.cumsum(np.maximum(size - N + 1, 0))]
            first += np.bincount(h[~_within(seen[h], start, SEED_WINDOW, SEED_SHARE)], minlength=SIZE)
        shape += np.bincount(_line_shapes(own), minlength=SHAPE_SIZE)
    return [first, every, shape]


def _line_shapes(lines: list[str]) -> np.ndarray:
    """Shape n-grams of padded lines, none over two lines."""
    last = np.cumsum([len(x) for x in lines])
    h = _hash(_shape(_codes("".join(lines))), SHAPE_N, SHAPE_SIZE.bit_length() - 1)
    keep = np.ones(len(h) + SHAPE_N, dtype=bool)
    for j in range(1, SHAPE_N):
        keep[last - j] = False
    return h[keep[: len(h)]]


def _url_shape(url: str) -> str:
    return RUN.sub(lambda m: m.group()[:3].lower(), unquote(url))


def _url_counts(shapes: list[str]) -> np.ndarray:
    """Each shape of a url counts once, so one form of slot cannot become usual by its number."""
    return _counts(shapes, SHAPE_N, SHAPE_SIZE, True) if shapes else np.zeros(SHAPE_SIZE)


def _marked(texts: list[str | None], model: dict[str, np.ndarray]) -> list[bool]:
    return [bool(maybe) and judge(t, model, maybe)[0] is not None for t, maybe in zip(texts, propose(texts, model))]


def fit(prose: list[str], urls: list[str] = (), without: str | None = None) -> dict[str, np.ndarray]:
    """Score tables: log ratio of each model to prose per hashed n-gram; residue in prose is left out.

    urls: urls of the corpus, for their shape; without: a family of examples to leave out. fit_all is
    the same for a table."""
    seeds = examples(without)
    seen, lines, clean = _seen(seeds), {}, set()
    each = [_masked(t) for t in prose]
    for own in each:
        for k, line in own.items():
            lines[k] = min(line, lines.get(k, line))
    first, every, shape = _line_counts(list(lines.values()), seen)
    shapes = {_url_shape(u) for u in urls if u}
    url = (_url_counts(sorted(shapes)), len(shapes))
    bad = _marked(prose, _tables(first, shape, url, seeds))
    for own, b in zip(each, bad):
        if not b:
            clean.update(own)
    lost = _line_counts([line for k, line in lines.items() if k not in clean])
    return _tables(every - lost[1], shape - lost[2], url, seeds)


LINE = "h BIGINT, ok BOOLEAN, line STRING"
COUNT = "i INT, a BIGINT, b BIGINT, c BIGINT"


def _lines(sent=None):
    """(h, ok, line) of all lines of all texts; with a model: whether an unmarked text has it, the line of marked ones alone."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                texts = [t for t in b.column(0).slice(at, 512).to_pylist() if t]
                out: dict[str, tuple[bool, str | None]] = {}
                for t, bad in zip(texts, _marked(texts, sent.value) if sent else [True] * len(texts)):
                    for k, line in _masked(t).items():
                        ok, was = out.get(k, (False, None))
                        out[k] = (ok or not bad, (line if was is None else min(line, was)) if bad else was)
                rows = [(xxhash.xxh3_64_intdigest(k.encode("utf-8", "surrogatepass")) - (1 << 63), ok, None if ok else line) for k, (ok, line) in out.items()]
                h, ok, line = zip(*rows) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(ok, pa.bool_()), pa.array(line, pa.string())], names=["h", "ok", "line"])

    return run


def _count_lines(sent=None):
    def run(batches):
        seen, total, some = sent.value if sent else None, None, False
        for b in batches:
            got = _line_counts(b.column(0).to_pylist(), seen)
            total, some = got if total is None else [x + y for x, y in zip(total, got)], True
        if some:
            total[2] = np.r_[total[2], np.zeros(SIZE - SHAPE_SIZE)]
            at = np.flatnonzero(total[1] + total[2])
            for x in range(0, len(at), 1 << 16):
                i = at[x : x + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), *(pa.array(c[i].astype(np.int64)) for c in total)], names=["i", "a", "b", "c"])

    return run


def _count_urls(batches):
    for b in batches:
        c = _url_counts(b.column(0).to_pylist())
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(c[at].astype(np.int64)), pa.array([b.num_rows if x == 0 else 0 for x in range(len(at))], pa.int64())], names=["i", "a", "n"])


def _url_shapes(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(list({_url_shape(u) for u in b.column(0).to_pylist() if u}), pa.string())], names=["s"])


def fit_all(df: DataFrame, key: str, text: str, without: str | None = None) -> dict[str, np.ndarray]:
    """fit() of all texts and urls of a table: lines are counted once by an aggregation, the driver gets counters alone."""
    docs, seeds = df.select(F.col(text).alias("t")).where("t IS NOT NULL"), examples(without)

    sc = df.sparkSession.sparkContext

    def counted(lines: DataFrame, seen=None) -> list[np.ndarray]:
        got = lines.select("line").mapInArrow(_count_lines(seen), COUNT).groupBy("i").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("c").alias("c")).toArrow()
        out = [np.zeros(SIZE) for _ in "abc"]
        for x, c in zip(out, "abc"):
            x[got["i"].to_numpy()] = got[c].to_numpy()
        return [*out[:2], out[2][:SHAPE_SIZE]]

    once = lambda lines: lines.groupBy("h").agg(F.max("ok").alias("ok"), F.min("line").alias("line"))
    first, every, shape = counted(once(docs.mapInArrow(_lines(), LINE)), sc.broadcast(_seen(seeds)))
    got = df.select(F.col(key).cast("string").alias("k")).mapInArrow(_url_shapes, "s STRING").distinct().mapInArrow(_count_urls, "i INT, a BIGINT, n BIGINT").groupBy("i").agg(F.sum("a").alias("a"), F.sum("n").alias("n")).toArrow()
    urls = np.zeros(SHAPE_SIZE)
    urls[got["i"].to_numpy()] = got["a"].to_numpy()
    url = (urls, int(got["n"].to_numpy().sum()))
    sent = sc.broadcast(_tables(first, shape, url, seeds))
    lost = counted(once(docs.mapInArrow(_lines(sent), LINE)).where("NOT ok"))
    return _tables(every - lost[1], shape - lost[2], url, seeds)


def _ratio(own: np.ndarray, base: np.ndarray, floor: float) -> np.ndarray:
    """Log ratio of the examples' model to the base; an n-gram that neither has says nothing."""
    p = (base + floor) / (base.sum() + floor * len(base))
    q = (own + 0.25 * own.sum() * p) / (1.25 * own.sum())
    out = np.clip(np.log(q / p), -CAP, CAP)
    out[(own == 0) & (base < 0.5)] = 0.0
    return out.astype(np.float32)


def _tables(grams: np.ndarray, shape: np.ndarray, url: tuple[np.ndarray, int], seeds: dict[str, list[str]]) -> dict[str, np.ndarray]:
    """Score tables for prose with these counts of n-grams and shapes; url: counts of the urls' shapes, and how many."""
    talk, scale = _counts(seeds["talk"], N, SIZE), min(1.0, PROSE_GRAMS / max(grams.sum(), 1))
    grams = np.maximum(grams - 1, 0) * scale  # one line's own n-grams are no evidence that it is prose
    out = {name: _ratio(_counts(ls, N, SIZE), grams + talk, 0.02) for name, ls in seeds.items() if name != "talk"}
    # talk is part of the base that the others are compared with, so only corpus prose is its own base
    out["talk"] = _talk(talk, grams + talk)
    made = _counts([f" {s.replace('a', 'abcd').replace('A', 'ABCD')} " for s in SHAPES], SHAPE_N, SHAPE_SIZE, True)
    out["slot"] = _ratio(made, shape * min(1.0, PROSE_GRAMS / max(shape.sum(), 1)), 0.5)
    made = _counts([f"/{s.replace('a', 'abcd').replace('A', 'ABCD')}/" for s in [*SHAPES, *URL_SHAPES]], SHAPE_N, SHAPE_SIZE, True)
    out["url"] = _ratio(made, url[0] * min(1.0, URL_SHAPES_MOST / max(url[1], 1)) * URL_BASE, 0.5)
    return out


def _talk(own: np.ndarray, base: np.ndarray) -> np.ndarray:
    p = (base + 0.02) / (base.sum() + 0.02 * len(base))
    q = (own + 0.25 * own.sum() * p) / (1.25 * own.sum())
    return np.clip(np.log(q / p), -CAP, CAP).astype(np.float32)


def _repeats(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """N-grams of letters and blanks that stand twice before, each time the same at most REPEAT_SPAN positions further back."""
    out = np.zeros(len(h), dtype=bool)
    for p in range(3, REPEAT_SPAN + 1):
        again = h[p:] == h[:-p]
        out[2 * p :] |= again[p:] & again[:-p]
    at = np.flatnonzero(out)
    c = codes[at[:, None] + np.arange(N)]
    word = (c > 64) & ((c < 91) | (c > 96)) & ((c < 123) | (c > 0xBF))
    out[at] = (word | (c == 32)).all(axis=1) & (word.sum(axis=1) >= 2)
    return out


def _filler_scores(model: dict[str, np.ndarray], h: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Scores of the filler model, joined with those of a model of the text's own last words:
    it gives an n-gram that just stood there as high a probability as the cap allows."""
    s = model["filler"][h].copy()
    s[_repeats(h, codes)] = CAP
    return s


def _window_mean(s: np.ndarray, w: int) -> np.ndarray:
    c = np.r_[0.0, np.cumsum(s, dtype=np.float64)]
    return (c[w:] - c[:-w]) / w


def _covered(s: np.ndarray, w: int, bound: float) -> np.ndarray:
    """Positions inside a window of w n-grams whose mean score passes the bound."""
    n = len(s)
    if n < w:
        return np.full(n, n > 0 and s.mean() >= bound)
    hit = np.flatnonzero(_window_mean(s, w) >= bound)
    mark = np.zeros(n + 1, dtype=np.int32)
    np.add.at(mark, hit, 1)
    np.add.at(mark, hit + w, -1)
    return np.cumsum(mark[:-1]) > 0


def url_slot(url: str | None, model: dict[str, np.ndarray]) -> bool:
    """A window of the url's shape likelier in a slot than in a url proposes one; its syntax is then checked."""
    for u in dict.fromkeys((unquote(url), url)) if url else ():
        sh = _hash(_shape(_codes(u)), SHAPE_N, SHAPE_SIZE.bit_length() - 1)
        if len(sh) and float(model["url"][sh].max()) >= 1.0:
            for m in URL_SLOT.finditer(u):
                if model["url"][sh[max(0, m.start() - 1) : m.end()]].max(initial=0) > 0:
                    return True
    return False


def url_residue(url: str | None, model: dict[str, np.ndarray]) -> bool:
    """A slot in the url, or an instruction or filler among its words, separators as blanks."""
    if not url:
        return False
    if url_slot(url, model):
        return True
    codes = _plain(" ".join(URL_WORD.findall(unquote(url))))
    h = _hash(codes, N, SIZE.bit_length() - 1)
    if len(h) < URL_GRAMS:
        return False
    return any(_covered(model[k][h], min(len(h), w), URL_BOUND).any() for k, w in (("filler", URL_GRAMS), ("instruction", WINDOW["instruction"])))


def _span(mark: np.ndarray) -> tuple[int, int]:
    at = np.flatnonzero(mark)
    return int(at[0]), int(at[-1]) + 1


KINDS = {"filler": 1, "notice": 2, "instruction": 4, "slot": 8}


def judge(text: str | None, model: dict[str, np.ndarray], maybe: int = 15) -> tuple[str | None, float]:
    """(kind, share of the text that residue covers); kind is slot, instruction, filler, notice or null.

    maybe: the kinds that propose() leaves."""
    if not text or not text.strip():
        return None, 0.0
    raw = _codes(text)
    codes = _plain(text)
    if len(codes) != len(raw):  # lower case of another length
        codes = _plain("".join(c.lower() if len(c.lower()) == 1 else c for c in text))
    if len(codes) < N:
        codes = np.r_[codes, np.full(N, 32, dtype=np.uint32)]
    h = _hash(codes, N, SIZE.bit_length() - 1)
    visible = max(1, int((codes != 32).sum()))
    talk = model["talk"][h]

    def talked(a: int, b: int) -> bool:
        """Whether the rest of the sentence talks about such things."""
        before = max(text.rfind(c, 0, a) for c in SENTENCE_ENDS)
        after = min((i for i in (text.find(c, b) for c in SENTENCE_ENDS) if i >= 0), default=len(text))
        lo, hi = max(0, a - TALK_SPAN, before + 1), min(b + TALK_SPAN, after)
        out = np.r_[talk[lo : max(lo, a - N + 1)], talk[min(b, len(talk)) : hi]]
        return len(out) >= 8 and float(out.mean()) > 0.4

    sh = _hash(_shape(raw), SHAPE_N, SHAPE_SIZE.bit_length() - 1) if maybe & KINDS["slot"] else ()
    if len(sh) and float(model["slot"][sh].max()) >= 1.0:
        for m in SLOT.finditer(text):
            a, b = m.span()
            if a and b < len(text) and text[a - 1] in QUOTES and text[b] in QUOTES:
                continue
            if model["slot"][sh[max(0, a - 1) : b]].max() > 0 and not talked(a, b):
                return "slot", (b - a) / visible
    own = codes[: len(h)] != 32
    for kind, need in (("filler", FILLER_CHARS), ("instruction", 1), ("notice", None)):
        if not maybe & KINDS[kind]:
            continue
        got = _covered(_filler_scores(model, h, codes) if kind == "filler" else model[kind][h], WINDOW[kind], BOUND[kind])
        n = int((got & own).sum())
        if not n:
            continue
        if kind == "notice":
            # sentences and lines that mostly are notice; a few usual words inside another line are not
            of = np.cumsum(np.isin(raw[: len(h)], _ENDS))[: len(h)] if len(raw) >= len(h) else np.zeros(len(h), dtype=np.int64)
            size, hit = np.bincount(of, weights=own), np.bincount(of, weights=got & own)
            at = np.flatnonzero((hit >= SENTENCE_SHARE * size) & (hit > 0))
            n = int(sum(size[i] for i in at if not talked(*_span(got & (of == i)))))
            if n >= NOTICE_SHARE * visible:
                return kind, n / visible
            continue
        at = np.flatnonzero(got)
        if n >= need and (n >= SURE_CHARS or not talked(int(at[0]), int(at[-1]) + 1)):
            return kind, n / visible
    return None, 0.0


def propose(texts: list[str | None], model: dict[str, np.ndarray]) -> np.ndarray:
    """The kinds of residue (a sum of KINDS) that a text may have by its windows; of none it has any.

    The texts are scored as one array. Windows across two texts only propose more. A notice must cover half
    of sentences that are NOTICE_SHARE of the text, filler FILLER_CHARS characters."""
    out = np.array([15 * (bool(t) and len(t) < 4 * N) for t in texts], dtype=np.uint8)
    own = [t or "" for t in texts]
    joined = "\n".join(own) + "\n" * 2 * N
    raw = _codes(joined)
    codes = _plain(joined)
    if len(codes) != len(raw):
        codes = _plain("".join(c.lower() if len(c.lower()) == 1 else c for c in joined))
    end = np.cumsum([len(t) + 1 for t in own])
    begin = np.r_[0, end[:-1]]
    h = _hash(codes, N, SIZE.bit_length() - 1)
    black = np.r_[0, np.cumsum(codes != 32)]
    visible = black[end] - black[begin]
    least = {"filler": FILLER_CHARS, "notice": np.maximum(1, NOTICE_SHARE * SENTENCE_SHARE * visible - 1e-6), "instruction": 1}
    for kind, w in WINDOW.items():
        hit = np.flatnonzero(_window_mean(_filler_scores(model, h, codes) if kind == "filler" else model[kind][h], w) >= BOUND[kind] - 1e-6)
        mark = np.zeros(len(h) + 1, dtype=np.int8)
        mark[hit] += 1
        mark[hit + w] -= 1
        got = np.r_[0, np.cumsum((np.cumsum(mark[:-1], dtype=np.int32) > 0) & (codes[: len(h)] != 32))]
        out[got[end] - got[begin] >= least[kind]] |= KINDS[kind]
    sh = _hash(_shape(raw), SHAPE_N, SHAPE_SIZE.bit_length() - 1)
    hit = np.flatnonzero(model["slot"][sh] >= 1.0)
    out[np.searchsorted(end, hit[hit < end[-1]], side="right")] |= KINDS["slot"]
    return out


def propose_urls(urls: list[str | None], model: dict[str, np.ndarray]) -> np.ndarray:
    """Which urls may have residue: an n-gram of a slot's shape and the syntax of one, or a window of filler or an instruction."""
    own = [(u or "") for u in urls]
    out = np.zeros(len(own), dtype=bool)
    plain = [unquote(u) for u in own]
    for us in (plain, own):
        end = np.cumsum([len(u) + 1 for u in us])
        sh = _hash(_shape(_codes("\n".join(us) + "\n" * SHAPE_N)), SHAPE_N, SHAPE_SIZE.bit_length() - 1)
        hit = np.flatnonzero(model["url"][sh] >= 1.0)
        for i in np.unique(np.searchsorted(end, hit[hit < end[-1]], side="right")):
            out[i] |= URL_SLOT.search(us[i]) is not None
    each = [_plain(" ".join(URL_WORD.findall(u)) + "\n") for u in plain]
    end = np.cumsum([len(c) for c in each])
    codes = np.r_[np.concatenate(each), np.full(N, 32, dtype=np.uint32)]
    h = _hash(codes, N, SIZE.bit_length() - 1)
    # a window of at most 16 instruction n-grams has URL_GRAMS in a row that miss the cap by no more than 13 do together
    for s, least in ((_filler_scores(model, h, codes), URL_BOUND), (model["instruction"][h], CAP - (2 * URL_GRAMS - 1) * (CAP - URL_BOUND) / URL_GRAMS)):
        hit = np.flatnonzero(_window_mean(s, URL_GRAMS) >= least - 1e-6)
        out[np.searchsorted(end, hit[hit < end[-1]], side="right")] = True
    return out


def prose_sample(df: DataFrame, key: str, text: str, rows: int = PROSE_ROWS, chars: int = PROSE_CHARS) -> tuple[list[str], list[str]]:
    """Distinct texts with the smallest hashes, and a url of each: a bounded sample that depends neither on the order nor on copies.

    At most rows texts of at most chars characters each (longer ones take no part in the fit alone).
    The range of hashes is cut to twice the wanted texts first, so that all tasks together, however
    many, send about that many."""
    s = df.select(F.col(key).alias("k"), F.col(text).alias("t"), F.xxhash64(text).alias("h")).where(F.col("t").rlike(r"\S") & (F.length("t") <= chars))
    n = s.agg(F.approx_count_distinct("h", 0.02)).first()[0]
    if n > 2 * rows:
        s = s.where(F.col("h") <= -(2**63) + int(2**64 * (2 * rows / n)))
    got = s.groupBy("h", "t").agg(F.min("k").alias("k")).orderBy("h", "t").limit(rows).collect()
    return [r["t"] for r in got], [r["k"] for r in got]


def _judge(sent):
    def run(batches):
        model = sent.value
        for b in batches:
            keys, kinds, shares = [], [], []
            for at in range(0, b.num_rows, 512):
                urls, texts = (c.to_pylist() for c in b.slice(at, 512).columns)
                for k, text, odd, maybe in zip(urls, texts, propose_urls(urls, model), propose(texts, model)):
                    kind, share = ("url", 0.0) if odd and url_residue(k, model) else judge(text, model, maybe) if maybe else (None, 0.0)
                    if kind:
                        keys.append(k)
                        kinds.append(kind)
                        shares.append(share)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(kinds, pa.string()), pa.array(shares, pa.float64())], names=["key", "kind", "share"])

    return run


def residue(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, share): the rows with residue, one per key."""
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).where("key IS NOT NULL")
    sent = df.sparkSession.sparkContext.broadcast(fit_all(rows, "key", "text"))
    found = rows.mapInArrow(_judge(sent), "key STRING, kind STRING, share DOUBLE")
    return found.groupBy("key").agg(F.max(F.struct("share", "kind")).alias("r")).select(F.col("key").alias(key), "r.kind", "r.share")


def content(df: DataFrame, key: str, text: str) -> DataFrame:
    """The rows without residue."""
    return df.join(residue(df, key, text).select(F.col(key).alias("_residue_key")), F.col(key) == F.col("_residue_key"), "left_anti")
