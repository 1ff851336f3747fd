"""The suffix stripping algorithm of Porter (1980), vectorised over distinct words."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOWELS = set("aeiou")
#: Suffix tables of the published steps 2, 3 and 4 (fixed values).
STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def _table(text: str) -> list[tuple[str, str]]:
    rows = [tuple(x.split(":")) if ":" in x else (x, "") for x in text.split()]
    return sorted(rows, key=lambda r: -len(r[0]))


_S2, _S3, _S4 = _table(STEP2), _table(STEP3), _table(STEP4)


def _shape(w: str) -> str:
    """v for vowels, c for consonants; y is a vowel after a consonant."""
    out = []
    for i, ch in enumerate(w):
        out.append("v" if ch in VOWELS or (ch == "y" and i and out[-1] == "c") else "c")
    return "".join(out)


def _measure(w: str) -> int:
    return _shape(w).count("vc")


def _cvc(w: str) -> bool:
    return len(w) > 2 and _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c"


def _swap(w: str, table: list[tuple[str, str]], least: int) -> str:
    for suffix, new in table:
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            return base + new if _measure(base) >= least else w
    return w


def stem(w: str) -> str:
    """Stem of a lower-case word; words that are not plain Latin letters stay."""
    if len(w) <= 2 or not (w.isascii() and w.isalpha()):
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for suffix in ("ed", "ing"):
            base = w[: -len(suffix)]
            if w.endswith(suffix) and "v" in _shape(base):
                w = base
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(w, _S2, 1)
    w = _swap(w, _S3, 1)
    for suffix, _ in _S4:
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            if _measure(base) > 1 and (suffix != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e"):
        base = w[:-1]
        if _measure(base) > 1 or (_measure(base) == 1 and not _cvc(base)):
            w = base
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def stem_column(c: Column) -> Column:
    def run(s: pd.Series) -> pd.Series:
        code, words = pd.factorize(s)
        return pd.Series([stem(x) for x in words] + [None], dtype=object).take(code).reset_index(drop=True)

    return F.pandas_udf(run, "string")(c)


def stem_arrays(c: Column) -> Column:
    """Stems of the words of an array column; a batch stems each distinct word once."""

    def run(s: pd.Series) -> pd.Series:
        known: dict[str, str] = {}
        return s.map(lambda a: None if a is None else [known[w] if w in known else known.setdefault(w, stem(w)) for w in a])

    return F.pandas_udf(run, "array<string>")(c)
