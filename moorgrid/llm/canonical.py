"""One consistent form of texts that look alike, by SQL of an embedded DuckDB.

Each Arrow partition is rewritten by one SQL expression: invisible characters are deleted, blanks
become the plain space and line breaks the line feed, width and joined forms become their plain
letters, look-alike letters of Greek, Cyrillic, Armenian, Cherokee and the small capitals become the
Latin ones (Greek letters without a Latin twin the Cyrillic ones), accents are composed.

Defined cases: null stays null; empty stays empty; visible letters, digits and accents without a
plain counterpart stay as they are (superscripts, circled digits and letters of a different shape
are not touched); texts without a visible character are never a pair.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Characters without a shape, and blanks.
INVISIBLE = r"[\x00-\x08\x0E-\x1F\x7F-\x84\x86-\x9F\u00AD\u034F\u061C\u115F\u1160\u17B4\u17B5\u180B-\u180F\u200B-\u200F\u202A-\u202E\u2060-\u206F\u3164\uFE00-\uFE0F\uFEFF\uFFA0\uFFF9-\uFFFB\U000E0000-\U000E007F]"
BLANK = r"[\t\x0B\x0C\u00A0\u1680\u2000-\u200A\u202F\u205F\u2800\u3000]"
BREAK = r"\r\n|[\r\x85\u2028\u2029]"
# Letters of Cyrillic and Greek and, below each, the Latin letter of the same shape.
CYRILLIC = "АВЕЅІЈКМНОРСТУХҮԌԚԜӀаеѕіјорсухһԁԛԝӏүѵ"
CYR_LATIN = "ABESIJKMHOPCTYXYGQWIaesijopcyxhdqwlyv"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϜϹϳορϲν"
GRE_LATIN = "ABEZHIKMNOPTYXFCjopcv"
# Greek letters of a Cyrillic shape that Latin has not, and single letters of other scripts
# (Armenian, Cherokee, Latin small capitals that look like the small letter) below which is the Latin one.
GREEK_ONLY = "ΓΠΦ"
GRE_CYRILLIC = "ГПФ"
OTHERS = "ɑɡՕօոսհցԼᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏙᏚᏞᏟᏢᏦᏴᴄᴏᴠᴡᴢꜱ"
OTH_LATIN = "agOonuhgLDRTAJEWMHGZVSLCPKBcovwzs"
WIDTH_TAGS = {"<wide>", "<narrow>", "<isolated>", "<initial>", "<medial>", "<final>"}
JOINED = [*range(0xFB00, 0xFB07), *range(0xFB13, 0xFB18), 0x132, 0x133, *range(0x1C4, 0x1CD), *range(0x1F1, 0x1F4)]


def width_map() -> dict[str, str]:
    """Plain forms of width variants and joined letters, from the character database."""
    out = {}
    for o in range(0x80, 0x10000):
        d = unicodedata.decomposition(chr(o))
        if d and (d.split()[0] in WIDTH_TAGS or o in JOINED):
            out[chr(o)] = "".join(map(expand, d.split()[1:]))
    return out


def expand(code: str) -> str:
    c = chr(int(code, 16))
    d = unicodedata.decomposition(c)
    return "".join(map(expand, d.split()[1:])) if d.startswith("<") and (d.split()[0] in WIDTH_TAGS or ord(c) in JOINED) else c


def shape_map() -> dict[str, str]:
    """Latin or else Cyrillic letters of the same shape, with the accents that a composed letter carries."""
    base = dict(zip(CYRILLIC + GREEK + GREEK_ONLY + OTHERS, CYR_LATIN + GRE_LATIN + GRE_CYRILLIC + OTH_LATIN))
    out = dict(base)
    for o in [*range(0x370, 0x530), *range(0x1F00, 0x2000)]:
        d = unicodedata.normalize("NFD", chr(o))
        if len(d) > 1 and d[0] in base:
            out[chr(o)] = unicodedata.normalize("NFC", base[d[0]] + d[1:])
    return out


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _pattern(p: str) -> str:
    """The pattern with its escapes written as the characters' code points in RE2's way."""
    p = re.sub(r"\\U([0-9A-F]{8})", lambda m: "\\x{%s}" % m[1].lstrip("0"), p)
    return re.sub(r"\\u([0-9A-F]{4})", r"\\x{\1}", p)


JOIN = "{joined}"


def joined_map() -> dict[str, str]:
    """Characters that become several."""
    return {a: b for a, b in {**width_map(), **shape_map()}.items() if len(b) > 1}


def join_sql(present: list[str], many: dict[str, str]) -> str:
    """The replacements of the characters that a table holds; all of them would cost far more to plan than to run."""
    x = "x"
    for a in present:
        x = f"replace({x}, {_quote(a)}, {_quote(many[a])})"
    return x


def statements() -> list[str]:
    """SQL steps over the tables t0 (k, x), t1, ...; kept apart so that no expression is written twice.

    JOIN stands for join_sql of the characters in the step's table."""
    width, shape = width_map(), shape_map()
    one = lambda t: {a: b for a, b in t.items() if len(b) == 1}
    # translate reads its tables anew for each row, so only rows that hold one of their characters go through it
    tr = lambda t: f"CASE WHEN regexp_matches(x, {_quote('[' + ''.join(t) + ']')}) THEN translate(x, {_quote(''.join(t))}, {_quote(''.join(t.values()))}) ELSE x END"
    x = f"regexp_replace(x, {_quote(_pattern(INVISIBLE))}, '', 'g')"
    x = f"regexp_replace({x}, {_quote(_pattern(BREAK))}, chr(10), 'g')"
    x = f"regexp_replace({x}, {_quote(_pattern(BLANK))}, ' ', 'g')"
    return [
        f"SELECT k, CASE WHEN regexp_full_match(x, {_quote('[ -~' + chr(10) + ']*')}) THEN x ELSE {x} END AS x FROM t0",
        f"SELECT k, {tr(one(width))} AS x FROM t1",
        f"SELECT k, nfc_normalize({JOIN}) AS x FROM t2",
        f"SELECT k, {tr(one(shape))} AS x FROM t3",
        f"SELECT k, nfc_normalize({JOIN}) AS x FROM t4",
    ]


def _runner(raw_hash: bool):
    def run(batches):
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "600MB"})
        steps, many = statements(), joined_map()
        rare = _quote("[" + "".join(many) + "]")
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                t0 = pa.table({"k": b.column(0), "x": b.column(1).cast(pa.string())}).slice(at, 2048)
                tables = {"t0": t0}
                for i, sql in enumerate(steps):
                    con.register(f"t{i}", tables[f"t{i}"])
                    if JOIN in sql:
                        present = con.sql(f"SELECT DISTINCT unnest(regexp_extract_all(x, {rare})) FROM t{i} ORDER BY 1").fetchall()
                        sql = sql.replace(JOIN, join_sql([r[0] for r in present], many))
                    tables[f"t{i + 1}"] = con.sql(sql).to_arrow_table()
                    con.unregister(f"t{i}")
                last = tables[f"t{len(steps)}"]
                if raw_hash:
                    con.register("c", pa.table({"k": last["k"], "x": last["x"], "raw": t0["x"]}))
                    last = con.sql("SELECT k, md5(x) AS form, md5(raw) AS stored FROM c WHERE regexp_matches(x, '[^ \\n]')").to_arrow_table()
                    con.unregister("c")
                for out in last.to_batches():
                    yield pa.RecordBatch.from_arrays([c.cast(pa.string()) if j else c for j, c in enumerate(out.columns)], names=out.schema.names)

    return run


def canonical(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, canonical) of every row."""
    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("x")).mapInArrow(_runner(False), f"k {kind}, x STRING").select(F.col("k").alias(key), F.col("x").alias("canonical"))


def forms(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, form, stored): hashes of the canonical and the stored text of rows with a visible character."""
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("x")).where("x IS NOT NULL AND x <> ''")
    return rows.mapInArrow(_runner(True), f"k {kind}, form STRING, stored STRING").select(F.col("k").alias(key), "form", "stored").distinct()


def classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, class_id, n_members): one row per key with a visible character; class_id is the smallest key of its form.

    Keys are unique in the table; the linear form of alike_pairs where a class is large."""
    from moorgrid.session import checkpoint

    f = checkpoint(forms(df, key, text))
    per = f.groupBy("form").agg(F.min(key).alias("class_id"), F.countDistinct(key).alias("n_members"))
    return f.select(key, "form").distinct().join(per, "form").select(key, "class_id", "n_members")


def alike_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(a, b), a < b: keys whose texts are stored differently and have one canonical form.

    Different stored forms of a class are paired first, their members joined afterwards, so rows
    stored alike are never compared with each other.
    """
    from moorgrid.session import checkpoint

    f = checkpoint(forms(df, key, text))
    kinds = f.select("form", "stored").distinct()
    other = kinds.select("form", F.col("stored").alias("stored_b"))
    pairs = kinds.withColumnRenamed("stored", "stored_a").join(other, "form").where("stored_a < stored_b")
    a = f.select(F.col(key).alias("x"), F.col("stored").alias("stored_a"))
    b = f.select(F.col(key).alias("y"), F.col("stored").alias("stored_b"))
    out = pairs.join(a, "stored_a").join(b, "stored_b").where("x <> y")
    return out.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
