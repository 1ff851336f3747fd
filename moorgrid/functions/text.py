"""Scalar text functions of the mesh pages, as column expressions that stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as a class that means the same in every regular-expression engine here.
SPACE = "\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Word pattern of the text index: letters and digits, joined by inner dots.
TOKEN = r"[\p{L}\p{N}]+(?:\.[\p{L}\p{N}]+)*"
#: Formatting marks that are dropped together with the backtick before them (fixed values).
MARKS = "car!_=`"


def strip_markup(c: Column) -> Column:
    """Page text without its markup: styles, colours, tags, comments, heading marks and extra blanks."""
    c = F.regexp_replace(c, "`[fb]", "")
    c = F.regexp_replace(c, "`[FB][^\\n]{3}", "")
    for mark in MARKS:
        c = F.replace(c, F.lit("`" + mark), F.lit(""))
    c = F.regexp_replace(c, "`<[^>]*>", " ")
    c = F.regexp_replace(c, "#[^\\n]*", "")
    c = F.regexp_replace(c, f"(?md)^[{SPACE}]*>+", "")
    c = F.replace(c, F.lit("\\"), F.lit(" "))
    c = F.regexp_replace(c, "[ \\t]+", " ")
    c = F.regexp_replace(c, f"\\n[{SPACE}]*\\n+", "\n\n")
    return F.replace(c, F.lit("`"), F.lit(""))


def link_block(block: Column) -> Column:
    """The target of one link block, by its number of backticks; empty from three on."""
    part = F.split(block, "`")
    with_fields = F.when(part[2].startswith("*"), part[1]).otherwise(F.concat(part[1], F.lit("`"), part[2]))
    n = F.size(part)
    return F.when(n == 1, block).when(n == 2, part[1]).when(n == 3, with_fields).otherwise(F.lit(""))


def extract_links(page: Column) -> Column:
    """Targets of all link blocks of a page that hold a colon, in order, with repeats."""
    blocks = F.regexp_extract_all(page, F.lit("`\\[([^\\n]*?)\\]"), F.lit(1))
    return F.filter(F.transform(blocks, link_block), lambda x: x.contains(":"))


def is_external(link: Column) -> Column:
    return ~link.startswith(":")


def resolve_links(address: Column, page: Column) -> tuple[Column, Column]:
    """(internal, external) distinct links; internal ones get the page's address in front."""
    links = extract_links(page)
    inside = F.array_distinct(F.transform(F.filter(links, lambda x: x.startswith(":")), lambda x: F.concat(address, x)))
    return inside, F.array_distinct(F.filter(links, is_external))


def address_from_url(url: Column) -> Column:
    return F.substring_index(url, ":", 1)


def path_from_url(url: Column) -> Column:
    """The second part of a url; empty where there is none."""
    return F.split_part(url, F.lit(":"), F.lit(2))


def parse_url(url: Column) -> Column:
    """struct(address binary, path); null unless the url has exactly two parts and a hexadecimal address."""
    p = F.split(url, ":")
    ok = (F.size(p) == 2) & p[0].rlike("^([0-9A-Fa-f]{2})+$")
    return F.when(ok, F.struct(F.unhex(p[0]).alias("address"), p[1].alias("path")))


def replace_line_breaks(c: Column) -> Column:
    return F.regexp_replace(c, f"[{SPACE}]+", " ")


def format_text(c: Column) -> Column:
    """One line without doubled backticks."""
    return F.replace(replace_line_breaks(c), F.lit("``"), F.lit(""))


def replace_malformed(c: Column) -> Column:
    """Without control characters and replacement characters."""
    return F.regexp_replace(c, "[\\x00-\\x1f\\x7f-\\x9f\\x{FFFD}]+", "")


def plain_hex(c: Column) -> Column:
    return F.translate(c, "<>", "")


def clean_query(c: Column) -> Column:
    """Query without surrounding white space; empty for null."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), f"^[{SPACE}]+|[{SPACE}]+$", "")


def contains_pattern(user_text: str) -> str:
    """Pattern of a contains search; % and _ of the user act as wildcards, a backslash is itself."""
    return "%" + user_text.replace("\\", "\\\\") + "%"


def announce_name(data: Column) -> Column:
    """Display name in an announce: the inner bytes of the packed form, else the whole as text."""
    h = F.hex(data)
    packed = h.startswith("92C40E") & h.endswith("C0")
    inner = F.unhex(h.substr(F.lit(7), F.length(h) - 8))
    return F.decode(F.when(packed, inner).otherwise(data), "UTF-8")


def tokens(c: Column) -> Column:
    """Index tokens of a text in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def word_ngrams(words: Column, low: int = 4, high: int = 15) -> Column:
    """All n-grams of low to high characters inside each word; words shorter than low have none."""
    def of(w: Column) -> Column:
        grams = F.transform(
            F.sequence(F.lit(low), F.least(F.lit(high), F.length(w))),
            lambda n: F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substring(w, i, n)),
        )
        return F.when(F.length(w) >= low, F.flatten(grams)).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(words, of))
