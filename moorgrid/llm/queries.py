"""Queries of the text problems and, where SQL can express them, their SQL."""

from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from moorgrid.llm import bpe, canonical, language, leakage, near_dup, residue, site_lines, term_counts
from moorgrid.sources.tables import read


def p2_found(spark, d):
    return residue.residue(read(spark, d, "search_documents"), "url", "text").select("url")


def p2_residue(spark, d):
    """Pages with residue, its kind and the share of the text that it covers."""
    return residue.residue(read(spark, d, "search_documents"), "url", "text").select("url", "kind", F.round("share", 4).alias("share"))


def _terms(spark, d):
    return term_counts.term_table(read(spark, d, "search_queries"), "id", "query")


def p3_found(spark, d):
    return _terms(spark, d).where("mark IS NOT NULL").select("term", "mark")


def p3_terms(spark, d):
    return _terms(spark, d).select("term", "n_records", "n_occurrences", "mark")


def _site(spark, d):
    return read(spark, d, "search_documents"), "url", "address", "text"


def p4_found(spark, d):
    kept, _ = site_lines.repeated(*_site(spark, d), key_docs=5)
    return site_lines.frequent_lines(kept).select(F.col("source").alias("address"), "line")


def p4_clusters(spark, d):
    """Clusters of near-equal lines that recur too often, with their first line."""
    kept, _ = site_lines.repeated(*_site(spark, d))
    return kept.groupBy(F.col("source").alias("address"), "cluster").agg(F.min("line").alias("line"), F.count(F.lit(1)).alias("n_lines"), F.max("cluster_docs").alias("n_docs"), F.max("n_source").alias("n_source"))


def p4_cleaned(spark, d):
    return site_lines.cleaned(*_site(spark, d))


def _languages(spark, d, per_segment=False):
    return language.detect(read(spark, d, "search_documents"), read(spark, d, "page_labels"), "url", "text", "lang", per_segment)


def p6_found(spark, d):
    return language.unclaimed(_languages(spark, d), read(spark, d, "page_labels"), "url", "lang")


def p6_pages(spark, d):
    """The main language of every page with a confidence."""
    return language.main_language(_languages(spark, d), "url").select("url", "lang", F.round("confidence", 4).alias("confidence"))


def p6_segments(spark, d):
    """The language of every segment of every page with a confidence."""
    return _languages(spark, d, True).select("url", "segment", "lang", "n_words", F.round("confidence", 4).alias("confidence"))


def p7_found(spark, d):
    found = near_dup.pairs(read(spark, d, "search_documents"), "url", "text", t=0.5, k=3, min_words=40)
    return found.select(F.col("a").alias("url_a"), F.col("b").alias("url_b"))


def p7_classes(spark, d):
    return near_dup.classes(read(spark, d, "search_documents"), "url", "text", t=0.5, k=3, min_words=40)


def p8_ids(spark, d):
    return bpe.token_ids(read(spark, d, "documents"), "doc_id", "text")


def p9_found(spark, d):
    found = leakage.leaks(read(spark, d, "documents"), "doc_id", "text", read(spark, d, "eval_items"), "item_id", "text")
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def p9_items(spark, d):
    """Documents that each leaked item occurs in."""
    return p9_found(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc_id"))


def p10_found(spark, d):
    found = canonical.alike_pairs(read(spark, d, "documents"), "doc_id", "text")
    return found.select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p10_classes(spark, d):
    """One row per document with a visible character: its class of equal canonical forms and the number of documents in it."""
    return canonical.classes(read(spark, d, "documents"), "doc_id", "text")


def p10_canonical(spark, d):
    return canonical.canonical(read(spark, d, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p2_found, p2_residue, p3_found, p3_terms, p4_found, p4_clusters, p4_cleaned, p6_found, p6_pages, p6_segments, p7_found, p7_classes, p8_ids, p9_found, p9_items, p10_found, p10_classes, p10_canonical)}

_TERMS = """r AS (SELECT id, min(query) AS q FROM search_queries WHERE query IS NOT NULL AND id IS NOT NULL GROUP BY id),
t AS (SELECT id, unnest(regexp_extract_all(lower(q), '[\\p{L}\\p{N}]+')) AS term FROM r),
c AS (SELECT term, count(DISTINCT id) AS n_records, count(*) AS n_occurrences FROM t GROUP BY term),
m AS (SELECT *, CASE WHEN n_records <= 2 THEN 'rare' WHEN n_records >= 0.01 * (SELECT count(*) FROM r) THEN 'common' END AS mark FROM c)"""

_LEAKS = """dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
ds AS (SELECT doc_id, array_to_string(w[i:i+11], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM dw WHERE len(w) >= 12)),
its AS (SELECT item_id, array_to_string(w[i:i+11], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM iw WHERE len(w) >= 12)),
l AS (SELECT DISTINCT doc_id, item_id FROM ds JOIN its USING (s))"""

_LIKE = """w AS (SELECT url, regexp_extract_all(lower(any_value(text)), '[\\p{L}\\p{N}]+') AS w FROM search_documents WHERE url IS NOT NULL AND text IS NOT NULL GROUP BY url),
g AS (SELECT DISTINCT url, array_to_string(w[i:i+2], ' ') AS g FROM (SELECT url, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 40)),
n AS (SELECT url, count(*) AS n FROM g GROUP BY url),
o AS (SELECT a.url AS url_a, b.url AS url_b, count(*) AS o FROM g a JOIN g b ON a.g = b.g AND a.url < b.url GROUP BY 1, 2)"""

_LINES = """l AS (SELECT DISTINCT address, url, trim(regexp_replace(lower(unnest(regexp_split_to_array(text, '\\r\\n|\\n|\\r'))), '\\s+', ' ', 'g')) AS line FROM search_documents WHERE url IS NOT NULL),
u AS (SELECT address, count(DISTINCT url) AS n FROM search_documents GROUP BY address),
f AS (SELECT l.address, line, count(DISTINCT url) AS n_docs, any_value(n) AS n FROM l JOIN u ON l.address IS NOT DISTINCT FROM u.address WHERE line <> '' GROUP BY 1, 2)"""



def _values(table: dict[int, str]) -> str:
    return ", ".join("({}, '{}')".format(o, r.replace("'", "''")) for o, r in sorted(table.items()))


def _forms_sql() -> str:
    """The canonical form character by character, by rules of the character database rather than by patterns."""
    plain, kept = {}, {9, 10, 11, 12, 13, 0x85}
    for o in [*range(0x3000), *range(0x3000, 0x3400), *range(0xF900, 0x10000), *range(0xE0000, 0xE0080)]:
        c, kind = chr(o), unicodedata.decomposition(chr(o)).split(" ")[0].strip("<>")
        if (unicodedata.category(c) in ("Cc", "Cf") and o not in kept) or o in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0) or 0xFE00 <= o <= 0xFE0F:
            plain[o] = ""
        elif o in (13, 0x85) or unicodedata.category(c) in ("Zl", "Zp"):
            plain[o] = "\n"
        elif (unicodedata.category(c) == "Zs" and o != 32) or o in (9, 11, 12, 0x2800):
            plain[o] = " "
        elif kind in ("wide", "narrow", "isolated", "initial", "medial", "final") or o in canonical.JOINED:
            plain[o] = unicodedata.normalize("NFKC", c)
    alike = {ord(a): b for a, b in canonical.shape_map().items()}
    step = lambda n, src, table: f"""c{n} AS (SELECT doc_id, generate_subscripts(cs, 1) AS i, unnest(cs) AS c FROM (SELECT doc_id, regexp_extract_all(x, '(?s).') AS cs FROM {src})),
x{n} AS (SELECT doc_id, nfc_normalize(string_agg(coalesce(r, c), '' ORDER BY i)) AS x FROM c{n} LEFT JOIN {table} ON o = unicode(c) GROUP BY doc_id)"""  # noqa: E731
    return f"""pa(o, r) AS (VALUES {_values(plain)}), pb(o, r) AS (VALUES {_values(alike)}),
x0 AS (SELECT doc_id, replace(text, chr(13) || chr(10), chr(10)) AS x FROM documents WHERE text <> ''),
{step(1, "x0", "pa")}, {step(2, "x1", "pb")},
cf AS (SELECT d.doc_id, d.text, CASE WHEN d.text = '' THEN '' ELSE x END AS canonical FROM documents d LEFT JOIN x2 USING (doc_id))"""


_FORMS = _forms_sql()
_PAIRS = f"{_LIKE}, pp AS (SELECT url_a AS a, url_b AS b FROM o JOIN n x ON x.url = url_a JOIN n y ON y.url = url_b WHERE o >= 0.5 * (x.n + y.n - o)), ee AS (SELECT a, b FROM pp UNION ALL SELECT b, a FROM pp)"

ORACLES = {
    "p7_classes": f"""WITH RECURSIVE {_PAIRS}, rc(url, r) AS (SELECT DISTINCT url, url FROM search_documents WHERE url IS NOT NULL UNION SELECT rc.url, ee.b FROM rc JOIN ee ON rc.r = ee.a)
SELECT url, min(r) AS class_id, coalesce(any_value(m), 0) AS n_links FROM rc LEFT JOIN (SELECT a, count(*) AS m FROM ee GROUP BY a) ON a = url GROUP BY url""",
    "p10_canonical": f"WITH {_FORMS} SELECT doc_id, canonical FROM cf",
    "p10_classes": f"WITH {_FORMS} SELECT doc_id, min(doc_id) OVER (PARTITION BY canonical) AS class_id, count(*) OVER (PARTITION BY canonical) AS n_members FROM (SELECT DISTINCT doc_id, canonical FROM cf WHERE regexp_matches(canonical, '[^ \\n]'))",
    "p10_found": f"WITH {_FORMS} SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM cf a JOIN cf b ON a.canonical = b.canonical AND a.doc_id < b.doc_id AND a.text <> b.text WHERE regexp_matches(a.canonical, '[^ \\n]')",
    "p4_found": f"WITH {_LINES} SELECT address, line FROM f WHERE n_docs >= 5 AND n_docs >= 0.1 * n",
    "p7_found": f"WITH {_LIKE} SELECT url_a, url_b FROM o JOIN n x ON x.url = url_a JOIN n y ON y.url = url_b WHERE o >= 0.5 * (x.n + y.n - o)",
    "p3_found": f"WITH {_TERMS} SELECT term, mark FROM m WHERE mark IS NOT NULL",
    "p3_terms": f"WITH {_TERMS} SELECT term, n_records, n_occurrences, mark FROM m",
    "p9_found": f"WITH {_LEAKS} SELECT doc_id, item_id FROM l",
    "p9_items": f"WITH {_LEAKS} SELECT item_id, count(*) AS n_docs, min(doc_id) AS first_doc_id FROM l GROUP BY item_id",
}
