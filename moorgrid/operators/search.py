"""Full-text search: analysers, postings, keyed index writes, ranked retrieval and highlighting.

The index is two tables, documents (unique by url) and postings (field, term, url, tf, length), and the totals.
The score is BM25 per field with K1 and B, idf ln(1 + (N - df + 0.5) / (df + 0.5)), the field's
boost and the mean length over all documents, summed over fields and terms. Order: score, then url.

Defined cases: rows with null url are no documents; null fields have no terms; an empty query finds
nothing; rows of one url are one document (the row with the smallest hash counts).
"""

from __future__ import annotations

import re
import time as _time
from collections import OrderedDict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moorgrid.functions import text as X
from moorgrid.functions.stem import stem, stem_arrays
from moorgrid.session import checkpoint
from moorgrid.sources.versioned import VersionedTable

K1, B = 1.2, 0.75
BOOST = {"url": 1.0, "text": 1.0, "nodeName": 2.0, "owner": 1.0, "address": 1.0}
FIELDS = ["url", "text", "owner", "address", "nodeName"]
STOP_WORDS = "a an and are as at be by can for from have if in is it may not of on or tbd that the this to us we when will with yet you your".split()
SNIPPET, FRAGMENT = 200, 100
BOLD = ("`!`_", "`_`!")


def _row_hash() -> Column:
    return F.xxhash64("text", "owner", "address", "nodeName")


def documents(rows: DataFrame) -> DataFrame:
    """Stored fields of each url, with the raw copy of its text."""
    d = F.min_by(F.struct("text", "owner", "address", "nodeName"), _row_hash())
    one = rows.where("url IS NOT NULL").groupBy("url").agg(d.alias("d")).select("url", "d.*")
    return one.withColumn("raw", F.col("text"))


def upsert_documents(docs: DataFrame, batch: DataFrame) -> DataFrame:
    """The index after a batch: its urls replace the stored ones."""
    new = documents(batch)
    return docs.join(new.select("url"), "url", "left_anti").unionByName(new.select(*docs.columns))


def delete_by_address(docs: DataFrame, addresses: str | list[str] | DataFrame) -> DataFrame:
    """The index without the documents of these addresses; unchanged for none."""
    if isinstance(addresses, DataFrame):
        return docs.join(addresses.select(F.col(addresses.columns[0]).alias("address")).distinct(), "address", "left_anti").select(*docs.columns)
    names = [addresses] if isinstance(addresses, str) else list(addresses)
    names = [a for a in names if a]
    return docs.where(~F.coalesce(F.col("address").isin(names), F.lit(False))) if names else docs


def _terms_of(stemmed: bool) -> dict[str, Column]:
    """Every field's terms as one array column; empty for null."""
    body = F.filter(X.tokens(F.col("text")), lambda w: F.length(w) >= 2)
    if stemmed:
        body = stem_arrays(F.filter(body, lambda w: ~w.isin(STOP_WORDS)))
    spaced = lambda c: F.filter(F.split(F.col(c), " "), lambda w: w != "")
    each = {"url": F.array("url"), "text": body, "nodeName": X.word_ngrams(X.tokens(F.col("nodeName"))), "owner": spaced("owner"), "address": spaced("address")}
    return {f: F.coalesce(t, F.array().cast("array<string>")) for f, t in each.items()}


def analysed(docs: DataFrame, stemmed: bool = False) -> DataFrame:
    """(url, field, term): every occurrence of a term in a field."""
    by_field = F.explode(F.map_from_entries(F.array(*[F.struct(F.lit(f), t) for f, t in _terms_of(stemmed).items()])))
    return docs.select("url", by_field.alias("field", "terms")).select("url", "field", F.explode("terms").alias("term"))


def postings(docs: DataFrame, stemmed: bool = False) -> DataFrame:
    """(field, term, url, tf, length); lengths ride along, so there is one shuffle."""
    by_field = F.explode(F.map_from_entries(F.array(*[F.struct(F.lit(f), t) for f, t in _terms_of(stemmed).items()])))
    rows = docs.select("url", by_field.alias("field", "terms")).select("url", "field", F.size("terms").cast("bigint").alias("length"), F.explode("terms").alias("term"))
    return rows.groupBy("field", "term", "url").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))


def term_statistics(posts: DataFrame) -> DataFrame:
    return posts.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").cast("bigint").alias("tf"))


def lengths_of(stemmed: bool = False) -> Column:
    """Number of terms of each of FIELDS."""
    each = _terms_of(stemmed)
    return F.array(*[F.size(each[f]).cast("bigint") for f in FIELDS])


def totals_of(docs: DataFrame) -> dict:
    """Number of documents and terms per field, from documents with their lengths; one row."""
    r = docs.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(F.col("lengths")[i]), F.lit(0)) for i in range(len(FIELDS))]).first()
    return {"n_docs": int(r[0]), **{f: int(x) for f, x in zip(FIELDS, r[1:])}}


class Index:
    """A stored index. Documents lie in buckets of their url with their generation and lengths; postings are
    appended per generation, by field and sorted by term, so a query reads the row groups of its terms;
    totals are kept by every write. A posting holds while its document has its generation, so upserts and
    deletes touch the buckets of their urls and never rewrite postings; compact() drops what is outdated."""

    DOCS = "url STRING, text STRING, owner STRING, address STRING, nodeName STRING, raw STRING, gen BIGINT, lengths ARRAY<BIGINT>"
    TOTALS = "n_docs BIGINT, " + ", ".join(f"{f} BIGINT" for f in FIELDS) + ", outdated BIGINT"

    def __init__(self, spark: SparkSession, path: str, stemmed: bool = False, buckets: int = 32):
        self.spark, self.path, self.stemmed = spark, path, stemmed
        self.table = VersionedTable(spark, f"{path}/documents", self.DOCS, "url", buckets)
        self.cache = ResultCache()

    def docs(self) -> DataFrame:
        return self.table.read()

    def version(self) -> int:
        return max(self.table.versions(), default=-1)

    def totals(self, before: int | None = None) -> dict:
        v = [x for x in self.table.versions() if before is None or x < before]
        zero = {"n_docs": 0, **dict.fromkeys(FIELDS, 0), "outdated": 0}
        return self.spark.read.schema(self.TOTALS).parquet(f"{self.path}/totals/v={v[-1]}").first().asDict() if v else zero

    def _finish(self, docs: DataFrame, hit: list[int], before: dict, old: dict, outdated: int, number: int) -> None:
        """Totals first, as the documents' success marks the version."""
        new = totals_of(docs)
        row = {k: before[k] - old[k] + new[k] for k in new} | {"outdated": outdated}
        self.spark.createDataFrame([tuple(row[c.split()[0]] for c in self.TOTALS.split(", "))], self.TOTALS).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/totals/v={number}")
        self.table.write(docs, number)
        self.cache.clear()

    def _append(self, docs: DataFrame, number: int) -> None:
        p = postings(docs, self.stemmed).repartitionByRange("field", "term").sortWithinPartitions("field", "term")
        p.write.mode("overwrite").partitionBy("field").parquet(f"{self.path}/postings/gen={number}")

    def upsert(self, batch: DataFrame, number: int | None = None) -> None:
        """A batch of documents; urls in it replace the stored ones."""
        number = self.version() + 1 if number is None else number
        new = checkpoint(documents(batch).withColumns({"gen": F.lit(number).cast("bigint"), "lengths": lengths_of(self.stemmed)}))
        hit = self.table.touched(new)
        old = checkpoint(self.table.read(number, hit))
        before, kept = self.totals(number), old.join(new.select("url"), "url", "left_anti")
        docs = checkpoint(kept.unionByName(new).select(*old.columns))
        replaced = old.count() + new.count() - docs.count()
        self._append(new, number)
        self._finish(docs, hit, before, totals_of(old), before["outdated"] + replaced, number)

    def delete_by_address(self, addresses, number: int | None = None) -> None:
        """Removes the documents of these addresses; their postings are outdated from then on."""
        number = self.version() + 1 if number is None else number
        here = self.table.read(number)
        gone = here.select("url", "address").join(delete_by_address(here, addresses).select("url"), "url", "left_anti")
        hit = self.table.touched(gone)
        if not hit:
            return
        old = checkpoint(self.table.read(number, hit))
        docs = checkpoint(delete_by_address(old, addresses).select(*old.columns))
        before = self.totals(number)
        self._finish_all(docs, hit, before, totals_of(old), before["outdated"] + old.count() - docs.count(), number)

    def _finish_all(self, docs, hit, before, old, outdated, number) -> None:
        """As _finish; buckets that lost their last document are written as empty ones."""
        left = set(self.table.touched(docs))
        self._finish(docs, hit, before, old, outdated, number)
        for b in set(hit) - left:
            self.spark.createDataFrame([], self.DOCS).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/documents/v={number}/b={b}")

    def compact(self) -> None:
        """All documents under one generation and postings of these alone."""
        number = self.version() + 1
        docs = checkpoint(self.docs().withColumn("gen", F.lit(number).cast("bigint")))
        self._append(docs, number)
        before = self.totals()
        self._finish(docs, [], before, {k: before[k] for k in before}, 0, number)
        fs, at = self.table._fs, self.table._jvm.org.apache.hadoop.fs.Path
        for g in self.table._names(at(f"{self.path}/postings"), "gen="):
            if g != number:
                fs.delete(at(f"{self.path}/postings/gen={g}"), True)

    def postings(self, query: str) -> DataFrame:
        """Valid postings of the query's terms; field and term filters reach the scan."""
        rows = self.spark.read.option("basePath", f"{self.path}/postings").parquet(f"{self.path}/postings")
        single: dict[str, list[str]] = {}
        for f, t in _weighted(query, self.stemmed):
            single.setdefault(f, []).append(t)
        want = F.lit(False)
        for f, ts in single.items():
            want = want | ((F.col("field") == f) & F.col("term").isin(ts))
        for f, ts, kind in _multiple(query, self.stemmed):
            want = want | ((F.col("field") == f) & _fits(F.col("term"), kind, ts))
        rows = rows.where(want)
        if self.totals()["outdated"]:
            rows = rows.join(self.docs().select("url", "gen"), ["url", "gen"], "left_semi")
        return rows

    def search(self, query: str) -> DataFrame:
        """As search(), on the stored postings."""
        return _retrieve(bm25(self.postings(query), self.docs(), query, self.stemmed, self.totals()), self.docs(), query, self.stemmed)

    def cached(self, query: str, make, *more):
        """A result kept for a while; every write clears what is kept."""
        return self.cache.get((query, *more, self.version()), make)


def write_index(docs: DataFrame, path: str, stemmed: bool = False) -> Index:
    """Stores an index of documents."""
    index = Index(docs.sparkSession, path, stemmed)
    index.upsert(docs)
    return index


def read_index(spark: SparkSession, path: str, stemmed: bool = False) -> Index:
    return Index(spark, path, stemmed)


_QUERY = re.compile(r'(?P<mark>[()])|(?:(?P<field>\w+):)?(?:"(?P<phrase>[^"]*)"(?:\^(?P<by>\d+(?:\.\d+)?))?|\[(?P<low>[^\s\]]+) TO (?P<high>[^\s\]]+)\]|(?P<word>[^\s()]+))')
_BOOSTED = re.compile(r"(.+)\^(\d+(?:\.\d+)?)$")
MANY = ("prefix", "wild", "range")  # kinds that stand for all terms of the index that fit


def parse(query: str, stemmed: bool = False) -> dict:
    """A query as clauses: any, all and none, each a list of alternatives (field, terms, kind).

    Words match any field; field:word one; "a phrase" its words in order; word* a prefix; * and ? inside a
    word any letters and one letter; [low TO high] all terms between; word^2 weighs more; ( ) makes its
    members alternatives of one clause; AND, OR and NOT (or a leading -) join clauses. Terms pass through
    the analyser of each field. weights: factors of (field, term) other than 1."""
    out: dict = {"any": [], "all": [], "none": [], "weights": {}}
    mode, pending, group = "any", None, None

    def put(alternatives: list) -> None:
        nonlocal pending
        if alternatives:
            if pending == "all" and out["any"] and not out["all"]:
                out["all"].append(out["any"].pop())
            out[pending or ("all" if mode == "all" else "any")].append(alternatives)
        pending = None

    for m in _QUERY.finditer((query or "").strip()):
        g = m.groupdict()
        field, phrase, word = g["field"], g["phrase"], g["word"]
        if g["mark"]:
            if g["mark"] == "(":
                group = []
            elif group is not None:
                put(group)
                group = None
            continue
        if field is not None and field not in BOOST:
            field, phrase, word = None, None, m.group(0)
        if phrase is None and field is None and word in ("AND", "OR", "NOT"):
            if group is not None:
                continue  # members of a group are alternatives
            if word == "AND":
                mode, pending = "all", "all"
            elif word == "NOT":
                pending = "none"
            else:
                mode = "any"
            continue
        by = float(g["by"] or 1)
        if phrase is not None:
            kind, value = "phrase", phrase
        elif word is None:
            kind, value = "range", (g["low"], g["high"])
        else:
            if hit := _BOOSTED.match(word):
                word, by = hit.group(1), float(hit.group(2))
            if field is None and word.startswith("-") and len(word) > 1:
                pending, word = "none", word[1:]
            inner = word.rstrip("*")
            kind = "wild" if inner and ("*" in inner or "?" in inner) else "prefix" if inner and inner != word else "term"
            value = inner if kind == "prefix" else word
        alternatives = []
        for f in [field] if field else FIELDS:
            low = f in ("text", "nodeName")
            if kind == "range":
                terms = [x.lower() if low else x for x in value]
            elif kind == "wild":
                terms = ["^" + re.escape(value.lower() if low else value).replace("\\*", ".*").replace("\\?", ".") + "$"]
            else:
                terms = terms_for(f, value, stemmed, kind)
            if terms:
                alternatives.append((f, terms, kind))
                if by != 1:
                    out["weights"] |= {(f, t): by for t in terms}
        if group is not None:
            group += alternatives
        else:
            put(alternatives)
    if group:
        put(group)
    return out


def _fits(term: Column, kind: str, terms: list[str]) -> Column:
    """Whether a term of the index is one that a prefix, a pattern or a range stands for."""
    if kind == "range":
        return term.between(*terms)
    if kind == "wild":
        return term.rlike(terms[0])
    return F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: term.startswith(t)) if len(terms) > 1 else term.startswith(terms[0])


def terms_for(field: str, value: str, stemmed: bool = False, kind: str = "term") -> list[str]:
    """Terms of a query word under a field's analyser."""
    if field == "url":
        return [value] if value else []
    if field in ("owner", "address"):
        return value.split()
    words = [w.lower() for w in re.findall(r"[^\W_]+(?:\.[^\W_]+)*", value)]
    if field == "nodeName":
        return [w[i : i + n] for w in words for n in range(4, min(15, len(w)) + 1) for i in range(len(w) - n + 1)]
    words = [w for w in words if len(w) >= 2]
    if stemmed:
        words = [stem(w) if kind != "prefix" else w for w in words if w not in STOP_WORDS]
    return words


def _weighted(query: str, stemmed: bool) -> dict[tuple[str, str], float]:
    """Weights of the single terms of all positive clauses."""
    q = parse(query, stemmed)
    rows: dict[tuple[str, str], float] = {}
    for clause in q["any"] + q["all"]:
        for f, terms, kind in clause:
            if kind not in MANY:
                for t in terms:
                    rows[f, t] = rows.get((f, t), 0) + q["weights"].get((f, t), 1)
    return rows


def _multiple(query: str, stemmed: bool) -> list[tuple[str, list[str], str]]:
    q = parse(query, stemmed)
    return [a for clause in q["any"] + q["all"] for a in clause if a[2] in MANY]


def query_terms(spark: SparkSession, query: str, stemmed: bool = False) -> DataFrame:
    """(field, term, n): scored terms of all positive clauses; bounded by the query's length."""
    return spark.createDataFrame([(f, t, float(n)) for (f, t), n in sorted(_weighted(query, stemmed).items())], "field STRING, term STRING, n DOUBLE")


def _expand(posts: DataFrame, query: str, stemmed: bool) -> DataFrame | None:
    """(field, term, n): the terms that prefixes, patterns and ranges stand for."""
    out = None
    for f, terms, kind in _multiple(query, stemmed):
        got = posts.where((F.col("field") == f) & _fits(F.col("term"), kind, terms)).select("field", "term").distinct().withColumn("n", F.lit(1.0))
        out = got if out is None else out.unionByName(got)
    return out


def bm25(posts: DataFrame, docs: DataFrame, query: str, stemmed: bool = False, totals: dict | None = None) -> DataFrame:
    """(url, score) of every document that matches any scored term; no limit, as later steps need all.

    posts may be cut to the query's terms when totals (as an index keeps them) are given; else they are summed here."""
    if totals is None:
        per = posts.groupBy("field", "url").agg(F.first("length").alias("length")).groupBy("field").agg(F.sum("length").alias("total"))
        totals = {"n_docs": docs.count(), **dict.fromkeys(FIELDS, 0), **{r["field"]: r["total"] for r in per.collect()}}  # one row per field
    spark = docs.sparkSession
    exact = query_terms(spark, query, stemmed)
    hits = posts.join(F.broadcast(exact), ["field", "term"])  # one row per word of the query
    more = _expand(posts, query, stemmed)
    if more is not None:
        # a short prefix may stand for much of the vocabulary: a join of a size that Spark decides on
        hits = hits.unionByName(posts.join(more, ["field", "term"]).select(*hits.columns))
    df = hits.select("field", "term", "url").distinct().groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
    h = hits.join(df if more is not None else F.broadcast(df), ["field", "term"])
    by_field = lambda values: F.element_at(F.create_map(*[x for f in FIELDS for x in (F.lit(f), F.lit(float(values[f])))]), F.col("field"))
    n = F.lit(float(totals["n_docs"]))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = K1 * (1 - B + B * F.col("length") / (by_field(totals) / n))
    part = F.col("n") * by_field(BOOST) * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)
    return h.groupBy("url").agg(F.round(F.sum(part), 9).alias("score"))


def scan_scores(rows: DataFrame, query: str, stemmed: bool = False) -> DataFrame:
    """(url, score) as bm25 gives it, straight from document rows where no index is stored.

    One scan keeps of each document the lengths of its fields and the counts of the query's terms;
    what is shuffled is that narrow table. Prefixes need the index."""
    if _multiple(query, stemmed):
        raise ValueError("a prefix, pattern or range is expanded from stored postings")
    wanted = _weighted(query, stemmed)
    spark, order = rows.sparkSession, sorted(wanted)
    if not order:
        return spark.createDataFrame([], "url STRING, score DOUBLE")
    each = _terms_of(stemmed)
    asked = {f: [t for g, t in order if g == f] for f in FIELDS}
    # one pass over a field's terms counts them and keeps the wanted ones
    kept = lambda f: F.filter(each[f], lambda w: w.isin(asked[f])) if asked[f] else F.array().cast("array<string>")
    length = F.array(*[F.size(each[f]) for f in FIELDS])
    narrow = rows.where("url IS NOT NULL").select("url", _row_hash().alias("h"), length.alias("length"), F.array(*[kept(f) for f in FIELDS]).alias("kept"))
    narrow = checkpoint(narrow.groupBy("url").agg(F.min_by(F.struct("length", "kept"), "h").alias("v")).select("url", "v.*"))
    terms = spark.createDataFrame([(FIELDS.index(f), t, float(BOOST[f] * n)) for (f, t), n in wanted.items()], "field INT, term STRING, weight DOUBLE")
    total = narrow.agg(F.count(F.lit(1)).alias("n_docs"), F.array(*[F.sum(F.col("length")[j]) for j in range(len(FIELDS))]).alias("total"), F.lit(1).alias("_one"))
    each_field = narrow.select("url", "length", F.posexplode("kept").alias("field", "kept"))
    hits = each_field.select("url", "field", F.col("length")[F.col("field")].alias("length"), F.explode("kept").alias("term"))
    hits = hits.groupBy("url", "field", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))
    df = hits.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
    # terms and df: one row per query term; total: one row
    h = hits.join(F.broadcast(terms.join(df, ["field", "term"])), ["field", "term"]).join(F.broadcast(total), F.lit(1) == F.col("_one"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = K1 * (1 - B + B * F.col("length") / (F.col("total")[F.col("field")] / F.col("n_docs")))
    part = F.col("weight") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)
    return h.groupBy("url").agg(F.round(F.sum(part), 9).alias("score"))


def _matches(clause: list, stemmed: bool) -> Column:
    """Whether a document matches a clause by its own fields (phrases, prefixes, all words)."""
    ok = F.lit(False)
    for f, terms, kind in clause:
        if f == "url":
            own = F.array("url")
        elif f in ("owner", "address"):
            own = F.split(F.col(f), " ")
        elif f == "nodeName":
            own = X.word_ngrams(X.tokens(F.col(f)))
        else:
            own = X.tokens(F.col(f))
            if stemmed:
                own = stem_arrays(own)
        own = F.coalesce(own, F.array().cast("array<string>"))
        if kind == "phrase" and f not in ("nodeName", "url"):
            joined = F.concat(F.lit(" "), F.array_join(own, " "), F.lit(" "))
            ok = ok | joined.contains(" " + " ".join(terms) + " ")
        elif kind == "phrase":
            ok = ok | (F.size(F.array_except(F.array(*[F.lit(t) for t in terms]), own)) == 0)
        elif kind in MANY:
            ok = ok | F.exists(own, lambda w: _fits(w, kind, terms))
        else:
            ok = ok | F.arrays_overlap(own, F.array(*[F.lit(t) for t in terms]))
    return ok


def search(posts: DataFrame, docs: DataFrame, query: str, stemmed: bool = False) -> DataFrame:
    """(url, owner, address, name, score): all candidates; their retrieval order is score, then url.

    Conditions of AND, NOT and phrases are checked on the documents that the postings find. Texts are
    joined by those who show them, for the rows that they show."""
    return _retrieve(bm25(posts, docs, query, stemmed), docs, query, stemmed)


def search_rows(rows: DataFrame, query: str, stemmed: bool = False) -> DataFrame:
    """As search, from document rows without a stored index."""
    scores = scan_scores(rows, query, stemmed)
    return _retrieve(scores, documents(rows.join(scores.select("url"), "url", "left_semi")), query, stemmed)


def _retrieve(scores: DataFrame, docs: DataFrame, query: str, stemmed: bool) -> DataFrame:
    q = parse(query, stemmed)
    found = docs.join(scores, "url")
    for clause in q["all"]:
        found = found.where(_matches(clause, stemmed))
    for clause in q["none"]:
        found = found.where(~_matches(clause, stemmed))
    strict = [c for c in q["any"] if any(k == "phrase" for _, _, k in c)]
    if strict and len(strict) == len(q["any"]):
        ok = F.lit(False)
        for c in strict:
            ok = ok | _matches(c, stemmed)
        found = found.where(ok)
    name = F.coalesce(F.nullif(F.col("nodeName"), F.lit("")), F.col("url"))
    return found.select("url", "owner", "address", name.alias("name"), "score")


def retrieval_order() -> list[Column]:
    return [F.desc("score"), F.asc("url")]


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their number from 1 in an order of all rows: a range-partitioned sort, the partitions' counts,
    and a number within each partition; no task ever holds more than its range."""
    placed = checkpoint(rows.orderBy(*order)).withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id()})
    counts = dict(placed.groupBy("_p").agg(F.count(F.lit(1))).collect())  # one row per partition
    start, at = {}, 0
    for p in sorted(counts):
        start[p], at = at, at + counts[p]
    if not start:
        return placed.select(*rows.columns, F.lit(0).cast("bigint").alias(name))
    first = F.element_at(F.create_map(*[F.lit(int(x)) for kv in start.items() for x in kv]), F.col("_p"))
    return placed.select(*rows.columns, (first + F.col("_i").bitwiseAND((1 << 33) - 1) + 1).cast("bigint").alias(name))


def highlight(text: Column, query: str, stemmed: bool = False, marks: tuple[str, str] = BOLD, size: int = FRAGMENT, top: int | None = None) -> Column:
    """Fragments around matched words, marked: all, or the first top ones; the first SNIPPET characters where none matches."""
    wanted = {t for c in parse(query, stemmed)["any"] + parse(query, stemmed)["all"] for f, ts, k in c if f == "text" for t in ts}
    word = re.compile(r"[^\W_]+(?:\.[^\W_]+)*")

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        hits = [m for m in word.finditer(t) if (stem(m.group().lower()) if stemmed else m.group().lower()) in wanted]
        if not hits:
            return t[:SNIPPET]
        out, end = [], -1
        for m in hits:
            a, b = max(0, m.start() - size // 2), min(len(t), m.end() + size // 2)
            if out and a <= end:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
            end = b
        parts = []
        for a, b in out[:top]:
            parts.append(word.sub(lambda m: marks[0] + m.group() + marks[1] if (stem(m.group().lower()) if stemmed else m.group().lower()) in wanted else m.group(), t[a:b]))
        return "...".join(parts)

    return F.pandas_udf(lambda s: s.map(one), "string")(text)


class ResultCache:
    """Results by (query, highlight, index version, as_of): least recently used, with a time limit.

    An entry is a persisted DataFrame; entries that leave are released. An empty query is never kept."""

    def __init__(self, seconds: float = 300, entries: int = 200, clock=_time.monotonic):
        self.seconds, self.entries, self.clock = seconds, entries, clock
        self._held: OrderedDict[tuple, tuple[float, DataFrame]] = OrderedDict()

    def get(self, key: tuple, make):
        query = (key[0] or "").strip()
        if not query:
            return make()
        key = (query, *key[1:])
        got = self._held.get(key)
        if got and got[0] > self.clock():
            self._held.move_to_end(key)
            return got[1]
        if got:
            self._drop(key)
        made = make().persist()
        self._held[key] = (self.clock() + self.seconds, made)
        while len(self._held) > self.entries:
            self._drop(next(iter(self._held)))
        return made

    def _drop(self, key: tuple) -> None:
        self._held.pop(key)[1].unpersist()

    def clear(self) -> None:
        for k in list(self._held):
            self._drop(k)

    def __len__(self) -> int:
        return len(self._held)

