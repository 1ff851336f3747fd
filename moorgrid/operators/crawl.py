"""Crawl dataflow: admission by time to live, and breadth-first rounds over a page table."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moorgrid.functions.text import address_from_url, resolve_links, strip_markup
from moorgrid.session import checkpoint

TTL, QUEUE, START_PAGE = 86400, 5000, ":/page/index.mu"


def _fold(ttl: float):
    """Admitted rows of a partition sorted by (url, ts); only the last url and its clock are held."""

    def run(batches):
        url, last = None, -np.inf
        for b in batches:
            names, ts = b.column(0), b.column(1).to_numpy()
            code = names.dictionary_encode().indices.to_numpy()
            cut = np.flatnonzero(np.r_[True, code[1:] != code[:-1], True]) if len(ts) else [0]
            taken = []
            for lo, hi in zip(cut[:-1], cut[1:]):
                name = names[int(lo)].as_py()
                if name != url:
                    url, last = name, -np.inf
                at = int(lo)
                while at < hi:
                    # the first time that is late enough; the difference itself decides, as sums may round
                    at += max(0, int(np.searchsorted(ts[at:hi], last + ttl)) - 1) if last > -np.inf else 0
                    while at < hi and ts[at] - last < ttl:
                        at += 1
                    if at < hi:
                        last = ts[at]
                        taken.append(at)
                        at += 1
            yield b.take(pa.array(taken, pa.int64()))

    return run


def admissions(attempts: DataFrame, ttl: float = TTL) -> DataFrame:
    """(url, ts) of admitted attempts (url, ts, seq): first, or ttl after the last admitted one.

    Rejected attempts leave the clock as it is, so each url is a fold over its sorted times; equal
    times of one url are one attempt. Rows come sorted by Spark, which spills, and pass by as Arrow
    batches: a url of any number of attempts takes constant memory, though one task."""
    rows = attempts.where("url IS NOT NULL AND ts IS NOT NULL").select("url", F.col("ts").cast("double").alias("ts"))
    return rows.repartition("url").sortWithinPartitions("url", "ts").mapInArrow(_fold(max(1.0, float(ttl))), "url STRING, ts DOUBLE")


def seeds(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.concat("dst", F.lit(START_PAGE)).alias("url"))


def page_links(pages: DataFrame) -> DataFrame:
    """(url, links): resolved links of pages (url, text)."""
    inside, outside = resolve_links(address_from_url(F.col("url")), F.col("text"))
    return pages.select("url", F.concat(inside, outside).alias("links"))


def page_table_loader(pages: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A loader that answers from stored pages; only page urls are asked for."""
    own = pages.select("url", "text")
    return lambda frontier: own.join(frontier.where(F.col("url").contains(".mu")), "url", "left_semi").where("text IS NOT NULL AND text <> ''")


def link_table_loader(pages: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """As page_table_loader and page_links in one: links are extracted once, and rounds join addresses only."""
    own = pages.select("url", "text").where(F.col("url").contains(".mu") & F.col("text").isNotNull() & (F.col("text") != ""))
    links = checkpoint(page_links(own).repartition("url"))
    return lambda frontier: links.join(frontier, "url", "left_semi")


def crawl(start: DataFrame, load: Callable[[DataFrame], DataFrame], extract: Callable[[DataFrame], DataFrame] = page_links, max_rounds: int = 1000, queue: int | None = None) -> DataFrame:
    """(url, depth) of all visited urls, round by round until no new url appears.

    queue bounds the new urls of a round as a full queue does: those found first (by page, then by place
    in it) stay, the newest are dropped and may come back; None, the default, is the exact way without a
    bound. A crawl that is deeper than max_rounds is an error, never a shorter result."""
    visited = checkpoint(start.where("url IS NOT NULL").select("url").distinct().withColumn("depth", F.lit(0)))
    frontier = visited.select("url")
    for depth in range(1, max_rounds + 2):
        found = extract(load(frontier)).select(F.col("url").alias("page"), F.posexplode("links").alias("place", "url"))
        if queue is None:
            new = found.select("url").distinct().join(visited.select("url"), "url", "left_anti")
        else:
            first = found.groupBy("url").agg(F.min(F.struct("page", "place")).alias("came"))
            new = first.join(visited.select("url"), "url", "left_anti").orderBy("came", "url").limit(queue).select("url")
        new = checkpoint(new.withColumn("depth", F.lit(depth)))
        if not new.limit(1).count():
            return visited
        if depth > max_rounds:
            raise RuntimeError(f"the crawl is deeper than {max_rounds} rounds")
        visited = visited.unionByName(new)
        if depth % 5 == 0:
            visited = checkpoint(visited)
        frontier = new.select("url")
    raise AssertionError


def crawled_documents(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """Search documents of crawled pages (url, text, owner): stripped text and the node's name."""
    own = nodes.select(F.col("dst").alias("address"), F.col("name").alias("nodeName"))
    rows = pages.where("text IS NOT NULL AND text <> ''").select("url", strip_markup(F.col("text")).alias("text"), "owner", address_from_url(F.col("url")).alias("address"))
    return rows.join(own, "address", "left").select("url", "text", "owner", "address", "nodeName")
