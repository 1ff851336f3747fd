"""References to parent keys that are missing, removed or learned of later.

A Bloom filter of all parent keys is built by aggregation and broadcast; a reference that it
rejects is a definite orphan and takes part in no join. The filter is an array of 64-bit words (four
bits of one word per key) in blocks of WORDS words. Its size is bounded by MAX_BLOCKS whatever the
number of parents (8 MiB at most): beyond that only more references pass on to the exact join.
The few keys that hold a large share of the references are joined by broadcast (at most 1 / share
of them can exist), the others by a shuffle, so one hot key never makes one hot task.

Defined cases: null and blank references are none; keys are compared in lower case without
surrounding white space and angle brackets; a repeated reference id counts once; references of rows
with a null id count once per distinct field, key and time; without parents every reference is missing; an unknown time of either side is never 'late'.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moorgrid.operators.relational import normal_address
from moorgrid.session import checkpoint

WORDS, MAX_BLOCKS, BITS_PER_KEY = 1024, 1024, 16


def latest_state(nodes: DataFrame) -> DataFrame:
    """One row per key: the state with the latest updated_at (ties: larger id, then removed)."""
    rank = F.struct(F.coalesce("updated_at", F.lit(float("-inf"))), F.col("id"), F.col("removed"))
    return (
        nodes.select(normal_address(F.col("dst")).alias("key"), "id", "updated_at", "removed", F.col("created_at").alias("known_at"))
        .where("key IS NOT NULL")
        .groupBy("key")
        .agg(F.max_by(F.struct(F.coalesce("removed", F.lit(False)).alias("gone"), F.col("known_at").alias("known_at")), rank).alias("s"))
        .select("key", F.col("s.gone").alias("gone"), F.col("s.known_at").alias("known_at"))
    )


def _place(key: Column, blocks: int) -> tuple[Column, Column, Column]:
    h, b = F.xxhash64(key), F.xxhash64(key, F.lit(7))
    word = F.pmod(h, F.lit(blocks * WORDS))
    bit = lambda k: F.expr(f"shiftleft(1L, cast(shiftrightunsigned(_bits, {6 * k}) & 63 as int))")
    return F.floor(word / WORDS).cast("int"), (word % WORDS).cast("int"), b, bit


def _with_place(df: DataFrame, key: str, blocks: int) -> DataFrame:
    block, word, bits, bit = _place(F.col(key), blocks)
    df = df.withColumns({"_block": block, "_word": word, "_bits": bits})
    return df.withColumn("_mask", bit(0).bitwiseOR(bit(1)).bitwiseOR(bit(2)).bitwiseOR(bit(3))).drop("_bits")


def bloom_blocks(n_keys: int, most: int = MAX_BLOCKS) -> int:
    """Blocks for that many keys; with most blocks (8 KiB each) the filter of more than most * WORDS * 64 /
    BITS_PER_KEY keys (4 million by default) fills up: at 4 times as many it passes about four in ten of the
    unknown keys on to the exact join, at 16 times nearly all."""
    return max(1, min(most, math.ceil(n_keys * BITS_PER_KEY / (64 * WORDS))))


def bloom(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """(_block, _words): the filter, one row per non-empty block."""
    words = _with_place(keys.select(key), key, blocks).groupBy("_block", "_word").agg(F.bit_or("_mask").alias("m"))
    packed = words.groupBy("_block").agg(F.map_from_entries(F.collect_list(F.struct("_word", "m"))).alias("at"))
    return packed.select("_block", F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda i: F.coalesce(F.col("at")[i], F.lit(0).cast("bigint"))).alias("_words"))


def probe(refs: DataFrame, key: str, filt: DataFrame, blocks: int) -> DataFrame:
    """refs with the column maybe: false proves that no parent has the key."""
    df = _with_place(refs, key, blocks).join(F.broadcast(filt), "_block", "left")
    hit = F.coalesce(F.col("_words")[F.col("_word")].bitwiseAND(F.col("_mask")) == F.col("_mask"), F.lit(False))
    return df.withColumn("maybe", hit).drop("_block", "_word", "_mask", "_words")


def join_unique(refs: DataFrame, parents: DataFrame, key: str, share: float = 0.01) -> DataFrame:
    """Left join to parents that are unique by key; keys with at least that share of refs are broadcast.

    refs and parents are read more than once, so they should be stored or checkpointed."""
    total = refs.count()
    # a key of that share of all rows has that share of some partition's rows, so each task passes on few keys
    hot = refs.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= max(2.0, share * total)).select(key, F.lit(True).alias("_hot"))
    # at most 1 / share keys can hold that share each
    hot_parents = checkpoint(hot.join(parents, key, "left"))
    if not hot_parents.limit(1).count():
        return refs.join(parents, key, "left")
    marked = refs.join(F.broadcast(hot_parents), key, "left")
    extra = [c for c in parents.columns if c != key]
    known = marked.where("_hot").drop("_hot")
    others = marked.where("_hot IS NULL").drop("_hot", *extra).join(parents, key, "left")
    return known.select(*refs.columns, *extra).unionByName(others.select(*refs.columns, *extra))


def references(citations: DataFrame, fields: tuple[str, ...] = ("target_address", "src_address")) -> DataFrame:
    """(id, field, key, at): one row per reference that is neither null nor blank."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), normal_address(F.col(f"r.{f}")).alias("key")) for f in fields]))
    refs = lambda rows: rows.select("id", F.col("r.created_at").alias("at"), each.alias("x")).select("id", "x.field", "x.key", "at").where("key IS NOT NULL")
    r = F.struct(*fields, "created_at").alias("r")
    known = refs(citations.where("id IS NOT NULL").groupBy("id").agg(F.min(r).alias("r")))
    return known.unionByName(refs(citations.where("id IS NULL").select("id", r)).distinct())


def orphans(citations: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, field, key, at, kind): every reference that is missing, deleted or late."""
    parents = checkpoint(latest_state(nodes))
    blocks = bloom_blocks(parents.count())
    tested = checkpoint(probe(references(citations), "key", bloom(parents, "key", blocks), blocks))
    definite = tested.where("NOT maybe").select("id", "field", "key", "at", F.lit("missing").alias("kind"))
    checked = join_unique(tested.where("maybe").drop("maybe"), parents, "key")
    kind = F.when(F.col("gone").isNull(), "missing").when(F.col("gone"), "deleted").when(F.col("known_at") > F.col("at"), "late")
    return definite.unionByName(checked.select("id", "field", "key", "at", kind.alias("kind")).where("kind IS NOT NULL"))


def by_period(found: DataFrame, seconds: int = 86400) -> DataFrame:
    """Orphans per field, kind and period; a null time gives the null period."""
    start = (F.floor(F.col("at") / seconds) * seconds).cast("bigint")
    return found.groupBy("field", "kind", start.alias("period_start")).agg(F.count(F.lit(1)).alias("n_refs"), F.countDistinct("key").alias("n_keys"))
