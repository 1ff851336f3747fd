import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from moorgrid.functions import survival as V
from moorgrid.functions import text as X
from moorgrid.functions import timefmt as D
from moorgrid.functions.stem import stem


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "raw, plain",
    [
        ("`!Bold`! and `_under`_", "Bold and under"),
        ("`Ff00red`f text`b", "red text"),
        ("a `<x y> b", "a b"),
        ("keep # gone\nnext", "keep \nnext"),
        (">>Head\n  >sub\ntext > 3", "Head\nsub\ntext > 3"),
        ("a\\b   c\t\td", "a b c d"),
        ("a\n\n\n \n\nb", "a\n\nb"),
        ("", ""),
        (None, None),
        ("a\r#x\u2028y", "a\r"),
        ("`", ""),
    ],
)
def test_strip_markup(spark, raw, plain):
    assert one(spark, raw, X.strip_markup) == plain


@pytest.mark.parametrize("block, target", [(":/p.mu", ":/p.mu"), ("label`A:/p.mu", "A:/p.mu"), ("l`u`action=view", "u`action=view"), ("l`u`*x", "u"), ("a`b`c`d", "")])
def test_link_block(spark, block, target):
    assert one(spark, block, X.link_block) == target


def test_links(spark):
    page = "x `[a`:/i.mu] `[b`0123:/e.mu] `[none] `[a`:/i.mu] `[l`:/q`f=1]"
    row = spark.createDataFrame([("ad", page)], "a string, p string").select(*[c.alias(n) for c, n in zip(X.resolve_links(F.col("a"), F.col("p")), "io")]).first()
    assert row["i"] == ["ad:/i.mu", "ad:/q`f=1"] and row["o"] == ["0123:/e.mu"]


def test_urls(spark):
    assert one(spark, "ab:/p.mu", X.address_from_url) == "ab" and one(spark, "ab:/p.mu", X.path_from_url) == "/p.mu" and one(spark, "ab", X.path_from_url) == ""
    assert one(spark, "zz:/p", X.parse_url) is None and one(spark, "0a:/p", X.parse_url)["path"] == "/p" and one(spark, "0a:b:c", X.parse_url) is None


def test_small_texts(spark):
    assert one(spark, " a\n b\t``c ", X.format_text) == " a b c "
    assert one(spark, "a\x00\x85\ufffdb", X.replace_malformed) == "ab"
    assert one(spark, None, X.clean_query) == "" and one(spark, "\t q \u00a0", X.clean_query) == "q"
    assert one(spark, "<ab>", X.plain_hex) == "ab"
    assert X.contains_pattern("a\\b%") == "%a\\\\b%%"
    assert one(spark, bytes([0x92, 0xC4, 0x0E]) + b"name" + bytes([0xC0]), X.announce_name, "binary") == "name"
    assert one(spark, b"plain", X.announce_name, "binary") == "plain"


def test_ngrams(spark):
    assert one(spark, ["abcde", "abc"], X.word_ngrams, "array<string>") == ["abcd", "bcde", "abcde"]


@pytest.mark.parametrize("seconds, shown", [(0.0, ""), (86400 + 300.0, "1d 5m"), (59.9, "59s"), (3661.0, "1h 1m 1s"), (-1.0, "23h 59m 59s"), (None, None)])
def test_timedelta(spark, seconds, shown):
    assert one(spark, seconds, D.format_timedelta, "double") == shown


def test_times(spark):
    assert one(spark, 1704067200.5, D.strftime, "double") == "01.01.2024, 00:00:00"
    assert one(spark, "2024-01-01T00:00:00.250000", D.iso_seconds) == 1704067200.25
    assert one(spark, "2024-01-01T00:00:00+05:00", D.iso_seconds) == 1704067200.0
    assert one(spark, "yesterday", D.iso_seconds) is None


def test_gamma_quantile():
    assert np.allclose(V.unit_gamma_ppf(0.05, np.array([1.0])), -math.log(0.95), rtol=1e-12)
    assert np.allclose(2 * V.unit_gamma_ppf(0.95, np.array([10.0])), 31.410432844, atol=1e-7)
    assert np.allclose(2 * V.unit_gamma_ppf(0.05, np.array([10.0])), 10.850811394, atol=1e-7)
    a = np.array([0.5, 1, 3, 50, 400.0])
    for p in (0.05, 0.5, 0.95):
        assert np.allclose(V.gamma_cdf(a, V.unit_gamma_ppf(p, a)), p, atol=1e-10)
    assert np.isnan(V.unit_gamma_ppf(0.5, np.array([0.0, np.nan]))).all()


def test_dead_interval(spark):
    rows = [(None, None, 0.0), (1.0, 1800.0, 600.0), (1.0, 1800.0, 6000.0), (20.0, 1e6, -5.0), (300.0, 1e6, 9e5)]
    low, high = V.dead_interval(F.col("a"), F.col("b"), F.col("dt"))
    got = spark.createDataFrame(rows, "a double, b double, dt double").select(low.alias("l"), high.alias("h")).collect()
    assert (got[0]["l"], got[0]["h"]) == (0.0, 0.0) and (got[3]["l"], got[3]["h"]) == (0.0, 0.0)
    assert all(0 <= r["l"] <= r["h"] <= 1 for r in got)
    assert got[1]["l"] <= got[2]["l"] and got[1]["h"] <= got[2]["h"]
    with pytest.raises(ValueError):
        V.dead_interval(F.col("a"), F.col("b"), F.col("dt"), 1.0)


@pytest.mark.parametrize("word, base", [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("falling", "fall"), ("happy", "happi"), ("relational", "relat"), ("conditional", "condit"), ("digitizer", "digit"), ("triplicate", "triplic"), ("hopeful", "hope"), ("revival", "reviv"), ("adjustment", "adjust"), ("adoption", "adopt"), ("probate", "probat"), ("controll", "control"), ("sky", "sky"), ("карта", "карта"), ("be", "be")])
def test_stem(word, base):
    assert stem(word) == base
