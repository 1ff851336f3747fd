"""Text operators against brute force, round trips and made cases, with nulls, ties, copies and clashing columns."""

import itertools
import random
import re
import unicodedata

import numpy as np
import pytest

from moorgrid.llm import bpe, canonical, language, leakage, near_dup, residue, residue_examples, site_lines, term_counts
from moorgrid.llm.words import mix, shingles, word_hashes, words

WORDS = [f"w{i}" for i in range(60)]


def sentence(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


# terms


def test_terms(spark):
    r = random.Random(1)
    rows = [(r.choice([i, i * 70_000, -i]), r.choice([None, "", "  ", "common " + sentence(r, 3), "Common, COMMON!"]), "x", 1) for i in range(1, 900)]
    rows += rows[:100] + [(None, "lost", "x", 1), (10**12, "big", "x", 1)]
    df = spark.createDataFrame(rows, "id long, query string, term string, chunk int")
    texts = {}
    for i, q, *_ in rows:
        if i is not None and q is not None:
            texts[i] = min(texts.get(i, q), q)
    df_, occ = {}, {}
    for q in texts.values():
        for w in set(words(q)):
            df_[w] = df_.get(w, 0) + 1
        for w in words(q):
            occ[w] = occ.get(w, 0) + 1
    got = {x["term"]: (x["n_records"], x["n_occurrences"], x["mark"]) for x in term_counts.term_table(df, "id", "query").collect()}
    want = {w: (n, occ[w], "rare" if n <= 2 else "common" if n >= 0.01 * len(texts) else None) for w, n in df_.items()}
    assert got == want
    assert term_counts.term_table(df.limit(0), "id", "query").count() == 0


def test_containers():
    r = np.random.default_rng(3)
    for n in (0, 1, 4095, 4096, 65536):
        x = np.sort(r.choice(65536, n, replace=False))
        assert (term_counts.decode(term_counts.encode(x)) == x).all()
    a, b = np.arange(0, 5000), np.arange(4000, 9000)
    assert (term_counts.decode(term_counts.union([term_counts.encode(a), term_counts.encode(b)])) == np.arange(9000)).all()


# byte-pair encoding


@pytest.fixture(scope="module")
def ranks():
    with open(bpe.VOCABULARY, "rb") as f:
        return bpe.load(f.read())


def test_bpe_equals_the_public_library(ranks):
    import regex
    import tiktoken
    from hypothesis import given, settings
    from hypothesis import strategies as st

    enc = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    pattern = regex.compile(bpe.PATTERN)

    @settings(max_examples=200, deadline=None)
    @given(st.one_of(st.text(), st.text(alphabet="ab \n'’éж日🙂"), st.text(alphabet="aA1 ").map(lambda s: s * 50)))
    def check(s):
        ids = bpe.encode(s, ranks, pattern, {})
        assert ids == enc.encode_ordinary(s) and enc.decode(ids) == s

    check()
    long = "ab" * 30000 + "<|endoftext|>"
    assert bpe.encode(long, ranks, pattern, {}) == enc.encode_ordinary(long)


def test_bpe_rows(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "hello world", 5), (3, "hello world", 5)], "doc_id long, text string, ids int")
    got = [(r["doc_id"], r["ids"]) for r in bpe.token_ids(df, "doc_id", "text").collect()]
    assert sorted(got) == [(1, []), (2, []), (3, [31373, 995]), (3, [31373, 995])]
    assert bpe.token_ids(df.limit(0), "doc_id", "text").count() == 0


# canonical forms


def test_canonical(spark):
    cases = [
        ("plain text", "plain text"), ("ｆｕｌｌ　ｗｉｄｔｈ", "full width"), ("e\u0301te\u0301", "été"), ("ze\u200bro\u00adwidth\ufeff", "zerowidth"), ("a\u00a0b\u2009c", "a b c"),
        ("раssword", "password"), ("ΑΒ", "AB"), ("ﬁne", "fine"), ("ё", "ë"), ("е\u0308", "ë"), ("й", "й"), ("x²", "x²"), ("①", "①"), ("a\r\nb\rc", "a\nb\nc"), ("ﾊﾞ", "バ"), ("", ""), (None, None), ("it's \\ 'q'", "it's \\ 'q'"), ("ﻣ", "م"), ("a\fb\vc", "a b c"), ("a\u2800b", "a b"), ("ɑɡe", "age"), ("ı", "ı"),
    ]
    df = spark.createDataFrame([(i, a, "clash") for i, (a, _) in enumerate(cases)], "k long, x string, form string")
    got = {r["k"]: r["canonical"] for r in canonical.canonical(df, "k", "x").collect()}
    assert [got[i] for i in range(len(cases))] == [b for _, b in cases]
    again = spark.createDataFrame([(k, v) for k, v in got.items()], "k long, x string")
    assert {r["k"]: r["canonical"] for r in canonical.canonical(again, "k", "x").collect()} == got


def test_alike_pairs(spark):
    rows = [(1, "abc"), (2, "аbс"), (3, "abc"), (4, "ab\u200bc"), (5, "abd"), (6, "\u200b"), (7, " "), (8, None), (9, ""), (2, "аbс")]
    got = {(r["a"], r["b"]) for r in canonical.alike_pairs(spark.createDataFrame(rows, "id long, t string"), "id", "t").collect()}
    assert got == {(1, 2), (2, 3), (1, 4), (3, 4), (2, 4)}


def test_letters_without_a_latin_twin_and_of_other_scripts(spark):
    rows = [(1, "ΓΠΦ"), (2, "ГПФ"), (3, "code"), (4, "cօde"), (5, "ᴄᴏde"), (6, "HAT"), (7, "ᎻᎪᎢ"), (8, "ΛΔΣ"), (9, "ЛДЗ"), (10, "гпф")]
    got = {(r["a"], r["b"]) for r in canonical.alike_pairs(spark.createDataFrame(rows, "id long, t string"), "id", "t").collect()}
    assert got == {(1, 2), (3, 4), (3, 5), (4, 5), (6, 7)}
    assert len(canonical.OTHERS) == len(canonical.OTH_LATIN) and len(canonical.GREEK_ONLY) == len(canonical.GRE_CYRILLIC)


def test_maps_are_of_one_shape():
    assert all(unicodedata.normalize("NFC", b) == b for b in canonical.shape_map().values())
    assert len(canonical.CYRILLIC) == len(canonical.CYR_LATIN) and len(canonical.GREEK) == len(canonical.GRE_LATIN)


# leakage


def test_leaks(spark):
    r = random.Random(5)
    items = [(i, "t", "Item, " + " ".join(f"{r.choice(WORDS)}{r.randint(0, 9)}" for _ in range(r.choice([5, 11, 12, 30, 40])))) for i in range(25)] + [(99, "t", None), (98, "t", "")]
    docs = []
    for i in range(200):
        t = sentence(r, r.randint(0, 60)).split()
        if r.random() < 0.5:
            src = words(items[r.randrange(25)][2])
            a = r.randrange(len(src))
            t[len(t) // 2 : len(t) // 2] = src[a : a + r.choice([8, 11, 12, 13, 25])]
        docs.append((i, ", ".join(t).upper() if r.random() < 0.3 else "\r\n".join(t), "x"))
    docs += [(400, None, "x"), (401, "", "x"), docs[7], (402, " ".join(["long"] * 5000) + " " + items[4][2], "x")]
    grams = lambda w: {tuple(w[i : i + 12]) for i in range(len(w) - 11)}
    of_doc, of_item = [(d[0], grams(words(d[1]))) for d in docs], [(i[0], grams(words(i[2]))) for i in items]
    want = {(d, i) for d, x in of_doc for i, y in of_item if x & y}
    dd, ii = spark.createDataFrame(docs, "doc_id long, text string, pos string"), spark.createDataFrame(items + items[:3], "item_id long, task string, text string")
    for bits_per_key in (32, 1):
        got = [(x["doc"], x["item"]) for x in leakage.leaks(dd, "doc_id", "text", ii, "item_id", "text", bits_per_key).collect()]
        assert set(got) == want and len(got) == len(want) and want
    assert leakage.leaks(dd, "doc_id", "text", ii.limit(0), "item_id", "text").count() == 0
    assert leakage.leaks(dd.limit(0), "doc_id", "text", ii, "item_id", "text").count() == 0


def test_leaks_of_two_texts_under_one_item_and_of_null_keys(spark):
    a, b = " ".join(f"a{i}" for i in range(15)), " ".join(f"b{i}" for i in range(15))
    items = spark.createDataFrame([(1, a), (1, b), (None, a), (2, "few words")], "item_id long, text string")
    docs = spark.createDataFrame([(1, a), (2, b + " x"), (3, "x " + a + " y " + b), (None, a), (4, " ".join(f"a{i}" for i in range(11)))] + [(10 + i, a) for i in range(50)], "doc_id long, text string")
    got = sorted((x["doc"], x["item"]) for x in leakage.leaks(docs, "doc_id", "text", items, "item_id", "text").collect())
    assert got == [(1, 1), (2, 1), (3, 1), *((10 + i, 1) for i in range(50))]


# near duplicates


def jaccard_pairs(rows, t, k, least):
    s = {}
    for u, x, *_ in rows:
        if u is not None and x is not None and len(words(x)) >= max(k, least):
            w = words(x)
            s[u] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    return {(a, b) for a, b in itertools.combinations(sorted(s), 2) if len(s[a] & s[b]) >= t * len(s[a] | s[b]) - 1e-12}


@pytest.mark.parametrize("t, k, least", [(0.5, 3, 40), (0.8, 5, 0)])
def test_near_duplicates(spark, t, k, least):
    r = random.Random(11)
    rows = []
    for i in range(60):
        base = sentence(r, r.randint(20, 120)).split()
        for j in range(r.choice([1, 1, 2, 4])):
            w = list(base)
            for _ in range(r.choice([0, 1, 3, 8])):
                w[r.randrange(len(w))] = r.choice(WORDS)
            if r.random() < 0.2:
                w = w[len(w) // 2 :] + w[: len(w) // 2]
            rows.append((f"u{i}_{j}", " ".join(w), "c", 1))
    rows += [(f"copy{i}", rows[3][1], "c", 1) for i in range(50)] + [("n", None, "c", 1), ("e", "", "c", 1), (None, rows[3][1], "c", 1), rows[5], ("long", " ".join(rows[8][1] for _ in range(300)), "c", 1)]
    df = spark.createDataFrame(rows, "url string, text string, key string, grp int").repartition(5)
    want = jaccard_pairs(rows, t, k, least)
    assert len(want) > 1000
    got = [(x["a"], x["b"]) for x in near_dup.pairs(df, "url", "text", t, k, least).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    if t == 0.8:
        return
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in want:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    links = {u: sum(u in p for p in want) for u in {x[0] for x in rows if x[0]}}
    cls = {x["url"]: (x["class_id"], x["n_links"]) for x in near_dup.classes(df, "url", "text", t, k, least).collect()}
    assert cls == {u: (find(u), links[u]) for u in links}


def test_groups_of_one_prefix_and_hot_shingles(spark, monkeypatch):
    # sets that share prefix and size but differ, and shingles of more sets than a cell holds
    monkeypatch.setattr(near_dup, "HOT", 7)
    r = random.Random(21)
    base = [f"z{i}" for i in range(30)]
    rows = []
    for i in range(60):
        w = list(base)
        for j in r.sample(range(30), r.choice([0, 1, 2, 9])):
            w[j] = r.choice(["p", "q", "s", f"own{i}"])
        rows.append((f"u{i}", " ".join(w)))
    rows += [(f"v{i}", f"all share this one phrase own{i} own{i}x own{i}y") for i in range(40)] + [(f"c{i}", rows[0][1]) for i in range(30)]
    df = spark.createDataFrame(rows, "url string, text string")
    for t, k in ((0.5, 2), (0.8, 2)):
        for parts in (1, 5):
            got = [(x["a"], x["b"]) for x in near_dup.pairs(df.repartition(parts), "url", "text", t, k, 0).collect()]
            assert len(got) == len(set(got)) and set(got) == jaccard_pairs(rows, t, k, 0) and got


def test_one_shingle_in_very_many_texts():
    import time

    n, r = 100_000, np.random.default_rng(5)
    tok = mix(np.full(n, 77, dtype=np.uint64))
    salt = mix(np.arange(n, dtype=np.uint64))
    at, cell, side = near_dup._cells(tok, salt, np.full(n, n))
    rows = -(-n // near_dup.HOT)
    assert len(at) == n * rows and np.bincount(np.unique(cell, return_inverse=True)[1]).max() < 2.5 * near_dup.HOT
    # the work of the fullest cell is bounded whatever the number of texts
    one = at[cell == np.unique(cell)[0]]
    ids = r.integers(-(2**62), 2**62, len(one))
    maps = r.integers(0, 2**63, (len(one), near_dup.MAP_WORDS)).astype(np.uint64)
    t = time.time()
    row = (ids.tobytes(), np.full(len(one), 4, dtype=np.int32).tobytes(), np.ones(len(one), dtype=np.uint32).tobytes(), ids.tobytes(), maps.tobytes(), np.zeros(len(one), dtype=np.uint32).tobytes(), np.arange(len(one), dtype=np.uint16).tobytes(), side[cell == np.unique(cell)[0]].astype(np.uint32).tobytes())
    near_dup._bucket_pairs([row], 0.5)
    assert time.time() - t < 60


def test_postings_in_rounds_and_short_sets(spark, monkeypatch):
    # about 7 KB of postings a set at this size; a round may write 8 bytes a shingle
    got = near_dup._rounds(1_200_000, 180_000_000, 0.5, 74)
    assert len(got) >= 3 and got[0][0] == 0 and got[-1][1] == 74 and all(a[1] == b[0] for a, b in zip(got, got[1:]))
    assert near_dup._rounds(0, 0, 0.5, 8) == [(0, 8)] and near_dup._rounds(90_000, 14_000_000, 0.5, 7) == [(0, 7)]
    r = random.Random(31)
    s = [np.array(r.sample(range(1 << 62), 400), dtype=np.uint64) for _ in range(40)]
    s = [np.unique(np.r_[x[:300], y[:100]]) for x, y in itertools.combinations(s, 2)]
    a, b = s[0], s[1]
    short = [np.sort((x >> np.uint64(24)).astype(np.uint16)).tobytes() for x in (a, b)]
    assert near_dup._shared(*short, True)[0] >= near_dup._shared(a.tobytes(), b.tobytes(), False)[0] > 100
    monkeypatch.setattr(near_dup, "ROUND_LEAST", 1)
    monkeypatch.setattr(near_dup, "FLUSH_POSTS", 50)
    base = [f"z{i}" for i in range(30)]
    rows = [(f"u{i}", " ".join(w if r.random() < 0.85 else f"x{r.randrange(9)}" for w in base)) for i in range(90)]
    monkeypatch.setattr(near_dup, "ROUND_BYTES", 1)
    got = [(x["a"], x["b"]) for x in near_dup.pairs(spark.createDataFrame(rows, "url string, text string").repartition(3), "url", "text", 0.5, 2, 0).collect()]
    assert len(got) == len(set(got)) and set(got) == jaccard_pairs(rows, 0.5, 2, 0) and len(got) > 90


def test_near_duplicates_empty(spark):
    df = spark.createDataFrame([], "url string, text string")
    assert near_dup.pairs(df, "url", "text").count() == 0 and near_dup.classes(df, "url", "text").count() == 0


def test_bounds_lose_nothing():
    assert near_dup.need(np.array([100]), np.array([100]), 0.5) == 67 and near_dup.need(np.array([50]), np.array([100]), 0.5) == 50
    h = word_hashes(["a", "b", "a", "b", "a"])
    assert len(np.unique(shingles(h, 2))) == 2 and len(shingles(h, 9)) == 0


# lines of one source


def line_pairs(rows, least=5, share=0.1):
    docs, on = {}, {}
    for u, a, t, *_ in rows:
        if u is None:
            continue
        docs.setdefault(a, set()).add(u)
        for line in (t or "").splitlines():
            n = " ".join(line.lower().split())
            if n:
                on.setdefault((a, n), set()).add(u)
    return {k for k, v in on.items() if len(v) >= least and len(v) >= share * len(docs[k[0]])}


def test_site_lines(spark):
    r = random.Random(8)
    rows = []
    for i in range(400):
        a = r.choice(["A", "A", "B", None, f"s{i % 30}"])
        own = ["Kept by Anna of the North group.", f"Page {i} of 400", "  KEPT  BY ANNA OF THE NORTH GROUP.", "=====", "", sentence(r, 8), "free to copy, " + r.choice(["Ana", "Bea"]) + " says so today"]
        rows.append((f"u{i}", a, r.choice(["\n", "\r\n", "\r"]).join(r.sample(own, 5)), "clash", 1))
    rows += rows[:30] + [("nul", "A", None, "c", 1), ("emp", "A", "", "c", 1), (None, "A", "=====", "c", 1), ("long", "B", "x " * 50000 + "\n=====", "c", 1)]
    df = spark.createDataFrame(rows, "url string, address string, text string, line string, lid int").repartition(4)
    kept, at = site_lines.repeated(df, "url", "address", "text")
    got = [(x["source"], x["line"]) for x in site_lines.frequent_lines(kept).collect()]
    want = line_pairs(rows)
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 5
    few, _ = site_lines.repeated(df, "url", "address", "text", key_docs=5)
    assert {(x["source"], x["line"]) for x in site_lines.frequent_lines(few).collect()} == want
    masks = {x["cluster"] for x in kept.where("line LIKE 'page % of 400' AND source = 'A'").collect()}
    assert len(masks) == 1  # numbers are masked, so the variants are one cluster
    clean = {x["url"]: x["text"] for x in site_lines.cleaned(df, "url", "address", "text").collect()}
    assert set(clean) == {x[0] for x in rows if x[0]} and clean["nul"] is None and clean["emp"] == ""
    gone = {(s, n) for s, n in want}
    for u, a, t, *_ in rows:
        if u and t:
            assert not [x for x in (clean[u] or "").splitlines() if (a, " ".join(x.lower().split())) in gone]
    assert site_lines.repeated(df.limit(0), "url", "address", "text")[0].count() == 0


def line_clusters(rows, least):
    """Clusters by comparing all lines of a source with each other."""
    forms, on = {}, {}
    for u, a, t in rows:
        for line in t.splitlines():
            n = site_lines.normal(line)
            forms.setdefault((a, n), set()).add(tuple(site_lines.masked(line)))
            on.setdefault((a, n), set()).add(u)
    each = [(a, n, m) for (a, n), ms in forms.items() for m in ms]
    bands = site_lines.keys_of([x[0] for x in each], [x[1] for x in each], [list(x[2]) for x in each])[1][:, : site_lines.BANDS]
    root = {x[:2]: x[:2] for x in each}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, x), (j, y) in itertools.combinations(enumerate(each), 2):
        p, q = set(x[2]), set(y[2])
        if x[0] == y[0] and (bands[i] == bands[j]).any() and len(p & q) >= 0.8 * len(p | q) - 1e-9:
            root[find(x[:2])] = find(y[:2])
    out = {}
    for x in root:
        out.setdefault(find(x), set()).add(x)
    return {frozenset(c) for c in out.values() if len(set().union(*(on[x] for x in c))) >= least}


def test_clusters_of_one_hot_address(spark):
    r = random.Random(9)
    common = "the of and relay under bridge keeps its old map for all who pass here today".split()
    kinds = [" ".join(r.sample(common, r.randint(4, 11))) for _ in range(60)]
    rows = []
    for i in range(300):
        own = []
        for k in r.sample(kinds, 4):
            w = k.split()
            w.insert(r.randint(1, len(w)), str(r.randint(0, 10**6)))
            if r.random() < 0.3:
                w[r.randrange(len(w))] = r.choice(common)
            own.append(" ".join(w))
        own.append(r.choice(["mirror kept by Anna today", "mirror kept by Bert today", "mirror kept by anna today"]))
        rows.append((f"u{i}", r.choice(["A", "A", "A", None]), "\n".join(own)))
    df = spark.createDataFrame(rows, "url string, address string, text string")
    got = {}
    for parts in (1, 6):
        kept, _ = site_lines.repeated(df.repartition(parts), "url", "address", "text", 5, 0.0)
        clusters = {}
        for x in kept.collect():
            clusters.setdefault(x["cluster"], set()).add((x["source"], x["line"]))
        got[parts] = {frozenset(c) for c in clusters.values()}
    assert got[1] == got[6] == line_clusters(rows, 5) and len(got[1]) > 20


def test_a_chain_of_lines_that_are_each_too_rare(spark):
    # each line is on four pages, the cluster on twelve: it is the cluster that recurs
    a = "one two three four five six seven eight nine ten eleven twelve"
    forms = [a, a.replace("twelve", "dozen"), a.replace("twelve", "dozen").replace("eleven", "more")]
    own = [" ".join(chr(97 + i) * k for k in (2, 3, 4, 5)) for i in range(12)]
    rows = [(f"u{i}", "A", f"{own[i]}\n{forms[i % 3]}") for i in range(12)]
    clean = {x["url"]: x["text"] for x in site_lines.cleaned(spark.createDataFrame(rows, "url string, address string, text string"), "url", "address", "text", 5, 0.1).collect()}
    assert clean == {f"u{i}": own[i] for i in range(12)}


def test_packed_keys_are_counted_exactly(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(site_lines, "HELD", 500)
    r = random.Random(41)
    docs = [("A", f"u{i}", "\n".join(sentence(r, r.randint(1, 3)) for _ in range(6))) for i in range(300)]
    b = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*docs)], names=["source", "url", "text"])
    src, _, norm, masks = site_lines._read(b)
    k, n = np.unique(site_lines._short(site_lines.keys_of(src, norm, masks)[1].ravel()), return_counts=True)
    for least in (1, 2, 5):
        got = np.concatenate([x.column(0).to_numpy() for x in site_lines._often(least)(site_lines._keys(iter([b])))]).view(np.uint64)
        assert sorted(got.tolist()) == k[n >= least].tolist() and len(got)


def test_pairs_at_the_bound_share_a_band():
    r = random.Random(31)
    hits, n = 0, 2000
    for _ in range(n):
        both = [r.getrandbits(60) for _ in range(8)]
        k = site_lines.keys_of(["A", "A"], ["x", "y"], [both + [r.getrandbits(60)], both + [r.getrandbits(60)]])[1][:, : site_lines.BANDS]
        hits += bool((k[0] == k[1]).any())
    assert hits / n >= 0.92  # measured 0.94, as the numbers of bands and rows say


def test_cleaned_lines_beside_all_pairs(spark):
    from pathlib import Path

    import duckdb

    if not Path("/root/testdata/sf0.01").exists():
        pytest.skip("test tables are not here")
    path = "/root/testdata/sf0.01/search_documents.parquet"
    rows = duckdb.execute(f"SELECT DISTINCT url, address, text FROM read_parquet('{path}') WHERE url IS NOT NULL").fetchall()
    docs, forms, on = {}, {}, {}
    for u, a, t in rows:
        docs.setdefault(a, set()).add(u)
        for line in site_lines.lines_of(t):
            n = site_lines.normal(line)
            forms.setdefault(a, {}).setdefault(n, set()).add(frozenset(site_lines.masked(line)))
            on.setdefault((a, n), set()).add(u)
    want = set()
    for a, own in forms.items():
        masks = sorted({m for ms in own.values() for m in ms}, key=len)
        root = {m: m for m in masks}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for i, p in enumerate(masks):
            for q in masks[i + 1 :]:
                if len(p) < 0.8 * len(q):
                    break
                if len(p & q) >= 0.8 * len(p | q) - 1e-9:
                    root[find(p)] = find(q)
        for ms in own.values():
            first, *rest = ms
            for m in rest:
                root[find(first)] = find(m)
        clusters = {}
        for n, ms in own.items():
            clusters.setdefault(find(next(iter(ms))), set()).add(n)
        for c in clusters.values():
            m = len(set().union(*(on[a, n] for n in c)))
            if m >= 5 and m >= 0.1 * len(docs[a]):
                want |= {(a, n) for n in c}
    kept, _ = site_lines.repeated(spark.read.parquet(path), "url", "address", "text")
    got = {(x["source"], x["line"]) for x in kept.collect()}
    assert want and not got - want and len(got & want) >= 0.98 * len(want)


def test_connected_sets():
    r = random.Random(10)
    for n, size in ((2, 5), (40, 9), (300, 12)):
        sets = [np.array(sorted(r.sample(range(size + 6), r.randint(2, size)))) for _ in range(n)] + [np.arange(3)] * 2
        like = lambda a, b: len(set(a) & set(b)) >= 0.8 * len(set(a) | set(b)) - 1e-9
        want = list(range(len(sets)))
        for i, j in itertools.combinations(range(len(sets)), 2):
            if like(sets[i].tolist(), sets[j].tolist()) and want[i] != want[j]:
                a, b = sorted((want[i], want[j]))
                want = [a if w == b else w for w in want]
        assert site_lines.connected(sets).tolist() == want


# residue


def test_residue_cases(spark):
    r = random.Random(2)
    prose = lambda: ". ".join(f"The {r.choice(['old', 'small', 'quiet'])} {r.choice(['relay', 'router', 'bridge'])} near the {r.choice(['hill', 'bay'])} {r.choice(['stores', 'hides', 'sorts'])} the {r.choice(['evening', 'shared'])} {r.choice(['report', 'channel'])} since the {r.choice(['storm', 'upgrade'])}" for _ in range(9)) + "."
    good = [prose() for _ in range(150)]
    talk = [prose() + ' In the course at Hill we write "{{name}}" into the template and the builder of Bay puts the real name there. ' + prose(), prose() + " If you see internal error 500, restart the page server in Bay and read the log, as Hill advises. " + prose(), prose() + " The chapter about lorem ipsum explains why designers in Bay fill 12 drafts with it. " + prose(), prose() + " We do not use JavaScript on Hill, because plain pages need 20 times less air time. " + prose()]
    bad = [prose() + " The {{ title }} relay hides. " + prose(), prose() + " %(city)s " + prose(), "TODO: describe your node in two sentences " + prose(), prose() + "\nYour text goes here.\n" + prose(), prose() + "\nLorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor.\n" + prose(), "asdf asdf asdf asdf asdf asdf", "Oops\n404 - no such page on Hill\nKept by Anna", "Please enable JavaScript to view this page.", "Seite nicht gefunden (404)", "Включите JavaScript, чтобы увидеть эту страницу."]
    rows = [(f"h:/g{i}", t, "k") for i, t in enumerate(good)] + [(f"h:/t{i}", t, "k") for i, t in enumerate(talk)] + [(f"h:/b{i}", t, "k") for i, t in enumerate(bad)]
    rows += [("h:/u{{slug}}.mu", good[0], "k"), ("h:/u%7B%7Bid%7D%7D.mu", None, "k"), ("h:/null", None, "k"), ("h:/empty", "", "k"), ("h:/short", "Hill", "k"), (None, bad[0], "k"), rows[-1], ("h:/long", " ".join(good * 20), "k"), ("h:/blong", " ".join(good * 20) + " ${name} " + good[0], "k")]
    df = spark.createDataFrame(rows, "url string, text string, kind string").repartition(3)
    got = {x["url"] for x in residue.residue(df, "url", "text").collect()}
    want = {f"h:/b{i}" for i in range(len(bad))} | {"h:/u{{slug}}.mu", "h:/u%7B%7Bid%7D%7D.mu", "h:/blong"}
    assert got == want
    left = residue.content(df.where("url IS NOT NULL"), "url", "text")
    assert left.where("url LIKE 'h:/b%'").count() == 0 and left.columns == df.columns
    assert residue.residue(df.limit(0), "url", "text").count() == 0


@pytest.mark.parametrize("near", [False, True])
def test_residue_that_holds_a_third_of_the_rows(spark, near):
    r = random.Random(12)
    prose = lambda: ". ".join(f"The {r.choice(['old', 'small', 'quiet'])} {r.choice(WORDS)} {r.choice(['relay', 'router', 'bridge'])} near the {r.choice(['hill', 'bay'])} {r.choice(['stores', 'hides', 'sorts'])} the {r.choice(['evening', 'shared'])} {r.choice(WORDS)} report" for _ in range(9)) + "."
    seeds = residue_examples.lines(residue_examples.NOTICES)
    pages = [". ".join(seeds[i] for i in (3, 90, 400, 900, 60)), residue_examples.CLASSIC]
    rows = [(f"h:/g{i}", prose()) for i in range(300)] + [(f"h:/b{i}", pages[i % 2] + (f" {r.choice(WORDS)} {i}" if near else "")) for i in range(150)]
    got = {x["url"] for x in residue.residue(spark.createDataFrame(rows, "url string, text string"), "url", "text").collect()}
    assert got == {f"h:/b{i}" for i in range(150)}


def test_residue_in_the_words_of_a_url():
    r = random.Random(13)
    model = residue.fit([sentence(r, 60) for _ in range(50)])
    for u in ("ab12:/page/your-text-goes-here.mu", "ab12:/page/lorem-ipsum.mu", "ab12:/page/lorem%20ipsum%20dolor.mu", "ab12:/insert_your_text_here", "ab12:/page/{{slug}}.mu"):
        assert residue.url_residue(u, model), u
    for u in (None, "", "faa3bb919cc4e6afee51aaa88c2f5052:/page/history_9046.mu", "ab12:/page/radio/12.mu", "ab12:/page/index.mu", "ab12:/page/test.mu", "ab12:/text/course-guide.mu"):
        assert not residue.url_residue(u, model), u


def test_prose_sample_takes_texts_once_and_short_ones_too(spark):
    rows = [(f"c{i}", "copy " * 80) for i in range(900)] + [(f"u{i}", f"short text {i}") for i in range(20)] + [("n", None), ("b", " \n")]
    got, keys = residue.prose_sample(spark.createDataFrame(rows, "k string, t string"), "k", "t", 50)
    assert keys[got.index("copy " * 80)] == "c0" and len(residue.prose_sample(spark.createDataFrame(rows, "k string, t string"), "k", "t", 50, 100)[0]) == 20
    assert sorted(got) == sorted({t for _, t in rows if t and t.strip()})


def test_the_model_is_fitted_on_all_texts(spark):
    # 5,000 short texts, more than a sample of 4,000 takes, one longer than 20,000 characters, and residue
    r = random.Random(41)
    texts = [sentence(r, 12) + f" own{i:x}\n" + sentence(r, 3) for i in range(5000)] + ["Only in this one " + sentence(r, 7000) + " zyxwvu. " + "Ä İ " * 5, "Another long one " + sentence(r, 7000) + " zyxwvu. Access refused, identify yourself.", "Oops\n404 - page not found\n" + sentence(r, 3), None, ""]
    texts += ["Please enable JavaScript to view this page.", texts[0], texts[1].upper()]
    urls = [f"h{i % 7}:/page/{'{{slug}}' if i == 9 else 'index'}_{i}.mu" for i in range(len(texts))]
    df = spark.createDataFrame(list(zip(urls, texts)), "url string, text string").repartition(3)
    assert len(texts[5000]) > 20_000
    want, got = residue.fit([t for t in texts if t], urls), residue.fit_all(df, "url", "text")
    assert want.keys() == got.keys() and all(np.array_equal(want[k], got[k]) for k in want)
    rare = residue._hash(residue._plain(" zyxwvu. "), residue.N, residue.SIZE.bit_length() - 1)
    assert (residue._line_counts([texts[5000].splitlines()[0]])[1][rare] > 0).all() and (got["notice"][rare] < 0).all()  # known as prose
    once = residue._hash(residue._plain("sed, identify your"), residue.N, residue.SIZE.bit_length() - 1)
    assert (got["talk"] != 0).any() and (got["filler"][once] >= 0).all()  # what one line alone has says nothing
    assert len(residue.fit_all(df.limit(0), "url", "text")) == len(got)


def test_proposals_of_urls_cover_all():
    r = random.Random(14)
    model = residue.fit([sentence(r, 60) for _ in range(50)])
    urls = ["ab12:/page/your-text-goes-here.mu", "ab12:/page/lorem-ipsum.mu", "ab12:/page/lorem%20ipsum%20dolor.mu", "ab12:/insert_your_text_here", "ab12:/page/{{slug}}.mu", "h:/u%7B%7Bid%7D%7D.mu", None, "", "ab12:/page/index.mu", "x/${a}", "TODO_describe_your_node_here"] * 3
    r.shuffle(urls)
    assert all(m or not residue.url_residue(u, model) for u, m in zip(urls, residue.propose_urls(urls, model)))
    assert not residue.propose_urls(["ab12:/page/index.mu"], model).any()


def test_proposals_cover_all_judgements():
    r = random.Random(4)
    texts = [sentence(r, r.randint(0, 80)) + r.choice(["", " {{x}}", " lorem ipsum dolor sit amet tempor magna", "\n404 not found", "Your text goes here."]) + sentence(r, 5) for _ in range(300)] + [None, "", "x", "asdf asdf asdf asdf"]
    model = residue.fit([sentence(r, 60) for _ in range(50)])
    maybe = residue.propose(texts, model)
    assert all(m or residue.judge(t, model)[0] is None for t, m in zip(texts, maybe))


# language


def test_language(spark):
    r = random.Random(6)
    vocab = {"en": "the and of with near under weather bridge through evening because which stores nothing should harbour".split(), "de": "der und nicht zwischen Wetter Brücke durch abends weil welche speichert nichts soll Hafen möchte über".split(), "ru": "и не между погода мост через вечером потому который хранит ничего должен гавань хочет над".split(), "fr": "le et dans avec près sous météo pont parce que lequel garde rien devrait havre soirée".split()}
    make = lambda lang, n: ". ".join(" ".join(r.choice(vocab[lang]) for _ in range(9)) for _ in range(n)) + "."
    pages, labels, truth = [], [], {}
    for i in range(240):
        a, b = r.sample(sorted(vocab), 2)
        mixed = r.random() < 0.2
        text = make(a, 6) + ("\n" + make(b, 5) if mixed else "")
        pages.append((f"u{i}", text, "x"))
        truth[f"u{i}"] = {a, b} if mixed else {a}
        claim = a if r.random() < 0.93 else b
        labels.append((f"u{i}", r.choice([claim, claim.upper(), claim + "-XX", claim + "_yy"])))
    pages += [("lorem", " ".join(["Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor"] * 4), "x"), ("nul", None, "x"), ("emp", "", "x"), ("num", "123 456 !!!", "x"), (None, make("en", 5), "x"), pages[3]]
    labels += labels[:5] + [("lorem", "und"), ("u1", None), ("gone", "en"), (None, "en"), ("emp", "")]
    p, l = spark.createDataFrame(pages, "url string, text string, lang string"), spark.createDataFrame(labels, "url string, lang string")
    found = language.detect(p, l, "url", "text", "lang").cache()
    got = {}
    for x in found.where("n_words >= 30").collect():
        got.setdefault(x["url"], set()).add(x["lang"])
        assert 0 < x["confidence"] <= 1
    right = sum(got.get(u) == t for u, t in truth.items())
    assert right >= 0.97 * len(truth) and "lorem" not in got and not {"nul", "emp", "num"} & set(got)
    claims = {}
    for u, c in labels:
        claims.setdefault(u, set()).add((c or "")[:2].lower())
    want = {(u, x) for u, s in got.items() for x in s if x not in claims.get(u, set())}
    assert {(x["url"], x["lang"]) for x in language.unclaimed(found, l, "url", "lang").collect()} == want
    segs = language.detect(p, l, "url", "text", "lang", True)
    assert segs.where("url = 'u0'").count() in (6, 11) and segs.groupBy("url", "segment").count().where("count > 1").count() == 0
    assert language.detect(p.limit(0), l, "url", "text", "lang").count() == 0
    assert language.detect(p, l.limit(0), "url", "text", "lang").count() == 0


def test_languages_of_few_pages_and_of_copies(spark):
    r = random.Random(16)
    vocab = {x: ["".join(r.choice(a) for _ in range(r.randint(3, 8))) for _ in range(80)] for x, a in (("en", "abcdefgh"), ("de", "hijklmno"), ("sv", "opqrstuv"), ("fi", "vwxyzæøå"))}
    make = lambda x, n: ". ".join(" ".join(r.choice(vocab[x]) for _ in range(9)) for _ in range(n)) + "."
    pages = [(f"{x}{i}", make(x, 8)) for x in ("en", "de") for i in range(40)] + [(f"sv{i}", make("sv", 8)) for i in range(3)] + [(f"fi{i}", make("fi", 8)) for i in range(30)]
    labels = [(u, u[:2]) for u, _ in pages] + [("en5", "nl"), ("en6", "nl"), ("mix", "no")]
    copy = make("fi", 8)
    pages += [(f"ficopy{i}", copy) for i in range(900)] + [("mix", make("en", 5) + " " + make("de", 5))]
    labels += [(f"ficopy{i}", "fi") for i in range(900)]
    pages += [(f"new_{x}{i}", make(x, 8)) for x in vocab for i in range(20)]
    p, l = spark.createDataFrame(pages, "url string, text string"), spark.createDataFrame(labels, "url string, lang string")
    sample = language.claimed_sample(p, l, "url", "text", "lang")
    assert sum(x == "fi" for x, _ in sample) == 31
    assert language.fit(sample)["langs"] == ["de", "en", "fi", "sv"]
    got = {(x["url"], x["lang"]) for x in language.detect(p, l, "url", "text", "lang").where("n_words >= 30").collect()}
    assert {(u, x) for u, x in got if u.startswith("new_")} == {(f"new_{x}{i}", x) for x in vocab for i in range(20)}
    assert {x for u, x in got if u.startswith("ficopy")} == {"fi"} and {x for u, x in got if u == "mix"} == {"en", "de"}


def test_a_second_language_without_stops_is_found():
    r = random.Random(17)
    vocab = {x: ["".join(r.choice(a) for _ in range(r.randint(3, 8))) for _ in range(80)] for x, a in (("en", "abcdefgh"), ("de", "hijklmno"), ("ja", "日本語文字海山川空"))}
    make = lambda x, n, by=", ": by.join(r.choice(vocab[x]) for _ in range(n))
    model = language.fit([(x, make(x, 60)) for x in vocab for _ in range(20)])
    for text, want in ((make("en", 60) + "; " + make("de", 45), {"en", "de"}), (make("de", 40, "、") + "。" + make("en", 40, " - "), {"de", "en"}), (make("ja", 50, "、") + "。" + make("de", 50, "; "), {"ja", "de"})):
        s = language.Segments([text])
        lang, _ = language.classify(s, model)
        words = {x: int(s.words[lang == i].sum()) for i, x in enumerate(model["langs"])}
        assert {x for x, n in words.items() if n >= 30} == want and s.words.sum() == len(words_of(text))


def words_of(text):
    return re.findall(r"[^\W_]+", text)


def test_segments_of_words():
    s = language.Segments(["One two. Three\nfour five!", None, "", "Six"])
    assert s.words.tolist() == [2, 1, 2, 1] and s.doc.tolist() == [0, 0, 0, 3]
    assert re.fullmatch(r"[a-z]+", "abc")
