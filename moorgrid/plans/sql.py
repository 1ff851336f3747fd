"""Shared pieces of the SQL that mirrors the queries."""

from moorgrid.functions.survival import PRIOR_ALPHA, PRIOR_BETA, RATE_DOWN, RATE_UP
from moorgrid.functions.text import SPACE, TOKEN

AS_OF = 1707955200.0

NODES = """n0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY updated_at DESC, id DESC, "time" DESC) AS rn FROM nodes WHERE dst IS NOT NULL) WHERE rn = 1),
ln AS (SELECT * FROM n0 WHERE NOT coalesce(removed, false))"""
PEERS = """p0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY updated_at DESC, id DESC, "time" DESC) AS rn FROM peers WHERE dst IS NOT NULL) WHERE rn = 1)"""


def address(x: str) -> str:
    return f"nullif(lower(regexp_replace({x}, '^[\\s<>]+|[\\s<>]+$', '', 'g')), '')"


CITES = f"""c1 AS (SELECT id, {address('target_address')} AS target_address, {address('src_address')} AS src_address, created_at, coalesce(removed, false) AS removed FROM citations),
c0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target_address, src_address ORDER BY created_at DESC, id DESC, removed DESC) AS rn FROM c1 WHERE target_address IS NOT NULL AND src_address IS NOT NULL) WHERE rn = 1),
lc AS (SELECT * FROM c0 WHERE NOT removed)"""

NODE_ORDER = 'rank DESC NULLS LAST, "time" DESC NULLS LAST, dst'
PEER_ORDER = '"time" DESC NULLS LAST, dst'


def strftime(x: str) -> str:
    return f"strftime(make_timestamp(CAST(floor({x} * 1000000) AS BIGINT)), '%d.%m.%Y, %H:%M:%S')"


def timedelta(x: str) -> str:
    s = f"CAST(floor({x}) AS BIGINT)"
    d = f"CAST(floor(floor({x}) / 86400) AS BIGINT)"
    r = f"({s} - {d} * 86400)"
    parts = [(d, "d"), (f"({r} // 3600)", "h"), (f"({r} % 3600 // 60)", "m"), (f"({r} % 60)", "s")]
    return "concat_ws(' ', " + ", ".join(f"CASE WHEN {v} > 0 THEN {v} || '{u}' END" for v, u in parts) + ")"


def quantiles(alphas: str, ci: float = 0.9) -> str:
    """CTEs q(a, p, v): quantiles of unit gamma distributions with whole alpha, by bisection of the Erlang sum."""
    lo, hi = (1 - ci) / 2, 1 - (1 - ci) / 2
    cdf = "1 - list_sum(list_transform(range(CAST(a AS BIGINT)), lambda j: exp(-((lo + hi) / 2) + j * ln((lo + hi) / 2) - lgamma(j + 1))))"
    return f"""qa AS (SELECT DISTINCT a FROM ({alphas})),
qb(a, p, lo, hi, i) AS (
  SELECT CAST(a AS DOUBLE), CAST(p AS DOUBLE), CAST(0 AS DOUBLE), CAST(a + 40 * sqrt(a) + 40 AS DOUBLE), 0 FROM qa, (VALUES ({lo}), ({hi})) t(p)
  UNION ALL
  SELECT a, p, CASE WHEN c < p THEN (lo + hi) / 2 ELSE lo END, CASE WHEN c < p THEN hi ELSE (lo + hi) / 2 END, i + 1 FROM (SELECT *, {cdf} AS c FROM qb WHERE i < 70)),
q AS (SELECT a, max(CASE WHEN p < 0.5 THEN (lo + hi) / 2 END) AS q_lo, max(CASE WHEN p > 0.5 THEN (lo + hi) / 2 END) AS q_hi FROM qb WHERE i = 70 GROUP BY a)"""


def dead(rate: str, dt: str) -> str:
    total = RATE_DOWN + RATE_UP
    pi = f"(CASE WHEN {dt} <= 0 THEN 0.0 ELSE {RATE_DOWN / total!r}::DOUBLE * (1 - exp(-{total!r}::DOUBLE * {dt})) END)"
    silent = f"exp(-({rate}) * {dt})"
    return f"(CASE WHEN {pi} + (1 - {pi}) * {silent} > 0 THEN {pi} / ({pi} + (1 - {pi}) * {silent}) ELSE 1.0 END)"


def features(as_of: float = AS_OF) -> str:
    """CTEs nf(dst, rank, p_dead_low, p_dead_high, time) of live nodes; needs NODES."""
    a, b = f"coalesce(announce_alpha, {PRIOR_ALPHA})", f"coalesce(announce_beta, {PRIOR_BETA})"
    dt = f"greatest({as_of}::DOUBLE - \"time\", 0.0)"
    return f"""{quantiles(f'SELECT {a} AS a FROM ln')},
nf AS (SELECT dst, rank, name, "time", {dead(f'q_lo / {b}', dt)} AS x_lo, {dead(f'q_hi / {b}', dt)} AS x_hi FROM ln JOIN q ON q.a = {a}),
ns AS (SELECT dst, rank, name, "time", least(x_lo, x_hi) AS p_dead_low, greatest(x_lo, x_hi) AS p_dead_high FROM nf)"""


def strip(x: str) -> str:
    x = f"regexp_replace({x}, '`[fb]', '', 'g')"
    x = f"regexp_replace({x}, '`[FB][^\\n]{{3}}', '', 'g')"
    for m in "car!_=`":
        x = f"replace({x}, '`{m}', '')"
    x = f"regexp_replace({x}, '`<[^>]*>', ' ', 'g')"
    x = f"regexp_replace({x}, '#[^\\n]*', '', 'g')"
    x = f"regexp_replace({x}, '(?m)^[{SPACE}]*>+', '', 'g')"
    x = f"replace({x}, '\\', ' ')"
    x = f"regexp_replace({x}, '[ \\t]+', ' ', 'g')"
    x = f"regexp_replace({x}, '\\n[{SPACE}]*\\n+', chr(10) || chr(10), 'g')"
    return f"replace({x}, '`', '')"


LINKS = """lb AS (SELECT url, doc_id, unnest(regexp_extract_all(text, '`\\[([^\\n]*?)\\]', 1)) AS b FROM documents WHERE url IS NOT NULL),
ls AS (SELECT url, doc_id, string_split(b, '`') AS s, b FROM lb),
ll AS (SELECT url, doc_id, CASE len(s) WHEN 1 THEN b WHEN 2 THEN s[2] WHEN 3 THEN CASE WHEN starts_with(s[3], '*') THEN s[2] ELSE s[2] || '`' || s[3] END ELSE '' END AS l FROM ls),
lr AS (SELECT DISTINCT url, doc_id, l AS raw, CASE WHEN starts_with(l, ':') THEN split_part(url, ':', 1) || l ELSE l END AS link FROM ll WHERE contains(l, ':'))"""

_GRAMS = f"flatten(list_transform(regexp_extract_all(lower(nodeName), '{TOKEN}'), lambda w: flatten(list_transform(range(4, least(15, len(w)) + 1), lambda n: list_transform(range(1, len(w) - n + 2), lambda i: substring(w, i, n))))))"
INDEX = f"""d AS (SELECT url, any_value(text) AS text, any_value(owner) AS owner, any_value(address) AS address, any_value(nodeName) AS nodeName FROM search_documents WHERE url IS NOT NULL GROUP BY url),
occ AS (SELECT url, 'text' AS field, unnest(list_filter(regexp_extract_all(lower(text), '{TOKEN}'), lambda x: len(x) >= 2)) AS term FROM d
  UNION ALL SELECT url, 'url', url FROM d
  UNION ALL SELECT url, 'owner', unnest(list_filter(string_split(owner, ' '), lambda x: x <> '')) FROM d
  UNION ALL SELECT url, 'address', unnest(list_filter(string_split(address, ' '), lambda x: x <> '')) FROM d
  UNION ALL SELECT url, 'nodeName', unnest({_GRAMS}) FROM d)"""


def bm25(terms: list[tuple[str, str, int]]) -> str:
    """CTEs sc(url, score); needs INDEX."""
    values = ", ".join("('{}', '{}', {})".format(f, t.replace("'", "''"), n) for f, t, n in terms)
    return f"""qt(field, term, n) AS (VALUES {values}),
po AS (SELECT field, term, url, count(*) AS tf FROM occ GROUP BY 1, 2, 3),
le AS (SELECT field, url, count(*) AS length FROM occ GROUP BY 1, 2),
al AS (SELECT field, sum(length) / (SELECT count(*) FROM d) AS mean FROM le GROUP BY field),
hi AS (SELECT po.*, qt.n, le.length, al.mean FROM po JOIN qt USING (field, term) JOIN le USING (field, url) JOIN al USING (field)),
dn AS (SELECT field, term, count(*) AS df FROM hi GROUP BY 1, 2),
sc AS (SELECT url, round(sum(n * CASE field WHEN 'nodeName' THEN 2.0 ELSE 1.0 END * ln(1 + ((SELECT count(*) FROM d) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 9) AS score FROM hi JOIN dn USING (field, term) GROUP BY url),
re AS (SELECT sc.url, score, text, owner, address, coalesce(nullif(nodeName, ''), sc.url) AS name, row_number() OVER (ORDER BY score DESC, sc.url) AS pos FROM sc JOIN d USING (url))"""


def ranked(as_of: float = AS_OF) -> str:
    """CTEs rk(url, address, name, score, p_dead_low, p_dead_high, time, order_no); needs NODES, INDEX, bm25."""
    return f"""{features(as_of)},
w1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY pos) AS k FROM re) WHERE k = 1),
w2 AS (SELECT * FROM (SELECT * EXCLUDE (k), row_number() OVER (PARTITION BY address ORDER BY pos) AS k FROM w1) WHERE k <= 2),
j1 AS (SELECT w2.*, coalesce(rank, 0) AS nrank, coalesce(p_dead_low, 0) AS lo, coalesce(p_dead_high, 0) AS hi, coalesce(ns."time", 0) AS seen, ln(1 + greatest(coalesce(rank, 0), 0)) AS lr FROM w2 LEFT JOIN ns ON ns.dst = w2.address),
mm AS (SELECT min(score) AS s0, max(score) AS s1, min(lr) AS r0, max(lr) AS r1 FROM j1),
bl AS (SELECT url, text, owner, address, name, pos, lo AS p_dead_low, hi AS p_dead_high, seen AS "time",
  round(0.65 * CASE WHEN s1 > s0 THEN (score - s0) / (s1 - s0) ELSE 0 END + 0.25 * CASE WHEN r1 > r0 THEN (lr - r0) / (r1 - r0) ELSE 0 END + 0.1 * greatest(0, least(1, 1 - (lo + hi) / 2)), 9) AS score FROM j1, mm),
rk AS (SELECT *, row_number() OVER (ORDER BY p_dead_low > 0.9, score DESC, pos) AS order_no FROM bl)"""


def pagerank(edges: str, vertices: str | None, rounds: int, weights: str | None = None, alpha: float = 0.15) -> str:
    """CTEs pr(v, score) after a fixed number of rounds."""
    out = [f"pe0 AS ({edges})"]
    out.append(f"pv AS (SELECT DISTINCT v FROM ({vertices or 'SELECT src AS v FROM pe0 UNION ALL SELECT dst FROM pe0'}) WHERE v IS NOT NULL)")
    out.append("pe AS (SELECT DISTINCT src, dst FROM pe0 WHERE src IN (SELECT v FROM pv) AND dst IN (SELECT v FROM pv))")
    out.append("pd AS (SELECT src, count(*) AS deg FROM pe GROUP BY src)")
    if weights:
        out.append(f"pw AS (SELECT v, sum(weight) AS w FROM ({weights}) WHERE weight > 0 AND v IN (SELECT v FROM pv) GROUP BY v)")
        out.append("pt AS (SELECT pv.v, CASE WHEN (SELECT coalesce(sum(w), 0) FROM pw) > 0 THEN coalesce(w, 0) / (SELECT sum(w) FROM pw) ELSE 1.0 / (SELECT count(*) FROM pv) END AS t FROM pv LEFT JOIN pw USING (v))")
    else:
        out.append("pt AS (SELECT v, 1.0::DOUBLE / (SELECT count(*) FROM pv) AS t FROM pv)")
    out.append("r0 AS (SELECT v, 1.0::DOUBLE / (SELECT count(*) FROM pv) AS r FROM pv)")
    for i in range(1, rounds + 1):
        p = f"r{i - 1}"
        out.append(f"g{i} AS (SELECT dst AS v, sum(r / deg) AS g FROM pe JOIN {p} ON {p}.v = pe.src JOIN pd USING (src) GROUP BY dst)")
        out.append(f"l{i} AS (SELECT coalesce(sum(r), 0) AS l FROM {p} WHERE v NOT IN (SELECT src FROM pd))")
        out.append(f"x{i} AS (SELECT pt.v, {1 - alpha!r} * coalesce(g, 0) + ({alpha} + {1 - alpha!r} * l) * t AS r FROM pt LEFT JOIN g{i} USING (v), l{i})")
        out.append(f"r{i} AS MATERIALIZED (SELECT v, r / (SELECT sum(r) FROM x{i}) AS r FROM x{i})")
    out.append(f"pr AS (SELECT v, r * (SELECT count(*) FROM pv) AS score FROM r{rounds})")
    return ",\n".join(out)
