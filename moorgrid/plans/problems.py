"""Queries of the general data problems: sessions (p1) and orphan references (p5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from moorgrid.operators import orphans as O
from moorgrid.operators import sessions as S
from moorgrid.sources.tables import read

GAP_S = 1800
SETTINGS = [60, 300, 900, 1800, 3600, 14400]


def _tree(spark, d):
    return S.gap_tree(S.points(read(spark, d, "user_search_history"), "remote_identity", "time", "query", "id"))


def p1_found(spark, d):
    s = S.cut(_tree(spark, d), GAP_S)
    return s.select(F.col("entity").alias("remote_identity"), F.floor("start_time").cast("bigint").alias("start_s"), F.floor("end_time").cast("bigint").alias("end_s"), F.col("n_events").alias("n_queries"))


def p1_sessions(spark, d):
    s = S.cut(_tree(spark, d), GAP_S)
    return s.select(F.col("entity").alias("remote_identity"), F.round("start_time", 3).alias("start_time"), F.round("end_time", 3).alias("end_time"), F.round("duration", 3).alias("duration_s"), F.col("n_events").alias("n_queries"))


def p1_gap_settings(spark, d):
    s = S.cut_many(_tree(spark, d), SETTINGS)
    return s.groupBy("threshold").agg(F.count(F.lit(1)).alias("n_sessions"), F.countDistinct("entity").alias("n_identities"), F.max("n_events").alias("longest_session"), F.round(F.avg("duration"), 4).alias("avg_duration_s"))


def p5_found(spark, d):
    return O.orphans(read(spark, d, "citations"), read(spark, d, "nodes")).select("id", "field", "kind")


def p5_by_period(spark, d):
    return O.by_period(O.orphans(read(spark, d, "citations"), read(spark, d, "nodes")))


_EV = """ev AS (
  SELECT DISTINCT id, lower(regexp_replace(remote_identity, '^\\s+|\\s+$', '', 'g')) AS e, "time" AS t
  FROM user_search_history
  WHERE "time" IS NOT NULL AND regexp_matches(coalesce(remote_identity, ''), '\\S') AND regexp_matches(coalesce(query, ''), '\\S')),
"""


def _sessions_sql(threshold: str, src: str = "ev") -> str:
    return f"""gaps AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY e{', threshold' if src != 'ev' else ''} ORDER BY t, id) <= {threshold} THEN 0 ELSE 1 END AS brk FROM {src}),
runs AS (SELECT *, sum(brk) OVER (PARTITION BY e{', threshold' if src != 'ev' else ''} ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS s FROM gaps)
"""


_REFS = """n AS (SELECT lower(trim(dst)) AS k, arg_max(removed, updated_at) AS gone, arg_max(created_at, updated_at) AS known_at FROM nodes GROUP BY 1),
r AS (SELECT DISTINCT id, field, nullif(lower(regexp_replace(a, '^[\\s<>]+|[\\s<>]+$', '', 'g')), '') AS k, created_at AS ct
  FROM (SELECT id, 'target_address' AS field, target_address AS a, created_at FROM citations UNION ALL SELECT id, 'src_address', src_address, created_at FROM citations)),
o AS (SELECT id, field, r.k, ct, CASE WHEN n.k IS NULL THEN 'missing' WHEN gone THEN 'deleted' WHEN known_at > ct THEN 'late' END AS kind FROM r LEFT JOIN n ON r.k = n.k WHERE r.k IS NOT NULL)
"""

QUERIES = {f.__name__: f for f in (p1_found, p1_sessions, p1_gap_settings, p5_found, p5_by_period)}

ORACLES = {
    "p1_found": f"WITH {_EV}{_sessions_sql(str(GAP_S))} SELECT e AS remote_identity, CAST(floor(min(t)) AS BIGINT) AS start_s, CAST(floor(max(t)) AS BIGINT) AS end_s, count(*) AS n_queries FROM runs GROUP BY e, s",
    "p1_sessions": f"WITH {_EV}{_sessions_sql(str(GAP_S))} SELECT e AS remote_identity, round(min(t), 3) AS start_time, round(max(t), 3) AS end_time, round(max(t) - min(t), 3) AS duration_s, count(*) AS n_queries FROM runs GROUP BY e, s",
    "p1_gap_settings": f"""WITH {_EV}evs AS (SELECT ev.*, x.threshold FROM ev, (SELECT unnest({[float(x) for x in SETTINGS]}::DOUBLE[]) AS threshold) x),
{_sessions_sql('threshold', 'evs')}, ss AS (SELECT threshold, e, s, max(t) - min(t) AS dur, count(*) AS n FROM runs GROUP BY 1, 2, 3)
SELECT threshold, count(*) AS n_sessions, count(DISTINCT e) AS n_identities, max(n) AS longest_session, round(avg(dur), 4) AS avg_duration_s FROM ss GROUP BY 1""",
    "p5_found": f"WITH {_REFS} SELECT id, field, kind FROM o WHERE kind IS NOT NULL",
    "p5_by_period": f"WITH {_REFS} SELECT field, kind, CAST(floor(ct / 86400) * 86400 AS BIGINT) AS period_start, count(*) AS n_refs, count(DISTINCT k) AS n_keys FROM o WHERE kind IS NOT NULL GROUP BY 1, 2, 3",
}
