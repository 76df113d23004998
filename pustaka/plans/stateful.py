"""Queries of keyed state; events stand for checks of links and for practice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pustaka.session import read
from pustaka.streaming import keyed_state as K


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def link_health_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.health(_events(spark, sf_dir), "user_id", ["ts", "event_id"], F.col("event_type") == "error")


def practice_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).filter("event_type = 'purchase'").withColumn("day", F.to_date("ts"))
    return K.streaks(e, "user_id", "day")


def retry_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.due_again(_events(spark, sf_dir), "user_id", "ts", F.col("event_type") == "error", F.col("event_type") != "error")


def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.tumbling(_events(spark, sf_dir), "ts", "event_type", "1 day").withColumnRenamed("start", "day_start")


def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.sessions(_events(spark, sf_dir), "user_id", "ts", "30 minutes").withColumnRenamed("start", "started")


def _life_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"view": "fetched", "error": "failure", "click": "verify", "purchase": "saved", "signup": "missing"}
    what = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return _events(spark, sf_dir).withColumn("what", what[F.col("event_type")])


def lifecycle_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where its events bring each file."""
    return K.lifecycle(_life_events(spark, sf_dir), "user_id", ["ts", "event_id"], F.col("what"), chunk=20)


def seen_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last ten kinds of question that each user has seen."""
    e = _events(spark, sf_dir).withColumn("kind", F.from_json("props", "k INT")["k"]).filter("kind IS NOT NULL")
    return K.seen_ring(e, "user_id", ["ts", "event_id"], "kind", 10)


QUERIES = {f.__name__: f for f in (lifecycle_states, seen_questions, link_health_debounce, practice_streak, retry_cooldown, tumbling_counts, session_windows)}

ORACLE = {
    "lifecycle_states": """WITH RECURSIVE e AS (SELECT user_id, event_type AS w, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
s AS (SELECT user_id, 0 AS k, 'pending' AS state FROM (SELECT DISTINCT user_id FROM events) UNION ALL
  SELECT s.user_id, e.k, CASE WHEN state = 'archived' THEN 'archived' WHEN w = 'click' THEN 'pending' WHEN state = 'failed 3' THEN state WHEN w = 'view' THEN CASE WHEN state = 'gone' THEN state ELSE 'ok' END
    WHEN w = 'error' THEN CASE state WHEN 'pending' THEN 'failed 1' WHEN 'failed 1' THEN 'failed 2' WHEN 'failed 2' THEN 'failed 3' ELSE state END
    WHEN w = 'signup' THEN 'gone' WHEN w = 'purchase' AND state IN ('ok', 'gone') THEN 'archived' ELSE state END
  FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1)
SELECT user_id, arg_max(state, k) AS state, max(k) AS n_events FROM s GROUP BY 1""",
    "seen_questions": """WITH l AS (SELECT user_id, json_extract(props, '$.k')::INT AS kind, max((ts, event_id)) AS last FROM events GROUP BY 1, 2)
SELECT user_id, kind FROM l WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY last DESC, kind) <= 10""",
    "link_health_debounce": """WITH e AS (SELECT user_id, ts, event_id, (event_type = 'error')::INT AS f FROM events), i AS (SELECT *, sum(1 - f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM e),
m AS (SELECT *, sum(f) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS misses FROM i), b AS (SELECT *, coalesce(lag(misses) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS bf FROM m)
SELECT user_id, count(*) FILTER (f = 0 AND bf < 2) AS n_up, count(*) FILTER (f = 1 AND misses < 2) AS n_missed, count(*) FILTER (f = 1 AND misses = 2) AS n_newly_down, count(*) FILTER (f = 1 AND misses > 2) AS n_still_down,
  count(*) FILTER (f = 0 AND bf >= 2) AS n_recovered, arg_max(misses, (ts, event_id)) >= 2 AS is_down FROM b GROUP BY user_id""",
    "practice_streak": """WITH d AS (SELECT DISTINCT user_id, ts::DATE AS d FROM events WHERE event_type = 'purchase'), r AS (SELECT *, d - row_number() OVER (PARTITION BY user_id ORDER BY d)::INT AS island FROM d),
g AS (SELECT user_id, island, count(*) AS n, max(d) AS e FROM r GROUP BY 1, 2) SELECT user_id, sum(n)::BIGINT AS n_days, max(n) AS longest, arg_max(n, e) AS last_run FROM g GROUP BY 1""",
    "retry_cooldown": """WITH g AS (SELECT user_id, max(ts) FILTER (event_type = 'error') AS last_failed, max(ts) FILTER (event_type <> 'error') AS last_ok FROM events GROUP BY 1), n AS (SELECT max(ts) AS newest FROM events)
SELECT user_id, last_failed, last_failed <= newest - INTERVAL 7 DAY AND (last_ok IS NULL OR last_ok < last_failed) AS due FROM g, n WHERE last_failed IS NOT NULL""",
    "tumbling_counts": "SELECT date_trunc('day', ts)::TIMESTAMP AS day_start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "session_windows": """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events), g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS started, max(ts) AS last_at, count(*) AS n FROM g GROUP BY user_id, k""",
}
