"""State tables out of events: users are owners, event types kinds of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import state
from ledgerline.plans.music import table
from ledgerline.streaming import limiter, tasks

_AS_OF = "2024-01-30 23:00:00"


def _events(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    return table(spark, sf_dir, "events").where(where)


def dedupe_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.keep_last(_events(spark, sf_dir), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


def dedupe_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.removed_count(_events(spark, sf_dir), ["user_id", "event_type"])


def _rows(spark: SparkSession, sf_dir: str, part: str) -> DataFrame:
    key = ["user_id", "source_id", "sync_type"]
    named = _events(spark, sf_dir, part).selectExpr("CAST(user_id AS STRING) AS user_id", "CAST(event_id % 97 AS STRING) AS source_id", "event_type AS sync_type", "CAST(event_id AS STRING) AS target_id", "ts AS synced_at", "event_id")
    return state.keep_last(named, key, ["event_id"]).drop("event_id").select(*key, "target_id", "synced_at")


def upsert_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = state.upsert(_rows(spark, sf_dir, "event_id % 2 = 0"), _rows(spark, sf_dir, "event_id % 2 = 1"), ["user_id", "source_id", "sync_type"])
    return ledger.select("user_id", "source_id", "sync_type", "target_id")


def save_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An upsert that keeps the status: the older half of the rows is dismissed."""
    old, new = (_rows(spark, sf_dir, f"event_id % 2 = {k}").selectExpr("user_id", "source_id", "sync_type", "target_id AS title", f"'{s}' AS status", "CAST(NULL AS STRING) AS resolved_target_id", "synced_at AS created_at") for k, s in ((0, "dismissed"), (1, "pending")))
    return state.save_unmatched(old, new).select("user_id", "source_id", "sync_type", "title", "status")


def ledger_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rest = state.mark_synced(_rows(spark, sf_dir, "event_id % 2 = 0"), _rows(spark, sf_dir, "event_id % 3 = 0"), _rows(spark, sf_dir, "event_id % 2 = 1"))
    return rest.select("user_id", "source_id", "sync_type", "target_id")


def coalesce_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _events(spark, sf_dir, "event_id % 2 = 0").select((F.col("event_id") / 2).cast("bigint").alias("id"), "event_type", "value")
    new = _events(spark, sf_dir, "event_id % 6 = 1").select(F.floor(F.col("event_id") / 2).alias("id"), F.when(F.col("event_id") % 4 == 1, F.col("event_type")).alias("event_type"), F.when(F.col("event_id") % 5 == 1, F.col("value")).alias("value"))
    kept = state.update(base, new, ["id"])
    put = state.update(base, new, ["id"], null_keeps=False)
    return kept.join(put.select("id", F.col("event_type").alias("put_type"), F.col("value").alias("put_value")), "id")


def latest_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.latest(_events(spark, sf_dir), [F.desc("ts"), F.desc("event_id")], 20, ["user_id"]).select("user_id", "event_id", "event_type")


def review_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = _events(spark, sf_dir).selectExpr("event_id", "user_id", "event_type AS sync_type", "IF(event_id % 3 = 0, 'dismissed', 'pending') AS status", "ts")
    return state.review_page(queue, [F.desc("ts"), F.desc("event_id")], 50, 100, "pending", "error").select("event_id", "user_id", "total")


def _tasks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    last = state.keep_last(_events(spark, sf_dir), ["user_id", "event_type"], ["ts", "event_id"])
    rows = last.selectExpr("CAST(event_id AS STRING) AS id", "CAST(user_id AS STRING) AS user_id", "user_id AS run_id", "CASE event_type WHEN 'click' THEN 'running' WHEN 'view' THEN 'starting' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'chunk_complete' ELSE 'completed' END AS status", "ts AS created_at", "ts AS updated_at")
    runs = rows.groupBy("run_id").agg(F.count("*").alias("n")).selectExpr("run_id AS id", "IF(run_id % 3 = 0, 'completed', 'running') AS status", "CAST(NULL AS TIMESTAMP) AS completed_at")
    return rows, runs


def stale_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, runs = _tasks(spark, sf_dir)
    rows, runs = state.expire_tasks(rows, runs, F.lit(_AS_OF).cast("timestamp"))
    return rows.join(runs.select(F.col("id").alias("run_id"), F.col("status").alias("run_status")), "run_id").select("id", "user_id", "status", "run_status")


def running_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.running_task(_tasks(spark, sf_dir)[0]).select("user_id", "id", "status")


def unexpired_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("event_id", (F.col("ts") + F.make_interval(mins=F.lit(10))).alias("expires_at"))
    return state.unexpired(rows, F.lit("2024-01-29").cast("timestamp")).select("event_id")


def progress_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.when(F.col("event_id") % 4 == 0, F.lit("no json")).when(F.col("event_id") % 4 == 1, F.col("props"))
    rows = _events(spark, sf_dir).select("event_id", state.parse_json(props, "k int").alias("p"))
    return rows.select("event_id", F.col("p.k").alias("k"), F.coalesce("p.k", F.lit(0)).alias("counter"), F.to_json(F.struct(F.coalesce("p.k", F.lit(0)).alias("k"))).alias("again"))


def rate_limiter_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir).select("user_id", "event_id", (F.col("event_type") == "error").alias("limited"))
    return limiter.delays(events, "user_id", "event_id", "limited")


def task_state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"click": "start", "view": "chunk_done", "purchase": "finish", "error": "fail", "signup": "cancel"}
    event = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[F.col("event_type")]
    rows = _events(spark, sf_dir).select(F.floor(F.col("event_id") / 5).alias("task"), "event_id", event.alias("event"))
    return tasks.final_states(rows, "task", ["event_id"], "event")


QUERIES = {f.__name__: f for f in (dedupe_keep_last, dedupe_removed, upsert_ledger, save_unmatched, ledger_delete, coalesce_update, latest_history, review_page, stale_tasks, running_task, unexpired_states, progress_json, rate_limiter_fold, task_state_machine)}

_LAST = "SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1"


def _ledger(where: str) -> str:
    return f"SELECT user_id::VARCHAR AS user_id, (event_id % 97)::VARCHAR AS source_id, event_type AS sync_type, max(event_id)::VARCHAR AS target_id FROM events WHERE {where} GROUP BY 1, 2, 3"


_TASKS = f"l AS ({_LAST}), t AS (SELECT event_id::VARCHAR AS id, user_id::VARCHAR AS user_id, user_id AS run_id, CASE event_type WHEN 'click' THEN 'running' WHEN 'view' THEN 'starting' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'chunk_complete' ELSE 'completed' END AS status, ts FROM l), live AS (SELECT *, status IN ('starting', 'running', 'chunk_complete') AS live FROM t)"
_HALVES = f"o AS ({_ledger('event_id % 2 = 0')}), n AS ({_ledger('event_id % 2 = 1')})"
_KEY = "(user_id, source_id, sync_type)"
ORACLES = {
    "dedupe_keep_last": f"WITH l AS ({_LAST}) SELECT user_id, event_type, event_id, value FROM l",
    "dedupe_removed": "SELECT (count(*) - count(DISTINCT (user_id, event_type)))::BIGINT AS removed FROM events",
    "upsert_ledger": f"WITH {_HALVES} SELECT user_id, source_id, sync_type, coalesce(n.target_id, o.target_id) AS target_id FROM o FULL JOIN n USING {_KEY}",
    "save_unmatched": f"WITH {_HALVES} SELECT user_id, source_id, sync_type, coalesce(n.target_id, o.target_id) AS title, CASE WHEN o.target_id IS NOT NULL THEN 'dismissed' ELSE 'pending' END AS status FROM o FULL JOIN n USING {_KEY}",
    "ledger_delete": f"WITH n AS ({_ledger('event_id % 2 = 1')}), u AS ({_ledger('event_id % 3 = 0')}) SELECT * FROM u WHERE {_KEY} NOT IN (SELECT {_KEY} FROM n)",
    "coalesce_update": "WITH b AS (SELECT event_id // 2 AS id, event_type, value FROM events WHERE event_id % 2 = 0), n AS (SELECT event_id // 2 AS id, CASE WHEN event_id % 4 = 1 THEN event_type END AS t, CASE WHEN event_id % 5 = 1 THEN value END AS v, true AS hit FROM events WHERE event_id % 6 = 1) SELECT id, coalesce(t, event_type) AS event_type, coalesce(v, value) AS value, CASE WHEN hit THEN t ELSE event_type END AS put_type, CASE WHEN hit THEN v ELSE value END AS put_value FROM b LEFT JOIN n USING (id)",
    "latest_history": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20",
    "review_page": "WITH q AS (SELECT * FROM events WHERE event_type = 'error' AND event_id % 3 != 0) SELECT event_id, user_id, (SELECT count(*) FROM q) AS total FROM q ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 100",
    "stale_tasks": f"WITH {_TASKS}, s AS (SELECT *, live AND ts < TIMESTAMP '{_AS_OF}' - INTERVAL 10 MINUTE AS stale FROM live) SELECT id, user_id, CASE WHEN stale THEN 'interrupted' ELSE status END AS status, CASE WHEN run_id % 3 = 0 THEN 'completed' WHEN bool_or(stale) OVER (PARTITION BY run_id) THEN 'interrupted' ELSE 'running' END AS run_status FROM s",
    "running_task": f"WITH {_TASKS} SELECT user_id, id, status FROM live WHERE live QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id DESC) = 1",
    "unexpired_states": "SELECT event_id FROM events WHERE ts + INTERVAL 10 MINUTE > TIMESTAMP '2024-01-29'",
    "progress_json": "WITH t AS (SELECT event_id, CASE WHEN event_id % 4 = 1 THEN (props->>'$.k')::INTEGER END AS k FROM events) SELECT event_id, k, coalesce(k, 0) AS counter, '{\"k\":' || coalesce(k, 0)::VARCHAR || '}' AS again FROM t",
    "rate_limiter_fold": "WITH RECURSIVE e AS (SELECT user_id, event_type = 'error' AS hit, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, count(*) OVER (PARTITION BY user_id) AS last FROM events), f(user_id, n, delay, streak) AS (SELECT DISTINCT user_id, 0::BIGINT, 50.0::DOUBLE, 0 FROM e UNION ALL SELECT f.user_id, e.n, CASE WHEN hit THEN least(5000.0::DOUBLE, delay * 2) WHEN streak + 1 >= 10 AND delay > 50 THEN greatest(50.0::DOUBLE, delay * 0.8::DOUBLE) ELSE delay END, CASE WHEN hit OR (streak + 1 >= 10 AND delay > 50) THEN 0 ELSE streak + 1 END FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1) SELECT f.user_id, delay, streak FROM f JOIN (SELECT DISTINCT user_id, last FROM e) x ON x.user_id = f.user_id AND f.n = x.last",
    "task_state_machine": "",
}
_MOVES = [f"('{s}', '{e}', '{t}')" for (s, e), t in tasks.TRANSITIONS.items()]
ORACLES["task_state_machine"] = (
    f"WITH RECURSIVE moves(s, e, t) AS (VALUES {', '.join(_MOVES)}), "
    "ev AS (SELECT event_id // 5 AS task, CASE event_type WHEN 'click' THEN 'start' WHEN 'view' THEN 'chunk_done' WHEN 'purchase' THEN 'finish' WHEN 'error' THEN 'fail' ELSE 'cancel' END AS e, row_number() OVER (PARTITION BY event_id // 5 ORDER BY event_id) AS n FROM events), "
    "f(task, n, state, rejected) AS (SELECT DISTINCT task, 0::BIGINT, 'pending', 0 FROM ev UNION ALL SELECT f.task, ev.n, coalesce(m.t, f.state), f.rejected + CASE WHEN m.t IS NULL THEN 1 ELSE 0 END FROM f JOIN ev ON ev.task = f.task AND ev.n = f.n + 1 LEFT JOIN moves m ON m.s = f.state AND m.e = ev.e) "
    "SELECT task, state, rejected FROM f QUALIFY row_number() OVER (PARTITION BY task ORDER BY n DESC) = 1"
)
