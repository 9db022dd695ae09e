"""State transitions and projections: queue, documents, versions, keys, settings; orders, events and documents stand for the entities."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.plans.base import query
from millrace.plans.queries_tables import _GRANTS_SQL, _TASKS_SQL, NOW, _grants, _now, _tasks
from millrace.sources.tables import table


@query("q_finish", f"SELECT id, CASE WHEN state = 'running' AND attempt = 0 THEN 'done' ELSE state END AS state, CASE WHEN state = 'running' AND attempt = 0 THEN TIMESTAMP '{NOW}' END AS finished_at FROM {_TASKS_SQL}")
def q_finish(spark, d):
    over = (F.col("state") == "running") & (F.col("attempt") == 0)
    return _tasks(spark, d).select("id", F.when(over, "done").otherwise(F.col("state")).alias("state"), F.when(over, _now()).alias("finished_at"))


@query("q_reschedule", f"SELECT id, TIMESTAMP '{NOW}' + to_seconds(least(pow(2, attempt), 300)::INT) AS run_after FROM {_TASKS_SQL} WHERE state = 'running'")
def q_reschedule(spark, d):
    delay = F.make_dt_interval(secs=F.least(F.pow(F.lit(2.0), "attempt"), F.lit(300.0)).cast("decimal(18,6)"))
    return _tasks(spark, d).filter("state = 'running'").select("id", (_now() + delay).alias("run_after"))


@query("q_heartbeat", f"SELECT id, CASE WHEN state = 'running' THEN TIMESTAMP '{NOW}' + INTERVAL 60 SECOND ELSE lease_until END AS lease_until FROM {_TASKS_SQL}")
def q_heartbeat(spark, d):
    return _tasks(spark, d).select("id", F.when(F.col("state") == "running", _now() + F.expr("INTERVAL 60 SECONDS")).otherwise(F.col("lease_until")).alias("lease_until"))


@query("q_retry", f"SELECT id, CASE WHEN state = 'done' AND error_code = 'TIMEOUT' THEN 'ready' ELSE state END AS state, CASE WHEN state = 'done' AND error_code = 'TIMEOUT' THEN 0 ELSE attempt END AS attempt FROM {_TASKS_SQL}")
def q_retry(spark, d):
    again = (F.col("state") == "done") & (F.col("error_code") == "TIMEOUT")
    return _tasks(spark, d).select("id", F.when(again, "ready").otherwise(F.col("state")).alias("state"), F.when(again, 0).otherwise(F.col("attempt")).alias("attempt"))


@query("upsert_runtime", f"SELECT workspace_id, count(*) FILTER (WHERE state = 'running') AS running, CASE WHEN workspace_id % 2 = 0 THEN 8 ELSE 4 END AS concurrency_limit FROM {_TASKS_SQL} GROUP BY workspace_id")
def upsert_runtime(spark, d):
    tasks = _tasks(spark, d)
    stored = tasks.select("workspace_id").distinct().filter("workspace_id % 2 = 0").select("workspace_id", F.lit(8).alias("stored"))
    running = tasks.groupBy("workspace_id").agg(F.count_if(F.col("state") == "running").alias("running"))
    return running.join(stored, "workspace_id", "left").select("workspace_id", "running", F.coalesce("stored", F.lit(4)).alias("concurrency_limit"))


_VERSIONS_SQL = "(SELECT o_custkey AS kb_id, o_orderkey AS version, CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'P' THEN 'building' ELSE 'retired' END AS state, o_orderdate AS started_at FROM orders)"


def _versions(spark, d):
    state = F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "P", "building").otherwise("retired")
    return table(spark, d, "orders").select(F.col("o_custkey").alias("kb_id"), F.col("o_orderkey").alias("version"), state.alias("state"), F.col("o_orderdate").alias("started_at"))


@query("iv_activate", f"SELECT kb_id, version, CASE WHEN state = 'building' AND version = newest THEN 'active' WHEN state = 'active' AND newest IS NOT NULL THEN 'retired' ELSE state END AS state FROM (SELECT *, max(CASE WHEN state = 'building' THEN version END) OVER (PARTITION BY kb_id) AS newest FROM {_VERSIONS_SQL})")
def iv_activate(spark, d):
    v = _versions(spark, d)
    newest = v.filter("state = 'building'").groupBy("kb_id").agg(F.max("version").alias("newest"))
    state = F.when((F.col("state") == "building") & (F.col("version") == F.col("newest")), "active").when((F.col("state") == "active") & F.col("newest").isNotNull(), "retired").otherwise(F.col("state"))
    return v.join(newest, "kb_id", "left").select("kb_id", "version", state.alias("state"))


@query("iv_fail", f"SELECT kb_id, version, CASE WHEN state = 'building' THEN 'failed' ELSE state END AS state FROM {_VERSIONS_SQL}")
def iv_fail(spark, d):
    return _versions(spark, d).select("kb_id", "version", F.when(F.col("state") == "building", "failed").otherwise(F.col("state")).alias("state"))


@query("iv_expired", f"SELECT kb_id, version FROM {_VERSIONS_SQL} WHERE state = 'retired' AND started_at + INTERVAL 24 HOUR < TIMESTAMP '1996-01-01'")
def iv_expired(spark, d):
    return _versions(spark, d).filter((F.col("state") == "retired") & (F.col("started_at") + F.expr("INTERVAL 24 HOURS") < F.to_timestamp_ntz(F.lit("1996-01-01")))).select("kb_id", "version")


@query("key_auth", f"SELECT e.event_id, g.subject FROM events e JOIN (SELECT id, subject, sha256('key' || id) AS h FROM {_GRANTS_SQL} WHERE revoked_at IS NULL AND (expires_at IS NULL OR expires_at > TIMESTAMP '{NOW}')) g ON sha256('key' || e.event_id) = g.h")
def key_auth(spark, d):
    from millrace.operators.tables import live_grant

    keys = _grants(spark, d).filter(live_grant(_now())).select("subject", F.sha2(F.concat(F.lit("key"), F.col("id").cast("string")), 256).alias("h"))
    asked = table(spark, d, "events").select("event_id", F.sha2(F.concat(F.lit("key"), F.col("event_id").cast("string")), 256).alias("h"))
    return asked.join(keys, "h").select("event_id", "subject")


@query("session_expire", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR")
def session_expire(spark, d):
    e = table(spark, d, "events")
    return e.filter(F.col("ts") >= F.lit(e.agg(F.max("ts")).first()[0]).cast("timestamp_ntz") - F.expr("INTERVAL 24 HOURS")).select("event_id")


@query("retention", "SELECT event_type, count(*) AS kept FROM events WHERE ts >= (SELECT max(ts) FROM events) - (CASE event_type WHEN 'click' THEN INTERVAL 2 DAY ELSE INTERVAL 10 DAY END) GROUP BY 1")
def retention(spark, d):
    e = table(spark, d, "events")
    last = F.lit(e.agg(F.max("ts")).first()[0]).cast("timestamp_ntz")
    limit = F.when(F.col("event_type") == "click", last - F.expr("INTERVAL 2 DAYS")).otherwise(last - F.expr("INTERVAL 10 DAYS"))
    return e.filter(F.col("ts") >= limit).groupBy("event_type").agg(F.count("*").alias("kept"))


@query("obj_keys", "SELECT doc_id, 'ws/' || source || '/kb/' || lang || '/doc/' || doc_id || '/original' AS key FROM documents")
def obj_keys(spark, d):
    return table(spark, d, "documents").select("doc_id", F.concat_ws("/", F.lit("ws"), "source", F.lit("kb"), "lang", F.lit("doc"), F.col("doc_id").cast("string"), F.lit("original")).alias("key"))


@query("proj_views", "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS kind, round(c_acctbal, 2) AS balance, n_name AS nation FROM customer JOIN nation ON n_nationkey = c_nationkey")
def proj_views(spark, d):
    made = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return made.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("kind"), F.round("c_acctbal", 2).alias("balance"), F.col("n_name").alias("nation"))


@query("codec_principal", f"SELECT subject, '{{\"subject\":' || subject || ',\"permissions\":[' || string_agg('\"' || p || '\"', ',' ORDER BY p) || ']}}' AS principal FROM (SELECT DISTINCT subject, unnest(permissions) AS p FROM {_GRANTS_SQL}) GROUP BY subject")
def codec_principal(spark, d):
    one = _grants(spark, d).select("subject", F.explode("permissions").alias("p")).groupBy("subject").agg(F.sort_array(F.collect_set("p")).alias("permissions"))
    return one.select("subject", F.to_json(F.struct("subject", "permissions")).alias("principal"))


@query("win_session_gap", "SELECT user_id, count(*) FILTER (WHERE gap IS NULL OR gap > INTERVAL 30 MINUTE) AS sessions FROM (SELECT user_id, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events) GROUP BY 1")
def win_session_gap(spark, d):
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = table(spark, d, "events").withColumn("before", before)
    return e.groupBy("user_id").agg(F.count_if(F.col("before").isNull() | (F.col("ts") > F.col("before") + F.expr("INTERVAL 30 MINUTES"))).alias("sessions"))
