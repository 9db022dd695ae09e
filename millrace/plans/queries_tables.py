"""Filters, catalog, queue, access, audit and usage queries over events, orders and the tables around them.

orders stand for tasks (priority, state and age), events for an audit and usage log, customers for workspaces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import scalars as S
from millrace.functions import text as T
from millrace.functions.filters import compile_filter
from millrace.operators import tables as O
from millrace.plans.base import query
from millrace.sources.tables import export_lines, table

#: A fixed time; queries never read the clock.
NOW = "1998-09-01 00:00:00"


def _now():
    return F.to_timestamp_ntz(F.lit(NOW))


# the filter language over events.props, with a list, a flag and a nested object put beside what is there

_PAYLOAD = "json_merge_patch(coalesce(props, '{}'), CASE WHEN event_id % 3 = 0 THEN json_object('meta', json_object('lang', CASE WHEN event_id % 2 = 0 THEN 'en' ELSE 'fr' END), 'tags', json_array('a', event_type)) WHEN event_id % 3 = 1 THEN json_object('flag', event_id % 2 = 0) ELSE '{}'::JSON END)"


def _payload(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    third = F.col("event_id") % 3
    made = F.to_json(F.struct(
        k.alias("k"),
        F.when(third == 0, F.struct(F.when(F.col("event_id") % 2 == 0, "en").otherwise("fr").alias("lang"))).alias("meta"),
        F.when(third == 0, F.array(F.lit("a"), F.col("event_type"))).alias("tags"),
        F.when(third == 1, F.col("event_id") % 2 == 0).alias("flag"),
    ))
    return events.select("event_id", "event_type", F.parse_json(made).alias("payload"))


_K = "try_cast(json_extract_string(props, '$.k') AS BIGINT)"
_CASES = {
    "f_eq": ({"k": 7}, f"{_K} = 7"),
    "f_ne": ({"k": {"$ne": 7}}, f"NOT coalesce({_K} = 7, FALSE)"),
    "f_in": ({"k": {"$in": [1, 2, 3]}}, f"{_K} IN (1, 2, 3)"),
    "f_nin": ({"meta.lang": {"$nin": ["en"]}}, "NOT (event_id % 3 = 0 AND event_id % 2 = 0)"),
    "f_gt": ({"k": {"$gt": 90}}, f"{_K} > 90"),
    "f_gte": ({"k": {"$gte": 90}}, f"{_K} >= 90"),
    "f_lt": ({"k": {"$lt": 3}}, f"{_K} < 3"),
    "f_lte": ({"k": {"$lte": 3}}, f"{_K} <= 3"),
    "f_exists": ({"meta.lang": {"$exists": True}, "flag": {"$exists": False}}, "event_id % 3 = 0"),
    "f_and": ({"$and": [{"k": {"$gt": 10}}, {"tags": "a"}]}, f"{_K} > 10 AND event_id % 3 = 0"),
    "f_or": ({"$or": [{"k": 5}, {"meta": {"lang": "fr"}}]}, f"{_K} = 5 OR (event_id % 3 = 0 AND event_id % 2 = 1)"),
    "f_not": ({"$not": {"meta.lang": "en"}}, "NOT (event_id % 3 = 0 AND event_id % 2 = 0)"),
    "f_path": ({"$or": [{"meta.lang": "fr"}, {"k.deeper": 1}, {"tags.lang": "fr"}]}, "event_id % 3 = 0 AND event_id % 2 = 1"),
    "f_parse": ({"k": {"$gte": 20, "$lt": 30}, "flag": True}, f"{_K} >= 20 AND {_K} < 30 AND event_id % 3 = 1 AND event_id % 2 = 0"),
    "f_mismatch": ({"$or": [{"flag": 1}, {"k": "7"}, {"meta.lang": {"$gt": 3}}, {"$and": [{"k": {"$ne": "7"}}, {"k": 7}]}]}, f"coalesce({_K} = 7, FALSE)"),
}


def _filter_query(condition):
    def run(spark, d):
        return _payload(spark, d).filter(compile_filter(condition, F.col("payload"))).select("event_id", "event_type")

    return run


for _name, (_condition, _sql) in _CASES.items():
    query(_name, f"SELECT event_id, event_type FROM events WHERE {_sql}")(_filter_query(_condition))


@query("f_array", "SELECT event_id FROM events WHERE event_id % 3 = 0 AND event_type IN ('click', 'view', 'purchase')")
def f_array(spark, d):
    condition = {"tags": {"$in": ["click", "view", "purchase"]}}
    return _payload(spark, d).filter(compile_filter(condition, F.col("payload"))).select("event_id")


@query("f_promoted", f"SELECT event_id, user_id FROM events WHERE user_id IN (3, 5, 8) AND coalesce({_K} > 50, FALSE)")
def f_promoted(spark, d):
    events = table(spark, d, "events").withColumn("payload", F.parse_json("props"))
    condition = {"user_id": {"$in": [3, 5, 8]}, "k": {"$gt": 50}}
    return events.filter(compile_filter(condition, F.col("payload"), {"user_id": (F.col("user_id"), "number")})).select("event_id", "user_id")


@query("f_promoted_types", "SELECT event_id FROM events WHERE user_id = 3")
def f_promoted_types(spark, d):
    """Values of other types match nothing and raise nothing; $ne and $nin of them match all."""
    events = table(spark, d, "events")
    condition = {"$and": [{"user_id": {"$nin": ["3", True, 4]}}, {"user_id": {"$ne": "x"}}, {"$or": [{"user_id": {"$gt": "soon"}}, {"user_id": {"$in": ["y", 3]}}, {"ts": "soon"}, {"ts": {"$lt": 5}}]}]}
    return events.filter(compile_filter(condition, F.parse_json("props"), {"user_id": (F.col("user_id"), "number"), "ts": (F.col("ts"), "time")})).select("event_id")


@query("f_docset_time", "SELECT o_orderkey FROM orders WHERE o_custkey IN (1, 2, 4, 7, 10, 13) AND o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'")
def f_docset_time(spark, d):
    day = F.col("o_orderdate")
    return table(spark, d, "orders").filter(F.col("o_custkey").isin(1, 2, 4, 7, 10, 13) & (day >= F.to_timestamp_ntz(F.lit("1995-01-01"))) & (day < F.to_timestamp_ntz(F.lit("1997-01-01")))).select("o_orderkey")


@query("f_ilike", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RE%'")
def f_ilike(spark, d):
    return table(spark, d, "part").filter(F.col("p_name").ilike("%RE%")).select("p_partkey", "p_name")


@query("f_prefix", "SELECT event_id FROM events WHERE starts_with(event_type, 'c')")
def f_prefix(spark, d):
    return table(spark, d, "events").filter(F.col("event_type").startswith("c")).select("event_id")


@query("f_audit", "SELECT event_id, ts FROM events WHERE user_id = 3 AND event_type <> 'x' AND value >= 1.0 ")
def f_audit(spark, d):
    return O.where_given(table(spark, d, "events"), user=F.col("user_id") == 3, kind=F.col("event_type") != "x", value=F.col("value") >= 1.0, until=None).select("event_id", "ts")


@query("f_empty_acl", "SELECT count(*) FILTER (WHERE FALSE) AS none, count(*) AS everything, count(*) FILTER (WHERE c_nationkey IN (1, 2)) AS some FROM customer")
def f_empty_acl(spark, d):
    c = table(spark, d, "customer")
    return c.agg(F.count_if(O.allowed([], "c_nationkey")).alias("none"), F.count_if(O.allowed(None, "c_nationkey")).alias("everything"), F.count_if(O.allowed([1, 2], "c_nationkey")).alias("some"))


_GRANTS_SQL = "(SELECT o_orderkey AS id, o_custkey AS subject, CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate END AS revoked_at, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 400 DAY END AS expires_at, CASE o_orderkey % 3 WHEN 0 THEN ['kb:manage'] WHEN 1 THEN ['kb:query', 'doc:read'] ELSE ['doc:write'] END AS permissions FROM orders)"


def _grants(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    perms = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("kb:manage"))).when(F.col("o_orderkey") % 3 == 1, F.array(F.lit("kb:query"), F.lit("doc:read"))).otherwise(F.array(F.lit("doc:write")))
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("subject"), F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderdate")).alias("revoked_at"),
        F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate") + F.expr("INTERVAL 400 DAYS")).alias("expires_at"), perms.alias("permissions"),
    )


_LIVE = f"revoked_at IS NULL AND (expires_at IS NULL OR expires_at > TIMESTAMP '{NOW}')"


@query("f_live_grant", f"SELECT id, subject FROM {_GRANTS_SQL} WHERE {_LIVE}")
def f_live_grant(spark, d):
    return _grants(spark, d).filter(O.live_grant(_now())).select("id", "subject")


@query("agg_perm_union", f"SELECT subject, array_to_string(list_sort(list_distinct(flatten(list(permissions)))), ',') AS permissions FROM {_GRANTS_SQL} WHERE {_LIVE} GROUP BY subject")
def agg_perm_union(spark, d):
    live = _grants(spark, d).filter(O.live_grant(_now()))
    one = live.select("subject", F.explode("permissions").alias("p")).groupBy("subject").agg(F.array_sort(F.collect_set("p")).alias("p"))
    return one.select("subject", F.array_join("p", ",").alias("permissions"))


@query("set_union_perms", f"SELECT subject, count(DISTINCT p) AS n FROM (SELECT subject, unnest(permissions) AS p FROM {_GRANTS_SQL}) GROUP BY subject")
def set_union_perms(spark, d):
    return _grants(spark, d).select("subject", F.explode("permissions").alias("p")).groupBy("subject").agg(F.countDistinct("p").alias("n"))


_SCOPES = "CASE id % 2 WHEN 0 THEN ['doc:read', 'kb:query', 'platform:admin'] ELSE ['doc:write', 'kb:manage'] END"


@query("set_intersect_perms", f"SELECT id, array_to_string(list_sort(list_filter(list_intersect({_SCOPES}, permissions), lambda x: x <> 'platform:admin')), ',') AS effective FROM {_GRANTS_SQL}")
def set_intersect_perms(spark, d):
    scopes = F.when(F.col("id") % 2 == 0, F.array(F.lit("doc:read"), F.lit("kb:query"), F.lit("platform:admin"))).otherwise(F.array(F.lit("doc:write"), F.lit("kb:manage")))
    return _grants(spark, d).select("id", F.array_join(O.effective_permissions(scopes, F.col("permissions"), ["platform:admin"]), ",").alias("effective"))


@query("set_diff_invalid", f"SELECT id, array_to_string(list_sort(list_filter(permissions, lambda x: x NOT IN ('kb:manage', 'doc:read'))), ',') AS invalid FROM {_GRANTS_SQL}")
def set_diff_invalid(spark, d):
    return _grants(spark, d).select("id", F.array_join(F.array_sort(F.array_except("permissions", F.array(F.lit("kb:manage"), F.lit("doc:read")))), ",").alias("invalid"))


@query("perm_implied", f"""SELECT id, CASE id % 9 WHEN 0 THEN 'kb:manage,kb:query,kb:read,kb:write' WHEN 1 THEN 'kb:query,kb:read,kb:write' WHEN 2 THEN 'kb:query,kb:read' WHEN 3 THEN 'kb:query' WHEN 4 THEN 'pipeline:edit,pipeline:read,pipeline:run' WHEN 5 THEN 'eval:read,eval:run,pipeline:run' WHEN 6 THEN 'function:edit,function:use' WHEN 7 THEN 'model:manage,model:use' ELSE 'kb:create,platform:audit' END AS all_permissions, id % 9 = 8 AS on_platform FROM {_GRANTS_SQL}""")
def perm_implied(spark, d):
    held = [["kb:manage"], ["kb:write"], ["kb:read"], ["kb:query"], ["pipeline:edit"], ["pipeline:run", "eval:run"], ["function:edit"], ["model:manage"], ["kb:create", "platform:audit"]]
    table_ = F.array(*[F.array(*map(F.lit, h)) for h in held])
    mine = _grants(spark, d).select("id", table_[(F.col("id") % 9).cast("int")].alias("p"))
    return mine.select("id", F.array_join(S.implied(F.col("p")), ",").alias("all_permissions"), F.exists("p", S.is_platform).alias("on_platform"))


@query("kb_discovery", f"SELECT c_custkey AS subject, c_name AS name, count(*) AS grants FROM customer JOIN {_GRANTS_SQL} ON subject = c_custkey WHERE {_LIVE} GROUP BY ALL")
def kb_discovery(spark, d):
    live = _grants(spark, d).filter(O.live_grant(_now())).groupBy("subject").agg(F.count("*").alias("grants"))
    return table(spark, d, "customer").join(live, F.col("c_custkey") == F.col("subject")).select("subject", F.col("c_name").alias("name"), "grants")


@query("f_validators", "SELECT c_custkey, regexp_full_match(c_name, '[A-Za-z#0-9]+') AS name_ok, c_acctbal BETWEEN 0 AND 5000 AS balance_ok, c_mktsegment IN ('BUILDING', 'MACHINERY') AS segment_ok FROM customer")
def f_validators(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", F.col("c_name").rlike(r"^[A-Za-z#0-9]+\z").alias("name_ok"), F.col("c_acctbal").between(0, 5000).alias("balance_ok"), F.col("c_mktsegment").isin("BUILDING", "MACHINERY").alias("segment_ok"))


@query("f_softdelete", "SELECT o_orderkey FROM orders WHERE (CASE WHEN o_orderstatus = 'F' THEN o_orderdate END) IS NULL")
def f_softdelete(spark, d):
    return table(spark, d, "orders").withColumn("deleted_at", F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))).filter(F.col("deleted_at").isNull()).select("o_orderkey")


# orders as tasks

_TASKS_SQL = f"""(SELECT o_orderkey AS id, o_custkey % 50 AS workspace_id, o_orderpriority AS queue, CASE o_orderstatus WHEN 'O' THEN 'ready' WHEN 'P' THEN 'running' ELSE 'done' END AS state,
  (o_orderkey * 7) % 5 AS priority, (o_orderkey % 4)::INT AS attempt, 3 AS max_attempts, o_orderdate AS run_after, o_orderdate AS created_at, o_orderdate + INTERVAL 700 DAY AS lease_until,
  CASE o_orderkey % 3 WHEN 0 THEN 'TIMEOUT' WHEN 1 THEN 'PARSE_FAILED' ELSE 'UNKNOWN' END AS error_code FROM orders)"""


def _tasks(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50).alias("workspace_id"), F.col("o_orderpriority").alias("queue"),
        F.when(F.col("o_orderstatus") == "O", "ready").when(F.col("o_orderstatus") == "P", "running").otherwise("done").alias("state"),
        ((F.col("o_orderkey") * 7) % 5).alias("priority"), (F.col("o_orderkey") % 4).cast("int").alias("attempt"), F.lit(3).alias("max_attempts"),
        F.col("o_orderdate").alias("run_after"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderdate") + F.expr("INTERVAL 700 DAYS")).alias("lease_until"),
        F.when(F.col("o_orderkey") % 3 == 0, "TIMEOUT").when(F.col("o_orderkey") % 3 == 1, "PARSE_FAILED").otherwise("UNKNOWN").alias("error_code"),
    )


def _limits(spark, d) -> DataFrame:
    return _tasks(spark, d).select("workspace_id").distinct().select("workspace_id", (F.col("workspace_id") % 3).alias("running"), F.lit(3).alias("concurrency_limit"))


_CLAIM_SQL = f"""SELECT id, workspace_id, priority FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY priority DESC, id) AS n FROM {_TASKS_SQL}
  WHERE state = 'ready' AND run_after <= TIMESTAMP '{NOW}') WHERE n <= 3 - workspace_id % 3 ORDER BY priority DESC, id LIMIT 64"""


@query("join_fair_claim", _CLAIM_SQL)
def join_fair_claim(spark, d):
    return O.claim(_tasks(spark, d), _limits(spark, d), _now(), 64).select("id", "workspace_id", "priority")


@query("win_fair_cap", f"SELECT workspace_id, count(*) AS claimed FROM ({_CLAIM_SQL}) GROUP BY workspace_id")
def win_fair_cap(spark, d):
    return join_fair_claim(spark, d).groupBy("workspace_id").agg(F.count("*").alias("claimed"))


@query("q_claim", f"SELECT id, CASE WHEN c.id IS NULL THEN state ELSE 'running' END AS state, CASE WHEN c.id IS NULL THEN attempt ELSE attempt + 1 END AS attempt FROM {_TASKS_SQL} t LEFT JOIN ({_CLAIM_SQL}) c USING (id)".replace("SELECT id, CASE", "SELECT t.id, CASE"))
def q_claim(spark, d):
    tasks = _tasks(spark, d)
    return O.with_claimed(tasks, O.claim(tasks, _limits(spark, d), _now(), 64), _now(), 60).select("id", "state", "attempt")


_TWO_QUEUES_SQL = _CLAIM_SQL.replace("WHERE state = 'ready'", "WHERE queue IN ('1-URGENT', '5-LOW') AND state = 'ready'")


@query("q_claim_queues", f"SELECT c.id, c.workspace_id, t.queue FROM ({_TWO_QUEUES_SQL}) c JOIN {_TASKS_SQL} t ON t.id = c.id")
def q_claim_queues(spark, d):
    """Of two queues only; the others' tasks take no places."""
    return O.claim(_tasks(spark, d), _limits(spark, d), _now(), 64, queues=["1-URGENT", "5-LOW"]).select("id", "workspace_id", "queue")


@query("join_update_from", f"SELECT t.id, c.id IS NOT NULL AS changed, CASE WHEN c.id IS NULL THEN lease_until ELSE TIMESTAMP '{NOW}' + INTERVAL 60 SECOND END AS lease_until FROM {_TASKS_SQL} t LEFT JOIN ({_CLAIM_SQL}) c USING (id)")
def join_update_from(spark, d):
    """The rows of one table changed by those of another that they join to: what was claimed gets a lease."""
    tasks = _tasks(spark, d)
    after = O.with_claimed(tasks, O.claim(tasks, _limits(spark, d), _now(), 64), _now(), 60).select("id", F.col("state").alias("after"), "lease_until")
    return after.join(tasks.select("id", "state"), "id").select("id", (F.col("after") != F.col("state")).alias("changed"), "lease_until")


@query("agg_claim_counter", f"SELECT workspace_id, count(*) AS n FROM {_TASKS_SQL} WHERE state = 'running' GROUP BY workspace_id")
def agg_claim_counter(spark, d):
    return _tasks(spark, d).filter("state = 'running'").groupBy("workspace_id").agg(F.count("*").alias("n"))


@query("q_lease_reap", f"SELECT id, CASE WHEN state = 'running' AND lease_until < TIMESTAMP '{NOW}' THEN 'ready' ELSE state END AS state, CASE WHEN state = 'running' AND lease_until < TIMESTAMP '{NOW}' THEN 'LEASE_EXPIRED' ELSE error_code END AS error_code FROM {_TASKS_SQL}")
def q_lease_reap(spark, d):
    return O.reap(_tasks(spark, d), _now()).select("id", "state", "error_code")


@query("q_fail_route", f"SELECT id, CASE WHEN error_code = 'TIMEOUT' AND attempt < 3 THEN 'ready' ELSE 'failed' END AS goes FROM {_TASKS_SQL} WHERE state = 'running'")
def q_fail_route(spark, d):
    return _tasks(spark, d).filter("state = 'running'").select("id", O.fail_route(["TIMEOUT"], ["PARSE_FAILED"]).alias("goes"))


@query("q_retryable", f"SELECT id, CASE error_code WHEN 'TIMEOUT' THEN 'retryable' WHEN 'PARSE_FAILED' THEN 'terminal' ELSE 'default' END AS class FROM {_TASKS_SQL}")
def q_retryable(spark, d):
    return _tasks(spark, d).select("id", F.when(F.col("error_code") == "TIMEOUT", "retryable").when(F.col("error_code") == "PARSE_FAILED", "terminal").otherwise("default").alias("class"))


@query("q_backoff", f"SELECT id, least(pow(2, attempt), 300)::DOUBLE AS seconds FROM {_TASKS_SQL}")
def q_backoff(spark, d):
    return _tasks(spark, d).select("id", S.backoff_seconds(F.col("attempt")).alias("seconds"))


@query("q_cancel", f"SELECT id, CASE WHEN state = 'ready' AND workspace_id = 7 THEN 'cancelled' ELSE state END AS state FROM {_TASKS_SQL}")
def q_cancel(spark, d):
    return _tasks(spark, d).select("id", F.when((F.col("state") == "ready") & (F.col("workspace_id") == 7), "cancelled").otherwise(F.col("state")).alias("state"))


@query("q_prune", f"SELECT id FROM {_TASKS_SQL} WHERE NOT (state = 'done' AND created_at < TIMESTAMP '{NOW}' - INTERVAL 1000 DAY)")
def q_prune(spark, d):
    return _tasks(spark, d).filter(~((F.col("state") == "done") & (F.col("created_at") < _now() - F.expr("INTERVAL 1000 DAYS")))).select("id")


@query("q_enqueue", f"SELECT o.o_orderkey AS id, CASE WHEN t.id IS NULL THEN 'inserted' ELSE 'existing' END AS outcome FROM (SELECT * FROM orders WHERE o_orderkey % 10 = 0) o LEFT JOIN (SELECT id FROM {_TASKS_SQL} WHERE state IN ('ready', 'running')) t ON t.id = o.o_orderkey")
def q_enqueue(spark, d):
    live = _tasks(spark, d).filter(F.col("state").isin("ready", "running")).select("id", F.lit(True).alias("live"))
    new = table(spark, d, "orders").filter("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("id"))
    return new.join(live, "id", "left").select("id", F.when(F.col("live"), "existing").otherwise("inserted").alias("outcome"))


@query("q_doc_progress", f"SELECT workspace_id, min(id) FILTER (WHERE state IN ('ready', 'running')) AS first_live, min(id) FILTER (WHERE state = 'done') AS first_done, count(*) AS n FROM {_TASKS_SQL} GROUP BY workspace_id")
def q_doc_progress(spark, d):
    return _tasks(spark, d).groupBy("workspace_id").agg(F.min(F.when(F.col("state").isin("ready", "running"), F.col("id"))).alias("first_live"), F.min(F.when(F.col("state") == "done", F.col("id"))).alias("first_done"), F.count("*").alias("n"))


_QUEUES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-BULK", "7-NONE"]
_QUEUES_SQL = "(SELECT unnest([" + ", ".join(f"'{q}'" for q in _QUEUES) + "]) AS queue)"
_DEPTH_SQL = f"""SELECT queue, coalesce(depth, 0) AS depth, round(oldest, 1) AS oldest_seconds FROM {_QUEUES_SQL} LEFT JOIN (
  SELECT queue, count(*) AS depth, (epoch(TIMESTAMP '{NOW}') - epoch(min(created_at)))::DOUBLE AS oldest FROM {_TASKS_SQL} WHERE state = 'ready' AND run_after <= TIMESTAMP '{NOW}' GROUP BY queue) USING (queue)"""


def _depth(spark, d) -> DataFrame:
    tasks = _tasks(spark, d).withColumns({"run_after": F.col("run_after").cast("timestamp"), "created_at": F.col("created_at").cast("timestamp")})
    return O.depth_and_age(tasks, spark.createDataFrame([(q,) for q in _QUEUES], "queue string"), F.lit(NOW).cast("timestamp"))


@query("agg_queue_stats", _DEPTH_SQL)
def agg_queue_stats(spark, d):
    return _depth(spark, d)


@query("agg_queue_depth", f"SELECT queue, depth FROM ({_DEPTH_SQL})")
def agg_queue_depth(spark, d):
    return _depth(spark, d).select("queue", "depth")


@query("agg_oldest_age", f"SELECT queue, oldest_seconds FROM ({_DEPTH_SQL}) WHERE depth > 0")
def agg_oldest_age(spark, d):
    return _depth(spark, d).filter("depth > 0").select("queue", "oldest_seconds")


@query("sort_priority_fifo", f"SELECT id, priority FROM {_TASKS_SQL} WHERE state = 'ready' ORDER BY priority DESC, id LIMIT 40")
def sort_priority_fifo(spark, d):
    return _tasks(spark, d).filter("state = 'ready'").orderBy(F.col("priority").desc(), "id").limit(40).select("id", "priority")


# catalog

@query("agg_state_counts", "SELECT o_orderstatus AS state, count(*) AS n FROM orders GROUP BY 1")
def agg_state_counts(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("state")).agg(F.count("*").alias("n"))


@query("agg_state_total", "SELECT coalesce(o_orderstatus, '(all)') AS state, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus)")
def agg_state_total(spark, d):
    return table(spark, d, "orders").rollup("o_orderstatus").agg(F.count("*").alias("n")).select(F.coalesce("o_orderstatus", F.lit("(all)")).alias("state"), "n")


@query("agg_admins", f"SELECT count(DISTINCT subject) AS n FROM {_GRANTS_SQL} JOIN customer ON c_custkey = subject WHERE list_contains(permissions, 'kb:manage') AND revoked_at IS NULL AND (expires_at IS NULL OR expires_at > TIMESTAMP '{NOW}') AND c_acctbal > 0")
def agg_admins(spark, d):
    """Active users with a live grant that makes them administrators: the last one must not go."""
    live = _grants(spark, d).filter(F.array_contains("permissions", "kb:manage") & O.live_grant(_now())).select("subject")
    active = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("subject"))
    return active.join(live, "subject", "left_semi").agg(F.count_distinct("subject").alias("n"))


@query("agg_counter_delta", "SELECT c_custkey, greatest(0, 20 - coalesce(n, 0)) AS left_over FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def agg_counter_delta(spark, d):
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return table(spark, d, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.greatest(F.lit(0), 20 - F.coalesce("n", F.lit(0))).alias("left_over"))


@query("join_recount", "SELECT c_custkey, coalesce(n, 0) AS doc_count, round(coalesce(total, 0), 2) AS bytes_used FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def join_recount(spark, d):
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    return table(spark, d, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("doc_count"), F.round(F.coalesce("total", F.lit(0.0)), 2).alias("bytes_used"))


@query("agg_recount", "SELECT o_orderkey, count(l_orderkey) AS n, round(coalesce(sum(l_quantity), 0), 2) AS size FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def agg_recount(spark, d):
    n = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("size"))
    return table(spark, d, "orders").join(n, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("size", F.lit(0.0)), 2).alias("size"))


@query("join_reconcile", "SELECT c.k AS o_custkey, stored AS n, coalesce(n, 0) AS counted FROM (SELECT c_custkey AS k, c_custkey % 20 AS stored FROM customer) c LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c.k WHERE stored IS DISTINCT FROM coalesce(n, 0)")
def join_reconcile(spark, d):
    stored = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_custkey") % 20).alias("n"))
    return O.reconcile(stored, table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")), "o_custkey", "n")


@query("semi_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def semi_exists(spark, d):
    big = table(spark, d, "orders").filter("o_totalprice > 300000")
    return table(spark, d, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("disjunctive_exists", "SELECT n_nationkey FROM nation WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9900) OR EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000)")
def disjunctive_exists(spark, d):
    keys = table(spark, d, "customer").filter("c_acctbal > 9900").select(F.col("c_nationkey").alias("n_nationkey")).union(table(spark, d, "supplier").filter("s_acctbal > 9000").select("s_nationkey")).distinct()
    return table(spark, d, "nation").join(keys, "n_nationkey", "left_semi").select("n_nationkey")


@query("lookup_map_join", "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey")
def lookup_map_join(spark, d):
    return table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")


@query("exists_probe_n1", "SELECT r_name, count(n_nationkey) AS model_count FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def exists_probe_n1(spark, d):
    return table(spark, d, "region").join(table(spark, d, "nation"), F.col("n_regionkey") == F.col("r_regionkey"), "left").groupBy("r_name").agg(F.count("n_nationkey").alias("model_count"))


@query("join_catalog3", "SELECT r_name, n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def join_catalog3(spark, d):
    n = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name", "customers")


_PAGE_ID = "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT {n}"


@query("page_keyset_id", _PAGE_ID.format(n=50))
def page_keyset_id(spark, d):
    return O.page_after(table(spark, d, "orders").select("o_orderkey", "o_custkey"), [("o_orderkey", False)], (1000,), 49)


@query("page_has_more", f"SELECT count(*) > 50 AS has_more, least(count(*), 50) AS n FROM ({_PAGE_ID.format(n=51)})")
def page_has_more(spark, d):
    page = O.page_after(table(spark, d, "orders").select("o_orderkey"), [("o_orderkey", False)], (1000,), 50)
    return page.agg((F.count("*") > 50).alias("has_more"), F.least(F.count("*"), F.lit(50)).alias("n"))


@query("page_keyset_composite", "WITH a AS (SELECT ts, event_id FROM events ORDER BY event_id LIMIT 1) SELECT e.event_id, e.ts FROM events e, a WHERE e.ts < a.ts OR (e.ts = a.ts AND e.event_id < a.event_id) ORDER BY e.ts DESC, e.event_id DESC LIMIT 101")
def page_keyset_composite(spark, d):
    events = table(spark, d, "events").select("event_id", "ts")
    at = events.orderBy("event_id").limit(1).first()
    return O.page_after(events, [("ts", True), ("event_id", True)], (at.ts, at.event_id), 100)


@query("page_ordinal", "SELECT conv_id, turn, role FROM conversations WHERE conv_id = 3 AND turn > 0 ORDER BY turn LIMIT 101")
def page_ordinal(spark, d):
    return O.page_after(table(spark, d, "conversations").filter("conv_id = 3").select("conv_id", "turn", "role"), [("turn", False)], (0,), 100)


@query("sort_desc_time", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 30")
def sort_desc_time(spark, d):
    return table(spark, d, "orders").orderBy(F.col("o_orderdate").desc(), "o_orderkey").limit(30).select("o_orderkey", "o_orderdate")


@query("lookup_pk", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 7")
def lookup_pk(spark, d):
    return table(spark, d, "orders").filter("o_orderkey = 7").select("o_orderkey", "o_totalprice")


@query("list_optional", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_name ILIKE '%00%'")
def list_optional(spark, d):
    return O.where_given(table(spark, d, "customer"), segment=F.col("c_mktsegment") == "BUILDING", nation=None, search=F.col("c_name").ilike("%00%")).select("c_custkey", "c_name")


@query("win_latest_version", "SELECT o_custkey, o_orderkey, version FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r, count(*) OVER (PARTITION BY o_custkey) AS version FROM orders) WHERE r = 1")
def win_latest_version(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("m"), F.count("*").alias("version"))
    return o.select("o_custkey", "m.o_orderkey", "version")


@query("agg_progress", """SELECT o_custkey, round(100.0 * done / total, 1) AS percent, CASE WHEN done > 0 AND done < total THEN ((total - done) / (done / 60.0))::DOUBLE END AS eta FROM (SELECT o_custkey, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS done FROM orders GROUP BY 1)""")
def agg_progress(spark, d):
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    eta = F.when((F.col("done") > 0) & (F.col("done") < F.col("total")), (F.col("total") - F.col("done")) / (F.col("done") / 60.0))
    return n.select("o_custkey", F.round(100.0 * F.col("done") / F.col("total"), 1).alias("percent"), eta.alias("eta"))


@query("agg_reindex_estimate", "SELECT o_custkey, count(*) AS chunks, greatest(1, (count(*) // 400))::BIGINT AS minutes, round(2 * sum(o_totalprice), 1) AS peak FROM orders GROUP BY 1")
def agg_reindex_estimate(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("chunks"), F.greatest(F.lit(1), F.floor(F.count("*") / 400)).cast("long").alias("minutes"), F.round(2 * F.sum("o_totalprice"), 1).alias("peak"))


@query("readmodel_drift", "SELECT o_orderkey, coalesce(n, 0) AS points, o_orderkey % 5 AS chunks FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE coalesce(n, 0) <> o_orderkey % 5")
def readmodel_drift(spark, d):
    n = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("points"))
    both = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 5).alias("chunks")).join(n, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return both.select("o_orderkey", F.coalesce("points", F.lit(0)).alias("points"), "chunks").filter("points <> chunks")


@query("upsert_points", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 1.0 ELSE o_totalprice END AS price FROM orders UNION ALL SELECT -1, 0.0")
def upsert_points(spark, d):
    old = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"))
    new = old.filter("o_orderkey % 7 = 0").select("o_orderkey", F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("price")).union(spark.range(1).select(F.lit(-1).cast("long"), F.lit(0.0)))
    return O.upsert(old, new, ["o_orderkey"])


@query("delete_points", "SELECT o_orderkey FROM orders WHERE NOT (o_orderkey IN (1, 2, 3, 4, 5) AND o_orderstatus = 'O')")
def delete_points(spark, d):
    gone = F.col("o_orderkey").isin(1, 2, 3, 4, 5) & (F.col("o_orderstatus") == "O")
    return table(spark, d, "orders").filter(~F.coalesce(gone, F.lit(False))).select("o_orderkey")


# audit, usage, access over events

@query("export_jsonl", "SELECT '{\"event_id\":' || event_id || ',\"user_id\":' || user_id || ',\"event_type\":\"' || event_type || '\"}' AS value FROM events")
def export_jsonl(spark, d):
    return export_lines(table(spark, d, "events").select("event_id", "user_id", "event_type"), [F.col("event_id").desc()])


@query("stream_batches", "SELECT event_id // 1000 AS batch, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY 1")
def stream_batches(spark, d):
    return table(spark, d, "events").groupBy(F.floor(F.col("event_id") / 1000).alias("batch")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


_RATE = "SELECT user_id, time_bucket(INTERVAL 60 SECOND, ts) AS window_start, count(*) AS used, greatest(0, 2 - count(*)) AS remaining, count(*) > 2 AS over FROM events GROUP BY 1, 2"


@query("rate_window", _RATE)
def rate_window(spark, d):
    return O.rate_windows(table(spark, d, "events"), 2)


@query("idempotency", "SELECT user_id, event_type, day, count(*) AS replays, min(event_id) AS first_id FROM (SELECT *, date_trunc('day', ts) AS day FROM events) GROUP BY ALL HAVING count(*) > 1")
def idempotency(spark, d):
    keyed = table(spark, d, "events").withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    return keyed.groupBy("user_id", "event_type", "day").agg(F.count("*").alias("replays"), F.min("event_id").alias("first_id")).filter("replays > 1")


@query("lockout", "SELECT user_id, count(*) AS failures, CASE WHEN count(*) >= 15 THEN 3600 WHEN count(*) >= 8 THEN 300 WHEN count(*) >= 4 THEN 60 ELSE 0 END AS lock_seconds FROM events WHERE event_type = 'click' GROUP BY 1")
def lockout(spark, d):
    return O.lockout(table(spark, d, "events").filter("event_type = 'click'"), [(4, 60), (8, 300), (15, 3600)])


@query("agg_usage", "SELECT coalesce(event_type, '(all)') AS kind, coalesce(strftime(date_trunc('month', ts), '%Y-%m'), '(all)') AS month, count(*) AS units, round(sum(value), 2) AS cost FROM events GROUP BY ROLLUP (event_type, date_trunc('month', ts))")
def agg_usage(spark, d):
    e = table(spark, d, "events").withColumn("m", F.date_format("ts", "yyyy-MM"))
    return e.rollup("event_type", "m").agg(F.count("*").alias("units"), F.round(F.sum("value"), 2).alias("cost")).select(F.coalesce("event_type", F.lit("(all)")).alias("kind"), F.coalesce("m", F.lit("(all)")).alias("month"), "units", "cost")


@query("agg_quota", "SELECT user_id, count(*) AS used, CASE WHEN count(*) >= 40 THEN 'exceeded' WHEN count(*) >= 32 THEN 'warning' ELSE 'ok' END AS status FROM events GROUP BY 1")
def agg_quota(spark, d):
    n = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("used"))
    return n.withColumn("status", F.when(F.col("used") >= 40, "exceeded").when(F.col("used") >= 32, "warning").otherwise("ok"))


@query("agg_latency_pct", "SELECT event_type, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.99), 4) AS p99 FROM events GROUP BY 1")
def agg_latency_pct(spark, d):
    """Exact percentiles; equal values are counted first, so a group brings its distinct values together and not its rows."""
    p = F.percentile("value", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)), F.col("n"))
    return table(spark, d, "events").groupBy("event_type", "value").agg(F.count("*").alias("n")).groupBy("event_type").agg(p.alias("p")).select("event_type", *[F.round(F.col("p")[k], 4).alias(n) for k, n in enumerate(("p50", "p95", "p99"))])


@query("agg_histogram", "SELECT event_type, CASE WHEN value <= 1 THEN 1.0 WHEN value <= 5 THEN 5.0 WHEN value <= 20 THEN 20.0 WHEN value <= 100 THEN 100.0 END::DOUBLE AS le, count(*) AS n FROM events GROUP BY ALL")
def agg_histogram(spark, d):
    return O.histogram(table(spark, d, "events"), "value", [1, 5, 20, 100], ["event_type"])


@query("cache_hit_rate", """
WITH e AS (SELECT event_type, ts, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before FROM events)
SELECT event_type, count(*) AS lookups, count(*) FILTER (WHERE ts <= before + INTERVAL 6 HOUR) AS hits, round(count(*) FILTER (WHERE ts <= before + INTERVAL 6 HOUR)::DOUBLE / count(*), 6) AS rate FROM e GROUP BY 1
""")
def cache_hit_rate(spark, d):
    """Lookups by key (user and kind) in a cache that keeps an entry for six hours after its last use."""
    before = F.lag("ts").over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    e = table(spark, d, "events").withColumn("hit", F.coalesce(F.col("ts") <= before + F.expr("INTERVAL 6 HOURS"), F.lit(False)))
    return e.groupBy("event_type").agg(F.count("*").alias("lookups"), F.count_if("hit").alias("hits")).withColumn("rate", F.round(F.col("hits") / F.col("lookups"), 6))


@query("use_counter", "SELECT user_id, count(*) AS use_count, max(ts) AS last_used_at FROM events GROUP BY 1")
def use_counter(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("use_count"), F.max("ts").alias("last_used_at"))


@query("part_ensure", "SELECT DISTINCT date_trunc('month', ts)::DATE AS month_start, (date_trunc('month', ts) + INTERVAL 1 MONTH)::DATE AS month_end FROM events")
def part_ensure(spark, d):
    m = table(spark, d, "events").select(F.col("ts").cast("date").alias("d")).select(S.month_start(F.col("d")).alias("month_start"), S.month_start(F.col("d"), 1).alias("month_end"))
    return m.distinct()


@query("part_drop", "SELECT o_orderkey FROM orders WHERE date_trunc('month', o_orderdate) + INTERVAL 1 MONTH >= DATE '1994-06-15'")
def part_drop(spark, d):
    return table(spark, d, "orders").filter(S.month_start(F.col("o_orderdate").cast("date"), 1) >= F.to_date(F.lit("1994-06-15"))).select("o_orderkey")


@query("session_valid", f"""
SELECT o_orderkey AS session_id, CASE WHEN c_custkey IS NULL OR c_acctbal <= 0 THEN 'USER_INACTIVE' WHEN o_orderkey % 5 = 0 THEN 'REVOKED' WHEN o_orderdate + INTERVAL 1200 DAY <= TIMESTAMP '{NOW}' THEN 'EXPIRED'
  WHEN o_orderkey % 3 <> c_custkey % 3 THEN 'CREDENTIALS_CHANGED' ELSE 'ok' END AS verdict FROM orders LEFT JOIN customer ON c_custkey = o_custkey
""")
def session_valid(spark, d):
    """Orders stand for sessions: of an active user, not revoked, not expired, made under the user's present credentials."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_custkey") % 3).alias("credential_version"), "c_acctbal")
    verdict = (
        F.when(F.col("credential_version").isNull() | (F.col("c_acctbal") <= 0), "USER_INACTIVE").when(F.col("o_orderkey") % 5 == 0, "REVOKED")
        .when(F.col("o_orderdate").cast("timestamp_ntz") + F.expr("INTERVAL 1200 DAYS") <= _now(), "EXPIRED").when(F.col("o_orderkey") % 3 != F.col("credential_version"), "CREDENTIALS_CHANGED").otherwise("ok")
    )
    return o.join(c, "o_custkey", "left").select(F.col("o_orderkey").alias("session_id"), verdict.alias("verdict"))


@query("proj_audit", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at, coalesce(props, '{}') AS detail FROM events")
def proj_audit(spark, d):
    return table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("at"), F.coalesce("props", F.lit("{}")).alias("detail"))


@query("fn_slug", "SELECT p_partkey, coalesce(nullif(left(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 200), ''), 'kb') AS slug FROM part")
def fn_slug(spark, d):
    return table(spark, d, "part").select("p_partkey", T.slug(F.col("p_name")).alias("slug"))


@query("fn_fingerprint", "SELECT event_id, sha256(user_id || chr(0) || event_type) AS fingerprint FROM events")
def fn_fingerprint(spark, d):
    return table(spark, d, "events").select("event_id", T.fingerprint(F.col("user_id").cast("string"), F.col("event_type")).alias("fingerprint"))
