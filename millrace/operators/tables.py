"""Catalog, queue, access and audit operators: relational transforms of snapshots.

Spark has no row locks: a mutation is a new snapshot of the table, written by one writer, and a claim is a ranked
choice over a snapshot.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page_after(df: DataFrame, order: list[tuple[str, bool]], after: tuple | None, limit: int) -> DataFrame:
    """The rows behind a place in the order (column, descending), one more than the page so that a next page shows."""
    if after is not None:
        cases: list[Column] = []
        for k, (name, down) in enumerate(order):
            tie = [F.col(n) == F.lit(v) for (n, _), v in zip(order[:k], after)]
            cases.append(reduce(lambda a, b: a & b, [*tie, F.col(name) < F.lit(after[k]) if down else F.col(name) > F.lit(after[k])]))
        df = df.filter(reduce(lambda a, b: a | b, cases))
    return df.orderBy(*[F.col(n).desc() if down else F.col(n).asc() for n, down in order]).limit(limit + 1)


def where_given(df: DataFrame, **given: Column | None) -> DataFrame:
    """All conditions that are given."""
    return reduce(lambda d, c: d.filter(c), [c for c in given.values() if c is not None], df)


def allowed(ids: list | None, column: str) -> Column:
    """None allows all; an empty list allows none."""
    return F.lit(True) if ids is None else F.col(column).isin(ids) if ids else F.lit(False)


def live_grant(now: Column) -> Column:
    return F.col("revoked_at").isNull() & (F.col("expires_at").isNull() | (F.col("expires_at") > now))


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """Rows of new replace rows of old with the same key; the rest of both stays. Of rows of new that repeat a key the one of the greatest order stays, of those that tie the one whose JSON text is the greatest, so columns of any type (maps, VARIANT) do."""
    rest = [F.col(c) for c in old.columns if c not in key]
    whole = F.struct(*rest) if rest else F.lit(0)
    rank = F.struct(*([F.col(order)] if order else []), F.to_json(F.struct(whole.alias("row"))))
    rows = new.groupBy(*key).agg(F.max_by(whole, rank).alias("_row"))
    rows = rows.select(*key, *[F.col(f"_row.{c}") for c in old.columns if c not in key])
    return old.join(rows.select(*key), key, "left_anti").select(*old.columns).unionByName(rows)


def dedupe_new(new: DataFrame, existing: DataFrame, key: list[str], order: str) -> DataFrame:
    """new with status: accepted for the first row of a key that isn't there yet, skipped for others."""
    first = F.row_number().over(Window.partitionBy(*key).orderBy(order)) == 1
    known = existing.select(*key).distinct().withColumn("_known", F.lit(True))
    made = new.withColumn("_first", first).join(known, key, "left")
    return made.withColumn("status", F.when(F.col("_first") & F.col("_known").isNull(), "accepted").otherwise("skipped")).drop("_first", "_known")


def claim(tasks: DataFrame, limits: DataFrame, now: Column, batch: int, workspace: str = "workspace_id", task: str = "id", spread: int = 64, queues: list[str] | None = None) -> DataFrame:
    """The ready tasks to run, of the queues if they are named: highest priority, then oldest; no workspace beyond its free places.

    A workspace's rank is found in two steps (within a slice of its tasks, then over what the slices leave), so one
    workspace with most tasks doesn't meet in one task: a slice leaves no more rows than the batch.
    """
    order = [F.col("priority").desc(), F.col(task).asc()]
    if queues is not None:
        tasks = tasks.filter(allowed(queues, "queue"))
    ready = tasks.filter((F.col("state") == "ready") & (F.col("run_after") <= now)).join(limits, workspace).filter("running < concurrency_limit")
    free = F.col("concurrency_limit") - F.col("running")
    sliced = ready.withColumn("_slice", F.pmod(F.xxhash64(task), F.lit(spread)))
    some = sliced.withColumn("_n", F.row_number().over(Window.partitionBy(workspace, "_slice").orderBy(*order))).filter((F.col("_n") <= free) & (F.col("_n") <= batch))
    fair = some.withColumn("_n", F.row_number().over(Window.partitionBy(workspace).orderBy(*order))).filter(F.col("_n") <= free)
    return fair.orderBy(*order).limit(batch).drop("_n", "_slice")


def with_claimed(tasks: DataFrame, claimed: DataFrame, now: Column, lease_seconds: int, task: str = "id") -> DataFrame:
    mine = claimed.select(task, F.lit(True).alias("_mine"))
    out = tasks.join(mine, task, "left")
    hit = F.coalesce("_mine", F.lit(False))
    return out.withColumns({
        "state": F.when(hit, "running").otherwise(F.col("state")),
        "attempt": F.when(hit, F.col("attempt") + 1).otherwise(F.col("attempt")),
        "lease_until": F.when(hit, now + F.make_dt_interval(secs=F.lit(lease_seconds))).otherwise(F.col("lease_until")),
    }).drop("_mine")


def reap(tasks: DataFrame, now: Column) -> DataFrame:
    """Running tasks whose lease has passed are ready again."""
    late = F.coalesce((F.col("state") == "running") & (F.col("lease_until") < now), F.lit(False))
    return tasks.withColumns({"state": F.when(late, "ready").otherwise(F.col("state")), "error_code": F.when(late, "LEASE_EXPIRED").otherwise(F.col("error_code")), "lease_until": F.when(late, F.lit(None)).otherwise(F.col("lease_until"))})


def fail_route(retryable: list[str], terminal: list[str]) -> Column:
    """Where a failed task goes: ready again, or failed for good."""
    again = ~F.col("error_code").isin(terminal) & (F.col("error_code").isin(retryable) | F.lit(not retryable)) & (F.col("attempt") < F.col("max_attempts"))
    return F.when(F.coalesce(again, F.lit(False)), "ready").otherwise("failed")


def depth_and_age(tasks: DataFrame, queues: DataFrame, now: Column) -> DataFrame:
    """queue, depth, oldest_seconds of ready tasks; queues without any have depth 0."""
    ready = tasks.filter((F.col("state") == "ready") & (F.col("run_after") <= now)).groupBy("queue").agg(F.count("*").alias("depth"), F.min("created_at").alias("oldest"))
    age = F.round((F.unix_timestamp(now) - F.unix_timestamp("oldest")).cast("double"), 1)
    return queues.join(ready, "queue", "left").select("queue", F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), age.alias("oldest_seconds"))


def reconcile(stored: DataFrame, counted: DataFrame, key: str, column: str) -> DataFrame:
    """Keys whose stored counter isn't what is counted."""
    made = stored.join(counted.withColumnRenamed(column, "_counted"), key, "left").withColumn("counted", F.coalesce("_counted", F.lit(0)))
    return made.filter(~F.col(column).eqNullSafe(F.col("counted"))).select(key, column, "counted")


def effective_permissions(key_scopes: Column, owner_permissions: Column, platform: list[str]) -> Column:
    return F.array_sort(F.array_except(F.array_intersect(key_scopes, owner_permissions), F.array(*map(F.lit, platform)) if platform else F.expr("cast(array() as array<string>)")))


def carry_edits(new: DataFrame, edits: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """New chunks with the text of hand edits of the same key, and the edits that found no chunk."""
    e = edits.select(*key, F.col("content").alias("_edit"))
    carried = new.join(e, key, "left").withColumn("is_edited", F.col("_edit").isNotNull()).withColumn("content", F.coalesce("_edit", "content")).drop("_edit")
    return carried, edits.join(new.select(*key), key, "left_anti")


def hash_diff(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """key, change: added, removed or kept."""
    a = existing.select(*key).distinct().withColumn("_a", F.lit(1))
    b = new.select(*key).distinct().withColumn("_b", F.lit(1))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("kept")
    return a.join(b, key, "full_outer").select(*key, change.alias("change"))


def lockout(failures: DataFrame, ladder: list[tuple[int, int]], user: str = "user_id") -> DataFrame:
    """user, failures, lock_seconds: the longest lock that the number of failures has reached."""
    n = failures.groupBy(user).agg(F.count("*").alias("failures"))
    lock = F.lit(0)
    for least, seconds in sorted(ladder):
        lock = F.when(F.col("failures") >= least, seconds).otherwise(lock)
    return n.withColumn("lock_seconds", lock)


def rate_windows(requests: DataFrame, limit: int, seconds: int = 60, principal: str = "user_id", at: str = "ts") -> DataFrame:
    """Tumbling windows: principal, window_start, used, remaining, over. The same expression serves streams."""
    w = requests.groupBy(F.window(at, f"{seconds} seconds"), principal).agg(F.count("*").alias("used"))
    return w.select(principal, F.col("window.start").alias("window_start"), "used", F.greatest(F.lit(0), F.lit(limit) - F.col("used")).alias("remaining"), (F.col("used") > limit).alias("over"))


def histogram(df: DataFrame, value: str, edges: list[float], by: list[str]) -> DataFrame:
    """Counts by the least edge that a value doesn't pass; values beyond all edges have no edge."""
    edge = F.lit(None).cast("double")
    for e in sorted(edges, reverse=True):
        edge = F.when(F.col(value) <= e, float(e)).otherwise(edge)
    return df.groupBy(*by, edge.alias("le")).agg(F.count("*").alias("n"))
