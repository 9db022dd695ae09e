"""Knowledge bases, their index versions, documents and grants: transitions of whole snapshots by tables of requests.

Each operator takes the table as it is and the requests, and gives the new table, the outcome of every request, or both.
Of requests for one row the first by `at` counts and the others are told so: a snapshot has one next state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import scalars as S
from millrace.functions import text as T
from millrace.sources.tables import written

# What can't be changed once a base has an active version, and what asks for a rebuild when it changes.
IMMUTABLE = ["embedding_model_id", "metric"]
REQUIRES_REINDEX = ["chunk_config"]
#: States that a document leaves by a retry alone.
TERMINAL = ["indexed", "failed", "skipped"]
#: Tasks that work out pairs of administrators and bases; up to so many rows (of two keys and a few names) are sent to all of them.
PAIR_PARTS, BROADCAST_ROWS = 96, 500_000
CONFLICT, NOT_FOUND, LOCKED = "CONFLICT", "NOT_FOUND", "EMBEDDING_MODEL_IMMUTABLE"


def first_by(requests: DataFrame, key: list[str], at: str) -> DataFrame:
    """requests with _first: whether it is the first of its key."""
    return requests.withColumn("_first", F.row_number().over(Window.partitionBy(*key).orderBy(at)) == 1)


def merged(old: Column, patch: Column, keys: list[str]) -> Column:
    """A shallow merge of two JSON objects (text) over known keys: a key of the patch wins, a null in it removes the key."""
    p, o = F.parse_json(patch), F.parse_json(old)
    entries = []
    for k in keys:
        new = F.try_variant_get(p, f"$.{k}", "variant")
        given = F.array_contains(F.json_object_keys(patch), k)
        value = F.when(given, new).otherwise(F.try_variant_get(o, f"$.{k}", "variant"))
        entries.append(F.when(value.isNotNull() & ~F.is_variant_null(value), F.struct(F.lit(k).alias("key"), F.to_json(value).alias("value"))))
    pairs = F.array_compact(F.array(*entries))
    return F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"])), ","), F.lit("}"))


def create(bases: DataFrame, requests: DataFrame, models: DataFrame, bindings: DataFrame) -> DataFrame:
    """The requests with slug, embedding_dim (the model's, never the request's) and outcome: created, or why not.

    requests: at, kb_id, workspace_id, name, slug, embedding_model_id, binding_id; models: embedding_model_id, dimension (null
    where it doesn't embed); bindings: binding_id; bases: workspace_id, slug. A slug is unique in its workspace.
    """
    asked = requests.withColumn("slug", F.coalesce("slug", T.slug(F.col("name"))))
    asked = asked.join(models.select("embedding_model_id", F.col("dimension").alias("embedding_dim")), "embedding_model_id", "left")
    asked = asked.join(bindings.select("binding_id", F.lit(True).alias("_bound")), "binding_id", "left")
    asked = asked.join(bases.select("workspace_id", "slug", F.lit(True).alias("_taken")).distinct(), ["workspace_id", "slug"], "left")
    asked = asked.withColumn("_fits", F.col("embedding_dim").isNotNull() & F.col("_bound").isNotNull() & F.col("_taken").isNull())
    order = Window.partitionBy("workspace_id", "slug", "_fits").orderBy("at")  # only a request that could be met takes the slug
    first = F.row_number().over(order) == 1
    outcome = F.when(F.col("embedding_dim").isNull(), "NO_EMBEDDING_MODEL").when(F.col("_bound").isNull(), NOT_FOUND).when(F.col("_taken").isNotNull() | ~first, CONFLICT).otherwise("created")
    return asked.withColumn("outcome", outcome).drop("_bound", "_taken", "_fits")


def update(bases: DataFrame, requests: DataFrame, fields: list[str]) -> DataFrame:
    """The bases after the requests (kb_id, at and fields, null: as it is), with changed (names, sorted), outcome and reindex_required.

    What is immutable once a version is active refuses the whole request; each request that is met raises config_version.
    """
    own = first_by(requests, ["kb_id"], "at").filter("_first").select("kb_id", *[F.col(f).alias(f"_{f}") for f in fields], F.lit(True).alias("_asked"))
    both = bases.join(own, "kb_id", "left")
    changed = F.array_sort(F.array_compact(F.array(*[F.when(F.col(f"_{f}").isNotNull(), F.lit(f)) for f in fields])))
    indexed, asked = F.col("active_index_version").isNotNull(), F.coalesce("_asked", F.lit(False))
    locked = asked & indexed & F.arrays_overlap(changed, F.array(*map(F.lit, IMMUTABLE)))
    met = asked & ~locked
    new = {f: F.when(met, F.coalesce(f"_{f}", f)).otherwise(F.col(f)) for f in fields}
    rows = both.withColumns({
        "changed": changed, "outcome": F.when(locked, LOCKED).when(asked, "updated").otherwise("unchanged"),
        "reindex_required": met & indexed & F.arrays_overlap(changed, F.array(*map(F.lit, REQUIRES_REINDEX))), "config_version": F.col("config_version") + met.cast("int"),
    })
    return rows.withColumns(new).drop("_asked", *[f"_{f}" for f in fields])


def runtime(bases: DataFrame, versions: DataFrame, bindings: DataFrame, models: DataFrame) -> DataFrame:
    """What the search side may see of each live base: its active version, never the newest; a base without one isn't published."""
    active = versions.filter("state = 'active'").groupBy("kb_id").agg(F.max("version").alias("index_version"))
    live = bases.filter("deleted_at IS NULL AND status <> 'deleting'").join(active, "kb_id")
    made = live.join(bindings.select("binding_id", "driver"), "binding_id").join(models.select("embedding_model_id", "dimension"), "embedding_model_id")
    return made.select("kb_id", "workspace_id", "index_version", F.struct("embedding_model_id", "dimension").alias("embedding_model"), "metric", F.struct("binding_id", "driver").alias("vector_binding"), "config_version", "status")


def start_builds(versions: DataFrame, requests: DataFrame) -> DataFrame:
    """New rows of the version table and refusals: kb_id, version, state building, outcome. requests: kb_id, at, confirmed.

    One build of a base at a time; without a confirmation the next version is told and nothing starts.
    """
    had = versions.groupBy("kb_id").agg(F.max("version").alias("_last"), F.bool_or(F.col("state") == "building").alias("_busy"))
    asked = requests.join(had, "kb_id", "left").withColumn("_order", F.when(F.col("confirmed"), 0).otherwise(1))
    first = F.row_number().over(Window.partitionBy("kb_id").orderBy("_order", "at")) == 1
    outcome = F.when(~F.col("confirmed"), "estimate").when(F.coalesce("_busy", F.lit(False)) | ~first, CONFLICT).otherwise("started")
    version = F.when(outcome != CONFLICT, F.coalesce("_last", F.lit(0)) + 1)
    return asked.select("kb_id", "at", version.alias("version"), F.when(outcome == "started", "building").alias("state"), outcome.alias("outcome"))


def set_versions(versions: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """versions after changes (kb_id, version, state, done, total, error; null: as it is): active and failed are completed now."""
    own = changes.select("kb_id", "version", *[F.col(c).alias(f"_{c}") for c in ("state", "done", "total", "error")])
    rows = versions.join(own, ["kb_id", "version"], "left")
    over = F.col("_state").isin("active", "failed")
    return rows.withColumns({
        "completed_at": F.when(over, now).otherwise(F.col("completed_at")), "state": F.coalesce("_state", "state"), "error": F.coalesce("_error", "error"),
        "chunk_done": F.coalesce("_done", "chunk_done"), "chunk_total": F.coalesce("_total", "chunk_total"),
    }).drop("_state", "_done", "_total", "_error")


def set_documents(docs: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """docs after changes (document_id, state, progress; null: as it is). Documents that are over stay so; indexed is 100 % with the time; progress is kept within 0 and 100."""
    rows = docs.join(changes.select("document_id", F.col("state").alias("_state"), F.col("progress").alias("_progress")), "document_id", "left")
    moves = F.col("_state").isNotNull() & ~F.col("state").isin(TERMINAL) & F.col("deleted_at").isNull()
    counts = F.col("_progress").isNotNull() & ~F.col("state").isin(TERMINAL)
    done = moves & (F.col("_state") == "indexed")
    return rows.withColumns({
        "progress": F.when(done, 100).when(counts, F.least(F.lit(100), F.greatest(F.lit(0), F.col("_progress")))).otherwise(F.col("progress")),
        "indexed_at": F.when(done, now).otherwise(F.col("indexed_at")), "state": F.when(moves, F.col("_state")).otherwise(F.col("state")),
    }).drop("_state", "_progress")


def delete_documents(docs: DataFrame, ids: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(docs, tasks): live ones of the ids are marked deleted; a purge task for each of these, named so that a second one isn't enqueued."""
    gone = docs.filter("deleted_at IS NULL").join(ids.select("document_id").distinct(), "document_id", "left_semi").select("document_id")
    marked = docs.join(gone.withColumn("_gone", F.lit(True)), "document_id", "left").withColumn("deleted_at", F.when(F.col("_gone"), now).otherwise(F.col("deleted_at"))).drop("_gone")
    return marked, gone.select("document_id", F.lit("document.purge").alias("kind"), F.concat(F.lit("document.purge:"), F.col("document_id").cast("string")).alias("dedupe_key"))


def retry_documents(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Failed live ones of the ids are registered again under their next revision, without error and progress."""
    own = docs.join(ids.select("document_id", F.lit(True).alias("_asked")).distinct(), "document_id", "left")
    again = F.coalesce("_asked", F.lit(False)) & (F.col("state") == "failed") & F.col("deleted_at").isNull()
    return own.withColumns({"state": F.when(again, "registered").otherwise(F.col("state")), "revision": F.col("revision") + again.cast("int"), "progress": F.when(again, 0).otherwise(F.col("progress"))}).drop("_asked")


def purge_rows(rows: DataFrame, gone: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(what stays, key and purged: how many rows went of each)."""
    ids = gone.select(key).distinct()
    return rows.join(ids, key, "left_anti"), rows.join(ids, key, "left_semi").groupBy(key).agg(F.count("*").alias("purged"))


def revoke(rows: DataFrame, which: Column, now: Column) -> tuple[DataFrame, DataFrame]:
    """(rows with revoked_at set where it was not, the affected rows)."""
    hit = F.coalesce(which, F.lit(False)) & F.col("revoked_at").isNull()
    return rows.withColumn("revoked_at", F.when(hit, now).otherwise(F.col("revoked_at"))), rows.filter(hit).withColumn("revoked_at", now)


def bump(counters: DataFrame, changes: DataFrame, key: str, counter: str) -> DataFrame:
    """Counters after a change each: + 1 for every row of changes with the key; keys that weren't there start at 1."""
    more = changes.groupBy(key).agg(F.count("*").alias("_more"))
    both = counters.join(more, key, "full_outer")
    return both.select(key, (F.coalesce(counter, F.lit(0)) + F.coalesce("_more", F.lit(0))).alias(counter))


def delete_bindings(bindings: DataFrame, bases: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bindings that stay, binding_id and outcome of each request): one that a live base refers to isn't deleted."""
    used = bases.filter("deleted_at IS NULL").select("binding_id", F.lit(True).alias("_used")).distinct()
    asked = ids.select("binding_id").distinct().join(bindings.select("binding_id", F.lit(True).alias("_there")), "binding_id", "left").join(used, "binding_id", "left")
    told = asked.select("binding_id", F.when(F.col("_there").isNull(), NOT_FOUND).when(F.col("_used"), CONFLICT).otherwise("deleted").alias("outcome"))
    return bindings.join(told.filter("outcome = 'deleted'"), "binding_id", "left_anti"), told


def validate_grants(requests: DataFrame, actors: DataFrame, valid: dict[str, list[str]], platform: list[str]) -> DataFrame:
    """requests (grant_id, actor, resource_type, permissions) with error: the first rule that a permission breaks, or null.

    Unknown permissions, then those that the type hasn't, then the platform's own, then those that the actor doesn't hold
    (actors: actor, held). An empty list grants nothing and is refused.
    """
    known = F.array(*map(F.lit, sorted({p for x in valid.values() for p in x} | set(platform))))
    own = F.lit(None).cast("array<string>")
    for kind, names in valid.items():
        own = F.when(F.col("resource_type") == kind, F.array(*map(F.lit, names))).otherwise(own)
    p, none = F.col("permissions"), F.expr("cast(array() as array<string>)")
    rules = [
        ("NO_PERMISSIONS", F.coalesce(F.size(p), F.lit(0)) < 1), ("UNKNOWN_PERMISSION", F.size(F.array_except(p, known)) > 0), ("PLATFORM_PERMISSION", F.arrays_overlap(p, F.array(*map(F.lit, platform))) if platform else F.lit(False)),
        ("NOT_VALID_FOR_TYPE", F.size(F.array_except(p, F.coalesce(own, none))) > 0), ("NOT_HELD", F.size(F.array_except(p, F.coalesce(F.col("held"), none))) > 0),
    ]
    error = F.lit(None).cast("string")
    for name, broken in reversed(rules):
        error = F.when(broken, name).otherwise(error)
    return requests.join(actors.select("actor", "held"), "actor", "left").withColumn("error", error).drop("held")


def transfer(bases: DataFrame, requests: DataFrame, members: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(bases with their new owners, audit rows): requests (kb_id, at, owner); only a member of the base's workspace (members: workspace_id, owner) takes it."""
    own = first_by(requests, ["kb_id"], "at").filter("_first").select("kb_id", F.col("owner").alias("_owner"))
    allowed = bases.join(own, "kb_id").join(members.select("workspace_id", F.col("owner").alias("_owner")).distinct(), ["workspace_id", "_owner"]).filter(~F.col("owner").eqNullSafe(F.col("_owner")))
    moved = allowed.select("kb_id", F.col("_owner").alias("_new"))
    after = bases.join(moved, "kb_id", "left").withColumn("owner", F.coalesce("_new", "owner")).drop("_new")
    return after, allowed.select("kb_id", F.lit("kb.transfer").alias("action"), F.col("owner").alias("before"), F.col("_owner").alias("after"), now.alias("at"))


def duplicate(bases: DataFrame, requests: DataFrame) -> DataFrame:
    """The new bases of the requests (kb_id, new_id, at): the settings of the old one, a free slug, no version, no documents."""
    copies = requests.join(bases.filter("deleted_at IS NULL"), "kb_id")
    n = F.row_number().over(Window.partitionBy("kb_id").orderBy("at"))
    tail = F.when(n > 1, F.concat(F.lit("-"), n.cast("string"))).otherwise("")
    named = copies.withColumns({"slug": F.concat("slug", F.lit("-copy"), tail), "name": F.concat("name", F.lit(" (copy"), F.when(n > 1, F.concat(F.lit(" "), n.cast("string"))).otherwise(""), F.lit(")"))})
    taken = bases.select("workspace_id", "slug", F.lit(True).alias("_taken")).distinct()
    free = named.join(taken, ["workspace_id", "slug"], "left").withColumn("slug", F.when(F.col("_taken"), F.concat("slug", F.lit("-"), F.substring(F.sha2(F.col("new_id").cast("string"), 256), 1, 8))).otherwise(F.col("slug")))
    return free.withColumns({"kb_id": F.col("new_id"), "active_index_version": F.lit(None).cast(bases.schema["active_index_version"].dataType), "config_version": F.lit(1)}).select(*bases.columns)


#: The least characters of a reason, and what such a grant holds (fixed values).
LEAST_REASON, BREAK_GLASS = 20, ["kb:read", "kb:query"]


def open_break_glass(requests: DataFrame, actors: DataFrame, now: Column, minutes: int = 60) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(grants, audit rows, request_id and outcome) of requests (request_id, actor, kb_id, reason): only administrators, with a reason worth the name, for a bounded time. actors: actor, is_admin, kind."""
    asked = requests.join(actors, "actor", "left").withColumn("reason", F.trim("reason"))
    admin = F.coalesce(F.col("is_admin") & (F.col("kind") == "user"), F.lit(False))
    outcome = F.when(~admin, "PERMISSION_DENIED").when(F.coalesce(F.length("reason"), F.lit(0)) < LEAST_REASON, "BREAK_GLASS_REASON_REQUIRED").otherwise("opened")
    told = asked.withColumn("outcome", outcome)
    expires = now + F.make_dt_interval(mins=F.lit(minutes))
    grants = told.filter("outcome = 'opened'").select(
        "request_id", F.col("actor").alias("subject"), F.col("kb_id").alias("resource"), F.array(*map(F.lit, BREAK_GLASS)).alias("permissions"), F.col("actor").alias("granted_by"), "reason", F.lit(True).alias("is_break_glass"), expires.alias("expires_at")
    )
    audit = grants.select(F.lit("break_glass.open").alias("action"), F.col("subject").alias("actor"), F.col("resource").alias("resource_id"), F.to_json(F.struct("reason", F.col("expires_at").cast("string").alias("expires_at"))).alias("detail"))
    return grants, audit, told.select("request_id", "outcome")


def admin_permissions(admins: DataFrame, bases: DataFrame, grants: DataFrame, policy: str) -> DataFrame:
    """What administrators hold on the bases of their workspace: actor, kb_id, permissions (sorted), readable.

    They manage every base. Its content is theirs to read by the policy: always; on_grant or break_glass: only by a live
    grant of their own. admins: actor, workspace_id; bases: kb_id, workspace_id; grants: subject, resource, permissions.
    """
    if policy not in ("always", "on_grant", "break_glass"):
        raise ValueError(f"no content policy {policy!r}")
    given = sorted(["kb:manage", *(["kb:query", "kb:read"] if policy == "always" else [])])
    bare = F.array(*[F.lit(p) for p in given])
    held = grants.join(_few(admins.select(F.col("actor").alias("subject")).distinct()), "subject", "left_semi").select(F.col("subject").alias("actor"), F.col("resource").alias("kb_id"), F.explode("permissions").alias("p")).groupBy("actor", "kb_id").agg(F.collect_set("p").alias("held"))
    own = _few(held.select("actor", "kb_id", F.array_sort(F.array_union(bare, F.col("held"))).alias("permissions")).withColumn("readable", F.array_contains("permissions", "kb:read")))  # worked out by grant, not by pair
    spread = bases.select("kb_id", "workspace_id").repartition(PAIR_PARTS, "kb_id")  # few bytes that become many rows
    admins, opened = _few(admins), _few(own.select("kb_id").distinct())
    some = spread.join(opened, "kb_id", "left_semi").join(admins, "workspace_id").join(own, ["actor", "kb_id"], "left")
    none = spread.join(opened, "kb_id", "left_anti").join(admins, "workspace_id")  # pairs that no grant can meet aren't looked up
    readable = F.lit("kb:read" in given)
    return none.select("actor", "kb_id", bare.alias("permissions"), readable.alias("readable")).unionByName(some.select("actor", "kb_id", F.coalesce("permissions", bare).alias("permissions"), F.coalesce("readable", readable).alias("readable")))


def _few(rows: DataFrame) -> DataFrame:
    """Written, and sent to all tasks if they are few: pairs made in a task stay there; more rows are met by a shuffle."""
    rows = written(rows, "few")
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def append_audit(rows: DataFrame, path: str, at: str = "at") -> None:
    """Appends audit rows (before, after and detail as JSON text) below a folder for each month, with the values of secret keys hidden in before and after."""
    clean = rows.withColumns({c: S.redacted(F.col(c)) for c in ("before", "after")}).withColumn("month", F.date_format(at, "yyyy-MM"))
    clean.withColumn("detail", F.coalesce("detail", F.lit("{}"))).hint("rebalance", F.col("month")).write.mode("append").partitionBy("month").parquet(path)


def set_progress(tasks: DataFrame, reports: DataFrame) -> DataFrame:
    """tasks (id, progress_done, progress_total) after reports (id, at, done, total; a null total: as it is), the latest of each, with percent kept within 0 and 100."""
    last = reports.groupBy("id").agg(F.max_by(F.struct("done", "total"), "at").alias("_r"))
    rows = tasks.join(last, "id", "left").withColumns({"progress_done": F.coalesce("_r.done", "progress_done"), "progress_total": F.coalesce("_r.total", "progress_total")}).drop("_r")
    share = F.floor(100 * F.col("progress_done") / F.col("progress_total"))
    return rows.withColumn("percent", F.when(F.col("progress_total") > 0, F.least(F.lit(100), F.greatest(F.lit(0), share))).cast("int"))
