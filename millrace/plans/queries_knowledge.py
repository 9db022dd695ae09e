"""Knowledge bases, versions, documents and grants as whole snapshots that requests change; customers, orders, suppliers and documents stand for the entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import knowledge as K
from millrace.plans.base import query
from millrace.plans.queries_tables import NOW, _now
from millrace.sources.tables import shared_folder, table

_BASES_SQL = f"""(SELECT c_custkey AS kb_id, c_nationkey AS workspace_id, c_name AS name, 'base-' || c_custkey % 40 AS slug, c_custkey % 4 AS embedding_model_id, 'cosine' AS metric, c_nationkey % 5 AS binding_id,
  '{{"size":512}}' AS chunk_config, 1 AS config_version, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 7 + 1 END AS active_index_version, c_custkey % 20 AS owner,
  CASE WHEN c_custkey % 10 = 0 THEN 'deleting' ELSE 'active' END AS status, CASE WHEN c_custkey % 10 = 0 THEN TIMESTAMP '{NOW}' END AS deleted_at FROM customer)"""


def _bases(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    gone = k % 10 == 0
    return table(spark, d, "customer").select(
        k.alias("kb_id"), F.col("c_nationkey").alias("workspace_id"), F.col("c_name").alias("name"), F.concat(F.lit("base-"), (k % 40).cast("string")).alias("slug"), (k % 4).alias("embedding_model_id"),
        F.lit("cosine").alias("metric"), (F.col("c_nationkey") % 5).alias("binding_id"), F.lit('{"size":512}').alias("chunk_config"), F.lit(1).alias("config_version"),
        F.when(k % 3 != 0, k % 7 + 1).alias("active_index_version"), (k % 20).alias("owner"), F.when(gone, "deleting").otherwise("active").alias("status"), F.when(gone, _now()).alias("deleted_at"),
    )


def _small(spark, d, name: str, n: int, **columns) -> DataFrame:
    """The first n numbers that the nations' keys hold, with columns of them."""
    return table(spark, d, "nation").filter(F.col("n_nationkey") < n).select(F.col("n_nationkey").cast("long").alias(name), *[c.alias(a) for a, c in columns.items()])


def _models(spark, d) -> DataFrame:
    """Four models embed, the fifth doesn't."""
    return _small(spark, d, "embedding_model_id", 5, dimension=F.when(F.col("n_nationkey") < 4, F.col("n_nationkey") * 128 + 128))


def _bindings(spark, d) -> DataFrame:
    return _small(spark, d, "binding_id", 5, driver=F.concat(F.lit("driver-"), F.col("n_nationkey").cast("string")))


@query("kb_create", f"""
WITH r AS (SELECT o_orderkey AS "at", o_custkey % 25 AS workspace_id, 'Base  ' || o_orderkey % 90 || '!' AS name, o_orderkey % 5 AS m, o_custkey % 6 AS b FROM orders),
s AS (SELECT *, 'base-' || "at" % 90 AS slug, m < 4 AND b < 5 AND NOT EXISTS (SELECT 1 FROM {_BASES_SQL} k WHERE k.workspace_id = r.workspace_id AND k.slug = 'base-' || "at" % 90) AS fits FROM r)
SELECT "at", slug, CASE WHEN m < 4 THEN m * 128 + 128 END AS embedding_dim, CASE WHEN m = 4 THEN 'NO_EMBEDDING_MODEL' WHEN b = 5 THEN 'NOT_FOUND'
  WHEN NOT fits OR row_number() OVER (PARTITION BY workspace_id, slug, fits ORDER BY "at") > 1 THEN 'CONFLICT' ELSE 'created' END AS outcome FROM s
""")
def kb_create(spark, d):
    """Requests for bases: the slug from the name and free in the workspace, the dimension from the model, the binding there."""
    k = F.col("o_orderkey")
    asked = table(spark, d, "orders").select(
        k.alias("at"), k.alias("kb_id"), (F.col("o_custkey") % 25).alias("workspace_id"), F.concat(F.lit("Base  "), (k % 90).cast("string"), F.lit("!")).alias("name"), F.lit(None).cast("string").alias("slug"),
        (k % 5).alias("embedding_model_id"), (F.col("o_custkey") % 6).alias("binding_id"),
    )
    return K.create(_bases(spark, d), asked, _models(spark, d), _bindings(spark, d)).select("at", "slug", F.col("embedding_dim").cast("long").alias("embedding_dim"), "outcome")


_UPDATES_SQL = """(SELECT * FROM (SELECT o_custkey AS kb_id, o_orderkey AS at, CASE WHEN o_orderkey % 2 = 0 THEN 'named ' || o_orderkey END AS name, CASE WHEN o_orderkey % 5 = 0 THEN 'dot' END AS metric,
  CASE WHEN o_orderkey % 3 = 0 THEN '{"size":' || o_orderkey % 9 || '}' END AS chunk_config, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n = 1)"""


def _updated(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    asked = table(spark, d, "orders").select(
        F.col("o_custkey").alias("kb_id"), k.alias("at"), F.when(k % 2 == 0, F.concat(F.lit("named "), k.cast("string"))).alias("name"), F.when(k % 5 == 0, "dot").alias("metric"),
        F.when(k % 3 == 0, F.concat(F.lit('{"size":'), (k % 9).cast("string"), F.lit("}"))).alias("chunk_config"),
    )
    return K.update(_bases(spark, d), asked, ["name", "metric", "chunk_config"])


@query("kb_update", f"""
SELECT b.kb_id, CASE WHEN met THEN coalesce(u.name, b.name) ELSE b.name END AS name, CASE WHEN met THEN coalesce(u.metric, b.metric) ELSE b.metric END AS metric, CASE WHEN met THEN coalesce(u.chunk_config, b.chunk_config) ELSE b.chunk_config END AS chunk_config,
  1 + met::INT AS config_version, met AND b.active_index_version IS NOT NULL AND u.chunk_config IS NOT NULL AS reindex_required
FROM {_BASES_SQL} b LEFT JOIN {_UPDATES_SQL} u USING (kb_id), LATERAL (SELECT u.at IS NOT NULL AND (u.metric IS NULL OR b.active_index_version IS NULL) AS met)
""")
def kb_update(spark, d):
    """Partial updates; a new chunk configuration of an indexed base asks for a rebuild."""
    return _updated(spark, d).select("kb_id", "name", "metric", "chunk_config", "config_version", "reindex_required")


@query("kb_immutable", f"SELECT b.kb_id, CASE WHEN u.at IS NULL THEN 'unchanged' WHEN u.metric IS NOT NULL AND b.active_index_version IS NOT NULL THEN 'EMBEDDING_MODEL_IMMUTABLE' ELSE 'updated' END AS outcome FROM {_BASES_SQL} b LEFT JOIN {_UPDATES_SQL} u USING (kb_id)")
def kb_immutable(spark, d):
    """The metric of an indexed base can't be changed: such a request is refused as a whole."""
    return _updated(spark, d).select("kb_id", "outcome")


_VERSIONS_SQL = f"""(SELECT o_custkey AS kb_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS version, CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'P' THEN 'building' ELSE 'retired' END AS state,
  CASE WHEN o_orderstatus = 'O' THEN o_orderdate END AS completed_at, NULL::VARCHAR AS error, 0::BIGINT AS chunk_done, NULL::BIGINT AS chunk_total FROM orders)"""


def _versions(spark, d) -> DataFrame:
    from pyspark.sql import Window

    status = F.col("o_orderstatus")
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("kb_id"), n.alias("version"), F.when(status == "O", "active").when(status == "P", "building").otherwise("retired").alias("state"),
        F.when(status == "O", F.col("o_orderdate").cast("timestamp_ntz")).alias("completed_at"), F.lit(None).cast("string").alias("error"), F.lit(0).cast("long").alias("chunk_done"), F.lit(None).cast("long").alias("chunk_total"),
    )


@query("proj_runtime", f"""
SELECT b.kb_id, b.workspace_id, max(v.version) AS index_version, b.embedding_model_id * 128 + 128 AS dimension, 'driver-' || b.binding_id AS driver, b.status
FROM {_BASES_SQL} b JOIN {_VERSIONS_SQL} v ON v.kb_id = b.kb_id AND v.state = 'active' WHERE b.deleted_at IS NULL AND b.status <> 'deleting' GROUP BY ALL
""")
def proj_runtime(spark, d):
    """What the search side sees of each live base."""
    made = K.runtime(_bases(spark, d), _versions(spark, d), _bindings(spark, d), _models(spark, d))
    return made.select("kb_id", "workspace_id", "index_version", F.col("embedding_model.dimension").cast("long").alias("dimension"), "vector_binding.driver", "status")


@query("kb_runtime", f"SELECT b.kb_id, max(v.version) AS active_version FROM {_BASES_SQL} b LEFT JOIN {_VERSIONS_SQL} v ON v.kb_id = b.kb_id AND v.state = 'active' WHERE b.deleted_at IS NULL GROUP BY 1 HAVING max(v.version) IS NOT NULL")
def kb_runtime(spark, d):
    """Only bases with an active version are served; a newer one that is built isn't."""
    return K.runtime(_bases(spark, d), _versions(spark, d), _bindings(spark, d), _models(spark, d)).select("kb_id", F.col("index_version").alias("active_version"))


@query("iv_start", f"""
WITH h AS (SELECT kb_id, max(version) AS last, bool_or(state = 'building') AS busy FROM {_VERSIONS_SQL} GROUP BY 1),
r AS (SELECT c_custkey AS kb_id, k AS "at", (c_custkey + k) % 3 <> 0 AS confirmed FROM customer, (SELECT unnest([1, 2]) AS k))
SELECT kb_id, "at", CASE WHEN outcome <> 'CONFLICT' THEN coalesce(last, 0) + 1 END AS version, CASE WHEN outcome = 'started' THEN 'building' END AS state, outcome
FROM (SELECT *, CASE WHEN NOT confirmed THEN 'estimate' WHEN coalesce(busy, FALSE) OR row_number() OVER (PARTITION BY kb_id ORDER BY NOT confirmed, "at") > 1 THEN 'CONFLICT' ELSE 'started' END AS outcome FROM r LEFT JOIN h USING (kb_id))
""")
def iv_start(spark, d):
    """Two requests for each base, of which some only ask what a build would be: one build at a time."""
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("kb_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("at"))
    return K.start_builds(_versions(spark, d), asked.withColumn("confirmed", (F.col("kb_id") + F.col("at")) % 3 != 0))


@query("iv_progress", f"""
SELECT kb_id, version, CASE WHEN version % 4 = 1 THEN 'active' WHEN version % 4 = 2 THEN 'failed' ELSE state END AS state, CASE WHEN version % 4 = 2 THEN 'NO_PROVIDER' END AS error,
  CASE WHEN version % 4 IN (1, 2) THEN TIMESTAMP '{NOW}' ELSE completed_at END AS completed_at, version * 10 AS chunk_done, CASE WHEN version % 2 = 0 THEN 100 END::BIGINT AS chunk_total
FROM {_VERSIONS_SQL}
""")
def iv_progress(spark, d):
    """States and counts of versions; what isn't given stays as it is."""
    v = _versions(spark, d)
    n = F.col("version")
    changes = v.select(
        "kb_id", "version", F.when(n % 4 == 1, "active").when(n % 4 == 2, "failed").alias("state"), (n * 10).alias("done"), F.when(n % 2 == 0, F.lit(100).cast("long")).alias("total"), F.when(n % 4 == 2, "NO_PROVIDER").alias("error")
    )
    return K.set_versions(v, changes, _now()).select("kb_id", "version", "state", "error", "completed_at", "chunk_done", "chunk_total")


_DOCS_SQL = f"""(SELECT doc_id AS document_id, CASE doc_id % 5 WHEN 0 THEN 'indexed' WHEN 1 THEN 'failed' WHEN 2 THEN 'parsed' WHEN 3 THEN 'embedding' ELSE 'registered' END AS state, 40 AS progress, 1 AS revision,
  NULL::TIMESTAMP AS indexed_at, CASE WHEN doc_id % 13 = 0 THEN TIMESTAMP '{NOW}' END AS deleted_at FROM documents)"""


def _documents(spark, d) -> DataFrame:
    k = F.col("doc_id")
    state = F.element_at(F.array(*map(F.lit, ["indexed", "failed", "parsed", "embedding", "registered"])), (k % 5 + 1).cast("int"))
    return table(spark, d, "documents").select(
        k.alias("document_id"), state.alias("state"), F.lit(40).alias("progress"), F.lit(1).alias("revision"), F.lit(None).cast("timestamp_ntz").alias("indexed_at"), F.when(k % 13 == 0, _now()).alias("deleted_at")
    )


@query("doc_state", f"""
SELECT document_id, CASE WHEN moves AND s IS NOT NULL THEN s ELSE state END AS state, CASE WHEN moves AND s = 'indexed' THEN 100 WHEN state NOT IN ('indexed', 'failed', 'skipped') AND p IS NOT NULL THEN least(100, greatest(0, p)) ELSE progress END::INT AS progress,
  CASE WHEN moves AND s = 'indexed' THEN TIMESTAMP '{NOW}' END AS indexed_at
FROM (SELECT d.*, s, p, state NOT IN ('indexed', 'failed', 'skipped') AND deleted_at IS NULL AS moves FROM {_DOCS_SQL} d LEFT JOIN (
  SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'indexed' WHEN doc_id % 3 = 1 THEN 'failed' END AS s, CASE WHEN doc_id % 7 > 0 THEN (doc_id % 7) * 40 - 60 END AS p FROM documents WHERE doc_id % 4 <> 0) c ON c.doc_id = d.document_id)
""")
def doc_state(spark, d):
    """Reports of workers: documents that are over take none; indexed is 100 %."""
    k = F.col("document_id")
    docs = _documents(spark, d)
    changes = docs.filter(k % 4 != 0).select(k, F.when(k % 3 == 0, "indexed").when(k % 3 == 1, "failed").alias("state"), F.when(k % 7 > 0, (k % 7) * 40 - 60).cast("int").alias("progress"))
    return K.set_documents(docs, changes, _now()).select("document_id", "state", "progress", "indexed_at")


@query("doc_delete", f"""
SELECT document_id, deleted_at IS NOT NULL OR document_id % 6 = 0 AS deleted, CASE WHEN deleted_at IS NULL AND document_id % 6 = 0 THEN 'document.purge:' || document_id END AS task FROM {_DOCS_SQL}
""")
def doc_delete(spark, d):
    """Documents are marked, each with one purge task; those that are marked already get none, however often it is asked."""
    docs = _documents(spark, d)
    asked = docs.filter("document_id % 6 = 0").select("document_id")
    marked, tasks = K.delete_documents(docs, asked.union(asked), _now())
    return marked.join(tasks, "document_id", "left").select("document_id", F.col("deleted_at").isNotNull().alias("deleted"), F.col("dedupe_key").alias("task"))


@query("doc_retry", f"""
SELECT document_id, CASE WHEN again THEN 'registered' ELSE state END AS state, 1 + again::INT AS revision, CASE WHEN again THEN 0 ELSE progress END AS progress
FROM (SELECT *, state = 'failed' AND deleted_at IS NULL AND document_id % 2 = 1 AS again FROM {_DOCS_SQL})
""")
def doc_retry(spark, d):
    docs = _documents(spark, d)
    return K.retry_documents(docs, docs.filter("document_id % 2 = 1")).select("document_id", "state", "revision", "progress")


@query("chunk_purge", "SELECT conv_id, count(*) FILTER (WHERE conv_id % 3 <> 0) AS kept, count(*) FILTER (WHERE conv_id % 3 = 0) AS purged FROM conversations GROUP BY 1")
def chunk_purge(spark, d):
    """Turns stand for chunks: those of some conversations go, and how many is told."""
    turns = table(spark, d, "conversations")
    kept, purged = K.purge_rows(turns, turns.filter("conv_id % 3 = 0"), "conv_id")
    both = kept.groupBy("conv_id").agg(F.count("*").alias("kept")).join(purged, "conv_id", "full_outer")
    return both.select("conv_id", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("purged", F.lit(0)).alias("purged"))


@query("version_bump", "SELECT c_custkey AS user_id, c_custkey % 5 + coalesce(n, 0) AS perm_version FROM customer LEFT JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1) ON user_id = c_custkey UNION ALL SELECT user_id, count(*) FROM events WHERE event_type = 'purchase' AND user_id NOT IN (SELECT c_custkey FROM customer) GROUP BY 1")
def version_bump(spark, d):
    """Stored counters, one more for each change; who had none starts."""
    counters = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 5).alias("perm_version"))
    return K.bump(counters, table(spark, d, "events").filter("event_type = 'purchase'"), "user_id", "perm_version")


_GRANTS_SQL = "(SELECT o_orderkey AS id, o_custkey AS subject, CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate END AS revoked_at FROM orders)"


@query("revoke", f"SELECT id, CASE WHEN revoked_at IS NULL AND subject % 10 = 0 THEN TIMESTAMP '{NOW}' ELSE revoked_at END AS revoked_at, revoked_at IS NULL AND subject % 10 = 0 AS affected FROM {_GRANTS_SQL}")
def revoke(spark, d):
    """All grants of some subjects; a grant that was revoked before keeps its time."""
    o = table(spark, d, "orders")
    grants = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("subject"), F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderdate").cast("timestamp_ntz")).alias("revoked_at"))
    after, hit = K.revoke(grants, F.col("subject") % 10 == 0, _now())
    return after.join(hit.select("id", F.lit(True).alias("hit")), "id", "left").select("id", "revoked_at", F.coalesce("hit", F.lit(False)).alias("affected"))


@query("binding_guard", f"""
SELECT s.k AS binding_id, CASE WHEN s.k > 24 THEN 'NOT_FOUND' WHEN EXISTS (SELECT 1 FROM {_BASES_SQL} b WHERE b.workspace_id = s.k AND b.deleted_at IS NULL AND b.kb_id % 9 = 0) THEN 'CONFLICT' ELSE 'deleted' END AS outcome
FROM (SELECT DISTINCT s_suppkey % 30 AS k FROM supplier) s
""")
def binding_guard(spark, d):
    """Bindings that a live base refers to aren't deleted."""
    bases = _bases(spark, d).filter("kb_id % 9 = 0").withColumn("binding_id", F.col("workspace_id"))
    bindings = table(spark, d, "nation").select(F.col("n_nationkey").alias("binding_id"))
    return K.delete_bindings(bindings, bases, table(spark, d, "supplier").select((F.col("s_suppkey") % 30).alias("binding_id")))[1]


_VALID = {"knowledge_base": ["kb:manage", "kb:query", "kb:read", "kb:write"], "document": ["doc:read", "doc:write"]}


@query("grant_validate", """
WITH r AS (SELECT o_orderkey AS grant_id, o_custkey AS actor, CASE WHEN o_orderkey % 2 = 0 THEN 'knowledge_base' ELSE 'document' END AS kind,
  CASE o_orderkey % 6 WHEN 0 THEN ['kb:read', 'kb:query'] WHEN 1 THEN ['doc:read'] WHEN 2 THEN ['doc:write'] WHEN 3 THEN ['platform:admin'] WHEN 4 THEN ['kb:fly'] ELSE []::VARCHAR[] END AS p FROM orders),
h AS (SELECT c_custkey AS actor, CASE WHEN c_custkey % 3 = 0 THEN ['kb:read'] ELSE ['kb:read', 'kb:query', 'doc:read', 'doc:write'] END AS held FROM customer)
SELECT grant_id, CASE WHEN len(p) = 0 THEN 'NO_PERMISSIONS' WHEN p[1] = 'kb:fly' THEN 'UNKNOWN_PERMISSION' WHEN p[1] = 'platform:admin' THEN 'PLATFORM_PERMISSION'
  WHEN kind = 'knowledge_base' AND p[1] LIKE 'doc:%' OR kind = 'document' AND p[1] LIKE 'kb:%' THEN 'NOT_VALID_FOR_TYPE' WHEN NOT list_has_all(coalesce(held, []::VARCHAR[]), p) THEN 'NOT_HELD' END AS error
FROM r LEFT JOIN h USING (actor)
""")
def grant_validate(spark, d):
    k = F.col("o_orderkey")
    lists = [["kb:read", "kb:query"], ["doc:read"], ["doc:write"], ["platform:admin"], ["kb:fly"]]
    given = F.expr("cast(array() as array<string>)")
    for i, names in enumerate(lists):
        given = F.when(k % 6 == i, F.array(*map(F.lit, names))).otherwise(given)
    asked = table(spark, d, "orders").select(k.alias("grant_id"), F.col("o_custkey").alias("actor"), F.when(k % 2 == 0, "knowledge_base").otherwise("document").alias("resource_type"), given.alias("permissions"))
    held = F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("kb:read"))).otherwise(F.array(*map(F.lit, ["kb:read", "kb:query", "doc:read", "doc:write"])))
    return K.validate_grants(asked, table(spark, d, "customer").select(F.col("c_custkey").alias("actor"), held.alias("held")), _VALID, ["platform:admin"]).select("grant_id", "error")


@query("kb_transfer", f"""
WITH r AS (SELECT * FROM (SELECT o_custkey AS kb_id, o_orderkey % 20 AS o, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n = 1),
b AS (SELECT b.*, r.o, EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey = b.workspace_id AND c.c_custkey % 20 = r.o) AND r.o <> b.owner AS moves FROM {_BASES_SQL} b LEFT JOIN r USING (kb_id))
SELECT kb_id, CASE WHEN moves THEN o ELSE owner END AS owner, CASE WHEN moves THEN owner END AS before FROM b
""")
def kb_transfer(spark, d):
    """Bases go to members of their workspace, each with an audit row."""
    asked = table(spark, d, "orders").select(F.col("o_custkey").alias("kb_id"), F.col("o_orderkey").alias("at"), (F.col("o_orderkey") % 20).alias("owner"))
    members = table(spark, d, "customer").select(F.col("c_nationkey").alias("workspace_id"), (F.col("c_custkey") % 20).alias("owner"))
    after, audit = K.transfer(_bases(spark, d), asked, members, _now())
    return after.join(audit.select("kb_id", "before"), "kb_id", "left").select("kb_id", "owner", "before")


@query("kb_duplicate", f"""
WITH c AS (SELECT b.*, k, c_custkey FROM (SELECT c_custkey, unnest([1, 2]) AS k FROM customer WHERE c_custkey % 4 = 0) JOIN {_BASES_SQL} b ON b.kb_id = c_custkey AND b.deleted_at IS NULL)
SELECT kb_id * 1000 + k AS kb_id, workspace_id, name || ' (copy' || CASE WHEN k > 1 THEN ' 2' ELSE '' END || ')' AS name, slug || '-copy' || CASE WHEN k > 1 THEN '-2' ELSE '' END AS slug, chunk_config, 1 AS config_version, NULL::BIGINT AS active_index_version FROM c
""")
def kb_duplicate(spark, d):
    """Each of some bases is copied twice: its settings, no version and no documents."""
    asked = table(spark, d, "customer").filter("c_custkey % 4 = 0").select(F.col("c_custkey").alias("kb_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("at"))
    made = K.duplicate(_bases(spark, d), asked.withColumn("new_id", F.col("kb_id") * 1000 + F.col("at")))
    return made.select("kb_id", "workspace_id", "name", "slug", "chunk_config", "config_version", "active_index_version")


@query("settings_patch", """
WITH s AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'null' WHEN props IS NULL THEN NULL ELSE json_extract(props, '$.k')::VARCHAR END AS k, CASE WHEN event_id % 3 = 0 THEN 'true' END AS dark FROM events)
SELECT event_id, CASE WHEN k = 'null' THEN NULL WHEN k IS NULL THEN 10 ELSE k::BIGINT END AS k, coalesce(dark, 'false') = 'true' AS dark, k IS NOT NULL AS restart FROM s
""")
def settings_patch(spark, d):
    """A shallow merge of each patch into the stored settings; a null takes the key away; what asks for a restart is told."""
    k, dark = F.when(F.col("event_id") % 4 == 0, "null").otherwise(F.get_json_object("props", "$.k")), F.col("event_id") % 3 == 0
    entries = F.array_compact(F.array(F.when(k.isNotNull(), F.concat(F.lit('"k":'), k)), F.when(dark, '"dark":true')))
    patch = F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}"))
    rows = table(spark, d, "events").select("event_id", patch.alias("patch"))
    new = F.parse_json(K.merged(F.lit('{"k":10,"dark":false}'), F.col("patch"), ["k", "dark"]))
    return rows.select("event_id", F.try_variant_get(new, "$.k", "long").alias("k"), F.try_variant_get(new, "$.dark", "boolean").alias("dark"), F.array_contains(F.json_object_keys("patch"), "k").alias("restart"))


@query("break_glass", f"""
WITH r AS (SELECT o_orderkey AS request_id, o_custkey AS actor, trim(CASE WHEN o_orderkey % 4 = 0 THEN '  too short  ' ELSE 'incident ' || o_orderkey || ' needs a look' END) AS reason FROM orders)
SELECT request_id, CASE WHEN c_custkey IS NULL OR c_custkey % 5 <> 0 OR c_custkey % 3 = 0 THEN 'PERMISSION_DENIED' WHEN length(reason) < 20 THEN 'BREAK_GLASS_REASON_REQUIRED' ELSE 'opened' END AS outcome,
  CASE WHEN c_custkey % 5 = 0 AND c_custkey % 3 <> 0 AND length(reason) >= 20 THEN TIMESTAMP '{NOW}' + INTERVAL 60 MINUTE END AS expires_at
FROM r LEFT JOIN customer ON c_custkey = actor
""")
def break_glass(spark, d):
    """Administrators open bases for an hour, with a reason; each opening is a grant and an audit row."""
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    reason = F.when(k % 4 == 0, "  too short  ").otherwise(F.concat(F.lit("incident "), k.cast("string"), F.lit(" needs a look")))
    asked = table(spark, d, "orders").select(k.alias("request_id"), F.col("o_custkey").alias("actor"), (k % 7).alias("kb_id"), reason.alias("reason"))
    actors = table(spark, d, "customer").select(c.alias("actor"), (c % 5 == 0).alias("is_admin"), F.when(c % 3 == 0, "key").otherwise("user").alias("kind"))
    grants, _, told = K.open_break_glass(asked, actors, _now())
    return told.join(grants.select("request_id", "expires_at"), "request_id", "left")


@query("content_policy", f"""
WITH a AS (SELECT c_custkey AS actor, c_nationkey AS workspace_id FROM customer WHERE c_custkey % 50 = 0), g AS (SELECT DISTINCT o_custkey AS actor, o_orderkey % 200 AS kb_id FROM orders WHERE o_orderkey % 3 = 0)
SELECT a.actor, b.kb_id, CASE WHEN g.actor IS NULL THEN ['kb:manage'] ELSE ['kb:manage', 'kb:query', 'kb:read'] END AS permissions, g.actor IS NOT NULL AS readable
FROM a JOIN {_BASES_SQL} b USING (workspace_id) LEFT JOIN g ON g.actor = a.actor AND g.kb_id = b.kb_id
""")
def content_policy(spark, d):
    """Administrators manage all bases of their workspace and read those that a grant opens to them."""
    admins = table(spark, d, "customer").filter("c_custkey % 50 = 0").select(F.col("c_custkey").alias("actor"), F.col("c_nationkey").alias("workspace_id"))
    grants = table(spark, d, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("subject"), (F.col("o_orderkey") % 200).alias("resource"), F.array(F.lit("kb:read"), F.lit("kb:query")).alias("permissions"))
    return K.admin_permissions(admins, _bases(spark, d), grants, "break_glass")


@query("audit_append", """
SELECT strftime(ts, '%Y-%m') AS month, event_id, '{"token":"[redacted]","k":' || event_id % 7 || '}' AS before, '{"list":[{"api-key":"[redacted]"}],"name":"n' || event_id % 5 || '"}' AS after, coalesce(props, '{}') AS detail FROM events
""")
def audit_append(spark, d):
    """Events as changes: appended twice (the second half later) to month folders, secrets hidden, and read again."""
    k = F.col("event_id")
    rows = table(spark, d, "events").select(
        "event_id", F.col("ts").alias("at"), F.concat(F.lit('{"token":"t'), k.cast("string"), F.lit('","k":'), (k % 7).cast("string"), F.lit("}")).alias("before"),
        F.concat(F.lit('{"list":[{"api-key":'), k.cast("string"), F.lit('}],"name":"n'), (k % 5).cast("string"), F.lit('"}')).alias("after"), F.col("props").alias("detail"),
    )
    path = shared_folder(spark, "audit")
    for half in (0, 1):
        K.append_audit(rows.filter(k % 2 == half), path)
    back = spark.read.schema("event_id long, before string, after string, detail string, month string").parquet(path)
    return back.select("month", "event_id", "before", "after", "detail")


@query("q_progress", """
WITH r AS (SELECT l_orderkey AS id, arg_max(struct_pack(done := l_linenumber * 30, total := CASE WHEN l_linenumber % 2 = 0 THEN 100 END), l_linenumber) AS r FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) GROUP BY 1)
SELECT o_orderkey AS id, coalesce(r.done, 0)::BIGINT AS progress_done, coalesce(r.total, 50)::BIGINT AS progress_total, least(100, greatest(0, floor(100.0 * coalesce(r.done, 0) / coalesce(r.total, 50))))::INTEGER AS percent
FROM orders LEFT JOIN r ON id = o_orderkey
""")
def q_progress(spark, d):
    """Lines of orders as reports of their tasks: the last counts, a total that isn't given stays."""
    tasks = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit(0).cast("long").alias("progress_done"), F.lit(50).cast("long").alias("progress_total"))
    n = F.col("l_linenumber").cast("long")
    reports = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), n.alias("at"), (n * 30).alias("done"), F.when(n % 2 == 0, F.lit(100).cast("long")).alias("total"))
    return K.set_progress(tasks, reports).select("id", "progress_done", "progress_total", "percent")
