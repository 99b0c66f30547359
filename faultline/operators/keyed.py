"""Key-based writes as joins: resolve, upsert, insert when absent, cascade, check.

Parquet tables take no MERGE, so an upsert is the new content of the table as a
DataFrame; streams append changes instead, which ``sources.changes`` folds on read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import schemas
from faultline.session import BROADCAST_ROWS, lookup_join, sorted_join


def resolve_service(
    rows: DataFrame, services: DataFrame, spread: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Replace ``service_name`` by ``service_id``: (known rows, rows of unknown names).

    Rows of an unknown service are dropped from the first result, as on ingest.
    """
    ids = services.select(F.col("name").alias("service_name"), F.col("id").alias("service_id"))
    joined = lookup_join(rows, ids, ["service_name"], "left", spread=list(spread))
    known = joined.filter(F.col("service_id").isNotNull()).drop("service_name")
    return known, joined.filter(F.col("service_id").isNull()).drop("service_id")


def resolve_deployment(
    rows: DataFrame, deployments: DataFrame, spread: Sequence[str]
) -> DataFrame:
    """(service_id, deployment_version) -> deployment_id, null when there is none.

    Rows that name no version have no deployment and stay where they are.
    """
    ids = deployments.groupBy("service_id", F.col("version").alias("deployment_version")).agg(
        F.min("id").alias("deployment_id")
    )
    named, plain = rows.where("deployment_version IS NOT NULL"), rows.where("deployment_version IS NULL")
    found = lookup_join(
        named, ids, ["service_id", "deployment_version"], "left", spread=list(spread)
    )
    none = F.lit(None).cast(ids.schema["deployment_id"].dataType)
    return found.unionByName(plain.withColumn("deployment_id", none))


def latest_per_key(source: DataFrame, keys: Sequence[str], order: str, *, first=False) -> DataFrame:
    """One row per key, the last (or first) in batch order; folds before it shuffles."""
    pick = F.min_by if first else F.max_by
    rest = [c for c in source.columns if c not in keys]
    return (
        source.groupBy(*keys)
        .agg(pick(F.struct(*rest), F.col(order)).alias("_row"))
        .select(*keys, "_row.*")
    )


def upsert(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    update: Sequence[str],
    *,
    order: str = "batch_seq",
) -> DataFrame:
    """``target`` after INSERT .. ON CONFLICT (keys) DO UPDATE of the ``update`` columns.

    Later source rows win within a batch. A new key takes every source column; for an
    existing key the other columns keep their stored value.
    """
    rows = latest_per_key(source, keys, order).drop(order)
    old = target.withColumn("_old", F.lit(True)).alias("o")
    new = rows.withColumn("_new", F.lit(True)).alias("n")
    joined = old.join(new.hint("merge"), [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full_outer")
    stored, sent = F.col("o._old").isNotNull(), F.col("n._new").isNotNull()

    def column(name: str) -> Column:
        if name not in rows.columns:
            return F.col(f"o.{name}")
        if name in update:
            return F.when(sent, F.col(f"n.{name}")).otherwise(F.col(f"o.{name}"))
        return F.when(stored, F.col(f"o.{name}")).otherwise(F.col(f"n.{name}"))

    return joined.select(*[column(c).alias(c) for c in target.columns])


def upsert_services(target: DataFrame, source: DataFrame) -> DataFrame:
    update = ["display_name", "description", "owner_team", "runtime", "criticality"]
    return upsert(target, source, ["name"], update)


def upsert_deployments(target: DataFrame, source: DataFrame) -> DataFrame:
    update = ["commit_sha", "deployed_by", "status", "deployed_at", "metadata"]
    return upsert(target, source, ["service_id", "version", "environment"], update)


def upsert_runbooks(target: DataFrame, source: DataFrame, *, body_only: bool = False) -> DataFrame:
    """By slug; either the full or the body-only update policy, both touch updated_at."""
    update = ["body"] if body_only else ["title", "body", "source_path", "version"]
    return upsert(target, source, ["slug"], [*update, "updated_at"])


def upsert_chunks(
    target: DataFrame, source: DataFrame, *, prune_stale: bool = False, contents: DataFrame | None = None
) -> DataFrame:
    """By (runbook_id, chunk_index). Stale higher chunks stay unless ``prune_stale``.

    With ``contents`` (content_hash, content, embedding) the source names its contents by
    ``content_hash``. Keys are settled without texts and vectors then, which are moved once.
    """
    keys = ["runbook_id", "chunk_index"]
    if prune_stale:
        sent = source.select("runbook_id").distinct()
        stale = target.join(sent, "runbook_id", "left_semi").join(source, keys, "left_anti")
        target = target.join(stale.select(*keys), keys, "left_anti")
    if contents is None:
        return upsert(target, source, keys, ["content", "embedding", "metadata"])
    named = target.drop("content", "embedding").withColumn("content_hash", F.lit(None).cast("binary"))
    sent = upsert(named, source, keys, ["content_hash", "metadata"]).where("content_hash IS NOT NULL")
    # One content, a licence line say, may be that of many chunks.
    large = contents.count() > BROADCAST_ROWS
    sent = lookup_join(sent, contents, ["content_hash"], spread=keys, large=large).select(*target.columns)
    old, new = target.alias("o"), source.select(*keys).alias("n").hint("merge")
    left = old.join(new, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "left_anti")
    return sent.unionByName(left)


def absent_rows(
    target: DataFrame, source: DataFrame, keys: Sequence[str], *, order: str = "batch_seq"
) -> DataFrame:
    """Source rows whose key the target lacks, the first of each key."""
    return latest_per_key(source, keys, order, first=True).join(
        target.select(*keys).distinct(), list(keys), "left_anti"
    )


def stored_incidents(scenarios: DataFrame) -> DataFrame:
    """Scenarios in the shape of the incident table, with their place in the batch if they have one."""
    place = [c for c in ("batch_seq",) if c in scenarios.columns]
    return scenarios.select(
        F.sha2(F.concat(F.lit("incident/"), F.col("scenario_id")), 256).alias("id"),
        "scenario_id",
        "service_id",
        "title",
        "severity",
        F.lit("detected").alias("status"),
        "detected_at",
        "started_at",
        "detection_reason",
        "suspected_root_cause",
        F.struct(
            F.col("scenario_id").alias("scenarioId"),
            F.col("affected_signals").alias("affectedSignals"),
            F.lit(True).alias("synthetic"),
        ).alias("metadata"),
        *place,
    )


def insert_absent_incidents(target: DataFrame, source: DataFrame) -> DataFrame:
    """The incident table with the scenarios it lacks added; stored ones never change."""
    new = stored_incidents(absent_rows(target, source, ["scenario_id"])).drop("batch_seq")
    return target.unionByName(new, allowMissingColumns=True)


def stable_id(*parts: str | Column) -> Column:
    """An id that a replay produces again, unlike a random one."""
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    texts = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    return F.sha2(F.concat_ws("/", *texts), 256)


def apply_defaults(df: DataFrame, id_parts: Sequence[str], as_of: Column) -> DataFrame:
    """Fill the columns the store fills: id, environment, version, JSON documents, times."""
    defaults: dict[str, Column] = {
        "id": stable_id(*id_parts),
        "environment": F.lit("production"),
        "version": F.lit(1),
        "metadata": F.lit("{}"),
        "attributes": F.lit("{}"),
        "created_at": as_of,
        "updated_at": as_of,
    }
    filled = {c: F.coalesce(F.col(c), d) for c, d in defaults.items() if c in df.columns}
    return df.withColumns(filled)


def cascade_delete(
    tables: Mapping[str, DataFrame], parent: str, ids: DataFrame
) -> dict[str, DataFrame]:
    """The parent table and its children without the rows of the deleted ids."""
    gone = ids.select(F.col("id")).distinct()
    left = dict(tables)
    left[parent] = sorted_join(tables[parent], gone, "id", "left_anti")
    for child, column in schemas.CASCADES[parent].items():
        if child in tables:
            left[child] = lookup_join(
                tables[child], gone.withColumnRenamed("id", column), [column], "left_anti", spread=["id"]
            )
    return left


def _row_tests(name: str, df: DataFrame) -> dict[tuple[str, str], Column]:
    """(rule, column) -> what is true of a row that breaks it."""
    tests: dict[tuple[str, str], Column] = {}
    for c in schemas.REQUIRED.get(name, ()):
        if c in df.columns:
            tests["not_null", c] = F.col(c).isNull()
    for c, allowed in schemas.ENUMS.get(name, {}).items():
        if c in df.columns:
            tests["enum", c] = ~F.col(c).isin(*allowed)
    for c, (low, high) in schemas.RANGES.get(name, {}).items():
        if c in df.columns:
            outside = F.lit(False) if low is None else F.col(c) < low
            tests["range", c] = outside if high is None else outside | (F.col(c) > high)
    return tests


def _key_text(key: Sequence[str]) -> Column:
    """A key as one text, the same for equal keys only."""
    texts = [F.col(c).cast("string") for c in key]
    if len(texts) == 1:
        return texts[0]
    return F.concat(*[F.concat(F.octet_length(t).cast("string"), F.lit(":"), t) for t in texts])


def check_integrity(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, rule, columns, rows) of the rules that rows break.

    Each table is read once and says for every row what matters to any rule: that it breaks
    one of its own, which unique key it holds, whom it refers to, and whom others may refer
    to. These tagged keys are folded where they lie, so a key that most rows share is one
    row per task, and one shuffle brings the rest together for all rules of all tables. Null
    keys take no part.
    """
    rules: list[tuple[str, str, str]] = []
    said: dict[str, list[Column]] = {name: [] for name in tables}

    def entry(rule: int, when: Column, key: Column | None, parent: bool = False) -> Column:
        count = [F.lit(int(not parent)).alias("held"), F.lit(int(parent)).alias("known")]
        text = F.lit(None).cast("string") if key is None else key
        return F.when(when, F.struct(F.lit(rule).alias("rule"), text.alias("key"), *count))

    for name, df in tables.items():
        for (rule, c), test in _row_tests(name, df).items():
            said[name].append(entry(len(rules), test, None))
            rules.append((name, rule, c))
        for key in schemas.UNIQUE.get(name, ()):
            if set(key) <= set(df.columns):
                whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in key])
                said[name].append(entry(len(rules), whole, _key_text(key)))
                rules.append((name, "unique", ",".join(key)))
        for c, parent in schemas.FOREIGN.get(name, {}).items():
            if c in df.columns and parent in tables:
                said[name].append(entry(len(rules), F.col(c).isNotNull(), _key_text([c])))
                said[parent].append(entry(len(rules), F.col("id").isNotNull(), _key_text(["id"]), parent=True))
                rules.append((name, "foreign_key", c))
    tagged = [df.select(F.inline(F.array_compact(F.array(*said[name])))) for name, df in tables.items() if said[name]]
    keys = reduce(DataFrame.unionByName, tagged).groupBy("rule", "key").agg(
        F.sum("held").alias("held"), F.sum("known").alias("known")
    )
    names = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("table_name", "rule", "columns"), r)]) for r in rules])
    kind = F.element_at(names, F.col("rule") + 1)["rule"]
    broken = F.when(kind == "unique", F.col("held") > 1).when(kind == "foreign_key", F.col("known") == 0).otherwise(True)
    found = keys.where(broken & (F.col("held") > 0)).groupBy("rule").agg(F.sum("held").alias("rows"))
    return found.select(F.element_at(names, F.col("rule") + 1).alias("_of"), "rows").select("_of.*", "rows")
