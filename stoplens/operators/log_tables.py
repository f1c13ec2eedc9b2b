"""Operators over the stop-log tables: records, upload batches, clusters with their members, canonical failures.

Cluster members are a bridge table (cluster_id, record_id); :func:`members_of` explodes the array form.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stoplens import fixed_values as fv
from stoplens.functions import calc
from stoplens.operators.skew import lookup_join


def members_of(clusters: DataFrame, ids: str = "member_record_ids") -> DataFrame:
    """One row per (cluster, record) from an id array or its JSON text."""
    array = F.col(ids) if clusters.schema[ids].dataType.typeName() == "array" else F.from_json(ids, "array<bigint>")
    return clusters.select(F.col("id").alias("cluster_id"), F.explode(array).alias("record_id"))


# ---- C4, F14: one batch per content ------------------------------------------------------------------------

def canonical_batches(batches: DataFrame) -> DataFrame:
    """the earliest batch of every content hash, and every batch without a hash."""
    earliest = batches.filter(F.col("content_hash").isNotNull()).groupBy("content_hash").agg(F.min("id").alias("id"))
    return earliest.select("id").unionByName(batches.filter(F.col("content_hash").isNull()).select("id"))


def canonical_records(records: DataFrame, batches: DataFrame) -> DataFrame:
    """C4: records of canonical batches, and records that belong to no batch."""
    keep = canonical_batches(batches).select(F.col("id").alias("upload_batch_id"), F.lit(True).alias("_canonical"))
    marked = lookup_join(records, keep, ["upload_batch_id"])
    return marked.filter(F.col("upload_batch_id").isNull() | F.col("_canonical")).drop("_canonical")


# ---- C2, D1: dashboard scope --------------------------------------------------------------------------------

def confirmed_between(members: DataFrame, clusters: DataFrame, start: str, end: str) -> DataFrame:
    """Ids of records in clusters confirmed in the range, each once."""
    chosen = clusters.filter((F.col("status") == "confirmed")
                             & F.col("confirmed_on").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return lookup_join(members, chosen.select(F.col("id").alias("cluster_id")), ["cluster_id"], "inner")\
        .select("record_id").distinct()


def dashboard_scope(records: DataFrame, batches: DataFrame, members: DataFrame, clusters: DataFrame,
                    status: str = "all", day: str | None = None, start: str | None = None,
                    end: str | None = None) -> DataFrame:
    """The records a dashboard looks at; illegal combinations of arguments raise."""
    if status not in ("all", "confirmed", "pending"):
        raise ValueError("status must be all, confirmed or pending")
    if bool(start) != bool(end) or (day and start):
        raise ValueError("give one day, or both ends of a range")
    if start and start > end:
        raise ValueError("the range starts after its end")
    if (day or start) and status == "pending":
        raise ValueError("pending records have no confirmation date")
    base = canonical_records(records, batches)
    if day or start:
        chosen = confirmed_between(members, clusters, day or start, day or end)
        return base.filter(F.col("status") == "confirmed").join(
            chosen.withColumnRenamed("record_id", "id"), "id", "left_semi")
    return base if status == "all" else base.filter(F.col("status") == status)


def equals_trimmed(records: DataFrame, **wanted: str | None) -> DataFrame:
    """Equality on trimmed columns; empty filters are ignored."""
    conditions = [F.trim(F.col(name)) == value.strip() for name, value in wanted.items() if value and value.strip()]
    return records.filter(reduce(Column.__and__, conditions)) if conditions else records


# ---- C5, C6, C11, C13, G2: listings ---------------------------------------------------------------------------

def list_records(records: DataFrame, limit: int = 100, **equals: str | None) -> DataFrame:
    """Newest id first. The limit is the page the caller asks for."""
    for name, value in equals.items():
        if value:
            records = records.filter(F.col(name) == value)
    return records.orderBy(F.desc("id")).limit(limit)


def matching_clusters(clusters: DataFrame, status: str = "pending", linha: str = "", equipamento: str = "") -> DataFrame:
    """Status equality and substring tests on line and machine."""
    return clusters.filter((F.col("status") == status) & F.contains("linha", F.lit(linha.strip()))
                           & F.contains("equipamento", F.lit(equipamento.strip())))


def page(rows: DataFrame, order: list[Column], number: int = 1, size: int = 20) -> DataFrame:
    """One page of an ordering that ends in a unique key, with the total and the page count."""
    number, size = max(1, number), max(1, size)
    total = rows.agg(F.count(F.lit(1)).alias("total")).withColumn(
        "pages", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("bigint"))
    return rows.orderBy(*order).offset((number - 1) * size).limit(size).join(F.broadcast(total))


def questioned_records(records: DataFrame) -> DataFrame:
    """C11."""
    return records.filter("question_flag")


def drop_old_rejected(clusters: DataFrame, today: str, days: int) -> tuple[DataFrame, DataFrame]:
    """(clusters kept, one-row count of the dropped)."""
    old = (F.col("status") == "rejected") & (F.col("created_on") < F.date_sub(F.lit(today).cast("date"), days))
    return clusters.filter(~F.coalesce(old, F.lit(False))), \
        clusters.agg(F.count_if(old).alias("clusters_removidos"))


# ---- D2, D3, D5, D13: clusters with their records ---------------------------------------------------------------

def cluster_records(members: DataFrame, clusters: DataFrame, records: DataFrame, fields: list[str]) -> DataFrame:
    """Members of the given clusters side by side with their record fields."""
    kept = clusters.select(F.col("id").alias("cluster_id"), *[c for c in clusters.columns if c not in ("id", *fields)])
    linked = lookup_join(members, kept, ["cluster_id"], "inner")
    return linked.join(records.select(F.col("id").alias("record_id"), *fields), "record_id")


def with_canonical_member(clusters: DataFrame, members: DataFrame, records: DataFrame, batches: DataFrame) -> DataFrame:
    """D3: clusters with at least one member in a canonical import."""
    alive = members.join(canonical_records(records, batches).select(F.col("id").alias("record_id")), "record_id", "left_semi")
    return clusters.join(alive.select(F.col("cluster_id").alias("id")), "id", "left_semi")


def confirmed_on_day(clusters: DataFrame, members: DataFrame, records: DataFrame, batches: DataFrame, day: str,
                     **filters: str | None) -> DataFrame:
    """Clusters confirmed on a day, enriched with the kind and shift of their first member."""
    chosen = clusters.filter((F.col("status") == "confirmed") & (F.col("confirmed_on") == F.lit(day).cast("date")))
    chosen = with_canonical_member(chosen, members, records, batches)
    sizes = members.groupBy(F.col("cluster_id").alias("id")).agg(
        F.count(F.lit(1)).alias("total_registros"), F.min("record_id").alias("_first"))
    first = records.select(F.col("id").alias("_first"), "tipo_parada", "turno")
    enriched = chosen.join(sizes, "id", "left").join(first, "_first", "left").drop("_first")
    for name, value in filters.items():
        if value:
            enriched = enriched.filter(F.col(name) == value)
    return enriched


# ---- D6-D8, E3, E4, E10-E15 ----------------------------------------------------------------------------------------

def summary_row(records: DataFrame) -> DataFrame:
    """E3."""
    blank_null = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return records.agg(
        F.count(F.lit(1)).alias("total_apontamentos"), F.count_if(F.col("status") == "pending").alias("pendentes"),
        F.count_if(F.col("status") == "confirmed").alias("confirmados"), F.count_if("question_flag").alias("questionados"),
        F.countDistinct(blank_null("linha")).alias("linhas_distintas"),
        F.countDistinct(blank_null("equipamento")).alias("equipamentos_distintos"),
        calc.as_double(F.coalesce(F.sum("minutos_parada"), F.lit(0))).alias("total_minutos_parada"))


def cluster_summary(clusters: DataFrame, members: DataFrame, records: DataFrame, batches: DataFrame,
                    start: str | None = None, end: str | None = None) -> DataFrame:
    """Confirmed and pending clusters and confirmation days; with a range, confirmed clusters of that range."""
    alive = with_canonical_member(clusters, members, records, batches)
    if start:
        alive = alive.filter((F.col("status") == "confirmed") & F.col("confirmed_on").between(
            F.lit(start).cast("date"), F.lit(end).cast("date")))
    done = F.col("status") == "confirmed"
    return alive.agg(F.count_if(done).alias("clusters_confirmados"),
                     F.count_if(F.col("status") == "pending").alias("clusters_pendentes"),
                     F.countDistinct(F.when(done, F.col("confirmed_on"))).alias("dias_analisados"))


def history_days(clusters: DataFrame, members: DataFrame, records: DataFrame, batches: DataFrame,
                 **filters: str | None) -> DataFrame:
    """Clusters confirmed per day, optionally by unit, shift, line or kind of their records."""
    line = filters.pop("linha", None)
    done = clusters.filter((F.col("status") == "confirmed") & F.col("confirmed_on").isNotNull())
    done = equals_trimmed(done, linha=line)
    kept = equals_trimmed(canonical_records(records, batches), **filters).select(F.col("id").alias("record_id"))
    linked = members.join(kept, "record_id", "left_semi").select(F.col("cluster_id").alias("id"))
    return done.join(linked, "id", "left_semi").groupBy(F.col("confirmed_on").alias("data_analise"))\
        .agg(F.count(F.lit(1)).alias("total_clusters"))


def daily_drive(clusters: DataFrame, members: DataFrame) -> DataFrame:
    """Clusters and members confirmed per day."""
    sizes = members.groupBy(F.col("cluster_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    done = clusters.filter((F.col("status") == "confirmed") & F.col("confirmed_on").isNotNull())
    return done.join(sizes, "id", "left").groupBy(F.col("confirmed_on").alias("data_analise")).agg(
        F.count(F.lit(1)).alias("total_clusters"), F.sum("n").alias("total_apontamentos"))


def import_audit(batches: DataFrame, records: DataFrame) -> DataFrame:
    """Records of every batch by state; batches without records show null."""
    states = records.groupBy(F.col("upload_batch_id").alias("id")).agg(
        F.count_if(F.col("status") == "pending").alias("pendentes"),
        F.count_if(F.col("status") == "confirmed").alias("confirmados"), F.count_if("question_flag").alias("questionados"))
    return batches.join(states, "id", "left").select(
        F.col("id").alias("batch_id"), "filename", F.col("total_records").alias("registros_importados"),
        F.col("created_on").alias("data_importacao"), *[F.coalesce(c, F.lit(0)).alias(c)
                                                       for c in ("pendentes", "confirmados", "questionados")])


def global_counters(batches: DataFrame, records: DataFrame, clusters: DataFrame, canonical: DataFrame,
                    jobs: DataFrame | None = None) -> DataFrame:
    """One row of counters over all tables."""
    by = lambda value: F.count_if(F.col("status") == value)
    rows = [
        batches.agg(F.count(F.lit(1)).alias("total_importacoes")),
        records.agg(F.count(F.lit(1)).alias("total_apontamentos"), by("pending").alias("apontamentos_pendentes"),
                    by("confirmed").alias("apontamentos_confirmados"), F.count_if("question_flag").alias("apontamentos_questionados")),
        clusters.agg(by("pending").alias("clusters_pendentes"), by("confirmed").alias("clusters_confirmados"),
                     by("rejected").alias("clusters_rejeitados")),
        canonical.agg(F.count(F.lit(1)).alias("modos_falha_catalogados")),
    ]
    if jobs is not None:
        rows.append(jobs.agg(by("done").alias("jobs_dedup_completos"), by("error").alias("jobs_dedup_com_erro")))
    return reduce(lambda left, right: left.join(F.broadcast(right)), rows)


def canonical_usage(canonical: DataFrame, records: DataFrame) -> DataFrame:
    """Canonical failures with their record count, zero included."""
    used = records.filter(F.col("canonical_failure_id").isNotNull()).groupBy(F.col("canonical_failure_id").alias("id"))\
        .agg(F.count(F.lit(1)).alias("total_registros"))
    return canonical.join(used, "id", "left").withColumn("total_registros", F.coalesce("total_registros", F.lit(0)))


def orphan_canonical(canonical: DataFrame, records: DataFrame) -> DataFrame:
    """Canonical failures no record points to."""
    return canonical.join(records.select(F.col("canonical_failure_id").alias("id")), "id", "left_anti")


def with_channel(records: DataFrame, channels: DataFrame, default: str | None = "nao cadastrado") -> DataFrame:
    """Radio channel of the record's line and shift."""
    return lookup_join(records, channels, ["linha", "turno"]).withColumn(
        "canal_radio_sugerido", F.coalesce("canal", F.lit(default))).drop("canal")


def facet_values(stops: DataFrame, facets: dict[str, str]) -> DataFrame:
    """Distinct non-empty values of every facet, as (facet, value) rows."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("facet"), F.trim(F.col(c).cast("string")).alias("value"))
                                for f, c in facets.items()])).alias("p")
    return stops.select(pairs).select("p.*").filter("value <> ''").distinct()


def main_unit(stops: DataFrame) -> DataFrame:
    """The unit with most stops when there is more than one, else ''."""
    units = stops.groupBy("centro").agg(F.count(F.lit(1)).alias("n"))
    return units.agg(F.when(F.count(F.lit(1)) > 1, F.min_by("centro", F.struct(-F.col("n"), F.col("centro"))))
                     .otherwise(F.lit("")).alias("main_unit"))


def maintenance_default(stops: DataFrame) -> DataFrame:
    """Maintenance stops of the main unit; a side without its default is not narrowed."""
    defaults = main_unit(stops).join(F.broadcast(stops.agg(
        F.max(F.upper("tipo_parada") == fv.MAINTENANCE_STOP).alias("has_maintenance"))))
    kind = ~F.col("has_maintenance") | (F.upper("tipo_parada") == fv.MAINTENANCE_STOP)
    return stops.join(F.broadcast(defaults)).filter(kind & ((F.col("main_unit") == "") | (F.col("centro") == F.col("main_unit"))))\
        .drop("main_unit", "has_maintenance")


# ---- A13: content hashes of batches -----------------------------------------------------------------------------------

def batch_hashes(records: DataFrame) -> DataFrame:
    """B26 per batch, with partial sums before the shuffle."""
    present = [f for f in fv.SOURCE_FIELDS if f in records.columns]
    return records.withColumn("_row", calc.row_hash(present)).groupBy("upload_batch_id").agg(
        calc.content_hash("_row").alias("content_hash"))


def backfill_hashes(batches: DataFrame, records: DataFrame) -> DataFrame:
    """Hash the batches that have none; batches without records keep null."""
    missing = batches.filter(F.col("content_hash").isNull()).select(F.col("id").alias("upload_batch_id"))
    computed = batch_hashes(lookup_join(records, missing, ["upload_batch_id"], "inner")).select(
        F.col("upload_batch_id").alias("id"), F.col("content_hash").alias("_hash"))
    return batches.join(computed, "id", "left").withColumn("content_hash", F.coalesce("content_hash", "_hash")).drop("_hash")


# ---- M8, M9, M11: decisions about clusters and records -------------------------------------------------------------------

def confirm_clusters(clusters: DataFrame, members: DataFrame, picks: DataFrame) -> dict[str, DataFrame]:
    """M8: confirm the picked members (cluster_id, record_id) of pending clusters.

    A record picked for two clusters goes to the lower id. Confirmed ids leave every other pending cluster; another
    cluster that drops below 2 members is deleted; the confirming cluster stays pending with what was not picked.
    """
    pending = clusters.filter(F.col("status") == "pending").select(F.col("id").alias("cluster_id"))
    valid = picks.select("cluster_id", "record_id").join(members, ["cluster_id", "record_id"], "left_semi")
    valid = lookup_join(valid, pending, ["cluster_id"], "inner")
    taken = valid.groupBy("record_id").agg(F.min("cluster_id").alias("taken_by"))
    open_members = lookup_join(members.select("cluster_id", "record_id"), pending, ["cluster_id"], "inner")\
        .join(taken, "record_id", "left")
    stats = open_members.groupBy("cluster_id").agg(
        F.count_if(F.col("taken_by").isNull()).alias("left"),
        F.count_if(F.col("taken_by").isNotNull()).alias("gone"),
        F.count_if(F.col("taken_by") == F.col("cluster_id")).alias("own"))
    fate = stats.select(F.col("cluster_id").alias("id"), F.when((F.col("own") > 0) & (F.col("left") == 0), "confirmed")
                        .when((F.col("own") == 0) & (F.col("gone") > 0) & (F.col("left") < 2), "deleted")
                        .otherwise("pending").alias("fate"))
    updated = clusters.join(fate, "id", "left").withColumn("status", F.coalesce("fate", "status")).drop("fate")
    kept = fate.select(F.col("id").alias("cluster_id"), "fate")
    closed = lookup_join(members.select("cluster_id", "record_id"), clusters.filter(F.col("status") != "pending").select(
        F.col("id").alias("cluster_id")), ["cluster_id"], "inner")
    remaining = lookup_join(open_members, kept, ["cluster_id"], "inner").filter(
        ((F.col("fate") == "pending") & F.col("taken_by").isNull()) | (F.col("fate") == "confirmed"))
    return {"clusters": updated.filter(F.col("status") != "deleted"), "confirmed": taken,
            "members": remaining.select("cluster_id", "record_id").unionByName(closed)}


def confirm_all(clusters: DataFrame, members: DataFrame, job: int, day: str) -> DataFrame:
    """M9: every pending cluster that has members is confirmed under its suggested name."""
    filled = members.select(F.col("cluster_id").alias("id")).distinct().withColumn("_filled", F.lit(True))
    now = (F.col("status") == "pending") & F.coalesce("_filled", F.lit(False))
    return clusters.join(filled, "id", "left").withColumns({
        "bulk_job_id": F.when(now, F.lit(job)).otherwise(F.col("bulk_job_id")),
        "confirmed_on": F.when(now, F.lit(day).cast("date")).otherwise(F.col("confirmed_on")),
        "status": F.when(now, "confirmed").otherwise(F.col("status"))}).drop("_filled")


def revert_clusters(clusters: DataFrame, members: DataFrame, records: DataFrame, canonical: DataFrame,
                    chosen: Column) -> dict[str, DataFrame]:
    """M9: chosen confirmed clusters return to pending, their records lose the canonical failure, orphans go."""
    back = chosen & (F.col("status") == "confirmed")
    freed = lookup_join(members, clusters.filter(back).select(F.col("id").alias("cluster_id")), ["cluster_id"], "inner")\
        .select(F.col("record_id").alias("id")).distinct().withColumn("_freed", F.lit(True))
    loosened = records.join(freed, "id", "left").withColumns({
        "canonical_failure_id": F.when(F.col("_freed").isNull(), F.col("canonical_failure_id")),
        "status": F.when(F.col("_freed"), "pending").otherwise(F.col("status"))}).drop("_freed")
    reopened = clusters.withColumns({
        "confirmed_on": F.when(~back, F.col("confirmed_on")), "bulk_job_id": F.when(~back, F.col("bulk_job_id")),
        "status": F.when(back, "pending").otherwise(F.col("status"))})
    orphans = orphan_canonical(canonical, loosened)
    return {"clusters": reopened, "records": loosened, "orphans": orphans,
            "canonical": canonical.join(orphans.select("id"), "id", "left_anti")}


def reject_clusters(clusters: DataFrame, chosen: Column) -> DataFrame:
    """M9."""
    return clusters.withColumn("status", F.when(chosen, "rejected").otherwise(F.col("status")))


def remove_members(clusters: DataFrame, members: DataFrame, removed: DataFrame) -> dict[str, DataFrame]:
    """M9: take records out of pending clusters; a touched cluster left with fewer than 2 members is deleted."""
    pending = clusters.filter(F.col("status") == "pending").select(F.col("id").alias("cluster_id"))
    gone = lookup_join(removed.join(members, ["cluster_id", "record_id"], "left_semi"), pending, ["cluster_id"], "inner")\
        .select("cluster_id", "record_id").distinct()
    left = members.join(gone, ["cluster_id", "record_id"], "left_anti")
    sizes = left.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    touched = gone.select("cluster_id").distinct().join(sizes, "cluster_id", "left")
    dead = touched.filter(F.coalesce("n", F.lit(0)) < 2).select("cluster_id")
    return {"clusters": clusters.join(dead.withColumnRenamed("cluster_id", "id"), "id", "left_anti"),
            "members": left.join(dead, "cluster_id", "left_anti")}


def question_records(records: DataFrame, questions: DataFrame) -> DataFrame:
    """Raise the flag and keep the latest note (id, question_note, seq)."""
    latest = questions.groupBy("id").agg(F.max_by("question_note", "seq").alias("_note"), F.lit(True).alias("_asked"))
    return records.join(latest, "id", "left").withColumns({
        "question_flag": F.coalesce("_asked", "question_flag"),
        "question_note": F.coalesce("_note", F.lit(None).cast("string"))}).drop("_note", "_asked")


# ---- H5-H7: arrays and state differences ----------------------------------------------------------------------------------

def array_difference(first: Column, second: Column) -> Column:
    """H5."""
    return F.array_except(first, second)


def array_merge(first: Column, second: Column) -> Column:
    """H6: union that keeps order."""
    return F.array_union(first, second)


def state_changes(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """H7: keys whose value differs between two states, nulls compared as values; a missing key counts as null."""
    a = before.select(key, F.col(value).alias("before"))
    b = after.select(key, F.col(value).alias("after"))
    return a.join(b, key, "full_outer").filter(~F.col("before").eqNullSafe(F.col("after")))


def latest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Last row per key by ``order``, as one aggregation (no window over a hot key)."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*key, "_row.*")


def last_n(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The newest ``n`` points of a history (40 model points, 60 sheets, 100 events)."""
    return rows.orderBy(*order).limit(n)


def previous_delta(sheets: DataFrame) -> DataFrame:
    """hit rate of the sheet finished before, and the change; one row per finished sheet."""
    order = Window.orderBy("finished_at", "id")
    return sheets.withColumn("previous_hit_rate", F.lag("hit_rate").over(order))\
        .withColumn("delta", F.round(F.col("hit_rate") - F.col("previous_hit_rate"), 1))
