"""Pareto, Jack-Knife and breakdown tables.

Every table is one aggregation of the stops (partial sums before the shuffle) followed by windows over the
aggregated rows. Windows without a partition run only over dimension-sized tables: machines, failure classes.
The note-mode dimension, whose size follows the free text, goes through :func:`skew.running_total` instead.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stoplens import fixed_values as fv
from stoplens.functions import calc, text
from stoplens.operators.skew import lookup_join, running_total


def _whole():
    """The whole table as one window: only for dimension-sized tables."""
    return Window.partitionBy()


def _filled(name: str, default: str) -> Column:
    return F.coalesce(F.nullif(F.trim(F.col(name)), F.lit("")), F.lit(default))


def measure(mode: str = "events") -> Column:
    """E5: distinct failure events, or log lines."""
    if mode == "lines":
        return F.count(F.lit(1))
    if mode != "events":
        raise ValueError("count mode must be 'events' or 'lines'")
    return F.countDistinct(F.coalesce("event_id", F.concat_ws(":", "analysis_id", F.col("id").cast("string"))))


def _sums(mode: str) -> list[Column]:
    return [measure(mode).alias("count"), F.count(F.lit(1)).alias("lines"),
            F.coalesce(F.sum("minutos_parada"), F.lit(0)).cast("decimal(30,2)").alias("minutes")]


def _cuts(table: DataFrame, cuts: tuple[float, float] | None, over=None) -> DataFrame:
    """Mean count and total minutes / total count, unless fixed cuts are given."""
    over = over or _whole()
    if cuts:
        return table.withColumns({"q_cut": F.lit(float(cuts[0])), "mttr_cut": F.lit(float(cuts[1]))})
    total = F.sum("count").over(over)
    return table.withColumns({
        "q_cut": F.avg("count").over(over).cast("double"),
        "mttr_cut": F.when(total > 0, calc.as_double(F.sum("minutes").over(over)) / total).otherwise(F.lit(0.0)),
    })


def _ranked(table: DataFrame, tie: str, over=None, close: bool = True) -> DataFrame:
    """Percent and capped cumulative percent by minutes; the last row closes at 100 when ``close``."""
    over = over or _whole()
    order = over.orderBy(F.desc("minutes"), tie)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("minutes").over(over)
    share = lambda amount: F.when(total != 0, calc.as_double(amount) * 100 / calc.as_double(total)).otherwise(0.0)
    out = table.withColumns({
        "position": F.row_number().over(order).cast("bigint"),
        "percent": share(F.col("minutes")),
        "cumulative": F.least(F.lit(100.0), share(F.sum("minutes").over(upto))),
        "_total": total, "_size": F.count(F.lit(1)).over(over),
    })
    if close:
        last = (F.col("position") == F.col("_size")) & (F.col("_total") != 0)
        out = out.withColumn("cumulative", F.when(last, F.lit(100.0)).otherwise(F.col("cumulative")))
    return out.drop("_total", "_size")


# ---- E1, E2, F1, F2: plain Pareto --------------------------------------------------------------------

def totals_by_machine(stops: DataFrame, by: str = "equipamento") -> DataFrame:
    """Minutes and stops by line and machine (blank = SEM LINHA / SEM EQUIPAMENTO), or by line."""
    keys = [_filled("linha", "SEM LINHA").alias("linha")]
    if by == "equipamento":
        keys.append(_filled("equipamento", "SEM EQUIPAMENTO").alias("equipamento"))
    return stops.groupBy(*keys).agg(F.count(F.lit(1)).alias("falhas"),
                                    F.coalesce(F.sum("minutos_parada"), F.lit(0)).cast("decimal(30,2)").alias("tempo_min"))


def pareto_open(stops: DataFrame, by: str = "equipamento") -> DataFrame:
    """rounded percent, running sum of the rounded percents, no cap."""
    keys = ["linha", "equipamento"] if by == "equipamento" else ["linha"]
    table = stops.groupBy(*keys).agg(F.count(F.lit(1)).alias("falhas"),
                                     F.coalesce(F.sum("minutos_parada"), F.lit(0)).cast("decimal(30,2)").alias("tempo_min"))
    total = F.sum("tempo_min").over(_whole())
    upto = _whole().orderBy(F.desc("tempo_min"), *keys).rowsBetween(Window.unboundedPreceding, 0)
    return (table.withColumn("pct_total", calc.percent_2(F.col("tempo_min"), F.when(total == 0, F.lit(1)).otherwise(total)))
            .withColumn("pct_acumulado", calc.as_double(F.sum(F.col("pct_total").cast("decimal(9,2)")).over(upto)))
            .withColumn("tempo_min", calc.as_double("tempo_min")))


def pareto_closed(stops: DataFrame) -> DataFrame:
    """as F1 with blanks filled, capped at 100 and the last row forced to 100."""
    table = totals_by_machine(stops)
    order = _whole().orderBy(F.desc("tempo_min"), "linha", "equipamento")
    total = F.sum("tempo_min").over(_whole())
    last = (F.row_number().over(order) == F.count(F.lit(1)).over(_whole())) & (total != 0)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return (table.withColumn("pct_total", F.when(total != 0, calc.percent_2(F.col("tempo_min"), total)).otherwise(0.0))
            .withColumn("_running", calc.as_double(F.sum(F.col("pct_total").cast("decimal(9,2)")).over(upto)))
            .withColumn("pct_acumulado", F.when(last, 100.0).otherwise(F.least(F.lit(100.0), F.col("_running"))))
            .withColumn("tempo_min", calc.as_double("tempo_min")).drop("_running"))


# ---- F5: Jack-Knife of the log tables ------------------------------------------------------------------

def jack_knife_plain(stops: DataFrame, labels: list[Column], partition: list[str] | None = None) -> DataFrame:
    """T, Q, MTTR, cuts and quadrant by the given labels; ``partition`` compares within that key."""
    over = Window.partitionBy(*partition) if partition else _whole()
    table = stops.groupBy(*labels).agg(
        F.count(F.lit(1)).alias("count"),
        F.coalesce(F.sum("minutos_parada"), F.lit(0)).cast("decimal(30,2)").alias("minutes"))
    table = _cuts(table.withColumn("MTTR", calc.ratio("minutes", "count")), None, over)
    return table.select("*", calc.as_double("minutes").alias("T"), F.col("count").alias("Q"), calc.quadrant(
        F.col("count"), F.col("MTTR"), F.col("q_cut"), F.col("mttr_cut"), plain=True).alias("categoria")
    ).drop("count", "minutes")


def jack_knife_by_machine(stops: DataFrame) -> DataFrame:
    return jack_knife_plain(stops, [_filled("linha", "SEM LINHA").alias("linha"),
                                    _filled("equipamento", "SEM EQUIPAMENTO").alias("equipamento")])


def jack_knife_by_mode(stops: DataFrame, canonical: DataFrame) -> DataFrame:
    """Failure modes within each (line, machine): canonical name, else normalised note, else unknown."""
    names = canonical.select(F.col("id").alias("canonical_failure_id"), "nome_canonico")
    named = lookup_join(stops.select("id", "linha", "equipamento", "minutos_parada", "canonical_failure_id",
                                     "observacao_normalizada"), names, ["canonical_failure_id"])
    label = F.coalesce(F.nullif(F.trim("nome_canonico"), F.lit("")), F.nullif(F.trim("observacao_normalizada"), F.lit("")),
                       F.lit(fv.NO_MODE)).alias("modo_falha")
    return jack_knife_plain(named, [F.trim("linha").alias("linha"), F.trim("equipamento").alias("equipamento"), label],
                            ["linha", "equipamento"])


# ---- F3, F6: machines ------------------------------------------------------------------------------------

def machine_table(stops: DataFrame, mode: str = "events", cuts: tuple[float, float] | None = None) -> DataFrame:
    """F3 + F6: one row per (unit, line, machine) with Pareto shares, MTTR, cuts and quadrant."""
    table = stops.groupBy(F.col("centro").alias("unit"), F.col("linha").alias("line"),
                          F.col("equipamento").alias("name")).agg(*_sums(mode))
    table = table.withColumn("key", F.concat_ws("\x1f", "unit", "line", "name"))
    table = _cuts(table.withColumn("mttr", calc.ratio("minutes", "count")), cuts)
    return (_ranked(table, "key")
            .withColumn("category", calc.quadrant(F.col("count"), F.col("mttr"), F.col("q_cut"), F.col("mttr_cut")))
            .withColumn("short", F.concat_ws("_", text.short_line("line"), "name"))
            .withColumn("minutes", calc.as_double("minutes")))


def in_categories(stops: DataFrame, categories: list[str], mode: str = "events") -> DataFrame:
    """Machine table of the chosen quadrants, classified by the cuts of the full set, shares recomputed."""
    unknown = [c for c in categories if c not in fv.QUADRANTS]
    if unknown:
        raise ValueError(f"unknown category: {unknown[0]}")
    full = machine_table(stops, mode).filter(F.col("category").isin(categories))
    again = full.drop("position", "percent", "cumulative").withColumn("minutes", F.col("minutes").cast("decimal(30,2)"))
    return _ranked(again, "key").withColumn("minutes", calc.as_double("minutes"))


def stops_in_categories(stops: DataFrame, categories: list[str], mode: str = "events") -> DataFrame:
    """The stops of the machines in the chosen quadrants (for E6, E7, F7 on the narrowed set)."""
    keep = machine_table(stops, mode).filter(F.col("category").isin(categories)).select(
        F.col("unit").alias("centro"), F.col("line").alias("linha"), F.col("name").alias("equipamento"))
    return stops.join(keep, fv.MACHINE_FIELDS, "left_semi")


def quadrant_counts(machines: DataFrame) -> DataFrame:
    """Machines per quadrant, zero filled."""
    spark = machines.sparkSession
    names = spark.range(1).select(F.explode(F.array(*[F.lit(q) for q in fv.QUADRANTS])).alias("category"))
    counted = machines.groupBy("category").agg(F.count(F.lit(1)).alias("machines"))
    return names.join(counted, "category", "left").select("category", F.coalesce("machines", F.lit(0)).alias("machines"))


def action_plan(machines: DataFrame, top: int = 3) -> DataFrame:
    """the first machines of every quadrant with its strategy text."""
    pick = F.row_number().over(Window.partitionBy("category").orderBy("position"))
    chosen = machines.withColumn("rank", pick.cast("bigint")).filter(F.col("rank") <= top)
    lookup = F.create_map(*[F.lit(x) for q, (title, _, tools) in fv.STRATEGY.items() for x in (q, f"{title}|{tools}")])
    plan = F.element_at(lookup, F.col("category"))
    return chosen.select("category", "rank", "short", "unit", "minutes",
                         F.substring_index(plan, "|", 1).alias("title"),
                         F.regexp_replace(plan, r"^[^|]*\|", "").alias("tools"))


# ---- E6, E7, E8: strip, breakdown, regroup ------------------------------------------------------------------

def metric_strip(stops: DataFrame, mode: str = "events") -> DataFrame:
    """The one-row summary. Distinct counts are two-level aggregates, so no key is counted in one task."""
    numbered = F.countDistinct(F.when(F.col("order_number") != "", F.col("event_id")))
    strip = stops.agg(
        measure(mode).alias("count"), measure("events").alias("events"), F.count(F.lit(1)).alias("lines"),
        numbered.alias("with_order"), F.coalesce(F.sum("minutos_parada"), F.lit(0)).cast("decimal(30,2)").alias("minutes"),
        F.countDistinct(*fv.MACHINE_FIELDS).alias("machines"), F.countDistinct("group_id").alias("groups"),
        F.countDistinct("data_inicio").alias("days"), F.countDistinct("analysis_id").alias("analyses"))
    return strip.withColumn("mttr", calc.ratio("minutes", "count")).withColumn("minutes", calc.as_double("minutes"))


def breakdown(stops: DataFrame, mode: str = "events") -> DataFrame:
    """The six-dimension base every manual chart regroups."""
    keys = [F.col("centro").alias("unit"), F.col("linha").alias("line"), F.col("equipamento").alias("machine"),
            F.col("tipo_parada").alias("failure"), F.coalesce("failure_mode", F.lit("")).alias("mode"),
            F.coalesce("failure_class", F.lit(fv.NO_MODE)).alias("klass")]
    return stops.groupBy(*keys).agg(*_sums(mode))


DIMENSIONS = {
    "machine": (["unit", "line", "machine"], lambda: F.concat_ws("_", text.short_line("line"), "machine"), "unit"),
    "class": (["klass"], lambda: text.display_label("klass"), None),
    "line": (["unit", "line"], lambda: F.col("line"), "unit"),
    "unit": (["unit"], lambda: F.col("unit"), None),
    "failure": (["failure"], lambda: F.col("failure"), None),
    "mode": (["machine", "mode"], lambda: F.coalesce(F.nullif("mode", F.lit("")), F.lit("Sem descrição")), "machine"),
}


def regroup(base: DataFrame, dimension: str) -> DataFrame:
    """The breakdown by one dimension; counts add up, so an event in two cells counts twice."""
    keys, label, sub = DIMENSIONS[dimension]
    grouped = base.groupBy(*keys).agg(F.sum("count").cast("bigint").alias("count"),
                                      F.sum("minutes").cast("decimal(30,2)").alias("minutes"))
    return grouped.select(F.concat_ws("\x1f", *keys).alias("key"), label().alias("label"),
                          (F.col(sub) if sub else F.lit("")).alias("sub"), "count", "minutes")


OVERRIDE_SCHEMA = "key string, exclude boolean, label string, value double, count bigint, minutes decimal(30,2)"
EXTRA_SCHEMA = "key string, label string, count bigint, minutes decimal(30,2), value double"


def _with_overrides(groups: DataFrame, overrides: DataFrame | None, extras: DataFrame | None) -> DataFrame:
    """Edited labels, values and exclusions, and rows added by hand. Both are typed by a person: small."""
    if overrides is None:
        edited = groups.withColumns({"_exclude": F.lit(False), "_value": F.lit(None).cast("double")})
    else:
        o = F.broadcast(overrides.select("key", F.col("exclude").alias("_exclude"), F.col("label").alias("_label"),
                                         F.col("value").alias("_value"), F.col("count").alias("_count"),
                                         F.col("minutes").alias("_minutes")))
        edited = groups.join(o, "key", "left").withColumns({
            "label": F.coalesce("_label", "label"), "count": F.coalesce("_count", "count"),
            "minutes": F.coalesce("_minutes", "minutes"), "_exclude": F.coalesce("_exclude", F.lit(False)),
        }).drop("_label", "_count", "_minutes")
    if extras is not None:
        edited = edited.unionByName(extras.select("key", "label", F.lit("manual").alias("sub"), "count", "minutes",
                                                  F.lit(False).alias("_exclude"), F.col("value").alias("_value")))
    return edited


def custom_pareto(base: DataFrame, dimension: str = "machine", metric: str = "minutes", top: int | None = None,
                  cut: float = 80, highlight: str = "cut", overrides: DataFrame | None = None,
                  extras: DataFrame | None = None) -> DataFrame:
    """Pareto by any dimension and metric with overrides, extra rows, top-N and highlighted rows."""
    rows = _with_overrides(regroup(base, dimension), overrides, extras)
    computed = {"minutes": calc.as_double("minutes"), "count": calc.as_double("count"),
                "mttr": F.when(F.col("count") > 0, calc.as_double("minutes") / F.col("count")).otherwise(0.0)}[metric]
    rows = rows.withColumn("value", F.coalesce("_value", computed)).filter(~F.col("_exclude") & (F.col("value") > 0))\
        .drop("_exclude", "_value", "minutes")
    if top:
        rows = rows.orderBy(F.desc("value"), "label", "key").limit(top)
    exact = F.col("value").cast("decimal(30,6)")
    if dimension == "mode" and not top:
        rows = running_total(rows, [F.desc("value"), F.col("label"), F.col("key")], {"_running": exact})
        total = rows.agg(F.sum(exact).alias("_total"))
        rows = rows.join(F.broadcast(total)).withColumn("position", F.col("_position"))
    else:
        order = _whole().orderBy(F.desc("value"), "label", "key")
        rows = rows.withColumns({
            "_running": F.sum(exact).over(order.rowsBetween(Window.unboundedPreceding, 0)),
            "_total": F.sum(exact).over(_whole()), "position": F.row_number().over(order).cast("bigint")})
    before = calc.as_double(F.col("_running") - exact) * 100 / calc.as_double("_total")
    strong = F.col("position") <= 3 if highlight == "top3" else (F.col("position") == 1) | (before < cut)
    return rows.select("key", "label", "sub", "count", "value", "position", F.least(
        F.lit(100.0), calc.as_double("_running") * 100 / calc.as_double("_total")).alias("cumulative"),
        strong.alias("highlight"))


def custom_jack_knife(base: DataFrame, dimension: str = "machine", cut_mode: str = "mean",
                      cuts: tuple[float, float] | None = None, overrides: DataFrame | None = None,
                      extras: DataFrame | None = None) -> DataFrame:
    """F15 + F16: Jack-Knife by any dimension with mean, median or manual cuts over the live rows."""
    rows = _with_overrides(regroup(base, dimension), overrides, extras)
    live = rows.filter(~F.col("_exclude") & (F.col("count") > 0))\
        .withColumn("mttr", calc.as_double("minutes") / F.col("count"))
    if cut_mode == "manual":
        cut = live.sparkSession.range(1).select(F.lit(float(cuts[0])).alias("q_cut"), F.lit(float(cuts[1])).alias("mttr_cut"))
    elif cut_mode == "median":
        cut = live.agg(F.percentile("count", 0.5).alias("q_cut"), F.percentile("mttr", 0.5).alias("mttr_cut"))
    else:
        cut = live.agg(F.avg("count").alias("q_cut"),
                       (calc.as_double(F.sum("minutes")) / F.sum("count")).alias("mttr_cut"))
    return live.join(F.broadcast(cut)).select(
        "key", "label", "sub", "count", calc.as_double("minutes").alias("minutes"), "mttr", "q_cut", "mttr_cut",
        calc.quadrant(F.col("count"), F.col("mttr"), F.col("q_cut"), F.col("mttr_cut")).alias("category"))


def iso_curve(machines: DataFrame, points: int = 40, log: bool = True) -> DataFrame:
    """points of equal downtime (q * mttr = product of the cuts) across the plotted range."""
    box = machines.agg(F.max("count").alias("max_q"), F.min("count").alias("min_q"), F.max("q_cut").alias("q_cut"),
                       F.max("mttr_cut").alias("mttr_cut"))
    step = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    i = F.col("i")
    q = F.col("min_q") * F.pow(F.col("max_q") / F.col("min_q"), i / (points - 1)) if log \
        else F.greatest(F.lit(0.05), F.col("max_q") * (i + 1) / points)
    return box.select("*", step.alias("i")).select(F.col("i").cast("bigint").alias("i"), q.alias("q"),
                                                   (F.col("q_cut") * F.col("mttr_cut") / q).alias("mttr"))


# ---- F7, E23, F10: failures --------------------------------------------------------------------------------

def failure_table(stops: DataFrame, mode: str = "events", within: list[str] | None = None) -> DataFrame:
    """F7 + E23: failure classes with shares, MTTR, quadrant and their three most frequent machines.

    ``within`` computes one independent table per value of those columns (F10).
    """
    within = within or []
    over = Window.partitionBy(*within)
    keyed = stops.withColumn("key", F.coalesce("failure_class", F.lit(fv.NO_MODE)))
    table = keyed.groupBy(*within, "key").agg(*_sums(mode))
    table = _cuts(table.withColumn("mttr", calc.ratio("minutes", "count")), None, over)
    pick = Window.partitionBy(*within, "key").orderBy(F.desc("n"), "equipamento")
    machine = keyed.groupBy(*within, "key", "equipamento").agg(F.count(F.lit(1)).alias("n")) if "equipamento" not in within \
        else keyed.groupBy(*within, "key").agg(F.count(F.lit(1)).alias("n"))
    top = (machine.withColumn("_rank", F.row_number().over(pick)).filter("_rank <= 3")
           .groupBy(*within, "key").agg(F.array_sort(F.collect_list(F.struct("_rank", "equipamento", "n"))).alias("_top"))
           .select(*within, "key", F.array_join(F.transform("_top", lambda m: F.concat_ws(
               ":", m["equipamento"], m["n"].cast("string"))), ", ").alias("machines")))
    return (_ranked(table, "key", over, close=False)
            .withColumn("category", calc.quadrant(F.col("count"), F.col("mttr"), F.col("q_cut"), F.col("mttr_cut")))
            .withColumn("name", text.display_label("key")).withColumn("minutes", calc.as_double("minutes"))
            .join(top, [*within, "key"], "left"))


def drill_tables(stops: DataFrame, mode: str = "events", reach: float = 80.0) -> DataFrame:
    """the failure table of every machine up to ``reach`` percent cumulative (the first machine always)."""
    chosen = machine_table(stops, mode).filter((F.col("position") == 1) | (F.col("cumulative") <= reach + 1e-9)).select(
        F.col("unit").alias("centro"), F.col("line").alias("linha"), F.col("name").alias("equipamento"),
        F.col("position").alias("machine_position"), F.col("short"))
    drilled = failure_table(stops.join(chosen.select(*fv.MACHINE_FIELDS), fv.MACHINE_FIELDS, "left_semi"), mode,
                            fv.MACHINE_FIELDS)
    return drilled.join(chosen, fv.MACHINE_FIELDS)


def tta_table(ranked: DataFrame, min_rows: int = 40) -> DataFrame:
    """sequence, running minutes, cumulative share, minutes inside the 80 %; padded with numbered blank rows."""
    order = _whole().orderBy("position")
    amount = F.col("minutes").cast("decimal(30,2)")
    running = F.sum(amount).over(order.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum(amount).over(_whole())
    share = calc.as_double(running) / F.when(total == 0, F.lit(1.0)).otherwise(calc.as_double(total))
    rows = ranked.select(F.col("position").alias("seq"), F.col("short").alias("item"), "minutes", "count", "mttr",
                         calc.as_double(running).alias("tta"), share.alias("share"),
                         F.when(share <= 0.8 + 1e-9, F.col("minutes")).alias("in_80"), F.upper("category").alias("category"))
    blank = ranked.sparkSession.range(1, min_rows + 1).select(F.col("id").alias("seq"))
    return rows.join(blank, "seq", "full_outer")


# ---- E25: headline values -------------------------------------------------------------------------------------

def headline_values(stops: DataFrame, mode: str = "events") -> DataFrame:
    """Top-3 concentration, worst machine, critical-chronic count, top identified class, unidentified count."""
    machines = machine_table(stops, mode)
    amount = F.col("minutes").cast("decimal(30,2)")
    by_machine = machines.agg(
        (calc.as_double(F.coalesce(F.sum(F.when(F.col("position") <= 3, amount)), F.lit(0))) * 100
         / calc.as_double(F.sum(amount))).alias("top3_share"),
        F.min_by("name", "position").alias("worst_machine"), F.max("minutes").alias("worst_minutes"),
        F.count_if(F.col("category") == fv.QUADRANTS[0]).alias("critical_chronic"))
    classes = failure_table(stops, mode)
    by_class = classes.agg(
        F.coalesce(F.min_by("name", F.when(F.col("key") != fv.NO_MODE, F.col("position"))), F.min_by("name", "position"))
        .alias("top_class"),
        F.coalesce(F.max(F.when(F.col("key") == fv.NO_MODE, F.col("count"))), F.lit(0)).alias("unidentified"))
    return by_machine.join(F.broadcast(by_class))


# ---- F13: share inside the line --------------------------------------------------------------------------------

def share_in_line(stops: DataFrame) -> DataFrame:
    """per (line, machine) occurrences, minutes, points and share of all the line's stops.

    The line total counts stops without a machine too; a null line has no share.
    """
    grouped = stops.groupBy("linha", "equipamento").agg(
        F.count(F.lit(1)).alias("total_ocorrencias"),
        F.coalesce(F.sum("minutos_parada"), F.lit(0)).cast("decimal(30,2)").alias("_minutes"),
        F.coalesce(F.sum("pts_efic_perdidos"), F.lit(0)).cast("decimal(30,2)").alias("_points"))
    line_total = F.sum("total_ocorrencias").over(Window.partitionBy("linha"))
    share = F.when(F.col("linha").isNotNull(), calc.hundredths(
        (F.col("total_ocorrencias").cast("decimal(38,0)") * 10000), line_total.cast("decimal(38,0)")))
    return (grouped.withColumn("percentual_linha", share)
            .filter(F.col("equipamento").isNotNull() & (F.col("equipamento") != ""))
            .select("linha", "equipamento", "total_ocorrencias", calc.as_double("_minutes").alias("total_minutos_parada"),
                    calc.as_double("_points").alias("total_pts_perdidos"), "percentual_linha"))
