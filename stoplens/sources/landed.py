"""Reading landed exports (A1-A5): header search, alias mapping, validation with quarantine, labelled notes.

Files are delimited text, read once by :mod:`stoplens.sources.records`. Headers stay a table with one row per file, and
data rows pick their cells by the places it holds; no file's rows reach the driver.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stoplens import fixed_values as fv
from stoplens.functions import calc, text
from stoplens.operators.skew import lookup_join
from stoplens.operators.words import with_normal_notes
from stoplens.session import staged
from stoplens.sources.records import SEPARATORS, range_starts, read_lines, records, separator_text, split_cells

BAD_DATE = "data inválida"
BAD_MINUTES = "minutos de parada devem ser um número maior ou igual a zero"
NO_MACHINE = "linha e equipamento são obrigatórios"
ENDLESS = "célula entre aspas sem fim"
TEXT_FIELDS = [f for f in dict.fromkeys(fv.ALIASES.values()) if f not in ("data_inicio", "minutos_parada")]


def header_rows(lines: DataFrame, starts: DataFrame, required: list[str], names: Callable[[Column], Column], rows: int = fv.HEADER_SEARCH_ROWS) -> DataFrame:
    """One row per file: its header and separator, found among its first ``rows`` records.

    ``names`` turns cells into the array of the fields they name (null for others). A header names every required
    field; the earliest record wins, then the separator under which it names most. ``header`` is null where no record
    does; ``lacking`` then holds the shortest set of missing fields.
    """
    each = F.explode(F.array(*[F.lit(s) for s in range(len(SEPARATORS))]))
    heads = records(lines, starts.withColumn("separator", each), first=rows).where(F.col("text").isNotNull())
    heads = heads.withColumn("cells", split_cells(F.col("text"), separator_text(F.col("separator"))))
    heads = heads.withColumn("fields", names(F.col("cells")))
    lacking = F.array_sort(F.array_except(F.array(*[F.lit(f) for f in required]).cast("array<string>"), "fields"))
    named = F.size(F.filter("fields", lambda f: f.isNotNull()))
    heads = heads.withColumns({"lacking": lacking, "named": named})
    header = F.min(F.when(F.size("lacking") == 0, F.struct(
        F.col("number").alias("header_number"), (-F.col("named")).alias("rank"), "separator", F.col("cells").alias("titles"), "fields")))
    nearest = F.min(F.struct(F.size("lacking").alias("n"), "lacking"))
    return heads.groupBy("file").agg(header.alias("header"), nearest["lacking"].alias("lacking"))


def alias_names(aliases: dict[str, str]) -> Callable[[Column], Column]:
    """A2: the field that each title names, null for titles without one."""
    known = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return lambda cells: F.transform(cells, lambda c: F.try_element_at(known, text.header_key(c)))


def find_headers(lines: DataFrame, starts: DataFrame, required: list[str] | None = None, aliases: dict[str, str] | None = None,
                 rows: int = fv.HEADER_SEARCH_ROWS) -> DataFrame:
    """A1 + A2: (file, header_number, separator, titles, fields) of each file.

    Raises with the shortest set of missing fields when a file has no header, and when two columns mean the same; one
    row comes to the driver.
    """
    required = list(fv.REQUIRED) if required is None else required
    headers = staged(header_rows(lines, starts, required, alias_names(aliases or fv.ALIASES), rows), "landed-headers")
    known = F.filter("header.fields", lambda f: f.isNotNull())
    faults = headers.withColumn("twice", F.size(known) != F.size(F.array_distinct(known))).where("header IS NULL OR twice")
    for fault in faults.select("lacking", F.col("header").isNull().alias("missing")).orderBy("file").limit(1).collect():
        if not fault["missing"]:
            raise ValueError("Há duas colunas com o mesmo significado. Renomeie ou remova a coluna duplicada.")
        raise ValueError("Cabeçalhos não encontrados. Faltam: " + ", ".join(fv.REQUIRED.get(f, f) for f in fault["lacking"]))
    return headers.select("file", "header.*").drop("rank")


def _body(lines: DataFrame, starts: DataFrame, headers: DataFrame) -> DataFrame:
    """The records after each file's header, as cells beside the header's columns."""
    own = lookup_join(starts, headers.select("file", "separator"), ["file"], "inner")
    body = lookup_join(records(lines, own).drop("separator"), headers, ["file"], "inner").where(F.col("number") > F.col("header_number"))
    return body.withColumn("cells", split_cells(F.col("text"), separator_text(F.col("separator"))))


def _cell(field: str) -> Column:
    return F.get("cells", (F.array_position("fields", field) - 1).cast("int"))


def _rows(lines: DataFrame, starts: DataFrame, headers: DataFrame) -> DataFrame:
    """Data rows with raw field columns and the map of original cells."""
    body = _body(lines, starts, headers).where(F.col("text").isNull() | F.exists("cells", lambda c: F.trim(F.regexp_replace(c, r"\s+", " ")) != ""))
    title = lambda c, i: F.concat((i + 1).cast("string"), F.lit(" · "), F.when(c == "", "Coluna").otherwise(c))
    original = F.map_from_arrays(F.transform("titles", title), F.transform("titles", lambda c, i: F.coalesce(F.get("cells", i), F.lit(""))))
    return body.select("file", F.col("number").alias("source_row"), original.alias("original"), F.col("text").isNull().alias("endless"),
                       *[_cell(f).alias(f) for f in fv.SOURCE_FIELDS])


def validated(rows: DataFrame) -> DataFrame:
    """A3: typed rows with ``reject_reason`` (null = good) and defaults filled."""
    day = calc.multi_date("data_inicio")
    minutes = calc.pt_number("minutos_parada")
    amount = minutes.try_cast("decimal(12,2)")
    stripped = lambda f: F.regexp_replace(F.coalesce(F.col(f), F.lit("")), r"(?U)^\s+|\s+$", "")
    blank = lambda f: stripped(f) == ""
    reason = F.coalesce(
        F.when(F.col("endless"), ENDLESS) if "endless" in rows.columns else F.lit(None).cast("string"),
        F.when(day.isNull(), BAD_DATE),
        F.when(minutes.isNull() | F.isnan(minutes) | (minutes < 0) | (minutes == F.lit(float("inf"))) | amount.isNull(), BAD_MINUTES),
        F.when(blank("linha") | blank("equipamento"), NO_MACHINE))
    present = [f for f in TEXT_FIELDS if f in rows.columns and f not in fv.NUMERIC_FIELDS]
    clean = {f: stripped(f) for f in present}
    numbers = {f: calc.pt_number(f).try_cast("decimal(12,2)")
               for f in fv.NUMERIC_FIELDS if f in rows.columns and f != "minutos_parada"}
    out = rows.withColumns({"reject_reason": reason, "_day": day, "_minutes": amount}).withColumns({**clean, **numbers})
    return out.withColumns({
        "data_inicio": F.col("_day"), "minutos_parada": F.col("_minutes"),
        "centro": F.coalesce(F.nullif("centro", F.lit("")), F.lit("Não informada")),
        "tipo_parada": F.coalesce(F.nullif("tipo_parada", F.lit("")), F.lit("Não informado")),
    }).drop("_day", "_minutes", "endless")


def read_landed(spark: SparkSession, paths: list[str], strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """A1-A3: (stops, quarantine). Strict raises when any row is rejected, citing at most 20 of them.

    ``id`` numbers the good rows by file order; it is unique with ``file``. The typed rows are kept in the shared
    folder, so that stops and quarantine are cut from one parsing.
    """
    lines = read_lines(spark, paths)
    starts = range_starts(lines)
    rows = staged(validated(_rows(lines, starts, find_headers(lines, starts))), "landed-rows")
    bad = rows.filter("reject_reason IS NOT NULL").select("file", "source_row", "reject_reason")
    if strict:
        shown = bad.orderBy("file", "source_row").limit(20).collect()
        if shown:
            raise ValueError("Corrija a planilha antes de importar. " + " ".join(
                f"Linha {r['source_row']}: {r['reject_reason']}." for r in shown))
    good = rows.filter("reject_reason IS NULL").drop("reject_reason").withColumn("id", F.col("source_row"))
    return with_normal_notes(good, text.header_key("observacao_raw")), bad


def read_legacy(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, list[str]]:
    """A4: permissive scan: header is row 1, missing columns become warnings, text trimmed, numbers or null."""
    lines = read_lines(spark, paths)
    starts = range_starts(lines)
    headers = find_headers(lines, starts, [], fv.LEGACY_ALIASES, rows=1)
    wanted = F.array(*[F.lit(f) for f in fv.LEGACY_REQUIRED])
    missing = sorted(r["f"] for r in headers.select(F.explode(F.array_except(wanted, "fields")).alias("f")).distinct().collect())
    warnings = [f"Coluna esperada não encontrada no arquivo: '{f}'" for f in missing]
    rows = _rows(lines, starts, headers).where(~F.col("endless")).drop("endless")
    numbers = {f: calc.pt_number(f).try_cast("decimal(12,2)") for f in fv.NUMERIC_FIELDS}
    texts = {f: F.trim(F.col(f)) for f in fv.SOURCE_FIELDS if f not in fv.NUMERIC_FIELDS}
    return with_normal_notes(rows.withColumns({**numbers, **texts}), F.col("observacao_raw")), warnings


def read_labelled(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """A5: (labelled notes, per-file counts) from files with an OBSERVA* and a CLASSIFICA* column.

    Files without both headers in their first 30 rows are skipped.
    """
    lines = read_lines(spark, paths)
    starts = range_starts(lines)
    label = lambda c: F.when(text.plain_text(c).startswith("observa"), "note").when(text.plain_text(c).startswith("classifica"), "label")
    headers = staged(header_rows(lines, starts, ["note"], lambda cells: F.transform(cells, label)).where("array_contains(header.fields, 'label')")
                     .select("file", "header.*"), "landed-headers")
    body = _body(lines, starts, headers).where(F.exists("cells", lambda c: c != ""))
    rows = body.select("file", "number", F.coalesce(_cell("note"), F.lit("")).alias("note"),
                       F.trim(F.regexp_replace(F.coalesce(_cell("label"), F.lit("")), r"\s+", " ")).alias("label"))
    complete = (F.trim("note") != "") & (F.col("label") != "")
    counts = rows.groupBy("file").agg(F.count(F.lit(1)).alias("lidas"), F.count_if(~complete).alias("faltantes"),
                                      F.count_if(complete).alias("rows"))
    return rows.filter(complete), counts


def layout_of(original: Column) -> Column:
    """(header, field) pairs of the original-cell map in the order of their numeric prefix.

    An absent or empty map takes the default layout.
    """
    number = lambda k: F.coalesce(F.substring_index(k, " · ", 1).try_cast("int"), F.lit(0))
    alias = F.create_map(*[F.lit(x) for pair in fv.ALIASES.items() for x in pair])
    ordered = F.array_sort(F.transform(F.map_keys(original), lambda k: F.struct(number(k).alias("n"), F.substring_index(k, " · ", -1).alias("header"))))
    pairs = F.transform(ordered, lambda e: F.struct(e["header"].alias("header"), F.element_at(alias, text.header_key(e["header"])).alias("field")))
    default = F.array(*[F.struct(F.lit(h).alias("header"), F.lit(f).alias("field")) for h, f in fv.DEFAULT_LAYOUT])
    return F.when(F.coalesce(F.size(original), F.lit(0)) > 0, pairs).otherwise(default)
