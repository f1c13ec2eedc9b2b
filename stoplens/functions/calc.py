"""Numbers, dates, intervals, bands and hashes as native column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from stoplens import fixed_values as fv

WHOLE = "decimal(38,0)"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


# ---- exact rounding ----------------------------------------------------------------------------

def cents(amount: Column | str) -> Column:
    """A two-decimal amount as a whole number of hundredths."""
    return (_col(amount).cast("decimal(30,2)") * 100).cast(WHOLE)


def hundredths(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator as hundredths rounded half up to a whole; 0 when the denominator is 0."""
    top, bottom = (numerator * 2).cast(WHOLE) + denominator.cast(WHOLE), (denominator * 2).cast(WHOLE)
    return F.when(denominator != 0, F.call_function("div", top, bottom).cast("double") / 100).otherwise(F.lit(0.0))


def ratio(amount: Column | str, count: Column | str) -> Column:
    """amount / count to 2 decimals (mean time to repair)."""
    return hundredths(cents(amount), _col(count).cast(WHOLE))


def percent_2(amount: Column | str, total: Column | str) -> Column:
    """100 * amount / total to 2 decimals."""
    return hundredths((cents(amount) * 10000).cast(WHOLE), cents(total))


def percent_1(part: Column | str, total: Column | str) -> Column:
    """100 * part / total to 1 decimal for whole counts; 0 when total is 0."""
    part, total = _col(part).cast(WHOLE), _col(total).cast(WHOLE)
    tenths = F.call_function("div", ((part * 2000).cast(WHOLE) + total).cast(WHOLE), (total * 2).cast(WHOLE))
    return F.when(total != 0, tenths.cast("double") / 10).otherwise(F.lit(0.0))


def as_double(amount: Column | str) -> Column:
    return _col(amount).cast("double")


# ---- number and date parsing -------------------------------------------------------------------

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def pt_number(value: Column | str) -> Column:
    """With a comma, dots are thousands and the comma is the decimal mark; bad text is null."""
    text = F.trim(_col(value))
    text = F.when(F.contains(text, F.lit(",")), F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))\
        .otherwise(text)
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def loose_number(value: Column | str) -> Column:
    """Comma read as decimal mark, '' and bad text are null."""
    text = F.replace(F.trim(_col(value)), F.lit(","), F.lit("."))
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def shift_value(value: Column | str) -> Column:
    """B24: '2.0' -> '2'; text that is no single number stays."""
    number = F.when(_col(value).rlike(NUMBER), _col(value).try_cast("double"))
    return F.coalesce(number.cast("bigint").cast("string"), F.coalesce(_col(value), F.lit("")))


def multi_date(value: Column | str) -> Column:
    """Day serials 1..100000 and five written forms of a date; anything else is null."""
    text = F.trim(F.coalesce(_col(value), F.lit("")))
    serial = F.when(text.rlike(r"^\d+(\.\d+)?$"), text.try_cast("double"))
    whole = F.floor(serial).cast("int")
    from_serial = F.date_add(F.lit("1899-12-30").cast("date"), whole + F.when(whole < 60, 1).otherwise(0))
    head = F.substring_index(F.substring_index(text, "T", 1), " ", 1)
    forms = [(r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
             (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"), (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d")]
    parsed = [F.when(head.rlike(shape), F.try_to_date(head, form))
              for shape, form in forms]
    short = F.when(head.rlike(r"^\d{1,2}/\d{1,2}/\d{2}$"), F.try_to_date(head, "d/M/yy"))
    pivoted = F.when(F.year(short) >= 2069, F.add_months(short, -1200)).otherwise(short)
    return F.when((serial >= 1) & (serial <= 100000), from_serial).otherwise(F.coalesce(*parsed, pivoted))


def iso_text(value: Column | str) -> Column:
    """B2: timestamp as 'yyyy-MM-dd HH:mm:ss'."""
    return F.date_format(_col(value), "yyyy-MM-dd HH:mm:ss")


# ---- intervals ---------------------------------------------------------------------------------

INTERVAL = r"(\d{1,2}):(\d{2})\s*-\s*(\d{1,2}):(\d{2})"


def interval_bounds(value: Column | str) -> tuple[Column, Column]:
    """Minutes of day of both ends; an end not after its start is on the next day. Null when absent."""
    part = [F.regexp_extract(_col(value), INTERVAL, i) for i in range(1, 5)]
    number = [F.when(p != "", p).cast("int") for p in part]
    start, end = number[0] * 60 + number[1], number[2] * 60 + number[3]
    return start, F.when(end > start, end).otherwise(end + 1440)


# ---- bands and quadrants --------------------------------------------------------------------------

def band(confidence: Column | str) -> Column:
    """B31."""
    value = _col(confidence)
    return F.when(value >= fv.BAND_HIGH, "Alta").when(value >= fv.BAND_MEDIUM, "Média").otherwise("Baixa")


def quadrant(count: Column, mttr: Column, count_cut: Column, mttr_cut: Column, plain: bool = False) -> Column:
    """Frequent and slow / slow / frequent / neither."""
    both, slow, frequent, neither = fv.QUADRANTS_PLAIN if plain else fv.QUADRANTS
    often, long = count >= count_cut, mttr >= mttr_cut
    return F.when(often & long, both).when(long, slow).when(often, frequent).otherwise(neither)


def score_tone(score: Column | str) -> Column:
    """B34."""
    return F.when(_col(score) >= 85, "ok").when(_col(score) >= 70, "warn").otherwise("bad")


def wilson(hits: Column | str, total: Column | str, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson score interval of a proportion."""
    n = _col(total).cast("double")
    p = _col(hits).cast("double") / n
    spread = 1 + z * z / n
    center = (p + z * z / (2 * n)) / spread
    half = F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) * z / spread
    low, high = F.greatest(F.lit(0.0), center - half), F.least(F.lit(1.0), center + half)
    return (F.when(n > 0, low).otherwise(F.lit(0.0)), F.when(n > 0, high).otherwise(F.lit(0.0)))


# ---- periods and labels ----------------------------------------------------------------------------

def month_name(day: Column) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in fv.MONTHS]), F.month(day))


def br_date(day: Column | str) -> Column:
    return F.date_format(_col(day), "dd/MM/yyyy")


def period_label(start: Column | str, end: Column | str) -> Column:
    """One day or 'start - end'; no start is the whole period."""
    start, end = _col(start), _col(end)
    return F.when(start.isNull(), "todo o período").when(start == end, br_date(start))\
        .otherwise(F.concat_ws(" - ", br_date(start), br_date(end)))


def period_title(start: Column | str, end: Column | str) -> Column:
    """Whole months are named, other spans are dates."""
    start, end = _col(start), _col(end)
    name = lambda d: F.concat(month_name(d), F.lit(" de "), F.year(d).cast("string"))
    whole = (F.dayofmonth(start) == 1) & (F.last_day(end) == end)
    months = F.when(name(start) == name(end), name(start)).otherwise(F.concat(name(start), F.lit(" à "), name(end)))
    return F.when(start.isNull(), "Todo o período").when(start == end, br_date(start)).when(whole, months)\
        .otherwise(F.concat(br_date(start), F.lit(" – "), br_date(end)))


def day_group(day: Column | str, today: Column) -> Column:
    """Today, yesterday, last 7 days, upcoming, else month and year."""
    gap = F.datediff(today, _col(day))
    return F.when(gap == 0, "Hoje").when(gap == 1, "Ontem").when((gap > 1) & (gap < 7), "Últimos 7 dias")\
        .when(gap < 0, "Próximos dias")\
        .otherwise(F.concat(month_name(_col(day)), F.lit(" de "), F.year(_col(day)).cast("string")))


def period_range(mode: str, day: Column | str) -> tuple[Column, Column]:
    """First and last day of the day, ISO week, month or year that holds ``day``."""
    day = _col(day)
    if mode == "day":
        return day, day
    if mode not in ("week", "month", "year"):
        raise ValueError("mode must be day, week, month or year")
    first = F.trunc(day, mode)
    last = {"week": F.date_add(first, 6), "month": F.last_day(day),
            "year": F.make_date(F.year(day), F.lit(12), F.lit(31))}[mode]
    return first, last


def comparison_ranges(preset: str, anchor: Column | str) -> tuple[Column, Column, Column, Column]:
    """(a_from, a_to, b_from, b_to) for the presets 7d, 30d, week and month."""
    anchor = _col(anchor)
    if preset in ("7d", "30d"):
        n = int(preset[:-1])
        b_from = F.date_sub(anchor, n - 1)
        return F.date_sub(b_from, n), F.date_sub(b_from, 1), b_from, anchor
    if preset == "week":
        monday = F.trunc(anchor, "week")
        return F.date_sub(monday, 7), F.date_sub(monday, 1), monday, F.date_add(monday, 6)
    if preset == "month":
        first = F.trunc(anchor, "month")
        before = F.date_sub(first, 1)
        return F.trunc(before, "month"), before, first, F.last_day(anchor)
    raise ValueError("preset must be 7d, 30d, week or month")


# ---- hashes --------------------------------------------------------------------------------------------

def source_value(field: str, value: Column) -> Column:
    """Two-decimal numbers (half up), ISO dates, trimmed text; null stays null."""
    if field in fv.NUMERIC_FIELDS:
        return F.coalesce(value.try_cast("decimal(30,2)").cast("string"), F.trim(value.cast("string")))
    if field == "data_inicio":
        return F.replace(F.trim(value.cast("string")), F.lit("T"), F.lit(" "))
    return F.trim(value.cast("string"))


def row_hash(fields: list[str]) -> Column:
    """SHA-256 of one row's source values; null and '' differ."""
    parts = [F.coalesce(F.concat(F.lit("="), source_value(f, F.col(f))), F.lit("-")) for f in fields]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def content_hash(hash_column: Column | str) -> Column:
    """B26 as an aggregate: a multiset hash that ignores row order and keeps duplicates.

    The row digests are added in four 60-bit lanes, so partial sums combine before the shuffle and no task
    ever holds the rows of a batch, whatever its size.
    """
    digest = _col(hash_column)
    lanes = [F.sum(F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")) for i in range(4)]
    return F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), *[s.cast("string") for s in lanes]), 256)


def item_key(analysis: Column | str, key: Column | str) -> Column:
    """B27."""
    return F.sha1(F.concat_ws("|", _col(analysis), _col(key)))
