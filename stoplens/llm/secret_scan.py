"""Secret scans: fixed patterns, and a randomness test battery with false-discovery control. Built-in functions only.

Every long run of encoding symbols is a candidate. Its encoding is inferred from the symbols it uses; three statistics
of the symbol indexes are taken: chi-squared against a uniform alphabet, changes between the halves of the alphabet
(runs), and lag-one correlation. Each has exact moments under a uniform source and under ordinary text of the same
length (independent letters with natural frequencies). A second runs test counts the neighbours of which one is a letter
and one a digit: ordinary text holds its digits in groups, at most ``MIXED`` of its neighbours differ so. The p-value
under text is three times the smallest of the combined one, the chi-squared test's and the second runs test's; it is 1
where one of the first three rejects the uniform source, so that such a candidate can't be a discovery and the rate holds for what is reported. A
Benjamini-Hochberg step-up runs within each stratum of encoding and length. Short strings have wide text moments, so
the rule asks more of them. The text source writes in one case: joined words with capitals (FinalVersionOfTheBoard1999)
are no such text, and may be reported. A text source with capitals would take them out, but loses 15 to 24 of 50 random
base62, base64 and base64_url strings of 40 symbols.

Null texts count as empty and have no spans; equal rows are judged alike; an empty table gives an empty table and no
discovery; extra columns pass through unless they carry the name of an output column, which then wins.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stoplens.llm.common import bind

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run of hex digits, or of capitals after AKIA, is one greedy match, so its least length can stand in the pattern.
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
CANDIDATE = "[A-Za-z0-9+/_-]{20,}={0,2}"

DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()
#: Letters of English text per thousand, a to z.
LETTERS = [82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1]
#: Encoding, its alphabet, the pattern that a candidate must match whole (first fit wins), and the letters of ordinary text in it.
ENCODINGS = [
    ("hex", DIGITS + "abcdef", "[0-9a-f]+", DIGITS),
    ("hex_upper", DIGITS + "ABCDEF", "[0-9A-F]+", DIGITS),
    ("letters", LOWER, "[a-z]+", LOWER),
    ("base32", UPPER + "234567", "[A-Z2-7]+=*", UPPER),
    ("base36", DIGITS + LOWER, "[0-9a-z]+", LOWER),
    ("letters_mixed", UPPER + LOWER, "[A-Za-z]+", LOWER),
    ("base62", DIGITS + UPPER + LOWER, "[0-9A-Za-z]+", LOWER),
    ("base64", UPPER + LOWER + DIGITS + "+/", "[A-Za-z0-9+/]+=*", LOWER),
    ("base64_url", UPPER + LOWER + DIGITS + "-_", "[A-Za-z0-9_-]+=*", LOWER),
]
LENGTHS = (20, 32, 64, 128)
STEPS, TOP = 20, 800  # p-values are counted in steps of a twentieth of a decade, down to 1e-40
RATE = 0.01
REJECT = 3.3  # standard deviations at which a test rejects the uniform source
MIXED = 0.06  # share of neighbours in ordinary text that are a letter and a digit: one group of digits in some 33 symbols
DEPENDENCE = 0.3  # correlation that the combination assumes between the three statistics


def _text_moments(alphabet: str, letters: str) -> dict:
    """What one symbol of ordinary text contributes to each statistic."""
    k = len(alphabet)
    weights = [1] * 10 if letters == DIGITS else LETTERS
    q = {alphabet.index(c): w / sum(weights) for c, w in zip(letters, weights, strict=True)}
    s2, s3 = sum(p * p for p in q.values()), sum(p ** 3 for p in q.values())
    high = sum(p for i, p in q.items() if i >= k / 2)
    sigma = math.sqrt((k * k - 1) / 12)
    mean = sum(p * (i - (k - 1) / 2) / sigma for i, p in q.items())
    var = sum(p * ((i - (k - 1) / 2) / sigma) ** 2 for i, p in q.items()) - mean * mean
    change = 2 * high * (1 - high)
    return {"k": k, "s2": s2, "spread": max(s3 - s2 * s2, 0.0), "change": change, "mean2": mean * mean,
            "pair_var": (var + mean * mean) ** 2 - mean ** 4, "next_var": 2 * mean * mean * var}


def _pieces(text: Column, pattern: str, use) -> Column:
    """Array of ``use(hit, start, end)`` for the leftmost non-overlapping matches; ``use`` gives an array to append."""
    found = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))

    def walk(f):
        empty = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int,hit:string>>)").alias("out"))

        def step(acc, x):
            start = acc["at"] + F.length(x["gaps"])
            end = start + F.length(x["hits"])
            return F.struct(end.alias("at"), F.concat(acc["out"], use(x["hits"], start, end)).alias("out"))

        pairs = F.filter(F.arrays_zip(f["gaps"], f["hits"]), lambda x: x["hits"].isNotNull())
        return F.aggregate(pairs, empty, step, lambda acc: acc["out"])

    none = F.expr("cast(array() as array<struct<start:int,end:int,hit:string>>)")
    return F.when(text.rlike(pattern), bind(found, walk)).otherwise(none)


def _span(hit: Column, start: Column, end: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"), hit.alias("hit"))


def _if(test: Column, span: Column) -> Column:
    return F.when(test, F.array(span)).otherwise(F.expr("cast(array() as array<struct<start:int,end:int,hit:string>>)"))


def _kind(spans: Column, order: int, kind) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("rank"), s["end"].alias("end"),
                                                 (kind(s) if callable(kind) else F.lit(kind)).alias("kind")))


def base_spans(text: Column) -> dict[str, Column]:
    """Base spans by kind: arrays of (start, end, hit), code points, end exclusive, over the whole match."""
    value = lambda hit: F.length(F.regexp_extract(hit, ASSIGN, 2))
    return {"assign": _pieces(text, ASSIGN, lambda h, s, e: _if(value(h) >= 12, _span(h, s, e))),
            "access": _pieces(text, ACCESS, lambda h, s, e: F.array(_span(h, s, e))),
            "hex": _pieces(text, HEX, lambda h, s, e: F.array(_span(h, s, e)))}


def _case(encoding: Column, value) -> Column:
    out = F.lit(None)
    for name, *rest in reversed(ENCODINGS):
        out = F.when(encoding == name, value(name, *rest)).otherwise(out)
    return out


def _tail(z: Column) -> Column:
    """-log10 of an upper bound of the normal tail at ``z`` (0 for z below 0): a bound keeps the control valid."""
    return F.when(z > 0, (z * z / 2) / math.log(10) + math.log10(2)).otherwise(0.0)


def _excess(hits: Column, trials: Column, share: float) -> Column:
    """-log10 of Chernoff's bound of the binomial chance of ``hits`` or more among ``trials``."""
    q = hits / trials
    of = lambda part, whole: part * F.log(F.greatest(part, F.lit(1e-12)) / whole)
    return F.when(q > share, trials * (of(q, share) + of(1 - q, 1 - share)) / math.log(10)).otherwise(0.0)


def battery(token: Column) -> Column:
    """Struct (encoding, stratum, step) of a candidate string; step 0 is a p-value of 1."""
    encoding = F.lit(None).cast("string")
    for name, _, pattern, _ in reversed(ENCODINGS):
        encoding = F.when(token.rlike(f"^{pattern}$"), name).otherwise(encoding)
    moments = {name: _text_moments(alphabet, letters) for name, alphabet, _, letters in ENCODINGS}

    def measured(x):
        bare, kind = F.rtrim(x["token"], F.lit("=")), x["encoding"]
        alphabet = _case(kind, lambda _, a, *__: F.lit(a))
        symbols = F.split(bare, "")
        return F.struct(kind.alias("encoding"), F.length(bare).cast("double").alias("n"), symbols.alias("symbols"), bare.alias("bare"),
                        F.transform(symbols, lambda c: F.instr(alphabet, c) - 1).alias("at"))

    def statistics(x):
        k = _case(x["encoding"], lambda _, a, *__: F.lit(float(len(a))))
        squares = F.aggregate(F.array_distinct(x["symbols"]), F.lit(0.0), lambda acc, c: acc + F.pow(
            (F.length(x["bare"]) - F.length(F.replace(x["bare"], c, F.lit("")))).cast("double"), 2))
        neighbours = F.arrays_zip(F.slice(x["at"], F.lit(1), F.size(x["at"]) - 1).alias("a"), F.slice(x["at"], F.lit(2), F.size(x["at"]) - 1).alias("b"))
        middle = (k - 1) / 2
        return F.struct(
            x["encoding"].alias("encoding"), x["n"].alias("n"), k.alias("k"), (k / x["n"] * squares - x["n"]).alias("chi"),
            F.aggregate(neighbours, F.lit(0.0), lambda acc, p: acc + F.when((p["a"] > middle) != (p["b"] > middle), 1.0).otherwise(0.0)).alias("changes"),
            F.regexp_count(x["bare"], F.lit("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])")).cast("double").alias("mixed"),
            (F.aggregate(neighbours, F.lit(0.0), lambda acc, p: acc + (p["a"] - middle) * (p["b"] - middle)) / ((k * k - 1) / 12)).alias("serial"))

    def verdict(x):
        n, k = x["n"], x["k"]
        of = lambda key: _case(x["encoding"], lambda name, *_: F.lit(float(moments[name][key])))
        # under a uniform source; the chi-squared statistic is brought to a normal one by its cube root
        nu = (k - 1) * n / (n - 1)
        uniform_chi = (F.cbrt(x["chi"] / (k - 1)) - (1 - 2 / (9 * nu))) / F.sqrt(2 / (9 * nu))
        uniform_changes = (x["changes"] - (n - 1) / 2) / F.sqrt((n - 1) / 4)
        uniform_serial = x["serial"] / F.sqrt(n - 1)
        random = (F.abs(uniform_chi) < REJECT) & (F.abs(uniform_changes) < REJECT) & (F.abs(uniform_serial) < REJECT)
        # under ordinary text; positive values are on the random side
        text_chi = (k + k * (n - 1) * of("s2") - n - x["chi"]) / F.sqrt(2 * k * k * of("s2") * (1 - of("s2")) + 4 * k * k * (n - 1) * of("spread"))
        text_changes = (x["changes"] - (n - 1) * of("change")) / F.sqrt((n - 1) * F.greatest(of("change") * (1 - of("change")), 1 / n))
        text_serial = ((n - 1) * of("mean2") - x["serial"]) / F.sqrt((n - 1) * of("pair_var") + (n - 2) * of("next_var"))
        together = (text_chi + text_changes + text_serial) / math.sqrt(3 + 6 * DEPENDENCE)
        evidence = F.when(random, F.greatest(_tail(F.greatest(together, text_chi)), _excess(x["mixed"], n - 1, MIXED)) - math.log10(3)).otherwise(0.0)
        stratum = F.lit(0)
        for i, least in enumerate(LENGTHS):
            stratum = F.when(n >= least, i).otherwise(stratum)
        return F.struct(x["encoding"].alias("encoding"), F.concat_ws("/", x["encoding"], stratum.cast("string")).alias("stratum"),
                        F.greatest(F.least(F.floor(evidence * STEPS), F.lit(TOP)), F.lit(0)).cast("int").alias("step"))

    start = F.struct(token.alias("token"), encoding.alias("encoding"))
    return bind(start, lambda s: bind(measured(s), lambda m: bind(statistics(m), verdict)))


def candidates(text: Column) -> Column:
    spans = _pieces(text, CANDIDATE, lambda h, s, e: F.array(_span(h, s, e)))
    return F.filter(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), battery(s["hit"]).alias("test"))),
                    lambda s: s["test"]["encoding"].isNotNull())


def discovery_steps(docs: DataFrame, text: str = "text", rate: float = RATE) -> dict[str, int]:
    """Least step of -log10 p that counts as a discovery, by stratum, over all documents.

    Candidates are counted by stratum and step before anything moves; the driver gets at most one row per stratum
    (9 encodings, 4 lengths) and step (801). A count is taken at the step's largest p-value, which is the safe side.
    """
    tests = docs.select(F.explode(candidates(F.coalesce(F.col(text), F.lit("")))).alias("c")).select("c.test.*")
    rows = tests.groupBy("stratum", "step").agg(F.count(F.lit(1)).alias("n")).collect()
    steps: dict[str, int] = {}
    for stratum in {r["stratum"] for r in rows}:
        own = sorted(((r["step"], r["n"]) for r in rows if r["stratum"] == stratum), reverse=True)
        total, above = sum(n for _, n in own), 0
        for step, n in own:
            above += n
            if total * 10 ** (-step / STEPS) <= rate * above:
                steps[stratum] = step
    return steps


def secret_spans(docs: DataFrame, text: str = "text", rate: float = RATE) -> DataFrame:
    """``docs`` with n_assign, n_access, n_hex, ``base`` and ``secrets``: arrays of (start, rank, end, kind) in order.

    ``secrets`` holds the base spans and those discoveries of the battery (kinds ``random_<encoding>``) that touch none.
    """
    steps = discovery_steps(docs, text, rate)
    value = F.coalesce(F.col(text), F.lit(""))
    docs = docs.drop("n_assign", "n_access", "n_hex", "base", "secrets")
    found = docs.withColumns({f"_{kind}": column for kind, column in base_spans(value).items()})
    found = found.withColumn("base", F.array_sort(F.concat(_kind(F.col("_assign"), 0, "assign"), _kind(F.col("_access"), 1, "access"), _kind(F.col("_hex"), 2, "hex"))))
    if steps:
        least = F.create_map(*[F.lit(x) for pair in steps.items() for x in pair])
        wanted = F.filter(candidates(value), lambda c: (c["test"]["step"] >= F.element_at(least, c["test"]["stratum"]))
                          & ~F.exists(F.col("base"), lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
        more = _kind(wanted, 3, lambda s: F.concat(F.lit("random_"), s["test"]["encoding"]))
    else:
        more = F.slice(F.col("base"), 1, 0)
    out = found.withColumn("secrets", F.array_sort(F.concat(F.col("base"), more)))
    return out.withColumns({f"n_{k}": F.size(f"_{k}").cast("long") for k in ("assign", "access", "hex")}).drop("_assign", "_access", "_hex")


def joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """``text`` with every run of overlapping spans replaced by ``mark``; null stays null."""
    first = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(acc, s):
        gap = F.when(s["start"] >= acc["at"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(F.expr("cast(array() as array<string>)"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap).alias("out"))

    cut = F.aggregate(spans, first, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, cut).otherwise(text)


def redact_secrets(docs: DataFrame, text: str = "text", rate: float = RATE) -> DataFrame:
    """``docs`` with the secrets of ``text`` replaced; every row stays."""
    columns = docs.columns
    found = secret_spans(docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("_text")), "_text", rate)
    return found.withColumn("_text", redacted(F.col("_text"), F.col("secrets")))\
        .select(*[F.col("_text").alias(c) if c == text else F.col("row")[c].alias(c) for c in columns])
