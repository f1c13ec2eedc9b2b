"""Quality rules as a bitmask ledger: every rule is evaluated once, policies and ablations only read the bits.

Null texts count as empty (no words); equal rows get equal rows; an empty table gives an empty ledger; extra columns
pass through unless they carry the name of a ledger column, which then wins.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stoplens.llm.common import WORD, bind

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_alpha_words")
#: Rules in bit order: name and the condition under which a document fails. Integers only, so no rounding decides.
RULES = [
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 10 * n_words"),
    ("repeated_lines", "100 * n_dup_lines > 40 * n_lines"),
    ("short_words", "100 * word_chars < 250 * n_words"),
    ("long_words", "100 * word_chars > 1200 * n_words"),
    ("few_letters", "100 * n_alpha_words < 70 * n_words"),
]
BASE = ("few_words", "repeated_words")
#: Versioned policies: a document is kept if it fails none of the rules named.
POLICIES = {"v1": BASE, "v2": (*BASE, "symbols", "repeated_lines"), "v3": tuple(name for name, _ in RULES)}
VERSION = "v3"


def mask(rules) -> int:
    """Bits of the named rules; a name that is not in RULES is an error."""
    names = [name for name, _ in RULES]
    return sum(1 << names.index(rule) for rule in rules)


def _repeats(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more, counted once each.

    Windows are sorted by hash, equal neighbours mark the repeated ones, and their starts, sorted, cover three words
    each less what the next start covers again.
    """
    def starts(w):
        at = F.sequence(F.lit(0), F.size(w) - 3)
        return F.array_sort(F.transform(at, lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("i"))))

    def repeated(s):
        last = F.size(s) - 1
        twin = lambda i: ((i > 0) & (s[F.greatest(i - 1, F.lit(0))]["h"] == s[i]["h"])) | ((i < last) & (s[F.least(i + 1, last)]["h"] == s[i]["h"]))
        return F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), last), twin), lambda i: s[i]["i"]))

    def covered(p):
        first = F.struct(F.lit(-3).alias("at"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(p, first, lambda acc, i: F.struct(i.alias("at"), (acc["n"] + F.least(i - acc["at"], F.lit(3))).alias("n")), lambda acc: acc["n"])

    return F.when(F.size(words) >= 4, bind(starts(words), lambda s: bind(repeated(s), covered))).otherwise(F.lit(0).cast("long"))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measures (long) of ``text``."""
    value = F.coalesce(F.col(text), F.lit(""))
    docs = docs.drop(*[m for m in MEASURES if m != text])

    def of_words(w):
        return F.struct(F.size(w).cast("long").alias("n_words"),
                        F.aggregate(w, F.lit(0).cast("long"), lambda acc, x: acc + F.length(x)).alias("word_chars"),
                        F.size(F.filter(w, lambda x: x.rlike(r"\p{L}"))).cast("long").alias("n_alpha_words"),
                        _repeats(w).alias("n_repeat_words"))

    def of_lines(lines):
        return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    lines = F.filter(F.split(value, "\n", -1), lambda x: x.rlike(WORD))
    return docs.withColumns({
        "_words": bind(F.regexp_extract_all(value, F.lit(WORD), F.lit(0)), of_words), "_lines": bind(lines, of_lines),
        "n_symbols": (F.length(value) - F.length(F.translate(value, "#*$%&|<>", ""))).cast("long"),
    }).select("*", "_words.*", "_lines.*").drop("_words", "_lines")


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measures and ``fail_bits``: bit i is set if rule i fails."""
    bits = F.lit(0).cast("long")
    for i, (_, fails) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measured(docs, text).withColumn("fail_bits", bits)


def with_policy(rows: DataFrame, version: str = VERSION) -> DataFrame:
    """Apply a policy to a ledger: base_failed, kept and the policy's version. Nothing is measured again."""
    failed = lambda rules: F.col("fail_bits").bitwiseAND(F.lit(mask(rules)).cast("long")) != 0
    return rows.withColumns({"base_failed": failed(BASE), "kept": ~(failed(BASE) | failed(POLICIES[version])), "policy": F.lit(version)})


def ablations(rows: DataFrame, version: str = VERSION) -> DataFrame:
    """One row per rule of the policy: documents it fails, fails alone (kept again without it), and the total.

    The ledger is counted by its bits first (at most 2^rules rows), then each count is dealt to the rules by mask.
    """
    policy = mask(POLICIES[version])
    counts = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy).cast("long")).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << i).cast("long").alias("bit"))
                      for i, (name, _) in enumerate(RULES) if name in POLICIES[version]])
    return counts.select("*", F.explode(rules).alias("r")).groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("failed_alone"), F.sum("n").alias("documents"))
