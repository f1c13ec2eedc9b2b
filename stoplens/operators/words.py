"""Word repair as a dictionary (B6, B7, K4): every distinct word once, texts by join.

Distinct texts give the distinct words that may need repair. A word meets only the vocabulary words that can reach the
ratio: those of a fitting length (or first letter), whose letters in common, counted with repeats, are enough. The
Ratcliff-Obershelp ratio, which SQL lacks, runs on these pairs alone, in Arrow batches; the best entry of each word
goes back to the texts as one map per distinct text.
"""

from collections.abc import Callable
from dataclasses import dataclass
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stoplens import fixed_values as fv
from stoplens.functions import text
from stoplens.functions.tokens import note_vocabulary
from stoplens.operators.skew import lookup_join
from stoplens.session import staged

ROUNDING = 1e-9


@dataclass(frozen=True)
class Repair:
    """Which words may be repaired, to which vocabulary, and how close they must come."""
    vocabulary: tuple[str, ...]
    cutoff: float
    prefixes: bool  # K4: same first letter, lengths within 3, the word's start may stand for the word; words that begin with a vocabulary word stay

    def suspicious(self, word: Column) -> Column:
        if not self.prefixes:
            return (F.length(word) >= 5) & ~word.isin(list(self.vocabulary))
        known = F.exists(F.array(*[F.lit(v) for v in self.vocabulary]), lambda v: word.startswith(v))
        return (F.length(word) >= 6) & ~known

    def ratios(self) -> Callable[[Column, Column], Column]:
        prefixes = self.prefixes

        def once(word: str, entry: str) -> float:
            if not prefixes:
                return SequenceMatcher(None, entry, word).ratio()
            return max(SequenceMatcher(None, word, entry).ratio(), SequenceMatcher(None, word[:len(entry)], entry).ratio())

        def batch(words: pd.Series, entries: pd.Series) -> pd.Series:
            return pd.Series([once(w, e) for w, e in zip(words, entries, strict=True)], dtype=float)
        return F.pandas_udf(batch, "double")


def note_repair() -> Repair:
    """Words of 5 or more characters outside the synonym vocabulary, ratio 0.88."""
    return Repair(tuple(note_vocabulary()), fv.TOKEN_REPAIR_RATIO, False)


def catalog_repair(vocabulary: list[str]) -> Repair:
    """K4: words of 6 or more characters that begin with no catalog word, ratio 0.84."""
    return Repair(tuple(sorted(vocabulary)), fv.TERM_REPAIR_RATIO, True)


def _letters(word: Column) -> Column:
    """The characters of a word with their count so far: two words share as many of these as letters with repeats."""
    each = F.filter(F.split(word, ""), lambda c: c != "")
    return F.transform(each, lambda c, i: F.concat(c, F.size(F.filter(F.slice(each, 1, i + 1), lambda d: d == c)).cast("string")))


def candidates(words: DataFrame, rule: Repair) -> DataFrame:
    """(word, entry): the pairs whose ratio may reach the cutoff."""
    spark = words.sparkSession
    entries = spark.createDataFrame([(v,) for v in rule.vocabulary], "entry string").withColumns({"entry_letters": _letters(F.col("entry")), "entry_size": F.length("entry")})
    sized = words.withColumns({"letters": _letters(F.col("word")), "size": F.length("word")})
    if rule.prefixes:
        sized, entries = sized.withColumn("key", F.substring("word", 1, 1)), entries.withColumn("key", F.substring("entry", 1, 1))
        fits = F.abs(F.col("size") - F.col("entry_size")) <= 3
        whole = F.least("size", "entry_size") + F.col("entry_size")
    else:
        low, high = rule.cutoff / (2 - rule.cutoff), (2 - rule.cutoff) / rule.cutoff
        lengths = F.sequence(F.ceil(F.col("size") * low - ROUNDING).cast("int"), F.floor(F.col("size") * high + ROUNDING).cast("int"))
        sized, entries = sized.withColumn("key", F.explode(lengths)), entries.withColumn("key", F.col("entry_size"))
        fits = F.lit(True)
        whole = F.col("size") + F.col("entry_size")
    shared = F.size(F.array_intersect("letters", "entry_letters"))
    met = sized.join(F.broadcast(entries), "key")  # the vocabulary is a list of the caller's, some hundred words
    return met.where(fits & (2 * shared >= rule.cutoff * whole - ROUNDING)).select("word", "entry")


def repairs(words: DataFrame, rule: Repair) -> DataFrame:
    """(word, repaired) of the distinct words that have an entry close enough: the closest, the greatest of equals."""
    scored = candidates(words, rule).withColumn("ratio", rule.ratios()(F.col("word"), F.col("entry"))).where(F.col("ratio") >= rule.cutoff)
    return scored.groupBy("word").agg(F.max(F.struct("ratio", "entry"))["entry"].alias("repaired"))


def repaired_texts(texts: DataFrame, key: str, rule: Repair) -> DataFrame:
    """Distinct texts (column ``key``, words separated by single spaces) with ``repaired``, the array of their words after
    repair."""
    words = F.split(key, " ")
    asked = texts.select(key, F.explode(F.array_distinct(F.filter(words, rule.suspicious))).alias("word"))
    fixed = staged(repairs(asked.select("word").distinct(), rule), "word-repairs")
    maps = lookup_join(asked, fixed, ["word"], "inner").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("word", "repaired"))).alias("_fixes"))
    joined = texts.join(maps, key, "left")
    return joined.select(*texts.columns, F.when(F.col("_fixes").isNull(), words).otherwise(
        F.transform(words, lambda w: F.coalesce(F.try_element_at("_fixes", w), w))).alias("repaired"))


def with_normal_notes(rows: DataFrame, note: Column, name: str = "observacao_normalizada") -> DataFrame:
    """Rows with the normal form of ``note``; every distinct note is worked out once."""
    keyed = rows.withColumn("_words", F.array_join(text.note_tokens(note), " "))
    notes = staged(keyed.select("_words").distinct(), "distinct-notes")
    normal = repaired_texts(notes, "_words", note_repair()).select("_words", text.fold_synonyms(F.array_join("repaired", " ")).alias(name))
    return lookup_join(keyed.drop(name), staged(normal, "normal-notes"), ["_words"], "inner").drop("_words")
