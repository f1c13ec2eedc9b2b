"""String-ratio repairs of single words.

The Ratcliff-Obershelp ratio has no native expression. Tables of notes go through :mod:`stoplens.operators.words`, where
each distinct word is worked out once; the column form here is for streams, which can't look at all their words: it
receives the words of a note, looks only at words outside the vocabulary, and remembers each word's repair for a batch.
"""

from collections.abc import Callable
from difflib import SequenceMatcher, get_close_matches

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from stoplens import fixed_values as fv
from stoplens.functions import text

MEMO = 200_000


def note_vocabulary() -> list[str]:
    """Synonym variations and the words of the multi-word ones."""
    variations = {v for v, _ in text.synonym_pairs()}
    return sorted(variations | {w for v in variations for w in v.split()})


def _mapped(repair: Callable[[str], str], limit: int = MEMO):
    """Arrow UDF over arrays of words; ships by value and keeps a bounded memo per task."""
    def words_repaired(words: pd.Series) -> pd.Series:
        memo = {}

        def once(word):
            if word not in memo:
                if len(memo) >= limit:
                    memo.clear()
                memo[word] = repair(word)
            return memo[word]
        return words.map(lambda row: None if row is None else [once(w) for w in row])
    return F.pandas_udf(words_repaired, "array<string>")


def repair_note_tokens(words: Column) -> Column:
    """Words of 5+ characters outside the vocabulary take the closest vocabulary entry at ratio >= 0.88."""
    vocabulary, cutoff = note_vocabulary(), fv.TOKEN_REPAIR_RATIO
    known = set(vocabulary)

    def repair(word: str) -> str:
        if len(word) < 5 or word in known:
            return word
        close = get_close_matches(word, vocabulary, n=1, cutoff=cutoff)
        return close[0] if close else word

    suspicious = F.exists(words, lambda w: (F.length(w) >= 5) & ~w.isin(vocabulary))
    return F.when(suspicious, _mapped(repair)(words)).otherwise(words)


def normal_note(value: Column | str) -> Column:
    """The whole note normaliser: tokens, word repair, synonyms."""
    return text.fold_synonyms(F.array_join(repair_note_tokens(text.note_tokens(value)), " "))


def string_ratio(a: Column, b: Column, least: float = fv.LABEL_SIMILARITY) -> Column:
    """Ratcliff-Obershelp ratio of two strings; 0 where the quick upper bound is already below ``least``."""
    def ratio(x: str, y: str) -> float:
        matcher = SequenceMatcher(None, x, y)
        return matcher.ratio() if matcher.quick_ratio() >= least else 0.0

    def ratios(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([ratio(x, y) for x, y in zip(left, right)], dtype=float)
    return F.pandas_udf(ratios, "double")(a, b)
