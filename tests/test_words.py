"""Word repair by dictionary against difflib, word by word."""

import random
from difflib import SequenceMatcher, get_close_matches

from pyspark.sql import functions as F

from stoplens import fixed_values as fv
from stoplens.functions.tokens import note_vocabulary
from stoplens.operators import words as W
from stoplens.operators.catalog import Catalog


def mutated(rng, vocabulary, n):
    out = {"", "A", "AAAAA", "ABCDEF" * 60, "ÇÃÕÉÍ", "12345"}
    while len(out) < n:
        word = list(rng.choice(vocabulary).replace(" ", ""))
        for _ in range(rng.randrange(4)):
            at, kind = rng.randrange(len(word) + 1), rng.randrange(4)
            if kind == 0:
                word.insert(at, rng.choice("AEIORST"))
            elif at < len(word) and kind == 1:
                word[at] = rng.choice("AEIORST")
            elif at < len(word) and kind == 2 and len(word) > 2:
                del word[at]
            elif at + 1 < len(word):
                word[at], word[at + 1] = word[at + 1], word[at]
        out.add("".join(word) + rng.choice(["", "", "S", "MENTO"]))
    return sorted(out)


def by_difflib(word, vocabulary, prefixes):
    if not prefixes:
        if len(word) < 5 or word in vocabulary:
            return word
        return (get_close_matches(word, vocabulary, n=1, cutoff=fv.TOKEN_REPAIR_RATIO) or [word])[0]
    if len(word) < 6 or word.startswith(tuple(vocabulary)):
        return word
    scored = [(max(SequenceMatcher(None, word, v).ratio(), SequenceMatcher(None, word[:len(v)], v).ratio()), v)
              for v in vocabulary if v[0] == word[0] and abs(len(v) - len(word)) <= 3]
    return max([s for s in scored if s[0] >= fv.TERM_REPAIR_RATIO], default=(0, word))[1]


def check(spark, rule, vocabulary):
    rng = random.Random(12)
    asked = mutated(rng, vocabulary, 700)
    texts = [" ".join(rng.choice(asked) for _ in range(rng.randrange(1, 9))) for _ in range(300)] + asked
    got = W.repaired_texts(spark.createDataFrame([(t,) for t in set(texts)], "t string").repartition(5), "t", rule).collect()
    changed = 0
    for r in got:
        want = [by_difflib(w, vocabulary, rule.prefixes) for w in r["t"].split(" ")]
        assert r["repaired"] == want, r["t"]
        changed += want != r["t"].split(" ")
    assert changed > 100 and len(got) == len(set(texts))


def test_note_words_equal_difflib(spark):
    check(spark, W.note_repair(), note_vocabulary())


def test_catalog_words_equal_difflib(spark):
    check(spark, W.catalog_repair(Catalog().vocabulary()), sorted(Catalog().vocabulary()))


def test_notes_by_dictionary_equal_the_column_form(spark):
    from stoplens.functions import tokens
    rows = [(i, n, "old") for i, n in enumerate(["ROLAMNETO ESTOURADO", "Vazando óleo (OS 30008216805)", "", None, "SENSORR sujo, sensorr", "ROLAMNETO ESTOURADO"])]
    df = spark.createDataFrame(rows, "i int, x string, observacao_normalizada string")
    got = W.with_normal_notes(df, F.col("x")).select("i", "observacao_normalizada").collect()
    want = df.select("i", tokens.normal_note("x").alias("n")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert W.with_normal_notes(df.limit(0), F.col("x")).count() == 0
