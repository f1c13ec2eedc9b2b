"""Text column functions. All are native expressions: no Python runs per row."""

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from stoplens import fixed_values as fv

ORDER_NUMBER_WORD = r"\b\d{5,}\b"
LONG_NUMBER = r"(?:^|[\x00-/:-@\[-`{-\x7F])[0-9]{5,}+(?![^\x00-/:-@\[-`{-\x7F])"


def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """Accented letter -> plain letter, derived from Unicode decompositions of the Latin blocks."""
    source, target, expand = [], [], {}
    for code in [*range(0xA0, 0x250), *range(0x1E00, 0x1F00), 0x2007, 0x202F, 0x2026, 0x2116, 0x2122, 0xFB01, 0xFB02]:
        char = chr(code)
        plain = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        plain = plain.replace("⁄", "")
        if plain == char or not plain.isascii() or not plain:
            continue
        if len(plain) == 1:
            source.append(char)
            target.append(plain)
        else:
            expand[char] = plain
    return "".join(source), "".join(target), expand


FOLD_FROM, FOLD_TO, FOLD_EXPAND = _fold_tables()


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _spaces(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"(?U)\s+", " "))


def strip_accents(value: Column | str) -> Column:
    """Plain letters for accented ones, combining marks removed; other letters stay."""
    out = F.translate(_col(value), FOLD_FROM, FOLD_TO)
    for char, plain in FOLD_EXPAND.items():
        if char in "…№™ﬁﬂ½¼¾":
            out = F.replace(out, F.lit(char), F.lit(plain))
    return F.regexp_replace(out, r"\p{Mn}", "")


def to_ascii(value: Column | str) -> Column:
    """Like :func:`strip_accents`, then everything outside ASCII is dropped."""
    return F.regexp_replace(strip_accents(value), r"[^\x00-\x7F]", "")


def header_key(value: Column | str) -> Column:
    """B1: trimmed, upper case, no accents, single spaces; null becomes ''."""
    text = strip_accents(F.upper(F.regexp_replace(F.coalesce(_col(value), F.lit("")), r"(?U)^\s+|\s+$", "")))
    return F.regexp_replace(text, r"(?U)\s+", " ")


def key_text(value: Column | str) -> Column:
    """Single spaces, trimmed, upper case."""
    return F.upper(_spaces(F.coalesce(_col(value), F.lit(""))))


def strip_order_numbers(value: Column | str) -> Column:
    """A parenthesis holding a 5+ digit number goes whole, then loose 5+ digit numbers."""
    text = F.regexp_replace(_col(value), r"(?U)\([^)]*\b\d{5,}\b[^)]*\)", "")
    return F.regexp_replace(text, r"(?U)\b\d{5,}\b", "")


def note_tokens(value: Column | str) -> Column:
    """B6, first half: upper case, order numbers and punctuation out, stop words dropped."""
    text = strip_order_numbers(F.upper(F.coalesce(_col(value), F.lit(""))))
    text = _spaces(F.regexp_replace(text, r"(?U)[^\wÀ-ÿ\s²³¹]", " "))
    return F.filter(F.split(text, " "), lambda t: (t != "") & ~t.isin(fv.NOTE_STOPWORDS))


def synonym_pairs() -> list[tuple[str, str]]:
    """(variation, canonical) longest variation first, listing order kept among equals."""
    pairs = [(v, canon) for canon, group in fv.SYNONYMS.items() for v in group]
    return sorted(pairs, key=lambda pair: -len(pair[0]))


def fold_synonyms(value: Column | str) -> Column:
    """Whole-word variations become their canonical form; texts without one skip the chain."""
    text = _col(value)
    changing = [(v, c) for v, c in synonym_pairs() if v != c]
    folded = text
    for variation, canon in changing:
        folded = F.regexp_replace(folded, rf"(?U)\b{variation}\b", canon)
    any_variation = "|".join(v for v, _ in changing)
    return _spaces(F.when(text.rlike(rf"(?U)\b(?:{any_variation})\b"), folded).otherwise(text))


def catalog_text(value: Column | str) -> Column:
    """Upper ASCII letters, digits and single spaces, without 5+ digit numbers."""
    text = to_ascii(F.upper(F.coalesce(_col(value), F.lit(""))))
    text = F.regexp_replace(text, ORDER_NUMBER_WORD, " ")
    return F.trim(F.regexp_replace(F.regexp_replace(text, "[^A-Z0-9 ]", " "), " +", " "))


def is_meaningful(normal: Column | str) -> Column:
    """At least 3 characters remain once numbers and filler words are gone."""
    text = F.regexp_replace(_col(normal), r"\b\d+\b", " ")
    text = F.regexp_replace(text, r"\b(" + "|".join(fv.FILLER_WORDS) + r")\b", " ")
    return F.length(F.trim(F.regexp_replace(text, r"\s+", " "))) >= 3


def memory_key(value: Column | str) -> Column:
    """Catalog text when meaningful, else ''."""
    normal = catalog_text(value)
    return F.when((normal != "") & is_meaningful(normal), normal).otherwise(F.lit(""))


def plain_text(value: Column | str) -> Column:
    """Lower ASCII letters and digits separated by single spaces."""
    return F.trim(F.regexp_replace(F.lower(to_ascii(F.coalesce(_col(value), F.lit("")))), "[^a-z0-9]+", " "))


def model_text(value: Column | str) -> Column:
    """Plain text without 5+ digit numbers."""
    return F.trim(F.regexp_replace(F.regexp_replace(plain_text(value), ORDER_NUMBER_WORD, " "), " +", " "))


def without_long_numbers(value: Column | str) -> Column:
    """The text without 5+ digit numbers that stand between plain marks or the ends: their words are no part of any
    model text, so both texts have the same one."""
    return F.regexp_replace(F.coalesce(_col(value), F.lit("")), LONG_NUMBER, " ")


def has_content(model: Column | str) -> Column:
    """Words that are neither numbers nor junk add up to 4+ characters."""
    words = F.filter(F.split(_col(model), " "), lambda w: (w != "") & ~w.rlike("^[0-9]+$") & ~w.isin(fv.JUNK_WORDS))
    return F.length(F.array_join(words, " ")) >= 4


def class_label(value: Column | str) -> Column:
    """Single spaces, upper case, at most 120 characters."""
    return F.substring(key_text(value), 1, 120)


def is_no_info_label(label_key: Column | str) -> Column:
    """Labels that inform nothing."""
    return _col(label_key).rlike(fv.NO_INFO_LABEL)


def label_canon(label_key: Column | str) -> Column:
    """Stop words dropped, plural endings cut, words sorted."""
    words = F.filter(F.split(_col(label_key), " "), lambda w: (w != "") & ~w.isin(fv.LABEL_STOPWORDS))
    return F.array_join(F.array_sort(F.transform(words, lambda w: F.regexp_replace(w, "(oes|aes|ns|s)$", ""))), " ")


def order_number(value: Column | str) -> Column:
    """First run of 9-12 digits not touching other digits, else ''."""
    return F.coalesce(F.regexp_extract(_col(value), r"(?<!\d)(\d{9,12})(?!\d)", 1), F.lit(""))


def short_line(value: Column | str) -> Column:
    """LINHA003 -> L03; anything else unchanged."""
    digits = F.regexp_extract(F.coalesce(_col(value), F.lit("")), r"(?i)^\s*LINHA\s*0*(\d+)\s*$", 1)
    padded = F.when(F.length(digits) >= 2, digits).otherwise(F.lpad(digits, 2, "0"))
    return F.when(digits != "", F.concat(F.lit("L"), padded)).otherwise(F.coalesce(_col(value), F.lit("")))


def display_label(value: Column | str) -> Column:
    """Lower case with a capital first letter."""
    text = F.lower(F.trim(F.coalesce(_col(value), F.lit(""))))
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30))


def signal_words(value: Column | str) -> Column:
    """Words that say something about the failure."""
    return F.filter(F.split(catalog_text(value), " "), lambda w: (F.length(w) > 2) & ~w.rlike("^[0-9]+$")
                    & ~w.isin(fv.GENERIC_SIGNAL_WORDS))


def context_document(note: Column | str, machine: Column | str) -> Column:
    """Note text followed by one MAQ_<word> per machine word."""
    words = F.filter(F.split(catalog_text(machine), " "), lambda w: (F.length(w) > 2) & ~w.rlike("^[0-9]+$"))
    marks = F.array_join(F.transform(words, lambda w: F.concat(F.lit("MAQ_"), w)), " ")
    return F.trim(F.concat_ws(" ", catalog_text(note), marks))


def text_only(document: Column | str) -> Column:
    """The document without its machine words."""
    return F.array_join(F.filter(F.split(_col(document), " "), lambda w: (w != "") & ~w.startswith("MAQ_")), " ")


def context_value(value: Column | str) -> Column:
    """Single spaces, trimmed, upper case (null = '')."""
    return key_text(value)


def context_key(prefix: str = "") -> Column:
    """Struct of the six context fields, null when line or machine is empty."""
    values = {f: context_value(F.col(prefix + f)) for f in fv.CONTEXT_FIELDS}
    return F.when((values["linha"] != "") & (values["equipamento"] != ""),
                  F.struct(*[v.alias(f) for f, v in values.items()]))


def title_case(value: Column | str) -> Column:
    """A letter starts a word unless the character before it is a letter."""
    runs = F.regexp_extract_all(_col(value), F.lit(r"((?U)\p{L}+|\P{L}+)"), 1)
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)),
                                                             F.lower(F.substring(r, 2, 1 << 30)))), "")


def contains_folded(value: Column | str, needle: str) -> Column:
    """Case-insensitive substring test; null counts as ''."""
    return F.contains(F.lower(F.coalesce(_col(value), F.lit(""))), F.lit(needle.lower()))
