"""The failure catalog as data (K1): cleaning, limits and the column it becomes inside queries."""

import json
import re
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stoplens import fixed_values as fv

KINDS = ("regra", "componente", "processo")
MAX_CLASSES, MAX_TERMS = 400, 60
CLASS_TYPE = ("array<struct<ord:int,kind:string,label:string,terms:array<string>,"
              "co_terms:array<string>,machine_terms:array<string>>>")
TERM_SCHEMA = "ord int, kind string, label string, role string, term string"


def plain_term(term: str) -> str:
    """A catalog term in the form notes take before matching (see ``text.catalog_text``)."""
    ascii_only = unicodedata.normalize("NFKD", str(term).upper()).encode("ascii", "ignore").decode()
    return " ".join(re.sub(r"[^A-Z0-9 ]", " ", re.sub(r"\b\d{5,}\b", " ", ascii_only)).split())


def _words(value) -> list[str]:
    parts = value.split(",") if isinstance(value, str) else value or []
    cleaned = [p for p in (str(part).strip().upper() for part in parts) if p]
    if len(cleaned) > MAX_TERMS:
        raise ValueError(f"a class takes at most {MAX_TERMS} terms per role")
    return cleaned


class Catalog:
    """A cleaned catalog. More than 400 classes or 60 terms per role are an error, so it always fits in a literal."""

    def __init__(self, classes: list[dict] | None = None, manifestations: dict | None = None):
        rows = fv.DEFAULT_CATALOG if classes is None else classes
        if len(rows) > MAX_CLASSES:
            raise ValueError(f"a catalog takes at most {MAX_CLASSES} classes")
        self.classes = []
        for row in rows:
            label = str(row.get("label") or "").strip().upper()
            terms = _words(row.get("terms"))
            if not label or not any(plain_term(t) for t in terms):
                continue
            kind = row.get("kind") if row.get("kind") in KINDS else "componente"
            self.classes.append({"ord": len(self.classes), "kind": kind, "label": label, "terms": terms,
                                 "with": _words(row.get("with")), "machine": _words(row.get("machine"))})
        if not self.classes:
            raise ValueError("a catalog needs at least one class with terms")
        given = fv.DEFAULT_MANIFESTATIONS if manifestations is None else manifestations
        self.manifestations = {str(k).strip().upper(): _words(v) for k, v in given.items()}

    @classmethod
    def from_json(cls, payload: str) -> "Catalog":
        body = json.loads(payload)
        if not isinstance(body.get("classes"), list):
            raise ValueError("invalid catalog")
        return cls(body["classes"], body.get("manifestations") or {})

    def column(self) -> Column:
        """The classes as one constant array (folded once by the optimizer, not evaluated per row)."""
        plain = lambda terms: [p for p in map(plain_term, terms) if p]
        rows = [{"ord": c["ord"], "kind": c["kind"], "label": c["label"], "terms": plain(c["terms"]),
                 "co_terms": plain(c["with"]), "machine_terms": plain(c["machine"])} for c in self.classes]
        return F.from_json(F.lit(json.dumps(rows, ensure_ascii=False)), CLASS_TYPE)

    def vocabulary(self) -> list[str]:
        """Words of 6+ letters of terms and co-terms: the targets of word repair."""
        words = {w for c in self.classes for t in c["terms"] + c["with"] for w in plain_term(t).split()}
        return sorted(w for w in words if len(w) >= 6)

    def labels(self) -> list[str]:
        """H4: final class names, unclassified ones last."""
        named = {f"FALHA DE {c['label']}" if c["kind"] == "componente" else c["label"] for c in self.classes}
        return sorted(named) + fv.UNCLASSIFIED

    def terms(self, spark: SparkSession) -> DataFrame:
        """K1: one row per (class, role, term)."""
        rows = [(c["ord"], c["kind"], c["label"], role, plain_term(t)) for c in self.classes
                for role, key in (("term", "terms"), ("with", "with"), ("machine", "machine")) for t in c[key]]
        return spark.createDataFrame([r for r in rows if r[4]], TERM_SCHEMA)
