"""Line dedup by overlapping windows of three lines.

A window is three consecutive lines that hold a word, compared without surrounding blanks and tabs. Windows are hashed
(128 bits) and counted over all documents. Every occurrence but the first, by (id, text hash, place), covers its three
lines; covered lines go, lines without a word stay. Texts with fewer than three such lines have no window and stay.

Null texts stay null (0 lines); null ids come first in the order; rows of the same id and text are one document, so a
repeated row does not count as a repeat of itself and all its rows get the same result; empty tables give empty tables;
extra columns pass through unless they carry the name of an output column, which then wins.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stoplens.llm.common import WORD, bind, written

SIZE = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_windows(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """(id, th, k, at, h1, h2): the k-th window of each document, the places of its lines, and its hash."""
    numbered = F.transform(_lines(F.col(text)), lambda line, i: F.struct(i.alias("i"), F.trim(line, F.lit(" \t\r")).alias("t")))

    def windows(x):
        def one(k):
            part = F.slice(x, k, size)
            lines = part["t"]
            return F.struct(k.alias("k"), part["i"].alias("at"), F.xxhash64(lines).alias("h1"), F.xxhash64(F.lit("w"), lines).alias("h2"))
        return F.when(F.size(x) >= size, F.transform(F.sequence(F.lit(1), F.size(x) - (size - 1)), one))

    found = bind(F.filter(numbered, lambda x: x["t"].rlike(WORD)), windows)
    return docs.select(F.col(id).alias("id"), F.xxhash64(text).alias("th"), F.explode(found).alias("w")).select("id", "th", "w.*")


def repeated_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """(id, th, removed): sorted places of the lines that later occurrences cover, for documents that have any."""
    windows = written(line_windows(docs, id, text, size), "line-windows")
    place = F.struct("id", "th", "k")
    # partial aggregation leaves one row per hash and task, so a passage that a third of all documents share stays cheap
    first = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("h1", "h2", "first")
    later = windows.join(first.hint("rebalance"), ["h1", "h2"]).where(place != F.col("first"))
    return later.select("id", "th", F.explode("at").alias("i")).groupBy("id", "th").agg(F.sort_array(F.collect_set("i")).alias("removed"))


def drop_repeated_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """``docs`` with ``text`` less its covered lines, and n_lines (lines), n_removed, removed (places from 0)."""
    docs = docs.drop(*[c for c in ("n_lines", "n_removed", "removed") if c not in (id, text)])
    covered = repeated_lines(docs, id, text, size).select(F.col("id").alias("_id"), F.col("th").alias("_th"), "removed")
    rows = docs.withColumn("_h", F.xxhash64(text)).join(covered, F.col(id).eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_th")), "left")
    gone = F.coalesce("removed", F.expr("cast(array() as array<int>)"))
    left = bind(_lines(F.col(text)), lambda lines: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone), lambda i: lines[i]), "\n"))
    return rows.withColumns({
        text: F.when(F.size(gone) > 0, left).otherwise(F.col(text)),
        "n_lines": F.when(F.col(text).isNull(), 0).otherwise(F.size(_lines(F.col(text)))).cast("long"),
        "n_removed": F.size(gone).cast("long"), "removed": gone,
    }).drop("_h", "_id", "_th")
