"""Records of delimited files whose quoted cells may hold line breaks, read by byte range.

Spark splits a file into byte ranges and reads the lines of each. Whether a line begins inside a quoted cell depends on
all lines before it, so a range is walked once under both suppositions, outside and inside, for each separator; every
line keeps both answers, and the last line of a range tells how the range turns either start into an end. A running
composition over the ranges of a file (one row a range) then picks the right supposition for each range, and the same
running totals give every record its place in the file. Lines that begin and end outside are records as they are;
only the lines of records with line breaks are brought together.

Quotes follow the usual rules: a cell is quoted if its first character is a quote, doubled quotes inside stand for one,
text after the closing quote belongs to the cell, and a quote elsewhere is a plain character. Records end at a line feed,
with or without a carriage return. A record with line breaks of more than ``LONGEST`` characters, as a quote that is
never closed makes, is not put together: it comes out without text.
"""

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stoplens.operators.skew import lookup_join
from stoplens.session import staged

SEPARATORS = (";", ",", "\t")
LONGEST = 16 << 20
BOM = "﻿"
CLOSED = re.compile(r'[^"]*+(?:""[^"]*+)*+"')
CELLS = [re.compile(r'(?:"[^"]*+(?:""[^"]*+)*+"[^S]*+|(?!")[^S]*+)(?:S(?:"[^"]*+(?:""[^"]*+)*+"[^S]*+|(?!")[^S]*+))*+'.replace("S", s)) for s in SEPARATORS]
#: Suppositions: separator by separator, first outside, then inside.
STARTS = [inside for _ in SEPARATORS for inside in (False, True)]
LINE = "file string, block bigint, at bigint, line string, before smallint, after smallint, inner array<bigint>"


def ends_inside(line: str, separator: int, inside: bool) -> bool:
    """Whether the line's end lies in a quoted cell, from where its start lies."""
    start = 0
    if inside:
        closed = CLOSED.match(line)
        if not closed:
            return True
        start = line.find(SEPARATORS[separator], closed.end()) + 1
        if not start:
            return False
    cells = CELLS[separator].match(line, start)
    return not cells or cells.end() < len(line)


def walk(batches):
    """Number the lines of each range and mark, for every supposition, which begin and end inside a quoted cell;
    ``inner`` counts the lines of the range so far that begin inside."""
    now, at, states, inner = None, 0, STARTS, np.zeros(len(STARTS), np.int64)
    bits = 1 << np.arange(len(STARTS))
    for batch in batches:
        file, block, line = batch.columns
        blocks, files = block.to_numpy(), file.dictionary_encode()
        names, codes = files.dictionary.to_pylist(), files.indices.to_numpy()
        turns = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(codes) != 0)) + 1
        bounds = [0, *turns.tolist(), len(blocks)] if len(blocks) else [0]
        quoted = np.flatnonzero(pc.match_substring(line, '"').to_numpy(zero_copy_only=False))
        firsts = {}
        for begin, end in zip(bounds, bounds[1:], strict=False):
            key = (names[codes[begin]], int(blocks[begin]))
            if key != now:
                now, at, states, inner = key, 0, STARTS, np.zeros(len(STARTS), np.int64)
                text = line[begin].as_py()
                if key[1] == 0 and text.startswith(BOM):
                    firsts[begin] = text[1:]
            before = np.empty((end - begin + 1, len(STARTS)), bool)
            done = 0
            for q in quoted[np.searchsorted(quoted, begin):np.searchsorted(quoted, end)]:
                before[done:q - begin + 1] = states
                done = int(q) - begin + 1
                text = firsts.get(int(q)) or line[int(q)].as_py()
                states = [ends_inside(text, k // 2, inside) for k, inside in enumerate(states)]
            before[done:] = states
            counted = inner + np.cumsum(before[:-1], axis=0)
            inner = counted[-1]
            marks = (before * bits).sum(axis=1).astype(np.int16)
            n = end - begin
            texts = line.slice(begin, n)
            if begin in firsts:
                texts = pa.concat_arrays([pa.array([firsts[begin]], texts.type), texts.slice(1)])
            yield pa.RecordBatch.from_arrays(
                [file.slice(begin, n), block.slice(begin, n), pa.array(at + 1 + np.arange(n)), texts, pa.array(marks[:-1]), pa.array(marks[1:]),
                 pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(STARTS)), pa.array(counted.ravel()))],
                ["file", "block", "at", "line", "before", "after", "inner"])
            at += n


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Every line with its file, range and marks: the one reading of the files, kept in the shared folder."""
    raw = spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
    return staged(raw.mapInArrow(walk, LINE), "landed-lines")


def range_starts(lines: DataFrame) -> DataFrame:
    """One row per file and range: ``lines_before`` it and, for each separator, whether it starts inside a quoted cell and
    how many earlier lines of the file begin inside one.

    A range turns its start into its end by keeping it, by swapping it, or by forgetting it; the start of a range is the
    last forgotten value before it, swapped as often as ranges since then swap.
    """
    ranges = lines.groupBy("file", "block").agg(F.max("at").alias("n"), F.max_by("after", "at").alias("after"), F.max_by("inner", "at").alias("inner"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bit = lambda k: F.col("after").bitwiseAND(F.lit(1 << k)) != 0
    out = ranges.withColumn("lines_before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    for s in range(len(SEPARATORS)):
        outside, inside = bit(2 * s), bit(2 * s + 1)
        out = out.withColumn("_swaps", F.coalesce(F.sum((outside & ~inside).cast("int")).over(earlier), F.lit(0)))
        out = out.withColumn("_last", F.last(F.when(outside == inside, F.struct(outside.cast("int").alias("value"), F.col("_swaps").alias("swaps"))), True).over(earlier))
        start = F.when(F.col("_last").isNull(), F.col("_swaps") % 2).otherwise((F.col("_last.value") + F.col("_swaps") - F.col("_last.swaps")) % 2) == 1
        out = out.withColumn(f"inside_{s}", start)
        own = F.when(F.col(f"inside_{s}"), F.col("inner")[2 * s + 1]).otherwise(F.col("inner")[2 * s])
        out = out.withColumn(f"inner_{s}", F.coalesce(F.sum(own).over(earlier), F.lit(0)))
    found = out.select("file", "block", "lines_before", F.array(*[f"inside_{s}" for s in range(len(SEPARATORS))]).alias("inside"),
                      F.array(*[f"inner_{s}" for s in range(len(SEPARATORS))]).alias("inner_before"))
    return staged(found, "landed-ranges")


def records(lines: DataFrame, starts: DataFrame, first: int | None = None, longest: int = LONGEST) -> DataFrame:
    """(file, separator, number, first_line, text): the records of each file, numbered from 1; blank ones count.

    ``starts``: rows of :func:`range_starts` with the ``separator`` (its place) to read a file by; a file may have more
    than one. ``first``: only so many records of each file.
    """
    starts = starts.select("file", "block", "separator", "lines_before", F.col("inside")[F.col("separator")].alias("inside"),
                           F.col("inner_before")[F.col("separator")].alias("inner_before"))
    if first is not None:
        starts = starts.where(F.col("lines_before") - F.col("inner_before") < first)
    placed = lookup_join(lines, starts, ["file", "block"], "inner")
    way = 2 * F.col("separator") + F.col("inside").cast("int")
    marked = lambda c: F.expr(f"(shiftright(CAST({c} AS INT), 2 * separator + CAST(inside AS INT)) & 1) = 1")
    placed = placed.select("file", "separator", (F.col("at") + F.col("lines_before")).alias("place"), "line", marked("before").alias("_before"), marked("after").alias("_after"),
                           (F.col("at") + F.col("lines_before") - F.get("inner", way) - F.col("inner_before")).alias("number"))
    if first is not None:
        placed = placed.where(F.col("number") <= first)
    whole = placed.where(~F.col("_before") & ~F.col("_after")).select("file", "separator", "number", F.col("place").alias("first_line"), F.col("line").alias("text"))
    torn = placed.where(F.col("_before") | F.col("_after"))
    key = ["file", "separator", "number"]
    endless = torn.groupBy(*key).agg(F.sum(F.length("line") + 1).alias("_size"), F.min("place").alias("first_line")).where(F.col("_size") > longest).drop("_size")
    short = torn.join(endless.select(*key), key, "left_anti").groupBy(*key).agg(
        F.min("place").alias("first_line"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda e: e["line"]), "\n").alias("text"))
    out = whole.unionByName(short).unionByName(endless.withColumn("text", F.lit(None).cast("string")))
    return out.withColumn("text", F.regexp_replace("text", "\r$", ""))


def split_cells(line: Column, separator: Column) -> Column:
    """Cells of one record; quoted cells may hold the separator, line breaks and doubled quotes, and be of any length
    (possessive repeats take no stack)."""
    plain = F.concat(F.lit("[^"), separator, F.lit("]*+"))
    pattern = F.concat(separator, F.lit('("[^"]*+(?:""[^"]*+)*+(?:"'), plain, F.lit(r"|\z)|"), plain, F.lit(")"))
    cells = F.regexp_extract_all(F.concat(separator, line), pattern, F.lit(1))
    quoted = r'(?s)^"([^"]*+(?:""[^"]*+)*+)(?:"(.*+))?$'
    return F.transform(cells, lambda c: F.when(c.startswith('"'), F.concat(
        F.replace(F.regexp_extract(c, quoted, 1), F.lit('""'), F.lit('"')), F.regexp_extract(c, quoted, 2))).otherwise(c))


def separator_text(place: Column) -> Column:
    return F.get(F.array(*[F.lit(s) for s in SEPARATORS]), place)
