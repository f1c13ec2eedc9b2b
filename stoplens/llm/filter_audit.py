"""What each filter of a chain costs in every order of the filters, by wide packed counters.

A document fails some of the filters; its mask says which. For every mask there is one big integer with a field of 64
bits for each order of the filters, step of that order and outcome (kept after the step, removed at it, failing it but
removed earlier, failing only it). The integers of a part's documents are added up, as many times as the mask occurs,
and the fields of the sum are the counts; a field holds up to 2**64 - 1, so no count runs into the next field.

Spark counts documents per part, mask and label, which leaves at most 2**filters * 4 rows per part however large it is;
these go through one Python group per part. Copies are found by the SHA-256 of the text: the least id of a digest comes
from a pre-aggregated minimum, and rows are matched with it on digest and id, so that a digest that holds a third
of all rows is not one group.

Null and empty texts have no words and no characters and are identical with each other; a null part is the empty string;
documents with a null id never count as copies and have no label; rows that share id and text are no copies of each
other; labels that repeat count if one of them says 1; labels of unknown documents are left out; empty tables give empty
tables; other columns are not read.
"""

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stoplens.llm.common import in_tasks, written

LETTERS = "ABCDE"
CAPITALS = bytes(range(65, 91))
SYMBOLS = b"#$%&*|"
FOLLOWERS = bytes(range(0x80, 0xC0))  # bytes of UTF-8 that begin no character
OUTCOMES = ("kept", "removed", "redundant", "unique_fails")
COPY = 4  # place of the filter on copies, whose bit comes from the whole table
SPREAD = 64  # places over which rows without id are dealt


def failures(text: bytes) -> int:
    """Bits of the filters A to D that a text fails; bytes.split() parts at exactly the six white spaces of words."""
    words = text.split()
    characters = len(text.translate(None, FOLLOWERS))
    fails = (len(words) < 100, 100 * len(set(words)) < 80 * len(words),
             100 * (len(text) - len(text.translate(None, CAPITALS))) > 10 * characters, len(text.translate(None, SYMBOLS)) < len(text))
    return sum(1 << k for k, failed in enumerate(fails) if failed)


def mark_batches(batches):
    for batch in batches:
        texts = [t.as_py() or b"" for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
                                          pa.array([failures(t) for t in texts], pa.int32())], ["id", "part", "digest", "fails"])


def document_masks(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, mask, good, toxic, documents): how often each mask occurs."""
    kind = docs.select(id).schema[0].dataType.simpleString()
    marks = written(docs.select(F.col(id).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).cast("string").cast("binary").alias("text"))
                    .mapInArrow(in_tasks(__name__, "mark_batches"), f"id {kind}, part string, digest binary, fails int"), "filter-marks")
    known = labels.where(F.col(id).isNotNull()).groupBy(F.col(id).alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    place = F.when(F.col("id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(SPREAD))).otherwise(0)
    labelled = marks.withColumn("place", place).join(known.withColumn("place", F.lit(0).cast("long")), ["id", "place"], "left")
    first = marks.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    copied = F.col("id").isNotNull() & F.col("first").isNull()
    mask = F.col("fails") + F.when(copied, 1 << COPY).otherwise(0)
    return labelled.join(first, ["digest", "id"], "left").groupBy(
        "part", mask.alias("mask"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")).agg(F.count(F.lit(1)).alias("documents"))


def fields(n_filters: int) -> list[tuple[tuple[int, ...], int]]:
    """(order, step from 0) of each group of fields."""
    return [(order, step) for order in permutations(range(n_filters)) for step in range(n_filters)]


def wide_integers(n_filters: int) -> list[int]:
    """For each mask the integer of its outcomes: one field for each order, step and outcome, the first one lowest."""
    wide = []
    for mask in range(1 << n_filters):
        outcomes = []
        for order, step in fields(n_filters):
            here = bool(mask >> order[step] & 1)
            gone = any(mask >> f & 1 for f in order[:step])
            outcomes += [not gone and not here, not gone and here, gone and here, mask == 1 << order[step]]
        wide.append(int.from_bytes(np.array(outcomes, "<u8").tobytes(), "little"))
    return wide


def unpack(total: int, n_filters: int) -> np.ndarray:
    """(orders * steps, outcomes)."""
    n = len(fields(n_filters)) * len(OUTCOMES)
    return np.frombuffer(total.to_bytes(8 * n, "little"), "<u8").astype(np.int64).reshape(-1, len(OUTCOMES))


def steps_of_part(table: pa.Table, letters: str) -> pa.Table:
    """All orders and steps of one part, from its counted masks."""
    k, wide = len(letters), wide_integers(len(letters))
    sums = {"all": 0, "good": 0, "toxic": 0}
    for r in table.to_pylist():
        packed = r["documents"] * wide[r["mask"]]
        sums["all"] += packed
        for label in ("good", "toxic"):
            sums[label] += packed if r[label] else 0
    counts = {label: unpack(total, k) for label, total in sums.items()}
    at = fields(k)
    removed = counts["all"][:, OUTCOMES.index("removed")]
    own = np.array([order[step] for order, step in at])
    shapley = np.array([removed[own == f].sum() for f in range(k)])
    columns = {"part": pa.array(table.column("part").to_pylist()[:1] * len(at), pa.string()), "filter_order": pa.array(["".join(letters[f] for f in o) for o, _ in at]),
               "step": pa.array([s + 1 for _, s in at], pa.int32())}
    columns |= {name: pa.array(counts["all"][:, i]) for i, name in enumerate(OUTCOMES)}
    columns |= {f"{label}_lost": pa.array(counts[label][:, OUTCOMES.index("removed")]) for label in ("good", "toxic")}
    return pa.table(columns | {"shapley": pa.array(shapley[own])})


def audit(masks: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row per part, order of the filters and step, from (part, mask, good, toxic, documents). With k filters there
    are k! * k rows a part and 2**k masks, so k is small."""
    return masks.groupBy("part").applyInArrow(in_tasks(__name__, "steps_of_part", letters), "part string, filter_order string, step int, "
                                              + ", ".join(f"{c} long" for c in (*OUTCOMES, "good_lost", "toxic_lost", "shapley")))
