"""Token counts of fields or sections, by character offsets of one encoding of the whole document.

A document is encoded once; the character span of each token is joined by interval to the sections (sorted, disjoint,
gaps allowed). A token that crosses a boundary is allocated by a stated rule:
``first``: to the section of its first character; ``last``: of its last; ``largest``: where most of its characters lie,
the earlier of equal ones; ``shared``: to each by its share of the token's characters.
A token whose deciding character lies in no section counts in none.

Null texts count as empty and have the one empty section of lines, with 0 tokens; null or missing section lists give no
rows; repeated rows give repeated rows; empty tables give empty tables; extra columns are not carried (join on the id).
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stoplens.llm.byte_bpe import encoder
from stoplens.llm.common import in_tasks

RULES = ("first", "last", "largest", "shared")
ROWS = 256


def allocate(starts: np.ndarray, ends: np.ndarray, low: np.ndarray, high: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens allocated to each section, and tokens that overlap it without lying within it."""
    a, b = np.searchsorted(high, starts, "right"), np.searchsorted(low, ends, "left") - 1  # first and last section it overlaps
    touches = a <= b
    within = np.zeros(len(starts), bool)
    within[touches] = (a[touches] == b[touches]) & (low[a[touches]] <= starts[touches]) & (ends[touches] <= high[a[touches]])
    counts = np.bincount(a[within], minlength=len(low)).astype(float)
    crossing = np.zeros(len(low), np.int64)
    for t in np.flatnonzero(touches & ~within):
        over = np.arange(a[t], b[t] + 1)
        size = np.minimum(ends[t], high[over]) - np.maximum(starts[t], low[over])
        over, size = over[size > 0], size[size > 0]
        crossing[over] += 1
        if rule == "shared":
            counts[over] += size / (ends[t] - starts[t])
        elif rule == "largest":
            counts[over[np.argmax(size)]] += 1
        elif rule == "first" and low[over[0]] <= starts[t]:
            counts[over[0]] += 1
        elif rule == "last" and ends[t] <= high[over[-1]]:
            counts[over[-1]] += 1
    return counts, crossing


def attribute_batches(batches, path: str, rule: str):
    own = encoder(path)
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            texts = [t or "" for t in part.column(1).to_pylist()]
            given = part.column(2).to_pylist() if part.num_columns > 2 else None
            out: list[list] = [[] for _ in range(7)]
            for row, (text, ids) in enumerate(zip(texts, own.encode(texts), strict=True)):
                starts, ends = own.spans(text, ids)
                if given is None:
                    line = np.cumsum([len(x) + 1 for x in text.split("\n")])
                    low, high = np.concatenate([[0], line[:-1]]), np.concatenate([line[:-1], [len(text)]])
                else:
                    low, high = (np.array([s[k] for s in given[row] or ()], np.int64) for k in ("start", "end"))
                    if (low > high).any() or (low[1:] < high[:-1]).any():
                        raise ValueError("sections must be sorted and disjoint")
                counts, crossing = allocate(starts, ends, low, high, rule)
                n = len(low)
                for column, values in zip(out, (np.full(n, row), np.full(n, len(starts)), np.arange(n), low, high, counts, crossing), strict=True):
                    column.append(values)
            row, *rest = (np.concatenate(c) for c in out)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), *(pa.array(c, pa.float64() if k == 4 else pa.int64()) for k, c in enumerate(rest))],
                                             ["id", "document_tokens", "section", "start", "end", "tokens", "crossing"])


def attribute_tokens(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", sections: str | None = None, rule: str = "first") -> DataFrame:
    """(id, document_tokens, section, start, end, tokens, crossing) per section; code points, end exclusive.

    ``sections``: a column of arrays of structs with ``start`` and ``end``; without one, lines with their line ends.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    kind = docs.schema[id].dataType.simpleString()
    columns = [F.col(id).alias("id"), F.col(text).alias("text"), *([F.col(sections).alias("sections")] if sections else [])]
    return docs.select(*columns).mapInArrow(in_tasks(__name__, "attribute_batches", path, rule),
                                            f"id {kind}, document_tokens long, section long, start long, end long, tokens double, crossing long")
