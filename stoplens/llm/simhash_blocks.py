"""Near-duplicates by SimHash fingerprints of word shingles and pigeonhole blocks.

Fingerprints of 64 bits are cut into blocks; of B blocks, two that differ in at most d bits agree in B - d at least (by
default two of four). So equal fingerprints are collapsed, each is dealt to the combinations of B - d blocks, and
fingerprints that share a combination are compared bit by bit. A bucket of more than ``CROWD`` fingerprints is not
paired out. For two bits its members are grouped by themselves and their 64 one-flip neighbours (at most 65 members in
a group) and linked to the smallest of the group: two fingerprints differ in at most two bits exactly if one flip at
most in each can make them equal. For other distances it is split into chunks, and each pair of chunks is a group that
returns a spanning set, one row per fingerprint. Both find the components that all pairs would give.

Null and empty texts have no words and the fingerprint zero, which links like any other. Equal rows share fingerprint
and component; null ids share a component but never name it; empty tables give empty tables; extra columns are not
carried by the digest and pass through ``drop_near_copies``.
"""

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stoplens.llm.common import in_tasks, written
from stoplens.llm.components import connected_components, local_roots

SHINGLE, SEED, DISTANCE = 3, 42, 2
BLOCKS = 4
CROWD, CHUNK = 32, 1024


def shingle_hashes(text: str, shingle: int, seed: int) -> np.ndarray:
    words = text.encode().lower().split()  # bytes: only A-Z, and only the six ASCII blanks
    if not words:
        return np.zeros(0, "<u8")
    shingles = map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False)) if len(words) >= shingle else [b" ".join(words)]
    return np.array([xxhash.xxh64_intdigest(s, seed) for s in shingles], dtype="<u8")


def majority(hashes: np.ndarray) -> int:
    """Signed 64-bit fingerprint: the bits set in over half the hashes."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):  # bounded memory for very long texts
        votes += np.unpackbits(hashes[at:at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: str, shingle: int, seed: int) -> int:
    return majority(shingle_hashes(text, shingle, seed))


def fingerprint_batches(batches, shingle: int, seed: int):
    for batch in batches:
        texts = batch.column(1)
        fps = [fingerprint(texts[i].as_py() or "", shingle, seed) for i in range(len(texts))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["id", "fp"])


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(id, fp) of each row, written to the shared folder."""
    kind = docs.schema[id].dataType.simpleString()
    found = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(in_tasks(__name__, "fingerprint_batches", shingle, seed), f"id {kind}, fp long")
    return written(found, "fingerprints")


def block_masks(distance: int, blocks: int) -> list[int]:
    """Signed masks of the combinations of blocks of which close fingerprints share one."""
    if not 0 <= distance < blocks <= 64:
        raise ValueError("there must be more blocks than differing bits")
    cuts = [64 * b // blocks for b in range(blocks + 1)]
    masks = [sum(chosen) for chosen in combinations([(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)], blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def linked_chunks(table: pa.Table, distance: int) -> pa.Table:
    """Links inside a pair of chunks: (u, v), v the smallest fingerprint that u reaches."""
    table = table.sort_by("fp")
    fp, chunk, low, high = table["fp"].to_numpy(), table["chunk"].to_numpy(), table["left"][0].as_py(), table["right"][0].as_py()
    bits, left, right = fp.view("<u8"), np.flatnonzero(chunk == low), np.flatnonzero(chunk == high)
    i, j = np.nonzero(np.bitwise_count(bits[left][:, None] ^ bits[right][None, :]) <= distance)
    root = local_roots(len(fp), left[i], right[j])
    moved = root != np.arange(len(fp))
    return pa.table({"u": fp[moved], "v": fp[root[moved]]})


def _links_of_chunks(crowded: DataFrame, distance: int) -> DataFrame:
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    dealt = crowded.withColumn("chunk", F.pmod(F.xxhash64("fp"), chunks).cast("int")).select("*", F.explode(F.transform(
        F.sequence(F.lit(0), chunks - 1), lambda o: F.struct(F.least("chunk", o).alias("left"), F.greatest("chunk", o).alias("right")))).alias("g")).select("*", "g.*").drop("g", "n")
    keys = ["pair", "block", "left", "right"]
    return dealt.repartition(*keys).groupBy(*keys).applyInArrow(in_tasks(__name__, "linked_chunks", distance), "u long, v long")


def _links_by_flips(crowded: DataFrame) -> DataFrame:
    flips = F.concat(F.array(F.col("fp")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    around = crowded.select("fp").distinct().select("fp", F.explode(flips).alias("near"))
    centres = around.groupBy("near").agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1").select("near", "v").hint("rebalance")
    return around.join(centres, "near").select(F.col("fp").alias("u"), "v").where("u <> v and bit_count(u ^ v) <= 2")


def fingerprint_links(fps: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """(u, v) between different fingerprints of the distinct column ``fp``; a spanning set inside crowded buckets."""
    dealt = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in block_masks(distance, blocks)])).alias("pair", "block"))
    sizes = dealt.groupBy("pair", "block").agg(F.count(F.lit(1)).alias("n")).where("n > 1").hint("rebalance")
    shared = written(dealt.join(sizes, ["pair", "block"]), "fingerprint-blocks")
    small, crowded = shared.where(F.col("n") <= CROWD), shared.where(F.col("n") > CROWD)
    side = lambda name: small.select("pair", "block", F.col("fp").alias(name))
    pairs = side("u").join(side("v"), ["pair", "block"]).where("u < v").where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance).select("u", "v")
    more = _links_by_flips(crowded) if distance == 2 else _links_of_chunks(crowded, distance)
    return pairs.unionByName(more).distinct()


def near_copies(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED,
                distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """(id, fp, component_id) of each row; the component is the smallest id that links reach."""
    rows = fingerprints(docs, id, text, shingle, seed)
    distinct = written(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    parts = connected_components(fingerprint_links(distinct.drop("least"), distance, blocks))
    named = distinct.join(parts, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id")).hint("rebalance")
    return rows.join(named.join(least, "component").select("fp", "component_id").hint("rebalance"), "fp").select("id", "fp", "component_id")


def row_key(id: str, text: str) -> Column:
    """Tells rows apart by id and text hash; null ids come last."""
    return F.struct(F.col(id).isNull().alias("missing"), F.col(id).alias("id"), F.xxhash64(text).alias("hash"))


def first_of_components(docs: DataFrame, found: DataFrame, id: str, text: str) -> DataFrame:
    """``docs`` with one row of each component of ``found(row, first)``, row keys: that of the component's least key, so
    of its smallest id and of several texts with that id the first by hash. Of equal ids and texts one row stays."""
    kept = found.where("row = first").select(F.col("row").alias("_key")).distinct()
    columns = [F.col(c) for c in docs.columns]
    chosen = docs.withColumn("_key", row_key(id, text)).join(kept, "_key", "left_semi")
    return chosen.groupBy("_key").agg(F.first(F.struct(*columns)).alias("_row")).select("_row.*")


def drop_near_copies(docs: DataFrame, id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """``docs`` with one row of each component, as ``first_of_components`` chooses it. ``settings`` are those of ``near_copies``."""
    keyed = docs.select(row_key(id, text).alias("row"), F.col(text).alias("text"))
    found = near_copies(keyed, "row", "text", **settings).select(F.col("id").alias("row"), F.col("component_id").alias("first"))
    return first_of_components(docs, found, id, text)
