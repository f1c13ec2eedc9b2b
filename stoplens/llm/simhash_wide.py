"""Near-duplicates of a wanted shingle similarity, by SimHash fingerprints wider than 64 bits.

The share of differing bits of two SimHash fingerprints estimates the angle of their shingle sets; sets of Jaccard
similarity s differ in at most acos(2s / (1 + s)) / pi of the bits on average. With 64 bits that estimate is too rough
to tell 0.8 from 0.9, and the pigeonhole blocks of so many bits too narrow to be keys. So the fingerprint holds
``BLOCKS`` blocks of ``BITS`` bits (96 of 24): fingerprints that differ in fewer bits than there are blocks must share
one, others share one with a chance that README states. Fingerprints are joined on blocks; of the pairs that agree
roughly in their first word, the differing bits of the whole are counted. The limit lies ``MARGIN`` standard deviations above
the bits expected at the wanted similarity.

Equal fingerprints are collapsed. Buckets of more than ``CROWD`` fingerprints are split into chunks, and each pair of
chunks is a group that returns a spanning set: the components are those of all pairs, in one row per fingerprint.

Shingles count once per text. Null and empty texts have none and are copies of each other; texts of fewer words than a
shingle are one shingle. Repeated rows share a component; null ids share a component but never name it; empty tables
give empty tables; extra columns pass through ``drop_similar``.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stoplens.llm.common import in_tasks, written
from stoplens.llm.components import connected_components, local_roots
from stoplens.llm.simhash_blocks import SEED, first_of_components, row_key, shingle_hashes

SHINGLE, SIMILARITY = 5, 0.8
BLOCKS, BITS = 96, 24
CROWD, CHUNK = 4, 1024
MARGIN = 1.0
ROUGH = 4.0  # standard deviations allowed in the first word, so that it drops strangers only


def most_bits(similarity: float, bits: int, deviations: float) -> int:
    """Differing bits, of ``bits``, expected at the similarity plus so many standard deviations."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(bits * share + deviations * math.sqrt(bits * share * (1 - share)))


def n_words(blocks: int, bits: int) -> int:
    return -(-blocks * bits // 64)


def mixed(hashes: np.ndarray) -> np.ndarray:
    """Two rounds of shift and odd multiplier."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        hashes = (hashes ^ (hashes >> np.uint64(shift))) * np.uint64(factor)
    return hashes ^ (hashes >> np.uint64(31))


def wide_fingerprint(hashes: np.ndarray, words: int) -> np.ndarray:
    """Signed 64-bit words; each bit is set if over half of the distinct hashes, mixed anew for each word, have it."""
    hashes = np.unique(hashes)
    salts = np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    votes = np.zeros(64 * words, np.int64)
    for at in range(0, len(hashes), 255):  # 255 rows of bits add up inside bytes
        bits = np.unpackbits(mixed(hashes[at:at + 255, None] + salts).view(np.uint8), axis=1, bitorder="little")
        votes += bits.view(np.uint64).sum(axis=0, dtype=np.uint64).view(np.uint8)
    return np.packbits(votes * 2 > len(hashes), bitorder="little").view("<i8")


def block_keys(fps: np.ndarray, blocks: int, bits: int) -> np.ndarray:
    """One key per fingerprint and block: the block's number above its bits."""
    flat = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8), axis=1, bitorder="little")[:, :blocks * bits].reshape(-1, blocks, bits)
    return (flat @ (1 << np.arange(bits, dtype=np.int64))) + (np.arange(blocks, dtype=np.int64) << bits)


def _lists(values: np.ndarray) -> pa.ListArray:
    width = values.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * width), pa.array(values.ravel()))


def _matrix(column, width: int) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False), dtype=np.int64).reshape(-1, width)


def fingerprint_batches(batches, shingle: int, seed: int, words: int):
    for batch in batches:
        texts = batch.column(1)
        fps = np.array([wide_fingerprint(shingle_hashes(texts[i].as_py() or "", shingle, seed), words) for i in range(len(texts))], np.int64).reshape(-1, words)
        yield pa.RecordBatch.from_arrays([batch.column(0), _lists(fps)], ["id", "fp"])


def key_batches(batches, blocks: int, bits: int):
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            keys = block_keys(_matrix(part.column(1), n_words(blocks, bits)), blocks, bits)
            rows = pa.array(np.repeat(np.arange(len(keys)), blocks))
            yield pa.RecordBatch.from_arrays([part.column(0).take(rows), pa.array(_matrix(part.column(1), n_words(blocks, bits))[:, 0]).take(rows), pa.array(keys.ravel())], ["node", "first", "key"])


def linked_chunks(table: pa.Table, words: int, rough: int, most: int) -> pa.Table:
    """Links inside a pair of chunks: (u, v), v the smallest node that u reaches."""
    table = table.sort_by("node")
    node, chunk, low, high = table["node"].to_numpy(), table["chunk"].to_numpy(), table["left"][0].as_py(), table["right"][0].as_py()
    fps = _matrix(table["fp"].combine_chunks(), words).view(np.uint64)
    left, right = np.flatnonzero(chunk == low), np.flatnonzero(chunk == high)
    a, b = fps[left], fps[right]
    apart = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0]).astype(np.uint16)
    close = apart <= rough
    if close.any():
        for w in range(1, words):
            apart += np.bitwise_count(a[:, None, w] ^ b[None, :, w])
    i, j = np.nonzero(close & (apart <= most))
    root = local_roots(len(node), left[i], right[j])
    moved = root != np.arange(len(node))
    return pa.table({"u": node[moved], "v": node[root[moved]]})


def _apart(u: Column, v: Column, words: int) -> Column:
    return sum((F.bit_count(u[w].bitwiseXOR(v[w])) for w in range(words)), F.lit(0))


def wide_links(fps: DataFrame, similarity: float = SIMILARITY, blocks: int = BLOCKS, bits: int = BITS, margin: float = MARGIN) -> DataFrame:
    """(u, v) between nodes of ``fps(node, fp)``, whose rows are distinct; a spanning set inside crowded buckets."""
    words = n_words(blocks, bits)
    rough, most = most_bits(similarity, 64, ROUGH), most_bits(similarity, 64 * words, margin)
    dealt = fps.select("node", "fp").mapInArrow(in_tasks(__name__, "key_batches", blocks, bits), "node long, first long, key long")
    sizes = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").hint("rebalance")
    shared = written(dealt.join(sizes, "key"), "wide-blocks")
    small, crowded = shared.where(F.col("n") <= CROWD), shared.where(F.col("n") > CROWD)
    side = lambda name: small.select("key", F.col("node").alias(name), F.col("first").alias(f"{name}_first"))
    pairs = side("u").join(side("v"), "key").where("v < u").where(F.bit_count(F.col("u_first").bitwiseXOR(F.col("v_first"))) <= rough).select("u", "v").distinct()
    whole = lambda name: fps.select(F.col("node").alias(name), F.col("fp").alias(f"{name}_fp"))
    checked = pairs.join(whole("u"), "u").join(whole("v"), "v").where(_apart(F.col("u_fp"), F.col("v_fp"), words) <= most).select("u", "v")
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    split = crowded.withColumn("chunk", F.pmod(F.xxhash64("node"), chunks).cast("int")).select("*", F.explode(F.transform(
        F.sequence(F.lit(0), chunks - 1), lambda o: F.struct(F.least("chunk", o).alias("left"), F.greatest("chunk", o).alias("right")))).alias("g"))
    keys = ["key", "left", "right"]
    more = split.select("node", "key", "chunk", "g.*").join(fps.select("node", "fp"), "node").repartition(*keys)\
        .groupBy(*keys).applyInArrow(in_tasks(__name__, "linked_chunks", words, rough, most), "u long, v long")
    return checked.unionByName(more).distinct()


def similar_copies(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED, **settings) -> DataFrame:
    """(id, component_id) of each row; the component is the smallest id that links reach. ``settings`` are those of
    ``wide_links``. A fingerprint is known by a 64-bit hash of its words."""
    words = n_words(settings.get("blocks", BLOCKS), settings.get("bits", BITS))
    kind = docs.schema[id].dataType.simpleString()
    rows = written(docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(
        in_tasks(__name__, "fingerprint_batches", shingle, seed, words), f"id {kind}, fp array<long>").withColumn("node", F.xxhash64("fp")), "wide-fingerprints")
    distinct = written(rows.groupBy("node").agg(F.min("id").alias("least"), F.min("fp").alias("fp")), "distinct-wide-fingerprints")
    parts = connected_components(wide_links(distinct, **settings)).withColumnRenamed("node", "of")
    named = distinct.select("node", "least").join(parts, F.col("node") == F.col("of"), "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id")).hint("rebalance")
    return rows.select("id", "node").join(named.join(least, "component").select("node", "component_id").hint("rebalance"), "node").select("id", "component_id")


def drop_similar(docs: DataFrame, id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """``docs`` with one row of each component, as ``first_of_components`` chooses it."""
    keyed = docs.select(row_key(id, text).alias("row"), F.col(text).alias("text"))
    found = similar_copies(keyed, "row", "text", **settings).select(F.col("id").alias("row"), F.col("component_id").alias("first"))
    return first_of_components(docs, found, id, text)
