"""Near-duplicates by the exact Jaccard similarity of distinct word shingles.

Two sets of at least the wanted similarity share an element among the first few of each, in any order common to all sets
(prefix filter: a fifth of a set at 0.8, a ninth of the smaller one). So the heads of the sets are joined on their
elements, pairs that sizes or places rule out are dropped, and of the others the sets are compared. No close pair
escapes, what SimHash misses included, and no other passes, short texts included. The order puts shingles frequent in a sample of the texts last; it
settles how many pairs are compared, not which are found.

Equal sets are collapsed, and SimHash comes first: sets whose fingerprints (of their distinct shingles) differ in at most
``DISTANCE`` bits are compared, and linked if they are close enough. Of each posting list the first node is compared with the others; after that only pairs of
different components are, dealt out by pairs of chunks. So near copies that link at once are not paired out.

A shingle and a set are known by 64-bit hashes. Null and empty texts have no shingles and are copies of each other; texts
of fewer words than a shingle are one shingle. Rows are told apart by id and text hash; empty tables give empty tables;
extra columns pass through ``drop_similar_sets``.
"""

from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stoplens.llm.common import in_tasks, written
from stoplens.llm.components import connected_components
from stoplens.llm.simhash_blocks import DISTANCE, SEED, fingerprint_links, first_of_components, majority, row_key, shingle_hashes

SHINGLE, SIMILARITY = 5, 0.8
SAMPLE, OFTEN, RANKED = 16, 3, 200_000  # one text of 16; shingles in 3 or more of them go last, 200,000 at most
CHUNK = 1024


def head_size(size: int, share: Fraction) -> int:
    """First elements of a set of which one lies in every set that has ``share`` of its elements."""
    return size + 1 + (-size * share.numerator) // share.denominator if size else 0


def in_order(hashes: np.ndarray, often: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Distinct hashes, those in ``often`` (sorted) last and by rank, others by value."""
    hashes = np.unique(hashes)
    if not len(often):
        return hashes
    at = np.minimum(np.searchsorted(often, hashes), len(often) - 1)
    return hashes[np.argsort(np.where(often[at] == hashes, ranks[at], 0), kind="stable")]


def _lists(sets: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, sets)], dtype=np.int64)
    flat = np.concatenate([*sets, np.zeros(0, "<u8")]).view("<i8")
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))


def head_batches(batches, shingle: int, seed: int, share: Fraction, often: np.ndarray, ranks: np.ndarray):
    for batch in batches:
        nodes, fps, sizes, heads = [], [], [], []
        for value in batch.column(1):
            hashes = np.unique(shingle_hashes(value.as_py() or "", shingle, seed))
            nodes.append(xxhash.xxh64_intdigest(hashes.tobytes()))
            fps.append(majority(hashes))
            sizes.append(len(hashes))
            heads.append(in_order(hashes, often, ranks)[:head_size(len(hashes), share)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(nodes, "<u8").view("<i8")), pa.array(fps, pa.int64()), pa.array(sizes, pa.int32()), _lists(heads)],
                                         ["row", "node", "fp", "size", "head"])


def set_batches(batches, shingle: int, seed: int):
    """(node, text) to (node, hashes), a few texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield pa.RecordBatch.from_arrays([part.column(0), _lists([np.unique(shingle_hashes(v.as_py() or "", shingle, seed)) for v in part.column(1)])], ["node", "hashes"])


def frequent(texts: DataFrame, shingle: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles found most often in the sample, sorted, and their ranks by frequency."""
    sample = texts.select(F.col("row.hash").alias("node"), "text").where(F.pmod("node", F.lit(SAMPLE)) == 0)
    sets = sample.mapInArrow(in_tasks(__name__, "set_batches", shingle, seed), "node long, hashes array<long>")
    top = sets.select(F.explode("hashes").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= OFTEN)\
        .orderBy(F.desc("n"), "h").limit(RANKED).toArrow()
    hashes, ranks = top["h"].to_numpy().astype("<i8").view("<u8"), np.arange(top.num_rows, 0, -1)
    order = np.argsort(hashes)
    return hashes[order], ranks[order]


def may_be_close(u: str, v: str, wanted: Fraction) -> Column:
    """False only if sizes and places of a shared element rule the pair out: elements before it in one set can be shared only with those before it in the other, and likewise after it."""
    a, b = wanted.numerator, wanted.denominator
    size, other, at, place = (F.col(f"{end}.{name}").cast("long") for name in ("size", "at") for end in (u, v))
    shared = F.least(at, place) + F.least(size - at, other - place)
    return (F.least(size, other) * b >= F.greatest(size, other) * a) & (shared * (a + b) >= (size + other) * a)


def likely_pairs(matches: DataFrame, wanted: Fraction, enough: int | None = None) -> DataFrame:
    """(u, v) of the matches (u, v) of heads, one for each shared element. Of the two heads let one end first: what the sets
    share up to there is counted, what comes later lies in the rest of that set. Pairs too far apart even so are dropped,
    unless they share ``enough`` elements."""
    a, b = wanted.numerator, wanted.denominator
    sides = matches.where(may_be_close("u", "v", wanted)).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    counted = sides.groupBy(F.col("u.node").alias("u"), F.col("v.node").alias("v")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.col("u.size").cast("long")).alias("size"), F.max(F.col("v.size").cast("long")).alias("other"))
    return counted.where(f"(n + (greatest(size, other) * {a} + {b - 1}) div {b} - 1) * {a + b} >= (size + other) * {a}" + (f" or n >= {enough}" if enough else "")).select("u", "v")


def similar_links(texts: DataFrame, heads: DataFrame, pairs: DataFrame, wanted: Fraction, shingle: int, seed: int) -> DataFrame:
    """Those of ``pairs(u, v)`` of nodes whose sets are close enough; ``heads(node, row)`` names a row of ``texts`` for each node."""
    a, b = wanted.numerator, wanted.denominator
    needed = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(heads.select("node", "row"), "node")
    sets = written(texts.join(needed, "row").dropDuplicates(["node"]).select("node", "text").mapInArrow(
        in_tasks(__name__, "set_batches", shingle, seed), "node long, hashes array<long>"), "shingle-sets")
    of = lambda end: sets.select(F.col("node").alias(end), F.col("hashes").alias(f"{end}_set"))
    shared = F.size(F.array_intersect("u_set", "v_set")).cast("long")
    return written(pairs.join(of("u"), "u").join(of("v"), "v").where(shared * (a + b) >= (F.size("u_set") + F.size("v_set")).cast("long") * a).select("u", "v"), "similar-links")


def simhash_pairs(heads: DataFrame) -> DataFrame:
    """(u, v) of nodes whose fingerprints are equal or differ in ``DISTANCE`` bits at most: each node with the least of its
    fingerprint, and the least ones of two fingerprints that ``fingerprint_links`` links."""
    least = written(heads.groupBy("fp").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")), "node-fingerprints")
    of = lambda end: least.select(F.col("fp").alias(end), F.col("least").alias(f"{end}_node"))
    across = fingerprint_links(least.select("fp")).join(of("u"), "u").join(of("v"), "v").select(
        F.greatest("u_node", "v_node").alias("u"), F.least("u_node", "v_node").alias("v"))
    inside = heads.select("fp", F.col("node").alias("u")).join(least.where("n > 1").select("fp", F.col("least").alias("v")).hint("rebalance"), "fp").where("u <> v")
    return written(across.unionByName(inside.select("u", "v")).distinct(), "simhash-pairs")


def set_components(docs: DataFrame, id: str, text: str, shingle: int, seed: int, similarity: float) -> DataFrame:
    """(row, first) of each row of ``docs``: its ``row_key`` and the least one that links reach."""
    wanted = Fraction(str(similarity))
    texts = docs.select(row_key(id, text).alias("row"), F.col(text).alias("text"))
    kind = texts.schema["row"].dataType.simpleString()
    rows = written(texts.mapInArrow(in_tasks(__name__, "head_batches", shingle, seed, wanted, *frequent(texts, shingle, seed)),
                                    f"row {kind}, node long, fp long, size int, head array<long>"), "shingle-heads")
    heads = written(rows.groupBy("node").agg(F.min("row").alias("row"), F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("head").alias("head")), "distinct-shingle-heads")
    dealt = heads.select("node", "size", F.posexplode("head").alias("at", "key")).select("key", F.struct("node", "size", "at").alias("u"))
    lists = dealt.groupBy("key").agg(F.min("u").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n").hint("rebalance")
    shared = written(dealt.join(lists, "key"), "shingle-postings")
    close = simhash_pairs(heads)
    stars = likely_pairs(shared.where("u.node <> v.node"), wanted, 2)
    stars = written(close.unionByName(stars).distinct(), "star-pairs")  # n counts a part of the lists here; what is missed comes below
    links = similar_links(texts, heads, stars, wanted, shingle, seed)

    parts = connected_components(links).withColumnRenamed("node", "of").hint("rebalance")
    named = written(shared.drop("v").join(parts, F.col("u.node") == F.col("of"), "left").select("key", "u", F.coalesce("component", "u.node").alias("part")), "named-postings")
    mixed = named.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count(F.lit(1)).alias("n")).where("low <> high")\
        .select("key", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")).hint("rebalance")
    split = named.join(mixed, "key").withColumn("chunk", F.pmod(F.xxhash64("u.node"), "chunks").cast("int")).select("key", "u", "part", "chunk", F.explode(F.transform(
        F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.struct(F.least("chunk", o).alias("left"), F.greatest("chunk", o).alias("right")))).alias("g"))
    split = split.select("key", "g.left", "g.right", "u", "part", "chunk")
    other = split.select("key", "left", "right", F.col("u").alias("v"), F.col("part").alias("v_part"), F.col("chunk").alias("v_chunk"))
    pairs = likely_pairs(split.where("chunk = left").join(other.where("v_chunk = right"), ["key", "left", "right"]).where("part <> v_part and (left < right or u.node < v.node)"), wanted)
    links = links.unionByName(similar_links(texts, heads, written(pairs.join(stars, ["u", "v"], "left_anti"), "other-pairs"), wanted, shingle, seed))

    parts = connected_components(links).withColumnRenamed("node", "of")
    found = heads.select("node", "row").join(parts, F.col("node") == F.col("of"), "left").select("node", "row", F.coalesce("component", "node").alias("component"))
    least = found.groupBy("component").agg(F.min("row").alias("first")).hint("rebalance")
    return rows.select("row", "node").join(found.join(least, "component").select("node", "first").hint("rebalance"), "node").select("row", "first")


def similar_sets(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED, similarity: float = SIMILARITY) -> DataFrame:
    """(id, component_id) of each row; the component is the smallest id that links reach."""
    return set_components(docs, id, text, shingle, seed, similarity).select(F.col("row.id").alias("id"), F.col("first.id").alias("component_id"))


def drop_similar_sets(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each component, as ``first_of_components`` chooses it."""
    return first_of_components(docs, set_components(docs, id, text, shingle, seed, similarity), id, text)
