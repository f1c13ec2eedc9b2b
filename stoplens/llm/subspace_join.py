"""Near-duplicate vectors by a subspace pigeonhole join.

For unit vectors a cosine of at least c is a squared distance of at most 2 - 2c. Vectors are rotated and cut into
blocks; each block gets a share of that squared distance proportional to its dimensions, so a close pair stays within
its share in one block at least. Each block is range-joined on its first coordinate: a vector meets those that lie
within the block's reach. Candidates are verified by their cosine in double precision. A pair counts in the first
block whose share it keeps, so nothing has to be removed afterwards.

Equal vectors of a label are collapsed first and count with their number. The vectors of a label are dealt out by pairs of
chunks, each once to every pair that its chunk is in (three times, in larger labels as often as there are chunks of
``CHUNK_VALUES`` components), and never by blocks or cells: a group joins all blocks of its pair of chunks in
memory, a tile of distances at a time. It returns link counts and a spanning set of links, one row per vector, never pairs.

Vectors that are null, zero, or hold null or non-finite components, and rows without label, link with nothing (and are
their own component); vectors of different length never link; repeated rows are further vectors; empty tables give
empty tables; extra columns are not carried (join on the id).
"""

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stoplens.llm.common import in_tasks, written
from stoplens.llm.components import connected_components, local_roots

COSINE = 0.93
BLOCK = 8  # dimensions of a block
CHUNK = 4096  # vectors of a chunk, where a label has no more than ``PARTS`` of them
PARTS = 3  # chunks of a larger label
CHUNK_VALUES = 1 << 22  # components of a chunk at most: labels beyond have more chunks
SLACK = 1e-6  # added to the squared distance for rounding; the cosine decides
NEAR = 4e-6  # added to a block's share where its distance is worked out in single precision
GUARD = 1e-9  # values from a matrix product that are so near to a limit are worked out pair by pair
LEFT, RIGHT = 256, 2048  # vectors of a tile
PAIRS = 100_000  # pairs that are worked out, or linked, at a time


@lru_cache(maxsize=8)
def rotation(dims: int) -> np.ndarray:
    q, _ = np.linalg.qr(np.random.default_rng(7).standard_normal((dims, dims)))
    return np.ascontiguousarray(q)


def rotated(vectors: np.ndarray) -> np.ndarray:
    unit = vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))
    return np.einsum("ij,kj->ik", unit, rotation(vectors.shape[1]))  # row by row, so equal in every task


def bounds(dims: int) -> list[tuple[int, int]]:
    return [(b, min(b + BLOCK, dims)) for b in range(0, dims, BLOCK)]


def budgets(dims: int, cosine: float) -> np.ndarray:
    return (2 - 2 * cosine + SLACK) * np.array([(b - a) / dims for a, b in bounds(dims)])


class Pairs:
    """Distances and cosines of pairs of the vectors of a group, and what their links came to."""

    def __init__(self, raw: np.ndarray, n: np.ndarray, cosine: float):
        self.raw, self.n, self.cosine, self.dims = raw, n, cosine, raw.shape[1]
        slices = [raw[at:at + 4096].astype(np.float64) for at in range(0, len(raw), 4096)]
        self.turned = np.concatenate([rotated(x) for x in slices])
        self.norm = np.concatenate([np.sqrt((x * x).sum(1)) for x in slices])
        self.edges, self.shares = bounds(self.dims), budgets(self.dims, cosine)
        self.links = np.zeros(len(raw), np.int64)
        self.root = np.arange(len(raw))
        self.held: list[tuple[np.ndarray, np.ndarray]] = []

    def within(self, p: np.ndarray, q: np.ndarray, block: int) -> np.ndarray:
        part = self.turned[p, slice(*self.edges[block])] - self.turned[q, slice(*self.edges[block])]
        return (part * part).sum(1) <= self.shares[block]

    def close(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        x, y = self.raw[p].astype(np.float64), self.raw[q].astype(np.float64)
        return np.einsum("ij,ij->i", x, y) / (self.norm[p] * self.norm[q]) >= self.cosine

    def few(self, p: np.ndarray, q: np.ndarray, block: int) -> None:
        """Candidates of a block, pair by pair."""
        for at in range(0, len(p), PAIRS):
            u, v = p[at:at + PAIRS], q[at:at + PAIRS]
            for k in range(block):
                if not len(u):
                    break
                rest = ~self.within(u, v, k)
                u, v = u[rest], v[rest]
            keep = self.within(u, v, block)
            u, v = u[keep], v[keep]
            keep = self.close(u, v)
            u, v = u[keep], v[keep]
            np.add.at(self.links, u, self.n[v])
            np.add.at(self.links, v, self.n[u])
            self.join(u, v)

    def many(self, p: np.ndarray, q: np.ndarray, near: np.ndarray, block: int) -> None:
        """Candidates of a block as a mask over p and q, by matrix products: most of a tile are near copies."""
        def judged(values: np.ndarray, limit: float, exact) -> np.ndarray:
            sure = values <= limit
            i, j = np.nonzero(near & (np.abs(values - limit) <= GUARD))
            sure[i, j] = exact(p[i], q[j])
            return sure

        for k in range(block + 1):
            x, y = self.turned[p, slice(*self.edges[k])], self.turned[q, slice(*self.edges[k])]
            kept = judged((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T), self.shares[k], lambda u, v, k=k: self.within(u, v, k))
            near = near & (kept if k == block else ~kept)
            if not near.any():
                return
        x, y = (self.raw[z].astype(np.float64) / self.norm[z][:, None] for z in (p, q))
        near = near & judged(-(x @ y.T), -self.cosine, self.close)
        self.links[p] += (near @ self.n[q].astype(np.float64)).astype(np.int64)
        self.links[q] += (self.n[p].astype(np.float64) @ near).astype(np.int64)
        i, j = np.nonzero(near & (self.root[p][:, None] != self.root[q][None, :]))
        self.join(p[i], q[j])

    def join(self, p: np.ndarray, q: np.ndarray) -> None:
        p, q = self.root[p], self.root[q]
        apart = p != q
        if apart.any():
            self.held.append((p[apart], q[apart]))
        if sum(len(x) for x, _ in self.held) > PAIRS:
            self.settle()

    def settle(self) -> None:
        if self.held:
            self.root = local_roots(len(self.root), *(np.concatenate([x[s] for x in self.held]) for s in (0, 1)))[self.root]
            self.held = []

    def range_join(self, left: np.ndarray, right: np.ndarray, block: int, one: bool) -> None:
        """All pairs of left and right (each pair once where they are the same) that a block's share lets through."""
        (a, b), share = self.edges[block], self.shares[block]
        reach = np.sqrt(share) * (1 + 1e-9)
        left, right = (z[np.argsort(self.turned[z, a], kind="stable")] for z in (left, right))
        x, y = self.turned[left, a:b], self.turned[right, a:b]
        ones, start = np.ones((len(left), 1)), x[:, 0]
        at = np.concatenate([x, (x * x).sum(1, keepdims=True), ones], 1).astype(np.float32)
        to = np.concatenate([-2 * y, np.ones((len(right), 1)), (y * y).sum(1, keepdims=True)], 1).astype(np.float32)
        for s in range(0, len(left), LEFT):
            e = min(s + LEFT, len(left))
            lo = s if one else int(np.searchsorted(y[:, 0], start[s] - reach, "left"))
            hi = int(np.searchsorted(y[:, 0], start[e - 1] + reach, "right"))
            for c in range(lo, hi, RIGHT):
                d = min(c + RIGHT, hi)
                near = at[s:e] @ to[c:d].T <= share + NEAR
                if one and c < e:
                    near &= np.arange(s, e)[:, None] < np.arange(c, d)[None, :]
                found = np.flatnonzero(near)
                if not len(found):
                    continue
                i, j = np.divmod(found, d - c)
                rows, cols = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
                if len(found) > 1000 and 8 * len(found) > len(rows) * len(cols):
                    self.many(left[s + rows], right[c + cols], near[np.ix_(rows, cols)], block)
                else:
                    self.few(left[s + i], right[c + j], block)


def linked(table: pa.Table, cosine: float) -> pa.Table:
    """Links inside a pair of chunks: (node, n_links, root) of each vector that has any."""
    dims, left, right = (table[c][0].as_py() for c in ("dims", "left", "right"))
    node, n, chunk = (table[c].to_numpy() for c in ("node", "n", "chunk"))
    raw = np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in table["v"].chunks]).reshape(-1, dims)
    pairs, one = Pairs(raw, n, cosine), left == right
    first = np.flatnonzero(chunk == left)
    second = first if one else np.flatnonzero(chunk == right)
    for block in range(len(pairs.edges)):
        pairs.range_join(first, second, block, one)
    pairs.settle()
    least = np.full(len(node), np.iinfo(np.int64).max)
    np.minimum.at(least, pairs.root, node)
    has = pairs.links > 0
    return pa.table({"node": node[has], "n_links": pairs.links[has], "root": least[pairs.root[has]]})


def chunk_pairs(alike: DataFrame) -> DataFrame:
    """(label, dims, left, right, node, n, v, chunk): each vector once for every pair of chunks of its label that its chunk is in."""
    count = F.count(F.lit(1))
    chunks = F.greatest(F.least(F.ceil(count / CHUNK), F.lit(PARTS)), F.ceil(count * F.col("dims") / CHUNK_VALUES)).cast("int")
    sizes = written(alike.groupBy("label", "dims").agg(count.alias("vectors"), chunks.alias("chunks")).where("vectors > 1").drop("vectors"), "vector-chunks")
    parts = alike.join(sizes, ["label", "dims"]).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    dealt = parts.select("label", "dims", "node", "n", "v", "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    return dealt.select("label", "dims", F.least("chunk", "other").alias("left"), F.greatest("chunk", "other").alias("right"), "node", "n", "v", "chunk")


def vector_links(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE) -> DataFrame:
    """(id, n_links, component_id, kept) of each row.

    Rows find their vector's result again by two 64-bit hashes, so that whole vectors are dealt out for the collapse and the chunks only.
    """
    v = F.col(vector)
    usable = F.col(label).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    kind = "array<float>" if dict(vectors.dtypes)[vector] == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id).alias("id"), F.col(label).cast("long").alias("label"), F.when(usable, v.cast(kind)).alias("v"))
    marks = [F.xxhash64("v").alias("first_mark"), F.xxhash64(F.lit(1), "v").alias("second_mark")]
    alike = rows.where("v is not null").groupBy("label", "v").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n"))
    alike = written(alike.where("node is not null").select("label", "node", "n", F.size("v").alias("dims"), "v", *marks), "vectors")
    key = ["label", "dims", "left", "right"]
    width = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, as coalesced tasks would hold few bytes and many pairs
    pairs = chunk_pairs(alike).repartition(width, *key).groupBy(*key)
    found = pairs.applyInArrow(in_tasks(__name__, "linked", cosine), "node long, n_links long, root long")
    found = written(found, "vector-links")
    parts_of = connected_components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    result = alike.join(found.groupBy("node").agg(F.sum("n_links").alias("n_links")), "node", "left")\
        .join(parts_of.withColumnRenamed("component", "least"), "node", "left")\
        .select("label", "first_mark", "second_mark", (F.col("n") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links"), F.coalesce("least", "node").alias("least"))
    known = rows.select("id", "label", *[F.when(F.col("v").isNotNull(), m).alias(c) for c, m in zip(("first_mark", "second_mark"), marks, strict=True)])\
        .join(result.hint("rebalance"), ["label", "first_mark", "second_mark"], "left")
    return known.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("least", "id").alias("component_id"))\
        .withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
