"""Quality of documents by attention over their passages: multiple-instance learning from document labels.

A text is cut into passages of 64 words; every passage of the whole text is encoded from its shares of letter pairs
(hashed) and of kinds of characters, word lengths and repetition, through a learned layer h. A gated attention weight
a ~ exp(w . (tanh(V h) * sigmoid(U h))) is learned with it from the labels of documents alone, and a document's score
is the logistic of c . (sum of a h) + b. For scoring, a passage comes down to two numbers, its attention and c . h.

Fitted on a bounded sample of the labelled rows: per class those with the smallest hash of their id, ``PER_CLASS`` at
most and while their texts add up to ``CHARS`` characters at most; weights bring the classes back to their shares among
all labels. Rows whose crc32(id as text) mod 3 is 1 are held out. Only the text is an input of a score.

Null and empty texts, and texts of white space alone, are one passage without words, scored like any other; texts of any
length are encoded in segments of 1 MiB, cut at white space, where a passage ends too. Labels that repeat count with
the largest quality, null labels are skipped, and labels of unknown documents count in the shares of the classes alone;
with labels of one class, or without documents of both, every score is the share of label 1 (0.5 without any label). A
null id is not held out, nor learned from. Repeated rows are scored alike; empty tables give empty tables; extra columns pass through unless they carry the name of
an output column, which then wins.
"""

from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stoplens.llm.common import in_tasks, written

PASSAGE = 64  # words
SEGMENT = 1 << 20  # bytes encoded at once
BUCKETS = 256
PER_CLASS = 3000  # documents of a class
CHARS = 5_000_000  # characters of a class
HIDDEN, GATES = 24, 12
EPOCHS, STEP, DECAY = 24, 0.01, 1e-3
OUTPUT = ("score", "predicted", "n_passages", "focus", "focus_weight")

SPACES = b" \t\n\r\x0b\x0c"
KINDS = (bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789", b"#$%&*|<>", b".,;:!?'\"()-", b"\n", bytes(range(128, 256)))
KIND_OF = np.full(256, len(KINDS), np.int64)
for _kind, _members in enumerate(KINDS):
    KIND_OF[list(_members)] = _kind
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
LOWER = np.arange(256)
LOWER[65:91] += 32
_order = np.random.default_rng(7)
PAIR = _order.integers(0, BUCKETS, (256, 256), np.int64).ravel()  # bucket of a pair of bytes
MIX = _order.integers(1, 2 ** 63, 256, np.uint64) | np.uint64(1)
PLACE = _order.integers(1, 2 ** 63, 64, np.uint64) | np.uint64(1)
STATS = 6
FEATURES = BUCKETS + len(KINDS) + 1 + STATS


def segments(text: bytes) -> list[bytes]:
    """The text in pieces of ``SEGMENT`` bytes or a little more, each ending before white space."""
    out, begin = [], 0
    while len(text) - begin > SEGMENT:
        end = begin + SEGMENT
        while end < len(text) and text[end] not in SPACES:
            end += 1
        out.append(text[begin:end])
        begin = end
    return [*out, text[begin:]]


def encode(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(features, piece) of all passages of the pieces, in order; a piece without words has one passage, all zeros."""
    lengths = np.array([len(p) + 1 for p in pieces])
    begins = np.concatenate([[0], np.cumsum(lengths)])
    text = np.frombuffer(b"\n".join(pieces) + b"\n", np.uint8)
    space = IS_SPACE[text]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    ends = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
    piece = np.searchsorted(begins, starts, "right") - 1
    words = np.bincount(piece, minlength=len(pieces))
    rank = np.arange(len(starts)) - np.concatenate([[0], np.cumsum(words)])[piece]
    count = np.maximum(-(-words // PASSAGE), 1)
    first = np.concatenate([[0], np.cumsum(count)])
    total = int(first[-1])
    passage = first[piece] + rank // PASSAGE  # of each word
    features = np.zeros((total, FEATURES), np.float32)
    owner = np.repeat(np.arange(len(pieces)), count)
    if not len(starts):
        return features, owner
    # a character belongs to the passage of the last word that begins at or before it, up to the end of the piece
    at = np.repeat(passage, np.diff(np.concatenate([starts, [len(text)]])))
    inner = np.arange(starts[0], len(text)) < begins[1:][owner[at]] - 1
    at, body = at[inner], text[starts[0]:][inner]
    own = LOWER[body]
    pairs = np.bincount(at[:-1] * BUCKETS + PAIR[own[:-1] * 256 + own[1:]], (at[:-1] == at[1:]).astype(np.float64), total * BUCKETS).reshape(total, BUCKETS)
    features[:, :BUCKETS] = np.sqrt(pairs / np.maximum(pairs.sum(axis=1, keepdims=True), 1))
    kinds = np.bincount(at * (len(KINDS) + 1) + KIND_OF[body], minlength=total * (len(KINDS) + 1)).reshape(total, -1)
    features[:, BUCKETS:BUCKETS + len(KINDS) + 1] = np.sqrt(kinds / np.maximum(kinds.sum(axis=1, keepdims=True), 1))
    size = ends - starts
    inside = ~space
    place = (np.flatnonzero(inside) - np.repeat(starts, size)) & 63
    mixed = MIX[text[inside]] * PLACE[place]
    hashed = np.add.reduceat(mixed, np.concatenate([[0], np.cumsum(size)[:-1]])) ^ size.astype(np.uint64)
    n = np.bincount(passage, minlength=total)
    least = np.maximum(n, 1)
    known = np.unique(hashed ^ (passage.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    again = np.concatenate([[False], (hashed[1:] == hashed[:-1]) & (passage[1:] == passage[:-1])])
    mean = np.bincount(passage, size, total) / least
    spread = np.sqrt(np.maximum(np.bincount(passage, size.astype(float) ** 2, total) / least - mean ** 2, 0))
    distinct = np.bincount(passage[known], minlength=total) / least
    capital = np.bincount(passage, KIND_OF[text[starts]] == 0, total) / least
    stats = [np.log1p(n), distinct, np.bincount(passage, again, total) / least, np.log1p(mean), np.log1p(spread), capital]
    features[:, -STATS:] = np.stack(stats, axis=1)
    return features, owner


def rounds(texts: list[bytes]):
    """(documents, pieces) with some ``SEGMENT`` bytes each."""
    documents, pieces, size = [], [], 0
    for i, text in enumerate(texts):
        for piece in segments(text):
            documents.append(i)
            pieces.append(piece)
            size += len(piece)
            if size >= SEGMENT:
                yield np.array(documents), pieces
                documents, pieces, size = [], [], 0
    if pieces:
        yield np.array(documents), pieces


@dataclass
class Attention:
    """Layer (mean, scale, E, e), gates V and U with w, classifier c and b."""
    mean: np.ndarray
    scale: np.ndarray
    E: np.ndarray
    e: np.ndarray
    V: np.ndarray
    U: np.ndarray
    w: np.ndarray
    c: np.ndarray
    b: np.ndarray

    def passages(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Attention before the softmax, and c . h, of each passage."""
        h = np.tanh((features - self.mean) / self.scale @ self.E + self.e)
        return (np.tanh(h @ self.V) / (1 + np.exp(-(h @ self.U)))) @ self.w, h @ self.c


LEARNED = ("E", "e", "V", "U", "w", "c", "b")


def slopes(model: Attention, x: np.ndarray, counts: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Weighted mean log-loss of a batch of documents, and its slopes. x: standardised features, passages of a document
    next to each other; counts: passages of each document."""
    begin = np.concatenate([[0], np.cumsum(counts)[:-1]])
    doc = np.repeat(np.arange(len(counts)), counts)
    h = np.tanh(x @ model.E + model.e)
    t, g = np.tanh(h @ model.V), 1 / (1 + np.exp(-(h @ model.U)))
    s = (t * g) @ model.w
    a = np.exp(s - np.maximum.reduceat(s, begin)[doc])
    a /= np.add.reduceat(a, begin)[doc]
    z = np.add.reduceat(a[:, None] * h, begin)
    score = 1 / (1 + np.exp(-np.clip(z @ model.c + model.b[0], -30, 30)))
    part = weight / weight.sum()
    loss = -(part * np.where(label > 0, np.log(score), np.log1p(-score))).sum()
    dy = (score - label) * part
    dz = (dy[:, None] * model.c)[doc]
    da = (h * dz).sum(axis=1)
    ds = a * (da - np.add.reduceat(a * da, begin)[doc])
    dt, dg = ds[:, None] * model.w * g * (1 - t * t), ds[:, None] * model.w * t * g * (1 - g)
    dh = (a[:, None] * dz + dt @ model.V.T + dg @ model.U.T) * (1 - h * h)
    return loss, {"E": x.T @ dh, "e": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ ds, "c": z.T @ dy, "b": dy.sum(keepdims=True)}


def fit_attention(features: np.ndarray, counts: np.ndarray, label: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, seed: int = 1) -> Attention:
    """Adam steps over batches of 128 documents."""
    rng = np.random.default_rng(seed)
    mean, scale = features.mean(axis=0, dtype=np.float64), features.std(axis=0, dtype=np.float64)
    scale = np.where(scale > 1e-6, scale, 1.0)
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    model = Attention(mean, scale, draw(features.shape[1], HIDDEN), np.zeros(HIDDEN), draw(HIDDEN, GATES), draw(HIDDEN, GATES), draw(GATES), draw(HIDDEN), np.zeros(1))
    begin = np.concatenate([[0], np.cumsum(counts)])
    m, v = ({k: np.zeros_like(getattr(model, k)) for k in LEARNED} for _ in range(2))
    batches = -(-len(counts) // 128)
    step, steps = 0, epochs * batches
    for _ in range(epochs):
        for chosen in np.array_split(rng.permutation(len(counts)), batches):
            step += 1
            rows = np.concatenate([np.arange(begin[d], begin[d + 1]) for d in chosen])
            _, slope = slopes(model, (features[rows] - mean) / scale, counts[chosen], label[chosen], weight[chosen])
            for k in LEARNED:
                value = getattr(model, k)
                m[k] = 0.9 * m[k] + 0.1 * slope[k]
                v[k] = 0.999 * v[k] + 0.001 * slope[k] ** 2
                rate = STEP * (1 - step / (steps + 1))
                value -= rate * (m[k] / (1 - 0.9 ** step) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-9) + (DECAY * value if k != "b" else 0))
    return model


def feature_batches(batches):
    """(label, passages, features as bytes of 32-bit floats) of each document of the sample."""
    for batch in batches:
        texts = [t.as_py() or b"" for t in batch.column(1)]
        parts: list[list[np.ndarray]] = [[] for _ in texts]
        for documents, pieces in rounds(texts):
            features, owner = encode(pieces)
            cuts = np.searchsorted(owner, np.arange(len(pieces) + 1))
            for k, d in enumerate(documents):
                parts[d].append(features[cuts[k]:cuts[k + 1]])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sum(map(len, p)) for p in parts], pa.int32()),
                                          pa.array([np.concatenate(p).tobytes() for p in parts], pa.binary())], ["label", "passages", "features"])


def score_batches(batches, fitted: tuple):
    model = Attention(*fitted)
    for batch in batches:
        texts = [t.as_py() or b"" for t in batch.column(1)]
        s, v, owners = [], [], []
        for documents, pieces in rounds(texts):
            features, owner = encode(pieces)
            got = model.passages(features)
            s.append(got[0])
            v.append(got[1])
            owners.append(documents[owner])
        if not texts:
            continue
        s, v, doc = np.concatenate(s), np.concatenate(v), np.concatenate(owners)
        begin = np.searchsorted(doc, np.arange(len(texts)))
        a = np.exp(s - np.maximum.reduceat(s, begin)[doc])
        a /= np.add.reduceat(a, begin)[doc]
        score = 1 / (1 + np.exp(-np.clip(np.add.reduceat(a * v, begin) + model.b[0], -30, 30)))
        counts = np.diff(np.append(begin, len(doc)))
        most = np.maximum.reduceat(a, begin)
        focus = np.array([int(a[b:b + n].argmax()) for b, n in zip(begin, counts, strict=True)], np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(counts.astype(np.int64)), pa.array(focus), pa.array(most)],
                                         ["row", "score", "n_passages", "focus", "focus_weight"])


def held_out(id: Column) -> Column:
    """True for the third of the ids whose labels are never learned from; a null id is not held out."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, id: str, text: str, per_class: int, chars: int) -> DataFrame:
    """(label, text): at most ``per_class`` documents a class and ``chars`` characters, by the smallest hash of the id."""
    chosen = None
    for label in (0, 1):
        part = labels.where(F.col("label") == label).orderBy(F.xxhash64("_id"), "_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    # at most 2 * per_class ids; documents that share an id are bounded by the running sum below
    found = docs.select(F.col(id).alias("_id"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "_id")
    one = found.groupBy("_id", "label").agg(F.min("text").alias("text"))
    running = F.sum(F.coalesce(F.length("text"), F.lit(0))).over(Window.partitionBy("label").orderBy(F.xxhash64("_id"), "_id"))
    return one.withColumn("running", running).where(F.col("running") <= chars).select("label", F.col("text").cast("binary").alias("text"))


def fit_quality(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: Column | None = None, per_class: int = PER_CLASS,
                chars: int = CHARS) -> Attention | float:
    """The model, or the one score of all documents where there is nothing to learn. The driver gets two counts and the
    passages' features of the sample: at most 2 * ``chars`` / 64 words of some characters, 1.1 kB each."""
    value = F.col("quality") if label is None else label
    usable = labels.select(F.col(id).alias("_id"), value.cast("int").alias("label")).where(F.col("_id").isNotNull() & ~held_out(F.col("_id")) & F.col("label").isin(0, 1))\
        .groupBy("_id").agg(F.max("label").alias("label"))
    shares = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    constant = shares.get(1, 0) / sum(shares.values()) if shares else 0.5
    if len(shares) < 2:
        return constant
    sample = written(labelled_sample(docs, usable, id, text, per_class, chars).mapInArrow(
        in_tasks(__name__, "feature_batches"), "label int, passages int, features binary"), "passage-sample")
    rows = sample.orderBy("label", F.xxhash64("features"), "passages").collect()
    found = np.array([r["label"] for r in rows], np.float64)
    if len(set(found.tolist())) < 2:
        return constant
    counts = np.array([r["passages"] for r in rows])
    features = np.frombuffer(b"".join(r["features"] for r in rows), np.float32).reshape(-1, FEATURES)
    weight = np.where(found > 0, shares[1] / (found > 0).sum(), shares[0] / (found == 0).sum())
    return fit_attention(features, counts, found, weight)


def score_quality(docs: DataFrame, model: Attention | float, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of ``docs`` (default: all) with score, predicted, the number of passages, the passage with
    the most attention (from 0, the first on ties) and its weight. Where the model is one number, the last three are null."""
    columns = [c for c in (docs.columns if carry is None else carry) if c not in OUTPUT or c == text]
    extra = {"score": "double", "n_passages": "long", "focus": "long", "focus_weight": "double"}
    if isinstance(model, float):
        scored = docs.select(*columns, *[F.lit(model if c == "score" else None).cast(kind).alias(c) for c, kind in extra.items()])
    else:
        row = F.struct(*columns)
        kind = docs.select(row.alias("row")).schema["row"].dataType.simpleString()
        scored = docs.select(row.alias("row"), F.col(text).cast("string").cast("binary").alias("text")).mapInArrow(
            in_tasks(__name__, "score_batches", astuple(model)), f"row {kind}, " + ", ".join(f"{c} {kind}" for c, kind in extra.items())).select("row.*", *extra)
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
