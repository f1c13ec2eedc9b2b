"""Near-duplicate grouping of notes inside the same operating context.

Notes join a group when their TF-IDF cosine with *every* member reaches the threshold; texts are taken in code-point
order and the lowest group wins. The rules are sequential, the computation is not:

* equal texts collapse first, with partial aggregation, so copies cost nothing;
* texts fall into independent parts: those of one context and negation, and where these are many, those linked by
  chains of shared prefix terms (similar texts share one). Links go to the least text of a posting list, so a family of
  n near copies has O(n) of them. A part of up to ``PART_ENTRIES`` weights is settled in one small group, in the order of the
  rules: a text is compared with the founders of groups that share a term with it, and with a member only where
  their distances from the founder leave the answer open;
* terms are 64-bit hashes, counted as arrays by ranges of hashes. A piece of consecutive texts asks once for each of its terms and
  gets back those that several texts have; a text's vector is worked out beside its piece's answers, so terms of single texts
  are never shuffled. Only texts that share a prefix term with one that could be similar keep their vectors;
* a larger part has its similar pairs from an exact prefix-filter join (no pair is formed unless it shares a rare term
  and its norm bound allows the threshold); long posting lists are cut into chunks joined chunk by chunk. Its greedy
  assignment is the fixed point of a set-based update, repeated until nothing changes: by induction over the text
  order that is the sequential result, and no such part is ever held by one task;
* tables that grew out of ``explode`` are joined with a merge hint, because size estimates do not see the growth.
"""

from math import acos, log2, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stoplens import fixed_values as fv
from stoplens.functions import text
from stoplens.operators.skew import lookup_join
from stoplens.session import cut_lineage, shuffle_partitions, staged

POSTING_CHUNK = 2000
RANK_CHUNK_BITS = 16
SLACK = 1e-12
TAIL_SLACK = 1e-9  # of tails, which are running sums over a piece: more terms than needed go to a prefix, the cosine decides
PART_ENTRIES = 1_000_000  # weights of the texts that are settled in one group
RANGE_CHARS = 32_000_000  # characters of text whose terms are counted in one group
PIECE_WORDS = 1 << 20  # words that a task turns into terms at a time
PIECE_CHARS = 8_000_000  # characters of the texts of a piece, about
PIECE_BITS, BLOCK_BITS = 11, 11  # consecutive texts whose vectors are put together (fewer if they are long), or compared, in one group


def with_context(stops: DataFrame) -> DataFrame:
    """J1 + J2: hashed context (6 fields), machine column (3 fields) and the text that is compared.

    An empty note gets a text of its own: it is never evidence of repetition.
    """
    key = lambda fields: F.md5(F.concat_ws("\x1f", "analysis_id", *[text.header_key(f) for f in fields]))
    return stops.withColumns({
        "bucket": key(fv.CONTEXT_FIELDS), "column_id": key(fv.MACHINE_FIELDS),
        "text": F.coalesce(F.nullif("observacao_normalizada", F.lit("")), F.concat(F.lit("__empty_"), F.col("id").cast("string"))),
    })


def machine_columns(keyed: DataFrame) -> DataFrame:
    """One column per machine in context, named as its first stop wrote it."""
    first = F.min_by(F.struct(F.col("equipamento").alias("name"), F.col("centro").alias("unit"), F.col("linha").alias("line")), "id")
    return keyed.groupBy("analysis_id", "column_id").agg(first.alias("f")).select(
        "analysis_id", "column_id", "f.*", F.lit(False).alias("validated"))


def distinct_texts(keyed: DataFrame) -> DataFrame:
    """One row per (context, text) with its number of stops, ranked by (context, text) code points.

    ``vid`` grows along a range-partitioned sort, so comparing two vids compares their texts.
    """
    grouped = keyed.groupBy("bucket", "text").agg(F.count(F.lit(1)).alias("n"))
    ranged = grouped.repartitionByRange(shuffle_partitions(keyed), "bucket", "text").sortWithinPartitions("bucket", "text")
    return staged(ranged.withColumn("vid", F.monotonically_increasing_id()), "distinct-texts", "zstd")


def text_terms(texts: DataFrame) -> DataFrame:
    """Normalised TF-IDF weights of word 1-2-grams per context with more than one text.

    idf = ln((1 + texts) / (1 + texts with the term)) + 1. ``tail`` is the norm of a text's terms from this one on, in
    (document frequency, term) order: the bound the prefix filter uses.
    """
    sizes = texts.groupBy("bucket").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1")
    shared = lookup_join(texts, sizes, ["bucket"], "inner")
    words = F.regexp_extract_all("text", F.lit(r"(?U)\w+"), 0)
    pairs = F.transform(F.slice("words", 1, F.greatest(F.lit(0), F.size("words") - 1)),
                        lambda w, i: F.concat(w, F.lit(" "), F.get("words", i + 1)))
    counted = (shared.select("bucket", "vid", "texts", words.alias("words"))
               .select("bucket", "vid", "texts", F.explode(F.concat("words", pairs)).alias("term"))
               .groupBy("bucket", "vid", "term").agg(F.count(F.lit(1)).alias("tf"), F.max("texts").alias("texts")))
    frequency = counted.groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("df"))
    weighed = counted.join(frequency.hint("merge"), ["bucket", "term"]).withColumn(
        "raw", F.col("tf") * (F.log((1 + F.col("texts")) / (1 + F.col("df"))) + 1))
    whole = Window.partitionBy("vid")
    onward = whole.orderBy(F.desc("df"), F.desc("term")).rowsBetween(Window.unboundedPreceding, 0)
    square = F.col("raw") * F.col("raw")
    norm = F.sqrt(F.sum(square).over(whole))
    return weighed.select("bucket", "vid", "term", "df", (F.col("raw") / norm).alias("w"),
                          (F.sqrt(F.sum(square).over(onward)) / norm).alias("tail"))


def context_sizes(texts: DataFrame) -> DataFrame:
    """(bucket, texts) of the contexts with more than one text."""
    return staged(texts.groupBy("bucket").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1"), "context-sizes")


def word_hashes() -> Column:
    """64-bit hashes of the words of a text, each with its context."""
    return F.transform(F.regexp_extract_all("text", F.lit(r"(?U)\w+"), 0), lambda w: F.xxhash64("bucket", w))


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    mixed = (left ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = ((mixed ^ (mixed >> np.uint64(29))) + right) * np.uint64(0x94D049BB133111EB)
    return mixed ^ (mixed >> np.uint64(32))


def _lists(values: np.ndarray, cuts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(values))


def _held(table: pa.Table, name: str) -> pa.ListArray:
    held = table.column(name).combine_chunks()
    return held.chunk(0) if isinstance(held, pa.ChunkedArray) else held


def _column(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, and the row of each."""
    held = _held(table, name)
    return held.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(held)), np.diff(held.offsets.to_numpy()))


def _starts(*sorted_: np.ndarray) -> np.ndarray:
    """Where a new value begins in arrays sorted together."""
    if not len(sorted_[0]):
        return np.zeros(0, int)
    return np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([x[1:] != x[:-1] for x in sorted_])]))


def term_counts(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term, row, times) of lists of word hashes, by row and term: their words and pairs of neighbours."""
    ends = lists.offsets.to_numpy()
    words = lists.values.slice(ends[0], ends[-1] - ends[0]).to_numpy(zero_copy_only=False).view(np.uint64)
    row = np.repeat(np.arange(len(lists)), np.diff(ends))
    same = row[:-1] == row[1:]
    term = np.concatenate([words, pair_hash(words[:-1], words[1:])[same]])
    row = np.concatenate([row, row[:-1][same]])
    order = np.lexsort((term, row))
    term, row = term[order], row[order]
    first = _starts(term, row)
    return term[first], row[first], np.diff(np.append(first, len(term)))


def dealt_terms(ranges: int, bits: int):
    """For mapInArrow: (vid, words) to rows (range, piece, term, texts), one for each piece of consecutive texts and range of term
    hashes: the terms of the piece, each once, with the number of its texts that have them."""
    def run(batches):
        for batch in batches:
            lists, pieces = batch.column(1), batch.column(0).to_numpy() >> bits
            ends, start = lists.offsets.to_numpy(), 0
            while start < batch.num_rows:
                last = int(np.searchsorted(ends, ends[start] + PIECE_WORDS, "right")) - 1
                other = np.flatnonzero(pieces[start:last] != pieces[start])
                stop = max(start + 1, start + int(other[0]) if len(other) else last)
                term, texts = np.unique(term_counts(lists.slice(start, stop - start))[0], return_counts=True)
                range_ = (term % np.uint64(ranges)).astype(np.int32)
                order = np.argsort(range_, kind="stable")
                term, texts, range_ = term[order], texts[order].astype(np.int32), range_[order]
                cuts = _starts(range_)
                ends_ = np.append(cuts, len(term))
                yield pa.RecordBatch.from_arrays([pa.array(range_[cuts]), pa.array(np.full(len(cuts), pieces[start])), _lists(term.view(np.int64), ends_), _lists(texts, ends_)],
                                                 ["range", "piece", "term", "texts"])
                start = stop
    return run


def counted_terms(table: pa.Table) -> pa.Table:
    """Document frequencies inside one range of terms, for the pieces that asked. Terms of one text only are nobody's link and stay out."""
    (term, row), (texts, _) = (_column(table, c) for c in ("term", "texts"))
    order = np.argsort(term, kind="stable")
    starts = _starts(term[order])
    df = np.empty(len(term), np.int32)
    if len(term):
        df[order] = np.repeat(np.add.reduceat(texts[order], starts), np.diff(np.append(starts, len(term))))
    shared = df > 1
    cuts = np.searchsorted(row[shared], np.arange(table.num_rows + 1))
    return pa.table({"piece": table.column("piece"), "term": _lists(term[shared], cuts), "df": _lists(df[shared], cuts)})


VECTORS = "vid bigint, part bigint, terms array<bigint>, raw array<double>, norm double, lone double, tails array<double>"


def weighed_terms(counted: pa.Table, texts: pa.Table) -> tuple[np.ndarray, ...]:
    """(row, term, raw, tail, norm of each text, squared weight of its terms of one text) of a piece's texts, by row, document frequency and term."""
    (asked, _), (known, _) = (_column(counted, c) for c in ("term", "df"))
    asked, at = np.unique(asked.view(np.uint64), return_index=True)
    known = known[at]
    term, row, tf = term_counts(_held(texts, "words"))
    number, size = texts.column("texts").to_numpy().astype(np.float64), texts.num_rows
    place = np.minimum(np.searchsorted(asked, term), max(len(asked) - 1, 0))
    df = np.ones(len(term), np.int64)
    if len(asked):
        found = asked[place] == term
        df[found] = known[place[found]]
    idf = np.log((1 + number[row]) / (1 + df)) + 1
    lone = df == 1
    rest = np.bincount(row[lone], (tf[lone] * idf[lone]) ** 2, size)
    row, term, raw, df = row[~lone], term[~lone], tf[~lone] * idf[~lone], df[~lone]
    order = np.lexsort((term, df, row))
    row, term, raw = row[order], term[order], raw[order]
    square = np.bincount(row, raw * raw, size)
    norm = np.sqrt(rest + square)
    share = raw * raw / (norm * norm)[row]
    sofar = np.cumsum(share)
    before = np.concatenate([[0.0], sofar])[np.searchsorted(row, np.arange(size))]
    tail = np.sqrt(np.maximum((square / np.where(norm > 0, norm * norm, 1))[row] - (sofar - share - before[row]), 0))
    return row, term, raw, tail, norm, rest


def vectors_of_piece(threshold: float):
    """For cogrouped applyInArrow over a piece's counted terms and its texts (piece, vid, part, texts, words): the vectors of the texts."""
    def run(counted: pa.Table, texts: pa.Table) -> pa.Table:
        row, term, raw, tail, norm, rest = weighed_terms(counted, texts)
        rare = tail >= threshold - TAIL_SLACK
        cuts = np.searchsorted(row, np.arange(texts.num_rows + 1))
        keep = np.flatnonzero(cuts[1:] > cuts[:-1])
        rares = np.bincount(row[rare], minlength=texts.num_rows)
        lists = lambda values, sizes: _lists(values, np.cumsum([0, *sizes[keep]]))
        held = lambda name: pa.array(texts.column(name).to_numpy()[keep])
        return pa.table({"vid": held("vid"), "part": held("part"), "terms": lists(term.view(np.int64), np.diff(cuts)), "raw": lists(raw, np.diff(cuts)), "norm": pa.array(norm[keep]),
                         "lone": pa.array(rest[keep] / norm[keep] ** 2), "tails": lists(tail[rare], rares)})
    return run


HEADS = "range int, vids array<bigint>, lists array<bigint>, tails array<double>"


def heads_of_piece(threshold: float, ranges: int):
    """For cogrouped applyInArrow like ``vectors_of_piece``: the prefix terms of the texts, one row for each range of their lists (part and term)."""
    def run(counted: pa.Table, texts: pa.Table) -> pa.Table:
        row, term, _, tail, _, _ = weighed_terms(counted, texts)
        rare = tail >= threshold - TAIL_SLACK
        row, term, tail = row[rare], term[rare], tail[rare]
        list_ = pair_hash(texts.column("part").to_numpy().view(np.uint64)[row], term)
        range_ = (list_ % np.uint64(ranges)).astype(np.int32)
        order = np.argsort(range_, kind="stable")
        range_, row, list_, tail = range_[order], row[order], list_[order], tail[order]
        cuts = _starts(range_)
        ends = np.append(cuts, len(row))
        return pa.table({"range": range_[cuts], "vids": _lists(texts.column("vid").to_numpy()[row], ends), "lists": _lists(list_.view(np.int64), ends), "tails": _lists(tail, ends)})
    return run


def linkable(threshold: float):
    """For applyInArrow over a range of lists: (vid) of the texts that share a list with a text whose tail there, times their own, reaches the threshold."""
    def run(table: pa.Table) -> pa.Table:
        (vid, _), (list_, _), (tail, _) = (_column(table, c) for c in ("vids", "lists", "tails"))
        order = np.lexsort((-tail, list_))
        vid, list_, tail = vid[order], list_[order], tail[order]
        first = _starts(list_)
        sizes = np.diff(np.append(first, len(list_)))
        best = np.repeat(tail[first], sizes)  # of the others: the largest tail, for its own text the next
        many = sizes > 1
        best[first[many]] = tail[first[many] + 1]
        best[first[~many]] = 0
        return pa.table({"vid": np.unique(vid[tail * best >= threshold - TAIL_SLACK])})
    return run


def text_vectors(texts: DataFrame, threshold: float = fv.MIN_SIMILARITY, only_linkable: bool = False) -> DataFrame:
    """J3 as one row per text that shares a term with another: the weights of ``text_terms`` for its terms of several texts (by 64-bit
    hash, in (document frequency, hash) order; ``raw`` / ``norm`` is the weight), ``lone``, the squared weight of all its other
    terms, and the tails that reach the threshold. ``part`` names its context and negation.

    A piece of consecutive texts sends each of its terms once to the term's range of hashes, where the texts are counted, and gets
    back those of several texts. ``only_linkable`` leaves out the texts that cannot be similar to any: the two tails of a similar
    pair at its first common term, multiplied, reach the threshold. Their prefix terms are worked out first, and vectors
    for the others only.
    """
    chars, count = texts.agg(F.sum(F.length("text").cast("long")), F.count(F.lit(1))).first()
    width = shuffle_partitions(texts)
    ranges = max(width, -(-(chars or 0) // RANGE_CHARS))
    bits = max(0, min(PIECE_BITS, int(log2(max(1.0, PIECE_CHARS * max(count, 1) / max(chars or 0, 1))))))
    sizes = context_sizes(texts)
    shared = lookup_join(texts.select("bucket", "vid", "text"), sizes, ["bucket"], "inner")
    dealt = shared.select("vid", word_hashes().alias("words")).mapInArrow(dealt_terms(ranges, bits), "range int, piece bigint, term array<bigint>, texts array<int>")
    counted = staged(dealt.repartition(width, "range").groupBy("range").applyInArrow(counted_terms, "piece bigint, term array<bigint>, df array<int>"), "term-counts")

    def by_piece(chosen: DataFrame, function, schema: str) -> DataFrame:
        placed = chosen.select(F.shiftright("vid", bits).alias("piece"), "vid", "texts", "bucket", "text").repartition(width, "piece")
        placed = placed.select("piece", "vid", F.xxhash64("bucket", negation("text")).alias("part"), "texts", word_hashes().alias("words"))
        return counted.repartition(width, "piece").groupBy("piece").cogroup(placed.groupBy("piece")).applyInArrow(function, schema)

    if only_linkable:
        heads = by_piece(shared, heads_of_piece(threshold, ranges), HEADS).repartition(width, "range").groupBy("range")
        chosen = staged(heads.applyInArrow(linkable(threshold), "vid bigint").distinct(), "linkable-texts")
        shared = lookup_join(shared, chosen, ["vid"], "left_semi")
    return staged(by_piece(shared, vectors_of_piece(threshold), VECTORS), "text-vectors")


def vector_prefixes(vectors: DataFrame) -> DataFrame:
    """(vid, part, term, tail) of the terms of which a similar text shares one."""
    return vectors.select("vid", "part", "terms", F.posexplode("tails").alias("_at", "tail")).select("vid", "part", F.get("terms", F.col("_at")).alias("term"), "tail")


def negation(value: Column | str) -> Column:
    """The negation words of a text, as one comparable string."""
    words = F.split(F.col(value) if isinstance(value, str) else value, " ")
    return F.array_join(F.array_sort(F.array_intersect(words, F.array(*[F.lit(n) for n in fv.NEGATIONS]))), " ")


def dot(left: Column, right: Column) -> Column:
    """Inner product of two arrays of (term, w) by one merge over their sorted union."""
    merged = F.array_sort(F.concat(left, right))
    start = F.struct(F.lit("").alias("term"), F.lit(0.0).alias("w"), F.lit(0.0).alias("acc"))
    step = lambda s, e: F.struct(e["term"].alias("term"), e["w"].alias("w"), (
        s["acc"] + F.when(s["term"] == e["term"], s["w"] * e["w"]).otherwise(F.lit(0.0))).alias("acc"))
    return F.aggregate(merged, start, step, lambda s: s["acc"])


def heads(vectors: DataFrame) -> DataFrame:
    """(vid, heads, left, full): the prefix terms, each as 23 bits of its hash and its weight rounded up to 8 bits, the norm of the
    shared terms that follow, and of all shared terms."""
    weight = lambda i: F.get("raw", i) / F.col("norm")
    size, last = F.size("tails"), F.size("tails") - 1
    code = lambda t, i: (F.shiftleft(t.bitwiseAND(F.lit((1 << 23) - 1)), 8) + F.least(F.lit(255), F.ceil(weight(i) * 255))).cast("int")
    left = F.sqrt(F.greatest(F.lit(0.0), F.get("tails", last) * F.get("tails", last) - weight(last) * weight(last))) + TAIL_SLACK
    return vectors.select("vid", F.transform(F.slice("terms", F.lit(1), size), code).alias("heads"), left.alias("left"), F.get("tails", F.lit(0)).alias("full"))


def hopeful_pairs(threshold: float):
    """For applyInArrow over pairs of two blocks of texts and their ``heads``: the pairs that may be close enough.

    Common terms up to the end of the prefix that ends first are in both prefixes. What follows is at most ``left`` of that text times
    ``full`` of the other. Equal bits of different terms and rounded weights only add.
    """
    def run(pairs: pa.Table, vectors: pa.Table) -> pa.Table:
        vid, left, full = (vectors.column(c).to_numpy() for c in ("vid", "left", "full"))
        held, row = _column(vectors, "heads")
        order = np.lexsort((held >> 8, row))
        code, row, weight = (held >> 8)[order], row[order], (held & 255)[order] / 255.0
        first = _starts(code, row)
        weight = np.add.reduceat(weight, first) if len(first) else weight
        code, row = code[first], row[first]
        cuts = np.searchsorted(row, np.arange(len(vid) + 1))
        place = {v: i for i, v in enumerate(vid.tolist())}
        lo, hi = pairs.column("lo").to_numpy(), pairs.column("hi").to_numpy()
        most = np.zeros(len(lo))
        for i, (u, v) in enumerate(zip(lo.tolist(), hi.tolist(), strict=True)):
            a, b = place[u], place[v]
            _, x, y = np.intersect1d(code[cuts[a]:cuts[a + 1]], code[cuts[b]:cuts[b + 1]], assume_unique=True, return_indices=True)
            most[i] = weight[cuts[a]:cuts[a + 1]][x] @ weight[cuts[b]:cuts[b + 1]][y] + max(left[a] * full[b], left[b] * full[a])
        hope = most >= threshold - TAIL_SLACK
        return pa.table({c: pairs.column(c).filter(pa.array(hope)) for c in ("lo", "hi", "lo_block", "hi_block")})
    return run


def compared_pairs(threshold: float):
    """For applyInArrow over pairs of two blocks of texts and their vectors: the pairs that are close enough, with the cosine."""
    def run(pairs: pa.Table, vectors: pa.Table) -> pa.Table:
        vid, norm = vectors.column("vid").to_numpy(), vectors.column("norm").to_numpy()
        terms, row = _column(vectors, "terms")
        weights = _column(vectors, "raw")[0] / norm[row]
        order = np.lexsort((terms, row))
        terms, weights = terms[order], weights[order]
        cuts = np.searchsorted(row, np.arange(len(vid) + 1))
        place = {v: i for i, v in enumerate(vid.tolist())}
        lo, hi = pairs.column("lo").to_numpy(), pairs.column("hi").to_numpy()
        found = np.zeros(len(lo))
        for i, (u, v) in enumerate(zip(lo.tolist(), hi.tolist(), strict=True)):
            a, b = place[u], place[v]
            _, left, right = np.intersect1d(terms[cuts[a]:cuts[a + 1]], terms[cuts[b]:cuts[b + 1]], assume_unique=True, return_indices=True)
            found[i] = (weights[cuts[a]:cuts[a + 1]][left] * weights[cuts[b]:cuts[b + 1]][right]).sum()
        close = found >= threshold - SLACK
        return pa.table({"lo": lo[close], "hi": hi[close], "similarity": found[close]})
    return run


def similar_pairs(vectors: DataFrame, threshold: float = fv.MIN_SIMILARITY) -> DataFrame:
    """J4 + J5: all pairs (lo < hi) of a context with equal negation and cosine >= threshold, with the cosine.

    Exact prefix filter: the first common term of such a pair lies where both tails still reach the threshold, and
    the product of the two tails there bounds the cosine. A term in more than ``POSTING_CHUNK`` texts has its list
    split in k chunks; every pair of chunks is its own join key, so no task sees more than two chunks. The pairs left are compared
    by pairs of blocks of texts: first by their prefixes, four bytes a term, sent once to every pair of blocks that asks for them, then
    those that may still be close by their vectors, sent likewise.
    """
    if not 0 < threshold <= 1:
        raise ValueError("similarity threshold must be above 0 and at most 1")
    prefix = vector_prefixes(vectors).select(F.xxhash64("part", "term").alias("list"), "vid", "tail")
    lists = prefix.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("tail").alias("best")).filter("n > 1")
    prefix = prefix.join(lists.hint("merge"), "list").filter(F.col("tail") * F.col("best") >= threshold - TAIL_SLACK).withColumn(
        "chunks", F.ceil(F.col("n") / POSTING_CHUNK).cast("int"))
    prefix = staged(prefix.withColumn("chunk", F.pmod(F.xxhash64("vid"), F.col("chunks")).cast("int")).drop("n", "best"), "shared-prefixes")
    key = ["list", "first", "second"]
    left = prefix.select("list", F.col("chunk").alias("first"), F.explode(
        F.sequence("chunk", F.col("chunks") - 1)).alias("second"), F.col("vid").alias("a"), F.col("tail").alias("a_tail"))
    right = prefix.select("list", F.explode(F.sequence(F.lit(0), F.col("chunk"))).alias("first"),
                          F.col("chunk").alias("second"), F.col("vid").alias("b"), F.col("tail").alias("b_tail"))
    near = (F.col("a_tail") * F.col("b_tail") >= threshold - TAIL_SLACK) & (F.col("a") != F.col("b")) & (
        (F.col("first") != F.col("second")) | (F.col("a") < F.col("b")))
    block = lambda end: F.shiftright(end, BLOCK_BITS)
    pairs = staged(left.join(right.hint("merge"), key).filter(near).select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
                   .select("lo", "hi", block("lo").alias("lo_block"), block("hi").alias("hi_block")), "likely-pairs")
    blocks, sides, width = ["lo_block", "hi_block"], ["lo_side", "hi_side"], shuffle_partitions(vectors)

    def beside(pairs: DataFrame, values: DataFrame, function, schema: str) -> DataFrame:
        asked = pairs.select(*[F.col(b).alias(s) for b, s in zip(blocks, sides, strict=True)], F.explode(F.array("lo", "hi")).alias("vid")).distinct()
        sent = lookup_join(values, staged(asked, "asked-blocks"), ["vid"], "inner")  # narrow: under 8 MB no vector is dealt out for the join
        return pairs.repartition(width, *blocks).groupBy(*blocks).cogroup(sent.repartition(width, *sides).groupBy(*sides)).applyInArrow(function, schema)

    pairs = staged(beside(pairs, heads(vectors), hopeful_pairs(threshold), "lo bigint, hi bigint, lo_block bigint, hi_block bigint"), "hopeful-pairs")
    return beside(pairs, vectors.select("vid", "terms", "raw", "norm"), compared_pairs(threshold), "lo bigint, hi bigint, similarity double")


def _members_below(members: DataFrame, asked: DataFrame) -> DataFrame:
    """For every asked (g, i), how many members of group g have a vid below i; large groups are counted by chunks."""
    chunk = F.shiftright("vid", RANK_CHUNK_BITS)
    both = members.select("g", "vid", F.lit(1).alias("is_member")).unionByName(
        asked.select("g", F.col("i").alias("vid"), F.lit(0).alias("is_member"))).withColumn("chunk", chunk)
    earlier = Window.partitionBy("g").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = both.groupBy("g", "chunk").agg(F.sum("is_member").alias("here")).select(
        "g", "chunk", F.coalesce(F.sum("here").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("g", "chunk").orderBy("vid", "is_member").rowsBetween(Window.unboundedPreceding, -1)
    counted = both.withColumn("within", F.coalesce(F.sum("is_member").over(inside), F.lit(0))).filter("is_member = 0")
    return counted.join(offsets, ["g", "chunk"]).select("g", F.col("vid").alias("i"), (F.col("within") + F.col("before")).alias("below"))


def assign_groups(pairs: DataFrame) -> DataFrame:
    """(vid, g) for every text in a similar pair; g is the vid of the text that founded its group.

    Update: text i takes the lowest group all of whose members below i are its neighbours, else founds its own. The
    update is applied to all texts at once until it changes nothing.
    """
    edges = cut_lineage(pairs.select("lo", "hi"))
    current = cut_lineage(edges.select(F.col("lo").alias("vid")).unionByName(edges.select(F.col("hi").alias("vid"))).distinct()
                          .withColumn("g", F.col("vid")))
    while True:
        linked = edges.join(current.withColumnRenamed("vid", "lo").hint("merge"), "lo").groupBy(F.col("hi").alias("i"), "g").agg(
            F.count(F.lit(1)).alias("linked"))
        fitting = linked.join(_members_below(current, linked).hint("merge"), ["g", "i"]).filter("linked = below")
        chosen = fitting.groupBy(F.col("i").alias("vid")).agg(F.min("g").alias("chosen"))
        step = cut_lineage(current.join(chosen, "vid", "left").select(
            "vid", F.coalesce("chosen", "vid").alias("g"), F.col("g").alias("old")))
        current = step.select("vid", "g")
        if step.filter("g <> old").isEmpty():
            return current


def product(left: dict[int, float], right: dict[int, float]) -> float:
    if len(left) > len(right):
        left, right = right, left
    return sum(w * right[t] for t, w in left.items() if t in right)


def shortfall(founder: dict[int, float], own: dict[int, float]) -> tuple[float, float]:
    """Norms of what a vector has less, and has more, than the founder on the founder's terms."""
    gaps = [w - own.get(t, 0.0) for t, w in founder.items()]
    return sqrt(sum(g * g for g in gaps if g > 0)), sqrt(sum(g * g for g in gaps if g < 0))


def settle(table: pa.Table, threshold: float) -> pa.Table:
    """(vid, g) of one part, text by text. Rows: part, vid, terms, weights, prefix (which terms are in the text's prefix).

    A candidate group's founder f shares a prefix term with the text and is close enough. Weights are not negative, so on f's terms alone a text x and a member
    y have x.y >= x.f + y.f - 1 - (less of x)(more of y) - (more of x)(less of y). Where the group's least y.f and largest
    norms already reach the threshold no member is compared; else each member by its own, then by its angle, and
    only then by its vector.
    """
    angle = lambda cosine: acos(max(-1.0, min(1.0, cosine)))
    limit, sure = angle(threshold) - 1e-9, threshold + 1e-9
    order = table.column("vid").to_pylist()
    rows = sorted(range(len(order)), key=order.__getitem__)
    terms, weights, prefix = table.column("terms"), table.column("weights"), table.column("prefix")
    number: dict[str, int] = {}
    posted: dict[int, list[int]] = {}  # term -> groups whose founder has it in its prefix
    members: list[list[tuple[float, float, float, dict[int, float]]]] = []  # cosine to the founder, less, more, vector
    worst: list[tuple[float, float, float]] = []
    founders, out = [], []

    def fits(g: int, cosine: float, less: float, more: float, own: dict[int, float]) -> bool:
        least, most_less, most_more = worst[g]
        if cosine + least - 1 - less * most_more - more * most_less >= sure:
            return True
        far = angle(cosine)
        return all(cosine + c - 1 - less * m - more * n >= sure or far + angle(c) < limit or product(own, v) >= threshold - SLACK for c, n, m, v in members[g])

    for r in rows:
        own = {number.setdefault(t, len(number)): w for t, w in zip(terms[r].as_py(), weights[r].as_py(), strict=True)}
        heads = [t for t, rare in zip(own, prefix[r].as_py(), strict=True) if rare]
        for g in sorted({g for t in heads for g in posted.get(t, ())}):
            close = product(own, members[g][0][3])
            if close < threshold - SLACK:
                continue
            less, more = shortfall(members[g][0][3], own)
            if fits(g, close, less, more, own):
                members[g].append((close, less, more, own))
                least, most_less, most_more = worst[g]
                worst[g] = min(least, close), max(most_less, less), max(most_more, more)
                out.append(founders[g])
                break
        else:
            for t in heads:
                posted.setdefault(t, []).append(len(members))
            members.append([(1.0, 0.0, 0.0, own)])
            worst.append((1.0, 0.0, 0.0))
            founders.append(order[r])
            out.append(order[r])
    return pa.table({"vid": pa.array([order[r] for r in rows], pa.int64()), "g": pa.array(out, pa.int64())})


def linked_parts(terms: DataFrame, signs: DataFrame, threshold: float) -> DataFrame:
    """(vid, part): texts joined by chains of shared prefix terms; part is the least vid of a chain.

    Each round a text takes the least part known in any of its lists, and every part takes the least part that one of
    its texts saw; parts grow by whole parts, so rounds grow with the logarithm of a chain's length.
    """
    lists = cut_lineage(terms.filter((F.col("tail") >= threshold - SLACK) & (F.col("df") > 1)).join(signs.hint("merge"), "vid")
                        .select(F.xxhash64("bucket", "negated", "term").alias("list"), "vid"))
    current = cut_lineage(lists.select("vid").distinct().withColumn("part", F.col("vid")))
    while True:
        placed = lists.join(current.hint("merge"), "vid")
        least = placed.groupBy("list").agg(F.min("part").alias("least"), F.max("part").alias("most")).filter("least < most").select("list", "least")
        seen = placed.select("list", "part").distinct().join(least.hint("merge"), "list").groupBy("part").agg(F.min("least").alias("to"))
        moves = cut_lineage(seen.filter("to < part"))
        if moves.isEmpty():
            return current
        while True:  # a part moves to where its goal moves
            next_ = moves.join(moves.select(F.col("part").alias("to"), F.col("to").alias("_on")).hint("merge"), "to", "left")
            next_ = cut_lineage(next_.select("part", F.coalesce("_on", "to").alias("to"), F.col("_on").isNotNull().alias("moved")))
            moves = next_.select("part", "to")
            if next_.filter("moved").isEmpty():
                break
        current = cut_lineage(current.join(moves.hint("merge"), "part", "left").select("vid", F.coalesce("to", "part").alias("part")))


def grouped_texts(vectors: DataFrame, threshold: float = fv.MIN_SIMILARITY) -> DataFrame:
    """(vid, g) for every text that may share a group; g is the vid of the text that founded its group."""
    if not 0 < threshold <= 1:
        raise ValueError("similarity threshold must be above 0 and at most 1")
    lengths = vectors.select("vid", "part", F.size("terms").alias("entries"))
    size = lambda df: df.groupBy("part").agg(F.sum("entries").alias("total"), F.count(F.lit(1)).alias("n"))
    whole = staged(size(lengths), "part-sizes")
    one_group = (F.col("total") <= PART_ENTRIES) & (F.col("n") > 1)
    ready, rest = lookup_join(vectors, whole.filter(one_group).select("part"), ["part"], "inner"), None
    large = whole.filter(F.col("total") > PART_ENTRIES).select("part")
    if not large.isEmpty():
        wide = lookup_join(vectors, large, ["part"], "inner")
        prefixes = vector_prefixes(wide).select(F.lit("").alias("bucket"), "vid", "term", F.lit(2).cast("long").alias("df"), "tail", F.col("part").alias("negated"))
        linked = linked_parts(prefixes.drop("negated"), wide.select("vid", F.col("part").cast("string").alias("negated")), threshold)
        found = linked.join(wide.select("vid", F.size("terms").alias("entries")).hint("merge"), "vid")
        found = staged(lookup_join(found, size(found), ["part"], "inner"), "linked-parts")
        chained = lookup_join(wide.drop("part"), found.filter(one_group).select("vid", "part"), ["vid"], "inner")
        ready = ready.unionByName(chained.select(*ready.columns))
        giant = found.filter(F.col("total") > PART_ENTRIES).select("vid")
        if not giant.isEmpty():
            rest = assign_groups(similar_pairs(lookup_join(wide, giant, ["vid"], "left_semi"), threshold))
    rows = ready.select("part", "vid", "terms", F.transform("raw", lambda x: x / F.col("norm")).alias("weights"),
                        F.transform("terms", lambda t, i: i < F.size("tails")).alias("prefix"))
    settled = rows.repartition(shuffle_partitions(vectors), "part").groupBy("part").applyInArrow(lambda table: settle(table, threshold), "vid bigint, g bigint")
    return settled if rest is None else settled.unionByName(rest)


def group_similarity(assigned: DataFrame, vectors: DataFrame) -> DataFrame:
    """Weighted mean similarity inside groups of several texts: (|sum of n*v|^2 - N) / (N (N - 1))."""
    sizes = assigned.groupBy("g").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("texts")).filter("texts > 1")
    inside = staged(lookup_join(assigned.select("vid", "g", "n"), sizes.select("g", "size"), ["g"], "inner"), "grouped-members")
    own = lookup_join(vectors.select("vid", "terms", F.transform("raw", lambda x: x / F.col("norm")).alias("w"), "lone"), inside, ["vid"], "inner")
    entry = F.explode(F.arrays_zip(F.col("terms").alias("term"), F.col("w").alias("w"))).alias("e")
    summed = own.select("g", "size", "n", entry).groupBy("g", "size", F.col("e.term").alias("term")).agg(F.sum(F.col("n") * F.col("e.w")).alias("s"))
    alone = own.select("g", "size", (F.col("n") * F.col("n") * F.col("lone")).alias("square"))
    n = F.col("size").cast("double")
    return summed.select("g", "size", (F.col("s") * F.col("s")).alias("square")).unionByName(alone).groupBy("g", "size").agg(F.sum("square").alias("square")).select(
        "g", ((F.col("square") - n) / (n * (n - 1))).alias("average"))


def group_notes(stops: DataFrame, threshold: float = fv.MIN_SIMILARITY) -> dict[str, DataFrame]:
    """Machine columns, cards and card members of the stops."""
    source = with_context(stops)
    # Normalising notes is the costly part: its result is written once and read by the three uses below.
    keyed = staged(source.select("analysis_id", "id", "bucket", "column_id", "text"), "keyed-notes", "zstd")
    texts = distinct_texts(keyed)
    vectors = text_vectors(texts, threshold, only_linkable=True)
    groups = grouped_texts(vectors, threshold)
    # Texts come back by their vid, which grows with them: what is grouped carries no text.
    assigned = texts.select("bucket", "vid", "n", F.length("text").alias("chars")).join(groups, "vid", "left").withColumn("g", F.coalesce("g", "vid"))
    assigned = staged(assigned, "grouped-texts")
    label = F.min_by("vid", F.struct(-F.col("n"), "chars", "vid"))
    named = assigned.groupBy("g", "bucket").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("texts"), label.alias("label_vid"))
    named = named.join(texts.select(F.col("vid").alias("g"), F.md5(F.concat_ws("|", "bucket", "text")).alias("card_id")).hint("merge"), "g")
    named = named.join(group_similarity(assigned, vectors), "g", "left").select(
        "g", "bucket", "size", "texts", "card_id", "label_vid", F.when(F.col("texts") == 1, 1.0).otherwise(F.round("average", 4)).alias("avg_similarity"))
    digest = F.sha2("text", 256).alias("digest")
    place = assigned.select("bucket", "vid", "g").join(named.select("g", "card_id"), "g").drop("g")
    place = texts.select("vid", digest).join(place.hint("merge"), "vid").drop("vid")
    members = lookup_join(keyed.select("analysis_id", "id", "bucket", digest), place, ["bucket", "digest"], "inner")
    contexts = keyed.groupBy("bucket").agg(F.min("analysis_id").alias("analysis_id"), F.min("column_id").alias("column_id"))
    title = F.when(F.col("label").startswith("__empty_"), fv.UNNAMED_CARD).otherwise(text.title_case("label"))
    cards = lookup_join(named.drop("g"), contexts, ["bucket"], "inner").join(
        texts.select(F.col("vid").alias("label_vid"), F.col("text").alias("label")).hint("merge"), "label_vid").select(
        "analysis_id", "card_id", "column_id", title.alias("name"), "size", "texts", "avg_similarity",
        F.lit(False).alias("validated"), F.lit(False).alias("held"))
    return {"machines": machine_columns(source), "cards": cards,
            "card_members": members.select("analysis_id", "card_id", F.col("id").alias("record_id"))}


def propose_clusters(records: DataFrame, distance: float = 0.20, smallest: int = 2) -> dict[str, DataFrame]:
    """Cluster proposals of pending records without a canonical failure, at least ``smallest`` members.

    Only records with a line and a machine take part. ``proposals``: (cluster_id, linha, equipamento, suggested_name,
    avg_similarity, size); ``members``: the bridge table (cluster_id, record_id).
    """
    ready = records.filter((F.col("status") == "pending") & F.col("canonical_failure_id").isNull() & text.context_key().isNotNull())
    blank = {f: F.coalesce(f, F.lit("")) for f in fv.CONTEXT_FIELDS}
    grouped = group_notes(ready.withColumns(blank).withColumn("analysis_id", F.lit("proposals")), 1 - distance)
    large = grouped["cards"].filter(F.col("size") >= smallest)
    names = grouped["machines"].select("column_id", F.col("name").alias("equipamento"), F.col("line").alias("linha"))
    proposals = lookup_join(large, names, ["column_id"], "inner").select(
        F.col("card_id").alias("cluster_id"), "linha", "equipamento", F.col("name").alias("suggested_name"), "avg_similarity", "size")
    members = lookup_join(grouped["card_members"], large.select("card_id"), ["card_id"], "inner").select(F.col("card_id").alias("cluster_id"), "record_id")
    return {"proposals": proposals, "members": members}
