"""Encoding and decoding with a merge-type SentencePiece vocabulary.

The symbols of a text are merged by an agenda of adjacent pairs: the pair whose piece has the best score goes first,
the leftmost of equal ones, and each merge puts its two new neighbour pairs on the agenda. Pieces hold the space mark
only at their start and no line end, so a text falls apart before each run of space marks and around line ends; nor
can a merge join two characters that stand together in no piece, as most words and the closing marks after them. The
segments are merged once per Python worker while they are remembered, and what is remembered of one is its ids as decimal
text, so that a document's ids are one join of its segments' texts.
Each Arrow batch checks every segment new to the worker against the sentencepiece library, its ids and what the library
decodes them to, and fails on other ids. Documents all of whose segments decode to themselves decode to their
normalised text; any other is decoded by the library whole. Where the vocabulary's normaliser changes more than spaces,
whole texts are checked instead of segments.

Null texts count as empty: no ids, empty decoded text. Equal rows get equal results; empty tables give empty tables;
extra columns are not carried (join on the id).
"""

import re
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stoplens.llm.common import in_tasks

MARK = "▁"
REMEMBERED = 1_000_000  # segments a worker holds before it starts afresh; bounds memory, not results
CLOSING = ".,;:!?"
LONGEST = 48  # longer segments are not remembered
ROWS = 128


class Remembered(dict):
    """Segment -> decimal ids, each followed by a comma; works out what it lacks and notes it as fresh."""

    def __init__(self, ids):
        super().__init__()
        self.ids, self.fresh = ids, []

    def __missing__(self, segment: str) -> str:
        self[segment] = found = self.ids(segment)
        self.fresh.append(segment)
        return found


class PieceModel:
    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        sp, self.byte_ids, self.ids, self.costs = self.library, {}, {}, {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[piece], self.costs[piece] = i, -sp.get_score(i)
        if len(self.byte_ids) != 256:
            raise ValueError("only vocabularies with byte fallback are supported")
        self.plain = sp.normalize(" a  ﬁ ") == f"{MARK}{MARK}a{MARK}{MARK}ﬁ{MARK}"
        self.whole = any(MARK in piece.lstrip(MARK) for piece in self.ids) or any("\n" in piece for piece in self.ids)
        self.segments = re.compile("(?s).+" if self.whole else " +[^ \n]*|[^ \n]+|\n").findall
        self.together = {piece[i:i + 2].replace(MARK, " ") for piece in self.ids for i in range(len(piece) - 1)}
        self.opening = sp.encode("\n")
        self.known, self.odd = Remembered(self.segment_ids), set()

    def merge(self, part: str) -> list[str]:
        """Pieces of ``part`` by the agenda."""
        symbol, costs = list(part), self.costs
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(costs[p], i, p) for i in range(n - 1) if (p := part[i:i + 2]) in costs]
        heapify(agenda)
        while agenda:
            _, i, piece = heappop(agenda)
            j = after[i]
            if j >= n or symbol[i] is None or symbol[i] + symbol[j] != piece:
                continue  # one of the two has been merged since
            symbol[i], symbol[j], after[i] = piece, None, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (p := piece + symbol[after[i]]) in costs:
                    heappush(agenda, (costs[p], i, p))
            if (h := before[i]) >= 0 and (p := symbol[h] + piece) in costs:
                heappush(agenda, (costs[p], h, p))
        return [s for s in symbol if s is not None]

    def part_ids(self, part: str) -> str:
        pieces, ids = self.merge(part.replace(" ", MARK)), self.ids
        if ids.keys() >= set(pieces):
            found = [ids[p] for p in pieces]
        else:
            found = chain.from_iterable((ids[p],) if p in ids else [self.byte_ids[b] for b in p.encode()] for p in pieces)
        return "".join([f"{i}," for i in found])

    def segment_ids(self, segment: str) -> str:
        core = segment.rstrip(CLOSING)
        if not core or core == segment or segment[len(core) - 1:len(core) + 1] in self.together:
            return self.part_ids(segment)
        return self.known[core] + self.known[segment[len(core):]]

    def normalized(self, text: str) -> str:
        """The text as the library merges it, with spaces for its marks."""
        if self.plain:
            return " " + text.replace(MARK, " ") if text else ""
        return self.library.normalize(text).replace(MARK, " ")

    def encode(self, texts: list[str]) -> tuple[list[str], list[str]]:
        """For each text its ids as decimal text, joined by commas, and what the library decodes them to."""
        if len(self.known) > REMEMBERED:
            self.known, self.odd = Remembered(self.segment_ids), set()
        normal = [self.normalized(t) for t in texts]
        cut = [self.segments(t) for t in normal]
        get = self.known.__getitem__
        ids = ["".join(map(get, segments))[:-1] for segments in cut]
        self.check(texts, ids)
        decoded = [t[1:] if self.plain else None for t in normal]
        for i, segments in enumerate(cut):
            if decoded[i] is None or self.odd and not self.odd.isdisjoint(segments):
                decoded[i] = self.library.decode(numbers(ids[i]))
        for s in self.known.fresh:
            if len(s) > LONGEST:
                del self.known[s]
                self.odd.discard(s)
        self.known.fresh.clear()
        return ids, decoded

    def check(self, texts: list[str], ids: list[str]) -> None:
        """Compare with the library what is new; it puts a mark before a text itself, so that a segment is given to it
        behind a line end, over which nothing merges."""
        if not self.plain or self.whole:
            theirs, own, shown = self.library.encode(texts, num_threads=1), [numbers(i) for i in ids], texts
            self.odd.update(self.known.fresh if self.plain else ())
        else:
            shown = self.known.fresh
            own = [numbers(self.known[s][:-1]) for s in shown]
            theirs = self.library.encode(["\n" + s for s in shown], num_threads=1)
            n = len(self.opening)
            if any(t[:n] != self.opening for t in theirs):
                raise RuntimeError("a merge crosses a line end")
            theirs = [t[n:] for t in theirs]
            back = self.library.decode(own) if own else []
            self.odd.update(s for s, text in zip(shown, back, strict=True) if text != s.removeprefix(" "))
        for s, a, b in zip(shown, own, theirs, strict=True):
            if a != b:
                raise RuntimeError(f"{s!r}: agenda {a}, library {b}")


def numbers(ids: str) -> list[int]:
    return [int(i) for i in ids.split(",")] if ids else []


model = lru_cache(maxsize=2)(PieceModel)


def encode_batches(batches, path: str):
    own = model(path)
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            ids, decoded = own.encode([t or "" for t in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([i.count(",") + 1 if i else 0 for i in ids], pa.int64()),
                                              pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["id", "n_tokens", "ids_text", "decoded"])


def encode_texts(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, ids_text, decoded) of each row: ids as the library's, without begin or end, as decimal text joined by
    commas, and what its decode gives for them."""
    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("id"), F.col(text).alias("text"))\
        .mapInArrow(in_tasks(__name__, "encode_batches", path), f"id {kind}, n_tokens long, ids_text string, decoded string")


def encode_documents(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids, decoded) of each row, the ids as an array."""
    ids = F.when(F.col("n_tokens") == 0, F.array().cast("array<int>")).otherwise(F.split("ids_text", ",").cast("array<int>"))
    return encode_texts(docs, path, id, text).select("id", ids.alias("ids"), "decoded")
