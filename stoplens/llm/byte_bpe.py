"""Byte-level BPE ids of a tokenizers file, computed by tiktoken from the same vocabulary.

tiktoken merges the same pairs several times faster. Of each call one text is also encoded by the tokenizers library,
and a difference is an error. Texts that hold a special token's string are left to the tokenizers library, and so is
everything if the file has a normalizer, another pre-tokenizer than plain byte-level, or ids that are not merge ranks.
"""

import json
import os
from array import array
from functools import lru_cache

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
#: Fixed value: the words of a byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it prints, else one from 256 on."""
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        told = json.loads(self.library.to_str())
        self.special = [t["content"] for t in told["added_tokens"]]
        letters, kind = byte_letters(), told["pre_tokenizer"] or {}
        vocabulary = {t: i for t, i in self.library.get_vocab().items() if t not in self.special}
        #: bytes of text each id stands for
        self.n_bytes = np.zeros(self.library.get_vocab_size(), np.int64)
        for token, i in self.library.get_vocab().items():
            self.n_bytes[i] = len(token.encode()) if token in self.special else len(token)
        merged = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in told["model"].get("merges", [])]
        in_order = [vocabulary.get(a + b) for a, b in merged] == list(range(256, 256 + len(merged)))
        self.fast = None
        if in_order and told["normalizer"] is None and kind.get("type") == "ByteLevel" and not kind.get("add_prefix_space") and kind.get("use_regex", True):
            import tiktoken

            ranks = {bytes(letters[c] for c in t): i for t, i in vocabulary.items()}
            self.fast = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _library(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if self.fast is None:
            return [self._library(t) for t in texts]
        own = [t for t in texts if not any(s in t for s in self.special)]
        if own and self._library(least := min(own, key=len)) != self.fast.encode_to_numpy(least, disallowed_special=()).tobytes():
            raise RuntimeError(f"the two libraries differ on {least[:200]!r}")
        return [self._library(t) if any(s in t for s in self.special) else self.fast.encode_to_numpy(t, disallowed_special=()).tobytes() for t in texts]

    def spans(self, text: str, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Character start and end of each token; a token inside a character spans that character."""
        data = np.frombuffer(text.encode(), np.uint8)
        place = np.cumsum((data & 0xC0) != 0x80) - 1
        ends = np.cumsum(self.n_bytes[np.frombuffer(ids, "<u4")])
        if len(ends) and ends[-1] != len(data):
            raise RuntimeError("the tokens do not cover the text")
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
        return place[starts], place[ends - 1] + 1


encoder = lru_cache(maxsize=2)(ByteEncoder)
