"""Token ids of a public byte-level vocabulary, as little-endian unsigned 32-bit bytes."""

from __future__ import annotations

import base64
import functools
import os
import re

import numpy as np
import public_tokenizers

VOCABULARY = "byte_bpe_50k"
SPECIAL = "<|endoftext|>"
# Entries of a worker's cache before it is emptied: bounds memory, not what is encoded.
CACHE = 400_000
UNSPLIT = re.compile(r" (?=\s|$)")
_SPLIT = re.compile(r" (?=\S)")


def _latin(text: str) -> bool:
    return len(text) <= 2000 and (text.isascii() or max(text) < "ɐ")


class Encoder(dict):
    """Ids of whole texts, equal to those of the library ``tokenizers`` without added tokens.

    The vocabulary's own rule always cuts before a space that a visible character follows, so a text is cut there,
    and the ids of each part (with its leading space) are looked up, or encoded once and kept. Parts of Latin
    letters go to the rank file of the same vocabulary, any others, very long ones and texts with the special
    token's string to ``tokenizers`` itself. With ``ordinary`` that string is text like any other.
    """

    def __init__(self, json_path: str, rank_path: str, ordinary: bool = False):
        super().__init__()
        self._ordinary = ordinary
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        with open(rank_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._full = Tokenizer.from_file(json_path)
        self._full.encode_special_tokens = ordinary
        self._fast = tiktoken.Encoding(
            VOCABULARY, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )

    def _whole(self, text: str) -> bytes:
        return np.array(self._full.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _part(self, text: str) -> bytes:
        if not text:
            return b""
        if not _latin(text):
            return self._whole(text)
        return np.array(self._fast.encode_ordinary(text), dtype="<u4").tobytes()

    def __missing__(self, part: str) -> bytes:
        found = self._part(" " + part)
        if len(part) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[part] = found
        return found

    def encode(self, text: str) -> bytes:
        if SPECIAL in text and not self._ordinary:
            return self._whole(text)
        first, *rest = _SPLIT.split(text) if UNSPLIT.search(text) else text.split(" ")
        # A text that begins with a space has an empty first part, and the next one keeps its space.
        return self._part(first) + b"".join([self[p] for p in rest])

    def words(self, words: list[str]) -> tuple[list[str], np.ndarray]:
        """Ids of words, each after a space, and the order they are in: short ones of Latin letters that no white space
        begins come first and are encoded together. For an encoder that is ``ordinary``."""
        together = lambda w: _latin(w) and not w[:1].isspace()
        latin = [w for w in words if together(w)]
        others = [] if len(latin) == len(words) else [w for w in words if not together(w)]
        ids = self._fast.encode_ordinary(" " + " ".join(latin)) if latin else []
        found = [np.array(ids, dtype="<u4").tobytes(), *(self._whole(" " + w) for w in others)]
        return latin + others, np.frombuffer(b"".join(found), dtype="<u4").astype(np.int64)

    def decode(self, ids: bytes) -> str:
        """The text of ids that stand for ordinary text; the vocabulary covers all bytes, so it comes back whole."""
        return self._fast.decode_bytes(np.frombuffer(ids, dtype="<u4").tolist()).decode("utf-8", "surrogatepass")


@functools.cache
def encoder(json_path: str | None = None, rank_path: str | None = None, ordinary: bool = False) -> Encoder:
    """One for each worker process; the paths default to the installed public vocabulary."""
    return Encoder(
        json_path or public_tokenizers.path(f"{VOCABULARY}.json"),
        rank_path or public_tokenizers.path(f"{VOCABULARY}.tiktoken"),
        ordinary,
    )
