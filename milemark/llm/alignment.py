"""Cross-tokenizer alignment by diagonal run skipping: token ends of two tokenizations of a text, compared at an index shift.

Groups end where tokens of both sides end. Along a diagonal (index of B minus index of A) equal ends are one-to-one
groups; their run is skipped by probes of doubling length. Where ends differ, the group is walked to its common end,
which gives the next shift.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from milemark.llm import common, tokens

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
SPACE = "▁"
# Where both sides may be cut: before a lone space that a visible character follows.
CUT = re.compile(r"(?<=[^ ]) (?=\S)")
# An id pair as one number: the id of A times this, plus the id of B.
B_IDS = 1 << 20
# Id pairs that are broadcast at most; links of rarer pairs are joined by an exchange.
FREQUENT = 200_000
# Texts that are encoded together: so many rows, and so many characters unless one text alone has more.
ROWS_AT_ONCE = 256
CHARS_AT_ONCE = 1_000_000
FIRST_PROBE = 16


def run_length(a: bytes | list[int], b: bytes | list[int], i: int, j: int) -> int:
    """How many items from ``a[i]`` and ``b[j]`` on are equal one by one: probes of doubling length, then the last one
    halved, and its rest walked, until the first difference is found."""
    at, step = 0, FIRST_PROBE
    x, y = a[i : i + step], b[j : j + step]
    while x == y:
        if len(x) < step:
            return at + len(x)
        at += step
        step *= 2
        x, y = a[i + at : i + at + step], b[j + at : j + at + step]
    while step > FIRST_PROBE:
        step //= 2
        if x[:step] == y[:step]:
            x, y = x[step:], y[step:]
            at += step
    for p, q in zip(x, y):  # noqa: B905
        if p != q:
            break
        at += 1
    return at


def byte_sizes(ends: np.ndarray) -> bytes | None:
    """The sizes of tokens by their ends, a byte each; None where one has more than 255 bytes."""
    sizes = np.diff(ends, prepend=0)
    return sizes.astype(np.uint8).tobytes() if sizes.max() < 256 else None


def align(a: np.ndarray | list[int], b: np.ndarray | list[int]) -> tuple[list[tuple[int, int, int, int]], list[int], list[int]]:
    """Runs of two rows of rising token ends that have the same last end, and the links of those that are not one-to-one.

    A run ``(i, j, n, 0)`` is ``n`` one-to-one groups from tokens ``i`` and ``j`` on; ``(i, j, n, m)`` one group of ``n``
    tokens of A and ``m`` of B. Links are the indexes of all tokens whose ranges overlap.
    """
    runs, left, right = [], [], []
    a, b = np.asarray(a), np.asarray(b)
    # From a common end on, ends are equal as long as sizes are, and those are compared as bytes.
    mine, theirs = byte_sizes(a), byte_sizes(b)
    a, b = a.tolist(), b.tolist()
    if mine is None or theirs is None:
        mine, theirs = a, b
    i = j = 0
    most = len(a)
    while i < most:
        end, other = a[i], b[j]
        if end == other:
            n = run_length(mine, theirs, i, j)
            runs.append((i, j, n, 0))
            i, j = i + n, j + n
            continue
        x, y = i, j
        left.append(x)
        right.append(y)
        while end != other:  # each step reaches the next pair that overlaps
            if end < other:
                x += 1
                end = a[x]
            else:
                y += 1
                other = b[y]
            left.append(x)
            right.append(y)
        x, y = x + 1, y + 1
        runs.append((i, j, x - i, y - j))
        i, j = x, y
    return runs, left, right


class Table:
    """The bytes of a vocabulary's tokens, one after the other."""

    def __init__(self, pieces: list[bytes]):
        self._bytes = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        self.sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        self._starts = np.cumsum(self.sizes) - self.sizes

    def _said(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of tokens, one after the other."""
        sizes = self.sizes[ids]
        return self._bytes[counted_on(self._starts[ids], sizes)]

    def ends(self, ids: np.ndarray, whole: np.ndarray) -> np.ndarray | None:
        """Where each token ends in a text of these bytes; None if the tokens are not these bytes."""
        ends = np.cumsum(self.sizes[ids])
        if len(ids) == 0 or ends[-1] != len(whole):
            return None
        return ends if np.array_equal(self._said(ids), whole) else None

    def given_back(self, ids: np.ndarray, counts: np.ndarray, whole: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Which words, of so many tokens and so many bytes of ``whole``, are the bytes of their tokens."""
        ends = np.concatenate([[0], np.cumsum(self.sizes[ids])])[np.cumsum(counts)]
        good = np.diff(ends, prepend=0) == lengths
        other = self._said(ids[np.repeat(good, counts)]) != whole[np.repeat(good, lengths)]
        good[np.repeat(np.flatnonzero(good), lengths[good])[other]] = False
        return good


def counted_on(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each start as many numbers as its count says, counted on from it."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(counts.sum())


class Words(dict):
    """Words by number, and the ids of each by one tokenizer after the other; encoded once, many together."""

    def __init__(self, encode):
        super().__init__()
        self._encode = encode
        self._empty()

    def _empty(self) -> None:
        self.clear()
        self._chars = 0
        self.good = np.empty(0, dtype=bool)
        self._ids = [np.empty(0, dtype=np.int32)] * 2
        self._starts, self._counts = [[np.empty(0, dtype=np.int64)] * 2 for _ in range(2)]

    def learn(self, words: set[str]) -> None:
        """Adds those that are not known; all are forgotten before that, once there are too many or they are too long."""
        if len(self) >= tokens.CACHE or self._chars >= 16 * tokens.CACHE:
            self._empty()
        new = words.difference(self)
        if not new:
            return
        new, ids, counts, good = self._encode(list(new))
        self.update(zip(new, range(len(self), len(self) + len(new)), strict=True))
        self._chars += sum(map(len, new))
        self.good = np.concatenate([self.good, good])
        for k in range(2):
            starts = np.cumsum(counts[k]) - counts[k] + len(self._ids[k])
            self._starts[k] = np.concatenate([self._starts[k], starts])
            self._counts[k] = np.concatenate([self._counts[k], counts[k]])
            self._ids[k] = np.concatenate([self._ids[k], ids[k].astype(np.int32)])

    def ids(self, side: int, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words by their numbers, and how many each has."""
        counts = self._counts[side][numbers]
        return self._ids[side][counted_on(self._starts[side][numbers], counts)].astype(np.int64), counts


class Pair:
    """Both tokenizers with the bytes of their tokens; one for each worker process."""

    def __init__(self, a_path: str, rank_path: str | None, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self._a = tokens.encoder(a_path, rank_path, True)
        vocabulary = Tokenizer.from_file(a_path).get_vocab(with_added_tokens=True)
        plain = byte_letters()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for piece, k in vocabulary.items():
            self.a_bytes[k] = bytes(plain[c] for c in piece) if all(c in plain for c in piece) else piece.encode()
        self._b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self._b.id_to_piece(k) for k in range(self._b.get_piece_size())]
        # No piece spans the start of a word: then a text may be encoded word by word.
        self._by_word = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self._b.is_byte(k) else p.replace(SPACE, " ").encode() for k, p in enumerate(pieces)
        ]
        self._tables = Table(self.a_bytes), Table(self.b_bytes)
        self._words = Words(self._encode_words)
        # An id and what follows it: within a side, between the sides, after a group. All of one width, filled up with zeros.
        self.said = np.array([f"{k}{mark}" for k in range(max(len(self.a_bytes), len(self.b_bytes))) for mark in ",|;"], dtype="S")

    def _parts(self, text: str) -> list[str]:
        """What both sides may encode one by one: words, with the white space around them that can't be cut off."""
        if not self._by_word:
            return [text]
        return CUT.split(text) if tokens.UNSPLIT.search(" " + text) else text.split(" ")

    def _b_ids(self, text: str) -> list[int]:
        """Ids by B, equal to those of the whole text, word by word."""
        return list(itertools.chain.from_iterable(self._b.encode(self._parts(text), num_threads=1)))

    def _encode_words(self, words: list[str]) -> tuple[list[str], list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Words in the order in which they were encoded, ids and numbers of ids by A (of a space and the word) and by B,
        and whether the bytes of both sides' tokens are those of a space and the word."""
        words, a_ids = self._a.words(words)
        data = [w.encode("utf-8", "surrogatepass") for w in words]
        whole = np.frombuffer(b" " + b" ".join(data), dtype=np.uint8)
        lengths = np.fromiter(map(len, data), np.int64, len(data)) + 1
        a_table, b_table = self._tables
        cuts = np.searchsorted(np.cumsum(a_table.sizes[a_ids]), np.cumsum(lengths), side="right")
        found = self._b.encode(words, num_threads=1)
        b_counts = np.fromiter(map(len, found), np.int64, len(found))
        b_ids = np.fromiter(itertools.chain.from_iterable(found), np.int64, b_counts.sum())
        a_counts = np.diff(cuts, prepend=0)
        good = a_table.given_back(a_ids[: cuts[-1]], a_counts, whole, lengths) & b_table.given_back(b_ids, b_counts, whole, lengths)
        return words, [a_ids, b_ids], [a_counts, b_counts], good

    def _encode_one(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """What ``encode`` gives for a text, encoded and compared as a whole."""
        ids = np.frombuffer(self._a.encode(" " + text), dtype="<u4").astype(np.int64)
        others = np.array(self._b_ids(text), dtype=np.int64)
        whole = np.frombuffer((" " + text).encode("utf-8", "surrogatepass"), dtype=np.uint8)
        a_ends, b_ends = self._tables[0].ends(ids, whole), self._tables[1].ends(others, whole)
        return None if a_ends is None or b_ends is None else (ids, others, a_ends, b_ends)

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None]:
        """Per text its ids by A (of a space and the text) and by B, and where their tokens end; None where the tokens'
        bytes do not give it back. Words that are new among all texts are encoded together; a text of which a word is not
        given back is encoded by itself."""
        parts = [self._parts(text) if text else [] for text in texts]
        self._words.learn(set().union(*parts))
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        numbers = np.fromiter(map(self._words.__getitem__, itertools.chain.from_iterable(parts)), np.int64, sizes.sum())
        last = np.cumsum(sizes)
        bad = np.concatenate([[0], np.cumsum(~self._words.good[numbers])])
        own = (sizes > 0) & (bad[last] == bad[last - sizes])
        sides = []
        for k, table in enumerate(self._tables):
            ids, counts = self._words.ids(k, numbers)
            ends = np.concatenate([[0], np.cumsum(table.sizes[ids])])
            cuts = np.concatenate([[0], np.cumsum(counts)])
            sides.append((ids, ends, cuts[last - sizes].tolist(), cuts[last].tolist()))
        (a_ids, a_ends, a_from, a_to), (b_ids, b_ends, b_from, b_to) = sides
        out = []
        for k, (text, whole) in enumerate(zip(texts, own.tolist(), strict=True)):
            if whole:
                a, b = slice(a_from[k], a_to[k]), slice(b_from[k], b_to[k])
                out.append((a_ids[a], b_ids[b], a_ends[1:][a] - a_ends[a.start], b_ends[1:][b] - b_ends[b.start]))
            else:
                out.append(self._encode_one(text) if text else None)
        return out

    def groups_text(self, ids: np.ndarray, others: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> str:
        """``a1,a2|b1;a3|b2,b3``: the ids of each group, of which the marked tokens are the last of their side."""
        a_after, b_after = np.flatnonzero(a_ends) + 1, np.flatnonzero(b_ends) + 1
        out = np.empty(len(ids) + len(others), dtype=np.int64)
        # A token of A comes after those of B in the groups before its own, one of B after those of A up to its own.
        group = np.cumsum(a_ends) - a_ends
        out[np.arange(len(ids)) + np.concatenate([[0], b_after])[group]] = ids * 3 + a_ends
        group = np.cumsum(b_ends) - b_ends
        out[np.arange(len(others)) + a_after[group]] = others * 3 + 2 * b_ends
        return self.said[out].tobytes().replace(b"\0", b"")[:-1].decode()


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 stands for itself, the other
    bytes in order for the letters from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


@functools.cache
def pair(a_path: str | None = None, rank_path: str | None = None, b_path: str | None = None) -> Pair:
    return Pair(a_path or public_tokenizers.path(A_FILE), rank_path, b_path or public_tokenizers.path(B_FILE))


def _one(found: tuple | None, two: Pair) -> tuple:
    if found is None:
        return 0, 0, 0, 0, "", np.empty(0, np.int64), np.empty(0, np.int32)
    ids, others, a_at, b_at = found
    runs, left, right = align(a_at, b_at)
    start, other, n, m = np.fromiter(itertools.chain.from_iterable(runs), np.int64, 4 * len(runs)).reshape(-1, 4).T
    lone = m == 0
    n_groups = int(n[lone].sum() + (~lone).sum())
    # The links of one-to-one runs: each run's tokens, counted on from its start.
    mine, theirs = counted_on(start[lone], n[lone]), counted_on(other[lone], n[lone])
    one_to_one = ids[mine] * B_IDS + others[theirs]
    codes = np.concatenate([one_to_one, ids[left] * B_IDS + others[right]]) if left else one_to_one
    pairs, times = np.unique(codes, return_counts=True)
    a_ends, b_ends = np.zeros(len(ids), np.int64), np.zeros(len(others), np.int64)
    a_ends[mine] = b_ends[theirs] = 1
    a_ends[(start + n - 1)[~lone]] = b_ends[(other + m - 1)[~lone]] = 1
    said = hashlib.sha256(two.groups_text(ids, others, a_ends, b_ends).encode()).hexdigest()
    return len(ids), len(others), n_groups, len(codes), said, pairs, times.astype(np.int32)


def in_parts(texts: list[str | None], chars: int = CHARS_AT_ONCE) -> Iterator[list[str | None]]:
    """The texts in their order, in parts of at most so many characters or one text."""
    part, held = [], 0
    for text in texts:
        size = len(text or "")
        if part and held + size > chars:
            yield part
            part, held = [], 0
        part.append(text)
        held += size
    if part:
        yield part


FIELDS = {
    "n_a": ("bigint", pa.int64()), "n_b": ("bigint", pa.int64()), "n_groups": ("bigint", pa.int64()), "n_links": ("bigint", pa.int64()),
    "groups_sha256": ("string", pa.string()), "pairs": ("array<bigint>", pa.list_(pa.int64())), "times": ("array<int>", pa.list_(pa.int32())),
}


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str | None, str | None, str | None] = (None, None, None)) -> DataFrame:
    """Per row: id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups_sha256`` and its id ``pairs`` (sorted) with how
    many links hold each (``times``)."""

    def work():
        two = pair(*paths)
        return lambda texts: [_one(found, two) for part in in_parts(texts) for found in two.encode(part)]

    return common.map_column(docs.select(F.col(id_col), F.col(text_col).alias("_text")), "_text", FIELDS, work, ROWS_AT_ONCE)


def pair_counts(found: DataFrame) -> DataFrame:
    """``pair, a_id, b_id, count`` of every id pair in the corpus and ``best``: no pair of its B id has a higher count."""
    each = found.select(F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("times").alias("n"))))
    counts = common.stored(each.groupBy("pair").agg(F.sum("n").alias("count")))
    counts = counts.withColumn("a_id", F.shiftright("pair", 20)).withColumn("b_id", F.col("pair").bitwiseAND(B_IDS - 1))
    most = counts.groupBy("b_id").agg(F.max("count").alias("_most"))
    return common.stored(counts.join(most, "b_id").select("pair", "a_id", "b_id", "count", (F.col("count") == F.col("_most")).alias("best")))


def frequent(counts: DataFrame, most: int = FREQUENT) -> DataFrame:
    """The pairs of the highest counts, ``most`` of them at most: all whose count is a certain power of two or more."""
    exponent = F.floor(F.log2("count")).cast("int")
    at, left = 64, most
    for row in counts.groupBy(exponent.alias("e")).agg(F.count("*").alias("n")).orderBy(F.desc("e")).collect():  # 63 rows at most
        left -= row["n"]
        if left < 0:
            break
        at = row["e"]
    return counts.where(exponent >= at)


def align_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = FREQUENT) -> DataFrame:
    """Per row: id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``.

    A text that is null, empty or that the bytes of its tokens do not give back has no tokens: zeros and an empty
    digest. Repeated rows count and are returned each, null ids as well; other columns are not read. An empty table gives
    none. Links of a document are looked up by distinct pair: frequent pairs (a bounded number) are broadcast, so that
    a document is summed up where it lies, and only links of rare pairs are exchanged.
    """
    found = common.stored(aligned(docs, id_col, text_col).withColumn("_row", F.monotonically_increasing_id()))
    counts = pair_counts(found)
    known = F.broadcast(frequent(counts, most).select("pair", "count", "best"))
    each = found.select("_row", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("times").alias("n"))))
    sums = [F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum")]
    near = each.join(known, "pair").groupBy("_row").agg(*sums)
    rare = each.join(known.select("pair"), "pair", "left_anti").join(counts.select("pair", "count", "best").hint("merge"), "pair")
    both = near.unionByName(rare.groupBy("_row").agg(*sums)).groupBy("_row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    total = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return found.join(both, "_row", "left").select(
        F.col(f"`{id_col}`"), "n_a", "n_b", "n_groups", "n_links", total("n_best"), total("count_sum"), "groups_sha256"
    )


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by the byte-level and the piece vocabulary."""
    return align_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
