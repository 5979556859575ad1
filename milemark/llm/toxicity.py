"""Toxicity: a bidirectional gated recurrent network over words and their characters, with attention, in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from milemark.llm import common
from milemark.llm.langid import fold

# The network is trained on at most this many labelled documents of each class and this many characters of each; of a
# longer text on parts of SAMPLE_PART characters from all over it.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_PART = 1200, 50_000, 2000
# Words of a window and from one window's start to the next: every word is in a window, windows overlap.
WINDOW, STRIDE = 32, 24
# Bytes of a word's piece, and characters that neighbouring pieces share.
WORD_BYTES, OVERLAP = 32, 3
VOCABULARY = 1 << 14
GRAMS = 1 << 14
WORD_DIM = CHAR_DIM = 8
HIDDEN = 12
BATCH, RATE = 256, 6e-3
# Rounds over the windows: this many, and more for a small sample until as many steps are made.
EPOCHS, STEPS = 5, 120
# Words whose inputs a worker keeps before it begins anew: bounds memory, not what is scored.
CACHE = 150_000
_WORD = re.compile(r"\w+")

Params = dict[str, np.ndarray]


def words_of(text: str | None) -> list[str]:
    """Lower-case words; a very long one is cut into pieces of at most ``WORD_BYTES``, so that all of it is seen."""
    found = _WORD.findall(text.lower()) if text else []
    if found and max(map(len, found)) > WORD_BYTES // 4:
        found = [p for w in found for p in (_pieces(w) if len(w) > WORD_BYTES // 4 else (w,))]
    return found


def _pieces(word: str) -> Iterator[str]:
    """Whole characters that fit ``WORD_BYTES``; each piece repeats the last ``OVERLAP`` characters of the one before."""
    at = 0
    while True:
        piece = word[at : at + WORD_BYTES].encode("utf-8", "surrogatepass")[:WORD_BYTES].decode("utf-8", "ignore")
        yield piece
        at += len(piece)
        if at >= len(word):
            return
        at -= OVERLAP


def starts(n: int) -> range:
    """First words of the windows of ``n`` words; the last window reaches the end."""
    return range(0, max(n - (WINDOW - STRIDE), 1), STRIDE)


def grams(words: list[str]) -> np.ndarray:
    """Rows of hashed runs of three and four bytes of each word with its ends marked; 0 fills up."""
    if len(words) > 4096:  # bounds the intermediate rows
        return np.concatenate([grams(words[k : k + 4096]) for k in range(0, len(words), 4096)])
    raw = np.zeros((len(words), WORD_BYTES + 2), dtype=np.uint8)
    for row, w in zip(raw, words, strict=True):
        b = b"\x02" + w.encode("utf-8", "surrogatepass")[:WORD_BYTES] + b"\x03"
        row[: len(b)] = np.frombuffer(b, dtype=np.uint8)
    x = raw.astype(np.uint32)
    three = x[:, :-2] * np.uint32(0x9E3779B1) ^ x[:, 1:-1] * np.uint32(0x85EBCA77) ^ x[:, 2:] * np.uint32(0xC2B2AE3D)
    four = three[:, :-1] * np.uint32(0x27D4EB2F) ^ x[:, 3:] * np.uint32(0x165667B1)
    both = np.concatenate([np.where(x[:, 2:] > 0, three, 0), np.where(x[:, 3:] > 0, four, 0)], axis=1)
    mixed = (both ^ both >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
    return np.where(both > 0, 1 + (mixed ^ mixed >> np.uint32(13)) % np.uint32(GRAMS - 1), 0).astype(np.int32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _initial(vocabulary: int, rng: np.random.Generator) -> Params:
    normal = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
    inputs = WORD_DIM + CHAR_DIM
    out = {"word": normal(vocabulary, WORD_DIM, by=0.1), "gram": normal(GRAMS, CHAR_DIM, by=0.3)}
    for side in "fb":
        out |= {
            f"W{side}": normal(inputs, 3 * HIDDEN, by=inputs**-0.5), f"b{side}": np.zeros(3 * HIDDEN, np.float32),
            f"U{side}": normal(HIDDEN, 3 * HIDDEN, by=HIDDEN**-0.5),
        }
    out |= {"A": normal(2 * HIDDEN, HIDDEN, by=0.3), "a": normal(HIDDEN, by=0.3)}
    out |= {"o": normal(2 * HIDDEN, by=0.3), "c": np.zeros(1, np.float32)}
    out["word"][0] = 0  # words outside the vocabulary
    out["gram"][0] = 0
    return out


def _summed(n: int, index: np.ndarray, values: np.ndarray) -> np.ndarray:
    """``n`` rows; each is the sum of the values at its index."""
    out = np.zeros((n, values.shape[1]), values.dtype)
    if len(index):
        order = np.argsort(index, kind="stable")
        rows, first = np.unique(index[order], return_index=True)
        out[rows] = np.add.reduceat(values[order], first, axis=0)
    return out


def _inputs(p: Params, word: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.maximum((gram > 0).sum(axis=1, keepdims=True), 1).astype(np.float32)
    chars = np.empty((len(word), CHAR_DIM), p["gram"].dtype)
    for k in range(0, len(word), 4096):  # bounds the rows of all n-grams in memory
        chars[k : k + 4096] = p["gram"][gram[k : k + 4096]].sum(axis=1)
    return np.concatenate([p["word"][word], chars / n], axis=1), n


def _recur(p: Params, side: str, x: np.ndarray, at: np.ndarray, keep: list | None) -> np.ndarray:
    """Hidden states (windows, words, HIDDEN) of one direction; ``x`` are projected inputs by word, ``at`` (windows,
    words) their rows, below 0 past the end, where the state stays as it is."""
    u, h = p[f"U{side}"], np.zeros((len(at), HIDDEN), np.float32)
    out = np.empty((*at.shape, HIDDEN), np.float32)
    for t in range(at.shape[1]) if side == "f" else reversed(range(at.shape[1])):
        own = at[:, t]
        live = (own >= 0)[:, None]
        px, ph = x[own], h @ u
        gates = _sigmoid(px[:, : 2 * HIDDEN] + ph[:, : 2 * HIDDEN])
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        new = np.tanh(px[:, 2 * HIDDEN :] + r * ph[:, 2 * HIDDEN :])
        if keep is not None:
            keep.append((t, h, z, r, new, ph[:, 2 * HIDDEN :], live))
        h = np.where(live, (1 - z) * new + z * h, h)
        out[:, t] = h
    return out


def forward(p: Params, projected: dict[str, np.ndarray], at: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Logits of windows: both directions, attention over the window's words, one output."""
    steps = {side: [] for side in "fb"}
    states = np.concatenate([_recur(p, s, projected[s], at, steps[s] if keep is not None else None) for s in "fb"], axis=2)
    hidden = np.tanh(states @ p["A"])
    score = np.where(at >= 0, hidden @ p["a"], np.float32(-1e9))
    weight = np.exp(score - score.max(axis=1, keepdims=True))
    weight /= weight.sum(axis=1, keepdims=True)
    pooled = np.einsum("nt,nth->nh", weight, states)
    if keep is not None:
        keep |= {"steps": steps, "states": states, "hidden": hidden, "weight": weight, "pooled": pooled}
    return pooled @ p["o"] + p["c"][0]


def gradients(p: Params, word: np.ndarray, gram: np.ndarray, at: np.ndarray, label: np.ndarray) -> tuple[float, Params]:
    """Mean log loss of windows and its gradients; ``word`` and ``gram`` are the batch's distinct words."""
    x, n = _inputs(p, word, gram)
    keep: dict = {}
    logit = forward(p, {s: x @ p[f"W{s}"] + p[f"b{s}"] for s in "fb"}, at, keep)
    prob = _sigmoid(logit)
    loss = float(-np.mean(label * np.log(prob + 1e-7) + (1 - label) * np.log(1 - prob + 1e-7)))
    d = ((prob - label) / len(label)).astype(np.float32)
    g: Params = {"c": d.sum(keepdims=True), "o": keep["pooled"].T @ d}
    states, weight, hidden = keep["states"], keep["weight"], keep["hidden"]
    dpool = d[:, None] * p["o"]
    dstates = weight[:, :, None] * dpool[:, None]
    dweight = np.einsum("nh,nth->nt", dpool, states)
    dscore = weight * (dweight - (weight * dweight).sum(axis=1, keepdims=True))
    g["a"] = np.einsum("nt,nth->h", dscore, hidden)
    dhid = dscore[:, :, None] * p["a"] * (1 - hidden**2)
    g["A"] = states.reshape(-1, 2 * HIDDEN).T @ dhid.reshape(-1, HIDDEN)
    dstates += dhid @ p["A"].T
    dx = np.zeros_like(x)
    for k, side in enumerate("fb"):
        u, dh = p[f"U{side}"], np.zeros((len(at), HIDDEN), np.float32)
        g[f"U{side}"], each = np.zeros_like(u), np.zeros((*at.shape, 3 * HIDDEN), x.dtype)
        for t, before, z, r, new, phn, live in reversed(keep["steps"][side]):
            dh = dh + dstates[:, t, k * HIDDEN : (k + 1) * HIDDEN]
            own = np.where(live, dh, 0)
            dn = own * (1 - z) * (1 - new**2)
            dz = own * (before - new) * z * (1 - z)
            dr = dn * phn * r * (1 - r)
            dph = np.concatenate([dz, dr, dn * r], axis=1)
            g[f"U{side}"] += before.T @ dph
            each[:, t] = np.concatenate([dz, dr, dn], axis=1)
            dh = np.where(live, own * z, dh) + dph @ u.T
        proj = _summed(len(x), at[at >= 0], each[at >= 0])
        g[f"W{side}"], g[f"b{side}"] = x.T @ proj, proj.sum(axis=0)
        dx += proj @ p[f"W{side}"].T
    g["word"] = _summed(len(p["word"]), word, dx[:, :WORD_DIM])
    of_word, place = np.nonzero(gram)
    g["gram"] = _summed(len(p["gram"]), gram[of_word, place], (dx[:, WORD_DIM:] / n)[of_word])
    g["word"][0] = 0
    return loss, g


def _windows(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The windows of all texts, -1 past a text's end, and the number of the text that each comes from."""
    windows, owner = [], []
    for k, own in enumerate(ids):
        padded = np.full(starts(len(own))[-1] + WINDOW, -1, np.int32)
        padded[: len(own)] = own[: len(padded)]
        windows.append(np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE])
        owner.append(np.full(len(windows[-1]), k))
    return np.concatenate(windows), np.concatenate(owner)


@dataclass(frozen=True)
class Model:
    params: Params
    vocabulary: dict[str, int]
    threshold: float  # the logit that is a score of 0.5


class Scorer:
    """Scores texts in a worker; inputs of words that come again are kept."""

    def __init__(self, model: Model):
        self.model, self.rows = model, {}
        self.parts = {s: np.zeros((0, 3 * HIDDEN), np.float32) for s in "fb"}

    def _ids(self, texts: list[list[str]]) -> list[np.ndarray]:
        if len(self.rows) > CACHE:
            self.rows, self.parts = {}, {s: x[:0] for s, x in self.parts.items()}
        known = self.rows
        fresh = list(dict.fromkeys(w for words in texts for w in words if w not in known))
        if fresh:
            p, k = self.model.params, len(known)
            for at in range(0, len(fresh), 1 << 14):
                some = fresh[at : at + (1 << 14)]
                x, _ = _inputs(p, np.array([self.model.vocabulary.get(w, 0) for w in some]), grams(some))
                self.parts = {s: np.concatenate([old, x @ p[f"W{s}"] + p[f"b{s}"]]) for s, old in self.parts.items()}
            known.update(zip(fresh, range(k, k + len(fresh)), strict=True))
        return [np.fromiter(map(known.__getitem__, words), np.int32, len(words)) for words in texts]

    def logits(self, texts: Iterable[str | None]) -> np.ndarray:
        """For each text the largest logit of its windows; of a text without words that of an empty window."""
        words = [words_of(t) for t in texts]
        at, owner = _windows(self._ids(words))
        if not len(self.parts["f"]):  # no word at all so far: any row serves, none is used
            self.parts = {s: np.zeros((1, 3 * HIDDEN), np.float32) for s in "fb"}
        found = np.empty(len(at), np.float32)
        for k in range(0, len(at), 2048):
            found[k : k + 2048] = forward(self.model.params, self.parts, at[k : k + 2048])
        out = np.full(len(words), -np.inf)
        np.maximum.at(out, owner, found)
        return out

    def scores(self, texts: Iterable[str | None]) -> np.ndarray:
        return _sigmoid(self.logits(texts) - self.model.threshold)


def train(texts: list[str], labels: list[int], seed: int = 42) -> Model:
    """Fits the network to whole documents: a toxic document is known to have a toxic window, not which one.

    First every window has its document's label; after a fifth of the rounds a toxic document teaches by its windows that
    score highest so far. A fifth of the documents isn't trained on and has
    three times the weight of the others when the threshold is set; it is never below even odds. With one class only, all scores are 0.5 or less.
    """
    rng = np.random.default_rng(seed)
    y = np.array(labels, dtype=np.float32)
    row: dict[str, int] = {}
    ids = [np.array([row.setdefault(w, len(row)) for w in words_of(t)], dtype=np.int32) for t in texts]
    rows_of = [np.unique(own) for own in ids]
    seen = np.bincount(np.concatenate([*rows_of, np.empty(0, np.int32)]), minlength=len(row))
    frequent = sorted((-n, w) for w, n in zip(row, seen.tolist(), strict=True) if n > 2)[: VOCABULARY - 1]
    vocabulary = {w: k + 1 for k, (_, w) in enumerate(frequent)}
    params = _initial(len(vocabulary) + 1, rng)
    if not len(y) or y.min() == y.max():
        return Model(params, vocabulary, 1e3 if not len(y) or y.max() < 1 else -1e3)
    every = list(row)
    word, gram = np.array([vocabulary.get(w, 0) for w in every]), grams(every)
    at, owner = _windows(ids)
    check = rng.random(len(y)) < 0.2
    usable = ~check[owner]
    params["word"][1:, 0] = _surprise((word[r] for r in rows_of), y, ~check, len(params["word"]))[1:]
    params["gram"][1:, 0] = _surprise((gram[r].ravel() for r in rows_of), y, ~check, GRAMS)[1:]
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params.items()}
    steps = 0

    def logits(rows: np.ndarray) -> np.ndarray:
        x, _ = _inputs(params, word, gram)
        parts = {s: x @ params[f"W{s}"] + params[f"b{s}"] for s in "fb"}
        return np.concatenate([forward(params, parts, at[rows[k : k + 512]]) for k in range(0, len(rows), 512)])

    expected = 4 * len(at) * y.mean() / BATCH
    epochs = max(EPOCHS, min(round(STEPS / max(expected, 1)), 8 * EPOCHS))
    for epoch in range(epochs):
        rows = np.flatnonzero(usable)
        if epoch * EPOCHS >= epochs:
            now = logits(rows)
            best = np.full(len(y), -np.inf)
            np.maximum.at(best, owner[rows], now)
            rows = rows[(y[owner[rows]] == 0) | (now >= np.minimum(best[owner[rows]], 1.0))]
        positive, negative = rows[y[owner[rows]] == 1], rows[y[owner[rows]] == 0]
        negative = rng.permutation(negative)[: max(3 * len(positive), 2000)]
        rows = rng.permutation(np.concatenate([positive, negative]))
        for k in range(0, len(rows), BATCH):
            some = at[rows[k : k + BATCH]]
            own, inverse = np.unique(some[some >= 0], return_inverse=True)
            local = np.full(some.shape, -1, np.int32)
            local[some >= 0] = inverse
            # Some words go unknown, so that their characters must be learned as well.
            masked = np.where(rng.random(len(own)) < 0.3, 0, word[own])
            _, g = gradients(params, masked, gram[own], local, y[owner[rows[k : k + BATCH]]])
            steps += 1
            rate = RATE * min(1, steps / 20) * (1 - 0.8 * epoch / epochs)
            for name, value in g.items():
                m, v = moments[name]
                m += 0.1 * (value - m)
                v += 0.01 * (value * value - v)
                params[name] -= rate * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.99**steps)) + 1e-7)
    best = np.full(len(y), -np.inf)
    np.maximum.at(best, owner, logits(np.arange(len(at))))
    return Model(params, vocabulary, max(0.0, _threshold(best, y, np.where(check, 3.0, 1.0))))


def _surprise(found: Iterable[np.ndarray], label: np.ndarray, used: np.ndarray, n: int) -> np.ndarray:
    """How many deviations more often than expected a feature is in toxic documents: where its first input starts."""
    toxic, all_ = np.zeros(n), np.zeros(n)
    for own, y, use in zip(found, label, used, strict=True):
        if use:
            own = np.unique(own)
            all_[own] += 1
            toxic[own] += y
    mean = all_ * label[used].mean()
    return np.clip((toxic - mean) / np.sqrt(mean + 0.5), -4, 8) / 4


def _threshold(logit: np.ndarray, label: np.ndarray, weight: np.ndarray) -> float:
    """The cut with the best weighted F1, halfway between its neighbours."""
    order = np.argsort(-logit, kind="stable")
    hit = np.cumsum((weight * label)[order])
    f1 = 2 * hit / (np.cumsum(weight[order]) + (weight * label).sum())
    k = int(np.argmax(f1))
    last = logit[order[k]]
    below = logit[logit < last]
    return float((last + (below.max() if len(below) else last - 2)) / 2)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Trains on a bounded sample of each class, chosen by hash: the same rows on every run.

    Labels that are null, documents without text and documents without a label teach nothing. A document with several
    labels is toxic if any says so. Rows alike in ``doc_id`` and text count once.
    """
    said = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    said = said.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = docs.where("text is not null").select("doc_id", "text", F.xxhash64("doc_id", "text").alias("h"))
    # Ids first: texts are read for the sample only.
    asked = common.stored(known.drop("text").join(said, "doc_id").distinct())
    chosen = common.sample_by_group(asked, "toxic", "h", SAMPLE_DOCS)
    chosen = F.broadcast(chosen.select("doc_id", "h", "toxic"))  # at most SAMPLE_DOCS rows of each class
    picked = known.join(chosen, ["doc_id", "h"]).withColumn("text", common.spread("text", "h", SAMPLE_CHARS, SAMPLE_PART))
    rows = picked.dropDuplicates(["doc_id", "h"]).orderBy("toxic", "h").collect()
    return train([r["text"] for r in rows], [int(r["toxic"] > 0) for r in rows])


def score(docs: DataFrame, model: Model, into: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score, in 0 to 1 (higher: more likely toxic), from whole texts alone.

    A text without a word (null, empty) gets the score of an empty window, capped below 0.5. Row-wise; repeated rows
    get equal scores. A column that already has the name ``into`` is replaced.
    """

    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Scorer(model)
        for some in texts:
            parts = []
            for k in range(0, len(some), 256):  # bounds the windows in memory
                part = some.iloc[k : k + 256]
                empty = np.array([not (t and _WORD.search(t)) for t in part])
                found = own.scores(part)
                parts.append(np.where(empty, np.minimum(found, 0.49), found))
            yield pd.Series(np.concatenate(parts) if parts else np.empty(0))

    return docs.withColumn(into, F.pandas_udf(scored, "double")("text"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document; learned from labelled documents whose fold is not 0."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold("doc_id", 5) != 0)
    return score(docs, fit(docs, labels)).select(
        "doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
