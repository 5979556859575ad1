"""Registered queries against SQL, brute force, exact round trips and held-out accuracy."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from milemark.llm import common, embeddings, lines, packing, quality, simhash, tokens, toxicity
from tools.check import compare, connect

SF = "/root/testdata/sf0.001"
SQL = oracle_sql()


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows_of(spark, name):
    return queries()[name](spark, SF).collect()


def groups(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_all_registered():
    known = queries()
    assert {x.split("_")[0] for x in known if x.startswith("op") and x[2].isdigit()} == {f"op{k}" for k in range(1, 14)}
    assert known["pipeline"] is corpus_pipeline.run


@pytest.mark.parametrize("name", ["op1_embeddings", "op2_mixing", "op9_urls", "op11_fingerprints"])
def test_sql(spark, name):
    assert compare(spark, connect(SF), SF, name, queries()[name], SQL[name]).startswith("ok")


def test_embeddings_with_links(spark, monkeypatch):
    """Many cells and small blocks: every link of brute force, also across cells."""
    monkeypatch.setattr(embeddings, "CELL_ROWS", 16)
    monkeypatch.setattr(embeddings, "PROBE_BLOCK", 32)
    rng = np.random.default_rng(1)
    centre = rng.standard_normal((12, 8))
    x = (centre[rng.integers(0, 12, 400)] + 0.25 * rng.standard_normal((400, 8))).tolist()
    x += x[:30]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df).collect()}
    unit = np.array(x) / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= embeddings.THRESHOLD
    np.fill_diagonal(near, False)
    want = groups(len(x), np.argwhere(near))
    assert near.sum() > 1000
    assert [got[k]["n_links"] for k in range(len(x))] == near.sum(axis=1).tolist()
    assert [got[k]["component_id"] for k in range(len(x))] == want


def shingle_print(text):
    words = text.encode().lower().split()
    parts = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, docs):
    ids = sorted(docs)
    prints = [shingle_print(docs[k]["text"]) for k in ids]
    links = [(a, b) for a in range(len(ids)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2]
    root = groups(len(ids), links)
    got = {r["doc_id"]: r for r in rows_of(spark, "op6_simhash")}
    assert [got[k]["fingerprint"] for k in ids] == [f"{p:016x}" for p in prints]
    assert [got[k]["component_id"] for k in ids] == [ids[r] for r in root]


def test_simhash_close_group(spark):
    """A bucket of very many close fingerprints, split into blocks: the same components as brute force."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 6)
    prints = sorted({int(base[k % 6]) ^ sum(1 << int(b) for b in rng.integers(0, 14, k % 5)) for k in range(900)})
    fps = spark.createDataFrame([(p.to_bytes(8, "little"),) for p in prints], "fp binary")
    found = {bytes(r["node"]): bytes(r["component"]) for r in common.components(simhash.links(fps, simhash.EXACT, 64)).collect()}
    root = groups(len(prints), [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2])
    by_group = {}
    for p, r in zip(prints, root, strict=True):
        own = p.to_bytes(8, "little")
        by_group.setdefault(r, set()).add(found.get(own, own))
    assert all(len(x) == 1 for x in by_group.values())
    assert len({x for s in by_group.values() for x in s}) == len(by_group)


def test_components(spark):
    rng = np.random.default_rng(5)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 600, (400, 2))] + [(k, k + 1) for k in range(1000, 1100)] + [(2000, k) for k in range(2001, 2300)]
    root = groups(2400, links)
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: root[k] for a, b in links if a != b for k in (a, b)}


def one_of_each(texts):
    """Of texts by id those that stay: the smallest id of each group linked by two differing bits or fewer."""
    ids = sorted(texts)
    prints = [shingle_print(texts[k]) for k in ids]
    root = groups(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2])
    return {ids[k] for k in range(len(ids)) if root[k] == k}


def test_near_copies_of_the_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in rows.collect()}
    want = one_of_each(texts)
    assert len(want) < len(texts)
    assert {r["doc_id"] for r in simhash.keep_one(rows).collect()} == want


def test_lines(spark, docs):
    texts = [(k, lines.hashed_lines(docs[k]["text"])) for k in sorted(docs)]

    def windows(own):
        for a in range(len(own)):
            n = 0
            for b in range(a, len(own)):
                n += own[b][2]
                if n >= lines.MIN_WORDS:
                    yield a, b
                    break

    first = {}
    for k, own in texts:
        for a, b in windows(own):
            first.setdefault(tuple(x[1] for x in own[a : b + 1]), (k, a))
    got = {r["doc_id"]: r for r in rows_of(spark, "op3_lines")}
    lookup = dict(texts)
    removed = 0
    for k, own in texts:
        gone = set()
        for a, b in windows(own):
            q, c = first[tuple(x[1] for x in own[a : b + 1])]
            if (q, c) == (k, a):
                continue
            other, lo, hi = lookup[q], 0, b - a
            while a + lo > 0 and c + lo > 0 and own[a + lo - 1][1] == other[c + lo - 1][1]:
                lo -= 1
            while a + hi + 1 < len(own) and c + hi + 1 < len(other) and own[a + hi + 1][1] == other[c + hi + 1][1]:
                hi += 1
            gone |= set(range(a + lo, a + hi + 1))
        left = [docs[k]["text"].split("\n")[x[0]] for j, x in enumerate(own) if j not in gone]
        assert [x for x in got[k]["text"].split("\n") if x.encode().split()] == left
        assert (got[k]["n_removed"], got[k]["n_lines"]) == (len(gone), len(own))
        removed += len(gone)
    assert removed > 0
    before = {x[1] for _, own in texts for x in own}
    after = {x[1] for r in got.values() for x in lines.hashed_lines(r["text"])}
    assert before == after  # every line stays somewhere


def test_chat(spark):
    turns = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    turns[-7] = [(role, r"\### Assistant: </turn> ok") for role in ("user", "assistant")]
    got = {r["conv_id"]: r for r in rows_of(spark, "op4_chat")}
    assert set(got) == set(turns)
    for conv, own in turns.items():
        whole, loss = "".join(f"{a}\n{b}\n" for a, b in own), "".join(b for a, b in own if a == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["loss_chars"]) == (len(own), len(loss))
        assert r["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert r["formatted_chars"] >= len(whole)


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_language(spark, docs):
    rows = rows_of(spark, "op5_langid")
    assert len(rows) == len(docs)
    assert all(r["held_out"] == (fold(r["doc_id"], 3) == 1) and 0 <= r["score"] <= 1 for r in rows)
    held = [r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in rows if r["held_out"]]
    assert sum(held) / len(held) > 0.95


def test_quality(spark, docs):
    rows = {r["doc_id"]: r for r in rows_of(spark, "op7_quality")}
    for k, d in docs.items():
        text, words = d["text"], d["text"].encode().split()
        three = list(zip(words, words[1:], words[2:], strict=False))
        count = Counter(three)
        again = {j for i, w in enumerate(three) if count[w] > 1 for j in (i, i + 1, i + 2)}
        with_word = [x for x in text.split("\n") if x.encode().split()]
        want = (len(words), len(b"".join(words).decode()), sum(c in "#*$%&|<>" for c in text), len(with_word) - len(set(with_word)), len(again))
        r = rows[k]
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    # The ratio again from counts in Python, with Spark's own buckets of the same n-grams.
    good = {r["doc_id"] for r in labels if r["quality"] == 1}
    grams = {k: [(w,) for w in d["text"].encode().split()] for k, d in docs.items()}
    grams = {k: [g for i, (w,) in enumerate(g_) for g in ((w,), (w, g_[i + 1][0]) if i + 1 < len(g_) else (w,))] for k, g_ in grams.items()}

    def bucket(gram):
        h = 42
        for w in gram:  # a row's hash chains its columns by the seed
            h = xxhash.xxh64_intdigest(w, h)
        return (h - (1 << 64) if h >> 63 else h) % quality.BUCKETS

    raw, target = np.ones(quality.BUCKETS), np.ones(quality.BUCKETS)
    buckets = {k: [bucket(g) for g in own] for k, own in grams.items()}
    for k, own in buckets.items():
        np.add.at(raw, own, 1)
        if k in good:
            np.add.at(target, own, 1)
    share = np.log(target / target.sum()) - np.log(raw / raw.sum())
    for k, own in buckets.items():
        assert rows[k]["ratio"] == pytest.approx(share[own].mean() if own else 0.0, abs=1e-9)
    kept = [rows[r["doc_id"]]["kept"] == (r["quality"] == 1) for r in labels if not rows[r["doc_id"]]["base_failed"]]
    assert sum(kept) / len(kept) > 0.9


def test_toxicity_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in toxicity._initial(50, rng).items()}
    word, gram = rng.integers(1, 50, 20), toxicity.grams([f"w{k}abc" for k in range(20)])
    at, y = rng.integers(0, 20, (6, toxicity.WINDOW)), np.array([0, 1, 0, 1, 1, 0.0])
    at[0, 10:] = -1
    _, g = toxicity.gradients(p, word, gram, at, y)
    for name in p:
        flat, k = p[name].reshape(-1), int(np.argmax(np.abs(g[name])))
        old = flat[k]
        flat[k] = old + 1e-4
        up, _ = toxicity.gradients(p, word, gram, at, y)
        flat[k] = old - 1e-4
        down, _ = toxicity.gradients(p, word, gram, at, y)
        flat[k] = old
        assert (up - down) / 2e-4 == pytest.approx(g[name].reshape(-1)[k], rel=0.02, abs=1e-5)


def test_toxicity_held_out(spark):
    """On the larger table: 200 labelled documents say too little."""
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = toxicity.op8(spark, sf).collect()
    assert len(rows) == 1000
    assert all(r["held_out"] == (fold(r["doc_id"], 5) == 0) and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [(labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(a == b for a, b in held) / len(held) >= 0.85


def test_windows_cover_all_words():
    for n in range(300):
        seen = {k for s in toxicity.starts(n) for k in range(s, s + toxicity.WINDOW)}
        assert seen >= set(range(n))


@pytest.mark.parametrize("first", ["\u4e00", "\u3042", "\u0e01", "\U00020000", "a", "\u00e0"])
def test_every_character_reaches_the_network(first):
    """Unspaced text of one to four bytes a character: a change anywhere changes some n-gram, and no word is cut short."""
    text = "".join(chr(ord(first) + k % 23) for k in range(100))
    if first == "\u0e01":
        assert len(text.encode()) == 300
    words = toxicity.words_of(text)
    assert all(len(w.encode()) <= toxicity.WORD_BYTES for w in words)
    seen = Counter(toxicity.grams(words).ravel().tolist())
    for k in range(len(text)):
        changed = text[:k] + chr(ord(text[k]) + 1) + text[k + 1 :]
        assert Counter(toxicity.grams(toxicity.words_of(changed)).ravel().tolist()) != seen
    for k in range(len(text) - toxicity.OVERLAP):  # a term across a border is whole in some piece
        assert any(text[k : k + toxicity.OVERLAP + 1] in w for w in words)


def test_packing(spark, docs):
    from tokenizers import Tokenizer
    import public_tokenizers

    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, total = {}, 0
    for k, d in docs.items():
        ids = np.array([*full.encode(d["text"], add_special_tokens=False).ids, 0], dtype="<u4")
        for piece, (start, length) in enumerate(packing.cut_points(len(ids), 2048)):
            want[k, piece] = (start, length, zlib.crc32(ids[start : start + length].tobytes()))
        total += len(ids)
    rows = rows_of(spark, "op10_packing")
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    assert len({r["sequence_id"] for r in rows}) <= 1.02 * total / 2048 + 1


def test_fullest_is_the_best_subset():
    rng = np.random.default_rng(2)
    for _ in range(200):
        counts = {int(x): int(n) for x, n in zip(rng.integers(1, 60, 6), rng.integers(1, 4, 6), strict=True)}
        room = int(rng.integers(1, 120))
        sums = {0}
        for length, n in counts.items():
            sums = {s + k * length for s in sums for k in range(n + 1) if s + k * length <= room}
        found = packing._fullest(counts, sorted(counts, reverse=True), room)
        assert sum(x * n for x, n in found) == max(sums)
        assert all(n <= counts[x] for x, n in found)


@pytest.mark.parametrize("text", ["", " ", "  a", "a  b   c", "a\n b \n\n c ", "don't we'll", "x" * 3000, "naïve  café\t\t—日本 語", "a   b\x85c\x1c d", "1234 5,6  7"])
def test_encoder(text):
    from tokenizers import Tokenizer
    import public_tokenizers

    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = tokens.encoder()
    assert np.frombuffer(own.encode(text), dtype="<u4").tolist() == full.encode(text, add_special_tokens=False).ids
    assert own.decode(own.encode(text)) == text


def test_pipeline(spark, docs):
    out = corpus_pipeline.run(spark, SF).collect()
    assert len(out) > 50
    kept, state = [], spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        state = common.stored(stage(spark, state, SF))
        assert state.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append(state.count())
    assert len(docs) >= kept[0] >= kept[1] >= kept[2] > 0
    assert {r["doc_id"] for r in out} == {r["doc_id"] for r in state.select("doc_id").collect()}
    assert sum(r["length"] for r in out if r["piece"] == 0 or r["length"]) > 0
