"""Alignment of two tokenizations against all overlaps."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from milemark.llm import alignment


def overlaps(a, b):
    sa, sb = [0, *a], [0, *b]
    return sorted((x, y) for x in range(len(a)) for y in range(len(b)) if max(sa[x], sb[y]) < min(a[x], b[y]))


def test_runs_and_links():
    rng = random.Random(3)
    for k in range(2000):
        a = sorted({*rng.sample(range(1, 90), rng.randint(0, 60)), 90})
        b = sorted({*rng.sample(range(1, 90), rng.randint(0, 60)), 90}) if k % 2 else sorted({*a} - {*rng.sample(a[:-1], min(3, len(a) - 1))})
        runs, left, right = alignment.align(a, b)
        links, ends = list(zip(left, right, strict=True)), []
        for i, j, n, m in runs:
            if m:
                assert a[i + n - 1] == b[j + m - 1] and n + m > 2
                ends.append(a[i + n - 1])
            else:
                assert a[i : i + n] == b[j : j + n]
                ends += a[i : i + n]
                links += [(i + x, j + x) for x in range(n)]
        assert ends == sorted({*a} & {*b})
        assert sorted(links) == overlaps(a, b)


def test_run_length():
    rng = random.Random(4)
    for _ in range(2000):
        n = rng.randint(0, 70)
        a, b = list(range(n)) + [500] * rng.randint(0, 9), list(range(n)) + [600] * rng.randint(0, 9)
        assert alignment.run_length([7, 7, *a], [7, *b], 2, 1) == n


@pytest.fixture(scope="module")
def plain():
    """Both tokenizers as their libraries give them, with the bytes of their tokens."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path(alignment.A_FILE))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(alignment.B_FILE))
    return a, b


def brute(texts, plain):
    a_, b_ = plain
    letters = alignment.byte_letters()
    found, count = [], Counter()
    for text in texts:
        ids, pieces = [], []
        if text:
            enc = a_.encode(" " + text, add_special_tokens=False)
            ids, a_bytes = enc.ids, [bytes(letters[c] for c in t) for t in enc.tokens]
            pieces = b_.encode(text)
            said = [b_.id_to_piece(k) for k in pieces]
            b_bytes = [bytes([int(p[3:5], 16)]) if b_.is_byte(k) else p.replace("▁", " ").encode() for k, p in zip(pieces, said, strict=True)]
            if not (b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode()):
                ids, pieces = [], []
        if not ids:
            found.append(None)
            continue
        ends = [[sum(map(len, side[: k + 1])) for k in range(len(side))] for side in (a_bytes, b_bytes)]
        cuts = sorted({*ends[0]} & {*ends[1]})
        groups, low = [], 0
        for cut in cuts:
            own = [[str(x) for x, e in zip(side, at, strict=True) if low < e <= cut] for side, at in ((ids, ends[0]), (pieces, ends[1]))]
            groups.append(f"{','.join(own[0])}|{','.join(own[1])}")
            low = cut
        links = [(ids[x], pieces[y]) for x, y in overlaps(*ends)]
        count.update(links)
        found.append((len(ids), len(pieces), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    return [
        (0, 0, 0, 0, 0, 0, "") if f is None else
        (*f[:3], len(f[3]), sum(count[x] == most[x[1]] for x in f[3]), sum(count[x] for x in f[3]), f[4]) for f in found
    ]


TEXTS = [
    None, "", " ", "  a  b ", "a\n\n b\tc\r\n", "naïve café 日本語 😀 é", "▁x", "a ▁ b", "</s> <s> <unk> <0x41> <|endoftext|>", "don't we'll 1234 5,6",
    "x" * 3000, "word " * 700, "a\x00b", "ends with space ", "same text here", "same text here",
]


@pytest.mark.parametrize("most", [alignment.FREQUENT, 3, 0])
def test_documents(spark, plain, most):
    """With all, few or no pairs broadcast."""
    texts = TEXTS + [r["text"][:1500] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(25).collect()]
    rows = [(None if k == 3 else 5 if k in (14, 15) else k, x) for k, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(777) for c in ("_row", "pair", "pairs", "n", "count", "x.y")})
    got = [tuple(r) for r in alignment.align_documents(df.repartition(3), most=most).collect()]
    want = [(k, *r) for (k, _), r in zip(rows, brute(texts, plain), strict=True)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_words_alone_and_together(plain):
    rng, two = random.Random(1), alignment.pair()
    letters = "ab é\n\t  ½你́<s>.ß😀 "
    for _ in range(4000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 30)))
        assert two._b_ids(text) == plain[1].encode(text)


def test_token_bytes_and_group_text():
    """Ends only where the bytes are the text's; groups written from marks of last tokens."""
    table = alignment.Table([b"a", b"", b"bc", "é".encode()])
    data = lambda x: np.frombuffer(x.encode(), dtype=np.uint8)
    ids = np.array([0, 2, 1, 3])
    assert table.ends(ids, data("abcé")).tolist() == [1, 3, 3, 5]
    assert table.ends(ids, data("abde")) is None and table.ends(ids, data("abc")) is None
    assert table.ends(ids[:0], data("")) is None
    marks = lambda *x: np.array(x, dtype=np.int64)
    text = alignment.pair().groups_text(marks(1, 2, 3, 4), marks(5, 6, 7), marks(0, 1, 1, 1), marks(1, 1, 1))
    assert text == "1,2|5;3|6;4|7"
    assert alignment.pair().groups_text(marks(1, 2), marks(5, 6, 7), marks(1, 1), marks(1, 0, 1)) == "1|5;2|6,7"


def alone(text, plain):
    """Ids and ends of one text by the libraries; None where the bytes do not give it back."""
    letters = alignment.byte_letters()
    if not text:
        return None
    enc, pieces = plain[0].encode(" " + text, add_special_tokens=False), plain[1].encode(text)
    said = [plain[1].id_to_piece(k) for k in pieces]
    sides = [bytes(letters[c] for c in t) for t in enc.tokens], [
        bytes([int(p[3:5], 16)]) if plain[1].is_byte(k) else p.replace("▁", " ").encode() for k, p in zip(pieces, said, strict=True)
    ]
    if any(b"".join(side) != (" " + text).encode() for side in sides):
        return None
    return [enc.ids, pieces, *(np.cumsum([len(t) for t in side]).tolist() for side in sides)]


def test_texts_together_and_alone(plain, monkeypatch):
    """Also with words that are not given back, and with words forgotten between the parts."""
    rng, two = random.Random(2), alignment.Pair(public_tokenizers.path(alignment.A_FILE), None, public_tokenizers.path(alignment.B_FILE))
    letters = "ab é\n\t  ½你́<s>.ß😀 ▁ﬁ\x1c\u00a0Ａ"
    words = ["word", "naïve", "日本語", "ﬁne", "a▁b", "x" * 2500, "end.\nNext", "don't", "4807", "é"]
    texts = [None, "", *TEXTS]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) for _ in range(600)]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 6))) for _ in range(300)]
    rng.shuffle(texts)
    want = [alone(t, plain) for t in texts]
    assert 0 < sum(w is None for w in want) < len(want) / 2
    for most in (400_000, 20):
        monkeypatch.setattr(alignment.tokens, "CACHE", most)
        parts = list(alignment.in_parts(texts, 3000))
        assert [t for part in parts for t in part] == texts and len(parts) > 3
        assert all(len(part) == 1 or sum(len(t or "") for t in part) <= 3000 for part in parts)
        got = [found and [x.tolist() for x in found] for part in parts for found in two.encode(part)]
        assert got == want


def test_new_words_are_encoded_together():
    """A tokenizer is called once for all words that are new in some texts, not for each word."""
    two, calls = alignment.Pair(public_tokenizers.path(alignment.A_FILE), None, public_tokenizers.path(alignment.B_FILE)), []

    class Counted:
        def encode(self, what, **options):
            calls.append(what)
            return model.encode(what, **options)

    model, two._b = two._b, Counted()
    texts = [f"one two {k} three{k}" for k in range(50)]
    first, second = two.encode(texts), two.encode(texts)
    assert len(calls) == 1 and len(set(calls[0])) == len(calls[0]) == 102
    assert None not in two.encode([" one two", "one  two ", "two \n one"]) and sorted(calls[1]) == [" one", "one  two ", "two \n"]
    assert all(np.array_equal(x, y) for f, s in zip(first, second, strict=True) for x, y in zip(f, s, strict=True))


def test_long_tokens():
    """Sizes that differ by 256, which no byte can tell apart."""
    runs, left, right = alignment.align([300, 344, 350], [44, 344, 350])
    assert runs == [(0, 0, 2, 2), (2, 2, 1, 0)] and list(zip(left, right, strict=True)) == [(0, 0), (0, 1), (1, 1)]
    assert alignment.align([300, 600], [300, 600])[0] == [(0, 0, 2, 0)]


def test_empty_table(spark):
    assert alignment.align_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
