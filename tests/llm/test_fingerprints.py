"""Threshold-scaled sketches against brute force."""

import hashlib

import pytest
from pyspark.sql import functions as F

from milemark.llm import fingerprints as fp

DOCS = "doc_id long, text string"


def words(text):
    return [w.decode() for w in text.encode().split()]


def sketch(text):
    w = words(text)
    said = [" ".join(w[k : k + fp.WORDS]) for k in range(max(1, len(w) - fp.WORDS + 1))] if w else []
    own = sorted({hashlib.md5(s.encode()).hexdigest()[:16] for s in said})
    low = [h for h in own if h < fp.LIMIT]
    return low if len(low) >= fp.LEAST else own[: fp.LEAST]


def upto(s):
    return "g" if len(s) < fp.LEAST else f"{int(fp.LIMIT, 16) - 1:016x}" if s[-1] < fp.LIMIT else s[-1]


def containment(a, b):
    if not a or not b:
        return float(not a and not b)
    known = [h for h in a if h <= min(upto(a), upto(b))]
    return len(set(known) & set(b)) / len(known) if known else 0.0


def expected(rows):
    """In descending order of id, null last, then of the text's hash, which the caller leaves without ties."""
    out = []
    for k, (doc_id, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        s, e, n = sketch(text), sketch(edited), sketch(after)
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), "".join(s), "".join(e), containment(s, e), containment(s, n)))
    return out


def got(df):
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


LONG = " ".join(f"tok{k * k % 977}" for k in range(20_000))


@pytest.fixture(scope="module")
def rows():
    plain = [(k, " ".join(f"w{k * j % 61}é" for j in range(5 * k % 170))) for k in range(40, 0, -1)]
    return [((1 << 53) + 1, LONG), (77, "one"), (76, None), (75, ""), (74, " \n\t "), (73, "a b c d e f"), (72, "a b c d e f"), *plain, (None, "no id 你好")]


def test_against_brute_force(spark, rows):
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(777) for c in ("_id", "_text", "_b", "n_chars", "fingerprint", "_n", "x.y")})
    for n in (1, 7):
        assert got(fp.fingerprints(df.repartition(n))) == sorted(expected(rows), key=str)


def test_ranges_of_the_order(spark, rows, monkeypatch):
    """Many ranges: the last row of each is followed by the first of the next, the last of all by the first."""
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    try:
        assert got(fp.fingerprints(spark.createDataFrame(rows, DOCS))) == sorted(expected(rows), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_repeated_rows(spark, monkeypatch):
    """Rows alike follow one another, also where they are many and only one of them is dealt out."""
    rows = [(9, "first of all here now"), *[(8, "many times the same text said")] * 25, (7, "after them"), *[(None, None)] * 30]
    want = sorted(expected(rows), key=str)
    df = spark.createDataFrame(rows, DOCS)
    assert got(fp.fingerprints(df.repartition(3))) == want
    monkeypatch.setattr(fp, "MANY_COPIES", 3)
    monkeypatch.setattr(fp, "COPIES_AT_ONCE", 4)
    assert got(fp.fingerprints(df.repartition(3))) == want


def test_few_rows(spark):
    assert fp.fingerprints(spark.createDataFrame([], DOCS)).count() == 0
    (one,) = got(fp.fingerprints(spark.createDataFrame([(5, "abcd")], DOCS)))
    assert one == expected([(5, "abcd")])[0]


def test_sketches_merge(spark):
    """The sketch of a union comes from the sketches alone, and tells how much of a short text a long one holds."""
    short = " ".join(f"tok{k * k % 977}" for k in range(500, 800))
    df = spark.createDataFrame([(LONG, short, "x y z " * 30)], "a string, b string, c string")
    row = df.select(
        fp.merge(fp.merge(fp.sketch(F.col("a")), fp.sketch(F.col("b"))), fp.sketch(F.col("c"))).alias("m"),
        fp.retain(F.concat(*[fp.hashes(F.col(c)) for c in "abc"])).alias("u"), fp.sketch(F.col("a")).alias("a"), fp.sketch(F.col("b")).alias("b"),
    )
    found = row.select("*", fp.containment(F.col("b"), F.col("a")).alias("in_long"), fp.containment(F.col("a"), F.col("b")).alias("in_short")).first()
    assert found["m"] == found["u"] and len(found["a"]) > fp.LEAST
    assert found["in_long"] == 1.0 and found["in_short"] < 0.5


def test_estimates(spark):
    """Close to the true shares over the table."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows.sort(reverse=True)
    found = {r[0]: r for r in got(fp.fingerprints(spark.createDataFrame(rows, DOCS)))}
    off = []
    for k, (doc_id, text) in enumerate(rows):
        half, after = len(text) // 2, rows[(k + 1) % len(rows)][1]
        w, e = words(text), words(text[: len(text) - half] + after[:half])
        a, b = ({tuple(x[j : j + 5]) for j in range(max(1, len(x) - 4))} for x in (w, e))
        off.append(abs(found[doc_id][5] - len(a & b) / len(a)))
    assert sum(off) / len(off) < 0.1
