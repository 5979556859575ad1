"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from milemark.llm import chat, embeddings, langid, lines, mixing, packing, quality, simhash, toxicity, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators give to their own columns.
CLASH = [
    "size", "score", "kept", "component_id", "fingerprint", "piece", "start", "length", "target", "source_size", "taken", "n_lines",
    "n_removed", "held_out", "lang_pred", "ratio", "h", "w", "l", "p", "at", "a", "b", "key", "block", "level", "weight", "n", "x.y", "fp",
    "_h", "_k", "_id", "_g", "_t", "_key", "_size", "_source", "_times", "_time", "_at", "_rounds", "_left", "_same", "_best", "_fp", "_root",
    "_none", "cuts", "_lines", "_removed", "c0", "c1", "again", "row", "_row", "pairs", "times", "_text", "_s", "_next", "_b", "_guest", "k", "th", "fault",
]
PASSAGE = " ".join(f"word{k}" for k in range(60))
LONG = " ".join(f"tok{k * k % 977}" for k in range(60_000))
BIG = (1 << 53) + 1


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, "   \n\t \n", "en", "a", 6), (4, LONG, "en", "b", len(LONG)),
        (5, f"{PASSAGE}\nown line", "de", "b", 9), (6, f"{PASSAGE}\nother line", "de", "b", 9), (6, f"{PASSAGE}\nother line", "de", "b", 9),
        (None, "no id at all here", None, "a", 3), (BIG, "exact id beside nulls", "fr", None, 3), (8, "é ü ñ 你好 <|endoftext|>", "fr", "c", 3),
        (9, f"{PASSAGE}\nown line", "de", None, 9), (10, "a" * 100_000, "en", "c", 9),
    ]
    out = spark.createDataFrame(rows, DOCS)
    return out.withColumns({c: F.lit(777) for c in CLASH})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(
        [(5, 1, 0), (4, 1, 0), (6, 0, 1), (6, 1, 1), (2, None, None), (None, 1, 1), (8, 0, 1)], "doc_id long, quality int, toxic int"
    )


def ids(rows):
    return sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in rows)


def every(docs):
    return ids(docs.select("doc_id").collect())


def by_id(rows):
    return {r["doc_id"]: r for r in rows}


def test_simhash(docs):
    rows = simhash.near_duplicates(docs).collect()
    assert ids(rows) == every(docs)
    got = by_id(rows)
    assert got[1]["component_id"] == got[2]["component_id"] == got[3]["component_id"] == 1
    assert set(got[2]["fingerprint"]) == {0}
    assert got[9]["component_id"] == 5
    assert got[BIG]["component_id"] == BIG
    assert got[None]["component_id"] is None


def unchanged(df):
    """Columns of the caller, whatever their names, come back as they were."""
    return all(r[c] == 777 for r in df.collect() for c in CLASH if c in df.columns)


def test_keep_one(docs):
    left = simhash.keep_one(docs)
    assert left.columns == docs.columns and unchanged(left)
    assert ids(left.collect()) == ids([{"doc_id": k} for k in (1, 4, 5, 6, None, BIG, 8, 10)])


def test_keep_one_of_rows_alike(spark):
    """Null ids come last; of one id the row that stays is the same whatever the order of the rows."""
    rows = [(None, "a b c d", 1), (4, "a b c d", 2), (4, "a b c d", 3), (4, "a b c d", 3), (None, "x y z", 1), (None, "x y z", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, other int")
    got = {tuple(sorted(map(str, simhash.keep_one(df.repartition(n)).collect()))) for n in (1, 3)}
    assert len(got) == 1 and len(got.pop()) == 2


def test_lines(docs):
    rows = lines.dedup(docs)
    assert rows.columns == [c for c in docs.columns if c not in ("n_lines", "n_removed")] + ["n_lines", "n_removed"]
    assert unchanged(rows.drop("n_lines", "n_removed"))
    got, rows = by_id(rows.collect()), rows.collect()
    assert ids(rows) == every(docs)
    assert got[1]["text"] is None and got[2]["text"] == "" and got[3]["text"] == "   \n\t \n"
    assert got[5]["n_removed"] == 0 and got[9]["text"] == ""
    assert [r["text"] for r in rows if r["doc_id"] == 6] == ["other line"] * 2
    assert got[4]["text"] == LONG and got[10]["text"] == "a" * 100_000


def test_mixing(docs):
    rows = mixing.mix(docs).collect()
    assert ids(rows) == every(docs)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    total = sum(r["size"] for r in rows)
    target = {r["source"]: r["target"] for r in rows}
    assert sum(target.values()) == pytest.approx(total)
    for source, want in target.items():
        assert abs(sum(r["taken"] for r in rows if r["source"] == source) - want) <= 2
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_mixing_repeats_rows(docs):
    out = mixing.repeated(docs)
    assert out.columns == docs.columns and unchanged(out)
    assert {r["doc_id"] for r in out.collect()} >= {1, 2, 3}


def test_packing(docs):
    rows = packing.pack(packing.pieces(docs)).collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.collect()}
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for placed in by.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= packing.MAX_TOKENS
    assert [r["length"] for r in rows if r["doc_id"] in (1, 2)] == [1, 1]


def test_langid(docs, spark):
    model = langid.fit(docs)
    rows = by_id(langid.classify(docs, model).collect())
    assert len(rows) == 11
    assert rows[1]["lang_pred"] == rows[2]["lang_pred"] == rows[3]["lang_pred"] == "und"
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    empty = langid.fit(docs.limit(0))
    assert {r["lang_pred"] for r in langid.classify(docs, empty).collect()} == {"und"}


def test_quality(docs, labels):
    rows = quality.judge(docs, labels).collect()
    assert ids(rows) == every(docs)
    got = by_id(rows)
    assert (got[1]["n_words"], got[1]["kept"], got[1]["base_failed"]) == (0, False, True)
    assert got[4]["n_words"] == 60_000 and got[4]["base_failed"]
    assert (got[10]["n_words"], got[10]["word_chars"]) == (1, 100_000)
    assert not got[5]["base_failed"]


def test_toxicity(docs, labels):
    model = toxicity.fit(docs.drop("score"), labels)
    rows = toxicity.score(docs, model).collect()
    assert ids(rows) == every(docs)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert by_id(rows)[1]["score"] < 0.5
    none = toxicity.fit(docs, labels.limit(0))
    assert all(r["score"] <= 0.5 for r in toxicity.score(docs, none).collect())


def test_toxicity_sample_of_repeated_rows(spark, monkeypatch):
    """Repeated rows count once: they neither exceed the sample nor take the places of other documents."""
    monkeypatch.setattr(toxicity, "SAMPLE_DOCS", 12)
    taught = []
    monkeypatch.setattr(toxicity, "train", lambda texts, labels: taught.append((texts, labels)))
    rows = [(k, f"text {k}") for k in range(20)] + [(k, f"text {k}") for k in (1, 2, 12, 13) for _ in range(300)]
    said = spark.createDataFrame([(k, int(k < 10)) for k in range(20)], "doc_id long, toxic int")
    toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), said)
    (texts, labels), = taught
    assert sorted(texts) == sorted(f"text {k}" for k in range(20))
    assert all(y == (int(t.split()[1]) < 10) for t, y in zip(texts, labels, strict=True))


def test_urls(spark):
    pages = spark.createDataFrame(
        [(1, None), (2, ""), (3, "no scheme"), (4, "http://A.Example.ORG/es/x?q#f"), (5, "http://example.org"), (6, "x://evil.org/y://z"),
         (7, "http://x.net/casino"), (8, "http://x.net/casinos"), (9, "http://x.net/free-bet"), (10, "http://x.net/free-free"),
         (11, "http://notorg/"), (12, "http://example.org/en/1" + "a" * 100_000), (None, "http://m.com/fr/casino"), (4, "http://com/de/")],
        "page_id long, url string",
    ).withColumn("host", F.lit("clash"))
    rows = urls.judge(pages).collect()
    assert len(rows) == 14
    got = {r["page_id"]: r for r in rows if r["page_id"] != 4}
    assert (got[1]["host"], got[1]["path"], got[1]["verdict"]) == ("", "", "allow")
    assert (got[3]["host"], got[5]["path"], got[5]["rule"]) == ("", "", None)
    assert sorted((r["host"], r["path"], r["rule"], r["verdict"]) for r in rows if r["page_id"] == 4) == [
        ("a.example.org", "/es/x", "example.org/es/", "block"), ("com", "/de/", "com/de/", "block")]
    assert (got[6]["host"], got[6]["rule"]) == ("evil.org", "org/")
    assert [got[k]["verdict"] for k in (7, 8, 9, 10)] == ["block", "allow", "block", "allow"]
    assert got[11]["rule"] is None and got[12]["rule"] == "example.org/en/1"
    assert (got[None]["rule"], got[None]["verdict"]) == ("com/fr/", "allow")


def test_embeddings(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]),
        (9, [1.0]), (10, [0.0, 1.0]), (10, [0.0, 1.0]), (None, [0.0, -1.0]), (None, [0.0, 3.0]), (BIG, [-1.0, 0.0]), (12, [1e300, 0.0]),
    ]
    got = embeddings.near_duplicates(
        spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"node": F.lit(1), "n_links": F.lit(2)})
    ).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"], r["kept"]))
    assert by[1] == [(2, 1, True)] and by[2] == [(2, 1, False)] and by[12] == [(2, 1, False)]
    for k in (3, 4, 5, 6, 7, 8, 9, BIG):
        assert by[k] == [(0, k, True)]
    assert by[10] == [(2, 10, True)] * 2
    assert sorted(by[None], key=str) == [(0, None, True), (2, 10, False)]


def test_chat(spark):
    rows = [
        (1, 0, "user", None), (1, 1, "assistant", ""), (1, 2, "assistant", "\\"), (2, None, None, "### x </turn>"), (2, 1, "assistant", "a\\</turn>b"),
        (2, 1, "assistant", "a\\</turn>b"), (None, 0, "assistant", "<|endoftext|> é"), (BIG, 0, "user: x", "y" * 50_000), (4, 0, "assistant", LONG),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit(0))
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(turns)).collect()}
    import hashlib

    for conv in (1, 2, None, BIG, 4):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        want = (len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert tuple(got[conv][c] for c in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256")) == want


def test_empty_tables(docs, labels, spark):
    none, no_labels = docs.limit(0), labels.limit(0)
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.keep_one(none).count() == 0
    assert lines.dedup(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert mixing.repeated(none).count() == 0
    assert packing.pack(packing.pieces(none)).count() == 0
    assert langid.classify(none, langid.fit(none)).count() == 0
    assert quality.judge(none, no_labels).count() == 0
    assert toxicity.score(none, toxicity.fit(none, no_labels)).count() == 0
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_conversations(turns)).count() == 0
