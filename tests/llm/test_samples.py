"""Training samples: parts from all over long texts, copies once."""

from pyspark.sql import functions as F

from milemark.llm import common, langid, toxicity


def test_spread_over_the_whole_text(spark):
    texts = ["", "ab", "x" * 100, "".join(f"{k:05d}" for k in range(2000)), "é😀" * 500, None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, text string")
    found = {r["id"]: r["s"] for r in rows.select("id", common.spread("text", "id", 100, 20).alias("s")).collect()}
    assert [found[k] for k in (0, 1, 2, 5)] == ["", "ab", "x" * 100, None]
    for k in (3, 4):
        parts = found[k].split("\n")
        assert len(parts) == 5 and all(len(p) == 20 for p in parts)
        at = [texts[k].index(p) for p in parts]
        assert at == sorted(at) and all(texts[k][a : a + 20] == p for a, p in zip(at, parts, strict=True))
    assert max(texts[3].index(p) for p in found[3].split("\n")) > 1000
    seeds = spark.range(300).withColumn("text", F.lit(texts[3])).select(common.spread("text", "id", 100, 20).alias("s"))
    places = {texts[3].index(p) // 20 for r in seeds.collect() for p in r["s"].split("\n")}
    assert len(places) > 450  # nearly all of the 500 parts, the last ones too
    assert {0, 499} & places and max(places) >= 495


def test_toxic_passage_late_in_a_long_text_teaches(spark):
    clean, nasty = "the quiet river runs past fields and small towns " * 40, "vile zorgh slur grunk "
    texts = [clean * 30 + nasty * 2000 if k % 2 else clean * (1 + k % 3) for k in range(60)]
    docs = spark.createDataFrame([(k, f"{k} {t}") for k, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    assert len(clean * 30) > toxicity.SAMPLE_CHARS
    model = toxicity.fit(docs, labels)
    asked = spark.createDataFrame([(0, clean), (1, clean * 60 + nasty), (2, nasty)], "doc_id long, text string")
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(asked, model).collect()}
    assert scores[0] < 0.5 <= min(scores[1], scores[2])


def test_copies_take_one_place_of_a_dictionary(spark):
    one = [("de", "Guten Tag zusammen, wie geht es euch heute?")] * 500
    more = [("de", f"Satz Nummer {k} steht hier") for k in range(20)]
    rows = spark.createDataFrame(one + more + [("fr", "Bonjour tout le monde")], "lang string, text string")
    content = dict(langid.fit(rows.repartition(4)).content)
    assert content["de"].count(b"guten tag zusammen") == 1 and content["de"].count(b"satz nummer") == 20
    assert langid.fit(rows.repartition(7)) == langid.fit(rows)


def test_dictionary_reads_late_parts(spark):
    text = "aaaa " * 4000 + "zebra xylophone " * 4000
    rows = spark.createDataFrame([("en", f"{text}{chr(97 + k)}") for k in range(5)], "lang string, text string")
    assert b"xylophone" in dict(langid.fit(rows).content)["en"]
