"""The inverted table gives the rows of the plain search, before and after updates, and reads few parts."""

import random

import pytest
from pyspark.sql import functions as F

from milemark.operators import explore
from milemark.sources import textindex
from milemark.operators.diff import diff_history
from milemark.sources.store import merge
from milemark.sources.textindex import TextIndex, folded, logged_keys

TEXTS = [
    "Prefeitura de São João", "PREFEITURA DE SAO JOAO", "pré-moldado 112/2024", "obra-12 x12 12x", "", None, "  ", "a.b+c (d)",
    "ΟΔΟΣ οδος οδοσ", "straße STRASSE ẞ", "İstanbul ısı I i", "😀emoji a😀b", "-x --y z-", "1" * 300 + "2", "q\u00a0nbsp\u2003em",
    "linha\nnova\tprefácio", "w" * 60 + "fim", "w" * 60 + "outro",
]
QUERIES = [
    "PREFEITURA", "sao", "12", "2024", "x12", "x", "-x", "--y", "b+c", "(d", "οδος", "ΟΔΟΣ",
    "straße", "strasse", "ẞ", "istanbul", "İ", "ı", "😀b", "1" * 100, "1" * 50 + "2", "em",
    "nova pref", "w" * 60 + "f", "zzz", "", "joão são pref", "\\E", "pré-m",
]


def table(spark, texts):
    rows = [(str(k) if k % 7 else None, f"c{k}" if k % 2 else None, t, t and t[::-1]) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "num_convenio string, cod_tci string, a string, b string")


def found(df):
    return sorted(map(str, df.collect()))


def test_same_rows_as_the_plain_search(spark, tmp_path):
    df = table(spark, TEXTS).cache()
    index = TextIndex(spark, str(tmp_path), ["a", "b"], rows_per_part=40)
    index.build(df)
    for query in QUERIES:
        assert found(index.search(df, query)) == found(explore.text_search(df, ["a", "b"], query)), query
    with pytest.raises(ValueError):
        index.build(df)


def test_updates(spark, tmp_path):
    rng = random.Random(3)
    words = ["norte", "norma", "sul", "sudeste", "12", "125", "x-norte", "leste"]
    state = {str(k): " ".join(rng.choices(words, k=3)) for k in range(40)}
    make = lambda: spark.createDataFrame(sorted(state.items()), "num_convenio string, a string")
    index = TextIndex(spark, str(tmp_path), ["a"], rows_per_part=30)
    index.build(make())
    for _ in range(3):
        changed = rng.sample(sorted(state), 6)
        for key in changed[:4]:
            state[key] = " ".join(rng.choices(words, k=3))
        del state[changed[4]]
        state[f"9{changed[5]}"] = "novo norte"
        changed.append(f"9{changed[5]}")
        index.update(make(), spark.createDataFrame([(k,) for k in changed], "k string"))
        for query in ("nor", "sul 12", "125", "novo", "leste su"):
            assert found(index.search(make(), query)) == found(explore.text_search(make(), ["a"], query))
    # Nothing but the words of the records still there is valid.
    kept = {r["registro"] for r in index.records("n").collect()}
    assert kept == {k for k, t in state.items() if any(w.startswith("n") for w in t.replace("-", "_").split())}


def test_updates_from_the_change_log(spark, tmp_path):
    days = [
        [("1", "Norte"), ("2", "Sul"), ("3", "Leste")],
        [("1", "Norte"), ("2", "Sudeste"), ("4", "Norma")],
    ]
    frames = {f"2026-01-0{k + 1}": spark.createDataFrame(d, "num_convenio string, txt_municipio_saci string") for k, d in enumerate(days)}
    index = TextIndex(spark, str(tmp_path), ["num_convenio", "txt_municipio_saci"])
    index.build(frames["2026-01-01"])
    keys = logged_keys(diff_history(*merge(frames)))
    assert sorted(r["registro"] for r in keys.collect()) == ["2", "3", "4"]
    now = frames["2026-01-02"]
    index.update(now, keys)
    for query in ("n", "su", "leste", "4", "3"):
        assert found(index.search(now, query)) == found(explore.text_search(now, index.columns, query))


def test_few_parts_are_read(spark, tmp_path):
    df = spark.range(4000).select(
        F.col("id").cast("string").alias("num_convenio"), F.concat(F.lit("comum w"), F.col("id").cast("string")).alias("a")
    )
    index = TextIndex(spark, str(tmp_path), ["a"], rows_per_part=400)
    index.build(df)
    files = lambda d: len(d.inputFiles())
    every = files(spark.read.parquet(index.words_path + "/*"))
    assert every >= 20
    # A rare word lies in one or two parts, one in each row in as many as its rows fill.
    assert files(index.entries("w1234")) <= 2 and 8 <= files(index.entries("comum")) <= 13
    assert index.entries("zz").count() == 0
    assert [r["num_convenio"] for r in index.search(df, "comum w1234").collect()] == ["1234"]


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "num_convenio string, a string")
    index = TextIndex(spark, str(tmp_path), ["a"])
    with pytest.raises(ValueError):
        index.update(none, none)
    index.build(none)
    assert index.search(none, "a").count() == 0
    some = spark.createDataFrame([("1", "abc"), (None, "abd")], "num_convenio string, a string")
    index.update(some, some.select("num_convenio"))
    assert index.search(some, "ab").count() == 2 and index.search(some, "abd").count() == 1


def test_fold_is_at_least_as_wide_as_the_search(spark):
    """Any two characters that the search takes for each other fold alike."""
    chars = [chr(c) for c in range(1, 0x2100) if chr(c).isalpha()] + [chr(0x1E9E), chr(0x212A), chr(0x212B)]
    df = spark.createDataFrame([(c,) for c in chars], "c string").withColumn("f", folded(F.col("c")))
    near = F.expr("array(c, upper(c), lower(c), upper(lower(c)), lower(upper(c)))")
    pairs = df.withColumn("d", F.explode(near)).where("length(d) = 1")
    alike = pairs.where(F.expr("c rlike concat('(?iu)^', d, '$')"))
    assert alike.count() > 5000
    assert alike.where(F.col("f") != folded(F.col("d"))).count() == 0


def test_parts_are_bounded(spark, tmp_path, monkeypatch):
    """Small parts grow where they would be too many, and none beyond a full one; the rows found are the same."""
    monkeypatch.setattr(textindex, "MOST_PARTS", 6)
    df = table(spark, TEXTS * 20).coalesce(1).cache()
    index = TextIndex(spark, str(tmp_path), ["a", "b"], rows_per_part=10)
    index.build(df)
    words = spark.read.parquet(f"{index.words_path}/*")
    assert words.count() > 2000 and 3 <= words.select("parte").distinct().count() <= 6
    # The words are found once, in several tasks though the rows lay in one; the sample and the exchange read what was written.
    staged = spark.read.parquet(f"{index.found_path}/*")
    assert staged.count() == words.count() and len(staged.inputFiles()) > 1
    for query in ("sao", "12", "straße", "w" * 60 + "f"):
        assert found(index.search(df, query)) == found(explore.text_search(df, ["a", "b"], query)), query
    assert textindex.part_count(10**12, 20_000) == 10**12 // textindex.FULL_PART and textindex.part_count(0, 9) == 1


def test_ascii_words_fold_without_lookups(spark):
    df = spark.createDataFrame([(w,) for w in ["ABC-12x", "", "ÁB", "ΟΔΟΣ", None, "ẞx", "ISTANBUL İ"]], "w string")
    assert [r[0] for r in df.select(folded(F.col("w"))).collect()] == ["abc-12x", "", "áb", "οδοσ", None, "ssx", "istanbul i"]
