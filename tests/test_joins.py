"""Keys and joins, with splitting forced on small data and compared with plain Python."""

import re
from collections import Counter
from decimal import Decimal, localcontext

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from milemark.functions.keys import canonical_key
from milemark.operators import joins as J
from milemark.operators import skew

NUMBER = re.compile(r"[0-9]+(\.[0-9]+)?")
KEYS = [
    "964945", "964945.0", "0964945", "964945.10", "964945.1", "1-1991950", "", "12.", ".5", "0", "00", "0.0", "A12",
    " 12", "12", None, "12\n", "1" * 44, "1" * 44 + ".0",
]


def same(a, b):
    if a is None or b is None:
        return False
    if NUMBER.fullmatch(a) and NUMBER.fullmatch(b):
        with localcontext() as ctx:
            ctx.prec = 200
            return Decimal(a) == Decimal(b)
    return a == b


def canon(spark, keys):
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, k string")
    return [r.c for r in df.select("i", canonical_key(F.col("k")).alias("c")).orderBy("i").collect()]


def assert_canonical(spark, keys):
    forms = canon(spark, keys)
    for a, fa in zip(keys, forms):
        for b, fb in zip(keys, forms):
            assert same(a, b) == (fa is not None and fa == fb), (a, b)


def test_canonical_key_on_awkward_texts(spark):
    assert_canonical(spark, KEYS)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("0123.A -", max_size=6), min_size=2, max_size=25))
def test_canonical_key_on_random_texts(spark, keys):
    assert_canonical(spark, keys)


def expected_join(left, right, how):
    out = Counter()
    for i, a in left:
        hits = [(i, a, j, b) for j, b in right if same(a, b)]
        if not hits and how == "left":
            hits = [(i, a, None, None)]
        out.update(hits)
    return out


@pytest.mark.parametrize("how", ["left", "inner"])
def test_tolerant_join_with_hot_keys_on_both_sides(spark, how):
    left = [(i, "7") for i in range(40)] + [(0, "07.0")] * 30 + [(i, "") for i in range(20)] + [(i, None) for i in range(9)]
    left += [(100 + i, str(i)) for i in range(10)]
    right = [(i, "7.0") for i in range(25)] + [(1, "9")] * 15 + [(i, "") for i in range(3)] + [(1, None), (2, "x")]
    l = spark.createDataFrame(left, "i int, a string").repartition(3)
    r = spark.createDataFrame(right, "j int, b string").repartition(3)
    got = Counter(tuple(x) for x in J.tolerant_join(l, r, "a", "b", how, rows_per_split=4).collect())
    assert got == expected_join(left, right, how)


def test_join_results_do_not_depend_on_the_split(spark):
    l = spark.range(300).select((F.col("id") % 7).cast("string").alias("a"), "id")
    r = spark.range(60).select((F.col("id") % 9).cast("string").alias("b"), F.col("id").alias("rid"))
    results = [Counter(map(tuple, J.tolerant_join(l, r, "a", "b", rows_per_split=n).collect())) for n in (2, 10, 10**6)]
    assert results[0] == results[1] == results[2]


def test_lookup_and_semi_join_with_hot_and_null_keys(spark):
    left = [(i, "hot") for i in range(50)] + [(i, None) for i in range(20)] + [(i, f"k{i}") for i in range(20)]
    l = spark.createDataFrame(left, "i int, a string")
    r = spark.createDataFrame([("hot", 1), ("k3", 2), ("zz", 3)], "b string, v int")
    got = Counter(tuple(x) for x in skew.lookup_join(l, r, {"a": "b"}, 5).collect())
    known = {"hot": 1, "k3": 2}
    assert got == Counter((i, a, a if a in known else None, known.get(a)) for i, a in left)
    repeated = r.union(r).union(r)
    kept = Counter(tuple(x) for x in skew.semi_join(l, repeated, {"a": "b"}, 5).collect())
    assert kept == Counter((i, a) for i, a in left if a in known)


def test_exact_copies_of_a_hot_row_are_spread(spark):
    copies = spark.range(4000).select(F.lit("x").alias("a"), F.lit(1).alias("v")).repartition(8)
    hot = skew.hot_grid(copies, {"none": (copies.limit(0), None)}, "a", 500)
    salts = skew.spread_left(copies, "a", hot, "s").groupBy("s").count().collect()
    assert len(salts) > 1 and sum(r["count"] for r in salts) == 4000


def test_key_hot_in_a_source_of_a_chain(spark):
    """Few left rows, very many of one source: both are dealt out, and the chain gives what plain joins give."""
    left = spark.createDataFrame([(i, k) for i, k in enumerate(["7", "7", "7", "8", "9", None, ""])], "i int, k string")
    many = spark.range(1000).select(F.lit("7").alias("k"), F.col("id").alias("m")).repartition(4)
    many = many.union(spark.createDataFrame([("8", -1), ("x", -2), (None, -3)], "k string, m long"))
    texts = spark.createDataFrame([("7", "u", j) for j in range(90)] + [("7", "v", 7), ("8", "v", 8), ("9", "u", 9)], "k string, t string, n int")
    few = spark.createDataFrame([("7", "p"), ("7", "q"), ("9", "r")], "k string, w string")
    left = left.withColumn("said", F.when(F.col("i") % 2 == 0, "u").otherwise("v"))
    said = F.col("said")

    def chain(hot):
        out = skew.spread_left(left, "k", hot, "salt", said)
        for tag, df, text in (("few", few, None), ("many", many, None), ("texts", texts, F.col("t"))):
            right = skew.spread_right(df.withColumnRenamed("k", "rk"), "rk", hot, "rsalt", tag, text)
            on = (F.col("k") == F.col("rk")) & (F.col("salt") == F.col("rsalt"))
            if text is not None:
                on = on & (F.col("said") == F.col("t"))
            out = skew.matched(out.join(right, on, "left"), tag, F.col("rk").isNotNull()).drop("rk", "rsalt")
        return out

    columns = ["i", "said", "w", "m", "t", "n"]
    want = Counter(map(tuple, chain(None).select(*columns).collect()))
    assert sum(want.values()) > 90_000
    for limit in (50, 60, 2000):
        grid = skew.hot_grid(left, {"many": (many, None), "texts": (texts, "t"), "few": (few, None)}, "k", limit)
        assert Counter(map(tuple, chain(grid).select(*columns).collect())) == want
    # Without the other hot source the one with a text of its own is the owner.
    grid = skew.hot_grid(left, {"texts": (texts, "t"), "few": (few, None)}, "k", 20)
    assert [tuple(r) for r in grid.collect()] == [("7", 1, 5, "texts", "u")]
    assert Counter(map(tuple, chain(grid).select(*columns).collect())) == want
    grid = skew.hot_grid(left, {"many": (many, None)}, "k", 50)
    dealt = skew.spread_right(many, "k", grid, "salt", "many").groupBy("k", "salt").count().collect()
    assert len(dealt) > 15 and max(r["count"] for r in dealt) < 120


def every_join(left, right):
    """Each public join over the two: (a, i) and (b, j), text keys."""
    lookup = right.groupBy("b").agg(F.min("j").alias("j"))
    pair = lambda df, k: df.select(F.col(k).alias("num_convenio"), F.lit("c").alias("cod_tci"))
    return {
        "tolerant": J.tolerant_join(left, right, "a", "b"),
        "tolerant split": J.tolerant_join(left, right, "a", "b", rows_per_split=3),
        "tolerant inner": J.tolerant_join(left, right, "a", "b", "inner", rows_per_split=3),
        "first match": J.first_match(left, right, "a", "b", "j", "found"),
        "membership": J.membership_flag(left, right, "a", "b", "found"),
        "lookup": skew.lookup_join(left, lookup, {"a": "b"}),
        "lookup split": skew.lookup_join(left, lookup, {"a": "b"}, 3),
        "semi": skew.semi_join(left, right, {"a": "b"}),
        "restrict": J.restrict_previous(pair(left, "a"), pair(right, "b")),
    }


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_joins_on_empty_and_all_null_sides(spark, adaptive):
    some = [(str(k % 3), k) for k in range(9)]
    sides = {"some": some, "empty": [], "null": [(None, k) for k in range(5)]}
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        for l, left in sides.items():
            for r, right in sides.items():
                frames = every_join(spark.createDataFrame(left, "a string, i int"), spark.createDataFrame(right, "b string, j int"))
                got = {name: df.count() for name, df in frames.items()}
                hits = 9 if l == r == "some" else 0
                many = 27 if hits else len(left)
                assert got == {
                    "tolerant": many, "tolerant split": many, "tolerant inner": 3 * hits, "first match": len(left),
                    "membership": len(left), "lookup": len(left), "lookup split": len(left), "semi": hits,
                    "restrict": 5 if l == r == "null" else hits,
                }, (l, r)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("how", ["tolerant", "lookup"])
def test_missing_keys_are_spread(spark, how):
    left = spark.range(40_000).select(F.when(F.col("id") % 10 == 0, F.col("id").cast("string")).alias("a"), "id")
    right = spark.range(2_000).select((F.col("id") * 10).cast("string").alias("b"), F.col("id").alias("j"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    for k, v in zip(old, ("-1", "false", "16"), strict=True):
        spark.conf.set(k, v)
    try:
        joined = J.tolerant_join(left, right, "a", "b") if how == "tolerant" else skew.lookup_join(left, right, {"a": "b"})
        rows = [r["n"] for r in joined.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert sum(rows) == 40_000 and len(rows) == 16 and max(rows) < 2 * 40_000 / 16
        assert joined.where("a is null").count() == 36_000 and joined.where("b is not null").count() == 2_000
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_blank_keys_as_missing(spark):
    left, right = spark.createDataFrame([("", 1), (" ", 2), ("7", 3)], "a string, i int"), spark.createDataFrame([("", 1), ("07", 2)], "b string, j int")
    assert J.tolerant_join(left, right, "a", "b", "inner").count() == 2
    assert [r.i for r in J.tolerant_join(left, right, "a", "b", "inner", blank_is_missing=True).collect()] == [3]


@pytest.mark.parametrize("bad", [[("1", "x"), (None, "y")], [("1", "x"), ("1 ", "y")]])
def test_snapshot_matches_refuse_missing_and_repeated_keys(spark, bad):
    from pyspark.errors import PySparkException

    good = spark.createDataFrame([("1", "x")], "num_convenio string, v string")
    df = spark.createDataFrame(bad, "num_convenio string, v string")
    for a, b in ((good, df), (df, good)):
        with pytest.raises(PySparkException, match="snapshot"):
            J.match_snapshots(a, b, ["num_convenio"]).collect()


def test_first_match_takes_the_smallest(spark):
    docs = spark.createDataFrame([("12",), ("13",), (None,)], "instrumento string")
    saci = spark.createDataFrame([("012", "b"), ("12.0", "a"), ("14", "c")], "num_convenio string, cod_tci string")
    got = {r.instrumento: r.cod for r in J.first_match(docs, saci, "instrumento", "num_convenio", "cod_tci", "cod").collect()}
    assert got == {"12": "a", "13": None, None: None}


def test_key_check(spark):
    df = spark.createDataFrame([("1", "a"), ("1 ", "b"), ("", "c"), (None, " ")], "num_convenio string, cod_tci string")
    names = ["num_convenio", "cod_tci"]
    row = J.key_report(df, names, "x").first()
    assert (row.sem_chave, row.chaves_duplicadas, row.exemplos) == (1, 1, "1")
    with pytest.raises(ValueError, match="1 rows without a key"):
        J.check_keys(df, names, "x")
    with pytest.raises(ValueError, match="duplicated keys: 1"):
        J.check_keys(df.where("num_convenio is not null"), names, "x")
    J.check_keys(df.where("num_convenio = ''"), names, "x")


def test_restrict_previous_blank_equals_null(spark):
    prev = spark.createDataFrame([("", "a", 1), (None, "b", 2), ("3", "c", 3)], "num_convenio string, cod_tci string, v int")
    cur = spark.createDataFrame([(None, "a"), ("", "b"), ("3", "x")], "num_convenio string, cod_tci string")
    assert sorted(r.v for r in J.restrict_previous(prev, cur).collect()) == [1, 2]


def test_blank_keys_are_dealt_out_without_counting(spark):
    left = spark.range(2000).select("id", F.lit("").alias("a"))
    right = spark.createDataFrame([("", 1), ("", 2), ("7", 3)], "b string, v int")
    joined = J.tolerant_join(left, right, "a", "b")
    assert joined.count() == 4000 and joined.where("a = b").select("id", "v").distinct().count() == 4000
    keyed = left.select("id", F.lit("t:").alias("k"))
    dealt = skew.spread_left(keyed, "k", None, "s").groupBy("s").count().collect()
    assert len(dealt) == skew.BLANK_PARTS and max(r["count"] for r in dealt) < 60
    sides = spark.createDataFrame([("t:", 1), ("n:7.", 2), (None, 3)], "k string, v int")
    assert skew.spread_right(sides, "k", None, "s").count() == skew.BLANK_PARTS + 1


def test_a_key_hot_on_both_sides_has_a_bounded_grid(spark):
    rows = spark.range(600).select(F.lit("t:").alias("k"))
    grid = skew.hot_grid(rows, {"s": (rows, None)}, "k", 3).collect()
    assert [(r["splits"], r["parts"]) for r in grid] == [(skew.GRID_PIECES, skew.GRID_PIECES)]
    alone = skew.hot_grid(rows, {"s": (rows.limit(0), None)}, "k", 3).collect()
    assert [(r["splits"], r["parts"]) for r in alone] == [(200, 1)]


def test_a_long_list_of_hot_keys_is_not_broadcast(spark):
    rows = spark.range(100).select(F.col("id").cast("string").alias("k"))
    plan = lambda n: skew._with_splits(rows, "k", skew.hot_keys(rows, "k", n), "s", n)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(10**6) and "strategy=broadcast" not in plan(3)
