"""Readers, writers, type inference, table loads and the snapshot store."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from milemark import config as C
from milemark.operators import diff as D
from milemark.sources import files, naming, tables
from milemark.sources.store import SnapshotStore

AWKWARD = [("a;b", 'say "x"', None), ("line\nbreak", "", "é"), ("", "\\back", " pad ")]


def only_file(path, suffix):
    return next(p for p in path.iterdir() if p.suffix == suffix)


def test_quoted_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame(AWKWARD, "x string, y string, z string")
    files.write_quoted_csv(df, str(tmp_path / "o"))
    back = files.read_snapshot(spark, str(tmp_path / "o"))
    assert sorted(map(tuple, back.collect())) == sorted(tuple(v or "" for v in r) for r in AWKWARD)
    df.coalesce(1).limit(1).transform(lambda d: files.write_quoted_csv(d, str(tmp_path / "one")) or d)
    text = only_file(tmp_path / "one", ".csv").read_text(encoding="utf-8")
    assert text.splitlines()[0].replace('"', "") == "x;y;z" and text.splitlines()[1] == '"a;b";"say ""x""";""'


@pytest.mark.parametrize(("sep", "encoding"), [(",", "utf-8"), (";", "latin-1"), ("\t", "utf-8"), ("|", "latin-1")])
def test_csv_separator_and_encoding_are_found(spark, tmp_path, sep, encoding):
    path = tmp_path / "f.csv"
    path.write_bytes(sep.join(["código", '"a,b"', "c"]).encode(encoding) + b"\n" + sep.join(["ção", "2", "003"]).encode(encoding) + b"\n")
    df = files.read_csv_any(spark, str(path))
    assert df.columns == ["código", "a,b", "c"] and tuple(df.first()) == ("ção", "2", "003")


def test_unknown_file_type(spark):
    with pytest.raises(ValueError, match="unsupported"):
        files.read_any(spark, "x.xlsx")


@pytest.mark.parametrize(
    ("name", "slug"),
    [("Situação da Obra (%)", "situacao_da_obra"), ("  A - B  ", "a_b"), ("já_é ok", "ja_e_ok"), ("X.Y/Z", "xyz"), (12, "12")],
)
def test_slug(name, slug):
    assert naming.slug(name) == slug


def test_type_inference(spark):
    rows = [
        ("1.234,50", "1", "1.5", "31/01/2026", "007", "a", None, "1"),
        ("2,00", "2", "x", "2026-02-01", "008", "1", None, "2.5"),
        (None, None, None, "1/2/2026 10:00", None, None, None, "1e3"),
    ]
    names = ["money", "n", "mixed", "day", "operacao_nu", "text", "empty", "real"]
    df = naming.infer_types(spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names)))
    assert dict(df.dtypes) == {
        "money": "double", "n": "bigint", "mixed": "string", "day": "date", "operacao_nu": "string", "text": "string",
        "empty": "string", "real": "double",
    }
    got = df.collect()
    assert got[0].money == 1234.5 and [r.day for r in got] == [dt.date(2026, 1, 31), dt.date(2026, 2, 1), dt.date(2026, 2, 1)]
    assert got[0].operacao_nu == "007"


@pytest.mark.parametrize("first", [True, False])
def test_type_inference_is_all_or_nothing_whatever_the_order(spark, first):
    late = [("1",)] * 150 + [("3,5",)]
    late = late[::-1] if first else late
    assert dict(naming.infer_types(spark.createDataFrame(late, "v string").coalesce(1)).dtypes) == {"v": "double"}
    days = [(None,)] * 150 + [("31/1/2026",)]
    assert dict(naming.infer_types(spark.createDataFrame(days, "v string").coalesce(1)).dtypes) == {"v": "date"}
    broken = [("3,5",), ("abc",)]
    df = naming.infer_types(spark.createDataFrame(broken, "v string"))
    assert sorted(r.v for r in df.collect()) == ["3,5", "abc"]


def test_load_modes(spark):
    at = dt.datetime(2026, 6, 1, 10)
    first = tables.prepare(spark.createDataFrame([("1", "a")], "`N.` string, nome string"), at)
    assert first.columns == ["n", "nome", "dte_carga"]
    tables.load_table(first, "loads")
    tables.load_table(spark.createDataFrame([("b", 2)], "nome string, n bigint"), "loads", "append")
    got = sorted(map(tuple, spark.table("loads").collect()))
    assert got == [(1, "a", dt.date(2026, 6, 1)), (2, "b", None)]
    tables.load_table(spark.createDataFrame([(3, "c")], "n bigint, nome string"), "loads", "replace")
    assert [tuple(r) for r in spark.table("loads").collect()] == [(3, "c", None)]
    with pytest.raises(ValueError, match="no columns"):
        tables.load_table(spark.createDataFrame([(3,)], "outra bigint"), "loads", "append")
    with pytest.raises(ValueError, match="invalid load mode"):
        tables.load_table(first, "loads", "merge")


def test_one_source_feeds_several_tables_and_failures_do_not_stop(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("kind;v\na;1\nb;2\n", encoding="utf-8")
    pick = lambda k: (lambda df: df.where(F.col("kind") == k))
    specs = [
        tables.LoadSpec(str(path), "part_a", pick("a")), tables.LoadSpec(str(tmp_path / "none.csv"), "missing"),
        tables.LoadSpec(str(path), "part_b", pick("b")),
    ]
    failures = tables.load_many(spark, specs)
    assert list(failures) == ["missing"]
    assert [spark.table(t).first().v for t in ("part_a", "part_b")] == [1, 2]


def test_snapshot_store(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    assert store.days() == [] and store.oldest() is None and store.previous("2026-01-01") is None
    one = spark.createDataFrame([("1", "x")], "num_convenio_saci string, fase_atual_calc string")
    store.write(one, "2026-01-02")
    assert [tuple(r) for r in store.previous_or_current("2026-01-02").collect()] == [("1", "x")]
    store.write(one.withColumn("extra", F.lit("e")), "2026-01-05")
    store.write(one.withColumn("fase_atual_calc", F.lit("y")), "2026-01-02")
    assert store.days() == ["2026-01-02", "2026-01-05"] and store.oldest() == "2026-01-02"
    assert store.at("2026-01-02").first().fase_atual_calc == "y" and store.at("2026-01-02").count() == 1
    assert store.previous("2026-01-02") == "2026-01-05" and store.previous("2026-01-02", strict=True) is None
    rows, headers = store.history()
    assert headers["2026-01-05"][-1] == "extra"
    log = D.change_log(D.diff_history(rows, headers)).collect()
    assert [(r.data, r.campo, r.valor_anterior, r.valor_atual) for r in log] == [("2026-01-05", "fase_atual_calc", "y", "x")]


def test_summary_json_and_report(spark, tmp_path):
    cols = "num_convenio_saci string, cod_tci_saci string, vlr_repasse_saci string, fase_atual_calc string"
    prev = spark.createDataFrame([("1", "a", "5", "LAE"), ("2", "b", "5", "LAE")], cols)
    cur = spark.createDataFrame([("1", "a", "6", "AIO"), ("3", "c", "5", "LAE")], cols)
    summary = D.diff_summary(prev, cur, {"atual": "2026-01-02", "anterior": "2026-01-01", "primeiro": "2026-01-01"})
    files.write_summary_json(summary, str(tmp_path / "j"))
    doc = json.loads(only_file(tmp_path / "j", ".json").read_text(encoding="utf-8"))
    assert doc["resumo"] == {"entered": 1, "exited": 1, "changed_records": 1, "changed_data_records": 1, "changed_time_records": 0}
    assert doc["delta_total"] == 0 and doc["mudancas_status"]["fase_atual_calc"] == 1
    files.write_report(summary, str(tmp_path / "r"))
    lines = only_file(tmp_path / "r", ".txt").read_text(encoding="utf-8").splitlines()
    assert lines[:10] == [
        "# Diferença da base - 2026-01-02", "", "- Snapshot atual: `2026-01-02`", "- Snapshot anterior: `2026-01-01`",
        "- Total anterior: **2**", "- Total atual: **2**", "", "## Resumo", "", "- Entraram na base: **1**",
    ]
    assert "- `fase_atual_calc`: **1**" in lines and lines[-6:-3] == ["", "## Leitura recomendada", ""]
    files.write_summary_json(D.diff_summary(None, cur, {"atual": "d", "primeiro": "d"}), str(tmp_path / "f"))
    first = json.loads(only_file(tmp_path / "f", ".json").read_text(encoding="utf-8"))
    assert first["snapshot_anterior"] is None and first["resumo"] is None and first["total_atual"] == 2


def test_choose_and_rename(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert naming.choose(df, ["c", "a", "b"], {"a": "A"}, default=["a", "c"]).columns == ["c", "A"]
    sheet = spark.createDataFrame([("x", "01/02/26 ")], "UF string, `DATA DA ASSINATURA` string")
    out = naming.rename(sheet, C.LEGACY_COLUMNS)
    assert out.columns == list(C.LEGACY_COLUMNS.values()) and out.first().uf == "x" and out.first().objeto == ""


def test_quoted_breaks_are_found(spark, tmp_path):
    one, two = tmp_path / "one.csv", tmp_path / "two.csv"
    one.write_text('\n' * 12 + 'a;b\n"x ""y""";2\n', encoding="utf-8")
    two.write_text('a;b\n"x\ny";2\n', encoding="utf-8")
    assert not files.has_quoted_breaks(spark, str(one)) and files.has_quoted_breaks(spark, str(two))
    assert [tuple(r) for r in files.read_csv_any(spark, str(one)).collect()] == [('x "y"', "2")]
    assert [tuple(r) for r in files.read_csv_any(spark, str(two)).collect()] == [("x\ny", "2")]
