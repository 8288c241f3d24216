from datetime import datetime

import pytest
from pyspark.sql import functions as F

from disputatio.operators.reshape import (
    empty_results,
    has_rows,
    progress_summary,
    require_field,
    rename_project,
    strip_time_zone,
)
from disputatio.sources.collection import add_to_collection, as_entries, get_or_create, scan_collection
from disputatio.sources.corpus import read_business_records, resolve_text, scan_text_corpus
from disputatio.sources.sinks import result_path, save_results, write_fields, write_results
from disputatio.sources.tables import TEST_SCHEMA, read_evidence_set, read_few_shot, read_labelled_csv


def test_scan_text_corpus(spark, tmp_path):
    for business, name, text in [("2021", "Proceedings.txt", "<p>Ä.</p>\n<p>B.</p>"), ("2022", "Initial Situation+.txt", "x")]:
        (tmp_path / business).mkdir()
        (tmp_path / business / name).write_text(text, encoding="utf-8")
    (tmp_path / "2022" / "notes.pdf").write_text("no")
    rows = {(r["business_id"], r["filename"]): r["html"] for r in scan_text_corpus(spark, str(tmp_path)).collect()}
    assert rows == {("2021", "Proceedings.txt"): "<p>Ä.</p>\n<p>B.</p>", ("2022", "Initial Situation+.txt"): "x"}


def test_resolve_text(spark, tmp_path):
    path = tmp_path / "a.txt"
    path.write_text("<b>Hallo</b> &amp; Welt")
    assert resolve_text(spark, str(path)).first()["text"] == "Hallo & Welt"
    assert resolve_text(spark, "Nur ein Text.").first()["text"] == "Nur ein Text."
    other = tmp_path / "a.docx"
    other.write_text("x")
    with pytest.raises(ValueError):
        resolve_text(spark, str(other))


def test_business_records(spark, tmp_path):
    spark.createDataFrame([(1, "DE", "a"), (1, "FR", "b"), (2, "DE", "c")], "ID long, Language string, Text string").write.json(str(tmp_path / "r"))
    rows = read_business_records(spark, str(tmp_path / "r"), "ID long, Language string, Text string", [1])
    assert sorted(r["Text"] for r in rows.collect()) == ["a", "b"]


def test_labelled_csv(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('stance_conf,topic_DE,argument_DE,stance_label\n0.9,"Das ""T""","zwei\nZeilen",-1\nx,b,c,1\n', encoding="utf-8")
    rows = read_labelled_csv(spark, str(path), TEST_SCHEMA).collect()
    assert tuple(rows[0]) == ('Das "T"', "zwei\nZeilen", -1, 0.9)
    assert rows[1]["stance_conf"] is None
    with pytest.raises(ValueError, match="argument_EN"):
        read_labelled_csv(spark, str(path), "argument_EN string")


def test_evidence_set_and_examples(spark, tmp_path):
    df = spark.createDataFrame([("t", "m", "k", "pro")], "`Worum geht es?` string, Meinung string, Kontext string, Haltung string")
    df.write.parquet(str(tmp_path / "e.parquet"))
    df.write.csv(str(tmp_path / "e"), header=True)
    assert read_evidence_set(spark, str(tmp_path / "e.parquet")).collect() == read_evidence_set(spark, str(tmp_path / "e")).collect()
    (tmp_path / "f.json").write_text('[\n{"topic": "t", "thema": "x", "argument": "a", "label": "pro", "reasoning": "r"},\n{"topic": "u"}\n]')
    assert [r["topic"] for r in read_few_shot(spark, str(tmp_path / "f.json")).collect()] == ["t", "u"]


def test_collection_adds_only_new_ids(spark):
    def entries(texts):
        rows = [("b1", "f", i, t, t, t) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, "business string, file string, n int, new_sentence string, original_sentence string, context string")
        return as_entries(df, "business", "file", F.col("n"))

    get_or_create(spark, "sentences")
    add_to_collection(spark, "sentences", entries(["a", "b"]))
    add_to_collection(spark, "sentences", entries(["changed", "b", "c"]))
    rows = {r["id"]: r["document"] for r in spark.table("sentences").collect()}
    assert rows == {"b1-0": "a", "b1-1": "b", "b1-2": "c"}
    scanned = scan_collection(spark.table("sentences"), ["document", "metadata.url"], limit=2).collect()
    assert [r["id"] for r in scanned] == ["b1-0", "b1-1"]
    assert scanned[0]["url"].endswith("AffairId=b1")
    spark.sql("DROP TABLE sentences")


def test_write_fields(spark, tmp_path):
    df = spark.createDataFrame([("b1", "text one", "more"), ("b2", "two", None)], "business string, a string, b string")
    write_fields(df, "business", ["a", "b"], str(tmp_path / "out"))
    back = spark.read.text(str(tmp_path / "out"))
    assert {(r["business"], r["field"], r["value"]) for r in back.collect()} == {("b1", "a", "text one"), ("b1", "b", "more"), ("b2", "a", "two"), ("b2", "b", "")}
    with pytest.raises(ValueError):
        write_fields(df, "business", ["missing"], str(tmp_path / "x"))


def test_result_files(spark, tmp_path):
    at = datetime(2024, 5, 6, 7, 8, 9)
    path = result_path(str(tmp_path), business_id="1", file="P.txt", model="a/b", at=at)
    assert path == f"{tmp_path}/2024-05-06_07-08-09/argument_analysis__business_id_1__P.txt__a_b"
    df = spark.createDataFrame([('say "x",\nplease',)], "t string")
    write_results(df, path, "csv")
    assert spark.read.csv(path, header=True, multiLine=True, escape='"').collect() == df.collect()
    with pytest.raises(ValueError):
        write_results(df, path, "xlsx")
    saved = spark.read.parquet(save_results(df, str(tmp_path), 0.8, ["a", "b"], at)).first()
    assert (saved["similarity_threshold"], saved["selected_sources"]) == (0.8, "a; b")


def test_schema_checks(spark):
    df = spark.createDataFrame([(1,)], "a int").withColumn("m", F.struct(F.lit(1).alias("x")))
    require_field(df, "m", "x")
    with pytest.raises(ValueError):
        require_field(df, "m", "y")
    with pytest.raises(ValueError, match="missing"):
        rename_project(df, {"missing": "M"})


def test_time_zone_is_dropped_and_wall_clock_kept(spark):
    df = spark.sql("select timestamp'2024-01-01 10:00:00' as t, 1 as x")
    out = strip_time_zone(df)
    assert dict(out.dtypes) == {"t": "timestamp_ntz", "x": "int"}
    assert out.first()["t"] == datetime(2024, 1, 1, 10)


def test_empty_results(spark):
    df = spark.createDataFrame([(1, "a")], "a int, b string")
    assert empty_results(df).dtypes == df.dtypes and not has_rows(empty_results(df))
    assert has_rows(df) and df.count() == 1


@pytest.mark.parametrize(
    "rows,options,state",
    [
        ([("t", 2, "pro", True)], {"cancelled": True}, "exhausted"),
        ([("t", 2, "pro", False)], {"cancelled": True}, "cancelled"),
        ([("t", 9, "Neutral", False)] * 3, {}, "neutral_limit"),
        ([("t", None, None, None)], {}, "no_match"),
        ([("t", 2, "pro", False), ("t", 2, "contra", False)], {}, "complete"),
        ([("t", 5, "pro", False)], {}, "running"),
    ],
)
def test_progress_states(spark, rows, options, state):
    df = spark.createDataFrame(rows, "t string, total int, label string, last boolean")
    hit = F.col("label").isin("pro", "contra")
    got = progress_summary(df, ["t"], F.col("total"), hit, ~hit, F.col("last"), **options).first()
    assert got["state"] == state
