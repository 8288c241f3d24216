"""Labelled CSV with rejects: nothing gets lost, and files without line breaks in fields are split."""

import json

import pytest
from pyspark.sql import functions as F

from disputatio.sources.tables import TEST_SCHEMA, has_line_breaks, read_checked_csv

HEADER = "stance_conf,topic_DE,argument_DE,stance_label\n"


@pytest.mark.parametrize("broken", [False, True])
def test_rejects_name_what_does_not_fit(spark, tmp_path, broken):
    text = "zwei\nZeilen" if broken else "eine Zeile"
    (tmp_path / "t.csv").write_text(HEADER + f'0.9,"Das ""T""","{text}",-1\nx,b,c,1\n,d,,\n0.5,e,f\n0.5,g,h,1,zu viel\nn,i,j,k\n', encoding="utf-8")
    path = str(tmp_path / "t.csv")
    assert has_line_breaks(spark, path) is broken
    found = read_checked_csv(spark, path, TEST_SCHEMA)
    assert sorted((tuple(r) for r in found.rows.collect()), key=str) == sorted([('Das "T"', text, -1, 0.9), ("d", None, None, None)], key=str)
    rejects = {tuple(r.reasons): r.record for r in found.rejects.collect() if "number of fields" not in r.reasons}
    assert json.loads(rejects[("stance_conf",)])["stance_conf"] == "x"
    assert json.loads(rejects[("stance_label", "stance_conf")])["topic_DE"] == "i"
    torn = sorted(r.record for r in found.rejects.collect() if "number of fields" in r.reasons)
    assert torn == ["0.5,e,f", "0.5,g,h,1,zu viel"]


def test_lines_without_breaks_are_read_by_many_tasks(spark, tmp_path):
    df = spark.range(20000).select(F.lit(0.5).alias("stance_conf"), F.concat(F.lit("t, "), "id").alias("topic_DE"), F.md5(F.col("id").cast("string")).alias("argument_DE"), F.lit(1).alias("stance_label"))
    df.coalesce(1).write.csv(str(tmp_path / "t"), header=True, escape='"')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128k")
    try:
        found = read_checked_csv(spark, str(tmp_path / "t"), TEST_SCHEMA)
        assert found.rows.rdd.getNumPartitions() > 3
        assert found.rows.count() == 20000 and found.rejects.isEmpty()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_missing_columns_are_an_error(spark, tmp_path):
    (tmp_path / "t.csv").write_text(HEADER, encoding="utf-8")
    with pytest.raises(ValueError, match="argument_EN"):
        read_checked_csv(spark, str(tmp_path / "t.csv"), "argument_EN string")
    assert read_checked_csv(spark, str(tmp_path / "t.csv"), TEST_SCHEMA).rows.isEmpty()
