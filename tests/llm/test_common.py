"""Saved frames: what a scratch block deletes and keeps; rows told apart."""

import os

from disputatio.llm.common import identified, saved, scratch


def folder(df):
    return os.path.dirname(df.inputFiles()[0].removeprefix("file://"))


def test_scratch_deletes_what_it_does_not_keep(spark):
    rows = spark.range(5)
    outside = saved(rows, "outside")
    with scratch(spark):
        gone = folder(saved(rows, "gone"))
        with scratch(spark):
            inner = folder(saved(rows, "inner"))
            middle = saved(rows, "middle", keep=True)
        kept = saved(rows, "kept", keep=True)
        assert not os.path.exists(inner) and middle.count() == 5
        middle = folder(middle)
    assert not os.path.exists(gone) and not os.path.exists(middle)
    assert kept.count() == outside.count() == 5


def test_rows_are_told_apart_alike_in_every_plan(spark):
    df = spark.createDataFrame([(None, "x"), (None, "x"), (1, "y")], "doc_id long, text string").repartition(3)
    rows = identified(df, "_row")
    assert rows.select("_row").distinct().count() == 3
    assert rows.select("_row").join(rows, "_row").count() == 3
    assert identified(saved(df, "again"), "_row").columns == ["doc_id", "text", "_row"]
