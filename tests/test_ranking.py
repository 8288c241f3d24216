import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from disputatio.operators.ranking import early_stop, running_counts, top_k, top_k_per_group
from disputatio.streaming.stateful import stop_with_state

# "hot" holds most of the rows
rows_strategy = st.lists(st.tuples(st.sampled_from(["hot", "hot", "hot", "a", "b"]), st.booleans()), min_size=1, max_size=60)


def frame(spark, rows):
    return spark.createDataFrame([(g, i, n) for i, (g, n) in enumerate(rows)], "g string, pos int, neutral boolean").repartition(5)


def stopped(rows, limit, already=None):
    seen, kept = dict(already or {}), []
    for i, (g, neutral) in enumerate(rows):
        if seen.get(g, 0) < limit:
            kept.append(i)
            seen[g] = seen.get(g, 0) + neutral
    return kept


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows_strategy, st.integers(1, 3))
def test_early_stop_equals_the_loop(spark, rows, limit):
    for two_level in (False, True):
        kept = early_stop(frame(spark, rows), ["g"], [F.col("pos")], F.col("neutral"), limit, two_level=two_level)
        assert sorted(r["pos"] for r in kept.collect()) == stopped(rows, limit)


def test_early_stop_fixture(spark):
    rows = [("t", s == "N") for s in "NPNCNPN"]
    kept = early_stop(frame(spark, rows), ["g"], [F.col("pos")], F.col("neutral"))
    assert sorted(r["pos"] for r in kept.collect()) == [0, 1, 2, 3, 4]


def test_consecutive_early_stop(spark):
    rows = [("t", s == "N") for s in "NPNNCNNNPN"]
    kept = early_stop(frame(spark, rows), ["g"], [F.col("pos")], F.col("neutral"), consecutive=True)
    assert sorted(r["pos"] for r in kept.collect()) == list(range(8))


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows_strategy)
def test_stop_with_state(spark, rows):
    counts = spark.createDataFrame([("hot", 2), ("a", 3)], "g string, neutrals int")
    kept = stop_with_state(frame(spark, rows), counts, ["g"], [F.col("pos")], F.col("neutral"), 3)
    assert sorted(r["pos"] for r in kept.collect()) == stopped(rows, 3, {"hot": 2, "a": 3})


@pytest.mark.parametrize("two_level", [False, True])
def test_top_k(spark, two_level):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id"), (F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    got = top_k_per_group(df, ["g"], [F.col("v").desc(), F.col("id")], 5, two_level=two_level).collect()
    rows = [(i % 3, i * 7919 % 1000, i) for i in range(1000)]
    want = {g: sorted((-v, i) for gg, v, i in rows if gg == g)[:5] for g in range(3)}
    for g in range(3):
        mine = sorted((r["rank"], r["id"]) for r in got if r["g"] == g)
        assert [i for _, i in mine] == [i for _, i in want[g]]
        assert [r for r, _ in mine] == list(range(5))
    assert [r["id"] for r in top_k(df, [F.col("id")], 4).collect()] == [0, 1, 2, 3]


def test_running_counts(spark):
    df = spark.createDataFrame([("r", i, s) for i, s in enumerate("pxpp")], "g string, pos int, s string")
    rows = running_counts(df, ["g"], ["pos"], [F.col("s")], F.col("s") == "p").orderBy("pos").collect()
    assert [(r["analyzed_so_far"], r["arguments_so_far"]) for r in rows] == [(1, 1), (2, 1), (3, 2), (4, 3)]


def test_running_counts_of_a_request_with_most_rows(spark):
    rows = [("hot" if i % 4 else f"g{i % 7}", i % 5 if i % 11 else None, i, i % 3 == 0 if i % 13 else None) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, part int, pos int, hit boolean").repartition(5)
    got = {r["pos"]: (r["analyzed_so_far"], r["arguments_so_far"]) for r in running_counts(df, ["g"], ["part"], [F.col("pos")], F.col("hit")).collect()}
    want, seen = {}, {}
    for g, _, pos, hit in sorted(rows, key=lambda r: (r[0], -1 if r[1] is None else r[1], r[2])):
        n, h = seen.get(g, (0, 0))
        want[pos] = seen[g] = (n + 1, h + bool(hit))
    assert got == want
