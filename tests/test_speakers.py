"""Who speaks: mentions before a sentence, carried through a document, into the argument rows."""

import time

from pyspark.sql import functions as F

from disputatio.functions.parsing import mention_fields, mentions_carried, speaker
from disputatio.functions.text import split_sentences
from disputatio.operators.stance import CueRule
from disputatio.plans.mining import MiningOptions, build_collection, find_arguments, prepare_topics

ANNA, BO = "Anna Muster (G, ZH)", "Bo Beispiel (M-E, BE)"
TEXT = f"Beginn ohne Namen. {ANNA} sagt etwas. Das finde ich richtig. Noch ein Satz. {BO} widerspricht. Es bleibt dabei."


def test_a_later_mention_does_not_count(spark):
    rows = [
        ("Das finde ich richtig.", TEXT, "Anna Muster"),
        ("Beginn ohne Namen.", TEXT, ""),
        ("Es bleibt dabei.", TEXT, "Bo Beispiel"),
        (f"{BO} widerspricht.", TEXT, "Bo Beispiel"),
        ("Nicht im Text.", TEXT, "Bo Beispiel"),
        ("Satz.", None, ""),
        (None, TEXT, ""),
    ]
    df = spark.createDataFrame(rows, "sentence string, context string, want string")
    got = df.withColumn("who", speaker(F.col("sentence"), F.col("context"))).collect()
    assert [r.who.person for r in got[:6]] == [r.want for r in got[:6]]
    assert got[6].who.person in ("", "Bo Beispiel")


def test_mentions_are_carried_through_the_document(spark):
    df = spark.createDataFrame([(TEXT,), ("Niemand. Keiner.",), ("",), (None,)], "text string")
    rows = df.select(F.transform(mentions_carried(split_sentences(F.col("text"))), lambda m: mention_fields(m)["canton"]).alias("cantons")).collect()
    assert [r.cantons for r in rows] == [["", "ZH", "ZH", "ZH", "BE", "BE"], ["", ""], [], None]


def test_mentions_of_a_long_document_are_searched_once(spark):
    """Four times the sentences do not take sixteen times as long, as they would if each searched all of them anew."""

    def seconds(n):
        text = " ".join(f"{ANNA if i % 1000 else BO} sagt etwas." if i % 500 == 0 else "Das Alte Haus Und Der Neue Wald stehen dort." for i in range(n))
        df = spark.createDataFrame([(text,)], "text string").select(mentions_carried(split_sentences(F.col("text"))).alias("m"))
        started = time.time()
        (row,) = df.collect()
        assert row.m == [(ANNA if i // 500 % 2 else BO) for i in range(n)]
        return time.time() - started

    seconds(10)
    assert seconds(6000) < 6 * seconds(1500) + 2


def test_argument_rows_name_the_speaker_far_behind(spark):
    cues = CueRule({"de": ["für"]}, {"de": ["gegen"]})
    filler = " ".join(f"Satz {chr(97 + i)} steht hier." for i in range(12))
    docs = [(1, "s", f"{ANNA} beginnt. {filler} Wir sind für das neue Waldgesetz. {BO} folgt.", "de")]
    collection = build_collection(spark.createDataFrame(docs, "doc_id long, source string, text string, lang string"), ["doc_id", "source"], "text", "lang", html=False, method=None, speakers=True)
    topics = prepare_topics(spark.createDataFrame([(1, "Das neue Waldgesetz.")], "request long, text string"), "request", "text", method=None)
    options = MiningOptions(similarity_threshold=0.4, stance=cues, cues=cues)
    (row,) = find_arguments(topics, collection, ["doc_id", "sent_id"], "source", "doc_id", options).collect()
    assert (row.label, row.person, row.canton) == ("pro", "Anna Muster", "ZH")
