"""End-to-end jobs: against brute force on small frames, as streams, and by the shape of their plans."""

import math
import re
from collections import Counter

import pytest
from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F

from disputatio.functions.prompts import PROMPTS
from disputatio.operators.context import prepare_sentences
from disputatio.operators.generation import batch_generate, rewrite_sentences
from disputatio.operators.ml import embed_hashed, embed_with, predict, train_stance_classifier
from disputatio.operators.ranking import top_k_per_group
from disputatio.operators.stance import CueRule, stance_from_generation
from disputatio.plans.mining import MiningOptions, build_collection, find_arguments, mine_corpus, prepare_topics, read_hits, search, stop_early
from disputatio.session import checkpointed, work_dir
from disputatio.streaming.incremental import ProgressListener, cancel, observed, start_append, stream_matches, stream_table
from disputatio.streaming.stateful import start_early_stop

CUES = CueRule({"en": ["for"]}, {"en": ["against"]})
OPTIONS = MiningOptions(similarity_threshold=0.3, stance=CUES, cues=CUES)
DOCS = [
    (1, "s1", "We speak for the new forest law. The old forest law fails. Against the forest law stand many."),
    (2, "s2", "The forest law is long. A forest law can wait. New forest law texts came. Nobody reads the forest law."),
    (3, "s2", "Bread is good."),
]


def inputs(spark, requests):
    docs = spark.createDataFrame([(*d, "en") for d in DOCS], "doc_id long, source string, text string, lang string")
    asked = spark.createDataFrame(requests, "request long, text string")
    collection = build_collection(docs, ["doc_id", "source"], "text", "lang", html=False, method=None)
    return prepare_topics(asked, "request", "text", method=None), collection


def test_copies_of_a_topic_share_their_counter(spark):
    requests = [(1, "The new forest law. The new forest law. The new forest law."), (2, "The new forest law."), (3, "Bread is good. Bread is good.")]
    topics, collection = inputs(spark, requests)
    rows = find_arguments(topics, collection, ["doc_id", "sent_id"], "source", "doc_id", OPTIONS).collect()

    hits = search(topics, collection.select("doc_id", "sent_id", "new_sentence"), ["doc_id", "sent_id"], OPTIONS, 1000, False)
    by_text = {}
    for r in sorted(hits.collect(), key=lambda r: r["rank"]):
        by_text.setdefault(r["topic_rewritten"], []).append(r)
    want = []
    for request, text in requests:
        seen = {}
        for pos, topic in enumerate(t.strip() + "." for t in text.split(".") if t.strip()):
            for hit in by_text.get(topic, []):
                if seen.get(topic, 0) < 3:
                    words = hit["new_sentence"].lower().replace(".", "").split()
                    stance = "pro" if "for" in words else "contra" if "against" in words else "Neutral"
                    seen[topic] = seen.get(topic, 0) + (stance == "Neutral")
                    want.append((request, pos, hit["rank"], stance, seen[topic]))
    got = [(r["request_id"], r["topic_pos"], r["num_arguments_analyzed"], r["label"], r["analysis_status"]) for r in rows]
    assert sorted(got) == sorted(want)
    assert any(s == "pro" for *_, s, _ in want) and any(p > 0 for _, p, *_ in want)
    one = next(r for r in rows if r["label"] == "pro")
    assert one["reasoning_segment"] and one["model_name"] == "cue-rule" and one["argument_reason"] == "1.0"


def test_source_filter_keeps_rank_and_matches(spark):
    topics, collection = inputs(spark, [(1, "The new forest law.")])
    every = find_arguments(topics, collection, ["doc_id", "sent_id"], "source", "doc_id", OPTIONS)
    some = find_arguments(
        topics, collection, ["doc_id", "sent_id"], "source", "doc_id", MiningOptions(similarity_threshold=0.3, stance=CUES, cues=CUES, sources=["s1"])
    )
    total = every.first()["num_matches"]
    rows = some.collect()
    assert {r["business_id"] for r in rows} == {"s1"} and {r["num_matches"] for r in rows} == {total}


def test_costly_classifier_sees_only_gated_hits(spark):
    topics, collection = inputs(spark, [(1, "The new forest law.")])

    def classifier(hits):
        said = F.when(F.col("_stance.label") == "Pro", "Contra").otherwise("Neutral")
        return hits.withColumn("_stance", F.struct(said.alias("label"), F.lit(None).cast("double").alias("score"), F.lit("x").alias("model_generation")))

    options = MiningOptions(similarity_threshold=0.3, stance=CUES, cues=CUES, precheck=True, classifier=classifier)
    rows = find_arguments(topics, collection, ["doc_id", "sent_id"], "source", "doc_id", options).collect()
    assert {r["label"] for r in rows} == {"contra", "neutral"}


def test_waves_call_the_classifier_less_and_find_the_same(spark, tmp_path):
    """Sixty equal hits per topic: one that is always neutral, one that never is."""
    docs = [(i, "s", f"forest law number {chr(97 + i // 26)}{chr(97 + i % 26)}", "en") for i in range(60)]
    docs += [(100 + i, "s", f"for bread tax value {chr(97 + i // 26)}{chr(97 + i % 26)}", "en") for i in range(60)]
    asked = spark.createDataFrame([(1, "Forest law number. Forest law number. Bread tax value.")], "request long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, source string, text string, lang string")
    collection = build_collection(frame, ["doc_id", "source"], "text", "lang", html=False, method=None)
    topics = prepare_topics(asked, "request", "text", method=None)
    calls = str(tmp_path / "calls")

    def model():
        def answer(prompts):
            with open(calls, "a") as f:
                f.writelines(p + "\n" for p in prompts)
            return prompts.map(lambda p: "Pro" if "for " in p else "Neutral")

        return answer

    def classifier(hits):
        answered = batch_generate(hits.withColumn("_p", F.col("new_sentence")), "_p", model, "_g").drop("_p")
        return answered.withColumn("_stance", stance_from_generation(F.col("_g"))).drop("_g")

    rows = find_arguments(
        topics, collection, ["doc_id", "sent_id"], "source", "doc_id", MiningOptions(similarity_threshold=0.3, stance=CUES, cues=CUES, classifier=classifier)
    )
    got = sorted((r["topic_pos"], r["num_arguments_analyzed"], r["label"], r["analysis_status"]) for r in rows.collect())
    assert got == [(0, i, "neutral", i + 1) for i in range(3)] + [(2, i, "pro", 0) for i in range(60)]
    assert len(open(calls).read().splitlines()) == 8 + 60


def test_mine_corpus_gates(spark):
    topics, collection = inputs(spark, [(1, "The new forest law.")])
    rows = mine_corpus(topics, collection, ["doc_id", "sent_id"], OPTIONS).collect()
    none = mine_corpus(
        topics, collection, ["doc_id", "sent_id"], MiningOptions(similarity_threshold=0.3, stance=CUES, cues=CUES, debatable=lambda s: s.startswith("X"))
    )
    assert rows and none.count() == 0
    assert all(r["reasoning_segment"] for r in rows)


def test_generation_merges_equal_prompts(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def model():
        def answer(prompts):
            with open(calls, "a") as f:
                f.writelines(p + "\n" for p in prompts)
            return prompts.str.upper()

        return answer

    df = spark.createDataFrame([(i, "hot" if i % 3 else f"p{i}") for i in range(30)] + [(99, None)], "id int, prompt string").repartition(4)
    rows = {r["id"]: r["generation"] for r in batch_generate(df, "prompt", model, keep=True, tasks=3).collect()}
    assert rows[1] == "HOT" and rows[3] == "P3" and rows[99] is None
    assert sorted(open(calls).read().split()).count("hot") == 1


def test_rewriting_by_model(spark):
    df = spark.createDataFrame([(1, "The law holds. This helps. End.")], "id int, text string")
    prepared = prepare_sentences(df, ["id"], lang=None, method="llm")
    rows = rewrite_sentences(prepared, lambda: lambda p: p.str.extract("Satz: (.*)")[0].str.upper()).orderBy("sent_id").collect()
    assert [r["new_sentence"] for r in rows] == ["The law holds.", "THIS HELPS.", "End."]
    assert "{context}" in PROMPTS["rewrite"]


def test_encoders(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "b c c"), (3, "")], "id int, text string")
    hashed = embed_hashed(df, "text", 32).orderBy("id").collect()
    assert [len(r["embedding"]) for r in hashed] == [32] * 3
    assert sum(x * x for x in hashed[1]["embedding"]) == pytest.approx(1.0, abs=1e-5)
    rows = embed_with(df, ["id"], "text", lambda: lambda s: [[len(x), 1.0] for x in s]).orderBy("id").collect()
    assert [list(r["embedding"]) for r in rows] == [[3.0, 1.0], [5.0, 1.0], [0.0, 1.0]]


def test_hashed_vectors_equal_brute_force(spark):
    texts = ["The law helps the poor", "the tax", "A law, a tax", "..."]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: r["embedding"] for r in embed_hashed(df, "text", 64).collect()}
    place = HashingTF(numFeatures=64).indexOf
    counts = [Counter(place(w) for w in re.findall("[a-z]+", t.lower())) for t in texts]
    for i, tf in enumerate(counts):
        weights = {j: n * math.log((len(texts) + 1) / (sum(j in c for c in counts) + 1)) for j, n in tf.items()}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        want = [weights.get(j, 0.0) / norm if norm else 0.0 for j in range(64)]
        assert list(got[i]) == pytest.approx(want, abs=1e-6)


def test_trained_classifier_learns_a_clear_rule(spark):
    rows = [(f"topic {i % 7} [SEP] {'we support it' if i % 2 else 'we reject it'} number {i}", i % 2) for i in range(80)]
    df = spark.createDataFrame(rows, "input_text string, label int")
    model = train_stance_classifier(df, features=512)
    scored = predict(model, df).collect()
    assert all(r["predicted_label"] == r["label"] and 0.5 <= r["score"] <= 1 for r in scored)


def test_checkpointed_uses_the_shared_folder(spark):
    df = checkpointed(spark.range(5))
    assert df.count() == 5
    assert all(f.startswith("file://" + spark.conf.get("spark.checkpoint.dir")) for f in df.inputFiles())


# --- streams -----------------------------------------------------------------------------------


def write_parts(df, folder, parts):
    """The rows of each part as one file, written in order."""
    for i in range(parts):
        df.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(folder)


@pytest.mark.parametrize("files", [1, None])
def test_stream_equals_batch_and_resumes(spark, files):
    topics, collection = inputs(spark, [(1, "The new forest law.")])
    docs = spark.createDataFrame([(*d, "en", i) for i, d in enumerate(DOCS)], "doc_id long, source string, text string, lang string, part int")
    folder = work_dir(spark, "t")
    write_parts(docs.where("part < 2"), f"{folder}/in", 2)
    seen = []
    listener = ProgressListener(lambda batch, analyzed, arguments: seen.append((batch, analyzed, arguments)))
    spark.streams.addListener(listener)

    def run():
        stream = stream_table(spark, f"{folder}/in", docs.drop("part").schema, files_per_batch=files)
        rows = observed(stream_matches(stream, topics, ["doc_id", "source"], "text", "lang", OPTIONS))
        # the rewriting method differs from the batch side's only for ambiguous sentences
        start_append(rows.select("doc_id", "sent_id", "similarity", "label"), f"{folder}/out", f"{folder}/cp").awaitTermination()
        return {(r["doc_id"], r["sent_id"]) for r in spark.read.parquet(f"{folder}/out").collect()}

    first = run()
    assert first and {d for d, _ in first} <= {1, 2}
    write_parts(docs.where("part = 2"), f"{folder}/in", 3)
    assert run() >= first
    assert spark.read.parquet(f"{folder}/out").groupBy("doc_id", "sent_id").count().where("count > 1").count() == 0
    batch = build_collection(docs.drop("part"), ["doc_id", "source"], "text", "lang", html=False)
    hits = search(topics, batch, ["doc_id", "sent_id"], OPTIONS, 1000, False)
    assert run() == {(r["doc_id"], r["sent_id"]) for r in hits.collect()}
    spark.streams.removeListener(listener)
    assert sum(n for _, n, _ in seen) == len(run())


def test_stop_over_batches_equals_the_loop(spark):
    marks = [(["hot", "a"][i % 3 == 0], i, i % 2 == 0) for i in range(40)]
    df = spark.createDataFrame([(g, p, n, p // 10) for g, p, n in marks], "g string, pos int, neutral boolean, part int")
    folder = work_dir(spark, "t")
    write_parts(df, f"{folder}/in", 4)
    stream = stream_table(spark, f"{folder}/in", "g string, pos int, neutral boolean", files_per_batch=1)
    start_early_stop(
        stream, group=["g"], order=[F.col("pos")], neutral=F.col("neutral"), out=f"{folder}/out", state=f"{folder}/state", checkpoint=f"{folder}/cp", limit=6
    ).awaitTermination()
    seen, want = {}, []
    for g, p, n in marks:
        if seen.get(g, 0) < 6:
            want.append(p)
            seen[g] = seen.get(g, 0) + n
    assert sorted(r["pos"] for r in spark.read.parquet(f"{folder}/out/batch=*").collect()) == want
    last = spark.read.parquet(f"{folder}/state/version=3")
    assert {r["g"]: r["neutrals"] for r in last.collect()} == seen


def test_cancel(spark):
    folder = work_dir(spark, "t")
    spark.range(3).write.parquet(f"{folder}/in")
    query = start_append(stream_table(spark, f"{folder}/in", "id long"), f"{folder}/out", f"{folder}/cp", available_now=False)
    query.processAllAvailable()
    cancel(query)
    assert not query.isActive and spark.read.parquet(f"{folder}/out").count() == 3


def test_hits_beyond_the_stop_bring_no_texts(spark):
    topics, collection = inputs(spark, [(1, "The new forest law. The new forest law."), (2, "Bread is good.")])
    key, neutral = ["doc_id", "sent_id"], MiningOptions(similarity_threshold=0.1, stance=CueRule({"en": ["nobodysays"]}, {"en": ["nobodysays"]}), cues=CUES)
    found = lambda asked: search(asked, collection.select(*key, "new_sentence"), key, neutral, 1000, False).drop("new_sentence")
    slim = read_hits(topics, collection, key, "source", neutral, found)
    per_topic = Counter(r.topic_rewritten for r in slim.collect())
    assert per_topic == {"The new forest law.": 3, "Bread is good.": 2} and found(topics.select("topic_rewritten").distinct()).count() == 9
    assert "SortMergeJoin" not in plan(slim) and "doc_id" in plan(slim).split("Generate")[1].split(" IN (")[0].splitlines()[-1]
    for options in (neutral, OPTIONS, MiningOptions(similarity_threshold=0.1, stance=CUES, cues=CUES, sources=("s2",), neutral_limit=1)):
        some = lambda asked, o=options: search(asked, collection.select(*key, "new_sentence"), key, o, 1000, False).drop("new_sentence")
        want = find_arguments(topics, collection, key, "source", "doc_id", options)
        got = find_arguments(topics, collection, key, "source", "doc_id", options, searcher=some)
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


# --- plans -------------------------------------------------------------------------------------


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_search_plan_does_not_move_the_corpus(spark):
    topics, collection = inputs(spark, [(1, "The new forest law.")])
    text = plan(search(topics, collection, ["doc_id", "sent_id"], OPTIONS, 1000, False))
    assert "BroadcastHashJoin" in text and "Partial" in text and "WindowGroupLimit" in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text and "SortMergeJoin" not in text


def test_top_k_is_cut_before_both_shuffles(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("g"), "id")
    text = plan(top_k_per_group(df, ["g"], [F.col("id")], 5, two_level=True))
    assert text.count("Partial") == 2 and text.count("Exchange hashpartitioning") == 2


def test_filters_and_columns_reach_the_scan(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    text = plan(prepare_sentences(docs, ["doc_id", "source"]).where(F.col("source") == "src1").select("doc_id", "new_sentence"))
    assert "EqualTo(source,src1)" in text and "n_chars" not in text


def test_contexts_are_made_only_where_they_are_read(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    prepared = prepare_sentences(docs, ["doc_id"], method=None)
    assert "slice(" in plan(prepared) and "slice(" not in plan(prepared.select("doc_id", "sent_id", "new_sentence"))


def test_sentences_need_no_shuffle(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").repartition(spark.sparkContext.defaultParallelism)
    text = plan(prepare_sentences(docs, ["doc_id"]))
    assert text.count("Exchange") == 1  # the repartition of this test
    assert "Filter ((size" not in text and "size(transform" not in text.split("Generate")[1]


def test_stop_in_a_search_reuses_the_topic_partitioning(spark):
    topics, collection = inputs(spark, [(1, "The new forest law.")])
    hits = search(topics, collection, ["doc_id", "sent_id"], OPTIONS, 1000, False).withColumn("label", F.lit("pro"))
    text = plan(stop_early(hits, topics, 3))
    assert text.count("Exchange hashpartitioning(topic_rewritten") <= 3  # distinct topics, hits, topics of the join
