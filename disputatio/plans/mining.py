"""End-to-end argument mining: collection building, argument search, corpus mining, presentation."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from disputatio.functions.parsing import SPEAKER_FIELDS, mention_fields, speaker
from disputatio.functions.text import escape_all_strings, strip_html
from disputatio.operators.context import prepare_sentences
from disputatio.operators.evidence import with_best_sentence
from disputatio.operators.generation import ModelFactory, rewrite_sentences
from disputatio.operators.ranking import running_counts, top_k_per_group
from disputatio.operators.reshape import DISPLAY_NAMES, chosen_names, rename_project
from disputatio.operators.similarity import BROADCAST_BYTES, SEARCH_DEPTH, SHORT_SEARCH_DEPTH, SIMILARITY_THRESHOLD, text_top_k
from disputatio.operators.stance import (
    ANY_SOURCE,
    NEUTRAL_LIMIT,
    STANCE_THRESHOLD,
    CueRule,
    StanceRule,
    allowed_source,
    final_label,
    is_argument,
    passes_precheck,
    with_struct,
)
from disputatio.session import checkpointed

# So many documents with hits are named in a filter, which Spark takes down to the scan; it does not take a join below a generator.
FEW_DOCUMENTS = 20_000

# Gets and returns a frame of hits; adds a costly second stance where the cheap one was not enough.
HitClassifier = Callable[[DataFrame], DataFrame]
# Gets distinct topic sentences, returns their hits.
Searcher = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class MiningOptions:
    """Settings of a search. The defaults are the usual ones of an interactive run."""

    similarity_threshold: float = SIMILARITY_THRESHOLD
    stance_threshold: float | None = STANCE_THRESHOLD
    depth: int = SEARCH_DEPTH
    neutral_limit: int = NEUTRAL_LIMIT
    sources: Sequence[str] = (ANY_SOURCE,)
    precheck: bool = False
    stance: StanceRule = field(default_factory=CueRule)
    cues: CueRule = field(default_factory=CueRule)
    classifier: HitClassifier | None = None
    model_name: str = "cue-rule"
    min_length: int = 10
    debatable: Callable[[Column], Column] | None = None


def build_collection(
    documents: DataFrame,
    keys: Sequence[str],
    text: str,
    lang: str | None = None,
    html: bool = True,
    separator: str = "\n",
    method: str | None = "context",
    model: ModelFactory | None = None,
    speakers: bool = False,
) -> DataFrame:
    """Documents to prepared sentences: markup removed, sentences split, contexts added, ambiguous ones rewritten.

    With ``speakers`` every sentence carries the last ``mention`` of a speaker so far, which the argument search then takes.

    Everything happens on the document's own row, so the job is one scan without a shuffle. ``method="llm"`` lets
    ``model`` rewrite; only ambiguous sentences then move.
    """
    plain = strip_html(F.col(text), separator) if html else F.col(text)
    columns = [c for c in dict.fromkeys([*keys, *([lang] if lang else [])])]
    rows = documents.select(*columns, plain.alias("_plain"))
    return _rewritten(rows, columns, "_plain", lang, method, model, speakers)


def _rewritten(rows: DataFrame, keys: Sequence[str], text: str, lang: str | None, method: str | None, model: ModelFactory | None, speakers: bool = False) -> DataFrame:
    if (method == "llm") != (model is not None):
        raise ValueError("the method 'llm' needs a model, and no other method takes one")
    prepared = prepare_sentences(rows, keys, text, lang, method, speakers=speakers)
    return prepared if model is None else rewrite_sentences(prepared, model)


def prepare_topics(requests: DataFrame, request: str, text: str, method: str | None = "context", model: ModelFactory | None = None) -> DataFrame:
    """Topic sentences of each request: ``request_id, topic_pos, topic_original, topic_rewritten``."""
    prepared = _rewritten(requests, [request], text, None, method, model)
    return prepared.select(
        F.col(request).alias("request_id"),
        F.col("sent_id").alias("topic_pos"),
        F.col("original_sentence").alias("topic_original"),
        F.col("new_sentence").alias("topic_rewritten"),
    )


def search(topics: DataFrame, collection: DataFrame, key: Sequence[str], options: MiningOptions, depth: int, strict: bool) -> DataFrame:
    """Hits of every distinct topic sentence; a sentence asked many times is searched once."""
    distinct = topics.select("topic_rewritten").distinct()
    return text_top_k(
        distinct,
        collection,
        topic="topic_rewritten",
        corpus_key=key,
        corpus_text="new_sentence",
        threshold=options.similarity_threshold,
        k=depth,
        strict=strict,
    )


def classify(hits: DataFrame, options: MiningOptions) -> DataFrame:
    """Stance of each hit: the cheap rule, the gate on its score, and the costly classifier if there is one.

    Spark does not move a filter below a Python stage, so the gate stands before it.
    """
    stance = options.stance(F.col("topic_rewritten"), F.col("new_sentence"), F.col("lang"))
    staged = with_struct(hits, F.struct(stance.alias("_stance")))
    staged = staged.where(passes_precheck(F.col("_stance.score"), options.stance_threshold or 0.0, options.precheck))
    if options.classifier is not None:
        staged = options.classifier(staged)
    return staged.withColumn("label", final_label(F.col("_stance"), options.stance_threshold))


def classify_in_waves(hits: DataFrame, options: MiningOptions, first: int = 8, growth: int = 4) -> DataFrame:
    """Classify hits rank by rank as far as needed, for a classifier too costly to run on all of them.

    Each wave takes the next ranks of the topic sentences that have not reached the neutral limit, and is
    four times as deep as the one before, so 1000 ranks take five waves. The rows of a wave are kept in
    the shared folder: neither the search nor the classifier runs twice.
    """
    hits = checkpointed(hits, "hits")
    waves: list[DataFrame] = []
    closed: DataFrame | None = None
    low, high = 0, first
    while low < options.depth:
        rest = hits.where(F.col("rank") >= low)
        if closed is not None:
            rest = rest.join(closed, "topic_rewritten", "left_anti")
            if rest.isEmpty():
                break
        waves.append(checkpointed(classify(rest.where(F.col("rank") < high), options), "wave"))
        seen = reduce(DataFrame.unionByName, waves).where(~is_argument(F.col("label")))
        counts = seen.groupBy("topic_rewritten").agg(F.count(F.lit(1)).alias("n"))
        closed = counts.where(F.col("n") >= options.neutral_limit).select("topic_rewritten")
        low, high = high, high * growth
    return reduce(DataFrame.unionByName, waves)


def stop_early(hits: DataFrame, topics: DataFrame, limit: int) -> DataFrame:
    """Join hits to the topics that asked for them, up to the neutral limit.

    Equal topic sentences of one request share a counter. The hits of a sentence are the same for each
    of its copies, so copy number ``j`` starts with ``j`` times the sentence's neutral hits, and both
    counts are taken once per sentence, over at most ``k`` hits. The first copy stops last, so hits
    beyond its stop are dropped before the join; later copies are cut after it.
    """
    per_text = Window.partitionBy("topic_rewritten")
    upto = per_text.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    neutral = (~is_argument(F.col("label"))).cast("int")
    counted = hits.withColumns({"_upto": F.sum(neutral).over(upto), "_all": F.sum(neutral).over(per_text), "_self": neutral})
    counted = counted.where(F.col("_upto") - F.col("_self") < limit)
    copies = Window.partitionBy("request_id", "topic_rewritten").orderBy("topic_pos")
    asked = topics.withColumn("_copy", F.row_number().over(copies) - 1)
    before = F.col("_copy") * F.col("_all") + F.col("_upto") - F.col("_self")
    kept = counted.join(asked, "topic_rewritten").where(before < limit)
    return kept.withColumn("analysis_status", (before + F.col("_self")).cast("int")).drop("_upto", "_all", "_self", "_copy")


def with_evidence(rows: DataFrame, options: MiningOptions, for_all: bool = False) -> DataFrame:
    """Evidence sentence, reasoning and speaker.

    The evidence of a hit is the sentence of its context nearest to the topic, its reasoning the cue
    words found there. Hits without a stance get empty texts (``for_all`` searches evidence for them too).
    """
    stance = is_argument(F.col("label"))
    wanted = F.lit(True) if for_all else stance
    found = rows.withColumn("_where", F.when(wanted, F.col("context")))
    found = with_best_sentence(found, "topic_rewritten", "_where", "_found")
    segment = F.coalesce(F.col("_found_sentence"), F.lit(""))
    reasoning = F.when(stance, options.cues.cue_words(segment, F.col("lang"), F.col("label"))).otherwise("")
    named = found.withColumns({"reasoning_segment": segment, "reasoning": reasoning})
    who = mention_fields(F.col("mention")) if "mention" in rows.columns else speaker(F.col("original_sentence"), F.col("context"))
    named = named.withColumn("_who", F.when(stance, who))
    named = named.withColumns({n: F.coalesce(F.col(f"_who.{n}"), F.lit("")) for n in SPEAKER_FIELDS})
    return named.drop("_where", "_found_sentence", "_found_pos", "_found_score", "_who")


def read_hits(topics: DataFrame, collection: DataFrame, key: Sequence[str], business: str, options: MiningOptions, searcher: Searcher) -> DataFrame:
    """Hits of a searcher with the collection's columns, without those that lie beyond the stop of their topic sentence.

    Hits are written with the number of their topic sentence. The first pass reads the sentence alone, to find the place of the
    neutral hit that closes the topic, the second whole rows for the few hits up to it. Within the checked size hits are sent to
    the collection, which then does not move. A costly classifier runs later, in waves, and gets all hits.
    """
    asked = checkpointed(topics.select("topic_rewritten").distinct().withColumn("_topic", F.monotonically_increasing_id()), "asked")
    hits = checkpointed(searcher(asked.select("topic_rewritten")).join(asked, "topic_rewritten").drop("topic_rewritten"), "hits")
    if options.classifier is None:
        slim = collection.select(*dict.fromkeys([*key, business, "lang", "new_sentence"]))
        read = _joined(hits.select("_topic", *key, "rank"), slim, key).join(asked, "_topic")
        labelled = classify(read.where(allowed_source(F.col(business), options.sources)), options)
        neutral = labelled.where(~is_argument(F.col("label"))).select("_topic", "rank")
        last = top_k_per_group(neutral, ["_topic"], [F.col("rank")], options.neutral_limit, "_nth")
        last = last.where(F.col("_nth") == options.neutral_limit - 1).select("_topic", F.col("rank").alias("_last"))
        reached = hits.join(last, "_topic", "left").where(F.col("_last").isNull() | (F.col("rank") <= F.col("_last")))
        hits = checkpointed(reached.drop("_last"), "reached")
    return _joined(hits, collection, key).join(asked, "_topic").drop("_topic")


def _joined(hits: DataFrame, collection: DataFrame, key: Sequence[str]) -> DataFrame:
    """Hits, read from files, with the collection's columns. Where few documents have hits, the others are dropped before their sentences are made."""
    rows = hits.count()
    if rows * 8 * (len(hits.columns) + 2) > BROADCAST_BYTES:
        return hits.join(collection, list(key))
    first = [r[0] for r in hits.select(key[0]).distinct().limit(FEW_DOCUMENTS + 1).collect()]
    if len(first) <= FEW_DOCUMENTS:
        collection = collection.where(F.col(key[0]).isin([x for x in first if x is not None]))
    return collection.join(F.broadcast(hits), list(key))


def find_arguments(
    topics: DataFrame, collection: DataFrame, key: Sequence[str], business: str, filename: str, options: MiningOptions = MiningOptions(), searcher: Searcher | None = None
) -> DataFrame:
    """Arguments for each topic sentence of each request.

    ``searcher`` replaces the text search: it gets the distinct topic sentences and returns ``topic_rewritten``, the key,
    ``similarity``, ``rank`` and ``num_matches``; the collection is then read for the hits only (:func:`read_hits`).

    ``topics`` comes from :func:`prepare_topics`; ``collection`` has the key, ``business`` and ``filename``
    columns, ``lang`` and the prepared sentence. Source filter and stop come after the search, so
    rank and number of matches count all hits.
    """
    columns = list(dict.fromkeys([*key, business, filename, "lang", "original_sentence", "new_sentence", "context", *(["mention"] if "mention" in collection.columns else [])]))
    if searcher is None:
        hits = search(topics, collection.select(*columns), key, options, options.depth, strict=False)
    else:
        hits = read_hits(topics, collection.select(*columns), key, business, options, searcher)
    hits = hits.where(allowed_source(F.col(business), options.sources))
    labelled = classify(hits, options) if options.classifier is None else classify_in_waves(hits, options)
    kept = stop_early(labelled, topics, options.neutral_limit)
    rows = with_evidence(kept, options)
    return rows.select(
        "request_id",
        "topic_pos",
        "topic_original",
        "topic_rewritten",
        F.col("new_sentence").alias("argument_rewritten"),
        F.col("original_sentence").alias("argument_original"),
        F.col("_stance.model_generation").alias("argument_reason"),
        *SPEAKER_FIELDS,
        "context",
        "label",
        F.col("_stance.score").alias("score"),
        "reasoning",
        "reasoning_segment",
        F.round("similarity", 2).alias("similarity"),
        F.lit(options.model_name).alias("model_name"),
        "num_matches",
        F.col("rank").alias("num_arguments_analyzed"),
        F.col(business).cast("string").alias("business_id"),
        F.col(filename).cast("string").alias("filename"),
        "analysis_status",
        (F.col("rank") + 1 == F.col("num_matches")).alias("all_arguments_analyzed"),
    )


def mine_corpus(
    topics: DataFrame, collection: DataFrame, key: Sequence[str], options: MiningOptions = MiningOptions()
) -> DataFrame:
    """The ten best hits per topic sentence, without early stop and with evidence for every stance.

    Short sentences and, on request, undebatable ones are dropped after the search.
    """
    columns = list(dict.fromkeys([*key, "lang", "original_sentence", "new_sentence", "context", *(["mention"] if "mention" in collection.columns else [])]))
    hits = search(topics, collection.select(*columns), key, options, SHORT_SEARCH_DEPTH, strict=True)
    hits = hits.where(F.length("new_sentence") > options.min_length)
    if options.debatable is not None:
        hits = hits.where(options.debatable(F.col("new_sentence")))
    rows = classify(hits, options).join(topics, "topic_rewritten")
    rows = with_evidence(rows, options, for_all=True)
    return rows.select(
        "request_id",
        "topic_pos",
        *key,
        "topic_original",
        "topic_rewritten",
        F.col("new_sentence").alias("argument_rewritten"),
        F.col("original_sentence").alias("argument_original"),
        F.col("_stance.model_generation").alias("argument_reason"),
        *SPEAKER_FIELDS,
        "context",
        "label",
        F.col("_stance.score").alias("score"),
        "reasoning",
        "reasoning_segment",
        "similarity",
    )


def present_results(arguments: DataFrame, chosen: Sequence[str] = ()) -> DataFrame:
    """Argument rows under their display names, escaped, with running counts per request.

    Counts include the rows without a stance, which are not shown.
    """
    counted = running_counts(arguments, ["request_id"], ["topic_pos"], [F.col("num_arguments_analyzed")], is_argument(F.col("label")))
    shown = counted.where(is_argument(F.col("label")))
    names = chosen_names(chosen) if chosen else DISPLAY_NAMES
    keep = {"request_id": "request_id", "topic_pos": "topic_pos", "num_arguments_analyzed": "rank"}
    counts = {"analyzed_so_far": "analyzed_so_far", "arguments_so_far": "arguments_so_far"}
    return escape_all_strings(rename_project(shown, {**keep, **names, **counts}))
