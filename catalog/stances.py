"""Queries on stance rules, labels and classifier evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.base import SQL_LABEL, SQL_SCORE, TEST_CUES, sql_adjust, sql_sentences, sql_stance, sql_words, spread_table, table
from disputatio.functions.labels import (
    adjust_label,
    argmax,
    convert_label,
    label_name,
    normalize_label,
    round_percent,
)
from disputatio.operators.context import explode_sentences
from disputatio.operators.metrics import (
    THRESHOLDS,
    best_threshold,
    classification_report,
    confusion_counts,
    multiclass_metrics,
    threshold_confusion,
)
from disputatio.operators.counted import count_documents, embed_counted, predict_counted, train_counted
from disputatio.operators.ml import assign_set, embed_hashed, predict, train_stance_classifier
from disputatio.operators.reshape import confidence_head, label_union, split_by_set, training_filter, with_input_text
from disputatio.operators.stance import is_argument, passes_precheck, says_yes, with_struct
from disputatio.plans.evaluation import evaluate_stance, predict_stance, prepare_training_set, split_sizes, sweep_reports
from disputatio.session import checkpointed


def sentence_stances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of the documents with label and score of the cue rule."""
    rows = explode_sentences(spread_table(spark, sf_dir, "documents"), ["doc_id", "lang", "source"])
    return predict_stance(rows, F.lit(None).cast("string"), F.col("sentence"), F.col("lang"), TEST_CUES)


def q_classify_stance_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sentence_stances(spark, sf_dir)
    return rows.select("doc_id", "sent_id", "label", "score", "model_generation")


def q_adjust_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sentence_stances(spark, sf_dir)
    return rows.select(
        "doc_id",
        "sent_id",
        adjust_label(F.col("label"), F.col("score"), 0.8).alias("adjusted"),
        adjust_label(F.col("label"), F.when(F.col("sent_id") > 0, F.col("score")), 0.8).alias("first_unscored"),
        adjust_label(F.col("label"), F.col("score"), None).alias("unlimited"),
    )


def q_convert_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sentence_stances(spark, sf_dir)
    text = F.concat(F.lit(" "), F.col("label"), F.lit(": "), F.col("sentence"))
    return rows.select("doc_id", "sent_id", convert_label(text).alias("code"), convert_label(F.col("sentence")).alias("own_code"))


def q_stance_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sentence_stances(spark, sf_dir).withColumn("label", F.lower("label"))
    return rows.where(is_argument(F.col("label"))).select("doc_id", "sent_id", "label")


def q_precheck_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sentence_stances(spark, sf_dir)
    return rows.where(passes_precheck(F.col("score"))).select("doc_id", "sent_id", "score")


def q_debatable_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yes/no rule: a scored sentence can be debated."""
    rows = sentence_stances(spark, sf_dir)
    answer = F.when(F.col("score") > 0, F.lit(" Ja\n")).otherwise(F.lit("Nein"))
    return rows.where(says_yes(answer)).select("doc_id", "sent_id", "sentence")


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as models give them, made from whole conversation texts."""
    text = F.col("text")
    kind = F.col("turn") % 7
    answer = (
        F.when(kind == 0, F.concat(F.lit("Pro, weil "), text))
        .when(kind == 1, F.lit(" Contra\n"))
        .when(kind == 2, F.concat(text, F.lit("\nLabel: Neutral")))
        .when(kind == 3, F.concat(text, F.lit(" also contra ")))
        .when(kind == 4, F.lit("Pro."))
        .when(kind == 5, F.concat(F.lit("Antwort : "), F.lit("PRO")))
        .otherwise(text)
    )
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", answer.alias("generation"))


def q_normalize_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = generations(spark, sf_dir)
    return rows.select("conv_id", "turn", normalize_label(F.col("generation")).alias("label"), normalize_label(F.col("generation"), strict=True).alias("strict_label"))


def q_argmax_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", argmax(F.col("embedding")).alias("best"))


def q_label_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.col("quality") - F.col("toxic")
    return table(spark, sf_dir, "labels").select("doc_id", code.cast("int").alias("code"), label_name(code).alias("name"))


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 1).otherwise(-1)
    return table(spark, sf_dir, "labels").select("doc_id", truth.alias("y_true"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: truth from the labels (toxic 0, else good 1 and bad -1)."""
    docs = spread_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return docs.join(marks(spark, sf_dir), "doc_id")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with the rule's label and score; texts are scored where they lie and do not move."""
    docs = spread_table(spark, sf_dir, "documents")
    scored = with_struct(docs, TEST_CUES(F.col("source"), F.col("text"), F.col("lang")), "doc_id", "lang", "source")
    return scored.join(marks(spark, sf_dir), "doc_id")


def coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir)
    return rows.withColumn("y_pred", convert_label(adjust_label(F.col("label"), F.col("score"), 0.6)))


def _six(df: DataFrame) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n, t in df.dtypes if t == "double" and n != "threshold"})


def q_round_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", round_percent(F.col("value")).alias("value"))


def q_confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confusion_counts(coded(spark, sf_dir))


def q_label_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_union(coded(spark, sf_dir), "y_true", "y_pred")


def q_classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(classification_report(confusion_counts(coded(spark, sf_dir)), label_name(F.col("label"))))


def q_multiclass_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(multiclass_metrics(confusion_counts(coded(spark, sf_dir))))


def q_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(sweep_reports(predictions(spark, sf_dir), "y_true"))


def q_best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    sweep = multiclass_metrics(threshold_confusion(predictions(spark, sf_dir), "y_true", "label", "score"), ["threshold"])
    return _six(best_threshold(sweep.withColumn("matthews_correlation", F.round("matthews_correlation", 9)), "matthews_correlation"))


def q_confidence_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confidence_head(predictions(spark, sf_dir).select("doc_id", "label", "score"), "score", ["doc_id"], n=20)


def q_evaluate_stance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All confident rows; the truth's own confidence is the document's score share of its source."""
    rows = labelled(spark, sf_dir).withColumn("stance_conf", F.when(F.col("y_true") == 0, 0.5).otherwise(0.9))
    report = evaluate_stance(
        rows, key=["doc_id"], y_true="y_true", confidence="stance_conf", topic=F.col("source"), text=F.col("text"), lang=F.col("lang"), rule=TEST_CUES, rows=None
    )
    return _six(report)


def arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows: the document's source is the topic, its text the argument, its stance share the quality."""
    rows = predict_stance(labelled(spark, sf_dir), F.col("source"), F.col("text"), F.col("lang"), TEST_CUES)
    return rows.select(
        "doc_id", F.col("source").alias("topic"), F.col("text").alias("argument"), F.col("y_true").alias("stance"), F.col("score").alias("quality_score"),
        assign_set(F.col("doc_id")).alias("set"),
    )


def q_training_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_filter(arguments(spark, sf_dir), "stance", "quality_score").drop("argument")


def q_build_input_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_input_text(arguments(spark, sf_dir), "topic", "argument", "stance").select("doc_id", "input_text", "label")


def q_split_by_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = split_by_set(arguments(spark, sf_dir).select("doc_id", "set", "stance"))
    return parts["train"].unionByName(parts["test"]).unionByName(parts["dev"])


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare_training_set(arguments(spark, sf_dir), topic="topic", argument="argument", stance="stance", quality="quality_score", part="set")


def q_prepare_training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_rows(spark, sf_dir)


def q_split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_sizes(training_rows(spark, sf_dir))


def q_train_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train on the train part, report the other two parts."""
    rows = with_input_text(arguments(spark, sf_dir).where(F.col("stance") != 0), "topic", "argument", "stance")
    rows = checkpointed(rows.select("doc_id", "set", "input_text", "label"), "training")  # read in every round
    parts = split_by_set(rows)
    model = train_stance_classifier(parts["train"])
    scored = predict(model, parts["dev"].unionByName(parts["test"]))
    return _six(multiclass_metrics(confusion_counts(scored, "label", "predicted_label", ["set"]), ["set"]))


def q_train_classifier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of the counted model for the rows it was not trained on."""
    rows = with_input_text(arguments(spark, sf_dir).where(F.col("stance") != 0), "topic", "argument", "stance")
    parts = split_by_set(checkpointed(rows.select("doc_id", "set", "input_text", "label"), "training"))
    rest = parts["dev"].unionByName(parts["test"])
    found = predict_counted(train_counted(parts["train"]), rest, ["doc_id", "set", "label"])
    return found.withColumn("margin", F.round("margin", 5))


def q_embed_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of all sentences, components in millionths."""
    rows = checkpointed(explode_sentences(spread_table(spark, sf_dir, "documents"), ["doc_id"]), "sentences")
    found = embed_counted(rows, ["doc_id", "sent_id"], "sentence", count_documents(rows, "sentence"))
    # Half away from zero, as ``round`` does, which would take every number through a decimal.
    parts = F.transform("embedding", lambda x: (x * 1_000_000 + F.signum(x) * 0.5).cast("long"))
    return found.select("doc_id", "sent_id", F.translate(F.to_json(parts), "[]", "").alias("vector"))


def q_embed_hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of MLlib's hashing."""
    rows = explode_sentences(spread_table(spark, sf_dir, "documents"), ["doc_id"])
    return embed_hashed(rows, "sentence").drop("sentence")


# --- SQL ---------------------------------------------------------------------------------------

PRO, CONTRA = sql_stance(sql_words("sentence"), "lang")
SQL_SENTENCE = f"""WITH {sql_sentences("s", "documents", "doc_id, lang, source", "text")},
n AS (SELECT *, {PRO} AS p, {CONTRA} AS c FROM s), st AS (SELECT *, {SQL_LABEL} AS label, {SQL_SCORE} AS score FROM n)"""

DOC_PRO, DOC_CONTRA = sql_stance(sql_words("text"), "lang")
SQL_DOC = f"""WITH n AS (SELECT d.doc_id, d.text, d.lang, d.source, CASE WHEN toxic = 1 THEN 0 WHEN quality = 1 THEN 1 ELSE -1 END AS y_true,
  {DOC_PRO} AS p, {DOC_CONTRA} AS c FROM documents d JOIN labels USING (doc_id)),
st AS (SELECT *, {SQL_LABEL} AS label, {SQL_SCORE} AS score FROM n)"""


def sql_code(label: str) -> str:
    return f"CASE WHEN starts_with({label}, 'pro') THEN 1 WHEN starts_with({label}, 'contra') THEN -1 ELSE 0 END"


def sql_rates(source: str, group: str = "") -> str:
    """CTEs from predictions (y_true, y_pred) to per-class rates."""
    g = f"{group}, " if group else ""
    on = f"AND l.{group} = x.{group}" if group else ""
    return f"""
labs AS (SELECT DISTINCT {g}y_true AS label FROM {source} UNION SELECT DISTINCT {g}y_pred FROM {source}),
cnt AS (SELECT {'l.' + group + ', ' if group else ''}l.label,
  (SELECT count(*) FROM {source} x WHERE x.y_true = l.label AND x.y_pred = l.label {on}) AS tp,
  (SELECT count(*) FROM {source} x WHERE x.y_true = l.label {on}) AS support,
  (SELECT count(*) FROM {source} x WHERE x.y_pred = l.label {on}) AS predicted FROM labs l),
rates AS (SELECT *, CASE WHEN predicted = 0 THEN 0 ELSE tp::DOUBLE / predicted END AS precision,
  CASE WHEN support = 0 THEN 0 ELSE tp::DOUBLE / support END AS recall,
  CASE WHEN support + predicted = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (support + predicted) END AS f1 FROM cnt)"""


def sql_report(group: str = "") -> str:
    g = f"{group}, " if group else ""
    by = f"GROUP BY {group}" if group else ""
    names = "CASE label WHEN -1 THEN 'Contra' WHEN 0 THEN 'Neutral' ELSE 'Pro' END"
    w = "round(sum({0} * support) / sum(support), 6)"
    return f"""
SELECT {g}{names} AS class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM rates
UNION ALL SELECT {g}'accuracy', NULL, NULL, round(sum(tp)::DOUBLE / sum(support), 6), CAST(sum(support) AS BIGINT) FROM rates {by}
UNION ALL SELECT {g}'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM rates {by}
UNION ALL SELECT {g}'weighted avg', {w.format('precision')}, {w.format('recall')}, {w.format('f1')}, CAST(sum(support) AS BIGINT) FROM rates {by}"""


MCC = """CASE WHEN (sum(support)::DOUBLE * sum(support) - sum(predicted::DOUBLE * predicted)) * (sum(support)::DOUBLE * sum(support) - sum(support::DOUBLE * support)) = 0 THEN 0
  ELSE (sum(tp)::DOUBLE * sum(support) - sum(predicted::DOUBLE * support))
  / sqrt((sum(support)::DOUBLE * sum(support) - sum(predicted::DOUBLE * predicted)) * (sum(support)::DOUBLE * sum(support) - sum(support::DOUBLE * support))) END"""
ACC = "round(sum(tp)::DOUBLE / sum(support), 6)"
CODED = f"{SQL_DOC}, cd AS (SELECT *, {sql_code(sql_adjust('label', 'score', 0.6))} AS y_pred FROM st)"
GRID = ", ".join(f"({t}::DOUBLE)" for t in THRESHOLDS)
SWEPT = f"""{SQL_DOC}, th(threshold) AS (VALUES {GRID}),
cd AS MATERIALIZED (SELECT threshold, y_true, {sql_code(sql_adjust('label', 'score', 'threshold'))} AS y_pred FROM st, th)"""
SQL_SET = "('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 7))::INTEGER % 100"
ARGS = f"""{SQL_DOC}, ar AS (SELECT doc_id, source AS topic, text AS argument, y_true AS stance, score AS quality_score,
  CASE WHEN {SQL_SET} < 70 THEN 'train' WHEN {SQL_SET} < 85 THEN 'dev' ELSE 'test' END AS set FROM st)"""
ANSWERS = """WITH g AS (SELECT conv_id, turn, CASE turn % 7 WHEN 0 THEN 'Pro, weil ' || text WHEN 1 THEN ' Contra' || chr(10)
  WHEN 2 THEN text || chr(10) || 'Label: Neutral' WHEN 3 THEN text || ' also contra ' WHEN 4 THEN 'Pro.' WHEN 5 THEN 'Antwort : PRO' ELSE text END AS generation FROM conversations),
l AS (SELECT *, lower(regexp_replace(regexp_replace(generation, '^\\s+', ''), '\\s+$', '')) AS x FROM g),
nl AS (SELECT *, CASE WHEN x IN ('pro', 'contra', 'neutral') THEN x
  WHEN starts_with(x, 'pro') OR starts_with(x, 'contra') OR starts_with(x, 'neutral') THEN string_split(x, ' ')[1]
  WHEN ends_with(x, 'pro') OR ends_with(x, 'contra') OR ends_with(x, 'neutral') THEN string_split(x, ' ')[-1] ELSE 'neutral' END AS label FROM l)"""

QUERIES = {
    "classify_stance_lexicon": q_classify_stance_lexicon,
    "adjust_labels": q_adjust_labels,
    "convert_label": q_convert_label,
    "stance_filter": q_stance_filter,
    "precheck_gate": q_precheck_gate,
    "debatable_gate": q_debatable_gate,
    "normalize_label": q_normalize_label,
    "argmax_logits": q_argmax_logits,
    "label_lookup": q_label_lookup,
    "round_percent": q_round_percent,
    "confusion_matrix": q_confusion_matrix,
    "label_union": q_label_union,
    "classification_report": q_classification_report,
    "multiclass_metrics": q_multiclass_metrics,
    "threshold_sweep": q_threshold_sweep,
    "best_threshold": q_best_threshold,
    "confidence_head": q_confidence_head,
    "evaluate_stance": q_evaluate_stance,
    "training_filter": q_training_filter,
    "build_input_text": q_build_input_text,
    "split_by_set": q_split_by_set,
    "prepare_training_set": q_prepare_training_set,
    "split_sizes": q_split_sizes,
    "train_classifier": q_train_classifier,
    "train_classifier_counts": q_train_classifier_counts,
    "embed_sentences": q_embed_sentences,
    "embed_hashed": q_embed_hashed,
}

ORACLE = {
    "classify_stance_lexicon": f"{SQL_SENTENCE} SELECT doc_id, sent_id, label, score, CAST(score AS VARCHAR) AS model_generation FROM st",
    "adjust_labels": f"""{SQL_SENTENCE} SELECT doc_id, sent_id, {sql_adjust('label', 'score', 0.8)} AS adjusted,
  CASE WHEN sent_id = 0 OR score >= 0.8 THEN lower(label) ELSE 'Neutral' END AS first_unscored, lower(label) AS unlimited FROM st""",
    "convert_label": f"""{SQL_SENTENCE} SELECT doc_id, sent_id, CASE label WHEN 'Pro' THEN 1 WHEN 'Contra' THEN -1 ELSE 0 END AS code,
  {sql_code("lower(regexp_replace(sentence, '^\\s+', ''))")} AS own_code FROM st""",
    "stance_filter": f"{SQL_SENTENCE} SELECT doc_id, sent_id, lower(label) AS label FROM st WHERE lower(label) IN ('pro', 'contra')",
    "precheck_gate": f"{SQL_SENTENCE} SELECT doc_id, sent_id, score FROM st WHERE score >= 0.8",
    "debatable_gate": f"{SQL_SENTENCE} SELECT doc_id, sent_id, sentence FROM st WHERE p + c > 0",
    "normalize_label": f"""{ANSWERS} SELECT conv_id, turn, label, CASE WHEN regexp_extract(label, '(pro|contra|neutral)', 1) = '' THEN 'neutral'
  ELSE regexp_extract(label, '(pro|contra|neutral)', 1) END AS strict_label FROM nl""",
    "argmax_logits": "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS best FROM embeddings",
    "label_lookup": "SELECT doc_id, CAST(quality - toxic AS INTEGER) AS code, CASE quality - toxic WHEN 1 THEN 'Pro' WHEN 0 THEN 'Neutral' ELSE 'Contra' END AS name FROM labels",
    "round_percent": "SELECT event_id, CASE WHEN value <= 1.0 THEN round(value * 100, 2) ELSE value END AS value FROM events",
    "confusion_matrix": f"{CODED} SELECT y_true, y_pred, count(*) AS n FROM cd GROUP BY y_true, y_pred",
    "label_union": f"{CODED} SELECT y_true AS label FROM cd UNION SELECT y_pred FROM cd",
    "classification_report": f"{CODED}, {sql_rates('cd')} {sql_report()}",
    "multiclass_metrics": f"""{CODED}, {sql_rates('cd')} SELECT round(avg(f1), 6) AS macro_f1, {ACC} AS micro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1,
  round({MCC}, 6) AS matthews_correlation, {ACC} AS accuracy_normalized, CAST(sum(tp) AS BIGINT) AS accuracy_not_normalized, round(avg(precision), 6) AS macro_precision,
  {ACC} AS micro_precision, round(sum(precision * support) / sum(support), 6) AS weighted_precision, round(avg(recall), 6) AS macro_recall, {ACC} AS micro_recall,
  round(sum(recall * support) / sum(support), 6) AS weighted_recall FROM rates""",
    "threshold_sweep": f"{SWEPT}, {sql_rates('cd', 'threshold')} {sql_report('threshold')}",
    "best_threshold": f"""{SWEPT}, {sql_rates('cd', 'threshold')}, m AS (SELECT threshold, round({MCC}, 9) AS mcc FROM rates GROUP BY threshold)
SELECT threshold, round(mcc, 6) AS matthews_correlation FROM m ORDER BY mcc DESC, threshold LIMIT 1""",
    "confidence_head": f"{SQL_DOC} SELECT doc_id, label, score FROM st WHERE score > 0.5 ORDER BY doc_id LIMIT 20",
    "evaluate_stance": f"""{SQL_DOC}, th(threshold) AS (VALUES {GRID}),
cd AS MATERIALIZED (SELECT threshold, y_true, {sql_code(sql_adjust('label', 'score', 'threshold'))} AS y_pred FROM st, th WHERE y_true <> 0), {sql_rates('cd', 'threshold')},
rep AS ({sql_report('threshold').replace(', 6)', ', 12)')})
SELECT threshold, class, round(round(precision * 100, 2), 6) AS precision, round(round(recall * 100, 2), 6) AS recall, round(round(f1 * 100, 2), 6) AS f1, support FROM rep""",
    "training_filter": f"{ARGS} SELECT doc_id, topic, stance, quality_score, set FROM ar WHERE stance IN (-1, 1) AND quality_score > 0.5",
    "build_input_text": f"{ARGS} SELECT doc_id, topic || ' [SEP] ' || argument AS input_text, CASE WHEN stance = -1 THEN 0 ELSE 1 END AS label FROM ar",
    "split_by_set": f"{ARGS} SELECT doc_id, set, stance FROM ar",
    "prepare_training_set": f"""{ARGS} SELECT doc_id, stance, quality_score, set, topic || ' [SEP] ' || argument AS input_text, CASE WHEN stance = -1 THEN 0 ELSE 1 END AS label
  FROM ar WHERE stance IN (-1, 1) AND quality_score > 0.5""",
    "train_classifier_counts": f"""{ARGS},
r AS (SELECT doc_id, set, CASE WHEN stance = -1 THEN 0 ELSE 1 END AS label, {sql_words("topic || ' [SEP] ' || argument")} AS ws FROM ar WHERE stance <> 0),
seen AS (SELECT label, unnest(ws) AS word FROM r WHERE set = 'train'),
model AS (SELECT l.label, word, ln((count(*) FILTER (s.label = l.label) + 1) / (any_value(total) + any_value(size))::DOUBLE) AS weight
  FROM seen s, (SELECT label, count(*) AS total FROM seen GROUP BY label) l, (SELECT count(DISTINCT word) AS size FROM seen) GROUP BY l.label, word),
prior AS (SELECT label, ln(count(*) / (sum(count(*)) OVER ())::DOUBLE) AS p FROM r WHERE set = 'train' GROUP BY label),
asked AS (SELECT doc_id, set, label, unnest(ws) AS word FROM r WHERE set <> 'train'),
sums AS (SELECT doc_id, m.label AS guess, sum(weight) AS s FROM asked JOIN model m USING (word) GROUP BY doc_id, m.label),
scores AS (SELECT r.doc_id, r.set, r.label, prior.label AS guess, p + coalesce(s, 0) AS s FROM r CROSS JOIN prior LEFT JOIN sums ON sums.doc_id = r.doc_id AND guess = prior.label WHERE r.set <> 'train')
SELECT doc_id, set, label, CAST(first(guess ORDER BY s DESC, guess) AS INTEGER) AS predicted_label, round(max(s) - min(s), 5) AS margin FROM scores GROUP BY doc_id, set, label""",
    "embed_sentences": f"""WITH {sql_sentences("s", "documents", "doc_id", "text")},
w AS (SELECT doc_id, sent_id, unnest({sql_words("sentence")}) AS word FROM s),
tf AS (SELECT doc_id, sent_id, word, count(*) AS tf FROM w GROUP BY ALL),
df AS (SELECT word, count(*) AS df FROM tf GROUP BY word),
v AS (SELECT doc_id, sent_id, ('0x' || substr(md5(word), 1, 7))::INTEGER % 64 AS d,
  sum(tf * CASE WHEN substr(md5(word), 8, 1) < '8' THEN 1 ELSE -1 END * ln(((SELECT count(*) FROM s) + 1.0::DOUBLE) / (df + 1)) ORDER BY word) AS v
  FROM tf JOIN df USING (word) GROUP BY ALL),
norm AS (SELECT doc_id, sent_id, sqrt(sum(v * v)) AS n FROM v GROUP BY ALL),
cells AS (SELECT s.doc_id, s.sent_id, i AS d, CASE WHEN coalesce(n, 0) < 1e-9 THEN 0 ELSE coalesce(v.v, 0) / n END AS x
  FROM s CROSS JOIN range(64) r(i) LEFT JOIN v ON v.doc_id = s.doc_id AND v.sent_id = s.sent_id AND v.d = i LEFT JOIN norm ON norm.doc_id = s.doc_id AND norm.sent_id = s.sent_id)
SELECT doc_id, sent_id, string_agg(CAST(CAST(round(x * 1000000) AS BIGINT) AS VARCHAR), ',' ORDER BY d) AS vector FROM cells GROUP BY doc_id, sent_id""",
    "split_sizes": f"{ARGS} SELECT set, count(*) AS n FROM ar WHERE stance IN (-1, 1) AND quality_score > 0.5 GROUP BY set",
}
