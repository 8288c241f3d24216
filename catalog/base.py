"""Shared pieces of the registered queries: table access, fixture settings, SQL fragments.

The SQL is written against the driver's tables and run by DuckDB as an independent check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from disputatio.operators.stance import CueRule
from disputatio.session import spread

# Cue words that occur in the test documents; `from` stands in for an English negation, of which they have none.
TEST_PRO = {"de": ["für", "mit"], "fr": ["pour", "avec"], "es": ["para", "con"], "en": ["for", "with"]}
TEST_CONTRA = {"de": ["nicht"], "fr": ["pas"], "es": ["no"], "en": ["from"]}
TEST_CUES = CueRule(TEST_PRO, TEST_CONTRA)

# Similarity threshold of the text queries: the documents are invented words, few sentences are close.
TEXT_THRESHOLD = 0.25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows are costly to work on; each of the driver's tables is one small file."""
    return spread(table(spark, sf_dir, name))


def sql_list(items) -> str:
    return "[" + ", ".join("'" + str(i).replace("'", "''") + "'" for i in items) + "]"


def sql_by_lang(lexicon, lang: str) -> str:
    everything = sorted({w for ws in lexicon.values() for w in ws})
    cases = " ".join(f"WHEN {lang} = '{code}' THEN {sql_list(ws)}" for code, ws in lexicon.items())
    return f"CASE {cases} ELSE {sql_list(everything)} END"


def sql_sentence_list(text: str) -> str:
    pieces = f"regexp_extract_all({text}, '[^.!?\\n]+[.!?]*', 0)"
    return f"list_filter(list_transform({pieces}, lambda x: trim(x)), lambda x: x <> '')"


def sql_words(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '\\p{{L}}+')"


def sql_sentences(name: str, source: str, keys: str, text: str) -> str:
    """CTE: one row per sentence with ``sent_id``; the whole list stays as ``lst``."""
    return f"""{name}_l AS (SELECT {keys}, {sql_sentence_list(text)} AS lst FROM {source}),
{name} AS (SELECT {keys}, unnest(lst) AS sentence, CAST(unnest(range(len(lst))) AS INTEGER) AS sent_id, lst FROM {name}_l)"""


def sql_window(i: str, radius: int, lst: str = "lst") -> str:
    return f"array_to_string(list_slice({lst}, greatest({i} - {radius}, 0) + 1, least({i} + {radius}, len({lst}))), ' ')"


def sql_ambiguous(sentence: str, lang: str) -> str:
    from disputatio.functions.lexicons import AMBIGUOUS_WORDS

    found = f"list_filter(regexp_extract_all({sentence}, '\\p{{L}}+'), lambda w: list_contains({sql_by_lang(AMBIGUOUS_WORDS, lang)}, lower(w)))"
    return found


def sql_stance(words: str, lang: str) -> tuple[str, str]:
    """Expressions counting pro and contra cues in a word list."""
    pro = f"len(list_filter({words}, lambda w: list_contains({sql_by_lang(TEST_PRO, lang)}, w)))"
    contra = f"len(list_filter({words}, lambda w: list_contains({sql_by_lang(TEST_CONTRA, lang)}, w)))"
    return pro, contra


SQL_LABEL = "CASE WHEN p > c THEN 'Pro' WHEN c > p THEN 'Contra' ELSE 'Neutral' END"
SQL_SCORE = "CASE WHEN p + c = 0 THEN 0.0::DOUBLE ELSE ((greatest(p, c) * 200 + p + c) // ((p + c) * 2)) / 100.0::DOUBLE END"


def sql_adjust(label: str, score: str, threshold) -> str:
    return f"CASE WHEN {threshold} IS NULL OR {score} IS NULL OR {score} >= {threshold} THEN lower({label}) ELSE 'Neutral' END"


def sql_plain(text: str) -> str:
    folded = f"translate(lower({text}), 'äöüàâáãåçèéêëìíîïñòóôõøùúûýÿ', 'aouaaaaaceeeeiiiinooooouuuyy')"
    for letter, pair in (("ß", "ss"), ("œ", "oe"), ("æ", "ae")):
        folded = f"replace({folded}, '{letter}', '{pair}')"
    return f"regexp_replace({folded}, '[^a-z0-9 ]', '', 'g')"


def sql_edit_ratio(a: str, b: str) -> str:
    return f"CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1.0::DOUBLE ELSE 1 - levenshtein({a}, {b}) / greatest(length({a}), length({b}))::DOUBLE END"
