"""Stance of a sentence: the built-in cue rule and the gates around it."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from disputatio.functions.labels import adjust_label, normalize_label
from disputatio.functions.lexicons import CONTRA_CUES, PRO_CUES, Lexicon, in_lexicon
from disputatio.functions.text import once, words

# Stance threshold, neutral rows after which a topic is given up, word for "any source".
STANCE_THRESHOLD = 0.8
NEUTRAL_LIMIT = 3
ANY_SOURCE = "alles"

# (topic, sentence, language) -> struct<label, score, model_generation>
StanceRule = Callable[[Column, Column, Column], Column]


@dataclass(frozen=True)
class CueRule:
    """Counts pro and contra cue words; the larger share is the score, a tie or no cue is neutral."""

    pro: Lexicon = field(default_factory=lambda: PRO_CUES)
    contra: Lexicon = field(default_factory=lambda: CONTRA_CUES)

    def __call__(self, topic: Column, text: Column, lang: Column) -> Column:
        def tally(found: Column) -> Column:
            return F.struct(
                F.size(F.filter(found, lambda w: in_lexicon(self.pro, lang, w))).alias("pro"),
                F.size(F.filter(found, lambda w: in_lexicon(self.contra, lang, w))).alias("contra"),
            )

        return once(once(words(text), tally), lambda n: stance_from_counts(n["pro"], n["contra"]))

    def cue_words(self, text: Column, lang: Column, label: Column) -> Column:
        """Cue words of the given stance in a text, joined by a comma."""

        def cue(w: Column) -> Column:
            is_pro = F.lower(label) == "pro"
            return F.when(is_pro, in_lexicon(self.pro, lang, w)).otherwise(in_lexicon(self.contra, lang, w))

        return F.array_join(F.array_distinct(F.filter(words(text), cue)), ", ")


def with_struct(df: DataFrame, value: Column, *columns: str) -> DataFrame:
    """The named columns (default all) and the fields of a struct that is computed once per row.

    The struct passes through a generator. From a plain projection Spark would copy it into every
    filter on one of its fields and so compute it twice.
    """
    return df.select(*(columns or df.columns), F.inline_outer(F.array(value)))


def stance_from_counts(pro: Column, contra: Column) -> Column:
    """Label and two-decimal score from cue counts; the score is rounded half up in whole numbers."""
    top, total = F.greatest(pro, contra), pro + contra
    score = F.when(total == 0, 0.0).otherwise(F.floor((top * 200 + total) / (total * 2)) / 100)
    label = F.when(pro > contra, "Pro").when(contra > pro, "Contra").otherwise("Neutral")
    return F.struct(label.alias("label"), score.alias("score"), score.cast("string").alias("model_generation"))


def stance_from_generation(generation: Column, strict: bool = False) -> Column:
    """Stance out of a model's free text; such a stance has no score."""
    return F.struct(
        normalize_label(generation, strict).alias("label"),
        F.lit(None).cast("double").alias("score"),
        generation.alias("model_generation"),
    )


def final_label(stance: Column, threshold: float | None = STANCE_THRESHOLD) -> Column:
    return adjust_label(stance["label"], stance["score"], threshold)


def is_argument(label: Column) -> Column:
    """Whether a final label is a pro or contra stance."""
    return label.isin("pro", "contra")


def allowed_source(source: Column, allowed: Sequence[str]) -> Column:
    """Source test; the list may hold the word that stands for any source."""
    return F.lit(True) if ANY_SOURCE in allowed else source.isin(*allowed)


def passes_precheck(score: Column, threshold: float = STANCE_THRESHOLD, precheck: bool = True) -> Column:
    """Gate on a cheap classifier's score, put before a costly one."""
    return F.coalesce(score >= threshold, F.lit(False)) if precheck else F.lit(True)


def says_yes(answer: Column) -> Column:
    """Whether a yes/no answer is yes."""
    return F.lower(F.regexp_replace(F.regexp_replace(answer, r"^\s+", ""), r"\s+$", "")) == "ja"
