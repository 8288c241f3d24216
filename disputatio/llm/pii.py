"""Personal data: fixed formats, further candidates judged by boosted trees, and redaction."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from disputatio.llm.common import saved

KINDS = ("email", "ip", "card", "phone")

# Fixed formats. Where a run of one class of characters fails, so do its tails; tails are not tried again, and no
# repetition gives back what it took, so that the time is linear in the text and no group recurses.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

# Generators of further candidates: looser forms of the same kinds.
LOOSE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:[.,:][0-9]++){3,}+",
    "card": r"[0-9](?:[\x20._/-]?[0-9])++",
    "phone": r"[+(]?[0-9](?:[\x20()./-]{0,3}[0-9])++",
}
LEAST_DIGITS = {"email": 0, "ip": 4, "card": 12, "phone": 7}

# Characters of context on each side of a candidate.
CONTEXT = 16


def _count(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, "")).cast("double")


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    """Whether the digits of a match pass the check sum; leading zeros up to 19 digits change nothing."""
    digits = F.lpad(_digits(match), 19, "0")
    total = F.lit(0)
    for place in range(19):
        d = F.substring(digits, 19 - place, 1).cast("int")
        total = total + (d if place % 2 == 0 else F.when(d > 4, d * 2 - 9).otherwise(d * 2))
    return total % 10 == 0


def valid(kind: str, match: Column) -> Column:
    """Whether a match of a base format counts."""
    n = F.length(_digits(match))
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        parts = F.split(match, r"\.")
        return ~F.exists(parts, lambda p: F.regexp_replace(p, "^0+", "").rlike("^[0-9]{4}") | (F.right(F.concat(F.lit("000"), p), F.lit(3)).cast("int") > 255))
    if kind == "card":
        return (n >= 12) & (n <= 19) & _luhn(match)
    return (n >= 9) & (n <= 15)


def _matches(text: Column, pattern: str, keep, with_context: bool, kind: str) -> Column:
    """Matches that are kept, with their place in code points: what lies between matches gives the places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pieces = F.transform(found, lambda m, i: F.struct(m.alias("m"), F.get(gaps, i).alias("l"), F.get(gaps, i + 1).alias("r")))
    fields = "start:int,kind:string,end:int" + (",match:string,left:string,right:string" if with_context else "")

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["l"])
        end = start + F.length(x["m"])
        item = [start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")]
        if with_context:
            item += [x["m"].alias("match"), F.right(x["l"], F.lit(CONTEXT)).alias("left"), F.left(x["r"], F.lit(CONTEXT)).alias("right")]
        return F.struct(end.alias("at"), F.when(keep(x["m"]), F.concat(acc["out"], F.array(F.struct(*item)))).otherwise(acc["out"]).alias("out"))

    empty = F.array().cast(f"array<struct<{fields}>>")
    return F.aggregate(pieces, F.struct(F.lit(0).alias("at"), empty.alias("out")), add)["out"]


def base_spans(text: Column) -> dict[str, Column]:
    """Per kind the spans of the fixed formats."""
    return {kind: _matches(text, BASE[kind], lambda m, k=kind: valid(k, m), False, kind) for kind in KINDS}


def in_order(spans: Column) -> Column:
    """Spans by start, then by kind in the listed order."""
    rank = lambda x: sum((F.when(x["kind"] == k, F.lit(n)).otherwise(F.lit(0)) for n, k in enumerate(KINDS)), F.lit(0))
    keyed = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), rank(x).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return F.transform(keyed, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


# Places a feature may be split at: more than any has values. The library looks for them in all of the rows up to its square.
SPLITS = 1024

FEATURES = ("kind", "last_group", "group_before", "letters", "space_before", "space_after", "letters_before", "letters_after", "digits_near")


def features(x: Column) -> list[Column]:
    """Ending and context of a candidate.

    What tells the base formats from the loose ones is hidden: leading plus, country code and brackets, dots, the counts
    of digits and groups, check sums and value ranges. So a candidate that differs from base spans in these only looks as they do.
    """
    match, left, right = x["match"], x["left"], x["right"]
    kind = sum((F.when(x["kind"] == k, F.lit(float(n))).otherwise(F.lit(0.0)) for n, k in enumerate(KINDS)), F.lit(0.0))
    flag = lambda c: F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))
    groups = F.filter(F.split(match, "[^0-9A-Za-z]+"), lambda g: g != "")
    length = lambda place: F.coalesce(F.length(F.get(groups, F.size(groups) - place)), F.lit(0)).cast("double")
    return [
        kind, length(1), length(2), _count(match, "[^A-Za-z]"),
        flag((left == "") | left.rlike(r"\s$")), flag((right == "") | right.rlike(r"^\s")), _count(left, r"[^\p{L}]"), _count(right, r"[^\p{L}]"), _count(F.concat(left, right), "[^0-9]"),
    ]


def candidates(text: Column) -> Column:
    """Spans of all generators, overlapping ones too."""
    found = [_matches(text, LOOSE[k], lambda m, k=k: F.length(_digits(m)) >= LEAST_DIGITS[k], True, k) for k in KINDS]
    return F.concat(*found)


def _overlaps(x: Column, spans: Column, same_kind: bool) -> Column:
    return F.exists(spans, lambda s: (s["start"] < x["end"]) & (x["start"] < s["end"]) & ((s["kind"] == x["kind"]) if same_kind else F.lit(True)))


@dataclass
class SpanModel:
    """Boosted trees as nested tests, and per kind the probability from which a candidate is taken (above 1: never)."""

    trees: list[tuple[float, object]] = field(default_factory=list)
    thresholds: dict[str, float] = field(default_factory=dict)

    def probability(self, values: list[Column]) -> Column:
        def branch(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            index, threshold, low, high = node
            return F.when(values[index] <= F.lit(threshold), branch(low)).otherwise(branch(high))

        margin = sum((branch(tree) * F.lit(weight) for weight, tree in self.trees), F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * margin))

    def takes(self, x: Column) -> Column:
        if not self.trees or not self.thresholds:
            return F.lit(False)
        least = F.coalesce(*[F.when(x["kind"] == k, F.lit(t)) for k, t in self.thresholds.items()], F.lit(2.0))
        return self.probability(features(x)) >= least


def _tests(node):
    if node.getClass().getSimpleName() == "LeafNode":
        return round(node.prediction(), 9)  # sums of weights may be added in another order
    split = node.split()
    return (split.featureIndex(), split.threshold(), _tests(node.leftChild()), _tests(node.rightChild()))


def train_span_model(docs: DataFrame, text: str = "text", trees: int = 8, depth: int = 4, precision: float = 0.95, support: int = 20) -> SpanModel:
    """Boosted trees on all candidates, counted by their features: equal ones are one row with a weight.

    A candidate is positive if it overlaps a base span of its kind. Trees see its ending and context only (``features``), in
    calibration, too; so they give the share of base spans among candidates that look alike, and what is added stands where
    nearly all look-alikes are base spans. Look-alikes outside the base formats count as wrong, true or not; where they are
    more than ``precision`` allows, none is added. The precision of added spans alone is not known without labels. Two thirds of the candidates grow the trees; on the rest, per kind, the smallest
    probability is sought from which at least ``precision`` of ``support`` or more candidates are positive. Kinds without one
    are left to the base formats; so is everything if those two thirds lack positives or negatives.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(t.alias("t")).where(F.col("t").rlike("[0-9@]"))
    rows = rows.select(F.concat(*base_spans(F.col("t")).values()).alias("base"), F.explode(candidates(F.col("t"))).alias("x"))
    label = F.when(_overlaps(F.col("x"), F.col("base"), True), 1.0).otherwise(0.0)
    order = F.xxhash64("x.match", "x.left", "x.right", "x.kind", "x.start")
    grow = F.pmod(order, F.lit(3)) > 0
    rows = rows.select(grow.alias("grow"), F.col("x.kind").alias("kind"), label.alias("label"), F.array(*features(F.col("x"))).alias("f"))
    # Written before they are grouped, as the features would else be computed anew for each use.
    rows = saved(rows, "found").groupBy("grow", "kind", "label", "f").agg(F.count(F.lit(1)).cast("double").alias("n"))
    rows = saved(rows, "candidates")
    if rows.where("grow").select("label").distinct().count() < 2:
        return SpanModel()
    model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=7, featuresCol="v", weightCol="n", maxBins=SPLITS).fit(rows.where("grow").withColumn("v", array_to_vector("f")))
    out = SpanModel([(round(float(w), 9), _tests(x._call_java("rootNode"))) for w, x in zip(model.treeWeights, model.trees)])
    share = F.floor(out.probability([F.get("f", F.lit(i)) for i in range(len(FEATURES))]) * 100) / 100
    counts = rows.where(~F.col("grow")).groupBy("kind", share.alias("p")).agg(F.sum(F.col("label") * F.col("n")).alias("hits"), F.sum("n").alias("n")).collect()
    for kind in KINDS:
        hits = n = 0
        for p, h, m in sorted(((r.p, r.hits, r.n) for r in counts if r.kind == kind), reverse=True):
            hits, n = hits + h, n + m
            if n >= support and hits >= precision * n:
                out.thresholds[kind] = p
    return out


def find_personal_data(docs: DataFrame, model: SpanModel, text: str = "text", base: str = "base", spans: str = "spans") -> DataFrame:
    """Add two columns of spans (``start, kind, end``; code points, end exclusive): the base formats, and all that is found.

    To the base spans come candidates that the model takes and that overlap no base span nor an added one before them.
    Null text counts as empty. Columns of those names are replaced, all others stay. Texts without digit or ``@``
    are passed over at once.
    """
    columns = [c for c in docs.columns if c not in (base, spans, "_t", "_found", "_more")]
    t = F.col("_t")
    kind = "array<struct<start:int,kind:string,end:int>>"
    rows = docs.select(*columns, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    worth = t.rlike("[0-9@]")
    found = rows.withColumn("_found", F.when(worth, F.concat(*base_spans(t).values())).otherwise(F.array().cast(kind)))
    if model.trees and model.thresholds:
        more = F.filter(candidates(t), lambda x: ~_overlaps(x, F.col("_found"), False))
        more = F.array_sort(F.transform(F.filter(more, model.takes), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))
        apart = F.aggregate(more, F.array().cast(kind), lambda acc, x: F.when(_overlaps(x, acc, False), acc).otherwise(F.concat(acc, F.array(x))))
        found = found.withColumn("_more", F.when(worth, apart).otherwise(F.array().cast(kind)))
    else:
        found = found.withColumn("_more", F.array().cast(kind))
    return found.select(*columns, in_order(F.col("_found")).alias(base), in_order(F.concat("_found", "_more")).alias(spans))


def redacted(text: Column, spans: Column) -> Column:
    """Text with every span replaced by its kind in brackets; spans that overlap become one, named after the first."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        inside = x["start"] < acc["at"]
        kept = F.substring(text, acc["at"] + 1, x["start"] - acc["at"])
        tag = F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], F.array(kept, tag))).alias("out"))

    cut = F.aggregate(spans, start, add, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, cut).otherwise(text)
