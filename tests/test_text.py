import pytest
from pyspark.sql import functions as F

from disputatio.functions.parsing import parse_dict_list, parse_evidence, speaker
from disputatio.functions.prompts import few_shot_examples, render_prompt, route_prompts
from disputatio.functions.text import (
    ILLEGAL_CONTROL_CODES,
    capitalize_first,
    clean_whitespace,
    escape_all_strings,
    escape_control_chars,
    split_sentences,
    plain_form,
    strip_html,
    token_set,
    words,
)
from disputatio.operators.context import ambiguous_words, prepare_sentences, sentence_contexts


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first()["y"]


def test_split_sentences(spark):
    assert one(spark, "Ja. Nein!? Doch\n\n Vielleicht", split_sentences) == ["Ja.", "Nein!?", "Doch", "Vielleicht"]
    assert one(spark, "  ", split_sentences) == []
    assert one(spark, None, split_sentences) is None


def test_token_set_is_longest_first(spark):
    assert one(spark, "The cat the mouse A a", token_set) == ["mouse", "cat", "the", "a"]


@pytest.mark.parametrize(
    "html,separator,text",
    [
        ("<p>A.</p><p>B.</p>", "", "A.B."),
        ("<p>A.</p><p>B.</p>", "\n", "A.\nB.\n"),
        ("x<script>var a = '<p>';</script>y<STYLE type=a>p{}</STYLE>z", "", "xyz"),
        ("a &amp;lt; b &lt; c&nbsp;d &quot;e&quot;", "", 'a &lt; b < c d "e"'),
        ("&#8211;&#228;&#128512;", "", "–ä😀"),
        ("3 < 5 and 7 > 2", "", "3 < 5 and 7 > 2"),
        ("&#x2013;&Eacute;&euro;&sect; &#38;lt; &nope; &#0; &#xD800;", "", "–É€§ &lt; &nope; &#0; &#xD800;"),
        ("<!-- <p>no</p> -->yes<br/>no", "\n", "yes\nno"),
    ],
)
def test_strip_html(spark, html, separator, text):
    assert one(spark, html, lambda c: strip_html(c, separator)) == text


def test_control_characters(spark):
    assert len(ILLEGAL_CONTROL_CODES) == 29
    raw = "a" + "".join(map(chr, range(32))) + "b"
    want = "a" + "".join(chr(c) if c in (9, 10, 13) else f"\\x{c:02x}" for c in range(32)) + "b"
    assert one(spark, raw, escape_control_chars) == want


def test_all_string_columns_are_escaped(spark):
    df = spark.createDataFrame([("a\x01", 1, "b\x1f")], "`Sem. Text` string, n int, t string")
    assert tuple(escape_all_strings(df).first()) == ("a\\x01", 1, "b\\x1f")


def test_whitespace_and_capitals(spark):
    assert one(spark, "a\n\n b\t c", clean_whitespace) == "a b c"
    assert one(spark, "über uns", capitalize_first) == "Über uns"
    assert one(spark, "", capitalize_first) == ""


@pytest.mark.parametrize(
    "generation,want",
    [
        ("[{'segment': 'a'}, {'segment': 'b'}]", [{"segment": "a"}, {"segment": "b"}]),
        ("```\n[{\"a\": null}] ]```", [{"a": ""}]),
        ("no list here", []),
        ('[{"a": "annulliert"}, {"b": null}]', [{"a": "annulliert"}, {"b": ""}]),
        ('Hier: [{"a": "Art. [3] gilt {so}"}] und [{"z": "nein"}]', [{"a": "Art. [3] gilt {so}"}]),
        ("x ['text', {'a': 'wo-\nrt'}]", [{"a": "wort"}]),
        ("{'a': 'b'}", [{"a": "b"}]),
    ],
)
def test_parse_dict_list(spark, generation, want):
    assert one(spark, generation, parse_dict_list) == want


@pytest.mark.parametrize(
    "generation,want",
    [
        ('{"reasoning_segment": "s", "reasoning": "r"}', ("s", "r")),
        ("no json", ("", "")),
        ('{"reasoning": null}', ("", "")),
        ("{'reasoning': 'r'}", ("", "r")),
    ],
)
def test_parse_evidence(spark, generation, want):
    assert tuple(one(spark, generation, parse_evidence)) == want


@pytest.mark.parametrize(
    "sentence,context,want",
    [
        ("Anna Muster (G, ZH) ist dafür.", "", ("Anna Muster", "G", "ZH")),
        ("Er ist dafür.", "Anna Muster (G, ZH). Bo Beispiel (M-E, BE) sprach.", ("Bo Beispiel", "M-E", "BE")),
        ("Niemand.", "Nichts.", ("", "", "")),
    ],
)
def test_speaker(spark, sentence, context, want):
    df = spark.createDataFrame([(sentence, context)], "s string, c string")
    assert tuple(df.select(speaker(F.col("s"), F.col("c")).alias("w")).first()["w"]) == want


def window(n, length, radius):
    """The list slice of the exact form."""
    return list(range(length))[n - radius : n + radius]


@pytest.mark.parametrize("length", [1, 3, 4, 9, 10, 12])
@pytest.mark.parametrize("radius", [2, 5])
def test_exact_windows(spark, length, radius):
    text = "\n".join(f"s{i}" for i in range(length))
    df = spark.createDataFrame([(1, text)], "id int, text string")
    rows = sentence_contexts(df, ["id"], radius=radius, exact=True).orderBy("sent_id").collect()
    assert [r["context"] for r in rows] == [" ".join(f"s{i}" for i in window(n, length, radius)) for n in range(length)]
    clamped = sentence_contexts(df, ["id"], radius=radius).orderBy("sent_id").collect()
    assert [r["context"] for r in clamped] == [
        " ".join(f"s{i}" for i in range(max(n - radius, 0), min(n + radius, length))) for n in range(length)
    ]


def test_prepare_sentences(spark):
    df = spark.createDataFrame([(1, "Das Gesetz gilt. Dies hilft allen. Ende.", "de"), (2, None, "de")], "id int, text string, lang string")
    rows = prepare_sentences(df, ["id"], lang="lang").orderBy("sent_id").collect()
    assert [r["new_sentence"] for r in rows] == ["Das Gesetz gilt.", "Das Gesetz gilt. Dies hilft allen. Ende.", "Ende."]
    kept = prepare_sentences(df, ["id"], lang="lang", method=None).orderBy("sent_id").collect()
    assert [r["new_sentence"] for r in kept] == ["Das Gesetz gilt.", "Dies hilft allen.", "Ende."]
    forced = prepare_sentences(df, ["id"], lang="lang", force=True).orderBy("sent_id").collect()
    assert forced[2]["new_sentence"] == "Das Gesetz gilt. Dies hilft allen. Ende."
    with pytest.raises(ValueError):
        prepare_sentences(df, ["id"], method="other")


def test_ambiguous_words_keep_order_and_case(spark):
    df = spark.createDataFrame([("That, this and That again", "en")], "s string, l string")
    assert df.select(ambiguous_words(F.col("s"), F.col("l")).alias("w")).first()["w"] == ["That", "this"]


def test_render_prompt_leaves_inserted_braces(spark):
    df = spark.createDataFrame([("{b}", "x")], "a string, b string")
    text = df.select(render_prompt("{{j}} {a}-{b}", {"a": F.col("a"), "b": F.col("b")}).alias("p")).first()["p"]
    assert text == "{j} {b}-x"
    with pytest.raises(ValueError):
        render_prompt("{missing}", {})


def test_few_shot_examples_are_repeatable(spark):
    rows = [(i, f"t{i}", f"a{i}", "pro") for i in range(8)]
    df = spark.createDataFrame(rows, "id int, thema string, argument string, label string")
    first = few_shot_examples(df, "id").first()["examples"]
    assert first == few_shot_examples(df.repartition(3), "id").first()["examples"]
    assert first.count(": pro\n") == 8
    assert first != few_shot_examples(df, "id", seed=7).first()["examples"]


def test_route_prompts(spark):
    registry = spark.createDataFrame(
        [("a/b", "transformers", "inst"), ("c", "openai", "inst"), ("d", "vllm", None)], "model string, client string, template string"
    )
    df = spark.createDataFrame([("a/b", "hi"), ("c", "hi"), ("d", "hi")], "model string, prompt string")
    got = {r["model"]: (r["final_prompt"], dict(r["parameters"])) for r in route_prompts(df, registry).collect()}
    assert got["a/b"] == ("<s> [INST] hi [/INST]", {"max_new_tokens": 4096.0, "temperature": 0.0, "repetition_penalty": 1.1})
    assert got["c"] == ("hi", {"max_tokens": 4096.0, "temperature": 0.0})
    assert got["d"][0] == "hi"


def test_german_words(spark):
    assert one(spark, "Die große Straße, œuvre cœur 3÷4×5", words) == ["die", "große", "straße", "œuvre", "cœur"]
    assert one(spark, "für größere Löhne", plain_form) == "fur grossere lohne"
