import pytest
from pyspark.sql import functions as F

from gleanset import fixed
from gleanset.functions import chat, keys
from gleanset.functions import labels as lb
from gleanset.functions import text as tx


def apply(spark, values, expression, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("x"))).collect()]


def check(spark, cases, expression, kind="string"):
    got = apply(spark, [c[0] for c in cases], expression, kind)
    assert got == [c[1] for c in cases]


def test_clean_text(spark):
    cases = [
        (None, ""),
        ("see https://t.co/x now", "see  now"),
        ("@bob buys $TSLA", "buys"),
        ("up $5 million", "up  million"),
        ("mail a@b.com", "mail a.com"),
        ("x @tê y", "x  y"),
        (":)", ":)"),
        ("  http://a.b/c?d=1 rest ", "rest"),
        ("@@bob$x", "@"),
        ("@https://x.y z", "@ z"),
        ("plain", "plain"),
        ("　wide ", "wide"),
        ("", ""),
    ]
    check(spark, cases, tx.clean_text)


def test_strip_cuts_what_python_cuts(spark):
    spaces = [chr(c) for c in range(0x110000) if chr(c).isspace()]
    assert sorted(tx.SPACE_CHARS) == sorted(spaces)
    others = ["​", "᠎", "﻿", "⁠"]
    values = [f"{c}a{c} b{c}{c}" for c in spaces + others]
    check(spark, [(v, v.strip()) for v in values], tx.strip)


WORDS = [
    ("a b　c d", 4),
    ("a\x1cb\x1fc\x85d\x0be", 5),
    ("  l t \n", 2),
    ("", 0),
    ("one", 1),
    (None, None),
]


def test_word_count(spark):
    check(spark, WORDS, tx.word_count)
    spaced = [f"a{chr(c)}b" for c in range(0x3100) if chr(c).isspace()] + ["a​b", "áb c"]
    check(spark, [(v, len(v.split())) for v in spaced], tx.word_count)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5])
def test_has_min_words_agrees_with_word_count(spark, n):
    values = [v for v, _ in WORDS if v is not None] + ["x y z", " x  y  z ", "\n\n", "a b c d e f"]
    check(spark, [(v, len(v.split()) >= n) for v in values], lambda c: tx.has_min_words(c, n))


def test_one_endless_word_is_read_once(spark):
    df = spark.range(1).select(F.repeat(F.lit("x"), 3_000_000).alias("t"))
    row = df.select(
        tx.has_min_words(F.col("t"), 3), tx.has_min_words(F.col("t"), 1), tx.word_count(F.col("t")), F.length(tx.clean_text(F.col("t")))
    ).first()
    assert tuple(row) == (False, True, 1, 3_000_000)


def test_tokens_and_lengths(spark):
    assert apply(spark, ["Don't stop, Été 2x_y"], tx.alphabetic_tokens) == [["don", "t", "stop", "été", "x", "y"]]
    check(spark, [("né 🙂", 4), (None, None)], tx.char_length)
    check(spark, [("a b c d", True), ("a b c", False), (" ".join("x" * 81), False)], lambda c: tx.words_between(c, 4, 80))
    check(spark, [("12 é", False), ("12 z", True)], tx.has_ascii_letter)


def test_label_maps(spark):
    cases = [("strong positive", "positive"), ("Positive", None), (" neutral", None), ("neutral", "neutral")]
    cases += [("mildly negative", "negative"), ("", None), (None, None)]
    check(spark, cases, lb.map_terms)
    check(spark, [(0, "negative"), (1, "neutral"), (2, "positive"), (3, None), (None, None)], lb.map_codes, "int")
    check(spark, [(0, "lecturer"), (1, "training_program"), (2, "facility"), (3, "others"), (4, None)], lb.map_topics, "int")
    check(spark, [("negative", 0), ("positive", 2), ("other", None), (None, None)], lb.class_index)
    check(spark, [(0, "negative"), (2, "positive"), (-1, None), (3, None)], lb.class_name, "bigint")


def test_clean_label(spark):
    cases = [
        ("Positive.", "positive"),
        ("negative, because", "negative"),
        ("Positive!", "positive!"),
        ("", None),
        (" \n ", None),
        ("\tNeu.tral,, x", "neutral"),
        ("., then", ""),
        (None, None),
    ]
    check(spark, cases, lb.clean_label)


def test_parse_sentiment(spark):
    cases = [
        ("Not positive, negative", "positive"),
        ("épositive negative", "negative"),
        ("_positive_", "positive"),
        ("non-positive", "positive"),
        ("neu-tral", "neutral"),
        ("unsure", "unparseable"),
        ("", "unparseable"),
        ("  \n", "unparseable"),
        (None, "unparseable"),
        ("NEUTRAL", "neutral"),
        ("positively neutral", "neutral"),
        ("negativepositive", "positive"),
        ("neg.ative! yes", "negative"),
    ]
    check(spark, cases, lb.parse_sentiment)


def test_is_correct(spark):
    df = spark.createDataFrame(
        [("a", "a"), ("a", "b"), ("unparseable", "unparseable"), (None, "a")], "p string, t string"
    )
    assert [r[0] for r in df.select(lb.is_correct(F.col("p"), F.col("t"))).collect()] == [True, False, False, False]


def test_messages_and_rendering(spark):
    row = spark.createDataFrame([("Do it.", " some text ", "positive")], "i string, x string, o string")
    i, x, o = F.col("i"), F.col("x"), F.col("o")
    full = row.select(chat.to_messages(i, x, o).alias("m")).first().m
    assert [(t.role, t.content) for t in full] == [
        ("system", fixed.SYSTEM_PROMPT),
        ("user", "Do it.\n\nText:  some text "),
        ("assistant", "positive"),
    ]
    open_turn = chat.ChatTemplate(begin="[", before_role="<", after_role=">", end_turn=";", trim_content=True)
    text = row.select(chat.render_chat(chat.to_messages(i, x, o, system=None), open_turn)).first()[0]
    assert text == "[<user>Do it.\n\nText:  some text;<assistant>positive;"
    asked = row.select(chat.render_chat(chat.to_messages(i, x, system="S"), open_turn, True)).first()[0]
    assert asked == "[<system>S;<user>Do it.\n\nText:  some text;<assistant>"
    raw = chat.ChatTemplate(begin="", before_role="<", after_role=">", end_turn=";", trim_content=False)
    assert row.select(chat.render_chat(chat.to_messages(i, x, system=None), raw)).first()[0] == (
        "<user>Do it.\n\nText:  some text ;"
    )


def test_missing_field_fails(spark):
    df = spark.createDataFrame([("a", "b", None)], "i string, x string, o string")
    with pytest.raises(Exception, match="missing instruction, input or output"):
        df.filter(chat.require_fields(F.col("i"), F.col("x"), F.col("o"))).collect()


def test_prompts(spark):
    df = spark.createDataFrame([("news",)], "x string")
    got = df.select(chat.label_prompt(F.col("x"))).first()[0]
    assert got == f"Instruction: {fixed.INSTRUCTION}\nNews: news\nSentiment:"
    cases = [
        ("Write it. Headline:", "Headline: big", "Headline: big"),
        ("Go: Up", "Up and away", "and away"),
        ("Go: Up", "Down", "Down"),
        ("no colon", "no colon here", "no colon here"),
        ("a: b: tail ", "tail  x", "x"),
    ]
    rows = spark.createDataFrame(cases, "p string, t string, want string")
    for r in rows.select("want", chat.strip_prompt_echo(F.col("p"), F.col("t")).alias("got")).collect():
        assert r.got == r.want


def test_keys(spark):
    df = spark.createDataFrame([("a", None), ("a", ""), ("a", "x"), (None, "a")], "p string, q string")
    table, names, whole = keys.with_value_keys(df, ["p", "q"])
    got = [bytes(r[0]) for r in table.select(whole).collect()]
    assert len(set(got)) == 4 and all(len(k) == 32 for k in got) and len(names) == 2
    assert df.select(keys.text_key(F.col("q"))).first()[0] is None


def test_expressions_run_on_a_stream(spark, tmp_path):
    """Cleaning and mapping are stateless, so they also serve a streaming table."""
    source = str(tmp_path / "in")
    spark.createDataFrame([("@a up $x now", "strong positive")], "input string, output string").write.parquet(source)
    stream = spark.readStream.schema("input string, output string").parquet(source)
    made = stream.select(tx.clean_text(F.col("input")).alias("t"), lb.map_terms(F.col("output")).alias("l"))
    query = (
        made.writeStream.format("memory").queryName("cleaned_stream")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination(60)
    assert [tuple(r) for r in spark.table("cleaned_stream").collect()] == [("up  now", "positive")]
