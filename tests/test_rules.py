"""Output markings by cases, and documented commands by the joined rule against the one over arrays."""

import itertools

from pyspark.sql import functions as F

from folioforge.functions import guards
from folioforge.operators import classify, relational


def marked(spark, text, strict=True, context="internal", sources=None):
    rows = spark.createDataFrame([(text, {1: "secret", 2: "internal", 3: "unheard of", 4: None, 5: "top"} if sources is None else sources, context)], "text string, sources map<int, string>, context string")
    r = classify.marked_output(rows, strict).first()
    return r.marked, r.banner


def test_paragraphs_take_the_highest_level_they_cite(spark):
    assert marked(spark, "One [2, 1].\n \n  Two [2].\n\n\nThree.") == ("(S) One [2, 1].\n\n(I) Two [2].\n\n(I) Three.", "secret")
    assert marked(spark, "None.", strict=False) == ("(U) None.", "public")
    assert marked(spark, "Unknown [3].\n\nNull [4].\n\nBeyond [99999999999].") == ("(U) Unknown [3].\n\n(I) Null [4].\n\n(I) Beyond [99999999999].", "internal")


def test_lists_headings_quotations(spark):
    assert marked(spark, "- a [1]\n  more [5]\n2. b\n\n# Head [5]\n\n| t [5] |\n\n```\n[5]\n```") == ("- (S) a [1]\n  more [5]\n2. (I) b\n\n# Head [5]\n\n| t [5] |\n\n```\n[5]\n```", "secret")
    assert marked(spark, "> said [5]") == ("> said [5]", "top")
    assert marked(spark, "- a\nplain [1]") == ("(S) - a\nplain [1]", "secret")


def test_nothing_to_mark(spark):
    assert marked(spark, None) == ("", "public") == marked(spark, " \n\n ")
    assert marked(spark, "# Only a heading", context="top") == ("# Only a heading", "public")
    assert marked(spark, "x", context=None) == ("(U) x", "public")
    assert marked(spark, "x [1]", sources={}) == ("(I) x [1]", "internal")
    empty = spark.createDataFrame([], "text string, sources map<int, string>, context string")
    assert classify.marked_output(empty).count() == 0


def test_a_long_answer(spark):
    text, banner = marked(spark, "\n\n".join(f"Paragraph {i} [{i % 2 + 1}]." for i in range(5000)))
    assert banner == "secret" and text.count("(S) ") == 2500 == text.count("(I) ")


def test_joined_commands_equal_the_rule_over_arrays(spark):
    words = ["a", "b", "--x"]
    every = [" ".join(w) for n in range(5) for w in itertools.product(words, repeat=n)] + [None, "  a \t b ", "cat x", " "]
    for known in (["a b", "b a --x", "a a b c"], ["--x", "a --x b", "b b a", "b b --x", None, ""], []):
        asked = spark.createDataFrame([(i, c, "kept") for i, c in enumerate(every)], "id int, command string, _x string").drop("_x")
        given = spark.createDataFrame([(c,) for c in known * 3], "command string")
        made = {r.id: r.known for r in relational.borne_out(asked, given, ["cat"]).collect()}
        held = F.array(*[F.lit(c) for c in known if c is not None]).cast("array<string>")
        plain = {r.id: r.known for r in asked.select("id", guards.documented(F.col("command"), F.filter(held, lambda c: F.trim(c) != ""), F.array(F.lit("cat"))).alias("known")).collect()}
        assert made == plain and len(made) == len(every)
