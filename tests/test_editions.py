import duckdb
import pytest
from folioforge.operators import editions
from folioforge.plans import catalogue

ARTIFACT = "id string, kind string, target string, text string, cartridge string"


@pytest.fixture()
def volume(spark):
    docs = spark.createDataFrame([("d", "hash"), ("e", "other")], "doc_id string, content_hash string")
    sections = spark.createDataFrame([("s2", "d", 2), ("s1", "d", 1), ("s3", "d", 3), ("t1", "e", 1)], "id string, doc_id string, order_index int")
    passages = spark.createDataFrame([("p1", "d", "s1", 0, "one"), ("p2", "d", "s1", 1, "two"), ("p3", "d", "s2", 2, "three"), ("p4", "d", None, 3, "four")], "id string, doc_id string, section string, order_index int, text string")
    artifacts = spark.createDataFrame(
        [("a", "section_summary", "s1", "theirs", "c"), ("b", "section_summary", "s1", "mine", None), ("c", "section_summary", "s3", "third", "c"), ("f", "reflection", "p1", "on one", None),
         ("g", "reflection", "p3", "stays behind", None), ("h", "reflection", "p4", "loose", None), ("i", "orientation", "d", "about", None), ("j", "document_summary", "d", "sum", "c")], ARTIFACT
    )
    tags = spark.createDataFrame([("p1", "x", 0.2), ("p2", "x", 0.7), ("p2", "y", None), ("p3", "x", 1.0)], "passage string, category string, confidence double")
    return docs, sections, passages, artifacts, tags


def ids(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns or ["id"]).collect())


def test_readings_stand_for_sections(spark, volume):
    out = editions.reduced("readings", *volume)
    texts = ids(out["passages"], "section", "order_index", "text", "id")
    assert [t[:3] for t in texts] == [("s1", 0, "mine"), ("s3", 1, "third")]
    stand = texts[0][3]
    assert ids(out["artifacts"], "id", "target") == [("b", "s1"), ("c", "s3"), ("f", stand), ("i", "d"), ("j", "d")]
    assert ids(out["tags"], "passage", "category", "confidence") == [(stand, "x", 0.7), (stand, "y", None)]
    assert out["sections"].count() == 4


def test_other_levels(spark, volume):
    full, catalogue = editions.reduced("full", *volume), editions.reduced("catalogue", *volume)
    assert ids(full["artifacts"]) == [(x,) for x in "bcfghij"] and full["passages"].count() == 4 and full["tags"].count() == 4
    assert ids(catalogue["artifacts"]) == [("i",), ("j",)]
    assert not any(catalogue[k].count() for k in ("sections", "passages", "tags"))
    with pytest.raises(ValueError):
        editions.reduced("half", *volume)
    empty = editions.reduced("readings", *(df.limit(0) for df in volume))
    assert not any(df.count() for df in empty.values())


def read(spark, docs, sections, passages, summaries=(), reflections=()):
    make = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    made = editions.margins(
        make(docs, "doc_id int, readings_only boolean"), make(sections, "doc_id int, section string, order_index int, title string"),
        make(passages, "doc_id int, section string, order_index int, kind string, text string, char_start int, char_end int"),
        make(summaries, "doc_id int, section string, text string"), make(reflections, "doc_id int, order_index int, text string, cartridge string, created int"),
    )
    return sorted((tuple(r) for r in made.collect()), key=lambda r: (r[0], r[1] is None, r[1] or 0, r[5] or 0))


def test_volumes_as_read(spark):
    passages = [
        (1, "s", 0, None, "## Chapter  \nfirst words", 0, 24), (1, "s", 1, "text", "words and more", 19, 33), (1, "s", 2, "figure", "Figure 1, p. 2\n\nA cat", 33, 40),
        (1, "t", 3, None, "BERT\nstays", 50, 60), (1, None, 4, None, "loose", 60, 65), (1, "gone", 5, None, "nowhere", 65, 70), (1, None, 6, None, "loose too", 60, 69),
        (2, "s", 0, None, "body", 0, 4), (9, "s", 0, None, "no volume", 0, 4),
    ]
    sections = [(1, "s", 0, "chapter"), (1, "t", 1, "E1 E2"), (1, "u", 2, "Without text"), (1, "v", 3, None), (2, "s", 0, "Section"), (2, "t", 1, "Section")]
    rows = read(spark, [(1, False), (2, True)], sections, passages, [(1, "s", "sum"), (2, "s", "sum")], [(1, 1, "b", None, 5), (1, 1, "a", "c", 1), (1, 1, "z", None, 2), (1, 4, "loose note", "c", 1)])
    assert rows == [
        (1, 0, "s", "chapter", "sum", 0, "first words", None, 0),
        (1, 0, "s", "chapter", "sum", 1, " and more", "z", 3),
        (1, 1, "t", None, None, 3, "BERT\nstays", None, 0),
        (1, 2, "u", "Without text", None, None, None, None, 0),
        (1, 3, "v", None, None, None, None, None, 0),
        (1, None, None, None, None, 4, "loose", "loose note", 1),
        (1, None, None, None, None, 6, "loose too", None, 0),
        (2, 0, "s", "Section", None, 0, "body", None, 0),
    ]
    assert read(spark, [], [], []) == []


def test_figures_by_number(spark):
    rows = [(1, 0, "figure", "Figure 2, p. 1\n\nold"), (1, 1, "figure", "Figure 2, p. 1\n\nnew\n\nlines"), (1, 2, "figure", "Figure 3, alone"), (1, 3, "figure", "A figure\n\nx"), (1, 4, None, "Figure 4, p. 1\n\nx"), (1, 5, "figure", None)]
    made = editions.figures(spark.createDataFrame(rows, "doc_id int, order_index int, kind string, text string"))
    assert sorted(tuple(r) for r in made.collect()) == [(1, 2, "new\n\nlines"), (1, 3, "Figure 3, alone")]


def test_figures_at_one_place_by_their_text(spark):
    rows = [(1, 7, "figure", f"Figure 2, p. 1\n\n{text}") for text in ("b", "c", "a")]
    for given in (rows, rows[::-1]):
        made = editions.figures(spark.createDataFrame(given, "doc_id int, order_index int, kind string, text string").coalesce(1))
        assert [tuple(r) for r in made.collect()] == [(1, 2, "c")]


def test_figures_of_large_turns_and_long_ones(spark, tmp_path):
    lines = lambda name, n: "\n".join(f"{name} {i}" for i in range(n))
    rows = [(1, 3_000_000, lines("large", 6)), (1, 4, lines("small", 6)), (2, -1, lines("before", 6)), (2, -4, lines("earlier", 9)), (3, 3, lines("last", 9)), (3, 1, lines("long", 2500)), (3, None, lines("nowhere", 9)), (4, 0, "short")]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    made = sorted(tuple(r) for r in catalogue.QUERIES["t38_figures"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    assert made == sorted(con.sql(catalogue.ORACLES["t38_figures"]).fetchall()) == [(1, 4, "large 4"), (2, 4, "before 4"), (3, 4, "last 4")]


def test_earliest_of_a_turns_figures(spark, tmp_path):
    rows = [(1, 1, "\n".join(f"line {i}" for i in range(40))), (1, 0, "\n".join(f"other {i}" for i in range(5)))]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert [tuple(r) for r in catalogue.QUERIES["t38_figures"](spark, str(tmp_path)).collect()] == [(1, 4, "line 4")]
