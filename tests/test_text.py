"""Behaviour of the text functions, structure and record sources on small fixtures."""

import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioforge.functions import text as tx
from folioforge.operators import chunking, references
from folioforge.sources import html, records


@pytest.mark.parametrize(
    ("query", "terms"),
    [
        ("what does O_DIRECT do", ["O_DIRECT"]),
        ("git commit --no-verify", ["--no-verify"]),
        ("see RFC 7231 for this", ["RFC 7231"]),
        ("where is getElementById called", ["getElementById"]),
        ("how does an SSTable work", ["SSTable"]),
        ('meaning of "write amplification" here', ["write amplification"]),
        ("fsync", ["fsync"]),
        ("TLS", ["TLS"]),
        ("how do caches work in practice", []),
        ("why is the kernel slow", []),
    ],
)
def test_literal_terms(spark, query, terms):
    assert one(spark, tx.literal_terms(F.col("q")), q=query) == terms


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if all(v is not None for v in values.values()) else spark.range(1).select(*[F.lit(v).cast("string").alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).head()["x"]


def test_back_matter(spark):
    for path, expected in (("Part › References (cont. 2)", True), ("A > Appendix A. Bibliography", True), ("Index", True), ("Indexing", False), (None, False)):
        assert one(spark, tx.is_back_matter(F.col("p")), p=path) is expected


def test_incident_key(spark):
    a = one(spark, tx.incident_key(F.col("m")), m="job 17 failed at /srv/a/b.txt with 'x y' 0")
    b = one(spark, tx.incident_key(F.col("m")), m="job 4 failed at /var/c with 'z' 12")
    assert a == b == "job N failed at <path> with '…' N"


def test_anchored(spark):
    body = "The cache keeps the last hundred entries, and drops the oldest first."
    for quote, expected in (("keeps the last hundred entries", True), ("two words", False), ("nothing of this stands there at all", False), ("the cache drops the oldest entries first", True)):
        assert one(spark, tx.anchored(F.col("q"), F.lit(body)), q=quote) is expected


def test_clip(spark):
    assert one(spark, tx.clip(F.col("t"), 20), t="short") == "short"
    assert one(spark, tx.clip(F.col("t"), 20), t="First part is. Second part runs on") == "First part is.…"
    assert one(spark, tx.clip(F.col("t"), 12), t="alpha beta gamma") == "alpha beta…"


def test_references(spark):
    text = "Body\nReferences\n[1] Ann Author. A work on caches, 2001. 10.1000/abc\n[2] Bob Writer. Another long work, 2003.\n[3] Cy Third. One more entry, 2005."
    rows = references.entries(spark.createDataFrame([(1, text), (2, "References\n[1] Too few of them here, really")], "doc_id bigint, text string")).orderBy("pos").collect()
    assert [(r["doc_id"], r["pos"], r["doi"]) for r in rows] == [(1, 1, "10.1000/abc"), (1, 2, None), (1, 3, None)]


def test_word_similarity():
    assert references.word_similarity("deep residual learning", "He K. Deep Residual Learning. CVPR 2016") == 1.0
    assert references.word_similarity("deep residual learning", "a wholly different title") < 0.4


def test_headings_and_sections():
    body = "word " * 60
    text = "\n\n".join(f"{n}. {t}\n{body}" for n, t in ((1, "Introduction"), (2, "Related Work"), (3, "Results")))
    found = chunking.sections(text)
    assert [s[0] for s in found] == ["1 Introduction", "2 Related Work", "3 Results"]
    assert found[-1][3] == len(text)
    assert [s[4] for s in chunking.sections("# Top\n" + body + "\n## Sub\n" + body)] == ["Top", "Top › Sub"]
    assert chunking.sections("  \n ") == []


@given(st.lists(st.sampled_from(["word", "Some words.", "More of it!", "\n\n", "x" * 30]), max_size=400))
def test_passages_cover_every_word(parts):
    text = chunking.normalise(" ".join(parts))
    covered = set()
    for _, _, a, b, n in chunking.passages(text):
        assert 0 <= a < b <= len(text) and n <= 2 * chunking.TARGET_TOKENS
        covered.update(range(a, b))
    assert all(i in covered or c.isspace() for i, c in enumerate(text))


def test_structure_in_detail():
    para = "Some words of a paragraph. " * 40
    text = "A preface of some length. " * 20 + "\n# One\n" + para + "\n```\n# no heading\n```\n## Two\nshort\n## Three\n" + para + "\n# Four\n" + para
    assert [(t, p) for t, _, _, _, p in chunking.sections(text)] == [("Front matter", "Front matter"), ("One", "One"), ("Three", "One › Three"), ("Four", "Four")]
    long = "\n\n".join("x" * 2500 for _ in range(6))
    assert [(t, b - a) for t, _, a, b, _ in chunking.sections("# T\n" + long)] == [("T", 7510), ("T (cont. 2)", 7504)]
    whole = "# T\n" + "y" * 20_000
    spans = [(a, b) for _, _, a, b, _ in chunking.sections(whole)]
    assert [b - a for a, b in spans] == [6000, 6000, 6000, 2004] and spans[-1][1] == len(whole)
    assert chunking.headings("PREFACE\nSECOND\nTHIRDS\n" + para) == []  # closer than the gap


def test_located_and_pages(spark):
    text = "Contents\nThe Long Way Home Again\n\n1.2 The long  way home\nbody\nThe Long Way Home Again and more\n  3. A (b) c.\n"
    find = lambda title, hint=None: one(spark, chunking.located(F.col("t"), F.lit(title), None if hint is None else F.lit(hint)), t=text)
    assert find("The Long Way Home") == 9 and find("A (b) c.") == text.index("  3.") and find("nowhere") == -1
    assert find("The Long Way Home of all others") == 9
    far = "\n".join(["Intro"] + ["x" * 50] * 100 + ["Intro"])
    assert one(spark, chunking.located(F.col("t"), F.lit("Intro"), F.lit(2000)), t=far) == far.rindex("Intro")
    assert [one(spark, chunking.page_of(F.lit(o), F.col("s")), s=[0, 10, 25]) for o in (0, 9, 10, 24, 99)] == [1, 1, 2, 2, 3]


def test_document_as_read(spark):
    body = " ".join(f"word{i}." if i % 9 == 0 else f"Word{i}" for i in range(3000))
    text = "# One\n\n" + body + "\n\n# Two\n\nA few more words of the end, " + "which go on for a while, " * 8
    made = chunking.chunks(spark.createDataFrame([(1, text)], "doc_id bigint, text string"))
    clean = chunking.normalise(text)
    got = {r["section"]: r["text"] for r in chunking.as_read(made).collect()}
    assert made.count() > 3 and "".join(" ".join(got[k] for k in sorted(got)).split()) == "".join(clean.split())


def test_chunks_spans_and_overlap_by_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    made = chunking.chunks(docs).orderBy("doc_id", "order_index").collect()
    texts = {r["doc_id"]: chunking.normalise(r["text"] or "") for r in docs.collect()}
    cut = {(r["doc_id"], r["order_index"]): r["text"] for r in chunking.without_overlap(chunking.chunks(docs)).collect()}
    before = {}
    for r in made:
        assert r["text"] == texts[r["doc_id"]][r["char_start"] : r["char_end"]]
        assert r["n_tokens"] == len(re.findall(r"\w+|[^\w\s]", r["text"]))
        words, last = r["text"].split(), before.get(r["doc_id"], [])
        n = next((n for n in range(min(400, len(words), len(last)), 7, -1) if last[-n:] == words[:n]), 0)
        assert cut[r["doc_id"], r["order_index"]].split() == words[n:]
        before[r["doc_id"]] = words
    for d, text in texts.items():
        covered = sorted((r["char_start"], r["char_end"]) for r in made if r["doc_id"] == d)
        at = 0
        for a, b in covered:
            assert not text[at:a].strip()
            at = max(at, b)
        assert not text[at:].strip()


def test_normalise():
    assert chunking.normalise("contex-\ntual ﬁle\x00 a\nb\n\n\n\nc") == "contextual file a b\n\nc"


def test_html():
    page = "<html><head><title>Page - Site</title></head><body><nav>menu</nav><article><h1>Head</h1><p>One  two</p><ul><li>a<li>b</ul><pre>x = 1\ny</pre></article></body></html>"
    assert html.markdown(page) == "# Head\n\nOne two\n\n- a\n\n- b\n\n```\n\nx = 1\ny\n\n```"
    assert html.markdown(None) == ""


def test_record_sources(spark):
    df = spark.createDataFrame([('{"items": [{"a": "x", "t": 0}, {"a": "y", "t": 86400}]}',)], "j string")
    rows = records.json_rows(df, "j", "items")
    lines = rows.select(records.line(F.col("row"), "{a|upper} on {t|date} {b|default:none}").alias("l")).collect()
    assert [r["l"] for r in lines] == ["X on 1970-01-01 none", "Y on 1970-01-02 none"]
    assert records.summary(rows, "row", "{count} rows, {distinct:a} names, {sum:t}").head()["summary"] == "2 rows, 2 names, 86400.0"
    csv = spark.createDataFrame([("host,os\na,linux\nb,bsd\n",)], "c string")
    assert [tuple(r) for r in records.csv_rows(csv, "c", ["host", "os"]).select("host", "os").collect()] == [("a", "linux"), ("b", "bsd")]
    xml = spark.createDataFrame([("<channel><item><title>T</title></item><item><title>U</title></item></channel>",), ("<!DOCTYPE x><channel><item/></channel>",)], "x string")
    assert [r["title"] for r in records.xml_rows(xml, "x", "item", ["title"]).collect()] == ["T", "U"]


def test_stems():
    from folioforge.functions.stem import lexemes, stem

    pairs = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop", "falling": "fall", "happy": "happi", "relational": "relat", "triplicate": "triplic", "hopeful": "hope", "revival": "reviv", "adoption": "adopt", "probate": "probat", "rate": "rate", "controll": "control"}
    assert {w: stem(w) for w in pairs} == pairs
    assert lexemes("The cats, and the hopping") == ["cat", "hop"]


def test_guards(spark):
    from folioforge.functions import guards

    rows = spark.createDataFrame([("So [1, 4] and [9], see [2].",), ("none",), (None,)], "t string")
    assert [r[0] for r in rows.select(guards.valid_citations(F.col("t"), 3)).collect()] == ["So [1] and, see [2].", "none", ""]
    parts = spark.createDataFrame([(["aa", "bb", "c" * 9, "dd"],)], "p array<string>").select(guards.parts(F.col("p"), 6)).head()[0]
    assert parts == ["aa\n\nbb", "c" * 6, "dd"]
    assert spark.range(1).select(guards.echoes(F.lit("what each side claims and why they cannot both hold"), F.lit("Say What each side claims and why they cannot both hold."))).head()[0] is True


def test_runs_are_cut_out_only_where_their_ends_meet(spark):
    """The longest run of 8 to 400 words that ends the passage before; the ends are compared first."""
    from folioforge.operators import chunking

    a = [f"w{i}" for i in range(20)]
    texts = [a, a[-10:] + ["new"], ["new", *["x"] * 9], ["x"] * 12, a[:7], a[:7] + ["more"]]
    rows = spark.createDataFrame([(1, i, " ".join(t)) for i, t in enumerate(texts)], "doc_id int, order_index int, text string")
    made = chunking.without_overlap(rows)
    want = [" ".join(a), "new", " ".join(texts[2]), "x x x", " ".join(a[:7]), " ".join(texts[5])]
    assert [r["text"] for r in made.orderBy("order_index").collect()] == want
    plan = made._jdf.queryExecution().analyzed().toString()
    assert "THEN (slice(" in plan
