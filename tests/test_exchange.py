"""Review packets against plain rules; paged sources in every style, over stored answers and over HTTP on this machine."""

import json
import threading
import uuid
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from folioforge.operators import reviews
from folioforge.sources import paging

CASES = "case_id bigint, question string, source string, judge string, pooled array<string>, model_marks string"


def packet(spark):
    cases = spark.createDataFrame([
        (1, "Où est-ce ?", "ask", "model", ["a", "gone", "b", "a"], "m1"), (2, "mine", "ask", "human", ["a"], None),
        (3, None, "ask", "model", ["a"], None), (4, "empty", "ask", "model", [], None), (5, "Later", "chat", "model", ["b"], "m5"), (6, "no pool", "ask", "model", None, None),
    ], CASES)
    passages = spark.createDataFrame([("a", "T", " x \n y "), ("b", None, "z" * 3000), ("c", "U", None)], "chunk_id string, title string, text string")
    return cases, reviews.packet(cases, passages)


def test_packet_is_blind_and_labelled_in_order(spark):
    _, items = packet(spark)
    assert not {"judge", "model_marks", "case_id"} & set(items.columns)
    rows = items.where("question like 'O%'").orderBy("label").collect()
    assert [(r.label, r.chunk_id) for r in rows] == [("P1", "a"), ("P2", "b"), ("P3", "a")]
    assert rows[0].id == uuid.uuid5(uuid.NAMESPACE_URL, "Où est-ce ?").hex[:12]
    assert rows[0].text == "x y" and len(rows[1].text) == 2000
    assert {r.question for r in items.collect()} == {"Où est-ce ?", "Later"}


def answers(spark, rows):
    return spark.createDataFrame(rows, "place int, id string, type string, unanswerable boolean, supporting array<string>, distractors array<string>, notes string")


def test_answers_become_cases(spark):
    cases, items = packet(spark)
    first, later = (reviews.item_id(F.lit(q)) for q in ("Où est-ce ?", "Later"))
    a, b = spark.range(1).select(first, later).first()
    given = answers(spark, [
        (1, a, "negation", False, ["P2", "P9"], ["P1", "P2", "x"], "n" * 600), (2, b, "nonsense", None, ["P1"], None, None),
        (3, "none", "concept", False, ["P1"], [], None), (4, b, None, True, ["P1"], ["P1"], "last"), (5, None, None, None, None, None, None),
    ])
    rows = reviews.answered(given, items, cases, " Human ")
    assert rows.orderBy("place").select("outcome", "unknown_labels", "type").collect() == [("saved", 2, "negation"), ("saved", 0, "concept"), ("unknown", 0, "unanswerable"), ("saved", 0, "unanswerable"), ("unknown", 0, "unanswerable")]
    kept = {r.id: r for r in reviews.saved_cases(rows).collect()}
    assert set(kept) == {a, b}
    assert kept[a].supporting == ["b"] and kept[a].distractors == ["a"] and kept[a].pooled == ["a", "b", "a"] and len(kept[a].notes) == 500
    assert kept[a].judge == "human-reviewer" and kept[a].model_marks == "m1" and kept[a].replaces == 1
    assert kept[b].supporting == [] and kept[b].distractors == ["b"] and kept[b].notes == "last"
    assert tuple(reviews.tally(rows).first()) == (3, 2, 2)


def test_the_owners_judgement_stands(spark):
    cases, items = packet(spark)
    since = cases.unionByName(spark.createDataFrame([(9, "  LATER ", "ask", "human", ["b"], None)], CASES))
    b = spark.range(1).select(reviews.item_id(F.lit("Later"))).first()[0]
    rows = reviews.answered(answers(spark, [(1, b, "concept", False, ["P1", "P7"], [], None)]), items, since, None)
    assert tuple(reviews.tally(rows).first()) == (0, 1, 1) and reviews.saved_cases(rows).count() == 0
    assert tuple(reviews.tally(rows.limit(0)).first()) == (0, 0, 0)


def body(ids, after=None):
    return json.dumps({"items": [{"id": i} for i in ids], "next": after})


def endpoints(spark, *keys):
    return spark.createDataFrame([(k, f"http://h.invalid/{k}/list") for k in keys], "key string, url string")


def run(spark, answers, style, *keys, **more):
    held = spark.createDataFrame(answers, "key string, token string, body string, link string")
    got = paging.calls(endpoints(spark, *keys), paging.stored(held), style, "items", **more)
    return sorted((r.key, r.page, r.token, r.n, r.error) for r in got.collect())


def test_numbered_pages_end_at_a_short_one(spark):
    held = [("a", "1", body([1, 2]), None), ("a", "2", body([3]), None), ("a", "3", body([4]), None), ("b", "1", body([]), None), ("c", "1", "no json", None), ("d", "1", body([1, 2]), None)]
    assert run(spark, held, "page", *"abcd", size=2) == [("a", 1, "1", 2, None), ("a", 2, "2", 1, None), ("b", 1, "1", 0, None), ("c", 1, "1", 0, None), ("d", 1, "1", 2, None), ("d", 2, "2", 0, "no answer")]
    assert run(spark, held, "page", "a", limit=2) == [("a", 1, "1", 2, None)]
    assert run(spark, held, "none", "a") == [("a", 1, None, 0, "no answer")]


def test_offsets_step_by_size_or_by_rows_had(spark):
    held = [("a", "0", body([1, 2]), None), ("a", "2", body([3, 4, 5]), None), ("a", "5", body([]), None), ("a", "4", body([9]), None)]
    assert [r[2] for r in run(spark, held, "offset", "a", first=0)] == ["0", "2", "5"]
    assert [r[2] for r in run(spark, held, "offset", "a", first=0, size=2)] == ["0", "2", "4"]


def test_cursors_end_at_ten_pages_whatever_is_asked(spark):
    held = [("a", None, body([0], "c1"), None)] + [("a", f"c{i}", body([i], f"c{i + 1}"), None) for i in range(1, 30)] + [("b", None, body([1], ""), None)]
    got = run(spark, held, "cursor", "a", "b", limit=1000, pages=99, cursor_path="next")
    assert [r[0] for r in got].count("a") == 10 and [r[0] for r in got].count("b") == 1


def test_links_stay_on_their_host(spark):
    u = "http://h.invalid/%s/list"
    held = [
        ("a", u % "a", body([1]), "?page=2"), ("a", u % "a" + "?page=2", body([2]), "/a/more"), ("a", "http://h.invalid/a/more", body([3]), "last"), ("a", "http://h.invalid/a/last", body([4]), None),
        ("b", u % "b", body([1]), "https://elsewhere.invalid/x"),
    ]
    got = run(spark, held, "link", "a", "b")
    assert [r[2] for r in got if r[0] == "a"] == [u % "a", u % "a" + "?page=2", "http://h.invalid/a/more", "http://h.invalid/a/last"]
    assert [r[1:] for r in got if r[0] == "b"] == [(1, u % "b", 1, "off host")]


def test_large_answers_and_no_endpoint(spark):
    held = [("a", None, body(list(range(100))), None)]
    assert run(spark, held, "none", "a", most_bytes=50) == [("a", 1, None, 0, "too large")]
    assert run(spark, held, "page") == []
    with pytest.raises(ValueError):
        run(spark, held, "sideways", "a")


def test_over_http(spark):
    class Pages(BaseHTTPRequestHandler):
        def do_GET(self):
            page = int(self.path.split("page=")[1].split("&")[0]) if "page=" in self.path else 1
            self.send_response(302 if "moved" in self.path else 200)
            if "moved" in self.path:
                self.send_header("Location", "/list")
            if page < 3:
                self.send_header("Link", f'</list?page={page + 1}>; rel="next", </list>; rel="first"')
            self.end_headers()
            self.wfile.write(body([page * 10, page * 10 + 1] if page < 3 else [30]).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    try:
        both = spark.createDataFrame([("a", base + "/list"), ("b", base + "/moved"), ("c", "file:///etc/hosts")], "key string, url string")
        numbered = paging.calls(both, paging.over_http("page", "size", 2), "page", "items", size=2)
        ids = paging.rows(numbered, "items").select("key", F.get_json_object("row", "$.id").cast("int").alias("id"))
        assert sorted(tuple(r) for r in ids.collect()) == [("a", 10), ("a", 11), ("a", 20), ("a", 21), ("a", 30)]
        assert {(r.key, r.error) for r in numbered.where("error is not null").collect()} == {("b", "no answer"), ("c", "no answer")}
        linked = paging.calls(both.where("key = 'a'"), paging.over_http(), "link", "items")
        assert [r.n for r in linked.orderBy("page").collect()] == [2, 2, 1]
    finally:
        server.shutdown()
