"""Laws of the ranking, relational, vector, upkeep and streaming operators."""

import numpy as np
from pyspark.sql import functions as F

from folioforge.operators import classify, lifecycle, ranking, relational, vectors
from folioforge.streaming import incidents


def ranks(spark, ids):
    return spark.createDataFrame([(x, i + 1) for i, x in enumerate(ids)], "id bigint, rk int")


def test_fusion_counts_a_missing_list_as_nothing(spark):
    fused = {r["id"]: r["score"] for r in ranking.fuse(ranks(spark, [1, 2]), ranks(spark, [2, 3]), "id").collect()}
    assert fused == {1: 1 / 61, 2: 1 / 62 + 0.2 / 61, 3: 0.2 / 62}


def test_diversify_holds_back_and_exempts(spark):
    hits = spark.createDataFrame([(i, "a" if i < 4 else "b", i) for i in range(1, 6)], "id int, doc string, pos int")
    order = lambda df: [r["id"] for r in df.orderBy("held", "pos").collect()] if "held" in df.columns else [r["id"] for r in df.collect()]
    assert order(ranking.diversify(hits, "doc", 2, 5)) == [1, 2, 4, 5, 3]
    assert order(ranking.diversify(hits, "doc", 2, 5, F.col("doc") == "a")) == [1, 2, 3, 4, 5]


def test_exact_first_and_splice(spark):
    rows = ranking.exact_first(ranks(spark, [1, 2, 3]), ranks(spark, [9, 2]), "id", 4).collect()
    assert [r["id"] for r in rows] == [2, 9, 1, 3]
    rows = ranking.splice(ranks(spark, [1, 2, 3, 4]), ranks(spark, [7, 2]), "id").orderBy("pos").collect()
    assert [r["id"] for r in rows] == [1, 2, 3, 7, 4]


def test_scopes_none_and_empty(spark):
    df = spark.range(4)
    none, empty = relational.in_scope(df, "id", [None]), relational.in_scope(df, "id", [spark.range(0)])
    assert none.count() == 4 and empty.count() == 0


def test_upsert_takes_null_keys_as_equal(spark):
    base = spark.createDataFrame([(1, None, "a"), (2, "x", "b")], "k int, l string, v string")
    out = relational.upsert(base, spark.createDataFrame([(1, None, "c")], "k int, l string, v string"), ["k", "l"])
    assert sorted(tuple(r) for r in out.collect()) == [(1, None, "c"), (2, "x", "b")]


def test_edges_merge_by_precedence(spark):
    edges = spark.createDataFrame([(1, 2, 0.9, "near"), (2, 1, 0.5, "cite"), (3, 1, 0.4, "near")], "a int, b int, weight double, kind string")
    assert sorted(tuple(r) for r in relational.merge_edges(edges).collect()) == [(1, 2, 0.9, "cite"), (1, 3, 0.4, "near")]


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(99, [0.0] * 8)], "vec_id bigint, embedding array<float>").repartition(3)
    got = {(r["query_id"], r["rk"]): r["vec_id"] for r in vectors.nearest(df, df, 3).collect()}
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    assert len(got) == 180
    for i in range(60):
        assert [got[i, k] for k in (1, 2, 3)] == list(np.argsort(-s[i])[:3])


def test_connected_parts(spark):
    chain = [(i, i + 1) for i in range(0, 30)] + [(50, 60), (60, 70)]
    parts = dict(lifecycle.connected(spark.createDataFrame(chain, "a bigint, b bigint")).collect())
    assert {parts[i] for i in range(31)} == {0} and {parts[i] for i in (50, 60, 70)} == {50}


def test_markings(spark):
    df = spark.createDataFrame([(1, "SECRET//NOFORN\nbody"), (2, "a SECRET in a sentence"), (3, "(TS) text\n\n(U) more"), (4, "Classification: INTERNAL")], "doc_id int, text string")
    assert [(r["banner"], r["portion"]) for r in classify.markings(df).orderBy("doc_id").collect()] == [("secret", None), (None, None), (None, "top"), ("internal", None)]


def test_stream_equals_batch(spark, sf, tmp_path):
    out = str(tmp_path / "out")
    source = str(tmp_path / "in")
    spark.read.parquet(f"{sf}/events.parquet").repartition(3).write.parquet(source)
    stream = incidents.tumbling(incidents.event_stream(spark, source))
    rows = stream.writeStream.format("memory").queryName("tumbling").outputMode("complete").trigger(availableNow=True).start()
    rows.awaitTermination()
    got = {(r["event_type"], r["start"]): r["n"] for r in spark.table("tumbling").collect()}
    batch = spark.read.parquet(source).groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"), "event_type").count()
    assert got == {(r["event_type"], r["w"]["start"]): r["count"] for r in batch.collect()}
    incidents.run_once(incidents.first_seen(incidents.event_stream(spark, source), "user_id"), out, str(tmp_path / "state"))
    assert spark.read.parquet(out).count() > 0


def test_sessions_and_rates_over_spans_equal_plain_ones(spark):
    import random

    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.randint(0, 40_000)) for _ in range(700)]
    df = spark.createDataFrame(rows, "k string, s bigint").withColumn("ts", F.timestamp_seconds("s"))
    want, counts = [], {}
    for k in "ab":
        times = sorted(s for x, s in rows if x == k)
        run = [times[0]]
        for s in times[1:]:
            if s - run[-1] > 60:
                want.append((k, run[0], run[-1], len(run)))
                run = []
            run.append(s)
        want.append((k, run[0], run[-1], len(run)))
        counts |= {(k, s): sum(s - 60 <= t <= s for t in times) for s in times}
    got = lifecycle.sessions(df, ["k"], "ts", 60).select("k", F.unix_seconds("first"), F.unix_seconds("last"), "n").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    near = lifecycle.preceding(df, "k", "ts", 60).collect()
    assert len(near) == len(rows) and all(r["n"] == counts[r["k"], r["s"]] for r in near)


def test_debounce_absorbs_waits_and_goes_on(spark):
    at = lambda s: F.timestamp_seconds(s)
    events = spark.createDataFrame([("a", s) for s in (0, 5, 9, 10, 11, 40, 41, 100)] + [("b", 3)], "k string, s bigint").withColumn("ts", at("s"))
    busy = spark.createDataFrame([("a", 45, 60), ("a", 60, 70)], "k string, x bigint, y bigint").select("k", at("x").alias("since"), at("y").alias("until"))
    out = lifecycle.debounced(events, "k", "ts", 10, busy).select("k", F.unix_seconds("asked"), F.unix_seconds("due"), "absorbed")
    assert sorted(map(tuple, out.collect())) == [("a", 0, 10, 4), ("a", 11, 21, 1), ("a", 40, 70, 2), ("a", 100, 110, 1), ("b", 3, 13, 1)]
    assert lifecycle.debounced(events, "k", "ts", 10).count() == 5


def test_map_of_last_takes_repeated_keys(spark):
    df = spark.createDataFrame([(1, "x", 5, 1), (1, "x", 6, 2), (1, "y", 7, 1), (1, None, 8, 1)], "g int, k string, v int, o int")
    assert relational.map_of_last(df, "g", "k", "v", F.col("o")).head()["entries"] == {"x": 6, "y": 7}


def test_clusters_are_parts_of_all_pairs(spark):
    rng = np.random.default_rng(5)
    m = np.concatenate([rng.normal(size=6) * 0.2 + rng.normal(size=6) * 2 + rng.normal(size=(9, 6)) * 0.4 for _ in range(5)])
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id bigint, embedding array<double>")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    part = list(range(len(m)))
    for i in range(len(m)):
        for j in range(i):
            if u[i] @ u[j] > 0.9 and part[i] != part[j]:
                a, b = sorted((part[i], part[j]))
                part = [a if p == b else p for p in part]
    want = {i: p if part.count(p) >= 3 else -1 for i, p in enumerate(part)}
    assert {r["vec_id"]: r["cluster"] for r in lifecycle.clusters(df, 0.9, 3).collect()} == want
    assert len(set(want.values())) > 2


def test_numbers_follow_the_order(spark):
    out = ranking.numbered(spark.range(1000).repartition(7).select((F.col("id") * 3).alias("k")), "k").orderBy("k").collect()
    assert [r["n"] for r in out] == list(range(1, 1001))


def test_search_of_all_terms_by_brute_force(spark, tmp_path):
    import random

    from folioforge.functions.stem import lexemes
    from folioforge.operators import lexical

    rng = random.Random(9)
    texts = [" ".join(rng.choice(["cats", "hopping", "stones", "river", "lamp"]) for _ in range(rng.randint(1, 14))) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    question = "the cat hops on a stone"

    def density(text):
        words, wanted = lexemes(text), set(lexemes(question))
        spans = [(i, j) for i in range(len(words)) for j in range(i, len(words)) if wanted <= set(words[i : j + 1])]
        least = [(i, j) for i, j in spans if not any((a, b) != (i, j) and i <= a and b <= j for a, b in spans)]
        return round(sum(len(wanted) / (j - i + 1) for i, j in least), 9)

    want = sorted(((d, -s) for d, t in enumerate(texts) if (s := density(t))), key=lambda x: (x[1], x[0]))
    posted = lexical.postings(docs)
    lexical.store(posted, str(tmp_path / "postings"))
    held = lexical.stored(spark, str(tmp_path / "postings"), question)
    for rows in (posted, held):
        assert [(r["doc_id"], -r["density"]) for r in lexical.search_all(rows, question, 100).collect()] == want
    assert held.count() == sum(len(set(lexemes(t)) & set(lexemes(question))) for t in texts)
    assert [tuple(r) for r in lexical.search(held, question, 9).collect()] == [tuple(r) for r in lexical.search(posted, question, 9).collect()]


def test_pairs_are_counted_in_as_many_tasks_as_they_need(spark, monkeypatch):
    from folioforge.operators import relational

    monkeypatch.setattr(relational, "TASK_PAIRS", 100, raising=False)
    rows = [(g, m) for g in range(60) for m in range(g % 5, 40, 4)]
    want = {}
    for g in range(60):
        held = range(g % 5, 40, 4)
        for a in held:
            for b in held:
                if a < b:
                    want[a, b] = want.get((a, b), 0) + 1
    made = relational.co_members(spark.createDataFrame(rows, "g int, m int"), "g", "m")
    assert made.rdd.getNumPartitions() >= 20
    assert {(r["a"], r["b"]): r["shared"] for r in made.collect()} == want
