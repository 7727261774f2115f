import random
import re
from itertools import permutations

import numpy as np

from folioforge.llm import interactions, queries
from folioforge.tables import table


def plain(docs, labels):
    """(part, order, step) -> counts, by applying every order to every document in turn."""
    firsts, marks = {}, {}
    for d, t, s in docs:
        t = t or ""
        if d is not None:
            firsts[t] = min(d, firsts.get(t, d))
    for d, q, x in labels:
        was = marks.get(d, (False, False))
        marks[d] = (was[0] or q == 1, was[1] or x == 1)
    rows = []
    for d, t, s in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": d is not None and d > firsts[t],
        }
        rows.append((s or "", fails, *(marks.get(d, (False, False)) if d is not None else (False, False))))
    out, shapley = {}, {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in map("".join, permutations("ABCDE")):
            alive = own
            for step, f in enumerate(order, 1):
                gone = [r for r in alive if r[1][f]]
                alive = [r for r in alive if not r[1][f]]
                failing = [r for r in own if r[1][f]]
                alone = sum(sum(r[1].values()) == 1 for r in failing)
                out[part, order, step] = [len(alive), len(gone), len(failing) - len(gone), alone, sum(r[2] for r in gone), sum(r[3] for r in gone)]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(docs, labels):
    columns = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    rows = interactions.audit(interactions.text_flags(docs, labels), list("ABCDE"), ["good", "toxic"]).collect()
    out = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in columns) for r in rows}
    assert len(out) == len(rows)
    return out


def texts(n, seed=3):
    random.seed(seed)
    out = []
    for i in range(n):
        words = [random.choice(["alpha", "Beta", "C", "d#", "e", "f"] if i % 3 else [f"w{j}" for j in range(300)]) for _ in range(random.choice([0, 5, 150, 199, 200, 260]))]
        out.append(random.choice([" ", "\n", "\t \x0b"]).join(words))
    return out


def test_every_order_equals_plain_application(spark, frame, clashing):
    random.seed(1)
    t = texts(60)
    t += [t[5], t[5], t[7], "", None, "É" * 150 + "A" * 4, "a" * 147 + "A" * 3]
    docs = [(i * 3 % 70, x, random.choice(["web", "books", "", None])) for i, x in enumerate(t)]
    docs += [docs[4], (None, t[5], "web"), (None, None, None)]
    labels = [(d, random.randint(0, 1), random.randint(0, 1)) for d in range(0, 70, 2)] + [(4, 1, 0), (None, 1, 1), (6, None, None)]
    df = frame([(d, x, "en", s) for d, x, s in docs])
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    want = plain(docs, labels)
    assert audited(df, marks) == want
    renamed = {"part": "_part", "id": "_id", "A": "_a"}
    assert audited(clashing(df).withColumnsRenamed(renamed), marks) == want
    assert len({k[0] for k in want}) == 3 and len(want) == 3 * 600


def test_empty_tables(spark, frame):
    marks = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert audited(frame([]), marks) == {}
    one = audited(frame([(1, "", "en", "s")]), marks)
    assert len(one) == 600 and one["s", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120)


def test_very_long_text_and_a_hot_part(spark, frame):
    long = "word " * 400_000
    docs = [(i, long if i == 0 else f"t{i}", "hot" if i % 10 else f"p{i}") for i in range(500)]
    got = audited(frame([(d, t, "en", s) for d, t, s in docs], partitions=7), spark.createDataFrame([(0, 1, 0)], "doc_id bigint, quality int, toxic int"))
    assert got == plain(docs, [(0, 1, 0)])


def test_packed_parts_begin_at_bytes():
    random.seed(2)
    parts = np.array([random.choice("abcd") for _ in range(1000)], object)
    flags = [np.array([random.random() < p for _ in parts]) for p in (0.1, 0.5, 0.9)]
    names, begins, sets = interactions.packed(parts, flags)
    ends = [*begins[1:], len(sets[0])]
    for name, a, b in zip(names, begins, ends):
        for flag, bits in zip([np.ones(1000, bool), *flags], sets):
            assert np.bitwise_count(bits[a:b]).sum() == flag[parts == name].sum()


def test_small_indexes_add_up(spark, frame):
    rows = frame([(i, None, "en", f"s{i % 3}") for i in range(200)]).selectExpr("source part", "doc_id % 2 = 0 x", "doc_id % 3 = 0 y", "if(doc_id % 5 = 0, null, doc_id % 7 = 0) z")
    whole = {tuple(r) for r in interactions.audit(rows, ["x", "y"], ["z"]).collect()}
    assert whole == {tuple(r) for r in interactions.audit(rows, ["x", "y"], ["z"], index_rows=9).collect()}
    assert len(whole) == 3 * 2 * 2


def test_query_reads_all_documents(spark, sf):
    rows = queries.op11_filter_audit(spark, sf).where("filter_order = 'ABCDE' and step = 1")
    assert rows.selectExpr("sum(kept + removed)").head()[0] == table(spark, sf, "documents").count()
