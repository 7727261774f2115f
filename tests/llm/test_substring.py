import random

from folioforge.llm import substring

RNG = random.Random(9)


def sentence():
    return " ".join(RNG.choice("abcdefghij") + str(RNG.randint(0, 999)) for _ in range(RNG.randint(5, 12))).capitalize() + "."


def passage(n):
    out = ""
    while len(out.split()) < n:
        out += (" " if out else "") + sentence()
    return out


def cut(text, spans):
    return "".join(c for i, c in enumerate(text) if not any(a <= i < b for a, b in spans))


def test_planted_passages_go_and_first_holders_stay(spark, frame):
    shared = [passage(60) for _ in range(3)]
    texts = {i: "\n".join(passage(30) for _ in range(4)) for i in range(20)}
    texts[3] += "\n" + shared[0] + "\n" + passage(30)
    texts[8] = passage(20) + "\n" + shared[0].upper().lower() + "\n" + passage(20)
    texts[9] = passage(40) + " and so " + shared[1] + " more of it " + passage(30)  # within a line
    texts[12] = "start of it " + shared[1] + " until " + passage(30)
    texts[15] = passage(30) + "\n" + shared[2] + "\n" + passage(30) + "\n" + shared[2]
    rows = substring.repeats(frame(list(texts.items()))).collect()
    spans = {}
    for r in rows:
        spans.setdefault(r["doc_id"], []).append((r["start"], r["end"]))
        assert min(r["first_doc_ids"]) <= r["doc_id"]
    assert set(spans) == {8, 12, 15}
    assert texts[8][min(a for a, _ in spans[8]) : max(b for _, b in spans[8])].split() == shared[0].lower().split()
    assert len(cut(texts[12], spans[12]).split()) <= len(texts[12].split()) - 45
    left = cut(texts[15], spans[15])
    assert left.count(shared[2]) == 1 and left.startswith(texts[15][: texts[15].index(shared[2]) + len(shared[2])])


def test_lines_equal_brute_force(spark, frame):
    """Of whole repeated lines of 25 words or more, all but the first holder's go, offsets exact."""
    pool = [passage(26) for _ in range(15)]
    texts = {i: "\n".join(RNG.sample(pool, 3)) for i in range(12)}
    seen, want = set(), {}
    for i, t in texts.items():
        at = 0
        for line in t.split("\n"):
            if line in seen:
                want.setdefault(i, set()).update(range(at, at + len(line)))
            seen.add(line)
            at += len(line) + 1
    got = {}
    for r in substring.repeats(frame(list(texts.items()))).collect():
        got.setdefault(r["doc_id"], set()).update(range(r["start"], r["end"]))
    for i in texts:
        lines = {x for x in got.get(i, set()) if texts[i][x] != "\n"}
        assert lines == want.get(i, set())


def test_short_lines_equal_brute_force(spark, frame):
    """With line_words 1 and only lines repeated, every repeated line goes but its first, in whatever document."""
    pool = [" ".join(RNG.choice("abcdefgh") + str(RNG.randint(0, 99)) for _ in range(RNG.randint(1, 24))) for _ in range(40)]
    texts = {i: "\n".join(RNG.sample(pool, RNG.randint(1, 6))) for i in range(30)}
    seen, want = set(), {}
    for i, t in texts.items():
        want[i] = "\n".join("" if line in seen else line for line in t.split("\n"))
        seen.update(t.split("\n"))
    docs = frame(list(texts.items()))
    spans = substring.repeats(docs, line_words=1, min_words=1000)
    lines = lambda t: [x for x in t.split("\n") if x.strip()]
    out = {r["doc_id"]: r["text"] for r in substring.remove(docs, spans).collect()}
    assert {i: lines(t) for i, t in out.items()} == {i: lines(t) for i, t in want.items()}


def test_text_outside_the_spans_stays(spark, frame):
    p = passage(60)
    rows = [(1, p), (2, "Head\n\n  indented code\n\n\n" + p + "\n\n\n  Para two.  ")]
    docs = frame(rows)
    out = {r["doc_id"]: (r["text"], r["n_chars"]) for r in substring.remove(docs, substring.repeats(docs)).collect()}
    left = "Head\n\n  indented code\n\n\n\n\n\n  Para two.  "
    assert out == {1: (p, len(p)), 2: (left, len(left))}


def test_edges(spark, frame, clashing):
    p = passage(60)
    rows = [(1, None), (2, ""), (3, "short"), (4, p), (4, p), (5, p + "\nrest of five"), (None, p), (6, "word " * 5000), (7, "x" * 100_000)]
    docs = clashing(frame(rows))
    spans = substring.repeats(docs)
    assert {r["doc_id"] for r in spans.collect()} >= {5, None}
    out = {(r["doc_id"], r["text"]) for r in substring.remove(docs, spans).collect()}
    assert (4, p) in out and (5, "\nrest of five") in out and (1, None) in out and (2, "") in out and (3, "short") in out and (None, "") in out
    assert substring.remove(docs, spans).columns == docs.columns
    assert substring.repeats(frame(rows).limit(0)).count() == 0
