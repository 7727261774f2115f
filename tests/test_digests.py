import hashlib

import pytest

from folioforge.operators import digests


def frame(spark, rows):
    return spark.createDataFrame(rows, "part string, key bigint, digest string").repartition(3)


def plain(rows, digits):
    """Nodes by hand: {(level, part, node): (n, digest)}."""
    sha = lambda lines: hashlib.sha256("\n".join(sorted(lines)).encode()).hexdigest()
    leaf = {}
    for p, k, d in rows:
        line = f"{'' if k is None else k}\t{d or ''}"
        cell = leaf.setdefault((p or "", hashlib.md5(line.encode()).hexdigest()[: digits // 4]), {})
        cell[line] = cell.get(line, 0) + 1
    level = {key: (sum(c.values()), sha(f"{line}\t{n}" for line, n in c.items())) for key, c in leaf.items()}
    out = {}
    for at in range(digits // 4, -1, -1):
        out |= {(at, *key): v for key, v in level.items()}
        groups = {}
        for (p, node), (n, d) in level.items():
            groups.setdefault((p, node[: at - 1] if at else ""), []).append((n, f"{node}\t{d}"))
        level = {key: (sum(n for n, _ in v), sha(x for _, x in v)) for key, v in groups.items()}
    return out


ROWS = [(f"p{i % 3}" if i % 7 else None, i // 2 if i % 11 else None, f"d{i % 5}" if i % 13 else None) for i in range(300)]


@pytest.mark.parametrize("digits", [0, 4, 12])
def test_every_node_equals_the_plain_tree(spark, digits):
    got = {(r["level"], r["part"], r["node"]): (r["n"], r["digest"]) for r in digests.tree(frame(spark, ROWS), digits).collect()}
    assert got == plain(ROWS, digits)


def test_depth_follows_the_rows():
    assert [digests.depth_for(n) for n in (0, 1024, 1025, 16384, 16385, 10**9)] == [0, 0, 4, 4, 8, 20]


def test_changed_rows_are_found_by_descent(spark):
    old = [("p", i, f"d{i}") for i in range(200)] + [("q", 1, "x"), ("p", 300, "twice"), ("p", 300, "twice")]
    new = [("p", i, f"d{i}" if i != 77 else "other") for i in range(200) if i != 5] + [("p", 900, "new"), ("p", 300, "twice"), ("r", 2, None)]
    got = {(r["part"], r["key"], r["state"]) for r in digests.changed_rows(frame(spark, old), frame(spark, new), 8).collect()}
    assert got == {("p", "77", "changed"), ("p", "5", "missing"), ("p", "900", "added"), ("p", "300", "missing"), ("q", "1", "missing"), ("r", "2", "added")}
    nodes = digests.differing(digests.tree(frame(spark, old), 8), digests.tree(frame(spark, new), 8)).where("part = 'p'").count()
    assert nodes <= 5
    assert digests.changed_rows(frame(spark, old), frame(spark, old), 8).count() == 0


def test_empty_tables(spark):
    none = frame(spark, []).limit(0)
    assert digests.tree(none).count() == 0 and digests.changed_rows(none, none, 4).count() == 0
    assert [r["state"] for r in digests.changed_rows(none, frame(spark, [("p", 1, "a")]), 4).collect()] == ["added"]
