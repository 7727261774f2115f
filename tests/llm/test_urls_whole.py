import pytest

from folioforge.llm import urls


def test_distrust_reaches_far_hosts(spark):
    """A chain of 14 links to a blocked seed: distrust is 0.85 ** 14 at its end, above the threshold."""
    names = [f"h{i}.example.edu" for i in range(15)]
    rows = [(i, f"http://{names[i]}/", f'<a href="http://{names[i + 1]}/">next</a>') for i in range(14)] + [(14, f"http://{names[14]}/x", "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r["page_id"]: r for r in urls.judge(pages, [("block", names[14], "/")]).collect()}
    assert all(got[i]["distrust"] == pytest.approx(0.85 ** (14 - i), abs=1e-8) and got[i]["verdict"] == "block" for i in range(15))


def test_circles_converge(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("b", "a", 1)], "src string, dst string, n bigint")
    got = {r["host"]: r["mass"] for r in urls.propagate(edges, spark.createDataFrame([("a",)], "host string"), None).collect()}
    assert got == pytest.approx({"a": 1 / (1 - 0.85**2), "b": 0.85 / (1 - 0.85**2)}, abs=1e-7)


def test_propagation_over_many_hosts_in_bounded_space(spark):
    """A circle of hosts, a hub and chance links: equal to power iteration, and no more tables in the shared folder than FOLD rounds need."""
    import os

    import numpy as np

    from folioforge.session import shared_dir

    n, rng = 3000, np.random.default_rng(3)
    links = {(i, (i + 1) % n): 1 for i in range(n)}
    for a, b in rng.integers(0, n, (6000, 2)).tolist() + [[i, 0] for i in range(1, n, 3)]:
        if a != b:
            links[a, b] = links.get((a, b), 0) + 1
    edges = spark.createDataFrame([(f"h{a}", f"h{b}", k) for (a, b), k in links.items()], "src string, dst string, n bigint")
    seeds = spark.createDataFrame([(f"h{i}",) for i in range(0, n, 50)], "host string")
    folder = shared_dir(spark).removeprefix("file:")
    most, before, write = [0], set(os.listdir(folder)), urls.materialise

    def counted(*a, **k):
        out = write(*a, **k)
        most[0] = max(most[0], len(set(os.listdir(folder)) - before))
        return out

    urls.materialise = counted
    try:
        mass = urls.propagate(edges, seeds, None, damping=0.4)
        got = {r["host"]: r["mass"] for r in mass.collect()}
    finally:
        urls.materialise = write
    share = np.zeros((n, n))
    for (a, b), k in links.items():
        share[b, a] = k
    share *= 0.4 / share.sum(axis=0)
    want = moving = np.isin(np.arange(n), np.arange(0, n, 50)).astype(float)
    for _ in range(200):
        moving = share @ moving
        want = want + moving
    assert all(abs(got.get(f"h{i}", 0) - want[i]) < 1e-8 for i in range(n))
    assert most[0] <= urls.FOLD + 4 and len(set(os.listdir(folder)) - before) == 1
