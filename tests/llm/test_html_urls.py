import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioforge.llm import html_text, urls

LONG = "A long enough paragraph of the article, with commas, clauses, and more words than a menu would have."


def page(body, head="<title>Site - Page</title>"):
    return f"<!DOCTYPE html><html><head>{head}<style>p{{margin:0}}</style><script>var t='</p><p>no';</script></head><body>{body}</body></html>"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("just text &amp; more", "just text & more"),
        (page(f"<nav><ul><li><a href='/a'>Menu</a></ul></nav><article><h1>Head</h1><p>{LONG}<p>Second   one,\n {LONG}</article><footer>&copy; foot</footer>"), f"Head\n{LONG}\nSecond one, {LONG}"),
        (page(f"<div id=sidebar><p>{LONG}</p></div><div class=content><p>{LONG}</p><p>Short.</p></div><div class='comments'><p>{LONG} says a reader</p></div>"), f"{LONG}\nShort."),
        (page(f"<header><h2>Site</h2></header><div class='cookie-notice'>{LONG}</div><main><p>{LONG}<form><p>{LONG}</p><input></form><aside>{LONG}</aside><p>End &lt;b&gt; &nbsp; x</main>"), f"{LONG}\nEnd <b> x"),
        (page(f"<article><p><b>{LONG}<br><p>Next, {LONG}</p></article>"), f"{LONG}\nNext, {LONG}"),
        (page(f"<article><p>One <!-- <p>hidden</p> --> two, {LONG}</p><div hidden><p>{LONG}</p></div><pre>a\n  b</pre></article>"), f"One two, {LONG}\na b"),
        (page(f"<div><p>{LONG}</p><p>{LONG}</p></div><div><p>{LONG}</p></div><ul><li><a href=x>{LONG}</a></li></ul>"), f"{LONG}\n{LONG}\n{LONG}"),
        (page(f"<div class='article-header'><p>{LONG}</p></div><div class=article-body><p>{LONG}</p><div class='entry-footer'>{LONG}</div></div><section id=usercomments><p>{LONG}</p></section><div class=article-comments><p>{LONG}</p></div>"), f"{LONG}\n{LONG}"),
        (page("<article><h1>T</h1><p>To.</p></article>"), "T\nTo."),
        (page(f"<article><p>{LONG}</article><div class=ad><p>{LONG}"), LONG),
    ],
)
def test_extract(html, text):
    assert html_text.extract(html) == text


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class=x>", "</div>", "<li>", "<ul>", "</ul>", "<b", ">", "text, more ", "<script>", "</script>", "<!--", "-->", "<td>", "&amp;", "<a href='", "'>", "<article>", "</article>"]), max_size=40))
def test_any_markup_is_taken(parts):
    out = html_text.extract("".join(parts))
    assert all(line and line == line.strip() for line in out.split("\n")) or out == ""


def test_html_edges(spark):
    rows = [(1, None), (2, ""), (3, page(f"<article><p>{LONG}</p></article>")), (3, page(f"<article><p>{LONG}</p></article>")), (4, "<p>" * 2000 + "deep"), (5, "<div>" * 5000 + "deep" + "x" * 500_000 + "</div>" * 5000)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id bigint, html string, text string, n_chars string")
    got = html_text.main_text(df, keep=["page_id"]).collect()
    assert {(r["page_id"], r["n_chars"]) for r in got} == {(1, 0), (2, 0), (3, len(LONG)), (4, 4), (5, 500_004)} and len(got) == 6
    assert html_text.main_text(df.limit(0)).count() == 0


def by_hand(url, rules):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, default=None)


def test_hosts_and_rules(spark):
    cases = ["http://A.Example.NET/en/x?y=/de/", "https://example.net", "http://x.net/", "http://notexample.com/de/1", "ftp://a.example.com/de/#f", "http://w.org/fr/", "http://w.org/en/", None, "nothing", "http://ÄÉ.org/fr/a", "http://h?q=://z.net/", "a://b://c.net/", "http://net/q"]
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(cases)], "page_id bigint, url string, html string")
    for r in urls.judge(df).collect():
        host, path, best = by_hand(cases[r["page_id"]], urls.RULES)
        assert (r["host"], r["path"], r["rule"]) == (host, path, best[1] if best else None)
        if best:
            assert r["verdict"] == best[2]
    assert urls.judge(df.limit(0)).count() == 0


def test_propagation_equals_power_iteration(spark):
    edges = {("a", "b"): 2, ("a", "c"): 1, ("b", "c"): 1, ("c", "a"): 3, ("d", "c"): 1, ("c", "d"): 1}
    df = spark.createDataFrame([(*k, n) for k, n in edges.items()], "src string, dst string, n bigint")
    got = dict(urls.propagate(df, spark.createDataFrame([("a",), ("z",)], "host string")).collect())
    total = {}
    for (s, _), n in edges.items():
        total[s] = total.get(s, 0) + n
    mass = start = {"a": 1.0, "z": 1.0}
    for _ in range(urls.ROUNDS):
        new = dict(start)
        for (s, d), n in edges.items():
            if s in mass:
                new[d] = new.get(d, 0) + urls.DAMPING * mass[s] * n / total[s]
        mass = new
    assert got == {k: pytest.approx(v) for k, v in mass.items()}


def test_links_to_blocked_hosts_count(spark, ):
    link = lambda *hosts: "".join(f'<a class="x" href="https://{h}/p">l</a><a href="/own">o</a>' for h in hosts)
    rows = [(1, "http://bad.net/x", link()), (2, "http://farm.org/1", link("bad.net", "bad.net")), (3, "http://fine.org/1", link("good.example.net")), (4, "http://good.example.net/en/1", link("fine.org")), (5, "http://far.org/1", link("farm.org")), (6, "http://alone.org/x", None)]
    got = {r["page_id"]: r["verdict"] for r in urls.judge(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "block", 6: "allow"}


def test_verdicts_equal_plain_propagation(spark):
    """Verdicts of unruled pages, ports and users in urls included, equal power iteration over the sites by hand; repeated rows count as pages, other columns don't."""
    import random

    rng = random.Random(4)
    sites = [f"{n}.{t}" for n in "abcdefgh" for t in ("net", "org", "example.net")]
    rows = []
    for i in range(60):
        site = rng.choice(sites)
        host = rng.choice(["", "u@"]) + site + rng.choice(["", ":8080"])
        links = "".join(f"<a href='//{rng.choice(sites)}{rng.choice(['', ':80'])}/x'>l</a>" for _ in range(rng.randint(0, 3)))
        rows.append((i, f"http://{host}/{rng.choice(['en', 'fr', 'x'])}/p", links, "clash", "clash"))
    rows += rows[:5]
    plain = lambda h: h.split("@")[-1].split(":")[0]
    pages, edges = [], {}
    for i, url, html, *_ in rows:
        host, path, best = by_hand(url, urls.RULES)
        pages.append((i, plain(host), best[2] if best else None))
        for part in html.split("//")[1:]:
            to = plain(part.split("/")[0])
            if to != plain(host):
                edges[plain(host), to] = edges.get((plain(host), to), 0) + 1

    def spread(seeds, edges):
        total = {}
        for (s, _), n in edges.items():
            total[s] = total.get(s, 0) + n
        mass = dict.fromkeys(seeds, 1.0)
        for _ in range(300):
            new = dict.fromkeys(seeds, 1.0)
            for (s, d), n in edges.items():
                if s in mass:
                    new[d] = new.get(d, 0) + urls.DAMPING * mass[s] * n / total[s]
            mass = new
        return mass

    def seeds(verdict):
        return [s for s in sites if 2 * sum(p[1] == s and p[2] == verdict for p in pages) > sum(p[1] == s for p in pages)]

    trust, distrust = spread(seeds("allow"), edges), spread(seeds("block"), {(d, s): n for (s, d), n in edges.items()})
    want = sorted((i, ruled or ("block" if distrust.get(s, 0) - trust.get(s, 0) >= urls.THRESHOLD else "allow")) for i, s, ruled in pages)
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, host string, site string")
    got = urls.judge(df).collect()
    assert sorted((r["page_id"], r["verdict"]) for r in got) == want
    assert {v for i, s, r in pages for j, v in want if i == j and not r} == {"allow", "block"}
