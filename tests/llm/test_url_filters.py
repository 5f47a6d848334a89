import random

import duckdb
import pytest

from inkmill.llm import url_filters
from inkmill.llm.queries import ORACLE, URL_RULES, op1_url_filters
from inkmill.llm.url_filters import url_filter


def canonical(to):
    return f'<html><head><link rel="canonical" href="{to}"></head></html>'


PAGES = [
    (1, "http://A.Example.org/es/1", None),  # blocked by rule
    (2, "http://x.net/2", canonical("http://a.example.org/es/1")),  # alias of 1
    (3, "https://x.net/3?q=1#f", '<META http-equiv=refresh content="0; URL=/2">'),  # alias of 2
    (4, "http://y.net/4", canonical("http://z.com/de/9")),  # alias of a blocked URL that is no page
    (5, "http://w.net/5", canonical("http://y.net/4b")),
    (6, "http://v.net/6", canonical("http://v.com/de/1")),
    (7, "http://v.net/7", canonical("http://v.net/6")),
    (8, "http://ok.org/8", canonical("http://v.net/6")),  # allowed by rule, so its class is not blocked
    (9, "http://u.com/fr/9", canonical("http://z.com/de/9")),  # explicit allow, class of 4
    (10, None, None),
    (11, "no scheme", "<p>"),
    (12, "http://example.org", None),  # empty path fits no rule
    (13, "http://notexample.org/es/", None),
    (1, "http://A.Example.org/es/1", None),
    (14, "", ""),
]


def verdicts(df):
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in df.collect()}


EXPECTED = {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "allow", 9: "allow", 10: "allow", 11: "allow", 12: "allow", 13: "allow", 14: "allow"}


@pytest.mark.parametrize("inline", [256, 0])
def test_aliases_and_precedence(spark, monkeypatch, inline):
    monkeypatch.setattr(url_filters, "INLINE", inline)
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as rule")
    out = url_filter(df, URL_RULES)
    assert out.count() == len(PAGES)
    got = verdicts(out)
    assert {k: v[3] for k, v in got.items()} == EXPECTED
    assert got[1] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[10] == ("", "", None, "allow") and got[12][:3] == ("example.org", "", None)
    assert got[13][2] == "org/"


def test_given_redirects_and_empty(spark):
    df = spark.createDataFrame([(1, "http://p.net/a", None)], "page_id long, url string, html string")
    more = spark.createDataFrame([("http://p.net/a", "http://q.com/de/x")], "url string, target string")
    assert verdicts(url_filter(df, URL_RULES, more))[1][3] == "block"
    assert url_filter(df.limit(0), URL_RULES).count() == 0


def test_all_tags_references_and_dots(spark):
    two = canonical("http://y.net/1") + canonical("http://q.com/de/x?a=1&amp;b=2")
    rows = [
        (1, "http://p.net/a", two), (2, "http://q.com/x/y/z", canonical("../../de/./w?u=../v")), (3, "http://p.net/c", '<meta http-equiv=refresh content="0; url=http://q.com/e?a=1&amp;b=&#x2F;&#50;">'),
        (4, "http://p.net/d", canonical("http://r.com/a/..")), (5, None, two),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted(map(tuple, url_filters.link_edges(df).collect())) == [
        ("http://p.net/a", "http://q.com/de/x?a=1&b=2"), ("http://p.net/a", "http://y.net/1"), ("http://p.net/c", "http://q.com/e?a=1&b=/2"), ("http://p.net/d", "http://r.com/"), ("http://q.com/x/y/z", "http://q.com/de/w?u=../v"),
    ]


RULES_TIED = [("block", "a.com/"), ("allow", "a.com/"), ("allow", "b.net/x"), ("block", "b.net/x"), ("block", "com/ab"), ("allow", "z.com/"), ("block", "org/")]


def test_rules_are_settled_alike_on_both_paths(spark, monkeypatch):
    """Equal rules of both actions, and equally long ones."""
    df = spark.createDataFrame([(i, f"http://{u}", None) for i, u in enumerate(["a.com/q", "b.net/xy", "z.com/ab", "c.org/", "n.b.net/x", "www.a.com/ab", "com/ab"])] + [(9, None, None)], "page_id long, url string, html string")
    got = []
    for inline in (256, 0):
        monkeypatch.setattr(url_filters, "INLINE", inline)
        got.append(verdicts(url_filter(df, RULES_TIED)))
    assert got[0] == got[1]
    assert {k: v[2:] for k, v in got[0].items()} == {0: ("a.com/", "allow"), 1: ("b.net/x", "allow"), 2: ("z.com/", "allow"), 3: ("org/", "block"), 4: ("b.net/x", "allow"), 5: ("com/ab", "block"), 6: ("com/ab", "block"), 9: (None, "allow")}


def fits(host, path, rule):
    at, slash, start = rule.partition("/")
    return (host == at or host.endswith("." + at)) and path.startswith(slash + start)


def rule_of(host, path):
    return max(((len(t), t, a) for a, t in URL_RULES if fits(host, path, t)), default=(0, None, None))[1:]


@pytest.fixture(scope="module")
def linked():
    """Pages with chains, a hub, several tags, references, relative targets, copies, targets that are no pages."""
    rnd, rows = random.Random(21), []
    hosts = ["a.example.org", "example.org", "x.com", "y.x.com", "k.net", "m.info", "q.example.net", "z.org"]
    urls = [(rnd.choice(hosts), f"/{rnd.choice(['es', 'en/1', 'fr', 'de', 'p', 'q', 'r', 's', 't'])}/{i}") for i in range(3000)]
    for i, (host, path) in enumerate(urls):
        tags = []
        for _ in range(rnd.choice([0, 0, 1, 1, 2])):
            to_host, to_path = urls[i - 1] if rnd.random() < 0.5 else rnd.choice(urls) if rnd.random() < 0.3 else (rnd.choice(hosts), f"/gone/{rnd.randrange(900)}")
            form = rnd.randrange(5)
            if form == 0 and to_host == host:
                tags.append((canonical(f"/x/../{to_path[1:]}"), (host, to_path)))
            elif form == 1:
                tags.append((f'<meta http-equiv="Refresh" content="0; url=https://{to_host.upper()}{to_path}?a=1&amp;b=&#50;#f">', (to_host, to_path + "?a=1&b=2")))
            elif form == 2:
                tags.append((canonical(f"//{to_host}{to_path}/./"), (to_host, to_path + "/")))
            else:
                tags.append((canonical(f"http://{to_host}{to_path}"), (to_host, to_path)))
        if 1000 <= i < 1200:
            tags = [(canonical("http://hub.net/"), ("hub.net", "/"))]
        rows.append((i, host, path, tags))
    return rows


def test_random_links_against_union_find_and_sql(spark, linked, tmp_path):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for _, host, path, tags in linked:
        for _, to in tags:
            root[find((host, path))] = find(to)
    acts = {}
    for node in list(root):
        acts.setdefault(find(node), set()).add(rule_of(node[0], node[1].partition("?")[0])[1])
    expected = []
    for i, host, path, _ in linked:
        rule, act = rule_of(host, path)
        seen = acts.get(find((host, path)), set())
        expected.append((i, host, path, rule, act or ("block" if "block" in seen and "allow" not in seen else "allow")))
    df = spark.createDataFrame([(i, f"http://{h}{p}#x", "<html>" + "".join(t for t, _ in tags)) for i, h, p, tags in linked], "page_id long, url string, html string")
    df.write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(map(tuple, op1_url_filters(spark, str(tmp_path)).collect()))
    assert got == expected
    aliased = [r for r in expected if r[3] is None and r[4] == "block"]
    assert len(aliased) > 30 and len({find((h, p)) for _, h, p, _ in linked}) < 2500
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(con.sql(ORACLE["op1_url_filters"]).fetchall()) == expected
