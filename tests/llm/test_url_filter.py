from __future__ import annotations

from quirefold.llm.queries import URL_RULES
from quirefold.llm.url_filter import alias_links, judge_urls
from tests.llm.helpers import own_columns_stay

PAGES = "page_id long, url string, html string, host string, node int, component int"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "old", 1, 2) for i, (u, h) in enumerate(rows)], PAGES)


def canonical(url):
    return f'<head><link href="{url}" rel="canonical"></head>'


def judged(spark, rows):
    got = judge_urls(pages(spark, rows), URL_RULES).collect()
    return [(r["host"], r["path"], r["rule"], r["verdict"]) for r in sorted(got, key=lambda r: r["page_id"])]


def test_host_path_and_longest_rule(spark):
    got = judged(spark, [
        ("https://A.Example.COM/en/1?x=/y#z", None),
        ("http://www.example.com/en/2", ""),
        ("http://x.www.example.com/en/2", ""),
        ("http://shop.net/es/", None),
        ("http://shop.net/es", None),
        ("http://net/fr/x", None),
        ("http://notexample.com/en/", None),
        ("http://example.org?q=http://b.net/es/", None),
        ("no scheme/at all", None),
        (None, None),
        ("://h#f", None),
        ("HTTP://É.NET/es/É?", None),
    ])
    assert got == [
        ("a.example.com", "/en/1", "example.com/en/", "block"),
        ("www.example.com", "/en/2", "www.example.com/en/", "allow"),
        ("x.www.example.com", "/en/2", "www.example.com/en/", "allow"),
        ("shop.net", "/es/", "net/es/", "block"),
        ("shop.net", "/es", None, "allow"),
        ("net", "/fr/x", "net/fr/", "block"),
        ("notexample.com", "/en/", "com/", "allow"),
        ("example.org", "", None, "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("h", "", None, "allow"),
        ("É.net", "/es/É", "net/es/", "block"),
    ]


def test_aliases_written_differently_are_met(spark):
    bad = "http://bad.net/es/q"
    got = judged(spark, [
        ("http://a.org/1", f'<link rel="nofollow canonical" href="{bad}">'),
        ("http://a.org/2", f"<link href='{bad}' rel='canonical me'/>"),
        ("http://a.org/3", f"<link rel=canonical href={bad}>"),
        ("http://a.org/4", f'<link rel="not-canonical" href="{bad}"><link rel="canonicals" href="{bad}">'),
        ("http://a.org/5", f'<!-- <link rel="canonical" href="{bad}"> --><p>'),
        ("http://a.org/6", f'<!-- open <link rel="canonical" href="{bad}">'),
        ("http://a.org/7", f'<!-- x --><link rel="canonical" href="{bad}"><!-- y -->'),
        ("http://b.org/r", canonical(bad)),
        ("http://b.org/x/y", canonical("../r")),
        ("http://b.org/x/z", canonical("./../q/../r")),
        ("http://b.org/x/../r", None),
        ("http://b.org/../../r", None),
        ("http://b.org/x/w", canonical("../../../r/.")),
        ("http://root.org", None),
        ("http://root.org/", canonical(bad)),
        ("http://root.org?q=1", canonical("http://root.org/")),
        ("http://root.org/.", None),
        ("http://root.org/a/..", None),
        ("http://root.org/...", None),
    ])
    want = "block block block allow allow allow block block block block block block allow block block block block block allow"
    assert [v for _, _, _, v in got] == want.split()
    assert got[10][1] == "/x/../r"


def test_input_columns_named_like_internal_ones_stay(spark):
    rows = pages(spark, [("http://a.net/es/", None)]).selectExpr("*", "'own' AS _q1", "2 AS _Q2", "3L AS _qfp", "9 AS _q9", "7 AS _qnode")
    got = judge_urls(rows, URL_RULES)
    assert own_columns_stay(got) and got.first()["_qnode"] == 7


def test_blocks_reach_aliases_over_chains_but_not_allowed_pages(spark):
    refresh = '<META content="0; URL=/b" HTTP-EQUIV=refresh>'
    got = judged(spark, [
        ("http://m.org/a", refresh),
        ("https://m.org/b#frag", canonical("//m.org/c?x=1&amp;y=2")),
        ("http://m.org/c?x=1&y=2", canonical("http://bad.net/es/q")),
        ("http://m.org/c", None),
        ("http://ok.com/", canonical("http://bad.net/es/q")),
        ("http://m.org/dir/d", canonical("e")),
        ("http://m.org/dir/e", None),
    ])
    assert [g[3] for g in got] == ["block", "block", "block", "allow", "allow", "allow", "allow"]
    assert got[4][2] == "com/"


def test_links(spark):
    got = alias_links(pages(spark, [("http://x.org/d/p?q#f", canonical("e") + canonical("/r") + canonical("?s") + canonical("#t"))]))
    assert {(r["a"], r["b"]) for r in got.collect()} == {
        ("x.org/d/p?q", "x.org/d/e"), ("x.org/d/p?q", "x.org/r"), ("x.org/d/p?q", "x.org/d/p?s"), ("x.org/d/p?q", "x.org/d/p"),
    }


def test_hot_target_and_repeated_rows(spark):
    rows = [(f"http://a{i % 90}.org/", canonical("http://bad.net/fr/")) for i in range(200)]
    assert {g[3] for g in judged(spark, rows)} == {"block"}


def test_empty_table_and_columns(spark):
    got = judge_urls(pages(spark, []), URL_RULES)
    assert got.count() == 0
    assert got.columns == ["page_id", "url", "html", "host", "node", "component", "path", "rule", "verdict"]
