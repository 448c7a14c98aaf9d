from gridhead.llm import url_filter
from gridhead.llm.graph import components
from tests.llm.helpers import clashing

PAGES = "page_id long, url string, html string"


def judged(spark, rows):
    df = clashing(spark.createDataFrame(rows, PAGES))
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df).collect()}


def test_rules(spark):
    urls = ["http://WWW.Example.com/en/712?q", "http://example.com/en/8", "https://a.net/de/x#f", "http://b.example.net/de/81", "http://x.org/es/", "http://notexample.com/en/7", None, "no scheme/en/", "http://org?/es/", "http://é.COM/en/é", "x://net", "http://a://com/en/"]
    got = judged(spark, [(i, u, None) for i, u in enumerate(urls)])
    assert got == {
        0: ("www.example.com", "/en/712", "example.com/en/7", "allow"),
        1: ("example.com", "/en/8", "com/en/", "block"),
        2: ("a.net", "/de/x", "net/de/", "allow"),
        3: ("b.example.net", "/de/81", "example.net/de/8", "block"),
        4: ("x.org", "/es/", "org/es/", "block"),
        5: ("notexample.com", "/en/7", "com/en/", "block"),
        6: ("", "", None, "allow"),
        7: ("", "", None, "allow"),
        8: ("org", "", None, "allow"),
        9: ("é.com", "/en/é", "com/en/", "block"),
        10: ("net", "", None, "allow"),
        11: ("a:", "//com/en/", None, "allow"),
    }


def link(to):
    return f"<html><LINK href='{to}' REL=canonical><body>"


def refresh(to):
    return f'<meta http-equiv="Refresh" content="0; URL={to}">'


def test_aliases(spark):
    rows = [
        (1, "http://one.example/a", link("http://two.example/b")),
        (2, "http://two.example/b#x", refresh("http://bad.com/en/1")),
        (3, "http://three.example/c", None),
        (4, "http://four.example/d", link("http://one.example/a")),
        (5, "http://five.example/", link("http://bad.com/en/2")),
        (6, "http://example.com/en/7", link("http://five.example/")),  # an explicit allow in the component
        (7, "http://seven.example/x/y", link("z")),
        (8, "http://seven.example/x/z", link("//bad.com/en/9")),
        (9, "http://nine.example/p", link("/q")),
        (10, "http://nine.example/q", link("http://nine.example/q")),
        (11, "http://one.example/a", None),
    ]
    got = {k: v[3] for k, v in judged(spark, rows).items()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "block", 5: "allow", 6: "allow", 7: "block", 8: "block", 9: "allow", 10: "allow", 11: "block"}


def test_addresses_in_other_forms(spark):
    """Character references and dot segments name the same node; a long page hides no link."""
    long = "<p>" + "x" * 2_000_000 + "</p>"
    rows = [
        (1, "http://a.example/p?a=1&b=2", None),
        (2, "http://b.example/", link("http://a.example/p?a=1&amp;b=2")),
        (3, "http://bad.com/en/3", link("http://a.example/p?a=1&#38;b=2")),
        (4, "http://c.example/x/y/z", long + link("../../q/./r")),
        (5, "http://c.example/q/r", refresh("http://bad.com/en/../en/4")),
        (6, "http://d.example/x", link("http&#x3a;//bad.com/en/5/..")),
        (7, "http://d.example/&amp;amp;", link("http://e.example/?&amp;amp;#x")),
        (8, "http://e.example/?&amp;", link("http://bad.com/en/6")),
        (8, "http://e.example/?&amp;", link("http://bad.com/en/6")),
        (9, "http://bad.com/en/", None),
    ]
    got = {k: v[3] for k, v in judged(spark, rows).items()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "block", 6: "block", 7: "block", 8: "block", 9: "block"}


def test_empty(spark):
    assert judged(spark, []) == {}


def test_components_of_long_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, i) for i in range(1001, 1400)] + [(5000, 5001), (5001, 5000), (7, 7), (None, 3)]
    df = spark.createDataFrame(edges, "u long, v long").repartition(4)
    got = dict(components(df, "test-components").collect())
    assert got == {i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 1400)} | {5000: 5000, 5001: 5000}


def test_what_is_no_link(spark):
    """Attributes of other names, comments, scripts, `>` in quotes, and the base address."""
    bad = "http://bad.com/en/1"
    html = [
        f'<link rel="canonical" data-href="http://x/" href="{bad}">',
        f'<link rel="canonical" data-href="{bad}" href="http://x.example/">',
        f"<!-- {link(bad)} --> <p>canonical",
        f"<!-- open {link(bad)}",
        f"<script>var x = \"{link(bad)}\"</script>",
        f'<style>{refresh(bad)}</style>{link("http://y.example/")}',
        f'<link title="a>b" rel=canonical href="{bad}">',
        f"<link title=\"it's href='http://z.example/'\" rel='canonical' href={bad}>",
        f'<base href="http://bad.com/en/"><link rel=canonical href="2">',
        '<base target=_blank><base href="http://y.example/"><link rel=canonical href="2">',
        f'<link rel=canonical href="3"><BASE HREF="//bad.com/en/x">',
        f'<linked rel=canonical href="{bad}">',
        f'<link rel="canonical" title={"x" * 100_000} {"a=1 b=" * 20_000}c href="{bad}">',
        '<link rel="canonical" ' + "a='1' " * 5_000 + "href='http://w.example/'",
    ]
    got = judged(spark, [(i, f"http://page{i}.example/p/", h) for i, h in enumerate(html)])
    assert [i for i, v in got.items() if v[3] == "block"] == [0, 6, 7, 8, 10, 12]
