"""Operators on pages against brute force, and the registered queries with a check."""

import math
import random

import pytest
from compare import connect, difference
from pyspark.sql import functions as F

from evidentia.llm import catalog, markup, revisits, urls

CHECKED = sorted(catalog.CHECKS)


@pytest.fixture(scope="module")
def con():
    return connect("0.001")


@pytest.mark.parametrize("name", CHECKED)
def test_matches_check(spark, con, name):
    assert difference(spark, con, name, catalog.QUERIES[name], catalog.CHECKS[name], "0.001") is None


# URL filters -------------------------------------------------------------------------------------------------------

URLS = [
    None, "", "no scheme", "http://", "HTTP://Example.ORG/es/a", "https://a.b.example.org/es", "https://a.b.example.org/es/?q=/x", "http://example.org", "http://example.org?x", "http://x.org/",
    "http://notexample.org/es/1", "http://example.org/en/1#f", "http://example.org/en/12", "http://com/fr/", "http://a.com/fr/x", "http://a.com/de/", "http://a.com/de", "a://b://c.org/",
    "http://ÉX.org/", "http://x.org/" + "p/" * 20_000, "http://" + "s." * 5_000 + "org/", "http://.org/", "http://x.org:80/", "http://u@x.com/de/"]


def plain_rule(url, rules):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = rest
    for mark in "/?#":
        host = host.split(mark, 1)[0]
    path = rest[len(host):].split("?", 1)[0].split("#", 1)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, default=(0, None, None))[2], max(fits, default=(0, None, None))[1]


@pytest.mark.parametrize("small", [True, False])
def test_url_rules_equal_brute_force(spark, monkeypatch, small):
    rules = [*urls.RULES, ("org", "/", "block"), ("example.org", "", "allow"), (None, "/", "block"), ("x.org", "/p/p/", "block")]
    monkeypatch.setattr(urls, "is_small", lambda df: small)
    pages = spark.createDataFrame([(i, u) for i, u in enumerate([*URLS, *URLS[:6]])] + [(None, URLS[4])], "page_id int, url string").withColumn("rule", F.lit(1)).withColumn("verdict", F.lit(2)).withColumn("__url", F.lit(3))
    given = spark.createDataFrame(rules, "host string, path string, verdict string")
    judged, name = urls.filter_urls(pages, given, "unknown")
    assert judged.columns == [*pages.columns, name]
    known = [r for r in rules if None not in r]
    got = {(r.page_id, r.url): tuple(r[name]) for r in judged.collect()}
    assert judged.count() == pages.count()
    for (_, url), (host, path, rule, verdict) in got.items():
        h, p, r, v = plain_rule(url, known)
        assert (host, path, rule, verdict) == (h, p, r, v or "unknown"), url


def test_url_rules_of_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://x.org/")], "page_id int, url string")
    judged, name = urls.filter_urls(pages, urls.default_rules(spark).limit(0))
    assert judged.first()[name].verdict == urls.DEFAULT
    assert urls.filter_urls(pages.limit(0), urls.default_rules(spark))[0].count() == 0


def test_short_prefixes_are_confirmed(spark):
    """With one hex digit nearly every expression is a candidate; the digest decides."""
    seen = spark.createDataFrame([(f"http://h{i}.org/p{i}",) for i in range(60)], "url string")
    rules = spark.createDataFrame([(f"h{i}.org", f"/p{i}", "block") for i in range(0, 60, 2)], "host string, path string, verdict string")
    assert {r.url for r in urls.match_rules(seen, rules, prefix=1).collect()} == {f"http://h{i}.org/p{i}" for i in range(0, 60, 2)}


# HTML --------------------------------------------------------------------------------------------------------------

ARTICLE = "<h1>Head &amp; line</h1><p>First  <b>bold</b>\n text<br>more</p><p>Second &lt;one&gt; &#233;<p>Third<ul><li>a<li>b</ul>"
TEXT = "Head & line\nFirst bold text more\nSecond <one> é\nThird\na\nb"
AROUND = [
    "<nav><a href=/>Menu</a></nav>", "<header><h1>Site</h1></header>", "<div class='ad banner'>Buy " + "now " * 60 + "</div>", "<aside>side</aside>", "<div id=cookie-notice>We use cookies</div>",
    "<form><input><button>Go</button></form>", "<script>var x='</p><p>no';</script>", "<style>p{}</style>", "<!-- <p>no</p> -->", "<footer>&copy; foot</footer>", "<section class=comments><p>" + "I say this. " * 80 + "</p></section>",
    "<div role=navigation>go</div>", "<div style='display: none'>hidden</div>", "<p hidden>hidden</p>"]


@pytest.mark.parametrize("box", ["<article>{}</article>", "<main>{}</main>", "<div class=post>{}</div>"])
def test_article_without_what_surrounds_it(box):
    half = len(AROUND) // 2
    page = f"<!DOCTYPE html><html><head><title>No</title></head><body>{''.join(AROUND[:half])}{box.format(ARTICLE)}{''.join(AROUND[half:])}</body></html>"
    assert markup.extract(page) == TEXT


def test_densest_subtree_wins_over_links():
    links = "".join(f"<li><a href=/{i}>link number {i}</a></li>" for i in range(80))
    body = "".join(f"<p>Paragraph {i} " + "with running text " * 8 + "</p>" for i in range(5))
    out = markup.extract(f"<body><div><ul>{links}</ul></div><div><div>{body}</div></div></body>")
    assert out.startswith("Paragraph 0") and out.count("\n") == 4 and "link number" not in out


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("   ", ""), ("plain", "plain"), ("<p>a<p>b", "a\nb"), ("<div>x <b>y</b>\n z</div><foot", "x y z"), ("<p title='a>b'>q</p>", "q"), ("a < b", "a < b"),
    ("<article><p>one</article>", "one"), ("<script>only", ""), ("<p>" + "<b>" * 3000 + "deep", "deep"), ("<div>" * 5000 + "deep", "deep"), ("<p>a&nbsp;b&#0;</p>", "a b�"), ("</p></div>x", "x")])
def test_odd_pages(page, text):
    assert markup.extract(page) == text


def test_pages_through_spark(spark):
    long = "<article>" + "<p>word &amp; word</p>" * 50_000 + "</article>"
    rows = [(1, "u", f"<body>{ARTICLE}</body>"), (1, "u", f"<body>{ARTICLE}</body>"), (None, None, None), (2, "u", ""), (3, None, long)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit(1))
    got = sorted(((r.page_id, r.url, r.n_chars, len(r.text)) for r in markup.extract_pages(df).collect()), key=str)
    assert got == sorted([(1, "u", len(TEXT), len(TEXT))] * 2 + [(None, None, 0, 0), (2, "u", 0, 0), (3, None, 12 * 50_000 - 1 + 0 * 50_000, 12 * 50_000 - 1)], key=str)
    assert markup.extract_pages(df.limit(0)).count() == 0


# Revisits ----------------------------------------------------------------------------------------------------------

SCHEMA = "record_id long, url string, time long, kind string, etag string, last_modified string, digest string, headers map<string,string>"


def test_revisits_equal_brute_force(spark):
    import random

    rng = random.Random(14)
    rows = []
    for i in range(600):
        kind = rng.choice(["response", "revisit", "revisit"])
        url = "http://hot.example/" if rng.random() < 0.4 else f"http://h{rng.randint(0, 9)}.example/{rng.randint(0, 3)}"
        pick = lambda *v: rng.choice([None, *v])
        rows.append((i, rng.choice([url, url.upper().replace("HTTP", "http") if "hot" in url else url, url + "#x", url + "?utm_a=1"]), rng.choice([None, *range(40)]), kind, pick('"a"', 'W/"a"', '"b"'), pick("m1", "m2"), pick("d1", "d2"),
                     rng.choice([None, {}, {"ETag": "1", "etag": "2", "Content-Type": "x"}, {"Date": str(i), "Content-Length": "9"}])))
    rows += [(2000, None, 5, "revisit", None, None, None, None), rows[1], rows[1]]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("full", F.lit(1)).withColumn("block", F.lit(1)).repartition(5)
    got = sorted(((r.record_id, r.canonical_url, r.response_id, r.verdict, r.headers) for r in revisits.resolve_revisits(df).collect()), key=str)

    def key(url):
        return None if url is None else url.split("#")[0].split("?")[0].split("://")[1].lower().rstrip("/")

    def low(headers):
        out = {}
        for k, v in (headers or {}).items():
            out[k.lower()] = v
        return out

    want = []
    for i, url, time, kind, etag, modified, digest, headers in rows:
        if kind != "revisit":
            continue
        before = [r for r in rows if r[3] == "response" and time is not None and r[2] is not None and url and key(r[1]) == key(url) and r[2] < time]
        hit = max(before, key=lambda r: (r[2], r[0]), default=None)
        verdict, merged = "unmatched", None
        if hit:
            pairs = [(etag and etag.removeprefix("W/"), hit[4] and hit[4].removeprefix("W/")), (modified, hit[5]), (digest, hit[6])]
            both = next(((a, b) for a, b in pairs if a and b), None)
            verdict = "unchecked" if both is None else "resolved" if both[0] == both[1] else "changed"
            if verdict == "resolved":
                merged = {**low(hit[7]), **{k: v for k, v in low(headers).items() if k not in revisits.KEPT_FIELDS}}
        want.append((i, key(url), hit and hit[0], verdict, merged))
    normal = lambda found: sorted(((*r[:4], None if r[4] is None else sorted(r[4].items())) for r in found), key=str)
    assert normal(got) == normal(want)


def test_revisits_of_an_empty_table(spark):
    assert revisits.resolve_revisits(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize(("url", "key"), [
    ("HTTP://WWW.Ex.com:80/a/?b=2&utm_x=1&a=1#f", "ex.com/a?a=1&b=2"), ("https://ex.com", "ex.com"), ("ex.com/A/", "ex.com/A"), ("", ""), (None, None)])
def test_canonical_urls(spark, url, key):
    df = spark.createDataFrame([(url,)], "url string")
    assert df.select(revisits.canonical_url(F.col("url"))).first()[0] == key


# Density -----------------------------------------------------------------------------------------------------------

def test_density_drops_clutter_that_no_class_names():
    words = lambda n, w: " ".join(f"{w}{i}" for i in range(n))
    links = "".join(f"<li><a href='/{i}'>Link {i}</a></li>" for i in range(25))
    body = [f"<p>{words(40, f'body{k}')} with <a href='#'>a link</a> inside.</p>" for k in range(6)]
    want = "\n".join(["Title", *[f"{words(40, f'body{k}')} with a link inside." for k in range(6)]])
    page = f"""<html><body><div><ul>{links}</ul></div><div><div><h1>Title</h1>{''.join(body)}</div><div><ul>{links}</ul></div></div>
        <div><span>One</span><span>two</span> <a href='/'>three</a></div></body></html>"""
    assert markup.extract(page) == want
    # A doubtful class takes out what is thin, and a page of nothing else keeps its text.
    thin = page.replace(body[2], body[2] + "<div class='share'>Tell <a href='/'>a friend</a></div>")
    assert markup.extract(thin) == want
    assert markup.extract("<body><div class='sidebar'><p>All there is.</p></div></body>") == "All there is."


def test_densities_equal_their_definition():
    rng = random.Random(12)

    def tree(depth):
        parts = []
        for _ in range(rng.randint(1, 4)):
            kind = rng.choice(["text", "link", "block", "block"] if depth else ["text", "link"])
            parts.append({"text": f"w{rng.randint(0, 9)} " * rng.randint(1, 9), "link": f"<a href='x'>l{rng.randint(0, 9)}</a>", "block": ""}[kind] or f"<div>{tree(depth - 1)}</div>")
        return "".join(parts)

    for _ in range(40):
        page = markup.Page(f"<html><body>{tree(4)}</body></html>")
        density, total = page.densities()
        children = {i: [j for j in range(len(page.parent)) if page.parent[j] == i] for i in range(len(page.parent))}

        def below(i, own):
            return own(i) + sum(below(j, own) for j in children[i])

        chars = {i: sum(len(t) for n, t in page.texts if n == i) for i in children}
        whole = below(0, chars.get)
        share = min(1.0, below(0, lambda i: page.link_chars[i]) / whole) if whole else 0.0
        for i in children:
            c, t, lc, lt = (below(i, own) for own in (chars.get, lambda i: page.tags[i], lambda i: page.link_chars[i], lambda i: page.links[i]))
            lc, plain = min(lc, c), 0.0
            if c:
                base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
                plain = c / max(t, 1) * (math.log(c / max(lc, 1) * max(t, 1) / max(lt, 1)) / math.log(base) if base > 1 else 1)
            assert density[i] == pytest.approx(max(0.0, plain))
            assert total[i] == pytest.approx(sum(density[j] for j in children[i]) if children[i] else density[i])
