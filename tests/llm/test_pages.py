import html
import random
import re

import pytest

from tillroll.llm import catalog, pages


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title>{head}</head><body>{body}</body></html>"


NAV = '<nav><ul><li><a href="/a">Home</a></li><li>About us</li></ul></nav>'


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        ("", ""),
        ("plain  text &amp; more", "plain text & more"),
        (page(f"{NAV}<article><h1>A &lt;b&gt;</h1><p>one<b>two</b> three<br>four</p></article><footer>f</footer>"),
         "A <b> onetwo three four"),
        (page("<div class='ad'>buy</div><article><p>x<p>y<script>if (a<b) {'</p>'}</script> z<div id=comments>c</div></article>"),
         "x y z"),
        (page("<header>H</header><main><p>m1</p><aside>s</aside><form>f<input>g</form>m2</main><p>after</p>"), "m1 m2"),
        (page("<article><header><h1>Title</h1></header>text<!-- <p>no</p> --> on</article>"), "Title text on"),
        (page("<article>cut &amp; <p>off <a hre").removesuffix("</body></html>"), "cut & off"),
        (page("<p>a</p><div class='cookie-notice'>c</div><div class=\"content-header2\">d</div><p>b</p>"), "a b"),
        (page("<article><p>x <span class='ad'>buy</span> y</p><style>p{}</style><textarea>t</textarea></article>"), "x y"),
        (page("<article><div class='section-header'>Part one</div><h2 id='comment-on-the-law'>Law</h2><p class='ad'>said</p>"
              "<div class='comment-list'>c</div><div class='ad-slot top'>buy</div></article>"), "Part one Law said"),
        ('<article><p class="x>Hello <b>you</b></p><p>more</p></article>', "Hello you more"),
        ("<p title='never ends>one</p><a href=\"x>two</a>", "one two"),
        ('<p title="a > b">kept</p>', "kept"),
        ("<article><p>text</p><article class='comment'><p>a reply</p></article></article>", "text"),
        ("<p>1 < 2 &nbsp; &copy; &#233; &bogus; <3</p>", "1 < 2 © é &bogus; <3"),
    ],
)
def test_lines(source, expected):
    cut = pages.lines(source)
    content = any(what == pages.CONTENT for what, _ in cut)
    kept = [text for what, text in cut if what == (pages.CONTENT if content else pages.OPEN)]
    assert " ".join(kept) == expected


def plain_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_shared_lines():
    rng = random.Random(0)
    for _ in range(300):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(12))] for _ in range(2))
        shared = pages.shared_lines(a, b)
        assert len(shared) == plain_lcs(a, b)


@pytest.fixture(scope="module")
def site(spark):
    """Pages without articles: the template is known by differencing only."""
    rows, expected = [], {}
    for i in range(30):
        host = f"http://h{i % 3}.example/"
        body = f"<p>Story {i} begins.</p><p>It goes on, {i * 7}.</p>"
        top, end = f"<div>Site {i % 3} top</div><div>Latest news</div>", "<div>All rights kept</div>"
        rows.append((i, f"{host}a/{i:03d}?x=1", page(top + body + end)))
        expected[i] = f"Story {i} begins. It goes on, {i * 7}."
    alone = page("<div>Top</div><p>Only one.</p>")
    rows += [(30, "http://alone.example/x", alone), (31, None, alone), (32, "http://h0.example/b", None), (33, "http://h0.example/b", "")]
    expected |= {30: "Top Only one.", 31: "Top Only one.", 32: "", 33: ""}
    rows.append((34, rows[3][1], rows[3][2]))
    expected[34] = expected[3]
    copy = page("<div>X top</div><p>Same story.</p><p>Same end.</p><p>Third.</p>")
    rows += [(40, "http://c.example/1", copy), (41, "http://c.example/2", copy.replace("Third", "Other"))]
    expected |= {40: "X top Same story. Same end. Third.", 41: "X top Same story. Same end. Other."}
    return spark.createDataFrame(rows, "page_id long, url string, html string"), expected


@pytest.mark.parametrize("handed", [0, 1_000_000])
def test_template_is_deleted(site, handed, monkeypatch):
    monkeypatch.setattr(pages, "HANDED", handed)
    df, expected = site
    rows = pages.digest(df).collect()
    assert {r.page_id: r.text for r in rows} == expected
    assert all(r.n_chars == len(r.text) for r in rows)
    assert pages.digest(df.limit(0)).count() == 0


def test_long_repeated_and_clashing(site, monkeypatch):
    """A very long page, repeated rows, and columns named like helpers, in both ways of handing the template on."""
    df, expected = site
    long = page("<div>Site 0 top</div>" + "".join(f"<p>Line {i} of many.</p>" for i in range(20_000)))
    spark = df.sparkSession
    more = spark.createDataFrame([(50, "http://h0.example/a/0001", long)], df.schema)
    held = df.union(df.limit(5)).union(more).selectExpr("*", "page_id as owner", "url as host", "1 as keys", "2 as `row`")
    for handed in (0, 1_000_000):
        monkeypatch.setattr(pages, "HANDED", handed)
        rows = pages.extract(held).collect()
        assert len(rows) == df.count() + 6
        for r in rows:
            assert (r["owner"], r["host"], r["keys"], r["row"]) == (r.page_id, r.url, 1, 2)
            if r.page_id != 50:
                assert r.text == expected[r.page_id]
            else:
                assert r.text.startswith("Line 0 of many.") and r.text.endswith("Line 19999 of many.")


def test_query(spark, sf_dir):
    """The test pages mark their article, so its text can be cut out plainly."""
    source = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = catalog.registered()["op3_page_differencing"](spark, sf_dir).collect()
    assert sorted(r.page_id for r in rows) == sorted(source)
    for r in rows:
        inner = re.search("<article>(.*)</article>", source[r.page_id].html, re.S).group(1)
        plain = re.sub("<[^>]*>", "", re.sub("<(?:p|br|/p|h1|/h1)>", " ", inner))
        assert r.text == " ".join(html.unescape(plain).split())
        assert r.url == source[r.page_id].url and r.n_chars == len(r.text)
