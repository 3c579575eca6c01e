"""Main text of pages: given tables, planted boilerplate, odd markup."""

import html
import random
import re

from pyspark.sql import functions as F

from gridwake.llm import pagediff
from gridwake.llm.queries import LLM_QUERIES

PATH = "/root/testdata/sf0.001"


def test_query_gives_the_article(spark):
    got = {r.page_id: r for r in LLM_QUERIES["op3_page_text"](spark, PATH).collect()}
    for r in spark.read.parquet(f"{PATH}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        want = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        want = "\n".join(w for w in want if w)
        assert (got[r.page_id].text, got[r.page_id].n_chars) == (want, len(want))
        assert got[r.page_id].n_shared + got[r.page_id].n_marked > 0


def test_common_subsequence_is_longest():
    draw = random.Random(5)
    for _ in range(400):
        a, b = ([draw.randint(0, 6) for _ in range(draw.randint(0, 14))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        places = pagediff.shared_places(a, b)
        assert len(places) == table[-1][-1] and places == sorted(set(places))
        kept, it = [a[k] for k in places], iter(b)
        assert all(x in it for x in kept)


def test_differencing_decides_where_no_article_is_marked(spark):
    page = lambda story: f"<html><body><div>Site &amp; name</div><div><p>Home</p><p>About</p></div><div><p>{story}</p><p>end of {story}</p></div><div>All rights</div></body></html>"
    rows = [(k, f"https://h.example/{'a' if k < 3 else 'b'}/{k}", page(f"story {k}")) for k in range(6)] + [(9, "https://other.example/x", page("lonely"))]
    got = {r.page_id: r for r in pagediff.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k].text == f"story {k}\nend of story {k}" and got[k].n_shared == 4 for k in range(6))
    assert got[9].text.split("\n")[3] == "lonely" and got[9].n_shared == 0


def test_markup_and_edges(spark):
    parts = (
        "<header>Top</header><nav><li>Menu</nav><aside>Side</aside><div class='cookie-notice'>We use</div><div id=topAds>Buy</div><main><h1>T&eacute; x</h1>"
        "<p>one<b>two</b>\n three&nbsp;four<p class=ad>Buy<p>five<form>Name<input></form><div class='reader-comments'><p>nice</p></div><script>var a='<p>no</p>'</script>"
        "<!-- <p>no --><p>six &lt;b&gt; &am</main><footer>Foot</footer>"
    )
    rows = [(1, "http://a/b", parts, "x"), (1, "http://a/b", parts, "x"), (2, None, None, "x"), (3, "", "", None), (4, "?", "<p>cut <b", "x"), (None, "http://a/c", "<article>" + "<p>w w " * 20_000, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_shared string").withColumn("text", F.lit("old"))
    out = pagediff.main_text(df)
    got = out.collect()
    assert len(got) == len(rows)
    text = {r.page_id: r.text for r in got}
    assert text[1] == "Té x\nonetwo three four\nfive\nsix <b> &am" and text[2] == text[3] == "" and text[4] == "cut"
    assert text[None] == "\n".join(["w w"] * 20_000)
    assert pagediff.main_text(df.limit(0)).count() == 0


def test_differencing_inside_articles(spark):
    own = lambda k: [f"paragraph {k} {j} of a story that only page {k} tells at some length" for j in range(4)]
    page = lambda lines, extra="": f"<html><body><nav>Menu</nav><article><p>{'</p><p>'.join(lines)}</p></article><div>{extra}</div></body></html>"
    notice = "Follow us for more"
    rows = [(k, f"https://h.example/a/{k}", page([*own(k)[:2], notice, *own(k)[2:], *(["a shared passage"] if k < 2 else [])], f"written by author {k}")) for k in range(12)]
    rows += [(20 + k, f"https://m.example/a/{k}", page([*own(99)[:3], f"an edited end {k}"])) for k in range(8)]
    got = {r.page_id: r.text.split("\n") for r in pagediff.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == [*own(k), *(["a shared passage"] if k < 2 else []), f"written by author {k}"] for k in range(12))
    assert all(got[20 + k] == [*own(99)[:3], f"an edited end {k}"] for k in range(8))
