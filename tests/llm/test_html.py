"""Main texts of small pages written out by hand, and of the given pages against their own article elements."""

import html
import re

import pytest
from pyspark.sql import functions as F

from tallyweave.llm import html_text as H

P = ["First paragraph of the story, with enough words in it to look like one.", "Second paragraph, which goes on for about as long as the first one did.", "Third and last of them; it ends the story that this page is about."]
BODY = "".join(f"<p>{p}</p>" for p in P)
STORY = "\n".join(P)

PAGES = {
    "semantic": (f"<!DOCTYPE html><html><head><title>x</title><script>var a='<p>no</p>'</script></head><body><header><h1>Site</h1></header><nav><a href=/>Home</a></nav><main><article><h1>Title</h1>{BODY}</article></main><aside>More</aside><footer>&copy; us</footer></body></html>", "Title\n" + STORY),
    "classes": (f"<body><div class='site-header'>The Daily</div><ul id=mainMenu><li><a href=1>One</a><li><a href=2>Two</a></ul><div class='wrap has-sidebar'><h1>Title</h1><div class=entry-content>{BODY}<div class='ad-slot'>Buy now!</div></div></div><div class='sidebar'>{BODY}</div><div class=cookie-notice>We use cookies on this site.</div><div id=comments><p>{P[0]}</p></div>", "Title\n" + STORY),
    "bare divs": (f"<body><div><a href=1>Home</a> <a href=2>News</a> <a href=3>Sport</a></div><div><div>{BODY}</div></div><div><a href=4>Terms</a> <a href=5>Privacy</a></div></body>", STORY),
    "comments by heading": (f"<body><article><h1>T</h1>{BODY}<h3>12 Comments</h3><ul><li>So true, I agree with each word of it.</li></ul></article></body>", "T\n" + STORY),
    "comment section": (f"<body><article>{BODY}<section><h2>Reader comments</h2><p>{P[0]}</p></section><form><textarea>type</textarea><button>Send</button></form></article></body>", STORY),
    "article header": (f"<body><header>Logo</header><article><header><h1>Title</h1></header>{BODY}<footer>Filed under x</footer></article></body>", "Title\n" + STORY),
    "unclosed": ("<body><article><h1>T</h1><p><b>One two.<br><p>Three <i>four<p>Five", "T\nOne two.\nThree four\nFive"),
    "references": ("<article><p>a &amp; b &lt;c&gt; &#233;&#x20AC; &nbsp;d\n\t e &am; &copy<br>f</p></article>", "a & b <c> é€ d e &am; © f"),
    "links inside": (f"<body><div><p>{P[0]} <a href=x>a link</a></p><p>{P[1]}</p><ul><li>point one</li><li>point two</li></ul></div>", f"{P[0]} a link\n{P[1]}\npoint one\npoint two"),
    "hidden markup": ("<article><p>a<!-- <p>no</p> -->b</p><style>p{}</style><noscript><p>no</p></noscript><script>if (a<b) '</p>'</script><p>c</p></article>", "ab\nc"),
    "short article, long advert": (f"<body><nav><a href=1>x</a></nav><div class=ad>{BODY}</div><article><h1>T</h1><p>Hm.</p></article><footer>{BODY}</footer></body>", "T\nHm."),
    "plain": ("just text", "just text"),
    "roles": (f"<body><div role=navigation>Menu</div><div role=main>{BODY}</div><div role=contentinfo>Imprint</div>", STORY),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    source, want = PAGES[name]
    assert H.main_text(source) == want


def test_densities_by_definition():
    page = H.Page("<body><div><a href=1>ab</a><a href=2>cd</a></div><div><p>long text here</p><p>more of it</p></div>")
    keep = H.kept_elements(page)
    density, total = H.densities(page, keep)
    of = dict(zip(page.tag, density))
    assert of["a"] < of["p"] and page.tag[total.index(max(total))] == "div" and total.index(max(total)) == page.tag.index("p") - 1
    for i in range(len(total)):
        assert abs(total[i] - sum(density[x] for x in page.items[i] if not isinstance(x, str))) < 1e-12


def test_odd_pages_end_in_time():
    for source in ("<a " * 50_000, '="<a ' * 50_000, "<div>" * 50_000 + "deep", "</x>" * 1000 + "<b>" * 20_000 + "</i>" * 20_000, "<" * 100_000, "<!--" * 50_000, "<p>" * 50_000 + "x", "&" * 100_000, "<script>" * 20_000):
        H.main_text(source)
    long = "word " * 400_000
    assert len(H.main_text(f"<article><p>{long}</p></article>")) == len(long) - 1


def test_rows(spark):
    rows = [(1, "u", "<p>x</p>", "old", 7), (1, "u", "<p>x</p>", "old", 7), (None, None, None, None, None), (2, "v", "", "t", 1), (3, "w", "<nav>menu</nav>", "t", 1), (4, "é", "<p>é€</p>", "t", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = sorted((r.page_id or 0, r.url, r.text, r.n_chars) for r in H.extract(df).collect() if r.page_id)
    assert got == [(1, "u", "x", 1), (1, "u", "x", 1), (2, "v", "", 0), (3, "w", "", 0), (4, "é", "é€", 2)]
    assert H.extract(df).where("page_id IS NULL").first()["text"] == "" and H.extract(df.limit(0)).collect() == []


def test_given_pages(spark, sf_dir):
    def article(source):
        inner = re.search(r"<article>(.*?)</article>", source, re.S)[1]
        parts = (html.unescape(re.sub("<[^>]*>", "", p.replace("<br>", " "))) for p in re.split(r"</?(?:p|h1)>", inner))
        return "\n".join(t for p in parts if (t := " ".join(p.split())))

    want = {r.page_id: article(r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = {r.page_id: r for r in H.op13_html_text(spark, sf_dir).withColumn("n", F.length("text")).collect()}
    assert {k: r.text for k, r in got.items()} == want and all(r.n == r.n_chars for r in got.values())
