import random
from html import escape

from pyspark.sql import functions as F

from daystrata.llm import html as h

WORD = ["über", "plain", "text", "a", "is", "running", "along", "&", "<x>", "1999", "of"]


def page(rng, blocks, wrap="<article>{}</article>"):
    menu = "".join(f"<li><a href='/{i}'>{rng.choice(WORD[:6])}</a></li>" for i in range(rng.randrange(3, 9)))
    body = "".join(f"<p>{escape(b)}</p>" if rng.random() < 0.8 else f"<p><b>{escape(b)}<br><p>" for b in blocks)
    return (f"<!DOCTYPE html><html><head><title>{escape(blocks[0])}</title><style>p{{}}</style><script>var t='</p>';if(a<b)x();</script></head><body>"
            f"<header><p>Site name and a line about this site</p></header><nav><ul>{menu}</ul></nav><!-- <p>no</p> -->"
            f"<div class='ad-box ad'>Buy now this thing, it is very good and cheap.<div>really</div></div>" + wrap.format(body)
            + "<aside>Also read this other story of ours</aside><form><p>Name <input> and all of it</p></form>"
            "<section id='comments'><p>I do not agree with this article at all, says a reader.</p></section>"
            "<div class='cookie notice'>We use cookies to do things. Accept them, please.</div><footer>&copy; all of us</footer></body></html>")


def test_articles_are_found_whole():
    rng = random.Random(2)
    for _ in range(60):
        blocks = [" ".join(rng.choice(WORD) for _ in range(rng.choice([1, 3, 12, 60, 200]))) for _ in range(rng.randrange(1, 14))]
        for wrap in ("<article>{}</article>", "<main><div>{}</div></main>", "<div id='text'>{}</div>"):
            assert h.main_text(page(rng, blocks, wrap)) == "\n\n".join(blocks)


def test_white_space_references_and_blocks():
    text = "<article><h1>A  &amp;\n B&#33;</h1><p>x&nbsp;<i>y</i>z<br>w</p><ul><li>one<li>two</ul>tail</article>"
    assert h.main_text(text) == "A & B!\n\nx yz w\n\none\n\ntwo\n\ntail"


def test_awkward_pages():
    assert h.main_text(None) == h.main_text("") == h.main_text("<nav>menu</nav>") == h.main_text("<script>x") == ""
    assert h.main_text("only text") == "only text"
    assert h.main_text("<p>open <b>tags <p>and <h2>more") == "open tags\n\nand\n\nmore"
    assert h.main_text("</p></div>stray<") == "stray<"
    long = "word " * 200_000
    assert h.main_text(f"<article><p>{long}</p></article>") == long.strip()
    assert h.main_text("<div>" * 20_000 + "deep" + "</div>" * 20_000) == "deep"


def test_links_and_text_are_told_apart_without_names():
    links = "".join(f"<p><a href='{i}'>go</a> <a href='{i}'>on</a></p>" for i in range(12))
    text = "".join(f"<p>{'A real sentence of the text, ' * 6}</p>" for _ in range(5))
    assert "go" not in h.main_text(f"<body><div>{links}</div><div>{text}</div></body>")


def test_smoothing_and_threshold():
    import numpy as np
    assert np.allclose(h.smoothed(np.full(7, 3.0)), 3.0)
    cut = h.threshold(np.array([1.0, 1.2, 0.8, 5.0, 5.5]))
    assert 1.2 < cut < 5.0
    assert h.threshold(np.array([2.0, 2.0])) < 2.0


def test_column(spark):
    rows = [(1, "u", "<p>x</p>"), (1, "u", "<p>x</p>"), (None, None, None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted(r[0] for r in frame.select(h.extract(F.col("html"))).collect()) == ["", "x", "x"]
    assert frame.limit(0).select(h.extract(F.col("html"))).count() == 0


def test_markup_that_lost_whole_pages():
    assert h.main_text("<p>a</p><![foo[x]]><p>b</p>") == "a\n\nb"
    assert h.main_text("<p>a</p><![CDATA[x]]><p>b</p><![if IE]><p>c</p><![endif]><![ ") .startswith("a\n\nb\n\nc")
    text = "A real sentence of the text, with words. " * 3
    want = text.strip()
    assert h.main_text(f'<div class="layout with-sidebar"><article><p>{text}</p></article><div class="sidebar">x</div></div>') == want
    assert h.main_text(f'<article class="post has-comments"><p>{text}</p><div class="comments"><p>me too</p></div></article>') == want
    assert h.main_text(f"<div><aside>menu</div><article><p>{text}</p></article>") == want
    assert h.main_text(f"<body><aside>menu<article><p>{text}</p></article></body>") == want
    assert h.main_text(f'<body><div id="search-page"><main><p>{text}</p></main></div></body>') == want
    assert h.main_text(f"<article><p>{text}</p><section class='comments'><article><p>first!</p></article></section></article>") == want
