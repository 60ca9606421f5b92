"""Main text of made pages."""

import pytest

from quarterline.llm import html_extract as h

CASES = {
    "article": ("<html><body><nav><a>m</a></nav><article><h1>T &amp; U</h1><p>a\n <b>b</b><br>c<p>d</article><footer>f</footer>", "T & U\n\na b c\n\nd"),
    "broken": ('<article><p><b>One.<br><p>Two <i>x</p><!-- no --><script>var t="</p>";</script><p title="a>b">Three', "One.\n\nTwo x\n\nThree"),
    "comments": ('<main><article><p>Body</p><section class="comments"><p>I disagree</p></section><div id="ad-1">Buy</div></article></main>', "Body"),
    "wrapped": ('<form><div class="with sidebar"><article><header><h1>H</h1></header><p>x</p><aside>y</aside></article></div></form>', "H\n\nx"),
    "main only": ("<body><header>site</header><main><div>one<div>two</div>three</div></main><div class='cookie-notice'>ok?</div>", "one\n\ntwo\n\nthree"),
    "lists": ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "a\n\nb\n\nc\n\nd"),
    "references": ("<article><p>&lt;p&gt; &eacute;&#8364;&nbsp;x &unknown; 1 < 2</p></article>", "<p> é€ x &unknown; 1 < 2"),
    "inline noise": ('<article><p>see <span class="ad">buy</span> this</p></article>', "see\n\nthis"),
    "empty": ("", ""),
    "no markup": ("just  text", "just text"),
    "hidden": ('<body><div hidden>no</div><div style="display: none">no</div><p>yes</p>', "yes"),
    "open comment": ("<article><p>a</p></article><!-- rest <p>b", "a"),
    "open script": ("<article><p>a</p><script>x <p>b</p>", "a"),
}


@pytest.mark.parametrize("name", CASES)
def test_page(name):
    html, text = CASES[name]
    assert h.main_text(html, []) == text


@pytest.mark.parametrize("unit", ["<p", "<!--", '<a x="', "</b>", "<div>", "<p><b>x", "&amp;", "<script>"])
def test_long_broken_pages_end(unit):
    h.main_text(unit * 3000, [])


def page(i, host="h.org"):
    return f"<html><body><div><span>Our daily paper</span></div><div><p>Story number {i} of many.</p><p>More {i}</p></div><div>Printed in town</div></body></html>"


def test_fixed_text_of_a_host_is_template(spark):
    rows = [(i, f"http://h.org/{i}", page(i)) for i in range(6)] + [(7, "http://other.net/", page(7)), (8, None, page(8)), (9, "http://h.org/9", None)]
    rows += [(10 + i, "HTTPS://me@Same.org:80/", "<article><p>always the same</p></article>") for i in range(5)]
    rows += [(0, "http://h.org/0", page(0))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumnRenamed("page_id", "HOST")
    done, text = h.extract(pages)
    got = {r.HOST: r[text] for r in done.collect()}
    assert got[3] == "Story number 3 of many.\n\nMore 3" and got[0] == "Story number 0 of many.\n\nMore 0"
    assert got[7].startswith("Our daily paper") and got[8].startswith("Our daily paper") and got[9] == ""
    assert all(got[10 + i] == "always the same" for i in range(5))
    assert done.columns == ["HOST", "url", "html", text] and done.count() == len(rows)
    assert h.extract(pages.limit(0))[0].count() == 0


def test_classes_are_equal_vectors(spark):
    rows = [(f"h.org", page(i)) for i in range(5)] + [("h.org", "<p>odd page</p>")]
    out = h.templates(spark.createDataFrame(rows, "host string, html string")).collect()
    assert len(out) == 1 and len(out[0].classes) >= 1
    fixed = {t for c in out[0].classes for t in c}
    texts = {t for t, is_text, *_ in h.page_tokens(page(99)) if is_text}
    assert len(texts & fixed) == 2


STORY = "Somebody saw the thing number {} happen on the day and told us all about it."


def inside(i, share="Share this story with friends", host="h.org"):
    return f"<body><article><h1>Headline {i}</h1><p>{STORY.format(i)}</p><div><p>{share}</p></div></article></body>"


def test_host_text_inside_articles_is_template(spark, monkeypatch):
    rows = [(i, "http://h.org/", inside(i)) for i in range(6)]
    rows += [(10 + i, "http://same.org/", inside(1)) for i in range(6)]  # one article on all pages
    rows += [(20 + i, "http://few.org/", inside(i // 3)) for i in range(6)]  # two articles only
    near = "".join(f"<p>{STORY.format(k)}</p>" for k in range(5))
    rows += [(30 + i, "http://near.org/", f"<article>{near}<p>{STORY.format(0) * 2} {i}</p></article>") for i in range(6)]
    made = spark.createDataFrame(rows, "page_id long, url string, html string")
    done, text = h.extract(made)
    got = {r.page_id: r[text] for r in done.collect()}
    monkeypatch.setattr(h, "MAX_BROADCAST", 0)  # shuffled by host, the same texts
    assert got == {r.page_id: r[text] for r in h.extract(made)[0].collect()}
    assert all(got[i] == f"Headline {i}\n\n{STORY.format(i)}" for i in range(6))
    assert all(got[i].endswith("Share this story with friends") for i in [*range(10, 16), *range(20, 26)])
    assert all(got[30 + i].startswith(STORY.format(0) + "\n\n" + STORY.format(1)) for i in range(6))


def test_templates_against_plain_vectors(spark):
    """Fixed tokens are those of brute-force occurrence vectors, by page outside and by distinct article inside."""
    pages = [page(i) for i in range(5)] + [inside(i % 4, "Share" if i % 3 else "Other") for i in range(9)]
    out = h.templates(spark.createDataFrame([("h.org", x) for x in pages], "host string, html string")).collect()
    on, of = {}, {}
    for i, x in enumerate(pages):
        found = h.page_tokens(x)
        article = next((t for t, kind, *_ in found if kind == h.WHOLE), None)
        for t, kind, *_ in found:
            of.setdefault(kind == h.INSIDE, set()).add(article if kind == h.INSIDE else i)
            on.setdefault((t, kind), set()).add(article if kind == h.INSIDE else i)
    often = lambda k: len(on[k]) >= max(h.MIN_PAGES, h.MIN_SHARE * (len(of[True]) if k[1] == h.INSIDE else len(pages)))
    expected = {t for t, kind in on if kind in (h.TEXT, h.INSIDE) and often((t, kind))}
    texts = {t for t, kind in on if kind in (h.TEXT, h.INSIDE)}
    assert expected and {t for r in out for c in r.classes for t in c} & texts == expected
