from conftest import SF

from perimetra.llm import maintext

PROSE = "A long sentence of the article that goes on for quite a while, so that its ratio of text to tags is high. "


def page(body, head="<title>t</title>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


def test_article_without_what_surrounds_it():
    html = page(
        "<header><a href='/'>Site</a></header><nav><ul><li><a href='/a'>A</a><li><a href='/b'>B</a></ul></nav><div class='cookie-notice'>We use cookies on this site, lots of them.</div>"
        f"<article><header><h1>Head &amp; line</h1></header><p>{PROSE}<br>Next&nbsp;bit\n here.<p>Short.<div class='ad-slot'>{PROSE}</div><ul><li>one</li><li>two <b>bold</b>er</li></ul>"
        "<form><p>Name</p><input></form><table><tr><td>1</td><td>2</td></tr></table><script>var a='<p>no</p>'</script></article>"
        f"<aside><p>{PROSE}</p></aside><section id='comments'><p>{PROSE}</p></section><footer>&copy; me</footer>"
    )
    assert maintext.main_text(html).split("\n") == ["Head & line", PROSE.strip() + " Next bit here.", "Short.", "one", "two bolder", "1 2"]


def test_pages_that_mark_no_article():
    html = page(
        "<div class='menu'><a href='/'>Home</a> <a href='/x'>More</a></div><div><a href='/l'>A list of links</a></div><h1>Title</h1>"
        f"<div><p>{PROSE}</p><p>{PROSE}{PROSE}</p><p>Tiny.</p><p>{PROSE}</p></div><div class='sidebar'><p>{PROSE}</p></div><div id='footer'>(c)</div>"
    )
    assert maintext.main_text(html).split("\n") == ["Title", PROSE.strip(), (PROSE * 2).strip(), "Tiny.", PROSE.strip()]


def test_an_advert_left_open_does_not_swallow_the_article():
    assert maintext.main_text(page(f"<div class='ad'>Buy<article><h1>T</h1><p>{PROSE}</article>")) == "T\n" + PROSE.strip()


def test_a_name_that_tells_what_a_page_has_is_no_mark():
    assert maintext.main_text(page(f"<div class='page has-sidebar'><h1>T</h1><p>{PROSE}</p><div class='sidebar'>{PROSE}</div></div>")) == "T\n" + PROSE.strip()


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p"), (4, "u", "<nav>only</nav>"), (None, "u", page(f"<main><p>{PROSE * 3000}</main>")), (4, "u", "<nav>only</nav>")]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, text int")
    got = [tuple(r) for r in maintext.extracted(pages).collect()]
    assert [(i, u, len(t)) for i, u, t in got] == [(1, "u", 0), (2, None, 0), (3, "u", len(got[2][2])), (4, "u", 0), (None, "u", len(PROSE) * 3000 - 1), (4, "u", 0)]
    assert maintext.extracted(pages.where("false")).collect() == []


def test_given_pages_give_their_article(spark):
    import html as h
    import re

    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        parts = [" ".join(h.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert maintext.main_text(r.html) == "\n".join(p for p in parts if p)
