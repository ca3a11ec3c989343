import time

import pytest

from veedor.llm.html_text import Tags, extract, main_text, second_pass

LONG = "the quick story of the fox and the dog is one that was told by many in the town for years on end and to all of them it is as good as new " * 2


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""), ("", ""), ("   ", ""), ("just words", "just words"), ("<", "<"), ("<p>a", "a"), ("<!-- never closed <p>x", ""),
        ("<p>&lt;b&gt; &amp;  &eacute;\n&#233;&nbsp;x</p>", "<b> & é é x"),
        (f"<nav><a href=x>Home</a></nav><article><h1>Title</h1><p>{LONG}</p><p>Short.</p><script>var p='<p>no</p>'</script></article><footer>© x</footer>",
         f"Title\n{LONG.strip()}\nShort."),
        (f"<div class=ad>{LONG}</div><div><p>{LONG}</p><p>End.</p></div><div id=comments><p>{LONG}</p></div>", f"{LONG.strip()}\nEnd."),
        (f"<div class='with-sidebar'><main><p>{LONG}</p></main><aside>{LONG}</aside></div>", LONG.strip()),
        (f"<p>{LONG}</p><form><p>{LONG}</p></form><ul><li><a href=1>one link</a></li><li><a href=2>two links</a></li></ul>", LONG.strip()),
        (f"<article><p>{LONG}<br><p>b<section class=comments><article><p>{LONG}</p></article></section></article>", f"{LONG.strip()}\nb"),
        (f"<style>p{{}}</style><p>{LONG}</p><!-- <p>hidden</p> --><p hidden>{LONG}</p>", LONG.strip()),
    ],
)
def test_pages(page, want):
    assert main_text(page) == want


def test_second_pass():
    g, b, o = "good", "bad", "open"
    assert second_pass([o, g, o, b, o]) == [True, True, True, False, False]
    assert second_pass([g, o, o, o, b, o]) == [True, True, True, False, False, False]
    assert second_pass([o, o]) == [False, False] and second_pass([]) == []


def test_table(spark):
    rows = [(1, "u", "<p>one"), (1, "u", "<p>one"), (2, None, None), (None, "v", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'old' AS text", "5 AS row")
    found = extract(pages)
    assert found.columns == ["page_id", "url", "row", "text"]
    assert sorted(r.text for r in found.collect()) == ["", "", "one", "one"]
    assert extract(pages.limit(0)).count() == 0


def test_many_unclosed_tags():
    assert main_text("<p><b>x" * 20_000).count("\n") == 19_999


@pytest.mark.parametrize("unit", ["<a '", '<a href="', "<b x ", "<a", "<!", "<nav><main>", "<p '\"", "</a '", "<a b='\">", "<script"])
def test_broken_markup_takes_one_pass(unit):
    """1 MB of it: scanning again from every tag would take minutes."""
    begin = time.process_time()
    text = main_text("<p>" + LONG + "</p>" + unit * (1_000_000 // len(unit)))
    assert time.process_time() - begin < 10
    assert text.startswith(LONG.strip()) or "<main>" in unit  # an unclosed main has no text of its own


def test_tags():
    """Names, attributes and ends; what is never closed is text."""
    page = "a<b c='>'>d</E ><!-- <x> --><!doctype y><1><f/><g \"h<i>"
    scan, at, found = Tags(page), 0, []
    while tag := scan.after(at):
        at = tag.end
        found.append((page[tag.start : tag.end], tag.closing, tag.name, tag.attributes))
    assert found == [
        ("<b c='>'>", False, "b", " c='>'"), ("</E >", True, "E", " "), ("<!-- <x> -->", False, "", ""), ("<!doctype y>", False, "", ""),
        ("<f/>", False, "f", "/"), ("<i>", False, "i", ""),
    ]
