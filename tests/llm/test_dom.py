"""Elements whose text is skipped, closed or not."""

import pytest

pytest.importorskip("blockloom.llm")
from blockloom.llm.dom import Page  # noqa: E402


@pytest.mark.parametrize("tag", ["noscript", "svg", "object", "select", "template"])
def test_an_unclosed_element_leaves_the_rest_of_the_page(tag):
    texts = lambda source: [t for _, t in Page(source).blocks]
    assert texts(f"<p>a</p><{tag}><p>b</p><{tag}><p>c</p>") == ["a", "b", "c"]
    assert texts(f"<p>a</p><{tag}>x</{tag}><p>b</p>") == ["a", "b"]
    assert texts(f"<p>a</p><{tag}>x</{tag}><{tag}><p>b</p>") == ["a", "b"]


@pytest.mark.parametrize("tag", ["script", "style", "textarea", "title", "iframe"])
def test_unclosed_raw_text_reaches_to_the_end(tag):
    assert [t for _, t in Page(f"<p>a</p><{tag}><p>b</p>").blocks] == ["a"]


@pytest.mark.parametrize("part, more", [("<a ", ""), ("<i>", "</b>"), ('<a "', ""), ("<!x", ""), ("<h1>", ""), ("<b><p><i>", "</b>"), ("</script ", ""), ("<p class=", "")])
def test_time_is_linear_in_malformed_pages(part, more):
    import time

    def took(n):
        start = time.perf_counter()
        Page(part * n + more * n)
        return time.perf_counter() - start

    n = 250_000 // len(part + more)
    assert took(4 * n) < 12 * took(n) + 1  # a megabyte at most, and in far less than the square


def test_quotes_and_brackets_that_nothing_closes():
    texts = lambda source: [t for _, t in Page(source).blocks]
    assert texts('<p class="x>one</p><p>two</p>') == ["one", "two"]
    assert texts("plain <words") == ["plain <words"] and texts("a < b <p>c") == ["a < b", "c"]
    assert texts("one<!-- never closed <p>two") == ["one"]
