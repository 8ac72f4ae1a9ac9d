"""Self-closed foreign elements, and text inside formulas, objects and canvases."""

from collections import Counter

import pytest

from tessera.llm.htmlblocks import NAMES, blocks, number_of


@pytest.mark.parametrize("closed", ["<svg/>", '<svg class="icon" />', "<math/>", '<math display="block" />'])
@pytest.mark.parametrize("later", ["", "<svg><title>x</title></svg><math></math>"])
def test_self_closed_foreign_elements_end_there(closed, later):
    found = [b.text for b in blocks(f"<div>{closed}<p>First.</p><p>Second.</p>{later}</div>")]
    assert found == ["First.", "Second."]


def test_formula_object_and_canvas_text_stays():
    page = "<p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p><object data=a.pdf><p>Fallback one.</p></object><canvas>Fallback two.</canvas>"
    assert [b.text for b in blocks(page)] == ["So x=2 holds.", "Fallback one.", "Fallback two."]


def test_raw_elements_stay_out():
    assert [b.text for b in blocks("<p>a<script/>no</script>b</p><svg><text>no</text></svg><p>c</p>")] == ["ab", "c"]


@pytest.mark.parametrize(
    "page, texts",
    [
        ("<div title=don't>It's text one</div><p>second it's</p>", ["It's text one", "second it's"]),
        ('<p class="x>broken</p><p class="y">next "quoted" one</p>', ["broken", 'next "quoted" one']),
        ("<p class='x>broken</p><p>it's next</p>", ["broken", "it's next"]),
        ('<p title="a > b">in</p><p title=\'c > d\' id=e>out</p>', ["in", "out"]),
        ('<a href="x"class="y">tight</a><p data-x = "1" >wide</p>', ["tight", "wide"]),
        ('<p title="5" 6">inches</p>', ["inches"]),
    ],
)
def test_quotes_swallow_no_text(page, texts):
    assert [b.text for b in blocks(page)] == texts


def test_paths_of_deep_pages_are_whole():
    """The names in the middle of a deep path count as well: the same vector as of the names one by one."""
    names = [f"c{'abcdefghij'[k % 10]}{'klmnopq'[k % 7]}" for k in range(90)]
    page = "".join(f'<div class="{n}">' for n in names) + "text" + "</div>" * 60 + "<p>more</p>"
    first, second = blocks(page)
    assert len(first.path) <= NAMES and sum(first.counts) == 180
    expected = Counter(number_of(n) for n in ["div"] * 90 + [f".{n}" for n in names])
    assert dict(zip(first.path, first.counts)) == expected
    assert second.path == tuple(x for n in names[:30] for x in ("div", f".{n}")) + ("p",) and second.counts == ()


def test_deep_pages_take_linear_time():
    import time

    began = time.perf_counter()
    for tag in ("div", "blockquote", "b", "h2"):
        found = blocks(f"<{tag}>x" * 20_000 + f"</{tag}></i>" * 20_000 + "<p>end</p>")
        assert found[-1].text.endswith("end")
    assert time.perf_counter() - began < 20
