"""Main text of pages written and labelled by hand: the lines between MAIN marks are expected, whatever the generator writes."""

import pytest

from tessera.llm import maintext

#: Each page is a list of (html, text expected of it or None).
BLOG = [
    ('<html><head><title>Bread</title><script>if (a < b) { document.write("<p>no</p>") }</script></head><body class="home"><header><a href="/">The Slow Kitchen</a></header>', None),
    ('<nav class="menu"><ul><li><a href="/recipes">Recipes</a></li><li><a href="/about">About</a></li></ul></nav>', None),
    ('<main><article class="post"><h1>A loaf for a rainy Sunday</h1>', "A loaf for a rainy Sunday"),
    ("<p>My grandmother&rsquo;s bread took two days. She mixed flour &amp; water the evening before, and never weighed anything.</p>", "My grandmother’s bread took two days. She mixed flour & water the evening before, and never weighed anything."),
    ('<div class="ad">Buy the dough scraper everybody talks about!</div>', None),
    ("<p>The trick, she said, is <em>waiting</em>: the dough\n   should double,\tslowly.</p>", "The trick, she said, is waiting: the dough should double, slowly."),
    ("<ul><li>500 g strong flour</li><li>340 g water</li><li>10 g salt</li></ul></article></main>", "500 g strong flour 340 g water 10 g salt"),
    ('<section id="comments"><h3>3 comments</h3><div class="comment">Lovely, I baked it twice.</div><div class="comment">Mine did not rise.</div></section>', None),
    ('<footer><p>&copy; 2024 The Slow Kitchen. All rights reserved.</p><a href="/privacy">Privacy</a></footer></body></html>', None),
]
NEWS = [
    ('<!doctype html><body><div id="consent">We use cookies to improve your visit. <button>Accept</button></div><div class="topnav"><a href=/>Home</a> | <a href=/w>World</a> | <a href=/s>Sport</a></div>', None),
    ('<div class="content"><h1>Bridge closed until further notice</h1>', "Bridge closed until further notice"),
    ("<p>The old bridge over the river has been closed to all traffic since Monday, the council said. Engineers found cracks in two of its piers during a routine inspection.", "The old bridge over the river has been closed to all traffic since Monday, the council said. Engineers found cracks in two of its piers during a routine inspection."),
    ("<p>Repairs are expected to take at least eight months and to cost more than four million.", "Repairs are expected to take at least eight months and to cost more than four million."),
    ("<blockquote>We had no choice, said the mayor on Tuesday.</blockquote></div>", "We had no choice, said the mayor on Tuesday."),
    ('<aside class="related"><h4>More on this</h4><ul><li><a href="/1">Ferry timetable</a></li><li><a href="/2">Why bridges crack</a></li></ul></aside>', None),
    ('<form class="newsletter"><label>Get our morning letter</label><input type=email><button>Subscribe</button></form><div class="footer">Imprint &middot; Contact &middot; Jobs</div>', None),
]
DOCS = [
    ('<body><nav class="breadcrumbs"><a href="/">Docs</a> &gt; <a href="/guide">Guide</a></nav><article>', None),
    ("<h1>Reading files</h1><p>A reader opens a file, checks its header and hands out records one after the other.</p>", "Reading files A reader opens a file, checks its header and hands out records one after the other."),
    ("<h2>Options</h2><table><tr><td>strict</td><td>stop at the first fault</td></tr></table>", "Options strict stop at the first fault"),
    ("<p>Where a header is missing, the reader falls back to the defaults described below.</p></article>", "Where a header is missing, the reader falls back to the defaults described below."),
    ('<footer class="site">Built with care. <a href="/licence">Licence</a></footer></body>', None),
]
NONE = [('<body><nav><ul><li><a href="/">Home</a></li><li><a href="/x">Other</a></li></ul></nav><footer>&copy; nobody</footer></body>', None)]


@pytest.mark.parametrize("page", [BLOG, NEWS, DOCS, NONE], ids=["blog", "news", "docs", "none"])
def test_pages_by_hand(page):
    html = "\n".join(part for part, _ in page)
    assert maintext.main_texts(maintext.trained(), [html]) == [" ".join(text for _, text in page if text)]
