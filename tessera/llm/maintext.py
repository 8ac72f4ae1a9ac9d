"""HTML main-text extraction by a recurrent block labeller (operator 6).

A page becomes a sequence of blocks (leaf texts with their tag paths); a bidirectional LSTM labels each with the whole
page in view, and the main ones are joined in page order.  The labeller is trained here, on TRAINING_PAGES pages that a
generator writes with known labels: many layouts of an article among menus, headers, sidebars, notices, adverts, forms,
reader comments, related links and footers, with open tags, nested containers and made-up words of many shapes.  The
bound is that number; no row of the input is learnt from, so a page's text depends on that page alone.

Weights (a few hundred kB) travel with the function; pages are labelled in small batches where they are read, no shuffle.

Edge cases: null or empty html, and pages without main text, give the empty string; cut-off pages lose only the tag,
comment or script that the end cuts; repeated rows are labelled one by one; an empty table gives no rows; other columns
pass through, and added columns get underscores in front where their names are taken.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.blocklstm import BlockLabeller, Pages
from tessera.llm.common import column_names, in_arrow
from tessera.llm.htmlblocks import Block, blocks

TRAINING_PAGES, EPOCHS, SEED = 700, 5, 11
BATCH_PAGES, BATCH_CHARS = 128, 2_000_000
MAIN, OTHER = "", ""

#: Names that authors of pages give to their parts.
CONTAINERS = ["article", "main", "div.content", "div#content", "div.post", "div.entry-content", "section.story", "div.article-body", "div#main", "div.post-content", "div.text", "section.page", "div.body"]
MENUS = ["nav", "div.menu", "div#nav", "ul.navigation", "div.navbar", "nav.breadcrumbs", "div.toolbar", "div.topnav", "div.breadcrumb"]
HEADERS = ["header", "div.header", "div#header", "div.masthead", "header.site", "div.banner"]
FOOTERS = ["footer", "div.footer", "div#footer", "div.copyright", "footer.site", "div.legal"]
SIDES = ["aside", "div.sidebar", "div#sidebar", "div.widget", "aside.related", "div.related", "section.recommended", "div.share", "div.social", "div.tags"]
ADVERTS = ["div.ad", "div.ads", "div.advert", "div.sponsored", "div.promo", "aside.ad", "div#ad", "section.advertisement", "div.banner-ad", "ins.adsbygoogle", "div.teaser-ad"]
NOTICES = ["div.cookie", "div.notice", "div#consent", "div.alert", "div.cookie-notice", "section.gdpr", "div.popup", "div.modal", "div.banner-notice", "div.disclaimer"]
FORMS = ["form", "form.search", "form.newsletter", "div.subscribe", "div.login", "form#signup", "div.newsletter"]
COMMENTS = ["div.comments", "div#comments", "section.comments", "ol.commentlist", "div.comment", "div.discussion", "section#reader-comments", "div.replies", "ul.comment-list"]


class _Writer:
    """Writes one random page; texts begin with a mark that tells their label."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        letters = self.r.choice(["abcdefghilmnoprstu", "aeionrstldéèàç", "aeionrstlüößä", "абвгдеиклмнопрст", "aeiouñrstlmó"])
        self.syllables = ["".join(self.r.choices(letters, k=self.r.randint(1, 3))) for _ in range(30)]
        self.noise = self.r.choice(["", "", "", "%%%", "!!", " |", "###"])

    def word(self) -> str:
        found = "".join(self.r.choices(self.syllables, k=self.r.randint(1, 4)))
        return found.capitalize() if self.r.random() < 0.15 else found

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() + ("," if self.r.random() < 0.08 else "") for _ in range(self.r.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        found = [self.words(1, 18).capitalize() + self.r.choice("...?!") for _ in range(self.r.randint(low, high))]
        text = self.r.choice([" ", " ", "\n"]).join(found)
        if self.noise and self.r.random() < 0.5:
            text = " ".join(w + self.noise for w in text.split())
        return text.replace("&", "&amp;")

    def wrap(self, name: str, inside: str) -> str:
        tag, _, kind = name.replace("#", ".").partition(".")
        attribute = "id" if "#" in name else "class"
        extra = self.r.choice(["", "", f" {self.word()}"]) if kind else ""
        return f'<{tag}{f" {attribute}={chr(34)}{kind}{extra}{chr(34)}" if kind else ""}>{inside}</{tag}>'

    def links(self, mark: str) -> str:
        n = self.r.randint(2, 9)
        style = self.r.random()
        if style < 0.6:
            return "<ul>" + "".join(f'<li><a href="/x">{mark}{self.words(1, 4)}</a>{"</li>" if self.r.random() < 0.9 else ""}' for _ in range(n)) + "</ul>"
        if style < 0.8:
            return mark + " | ".join(f'<a href="#">{self.words(1, 3)}</a>' for _ in range(n))
        return "".join(f'<div><a href="/y">{mark}{self.words(1, 6)}</a></div>' for _ in range(n))

    def other(self, kind: list[str]) -> str:
        r, m = self.r, OTHER
        name = r.choice(kind)
        if kind is MENUS:
            body = self.links(m)
        elif kind is FOOTERS:
            body = r.choice([f"&copy; {m}{self.words(1, 3)} &middot; {self.sentences(1, 2)}", f"<p>{m}{self.sentences(1, 2)}</p>" + self.links(m), f"{m}&copy; 20{r.randint(10, 26)} {self.words(1, 4)}"])
        elif kind is HEADERS:
            body = r.choice([f"<h1>{m}{self.words(1, 4)}</h1>", f"<div>{m}{self.words(1, 5)}</div>" + self.links(m), self.links(m), f"<p>{m}{self.words(2, 8)}</p>"])
        elif kind is FORMS:
            body = f"<label>{m}{self.words(1, 5)}</label><input name=q>" + r.choice(["", f"<p>{m}{self.sentences(1, 2)}</p>"]) + f"<button>{m}{self.words(1, 2)}</button>"
        elif kind is COMMENTS:
            item = r.choice(["div", "li", "p", "article"])
            body = r.choice(["", f"<h3>{m}{self.words(1, 3)}</h3>"]) + "".join(f"<{item}>{m}{self.sentences(1, 4)}</{item}>" for _ in range(r.randint(1, 5)))
        elif kind is SIDES:
            body = r.choice(["", f"<h3>{m}{self.words(1, 4)}</h3>"]) + r.choice([self.links(m), f"<p>{m}{self.sentences(1, 3)}</p>", f"{m}{self.sentences(1, 2)}"])
        else:
            body = r.choice([f"{m}{self.sentences(1, 3)}", f"<p>{m}{self.sentences(1, 2)}</p>", f"<b>{m}{self.words(1, 5)}</b> {self.sentences(1, 1)}", f'<a href="/z">{m}{self.words(2, 6)}</a>'])
        return self.wrap(name, body)

    def main(self) -> str:
        r, m, parts = self.r, MAIN, []
        if r.random() < 0.85:
            parts.append(f"<h{(k := r.choice([1, 1, 1, 2]))}>{m}{self.words(1, 10)}</h{k}>")
        for _ in range(r.choice([0, 1, 2, 3, 5, 8, 13])):
            style = r.random()
            text = self.sentences(1, r.choice([1, 2, 4, 8]))
            if style < 0.55:
                parts.append(f"<p>{m}{text}</p>")
            elif style < 0.65:
                parts.append(f"<p>{m}{text}")
            elif style < 0.75:
                parts.append(f"<p><b>{m}{self.words(2, 8)}<br><p>{m}{text}" + r.choice(["", "</p>"]))
            elif style < 0.8:
                parts.append(f"<h{(k := r.randint(2, 4))}>{m}{self.words(1, 6)}</h{k}>")
            elif style < 0.86:
                parts.append("<ul>" + "".join(f"<li>{m}{self.words(1, 9)}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
            elif style < 0.9:
                parts.append(f"<blockquote>{m}{text}</blockquote>")
            elif style < 0.93:
                parts.append("<table>" + "".join(f"<tr><td>{m}{self.words(1, 3)}</td><td>{m}{self.words(1, 3)}</td></tr>" for _ in range(r.randint(1, 3))) + "</table>")
            elif style < 0.96:
                parts.append(f"<div>{m}{text}</div>")
            else:
                parts.append(f'<p><a href="/w">{m}{self.words(1, 4)}</a> {text}</p>')
        if not parts:
            parts.append(f"<p>{m}{self.sentences(1, 2)}</p>")
        for kind in (ADVERTS, ADVERTS, SIDES, FORMS, NOTICES):
            if r.random() < 0.3:
                parts.insert(r.randint(0, len(parts)), self.other(kind))
        return "".join(parts)

    def page(self) -> str:
        r = self.r
        body = [self.other(kind) for kind, share in ((NOTICES, 0.3), (HEADERS, 0.5), (MENUS, 0.75), (ADVERTS, 0.5), (FORMS, 0.2), (SIDES, 0.2)) if r.random() < share]
        if r.random() < 0.3:
            r.shuffle(body)
        inside = self.main()
        name = r.choice(CONTAINERS) if r.random() < 0.6 else "article"
        if name == "article" and r.random() < 0.2:
            inside = f"<header>{inside.replace('</h1>', '</h1></header>', 1)}" if inside.startswith("<h1>") else inside
        if r.random() < 0.1:
            inside += self.other(COMMENTS)
        middle = self.wrap(name, inside)
        if r.random() < 0.25:
            middle = self.wrap(r.choice(["main", "div.container", "div.wrapper", "div#page", "div.row", "section"]), middle + (self.other(SIDES) if r.random() < 0.5 else ""))
        after = [self.other(kind) for kind, share in ((ADVERTS, 0.2), (COMMENTS, 0.35), (SIDES, 0.35), (FORMS, 0.2), (MENUS, 0.15), (NOTICES, 0.15), (FOOTERS, 0.8)) if r.random() < share]
        return f"<html><head><title>x</title></head><body>{''.join(body)}{middle}{''.join(after)}</body></html>"


def generated(seed: int) -> tuple[list[Block], list[int]]:
    """The blocks of a generated page, without marks, and their labels."""
    found, labels = [], []
    for block in blocks(_Writer(seed).page()):
        labels.append(int(MAIN in block.text))
        found.append(block._replace(text=block.text.replace(MAIN, "").replace(OTHER, "")))
    return found, labels


@cache
def trained(pages: int = TRAINING_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> BlockLabeller:
    """The labeller, trained once in a process; the same pages, order and weights each time."""
    made = [generated(seed * 1_000_003 + k) for k in range(pages)]
    labeller = BlockLabeller(seed)
    labeller.train([b for b, _ in made], [x for _, x in made], epochs)
    return labeller


def main_texts(labeller: BlockLabeller, htmls: list[str | None]) -> list[str]:
    """Main text of each page."""
    pages = [blocks(html) for html in htmls]
    likely = labeller.probabilities(Pages(pages)) >= 0.5
    out, at = [], 0
    for page in pages:
        out.append(" ".join(block.text for block, keep in zip(page, likely[at : at + len(page)]) if keep))
        at += len(page)
    return out


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text", labeller: BlockLabeller | None = None) -> DataFrame:
    """``pages`` with the main text of ``html_col``; narrow, no shuffle."""
    (name,) = column_names(pages, text_col)
    at, model = pages.columns.index(html_col), labeller or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            htmls, begin, size = batch.column(at).to_pylist(), 0, 0
            for i, html in enumerate(htmls):
                size += len(html or "")
                if size >= BATCH_CHARS or i + 1 - begin >= BATCH_PAGES or i + 1 == len(htmls):
                    part = batch.slice(begin, i + 1 - begin)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(main_texts(model, htmls[begin : i + 1]), pa.string())], names=[*part.schema.names, name])
                    begin, size = i + 1, 0

    return pages.transform(in_arrow, run, T.StructType([*pages.schema.fields, T.StructField(name, T.StringType())]))
