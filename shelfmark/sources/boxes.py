"""Boxes of HTML pages as rows: a table function that follows the nesting of tags."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML: elements without an end, and elements whose start ends an open one of the same kind, up to what holds them.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HOLDERS = {"li": {"ul", "ol"}, "option": {"select"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "dd": {"dl"}, "dt": {"dl"}}

SCHEMA = "place int, key string, fields map<string,string>, links array<string>, cover string, text string"


class _Box:
    def __init__(self, key: str | None):
        self.key, self.fields, self.links, self.cover, self.words = key, {}, [], None, []


class _Parser(HTMLParser):
    """Collects the elements with a tag and a class, each with the texts of its elements by class."""

    def __init__(self, tag: str, name: str, key: str):
        super().__init__(convert_charrefs=True)
        self.tag, self.name, self.key = tag, name, key
        self.found: list[_Box] = []
        #: Open elements: tag, the box that it is, and the text lists of the classes that it has in each open box.
        self.open: list[tuple[str, _Box | None, list[list[str]]]] = []
        self.skipped = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        told = dict(reversed(attrs))  # the first of equal attributes counts
        boxes = [b for _, b, _ in self.open if b]
        for box in boxes:
            box.links += [told[a] for a in ("href", "src") if told.get(a)]
            if tag == "img" and told.get("src") and box.cover is None:
                box.cover = told["src"]
        if tag in VOID:
            return
        if tag in HOLDERS:
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] == tag:
                    self.handle_endtag(tag)
                    boxes = [b for _, b, _ in self.open if b]
                    break
                if self.open[k][0] in HOLDERS[tag]:
                    break
        classes = (told.get("class") or "").split()
        # The first element of a class in a box gives the field.
        texts = [box.fields.setdefault(c, []) for box in boxes for c in classes if c not in box.fields]
        own = None
        if tag == self.tag and (not self.name or self.name in classes):
            own = _Box(told.get(self.key))
            self.found.append(own)
        self.skipped += tag in ("script", "style")
        self.open.append((tag, own, texts))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self.skipped -= sum(t in ("script", "style") for t, _, _ in self.open[k:])
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        data = data.strip()
        if data and not self.skipped:
            for _, box, texts in self.open:
                for words in [*texts, *([box.words] if box else [])]:
                    words.append(data)


def boxes(pages: DataFrame, html: str = "html", tag: str = "li", name: str = "product", key: str = "data-key") -> DataFrame:
    """pages with a row for each `tag` element of class `name` (or of any class, for name ""), whatever is nested in it.

    place (from 0, in order of the starts), key (its attribute `key`), fields (the text of the first element of each class in it), links (all href
    and src), cover (the first image), text. Pieces of text are parted by a space; script and style have none. Attributes may come in any order; an element
    that is never closed ends with what holds it or, for list items and table parts, where the next begins. A page that is null has no row.
    """

    @F.udtf(returnType=SCHEMA)
    class Boxes:
        def eval(self, page: str | None) -> Iterator[tuple]:
            if page:
                parser = _Parser(tag, name, key)
                parser.feed(page)
                parser.close()
                for place, b in enumerate(parser.found):
                    yield place, b.key, {c: " ".join(w) for c, w in b.fields.items()}, b.links, b.cover, " ".join(b.words)

    return pages.lateralJoin(Boxes(F.col(html).outer()))


def field(name: str) -> Column:
    """The text of a class in a row of `boxes`, null if it has none."""
    return F.nullif(F.trim(F.try_element_at("fields", F.lit(name))), F.lit(""))
