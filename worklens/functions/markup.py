"""Wiki HTML to Markdown, by one pass over the parser's events."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Entities that are decoded; all others stay as they are.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "#39": "'", "nbsp": " ", "#x2F": "/", "#x27": "'"}
# Tags whose content goes too, and the marks around emphasis.
DROPPED = {"ac:structured-macro", "style", "script"}
MARKS = {"strong": "**", "b": "**", "em": "*", "i": "*", "code": "`"}


class _Open:
    """An element that is open: what has been written in it, and whether only its bare text counts."""

    def __init__(self, tag: str, bare: bool, about: str = "") -> None:
        self.tag, self.bare, self.about, self.text, self.cells = tag, bare, about, [], []


class _Writer(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.stack = [_Open("", False)]
        self.silent = 0  # depth within dropped elements

    def write(self, text: str) -> None:
        if not self.silent:
            self.stack[-1].text.append(text)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in DROPPED:
            self.silent += 1
        if self.silent:
            return
        bare = self.stack[-1].bare
        if tag == "code" and not attrs or tag == "pre" or not bare and (tag in MARKS and not attrs or tag == "tr" or re.fullmatch("h[1-6]", tag)):
            self.stack.append(_Open(tag, bare or tag in ("tr", "pre") or tag[0] == "h"))
        elif tag in ("th", "td") and self.get_starttag_text()[1:3] == tag and any(o.tag == "tr" for o in self.stack):
            self.stack.append(_Open(tag, True))
        elif tag == "a" and not bare and dict(attrs).get("href") is not None:
            self.stack.append(_Open(tag, True, dict(attrs)["href"]))
        elif tag in ("br", "li") and not bare:
            self.write("\n" if tag == "br" else "- ")

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in DROPPED:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in DROPPED:
            self.silent = max(0, self.silent - 1)
        elif self.silent:
            return
        elif any(o.tag == tag for o in self.stack[1:]):
            while self.stack[-1].tag != tag:
                self._abandon()
            self._close()
        elif tag in ("p", "li") and not self.stack[-1].bare:
            self.write("\n\n" if tag == "p" else "\n")

    def _abandon(self) -> None:
        """An element that is never closed is no more than what is in it."""
        gone = self.stack.pop()
        self.stack[-1].text += gone.text

    def _close(self) -> None:
        done = self.stack.pop()
        text, tag = "".join(done.text), done.tag
        if tag in MARKS:
            self.write(MARKS[tag] + text + MARKS[tag])
        elif tag == "pre":
            self.write(f"\n```\n{text}\n```\n")
        elif tag in ("th", "td"):
            row = next(o for o in reversed(self.stack) if o.tag == "tr")
            row.cells.append((tag, text.strip()))
        elif tag == "tr":
            kind = "th" if any(t == "th" for t, _ in done.cells) else "td"
            cells = [c for t, c in done.cells if t == kind]
            if cells:
                self.write("| " + " | ".join(cells) + " |" + ("\n| " + " | ".join(["---"] * len(cells)) + " |" if kind == "th" else ""))
        elif tag == "a":
            text = text.strip()
            self.write(text if text == done.about else f"[{text}]({done.about})")
        else:
            self.write("\n" + "#" * int(tag[1]) + " " + text.strip() + "\n")

    def handle_data(self, data: str) -> None:
        self.write(data)

    def _entity(self, name: str) -> None:
        self.write(ENTITIES.get(name, f"&{name};"))

    def handle_entityref(self, name: str) -> None:
        self._entity(name)

    def handle_charref(self, name: str) -> None:
        self._entity("#" + name)

    def done(self) -> str:
        self.close()
        while len(self.stack) > 1:
            self._abandon()
        return re.sub(r"\n{3,}", "\n\n", "".join(self.stack[0].text)).strip()


def html_to_markdown(html: str | None) -> str | None:
    """Markdown of wiki HTML: headings, tables, links, code, emphasis, lists and paragraphs; all other tags go. Null stays null.

    Emphasis and code count only without attributes and if they are closed; in headings, cells and links only bare text and code do.
    """
    if html is None:
        return None
    if "<" not in html and "&" not in html:
        return re.sub(r"\n{3,}", "\n\n", html).strip()
    writer = _Writer()
    writer.feed(html)
    return writer.done()


@F.pandas_udf(StringType())
def markdown_of(html: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in html:
        yield batch.map(html_to_markdown)
