"""Markdown to a tree of document nodes (as JSON) and back to text; one row at a time, in Arrow batches."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The kinds of nodes that end with a line, of those that trackers' documents have.
BLOCKS = set("doc paragraph heading listItem bulletList orderedList tableRow tableCell tableHeader codeBlock blockquote mediaSingle rule taskList taskItem".split())
_SPAN = re.compile(r"`(?P<code>[^`]+)`|\[(?P<label>[^\]]+)\]\((?P<to>[^)\s]+)\)|\*\*(?P<strong>.+?)\*\*|\*(?P<em>[^*]+)\*|(?P<url>https?://[^\s)>\]]+)")
_ITEM = re.compile(r"(?P<pad>[ \t]*)(?:(?P<dot>[-*+])|(?P<num>\d+)[.)])[ \t]+(?:\[(?P<box>[ xX])\][ \t]+)?(?P<text>.*)$")


def _text(text: str, *marks: dict) -> dict:
    return {"type": "text", "text": text, **({"marks": list(marks)} if marks else {})}


def inline(text: str) -> list[dict]:
    """Text nodes of a line: code, links, strong, emphasis and bare addresses are marked."""
    out, last = [], 0
    for m in _SPAN.finditer(text):
        if m.start() > last:
            out.append(_text(text[last : m.start()]))
        last, kind = m.end(), m.lastgroup
        if kind == "to":
            out.append(_text(m["label"], {"type": "link", "attrs": {"href": m["to"]}}))
        elif kind == "url":
            out.append(_text(m["url"], {"type": "link", "attrs": {"href": m["url"]}}))
        else:
            out.append(_text(m[kind], {"type": kind}))
    return out + ([_text(text[last:])] if last < len(text) else [])


def _list(items: list[re.Match]) -> tuple[dict, list[re.Match]]:
    """The list that the first of ``items`` begins, and the items behind it. Deeper ones are lists within the item before them."""
    head = items[0]
    depth, task, ordered = len(head["pad"]), head["box"] is not None, head["num"] is not None
    node = {"type": "taskList" if task else "orderedList" if ordered else "bulletList", "content": []}
    while items:
        m = items[0]
        if len(m["pad"]) < depth or len(m["pad"]) == depth and ((m["box"] is not None) != task or (m["num"] is not None) != ordered):
            break
        if len(m["pad"]) > depth:
            inner, items = _list(items)
            node["content"][-1]["content"].append(inner)
            continue
        items = items[1:]
        if task:
            node["content"].append({"type": "taskItem", "attrs": {"state": "TODO" if m["box"] == " " else "DONE"}, "content": inline(m["text"])})
        else:
            node["content"].append({"type": "listItem", "content": [{"type": "paragraph", "content": inline(m["text"])}]})
    return node, items


def tree_of(markdown: str | None) -> dict:
    """The document of a Markdown text: headings, rules, fenced code, lists of bullets, numbers and tasks, nested or not, and paragraphs. Null is an empty document."""
    blocks: list[dict] = []
    lines = re.split(r"\r\n|\r|\n", markdown or "")
    i = 0
    while i < len(lines):
        line = lines[i]
        i += 1
        fence = re.match(r" {0,3}(`{3,}|~{3,})[ \t]*(\w*)", line)
        if fence:
            body = []
            while i < len(lines) and not re.match(rf" {{0,3}}{re.escape(fence[1])}", lines[i]):
                body.append(lines[i])
                i += 1
            i += 1
            blocks.append({"type": "codeBlock", **({"attrs": {"language": fence[2]}} if fence[2] else {}), "content": [_text("\n".join(body))] if body else []})
        elif h := re.match(r"(#{1,6})[ \t]+(.*?)[ \t]*$", line):
            blocks.append({"type": "heading", "attrs": {"level": len(h[1])}, "content": inline(h[2])})
        elif re.fullmatch(r" {0,3}([-*_])[ \t]*(?:\1[ \t]*){2,}", line):
            blocks.append({"type": "rule"})
        elif m := _ITEM.match(line):
            items = [m]
            while i < len(lines) and (m := _ITEM.match(lines[i])):
                items.append(m)
                i += 1
            while items:
                node, items = _list(items)
                blocks.append(node)
        elif line.strip():
            blocks.append({"type": "paragraph", "content": inline(line.strip())})
    return {"type": "doc", "version": 1, "content": blocks}


def text_of(node: object) -> str:
    """The text of a document: a line for each block, with signs before headings, items, tasks and around code. Anything else is empty."""
    if not isinstance(node, dict):
        return ""
    kind = node.get("type")
    if kind == "text":
        return node.get("text") or ""
    attrs = node.get("attrs") or {}
    inner = "".join(text_of(c) for c in node.get("content") or [] if isinstance(node.get("content"), list))
    sign = {"heading": "#" * int(attrs.get("level") or 1) + " ", "listItem": "- ", "taskItem": "- [x] " if attrs.get("state") == "DONE" else "- [ ] "}.get(kind, "")
    inner = f"```\n{inner}\n```" if kind == "codeBlock" else sign + inner
    return inner + "\n" if inner and kind in BLOCKS else inner


def _parsed(text: str | None) -> object:
    try:
        return json.loads(text) if text else None
    except ValueError:
        return None


@F.pandas_udf(StringType())
def tree_json(markdown: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in markdown:
        yield batch.map(lambda t: json.dumps(tree_of(t), ensure_ascii=False))


@F.pandas_udf(StringType())
def tree_text(tree: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in tree:
        yield batch.map(lambda t: text_of(_parsed(t)))
