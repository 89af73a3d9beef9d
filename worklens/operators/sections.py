"""Markdown documents as sections and retrieval chunks with breadcrumbs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# What stands before the overlap of a chunk and behind it, and how a short section joins the chunk before it.
LEAD, BEHIND, JOINED = "…", "\n\n---\n\n", "\n\n## {heading}\n{text}"

_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
_HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")


def sections(markdown: str) -> list[tuple[int, str, str]]:
    """(depth, heading, text) between headings. Headings inside fenced code are text. A heading that another follows at once has no section."""
    out: list[tuple[int, str, str]] = []
    depth, heading, body, fence = 0, "", [], ""
    for line in re.split(r"\r\n|\r|\n", markdown) + [None]:
        m = None if line is None else _FENCE.match(line)
        if m and (not fence or m.group(1).startswith(fence)):
            fence = "" if fence else m.group(1)
        h = None if line is None or fence or m else _HEADING.match(line)
        if line is None or h:
            text = "\n".join(body).strip()
            if text or line is None and heading:
                out.append((depth, heading, text))
            if h:
                depth, heading, body = len(h.group(1)), (h.group(2) or "").strip(), []
        else:
            body.append(line)
    return out


def _parts(text: str, most: int) -> list[str]:
    """Paragraphs packed in order while they fit; a paragraph is never cut."""
    if len(text) <= most:
        return [text]
    out, size = [[]], 0
    for p in re.split(r"\n\n+", text):
        if out[-1] and size + len(p) + 2 > most:
            out.append([])
            size = 0
        size += len(p) + (2 if out[-1] else 0)
        out[-1].append(p)
    return [x for x in ("\n\n".join(o).strip() for o in out) if x]


def chunks(markdown: str | None, least: int = 50, most: int = 2000, overlap: int = 100) -> list[tuple[str, str, int, str]]:
    """(breadcrumb, heading, depth, content). A section under ``least`` joins the chunk before it; one over ``most`` is packed by
    paragraphs; each chunk begins with the end of the section before."""
    out: list[list] = []
    trail: list[tuple[int, str]] = []
    tail = ""
    for depth, heading, text in sections(markdown or ""):
        trail = [t for t in trail if t[0] < depth] + ([(depth, heading)] if heading else [])
        if out and 0 < len(text) < least:
            out[-1][3] += JOINED.format(heading=heading, text=text)
            continue
        parts = _parts(text or heading, most)
        crumb = " > ".join(h for _, h in trail)
        lead = LEAD + tail[-overlap:] + BEHIND if overlap and tail and out else ""
        for i, part in enumerate(parts):
            out.append([crumb, heading + (f" ({i + 1}/{len(parts)})" if len(parts) > 1 else ""), depth, (lead if out else "") + part])
        tail = text
    return [tuple(c) for c in out]


def chunk_pages(pages: DataFrame, key: str, text: str, least: int = 50, most: int = 2000, overlap: int = 100) -> DataFrame:
    """(key, chunk_index, breadcrumb, heading, depth, content) of each row's Markdown; a narrow stage. Null and blank texts have no chunk."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, *c) for k, t in zip(b[key], b[text]) for i, c in enumerate(chunks(t, least, most, overlap))]
            yield pd.DataFrame(rows, columns=[key, "chunk_index", "breadcrumb", "heading", "depth", "content"])

    return pages.select(key, text).mapInPandas(run, f"{key} {kind}, chunk_index int, breadcrumb string, heading string, depth int, content string")
