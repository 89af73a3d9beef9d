"""Splitting oversized items at natural boundaries, by byte ranges.

A text is cut into byte ranges. Each range is summed up as a transition: for each state in which it may be entered
(between blocks, in a run of lines, in a fence of backticks or tildes, and how the line that crosses its start has begun)
the state in which it is left, and its numbers of blocks and code points. Transitions compose, so scanning them gives
every range its entry state, block number and offsets. Knowing these, a range finds the boundaries within it and a halo
behind it, and sums up where a cut that enters it leaves it; scanning that gives every range its first cut, and each
range then emits its pieces by offset. No worker holds more than a range and its halo, however long a line is: what a
line is, is known from how it begins, and a line that goes on for ranges is carried as one of 16 ways to have begun.

Items of up to ``range_bytes`` are one range each, entered at the start of a text; whole batches of them are worked on at
once without an exchange. Longer ones, and files, go through the exchanges of the scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from worklens.llm.scan import Automaton, buffers
from worklens.plans.lineage import cut, parallelism
from worklens.sources.tables import latest_rows, load

APART, TEXT, TICKS, TILDES = range(4)  # states before a line
(L_TICKS, L_TILDES, L_BLANK, L_HEADING, L_OTHER, L_ITEM) = range(6)  # letters: kinds of lines; L_ITEM: an item begins


def _steps() -> np.ndarray:
    step = np.zeros((6, 4), np.uint8)
    for letter in range(6):
        for s in range(4):
            if letter == L_ITEM:
                t = APART
            elif s in (TICKS, TILDES):
                t = APART if letter == (L_TICKS if s == TICKS else L_TILDES) else s
            else:
                t = {L_TICKS: TICKS, L_TILDES: TILDES, L_OTHER: TEXT}.get(letter, APART)
            step[letter, s] = t
    return step


LINES = Automaton(_steps())


class Lines:
    """The lines of UTF-8 bytes ``data`` that begin at or after ``begins[i]`` of item i and before its ``ends[i]``.

    start, stop: bytes of each line without its end; item: to which it belongs; kind: its letter; point: code points
    before each byte, a line end of ``\\r\\n`` counted as one.
    """

    def __init__(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> None:
        n = len(data)
        after = np.append(data[1:], 0).astype(np.uint8) if n else data
        crlf = (data == 13) & (after == 10)
        last = ends[ends > begins] - 1
        crlf[last] = False  # a pair never spans two items
        point = (data & 0xC0) != 0x80
        point &= ~crlf
        self.point = np.append(0, np.cumsum(point))
        brk = np.flatnonzero((data == 10) | (data == 13) & ~crlf)
        some = np.flatnonzero(ends > begins)
        start = np.concatenate([begins[some], brk + 1])
        item = np.concatenate([some, np.searchsorted(begins[some], brk, side="right") - 1])
        item[len(some) :] = some[item[len(some) :]] if len(some) else item[len(some) :]
        keep = start < ends[item] if len(some) else np.zeros(len(start), bool)
        keep[len(some) :] &= start[len(some) :] > begins[item[len(some) :]] if len(some) else False
        order = np.argsort(start[keep], kind="stable")
        self.start, self.item = start[keep][order], item[keep][order]
        upto = np.append(self.start[1:], n) if len(self.start) else self.start
        upto = np.minimum(upto, ends[self.item]) if len(self.start) else upto
        stop = upto.copy()
        for _ in range(2):  # the line end, of one or two bytes
            tail = np.maximum(stop - 1, 0)
            cutoff = (stop > self.start) & np.isin(data[tail], (10, 13)) if n else stop > stop
            if _ == 1:
                cutoff &= (data[tail] == 13) & (np.minimum(upto, n) - stop == 1) & (data[np.minimum(stop, n - 1)] == 10)
            stop = stop - cutoff
        self.stop, self.upto = stop, upto
        self.kind = self._kinds(data)

    def _kinds(self, data: np.ndarray) -> np.ndarray:
        kind = np.full(len(self.start), L_OTHER, np.uint8)
        if not len(self.start):
            return kind
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        at = np.append(np.flatnonzero(data != 32), len(data))
        first = np.minimum(at[np.searchsorted(at, self.start)], self.stop)
        for letter, c in ((L_TICKS, 96), (L_TILDES, 126)):
            three = (padded[first] == c) & (padded[first + 1] == c) & (padded[first + 2] == c) & (first + 3 <= self.stop)
            kind[three] = letter
        nbsp = (data == 0xC2) & (np.append(data[1:], 0) == 0xA0)
        space = (data == 32) | (data == 9) | nbsp
        space[1:] |= nbsp[:-1]
        at = np.append(np.flatnonzero(~space), len(data))
        kind[at[np.searchsorted(at, self.start)] >= self.stop] = L_BLANK
        hashes = np.zeros(len(self.start), np.int64)
        for i in range(7):
            hashes += (hashes == i) & (padded[self.start + i] == 35)
        heading = (hashes >= 1) & (hashes <= 6) & (padded[self.start + hashes] == 32) & (self.start + hashes < self.stop)
        kind[heading & (kind == L_OTHER)] = L_HEADING
        return kind

    def states(self, entry: int = APART, fresh: bool = True) -> tuple[np.ndarray, int]:
        """The state before each line, and the transition of all lines. ``fresh``: every item begins apart; else the first has state ``entry``."""
        if not len(self.start):
            return np.zeros(0, np.uint8), 0
        new = np.flatnonzero(np.diff(self.item, prepend=-1))
        if not fresh:
            new = new[1:]
        letters = np.insert(self.kind, new, L_ITEM)
        state, whole = LINES.states_before(letters, entry)
        return np.delete(state, new + np.arange(len(new))), whole

    def blocks(self, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return in_blocks(self.kind, state)


def in_blocks(kind: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each line begins a block, and whether it continues the block before, by its kind and the state before it."""
    fenced = (state == TICKS) | (state == TILDES)
    opens = ~fenced & ((kind == L_TICKS) | (kind == L_TILDES))
    text = ~fenced & (kind == L_OTHER)
    return opens | text & (state != TEXT), fenced | text & (state == TEXT)


def large_blocks(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Item number and block number, from 1, of the blocks of more than ``limit`` code points."""
    lines = Lines(data, begins, ends)
    if not len(lines.start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    state, _ = lines.states()
    opens, goes_on = lines.blocks(state)
    first = np.flatnonzero(opens)
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = np.flatnonzero(opens | goes_on)
    last = inside[np.searchsorted(inside, np.append(first[1:], len(opens))) - 1]
    points = lines.point[lines.stop[last]] - lines.point[lines.start[first]]
    items = lines.item[first]
    number = np.arange(len(first)) - np.searchsorted(items, items) + 1
    big = points > limit
    return items[big], number[big]


def _sentence_ends(data: np.ndarray) -> np.ndarray:
    """Bytes after which a sentence has ended: after . ! ? and a blank, or after a full stop of East Asian scripts."""
    if len(data) < 3:
        return np.zeros(0, np.int64)
    stop = (data[:-1] == 46) | (data[:-1] == 33) | (data[:-1] == 63)
    latin = np.flatnonzero(stop & ((data[1:] == 32) | (data[1:] == 10) | (data[1:] == 13))) + 2
    wide = (data[:-2] == 0xE3) & (data[1:-1] == 0x80) & (data[2:] == 0x82) | (data[:-2] == 0xEF) & (data[1:-1] == 0xBC) & ((data[2:] == 0x81) | (data[2:] == 0x9F))
    return np.union1d(latin, np.flatnonzero(wide) + 3)


# How a line has begun: enough to know its kind when it ends.
(EMPTY, SPACES, BLANKS, HEADING, FENCE_TICKS, FENCE_TILDES, OTHER, TICK1, TICK2, TILDE1, TILDE2, HASH1) = range(12)  # HASH1 to HASH1 + 5: one to six
BEGUN = HASH1 + 6
KIND_OF = np.full(BEGUN, L_OTHER, np.uint8)
KIND_OF[[EMPTY, SPACES, BLANKS]] = L_BLANK
KIND_OF[[HEADING, FENCE_TICKS, FENCE_TILDES]] = L_HEADING, L_TICKS, L_TILDES


def begun(so_far: int, data: np.ndarray, a: int, b: int) -> int:
    """How a line has begun after its bytes ``a`` to ``b`` (no line end among them), if it had begun as ``so_far`` before them."""

    def blank(i: int) -> bool:
        c = data[i]
        return c in (32, 9) or c == 0xC2 and i + 1 < len(data) and data[i + 1] == 0xA0 or c == 0xA0 and i > 0 and data[i - 1] == 0xC2

    i = a
    while i < b and so_far not in (HEADING, FENCE_TICKS, FENCE_TILDES, OTHER):
        c = int(data[i])
        if so_far in (EMPTY, SPACES, BLANKS):
            if c == 32:
                run = np.flatnonzero(data[i : min(b, i + 64)] != 32)
                if not len(run):
                    run = np.flatnonzero(data[i:b] != 32)
                i += int(run[0]) if len(run) else b - i
                so_far = SPACES if so_far == EMPTY else so_far
                continue
            if blank(i):
                so_far = BLANKS
            elif so_far == BLANKS:
                so_far = OTHER
            else:
                so_far = {96: TICK1, 126: TILDE1, 35: HASH1 if so_far == EMPTY else OTHER}.get(c, OTHER)
        elif so_far in (TICK1, TICK2):
            so_far = (TICK2 if so_far == TICK1 else FENCE_TICKS) if c == 96 else OTHER
        elif so_far in (TILDE1, TILDE2):
            so_far = (TILDE2 if so_far == TILDE1 else FENCE_TILDES) if c == 126 else OTHER
        elif c == 35 and so_far < HASH1 + 5:
            so_far += 1
        else:
            so_far = HEADING if c == 32 else OTHER
        i += 1
    return so_far


class Range:
    """Bytes ``a`` to ``b`` of ``data``, what lies around them read as lead and halo; ``last``: the text ends with it.

    The line end of ``\\r\\n`` belongs to the range of its ``\\n``.
    """

    def __init__(self, data: np.ndarray, a: int, b: int, last: bool) -> None:
        self.data, self.a, self.b, self.last = data, a, b, last
        after = np.append(data[1:], 0)
        crlf = (data == 13) & (after == 10)
        ends = (data == 10) | (data == 13) & ~crlf
        self.ends = np.flatnonzero(ends)  # the last byte of each line end
        begins = (data & 0xC0) != 0x80
        self.plain = np.append(0, np.cumsum(begins))
        self.plain -= self.plain[a]  # code points from the range's start on
        point = np.append(0, np.cumsum(begins & ~crlf))
        self.point = point - point[a]  # with a line end as one
        inside = self.ends[np.searchsorted(self.ends, a) : np.searchsorted(self.ends, b)]
        self.fragment = int(inside[0]) + 1 if len(inside) else b  # where the line that crosses the start ends, with its end
        self.ended = bool(len(inside)) or last and b > a
        self.tail = int(inside[-1]) + 1 if len(inside) else a
        if last:
            self.tail = b

    def content(self, upto: int) -> int:
        """The last byte of a line without its end, ``upto`` being where the next begins."""
        d = self.data
        if upto > 0 and d[upto - 1] == 10:
            return upto - 2 if upto > 1 and d[upto - 2] == 13 else upto - 1
        return upto - 1 if upto > 0 and d[upto - 1] == 13 and (upto >= len(d) or d[upto] != 10) else upto

    def first(self, so_far: int) -> int:
        stop = self.content(self.fragment) if self.fragment < self.b or self.ended else self._without_return()
        return begun(so_far, self.data, self.a, max(self.a, stop))

    def _without_return(self) -> int:
        """The range's end, before a ``\\r`` of which the ``\\n`` is in the next range."""
        d, b = self.data, self.b
        return b - 1 if b > self.a and d[b - 1] == 13 and b < len(d) and d[b] == 10 else b

    def middle(self) -> Lines:
        lo = min(self.fragment, self.tail)
        return Lines(self.data[: max(self.tail, lo) + 1] if self.tail < len(self.data) else self.data, np.array([lo]), np.array([max(self.tail, lo)]))

    def summary(self) -> dict:
        out = {"ended": self.ended, "begins": [self.first(c) for c in range(BEGUN)], "points": int(self.point[self.b]), "plain": int(self.plain[self.b])}
        lines = self.middle() if self.ended else None
        out["leaves"], out["opened"] = list(range(4)), [0] * 4
        for state in range(4) if self.ended else ():
            before, whole = lines.states(state, fresh=False)
            out["leaves"][state] = int(LINES.table[whole, state])
            out["opened"][state] = int(lines.blocks(before)[0].sum())
        out["tail"] = begun(EMPTY, self.data, self.tail, max(self.tail, self._without_return()))
        out["line_start"] = int(self.point[self.tail]) if self.ended else -1
        return out

    def block_parts(self, state: int, so_far: int, block: int, point: int, line_start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the lines that end here: block number, the block's start (-1 if it began earlier) and end so far, in code points of the text."""
        if not self.ended:
            return (np.zeros(0, np.int64),) * 3
        lines = self.middle()
        kind = np.append(KIND_OF[self.first(so_far)], lines.kind).astype(np.uint8)
        start = np.append(line_start, point + self.point[lines.start])
        stop = np.append(point + self.point[self.content(self.fragment)], point + self.point[lines.stop])
        before, _ = LINES.states_before(kind, state)
        opens, goes_on = in_blocks(kind, before)
        inside = np.flatnonzero(opens | goes_on)
        if not len(inside):
            return (np.zeros(0, np.int64),) * 3
        number = block + np.cumsum(opens)[inside]
        new = np.flatnonzero(np.diff(number, prepend=-1))
        last = np.append(new[1:], len(number)) - 1
        return number[new], np.where(opens[inside[new]], start[inside[new]], -1), stop[inside[last]]

    def cuts(self, state: int, so_far: int, limit: int, overlap: int, total: int) -> Cuts:
        """The boundaries behind the range's start, up to its halo; ``total``: code points from the range's start to the text's end."""
        data, a = self.data, self.a
        here = self.ends[self.ends >= a]
        fragment = int(here[0]) + 1 if len(here) else len(data)
        whole = self.first(so_far) if fragment <= self.b else begun(so_far, data, a, max(a, self.content(fragment)))
        if so_far == EMPTY and not (a and data[a - 1] == 13 and data[a : a + 1] == 10):
            lines, fragment_lines = Lines(data, np.array([a]), np.array([len(data)])), 0
            kind = lines.kind
        else:
            lines, fragment_lines = Lines(data, np.array([fragment]), np.array([len(data)])), 1
            kind = np.append(KIND_OF[whole], lines.kind).astype(np.uint8)
        before, _ = LINES.states_before(kind, state)
        fenced = (before == TICKS) | (before == TILDES)
        # A line that is blank for as long as a piece may be is, as a boundary, a blank line.
        solid = np.append(np.flatnonzero((data != 32) & (data != 9) & (data != 0xC2) & (data != 0xA0)), len(data))
        ink = np.minimum(solid[np.searchsorted(solid, lines.start)], lines.stop)
        as_cut = lines.kind.copy()
        as_cut[self.plain[ink] - self.plain[lines.start] >= limit] = L_BLANK
        own = before[fragment_lines:]
        apart = ~fenced[fragment_lines:]
        head = apart & (as_cut == L_HEADING)
        strong = in_blocks(as_cut, own)[0] | apart & (as_cut == L_BLANK)
        ends = _sentence_ends(data)
        ends = ends[ends > a]
        begin = np.append(a, lines.start) if fragment_lines else lines.start
        owner = np.searchsorted(begin, ends - 1, side="right") - 1
        sentence = ends[~fenced[np.maximum(owner, 0)]] if len(ends) and len(fenced) else ends[:0]
        blanks = np.flatnonzero((data == 32) | (data == 9)) + 1
        kinds = [self.plain[k] for k in (lines.start[head], lines.start[strong], sentence, lines.start, blanks[blanks > a])]
        titles = []
        for s, e in zip(lines.start[head].tolist(), lines.stop[head].tolist()):
            most = int(np.searchsorted(self.plain, self.plain[s] + limit, side="left"))
            titles.append(bytes(data[s : min(e, most)]).decode("utf-8", "ignore").lstrip("#").strip())
        return Cuts(kinds, titles, limit, overlap, total, int(self.plain[self.b]))


class Cuts:
    """Boundaries of a range by strength, in code points from its start, and the cuts that follow from one another."""

    def __init__(self, kinds: list[np.ndarray], titles: list[str], limit: int, overlap: int, total: int, size: int) -> None:
        self.kinds, self.titles, self.limit, self.overlap, self.total, self.size = kinds, titles, limit, overlap, total, size

    def after(self, new: np.ndarray, text_start: int) -> np.ndarray:
        """The cut that follows each cut of ``new``; ``text_start``: where the text begins, at or before 0."""
        start = np.where(new > text_start, np.maximum(new - self.overlap, text_start), new)
        most = start + self.limit
        least = new + np.maximum(1, (self.limit - (new - start)) // 4)
        end = np.zeros(len(new), np.int64)
        todo = np.ones(len(new), bool)
        for k in self.kinds:
            if not len(k):
                continue
            i = np.searchsorted(k, most, side="right") - 1
            at = k[np.maximum(i, 0)]
            ok = todo & (i >= 0) & (at >= least)
            end[ok] = at[ok]
            todo &= ~ok
        end[todo] = most[todo]
        return np.where(most >= self.total, self.total, end)

    def through(self, text_start: int) -> tuple[np.ndarray, np.ndarray]:
        """For a first cut at each of ``limit`` places from the range's start on: where, behind the range, the next cut stands, and how many were passed."""
        place = np.arange(self.limit, dtype=np.int64)
        way, passed = place.copy(), np.zeros(self.limit, np.int64)  # way[e]: the track that entry e is on
        at, count = place.copy(), np.zeros(self.limit, np.int64)
        stop = min(self.size, self.total)
        while True:
            go = at < stop
            if not go.any():
                return at[way] - self.size, (count[way] + passed)
            at[go] = self.after(at[go], text_start)
            count[go] += 1
            if len(at) > 1:  # tracks that have met go on as one
                one, first, to = np.unique(at, return_index=True, return_inverse=True)
                if len(one) < len(at):
                    passed += (count - count[first][to])[way]
                    way = to[way]
                    at, count = one, count[first]

    def pieces(self, entry: int, text_start: int) -> Iterator[tuple[int, int, int, str | None]]:
        """(start, new, end, title): pieces that begin in the range if its first cut is at ``entry``; no title: none in the range."""
        new, heads = entry, self.kinds[0]
        while new < min(self.size, self.total):
            end = int(self.after(np.array([new]), text_start)[0])
            h = int(np.searchsorted(heads, new, side="right")) - 1
            yield (max(new - self.overlap, text_start) if new > text_start else new), new, end, self.titles[h] if h >= 0 else None
            new = end

    def last_title(self) -> str | None:
        h = int(np.searchsorted(self.kinds[0], self.size, side="left")) - 1
        return self.titles[h] if h >= 0 else None


def split_text(text: str, limit: int = 2000, overlap: int = 100) -> list[tuple[int, int, int, str]]:
    """Pieces (start, new, end, heading): ``text[start:end]`` is at most ``limit`` code points and begins with the last ``overlap``
    code points of the piece before, up to ``new``; heading is the nearest heading at or before ``new``.

    A piece ends at the last heading in reach, else at the last block or blank line, else at the end of a sentence, a line
    or a word, else (a word or fence line longer than a piece) at the limit. A weaker boundary is taken only where the
    stronger would leave the piece under a quarter full, so overlap and progress are certain. Together the parts from
    ``new`` to ``end`` are the whole text. Empty text: no piece. Headings inside fences are none. The text is one range.
    """
    if not text:
        return []
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    cuts = Range(data, 0, len(data), True).cuts(APART, EMPTY, limit, overlap, len(text))
    return [(s, n, e, h or "") for s, n, e, h in cuts.pieces(0, 0)]


def _crumb(crumb: str | None, head: str | None) -> str:
    crumb = (crumb or "").strip()
    return crumb if crumb and (not head or crumb.endswith(head)) else " > ".join(x for x in (crumb, head) if x)


def _kinds(df: DataFrame, cols: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in cols)


def _arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(T._parse_datatype_string(schema))


# Many ranges: rows (__item, other columns, range_no, ranges, lead, size, data), scanned in two levels.

RANGE = "range_no int, ranges int, lead int, size int, data binary"
_RANGE = ["range_no", "ranges", "lead", "size", "data"]
SUPER = 1024  # ranges that one task scans


def _halo(limit: int, overlap: int) -> tuple[int, int]:
    """Bytes before and behind a range that its cuts hang on."""
    return 4 * overlap + 4, 8 * limit + 8


def ranges_of_rows(df: DataFrame, keep: list[str], text_col: str, range_bytes: int, limit: int, overlap: int) -> DataFrame:
    """(__item, keep, range...): the ranges of each row's text, each with its halo, apart from one another."""
    lead, halo = _halo(limit, overlap)
    src = cut(df.select(F.monotonically_increasing_id().alias("__item"), *[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias("__text")))
    same = ["__item", *keep]
    schema = f"{_kinds(src, same)}, {RANGE}"

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            data, begins, ends = buffers(batch.column(len(same)))
            for i, (a, b) in enumerate(zip(begins.tolist(), ends.tolist())):
                n = -(-(b - a) // range_bytes)
                for k in range(n):
                    s, e = a + k * range_bytes, min(a + (k + 1) * range_bytes, b)
                    low = max(a, s - lead)
                    row = [batch.column(j).slice(i, 1) for j in range(len(same))]
                    row += [pa.array([x], pa.int32()) for x in (k, n, s - low, e - s)]
                    yield pa.RecordBatch.from_arrays([*row, pa.array([data[low : min(b, e + halo)].tobytes()], pa.binary())], names=[*same, *_RANGE])

    return cut(src.mapInArrow(run, schema).repartition(2 * parallelism(df.sparkSession), "__item", "range_no"))


def ranges_of_files(spark: SparkSession, paths: list[str], range_bytes: int, limit: int, overlap: int) -> DataFrame:
    """(__item, range...) of files, ``__item`` being the path: Spark lists them; a range is read with its halo, by offset, by whoever needs it."""
    lead, halo = _halo(limit, overlap)
    sizes = spark.read.format("binaryFile").load(paths).select(F.col("path").alias("__item"), F.col("length").alias("whole")).where("whole > 0")  # no contents
    n = F.expr(f"cast((whole - 1) div {range_bytes} as int)")
    todo = sizes.select("__item", "whole", (n + 1).alias("ranges"), F.explode(F.sequence(F.lit(0), n)).alias("range_no")).repartition(4 * parallelism(spark), "__item", "range_no")
    schema = _arrow(f"__item string, {RANGE}")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in stream:
            for r in batch.to_pylist():
                start = r["range_no"] * range_bytes
                size = min(range_bytes, r["whole"] - start)
                low = max(0, start - lead)
                files, name = fs.FileSystem.from_uri(r["__item"])
                with files.open_input_file(name) as f:
                    data = f.read_at(min(r["whole"], start + size + halo) - low, low)
                row = {"__item": r["__item"], "range_no": r["range_no"], "ranges": r["ranges"], "lead": start - low, "size": size, "data": data}
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    return todo.mapInArrow(run, f"__item string, {RANGE}")


def _each(ranges: DataFrame, keep: list[str], more: list[str], schema: str, work) -> DataFrame:
    """(keep, ``schema``): the rows that ``work(Range, row)`` gives for every range; ``row`` has the columns ``more``."""
    names = [*keep, *more, *_RANGE]
    kind = _arrow(schema)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for i in range(batch.num_rows):
                row = {n: batch.column(k)[i].as_py() for k, n in enumerate(names) if n != "data"}
                data = np.frombuffer(batch.column(len(names) - 1)[i].as_buffer(), np.uint8)
                out = list(work(Range(data, row["lead"], row["lead"] + row["size"], row["range_no"] == row["ranges"] - 1), row))
                if out:
                    made = pa.RecordBatch.from_pylist(out, schema=kind)
                    same = [batch.column(k).take(pa.array([i] * len(out))) for k in range(len(keep))]
                    yield pa.RecordBatch.from_arrays(same + made.columns, names=[*keep, *kind.names])

    return ranges.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, f"{_kinds(ranges, keep)}, {schema}")


def _follow(x: tuple, r: dict) -> tuple:
    """(state, begun, blocks, points, plain, line_start) behind a range, if ``x`` is what holds before it."""
    state, so_far, blocks, points, plain, line = x
    now = int(r["begins"][so_far])
    if r["ended"]:
        kind = np.array([KIND_OF[now]])
        blocks += int(in_blocks(kind, np.array([state]))[0][0])
        state = int(LINES.table[LINES.letter[kind[0]], state])
        blocks += int(r["opened"][state])
        state, now, line = int(r["leaves"][state]), int(r["tail"]), points + int(r["line_start"])
    return state, now, blocks, points + int(r["points"]), plain + int(r["plain"]), line


def entries(ranges: DataFrame) -> DataFrame:
    """(__item, range_no, state, begun, block0, point0, plain0, line_start, total): what holds at the start of each range, and the
    code points of its text.

    Runs of ``SUPER`` ranges are first summed up for each of the 4 * 17 states in which they may be entered; a text's runs
    are then scanned in one task, a row for each run, and last the ranges of each run from its own entry.
    """
    item = _kinds(ranges, ["__item"])
    sums = _each(ranges, ["__item"], [], "range_no int, ended boolean, begins array<int>, leaves array<int>, opened array<bigint>, tail int, line_start bigint, points bigint, plain bigint", lambda r, row: [{"range_no": row["range_no"], **r.summary()}])
    sums = cut(sums.withColumn("__run", (F.col("range_no") / SUPER).cast("int")))

    def run_sums(group: pd.DataFrame) -> pd.DataFrame:
        rows, ends = group.sort_values("range_no").to_dict("records"), []
        for state in range(4):
            for so_far in range(BEGUN):
                x = (state, so_far, 0, 0, 0, -1)
                for r in rows:
                    x = _follow(x, r)
                ends.append(x)
        first = {"__item": rows[0]["__item"], "__run": rows[0]["__run"]}
        return pd.DataFrame([{**first, "states": [x[0] for x in ends], "begun": [x[1] for x in ends], "blocks": [x[2] for x in ends], "points": ends[0][3], "plain": ends[0][4], "line": ends[0][5]}])

    def run_entries(group: pd.DataFrame) -> pd.DataFrame:
        out, x = [], (APART, EMPTY, 0, 0, 0, 0)
        for r in group.sort_values("__run").to_dict("records"):
            out.append({"__item": r["__item"], "__run": r["__run"], "x": [int(v) for v in x]})
            k = x[0] * BEGUN + x[1]
            x = (int(r["states"][k]), int(r["begun"][k]), x[2] + int(r["blocks"][k]), x[3] + r["points"], x[4] + r["plain"], x[5] if r["line"] < 0 else x[3] + r["line"])
        return pd.DataFrame([{**o, "total": int(x[4])} for o in out])

    def range_entries(group: pd.DataFrame) -> pd.DataFrame:
        out, x = [], None
        for r in group.sort_values("range_no").to_dict("records"):
            x = tuple(int(v) for v in r["x"]) if x is None else x
            out.append({"__item": r["__item"], "range_no": r["range_no"], **dict(zip(("state", "begun", "block0", "point0", "plain0", "line_start"), x)), "total": r["total"]})
            x = _follow(x, r)
        return pd.DataFrame(out)

    per_run = sums.groupBy("__item", "__run").applyInPandas(run_sums, f"{item}, __run int, states array<int>, begun array<int>, blocks array<bigint>, points bigint, plain bigint, line bigint")
    placed = per_run.groupBy("__item").applyInPandas(run_entries, f"{item}, __run int, x array<bigint>, total bigint")
    both = sums.join(placed, ["__item", "__run"])
    return cut(both.groupBy("__item", "__run").applyInPandas(range_entries, f"{item}, range_no int, state int, begun int, block0 bigint, point0 bigint, plain0 bigint, line_start bigint, total bigint"))


def blocks_of_ranges(ranges: DataFrame, keep: list[str], limit: int) -> DataFrame:
    """(__item, keep, block_no, start_point, points): blocks of more than ``limit`` code points, put together from the ranges they cross."""
    known = ranges.join(entries(ranges), ["__item", "range_no"])

    def work(r: Range, row: dict) -> Iterator[dict]:
        number, first, last = r.block_parts(row["state"], row["begun"], row["block0"], row["point0"], row["line_start"])
        for k, (n, a, b) in enumerate(zip(number.tolist(), first.tolist(), last.tolist())):
            if k in (0, len(number) - 1) or b - a > limit:  # the others are whole and within the limit
                yield {"block_no": n, "first": a, "last": b}

    found = _each(known, ["__item", *keep], ["state", "begun", "block0", "point0", "line_start"], "block_no bigint, first bigint, last bigint", work)
    whole = found.groupBy("__item", *[F.col(f"`{c}`") for c in keep], "block_no").agg(F.max("first").alias("start_point"), F.max("last").alias("__stop"))
    whole = whole.withColumn("points", F.col("__stop") - F.col("start_point")).where(F.col("points") > limit)
    return whole.select("__item", *[F.col(f"`{c}`") for c in keep], F.col("block_no").cast("int").alias("block_no"), "start_point", "points")


_PIECE = "piece_no int, heading string, start bigint, new bigint, end bigint, piece string"


def pieces_of_ranges(ranges: DataFrame, keep: list[str], limit: int, overlap: int) -> DataFrame:
    """(__item, keep, piece_no, heading, start, new, end, piece): pieces as of ``split_text``, emitted by offset."""
    item = _kinds(ranges, ["__item"])
    known = ranges.join(entries(ranges), ["__item", "range_no"])
    at = ["state", "begun", "plain0", "total"]

    def boundaries(r: Range, row: dict) -> Cuts:
        return r.cuts(row["state"], row["begun"], limit, overlap, row["total"] - row["plain0"])

    def tracks(r: Range, row: dict) -> Iterator[dict]:
        cuts = boundaries(r, row)
        leaves, passed = cuts.through(-row["plain0"])
        yield {"range_no": row["range_no"], "leaves": leaves.tolist(), "passed": passed.tolist(), "title": cuts.last_title()}

    sums = cut(_each(known, ["__item"], at, "range_no int, leaves array<int>, passed array<int>, title string", tracks).withColumn("__run", (F.col("range_no") / SUPER).cast("int")))

    def run_sums(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values("range_no").to_dict("records")
        place, passed, title = np.arange(limit), np.zeros(limit, np.int64), None
        for r in rows:
            passed = passed + np.asarray(r["passed"])[place]
            place = np.asarray(r["leaves"])[place]
            title = title if r["title"] is None else r["title"]
        return pd.DataFrame([{"__item": rows[0]["__item"], "__run": rows[0]["__run"], "leaves": place.tolist(), "passed": passed.tolist(), "title": title}])

    def run_entries(group: pd.DataFrame) -> pd.DataFrame:
        out, place, passed, title = [], 0, 0, None
        for r in group.sort_values("__run").to_dict("records"):
            out.append({"__item": r["__item"], "__run": r["__run"], "entry0": place, "passed0": passed, "title0": title})
            place, passed, title = int(r["leaves"][place]), passed + int(r["passed"][place]), title if r["title"] is None else r["title"]
        return pd.DataFrame(out)

    def range_entries(group: pd.DataFrame) -> pd.DataFrame:
        out, x = [], None
        for r in group.sort_values("range_no").to_dict("records"):
            place, passed, title = x or (r["entry0"], r["passed0"], r["title0"])
            out.append({"__item": r["__item"], "range_no": r["range_no"], "entry": place, "passed": passed, "title": title})
            x = int(r["leaves"][place]), passed + int(r["passed"][place]), title if r["title"] is None else r["title"]
        return pd.DataFrame(out)

    per_run = sums.groupBy("__item", "__run").applyInPandas(run_sums, f"{item}, __run int, leaves array<int>, passed array<bigint>, title string")
    placed = per_run.groupBy("__item").applyInPandas(run_entries, f"{item}, __run int, entry0 int, passed0 bigint, title0 string")
    first = sums.join(placed, ["__item", "__run"]).groupBy("__item", "__run").applyInPandas(range_entries, f"{item}, range_no int, entry int, passed bigint, title string")

    def emit(r: Range, row: dict) -> Iterator[dict]:
        byte = np.flatnonzero((r.data & 0xC0) != 0x80)  # of each code point
        byte = np.append(byte, len(r.data))
        zero = int(np.searchsorted(byte, r.a))  # the code point with which the range begins
        base = row["plain0"]
        for k, (start, new, end, title) in enumerate(boundaries(r, row).pieces(row["entry"], -base)):
            text = bytes(r.data[byte[zero + start] : byte[zero + end]]).decode("utf-8", "replace")
            yield {"piece_no": row["passed"] + k, "heading": row["title"] if title is None else title, "start": base + start, "new": base + new, "end": base + end, "piece": text}

    return _each(known.join(first, ["__item", "range_no"]), ["__item", *keep], [*at, "entry", "passed", "title"], _PIECE, emit)


def large_blocks_of_files(spark: SparkSession, paths: list[str], limit: int = 2000, range_bytes: int = 1 << 26) -> DataFrame:
    """(path, block_no, start_point, points): blocks of more than ``limit`` code points of files of any size. Paths are Spark's."""
    found = blocks_of_ranges(ranges_of_files(spark, paths, range_bytes, limit, 0), [], limit)
    return found.withColumnRenamed("__item", "path")


def pieces_of_files(spark: SparkSession, paths: list[str], limit: int = 2000, overlap: int = 100, range_bytes: int = 1 << 26) -> DataFrame:
    """(path, piece_no, heading, start, new, end, piece) of files of any size."""
    return pieces_of_ranges(ranges_of_files(spark, paths, range_bytes, limit, overlap), [], limit, overlap).withColumnRenamed("__item", "path")


# Tables: items of one range in whole batches, longer ones through the scan.


def _by_length(df: DataFrame, text_col: str, range_bytes: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose text is one range, and the longer ones if there are any."""
    long = F.coalesce(F.octet_length(F.col(f"`{text_col}`").cast("string")), F.lit(0)) > range_bytes
    more = df.where(long)
    return df.where(~long), None if more.isEmpty() else more


def find_large_blocks(df: DataFrame, keys: list[str], text_col: str, limit: int = 2000, range_bytes: int = 1 << 26) -> DataFrame:
    """(keys, block_no): blocks of more than ``limit`` code points in each row's text, see the module.

    Null and empty texts have none. Rows are judged one by one; other columns are not read. A narrow stage, but for texts
    of more than ``range_bytes``.
    """
    short, long = _by_length(df, text_col, range_bytes)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in stream:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                item, number = large_blocks(*buffers(batch.column(len(keys))), limit)
                take = pa.array(item)
                yield pa.RecordBatch.from_arrays([batch.column(i).take(take) for i in range(len(keys))] + [pa.array(number.astype(np.int32))], names=[*keys, "block_no"])

    out = short.select(*[F.col(f"`{c}`") for c in [*keys, text_col]]).mapInArrow(run, f"{_kinds(df, keys)}, block_no int")
    if long is None:
        return out
    cross = blocks_of_ranges(ranges_of_rows(long, keys, text_col, range_bytes, limit, 0), keys, limit)
    return out.union(cross.select(*[F.col(f"`{c}`") for c in keys], "block_no"))


def split_items(df: DataFrame, keys: list[str], text_col: str, breadcrumb_col: str, limit: int = 2000, overlap: int = 100, oversized_only: bool = True, range_bytes: int = 1 << 26) -> DataFrame:
    """(keys, piece_no, breadcrumb, start, new, end, piece): the pieces of each row's text, see ``split_text``.

    With ``oversized_only`` rows of at most ``limit`` code points have no pieces. The breadcrumb is the row's, with the
    nearest heading; a null or blank one is just the heading. Null texts have no piece. A narrow stage, but for texts of
    more than ``range_bytes``.
    """
    src = df.select(*[F.col(f"`{c}`") for c in keys], F.col(f"`{breadcrumb_col}`").cast("string").alias("__crumb"), F.col(f"`{text_col}`").cast("string").alias("__text"))
    if oversized_only:
        src = src.where(F.length("__text") > limit)
    short, long = _by_length(src, "__text", range_bytes)
    kind = _arrow("piece_no int, breadcrumb string, start bigint, new bigint, end bigint, piece string")
    k = len(keys)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in stream:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                row, rest = [], []
                for i, (crumb, text) in enumerate(zip(batch.column(k).to_pylist(), batch.column(k + 1).to_pylist())):
                    for no, (start, new, end, head) in enumerate(split_text(text or "", limit, overlap)):
                        row.append(i)
                        rest.append({"piece_no": no, "breadcrumb": _crumb(crumb, head), "start": start, "new": new, "end": end, "piece": text[start:end]})
                made = pa.RecordBatch.from_pylist(rest, schema=kind)
                yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(row, pa.int64())) for i in range(k)] + made.columns, names=[*keys, *kind.names])

    schema = f"{_kinds(df, keys)}, piece_no int, breadcrumb string, start bigint, new bigint, end bigint, piece string"
    out = short.mapInArrow(run, schema)
    if long is None:
        return out
    cross = pieces_of_ranges(ranges_of_rows(long, [*keys, "__crumb"], "__text", range_bytes, limit, overlap), [*keys, "__crumb"], limit, overlap)
    crumb, head = F.coalesce(F.trim("__crumb"), F.lit("")), F.coalesce("heading", F.lit(""))
    joined = F.when((crumb != "") & ((head == "") | F.endswith(crumb, head)), crumb).otherwise(F.concat_ws(" > ", F.when(crumb != "", crumb), F.when(head != "", head)))
    return out.union(cross.select(*[F.col(f"`{c}`") for c in keys], "piece_no", joined.alias("breadcrumb"), "start", "new", "end", "piece"))


def _items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return load(spark, sf_dir, "pages"), load(spark, sf_dir, "chunks")


def found(spark: SparkSession, sf_dir: str, range_bytes: int = 1 << 26) -> DataFrame:
    """Blocks of current pages and of chunks that alone exceed 2,000 code points."""
    pages, chunks = _items(spark, sf_dir)
    blocks = find_large_blocks(pages, ["id", "indexed_at"], "content", range_bytes=range_bytes)
    current = pages.groupBy("id").agg(F.max("indexed_at").alias("indexed_at"))
    old = blocks.join(current, ["id", "indexed_at"], "left_semi")
    p = old.select(F.lit("page").alias("item_kind"), F.col("id").alias("item_id"), "block_no")
    c = find_large_blocks(chunks, ["id"], "content", range_bytes=range_bytes).select(F.lit("chunk").alias("item_kind"), F.col("id").cast("string").alias("item_id"), "block_no")
    return p.union(c).distinct()


def long_items(spark: SparkSession, sf_dir: str, limit: int = 2000) -> DataFrame:
    """(item_kind, item_id, breadcrumb, content) of current pages and of chunks of more than ``limit`` code points."""
    pages, chunks = _items(spark, sf_dir)
    current = latest_rows(pages.select("id", "indexed_at", "title", "content").where(F.length("content") > limit), ["id"], ["indexed_at"])
    newest = pages.groupBy("id").agg(F.max("indexed_at").alias("indexed_at"))
    current = current.join(newest, ["id", "indexed_at"], "left_semi")
    long = chunks.select("id", "breadcrumb", "content").where(F.length("content") > limit)
    one = long.groupBy("id").agg(F.max(F.struct("content", "breadcrumb")).alias("c")).select("id", "c.content", "c.breadcrumb")
    page = current.select(F.lit("page").alias("item_kind"), F.col("id").alias("item_id"), F.col("title").alias("breadcrumb"), "content")
    return page.union(one.select(F.lit("chunk"), F.col("id").cast("string"), "breadcrumb", "content"))


def pieces(spark: SparkSession, sf_dir: str, range_bytes: int = 1 << 26) -> DataFrame:
    """Pieces of at most 2,000 code points of all current pages and chunks that are longer."""
    return split_items(long_items(spark, sf_dir), ["item_kind", "item_id"], "content", "breadcrumb", range_bytes=range_bytes)
