"""Byte-level BPE of whole corpora, without a regular expression.

A batch of texts is one array of code points. A table gives each its class, an automaton's transition functions are
scanned over the classes (``scan.Automaton``), and its outputs say where pre-tokens begin. The slices between go through
a cache of merged pieces, so each distinct slice is merged once in a worker's life.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from worklens.llm.scan import Automaton
from worklens.plans.lineage import spread

(LETTER, STMD, ELL, RV, EE, NUMBER, OTHER, QUOTE, BLANK, SPACE, END) = range(11)
(START, IN_L, IN_N, IN_O, ONE_BLANK, ONE_SPACE, MANY_BLANK, MANY_SPACE, APOS, APOS_L, APOS_RV, CONTRACTED) = range(12)

# Letters and numbers that the tokenizer's Unicode version has beyond Python's.
NEWER_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEWER_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
# The code points of the Unicode property White_Space.
WHITE_SPACE = (9, 10, 11, 12, 13, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    kinds = np.full(0x110000, OTHER, np.uint8)
    category = unicodedata.category
    first = "".join(category(chr(c))[0] for c in range(0x110000))
    codes = np.frombuffer(first.encode(), np.uint8)
    kinds[codes == ord("L")] = LETTER
    kinds[codes == ord("N")] = NUMBER
    for a, b in NEWER_LETTERS:
        kinds[a : b + 1] = LETTER
    for a, b in NEWER_NUMBERS:
        kinds[a : b + 1] = NUMBER
    kinds[list(WHITE_SPACE)] = SPACE
    kinds[0x20] = BLANK
    kinds[ord("'")] = QUOTE
    for c in "stmd":
        kinds[ord(c)] = STMD
    for c in "rv":
        kinds[ord(c)] = RV
    kinds[ord("l")], kinds[ord("e")] = ELL, EE
    return kinds


def _fresh(c: int) -> int:
    """The state after letter ``c`` if a pre-token begins with it."""
    return {NUMBER: IN_N, OTHER: IN_O, QUOTE: APOS, BLANK: ONE_BLANK, SPACE: ONE_SPACE, END: START}.get(c, IN_L)


@lru_cache(maxsize=1)
def pretokenizer() -> tuple[Automaton, np.ndarray]:
    """The automaton, and out[state, class]: bit 0 if a pre-token begins here, bit 1 if one began a position earlier."""
    letters = {LETTER, STMD, ELL, RV, EE}
    step = np.zeros((11, 12), np.uint8)
    out = np.zeros((12, 11), np.uint8)

    def move(s: int, c: int) -> tuple[int, int]:
        if c == END:
            return START, 1 | (2 if s in (APOS_L, APOS_RV) else 0)
        if s in (START, CONTRACTED):
            return _fresh(c), 1
        if s in (IN_L, APOS_L, APOS_RV):
            if s == APOS_L and c == ELL or s == APOS_RV and c == EE:
                return CONTRACTED, 0
            late = 0 if s == IN_L else 2
            return (IN_L, late) if c in letters else (_fresh(c), 1 | late)
        if s == IN_N:
            return (IN_N, 0) if c == NUMBER else (_fresh(c), 1)
        if s in (IN_O, APOS):
            if c in (OTHER, QUOTE):
                return IN_O, 0
            if s == APOS and c in (STMD, ELL, RV):
                return {STMD: CONTRACTED, ELL: APOS_L, RV: APOS_RV}[c], 0
            return _fresh(c), 1
        if c in (BLANK, SPACE):
            return (MANY_BLANK if c == BLANK else MANY_SPACE), 0
        late = 2 if s in (MANY_BLANK, MANY_SPACE) else 0
        if s in (ONE_BLANK, MANY_BLANK):  # the blank belongs to the run that follows
            return (IN_O if c == QUOTE else _fresh(c)), late
        return _fresh(c), 1 | late

    for s in range(12):
        for c in range(11):
            step[c, s], out[s, c] = move(s, c)
    return Automaton(step), out


class _Pieces(dict):
    """Distinct slices and where their ids lie in a flat array."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        super().__init__()
        self.ranks = ranks
        self.flat: list[int] = []
        self.ends: list[int] = [0]

    def __missing__(self, piece: str) -> int:
        self.flat += merge(piece.encode("utf-8", "replace"), self.ranks)
        self.ends.append(len(self.flat))
        self[piece] = k = len(self.ends) - 2
        return k


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one slice: always the pair of least rank is joined, the leftmost first. Time n log n."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    if n < 40:
        parts = [piece[i : i + 1] for i in range(n)]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]
    after, prior, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = bytearray(b"\x01") * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i, e = heapq.heappop(heap)
        if not alive[i] or after[i] >= n or end[after[i]] != e:
            continue
        j = after[i]
        alive[j] = 0
        end[i], after[i] = e, after[j]
        if after[i] < n:
            prior[after[i]] = i
            if (r := ranks.get(piece[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if (p := prior[i]) >= 0 and (r := ranks.get(piece[p:e])) is not None:
            heapq.heappush(heap, (r, p, e))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The ranks of a ``.tiktoken`` file: base64 of the bytes, a blank, the id."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class Encoder:
    """Encodes lists of texts. ``most``: distinct slices kept at most; beyond it the cache starts anew, results stay the same."""

    def __init__(self, ranks: dict[bytes, int], most: int = 300_000) -> None:
        self.ranks, self.most = ranks, most
        self.pieces = _Pieces(ranks)
        widths = np.zeros(max(ranks.values()) + 1, np.int32)
        for b, r in ranks.items():
            widths[r] = len(b)
        self.widths = widths

    def slices(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The pre-tokens of all texts in order, and how many each text has."""
        joined = "\n".join(texts) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        letters = class_table()[points]
        stops = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        letters[stops] = END
        automaton, out = pretokenizer()
        state, _ = automaton.states_before(letters, START)
        said = out[state, letters]
        begins = (said & 1).astype(bool)
        begins[:-1] |= (said[1:] & 2).astype(bool)
        at = np.flatnonzero(begins)
        piece = letters[at] != END
        ends = np.append(at[1:], len(letters))[piece]
        starts = at[piece]
        counts = np.diff(np.searchsorted(starts, np.append(-1, stops)))
        return [joined[a:b] for a, b in zip(starts.tolist(), ends.tolist())], counts

    def encode(self, texts: list[str], ids: bool = True) -> tuple[np.ndarray | None, np.ndarray]:
        """All ids in one array (none if not ``ids``), and the number of ids of each text."""
        if not texts:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        if len(self.pieces) > self.most or len(self.pieces.flat) > 8 * self.most:
            self.pieces = _Pieces(self.ranks)
        pieces, counts = self.slices(texts)
        k = np.fromiter(map(self.pieces.__getitem__, pieces), np.int64, len(pieces))
        ends = np.array(self.pieces.ends, np.int64)
        width = ends[k + 1] - ends[k]
        total = np.append(0, np.cumsum(width))
        bounds = np.append(0, np.cumsum(counts))
        each = total[bounds[1:]] - total[bounds[:-1]]
        if not ids:
            return None, each
        flat = np.array(self.pieces.flat, np.int32)
        return flat[np.repeat(ends[k] - total[:-1], width) + np.arange(total[-1])], each


def batches(texts: list[str | None], most: int = 1_000_000) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about ``most`` code points; a longer text is a run of its own. Null counts as empty."""
    run: list[str] = []
    size = first = 0
    for i, t in enumerate(texts):
        t = t or ""
        if run and size + len(t) > most:
            yield first, run
            run, size, first = [], 0, i
        run.append(t)
        size += len(t) + 1
    if run:
        yield first, run


_encoders: dict[int, Encoder] = {}


def _encoder(data: bytes) -> Encoder:
    """One encoder for each vocabulary in a worker process."""
    key = hash(data)
    if key not in _encoders:
        _encoders[key] = Encoder(read_ranks(data))
    return _encoders[key]


def vocabulary(path: str | None = None) -> bytes:
    """The bytes of a ``.tiktoken`` file, by default the public byte_bpe_50k."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        return f.read()


def encode_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, vocab: str | None = None, offsets: bool = False, lengths_only: bool = False) -> DataFrame:
    """Token ids of each row's text: (id, ids array<int>), with ``offsets`` also (byte_ends array<int>), the end of each token in the
    UTF-8 text, from which any run of tokens is decoded by slicing; with ``lengths_only`` (id, n_tokens).

    Null and empty texts have an empty list. Rows are mapped one to one: repeated rows and repeated or null ids stay as they are. The
    strings of special tokens in a text are ordinary text. Texts of any length are encoded whole. Other columns are not read.
    A narrow stage: no shuffle; the vocabulary (under 1 MB) is broadcast.
    """
    spark = df.sparkSession
    data = spark.sparkContext.broadcast(vocabulary(vocab))
    src = spread(df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("__text")), id_col)
    fields = [T.StructField(id_col, df.schema[id_col].dataType)]
    if lengths_only:
        fields.append(T.StructField("n_tokens", T.IntegerType()))
    else:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
        if offsets:
            fields.append(T.StructField("byte_ends", T.ArrayType(T.IntegerType())))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(data.value)
        for batch in stream:
            for first, texts in batches(batch.column(1).to_pylist()):
                flat, each = enc.encode(texts, ids=not lengths_only)
                cols = [batch.column(0).slice(first, len(texts))]
                names = [id_col]
                if lengths_only:
                    cols.append(pa.array(each.astype(np.int32)))
                    names.append("n_tokens")
                else:
                    at = np.append(0, np.cumsum(each)).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(at), pa.array(flat)))
                    names.append("ids")
                    if offsets:
                        run_ends = np.cumsum(enc.widths[flat], dtype=np.int64)
                        base = np.append(0, run_ends)[at[:-1]]
                        cols.append(pa.ListArray.from_arrays(pa.array(at), pa.array((run_ends - np.repeat(base, each)).astype(np.int32))))
                        names.append("byte_ends")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return src.mapInArrow(run, T.StructType(fields))


def decode_documents(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", *, vocab: str | None = None) -> DataFrame:
    """(id, text): the texts of lists of token ids, as ``encode_documents`` gives them. Null and empty lists have an empty text; bytes
    that are no UTF-8 (a list cut within a character) are replaced. Rows are mapped one to one. A narrow stage."""
    data = df.sparkSession.sparkContext.broadcast(vocabulary(vocab))
    kind = df.schema[id_col].dataType.simpleString()

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(data.value)
        pieces = np.empty(len(enc.widths), object)
        for b, r in enc.ranks.items():
            pieces[r] = b
        for batch in stream:
            ids = batch.column(1)
            texts = [b"".join(pieces[ids[i].values.to_numpy(zero_copy_only=False)].tolist()).decode("utf-8", "replace") if ids[i].is_valid and len(ids[i]) else "" for i in range(len(ids))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return df.select(F.col(f"`{id_col}`"), F.col(f"`{ids_col}`")).mapInArrow(run, f"`{id_col}` {kind}, text string")
