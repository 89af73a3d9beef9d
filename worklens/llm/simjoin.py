"""Set similarity join by chosen paths.

Every set is described by minwise tokens: the least token under each of many hash functions. A node of a tree picks a few
of those functions, and its sets go to the children named by their minwise tokens there. Two sets of Jaccard similarity s
share a minwise token with chance s whatever their tokens are, frequent or rare, so the chance that they meet depends on s
alone and not on the data. Nodes that have become small, and those in which most sets are near the wanted similarity
anyway so that branching no longer parts them, are compared exhaustively. Independent trees raise the recall.

The trees' first nodes are spread over the cluster with all that the rest needs (a sketch for comparing, minwise tokens
for branching: 64 bytes a set); below them each task branches on by itself over index arrays. Only nodes too large for
a task go through another exchange. Exact copies of a set are one class beforehand.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from worklens.llm.scan import buffers
from worklens.plans.lineage import cut, parallelism

TREES = 12
BITS = 256  # one-bit minwise hashes of the sketch
COORDS = 60  # minwise tokens, four bits each, of which nodes choose theirs
WIDTH = 2  # children that a node gives each of its sets
MIX = np.uint64(0x9E3779B97F4A7C15)
TOKEN_BITS = 48

_PAYLOAD = [f"s{i}" for i in range(4)] + [f"c{i}" for i in range(4)]
_TREES = [f"t{i}" for i in range(TREES // 2)]
SIGNATURE = "h bigint, g bigint, n int, " + ", ".join(f"{c} bigint" for c in _TREES + _PAYLOAD)
_ROW = "node bigint, cid bigint, " + ", ".join(f"{c} bigint" for c in _PAYLOAD)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser by multiply and shift."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased ASCII letters and digits (0: none) and a random number for each byte."""
    low = np.zeros(256, np.uint8)
    for a, b in ((48, 57), (97, 122)):
        low[a : b + 1] = np.arange(a, b + 1)
    low[65:91] = np.arange(97, 123)
    return low, _mix(np.arange(1, 257, dtype=np.uint64) * MIX)


def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.append(np.uint64(1), np.full(n, 0xA0761D6478BD642F, np.uint64)))


def token_sets(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, least: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The distinct runs of ``least`` or more ASCII letters or digits, without case, of each text, as hashes of 48 bits.

    Returns all tokens, text by text in ascending order, and how many each text has. At most 65,536 texts. Two words of
    one pair of texts with 200 words have one hash with a chance below 1e-9.
    """
    low, random = _letters()
    n = len(begins)
    code = low[data]
    word = code > 0
    after = np.append(False, word[:-1]) if len(word) else word
    before = np.append(word[1:], False) if len(word) else word
    some = ends > begins
    after[begins[some]] = False
    before[ends[some] - 1] = False
    start, stop = np.flatnonzero(word & ~after), np.flatnonzero(word & ~before) + 1
    long = stop - start >= least
    start, size = start[long], (stop - start)[long]
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    off = np.cumsum(size) - size
    place = np.arange(off[-1] + size[-1])
    at = place - np.repeat(off - start, size)
    terms = random[code[at]] * _powers(int(size.max()))[place - np.repeat(off, size)]
    hashes = _mix(np.add.reduceat(terms, off))
    text = np.searchsorted(begins[some], start, side="right") - 1
    key = np.sort(np.flatnonzero(some)[text].astype(np.uint64) << np.uint64(TOKEN_BITS) | hashes >> np.uint64(64 - TOKEN_BITS))
    key = key[np.append(True, key[1:] != key[:-1])]
    return key & np.uint64((1 << TOKEN_BITS) - 1), np.bincount((key >> np.uint64(TOKEN_BITS)).astype(np.int64), minlength=n)


@lru_cache(maxsize=1)
def _functions() -> np.ndarray:
    return (_mix(np.arange(1, TREES + BITS + 1, dtype=np.uint64) * MIX) >> np.uint64(32)).astype(np.uint32)[:, None] | np.uint32(1)


def _hashed(a: np.ndarray, x: np.ndarray, out: np.ndarray, spare: np.ndarray) -> np.ndarray:
    np.multiply(a, x[None, :], out=out)
    np.right_shift(out, np.uint32(15), out=spare)
    np.bitwise_xor(out, spare, out=out)
    return np.multiply(out, np.uint32(0x2C1B3C6D), out=out)


def minwise(tokens: np.ndarray, n: np.ndarray, together: int = 256, long: int = 4096) -> np.ndarray:
    """(functions, sets): the least hash of each set under each function; of an empty set the greatest number.

    Sets are taken in order of size and token by token, so every step is one operation on a block that fits a cache.
    """
    a = _functions()
    k = len(a)
    x = (_mix(tokens * MIX) >> np.uint64(32)).astype(np.uint32)
    out = np.full((k, len(n)), 0xFFFFFFFF, np.uint32)
    start = np.cumsum(n) - n
    one, two = np.empty(k * together, np.uint32), np.empty(k * together, np.uint32)
    order = np.argsort(-n, kind="stable")
    for i in order[: int((n > long).sum())]:
        for at in range(start[i], start[i] + n[i], together):
            part = x[at : min(at + together, start[i] + n[i])]
            m = len(part)
            block = _hashed(a, part, one[: k * m].reshape(k, m), two[: k * m].reshape(k, m))
            out[:, i] = np.minimum(out[:, i], block.min(axis=1))
    order = order[n[order] <= long]
    for low in range(0, len(order), together):
        some = order[low : low + together]
        size, first = n[some], start[some]
        least = np.full((k, len(some)), 0xFFFFFFFF, np.uint32)
        for j in range(int(size[0]) if len(size) else 0):
            m = int(np.searchsorted(-size, -j, side="left"))  # sets with more than j tokens
            block = _hashed(a, x[first[:m] + j], one[: k * m].reshape(k, m), two[: k * m].reshape(k, m))
            np.minimum(least[:, :m], block, out=least[:, :m])
        out[:, some] = least
    return out


def _signatures(column: pa.Array, least_len: int, least_words: int) -> list[np.ndarray]:
    tokens, n = token_sets(*buffers(column), least_len)
    at = np.append(0, np.cumsum(n))
    total = np.append(np.zeros(1, np.uint64), np.cumsum(_mix(tokens * MIX))), np.append(np.zeros(1, np.uint64), np.cumsum(_mix(tokens ^ MIX)))
    h, g = (t[at[1:]] - t[at[:-1]] for t in total)
    enough = n >= max(least_words, 1)
    least = np.zeros((TREES + BITS, len(n)), np.uint32)
    least[:, enough] = minwise(tokens[np.repeat(enough, n)], n[enough])
    trees = np.ascontiguousarray(least[:TREES].T).view(np.uint64)
    mixed = least[TREES:] * np.uint32(0x85EBCA6B)
    sketch = np.packbits((mixed >> np.uint32(20) & np.uint32(1)).astype(np.uint8), axis=0)
    coords = (mixed[:COORDS] >> np.uint32(24) & np.uint32(15)).astype(np.uint8)
    tail = np.empty((32, len(n)), np.uint8)
    tail[: COORDS // 2] = coords[0::2] | coords[1::2] << 4
    size = np.minimum(n, 0xFFFF).astype(np.uint16)
    tail[30], tail[31] = size & 0xFF, size >> 8
    words = [np.ascontiguousarray(m.T).view(np.uint64) for m in (sketch, tail)]
    return [h, g, n, *trees.T, *words[0].T, *words[1].T]


def sign(df: DataFrame, keys: list[str], text_col: str, least_len: int = 3, least_words: int = 1) -> DataFrame:
    """(keys, h, g, n, t*, s*, c*): 128 bits that name each row's set of words, its size, and its minwise tokens.

    Sets of fewer than ``least_words`` words have zeros for minwise tokens; null counts as empty. A narrow stage; texts of any length.
    """
    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys]
    fields = T._parse_datatype_string(SIGNATURE).fieldNames()

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in stream:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                cols = _signatures(batch.column(len(keys)), least_len, least_words)
                arrays = [pa.array(c.astype(np.int32) if f == "n" else np.ascontiguousarray(c).view(np.int64)) for f, c in zip(fields, cols)]
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keys))] + arrays, names=[*keys, *fields])

    return df.select(*[F.col(f"`{c}`") for c in keys], F.col(f"`{text_col}`").cast("string")).mapInArrow(run, ", ".join([*kinds, SIGNATURE]))


def tokens_of(df: DataFrame, keys: list[str], text_col: str, least_len: int = 3) -> DataFrame:
    """(keys, h, g, tokens array<bigint>): the set of words of each row's text, as ``sign`` takes it."""
    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in stream:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                tokens, n = token_sets(*buffers(batch.column(len(keys))), least_len)
                ends = np.append(0, np.cumsum(n))
                sums = [np.append(np.zeros(1, np.uint64), np.cumsum(_mix(t))) for t in (tokens * MIX, tokens ^ MIX)]
                names = [pa.array((s[ends[1:]] - s[ends[:-1]]).view(np.int64)) for s in sums]
                sets = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(tokens.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keys))] + names + [sets], names=[*keys, "h", "g", "tokens"])

    return df.select(*[F.col(f"`{c}`") for c in keys], F.col(f"`{text_col}`").cast("string")).mapInArrow(run, ", ".join([*kinds, "h bigint, g bigint, tokens array<bigint>"]))


def classes(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``signed`` (key, h, g, n, ...) as representatives (cid, rep, h, g, t*, s*, c*) and members (key, cid); equal sets are one class.

    ``rep`` is the least key of the class. Counted with map-side combine, so copies by the million are no single task.
    """
    signed = cut(signed.select("key", "h", "g", *_TREES, *_PAYLOAD))
    same = [F.first(c).alias(c) for c in _TREES + _PAYLOAD]
    reps = cut(signed.groupBy("h", "g").agg(F.min("key").alias("rep"), *same).withColumn("cid", F.monotonically_increasing_id()))
    members = signed.select("key", "h", "g").join(reps.select("h", "g", "cid"), ["h", "g"]).select("key", "cid")
    return reps, members


def _children(node: np.ndarray, coords: np.ndarray) -> np.ndarray:
    """(WIDTH, rows): the children of each row, by its minwise tokens at the coordinates that its node chooses."""
    seed = _mix(node ^ MIX)
    c = (seed % np.uint64(COORDS)).astype(np.int64)
    step = (seed >> np.uint64(32)) % np.uint64(COORDS - 1) + np.uint64(1)
    out = np.empty((WIDTH, len(node)), np.uint64)
    row = np.arange(len(node))
    for k in range(WIDTH):
        value = coords[row, c >> 4] >> (np.uint64(4) * (c & 15).astype(np.uint64)) & np.uint64(15)
        out[k] = _mix(node * MIX + (c.astype(np.uint64) << np.uint64(4) | value) + np.uint64(1))
        c = (c + step.astype(np.int64)) % COORDS
    return out


class _Nodes:
    """Rows of whole nodes: ``add`` them, ``pairs`` gives the candidates among them.

    ``limit``: nodes of so many sets are compared as they are. ``most``: larger ones that branching doesn't part are
    compared too if they have up to so many sets; still larger ones are left in ``dense`` as row numbers. A node has
    ceased to part if its children together would hold at least nine tenths of its pairs: its sets are then about as
    similar as what is sought.
    """

    def __init__(self, similarity: float, limit: int, most: int, deviations: float) -> None:
        self.limit, self.most, self.similarity = limit, most, similarity
        same = (1 + similarity) / 2

        def allowed(bits: int) -> int:
            return int(np.ceil(bits * (1 - same) + deviations * (bits * same * (1 - same)) ** 0.5))

        self.half, self.whole = allowed(BITS // 2), allowed(BITS)

    def compare(self, i: np.ndarray, j: np.ndarray) -> None:
        s = self.sketch
        bits = np.bitwise_count(s[i, 0] ^ s[j, 0]) + np.bitwise_count(s[i, 1] ^ s[j, 1])
        ok = np.flatnonzero(bits <= self.half)
        if not len(ok):
            return
        i, j, bits = i[ok], j[ok], bits[ok].astype(np.int64)
        bits += np.bitwise_count(s[i, 2] ^ s[j, 2]).astype(np.int64) + np.bitwise_count(s[i, 3] ^ s[j, 3])
        a, b = self.size[i], self.size[j]
        ok = (bits <= self.whole) & (np.minimum(a, b) >= self.similarity * np.maximum(a, b))
        i, j = self.cid[i[ok]], self.cid[j[ok]]
        self.found.append(np.stack([np.minimum(i, j), np.maximum(i, j)])[:, i != j])

    def exhaust(self, rows: np.ndarray, sizes: np.ndarray) -> None:
        """All pairs within each run of ``sizes`` rows."""
        first = np.cumsum(sizes) - sizes
        left = np.repeat(first + sizes, sizes) - np.arange(len(rows))  # rows of its run from this one on
        i = np.arange(len(rows))
        d = 1
        while True:
            i = i[left[i] > d]
            if not len(i):
                return
            for at in range(0, len(i), 1 << 20):
                part = i[at : at + (1 << 20)]
                self.compare(rows[part], rows[part + d])
            d += 1

    def pairs(self, node: np.ndarray, cid: np.ndarray, payload: np.ndarray) -> np.ndarray:
        """(2, n): candidates, each once; ``payload`` (rows, 8), rows of a node together."""
        self.cid, self.sketch, coords = cid, np.ascontiguousarray(payload[:, :4]), np.ascontiguousarray(payload[:, 4:])
        self.size = (coords[:, 3] >> np.uint64(48)).astype(np.int64)
        self.found, self.dense = [np.zeros((2, 0), np.int64)], []
        work = [(node, np.arange(len(node)))]
        while work:
            key, row = work.pop()
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            sizes = np.diff(np.append(first, len(key)))
            small = (sizes > 1) & (sizes <= self.limit)
            self.exhaust(row[np.repeat(small, sizes)], sizes[small])
            large = sizes > self.limit
            if not large.any():
                continue
            inside = np.repeat(large, sizes)
            key, row, sizes = key[inside], row[inside], sizes[large]
            parent = np.repeat(np.arange(len(sizes)), sizes)
            child = _children(key, coords[row]).reshape(-1)
            order = np.argsort(child, kind="stable")
            child, row2, parent2 = child[order], np.tile(row, WIDTH)[order], np.tile(parent, WIDTH)[order]
            begin = np.flatnonzero(np.append(True, child[1:] != child[:-1]))
            born = np.diff(np.append(begin, len(child)))
            kept = np.bincount(parent2[begin], born.astype(np.float64) ** 2, len(sizes))
            stuck = kept >= 0.9 * sizes.astype(np.float64) ** 2
            if stuck.any():
                at = np.cumsum(sizes) - sizes
                for k in np.flatnonzero(stuck):
                    group = row[at[k] : at[k] + sizes[k]]
                    if sizes[k] <= self.most:
                        self.exhaust(group, sizes[k : k + 1])
                    else:
                        self.dense.append(group)
            go = ~stuck[parent2] & np.repeat(born > 1, born)
            child, row2 = child[go], row2[go]
            while len(child):  # pieces of whole nodes, so that the arrays stay bounded
                upto = len(child)
                if upto > 400_000:
                    upto = int(np.searchsorted(child, child[400_000], side="left")) or int(np.searchsorted(child, child[400_000], side="right"))
                work.append((child[:upto], row2[:upto]))
                child, row2 = child[upto:], row2[upto:]
        pair = np.concatenate(self.found, axis=1)
        return np.unique(pair, axis=1) if pair.shape[1] else pair


_OUT = "kind tinyint, " + _ROW


def _out(kind: int, a: np.ndarray, b: np.ndarray, payload: np.ndarray | None = None) -> pa.RecordBatch:
    rest = [pa.nulls(len(a), pa.int64())] * 8 if payload is None else [pa.array(np.ascontiguousarray(payload[:, i]).view(np.int64)) for i in range(8)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int8)), pa.array(a.view(np.int64)), pa.array(b), *rest], names=["kind", "node", "cid", *_PAYLOAD])


def _compared(similarity: float, limit: int, most: int, most_rows: int, deviations: float, whole: bool = False):
    """Over rows sorted by node: (0, a, b) for candidates; (1, row) for rows of nodes of more than ``most_rows`` sets, to be branched
    on; (2, row) for rows of nodes of more than ``most`` sets that branching doesn't part. ``whole``: every node is compared as it is."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = _Nodes(similarity, 1 << 60 if whole else limit, most, deviations)
        pending: list[tuple] = []
        open_: list[tuple] = []
        counts = {"pending": 0, "open": 0}
        flooded: dict[int, int] = {}

        def work() -> Iterator[pa.RecordBatch]:
            node, cid, payload = (np.concatenate(x) for x in zip(*pending))
            pending.clear()
            counts["pending"] = 0
            found = nodes.pairs(node, cid, payload)
            if found.shape[1]:
                yield _out(0, found[0], found[1])
            for k, group in enumerate(nodes.dense):  # a name of its own for each: all its pairs are looked at
                yield _out(2, np.full(len(group), _mix(node[group[:1]] + np.uint64(k))[0]), cid[group], payload[group])

        for batch in stream:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(10)]
            rows = (cols[0].view(np.uint64), cols[1], np.stack([c.view(np.uint64) for c in cols[2:]], axis=1))
            node = rows[0]
            if not len(node):
                continue
            if flooded:
                name, kind = next(iter(flooded.items()))
                same = int((node == name).sum())
                if same:
                    yield _out(kind, node[:same], rows[1][:same], rows[2][:same])
                    rows = tuple(x[same:] for x in rows)
                    node = rows[0]
                    if not len(node):
                        continue
                flooded.clear()
            differ = np.flatnonzero(node != node[-1])
            k = int(differ[-1]) + 1 if len(differ) else 0
            if open_ and (k or open_[0][0][0] != node[0]):
                joins = int((node[:k] == open_[0][0][0]).sum()) if k else 0
                pending += open_ + ([tuple(x[:joins] for x in rows)] if joins else [])
                counts["pending"] += counts["open"] + joins
                if k > joins:
                    pending.append(tuple(x[joins:k] for x in rows))
                    counts["pending"] += k - joins
                open_, counts["open"] = [], 0
            elif k:
                pending.append(tuple(x[:k] for x in rows))
                counts["pending"] += k
            open_.append(tuple(x[k:] for x in rows))
            counts["open"] += len(node) - k
            if counts["open"] > most_rows and not whole:
                name, cid, payload = (np.concatenate(x) for x in zip(*open_))
                child = _children(name, payload[:, 4:])
                held = sum((np.unique(c, return_counts=True)[1].astype(np.float64) ** 2).sum() for c in child)
                kind = 2 if held >= 0.9 * float(len(name)) ** 2 else 1
                yield _out(kind, name, cid, payload)
                flooded[int(name[0])] = kind
                open_, counts["open"] = [], 0
            if counts["pending"] > 150_000:
                yield from work()
        pending += open_
        if pending:
            yield from work()

    return run


def _branched(levels: int = 1):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(10)]
            node, cid, payload = cols[0].view(np.uint64), cols[1], np.stack([c.view(np.uint64) for c in cols[2:]], axis=1)
            for _ in range(levels):
                node = _children(node, payload[:, 4:]).reshape(-1)
                cid, payload = np.tile(cid, WIDTH), np.tile(payload, (WIDTH, 1))
            yield _out(0, node, cid, payload).select(["node", "cid", *_PAYLOAD])

    return run


def similar_classes(
    reps: DataFrame,
    texts: Callable[[DataFrame], DataFrame],
    similarity: float = 0.6,
    *,
    least_len: int = 3,
    limit: int = 64,
    most: int = 20_000,
    most_rows: int = 400_000,
    deviations: float = 3.5,
) -> DataFrame:
    """Pairs of representatives (a, b), a < b, with Jaccard similarity of at least ``similarity``; each pair exact, with a recall that is set by the trees.

    ``texts`` gives (cid, h, g, text) of the representatives (cid, rep, h, g) it is asked for; rows of which the words are
    not those of (h, g) are passed over, so it may give several for each.

    Recall: a pair of similarity s stands together in a tree's first node with chance s and then in either of two children
    with s + (1 - s) / 16, so the chance r to be found below a node is at least 1 - (1 - (s + (1 - s) / 16) r) ** 2, which
    does not fall below 0.64 for s = 0.6 however deep the tree. With 12 trees a pair of similarity 0.6 is missed with a
    chance of at most 0.3 % (0.1 % within three levels), one of 0.7 with 0.002 %, whatever its words. The sketches pass
    over 0.02 % at 0.6 (``deviations`` standard deviations) and far fewer above. Nothing is capped: nodes of more than
    ``most_rows`` sets are branched in a further exchange, and where branching does not part them compared block by block.
    """
    spark = reps.sparkSession
    cores = parallelism(spark)
    n = reps.count()
    parts = max(2 * cores, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * TREES // 200_000))
    half = [F.col(c) for c in _TREES]
    values = [x for c in half for x in (c.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(c, 32))]
    first = F.explode(F.array(*[F.xxhash64(F.lit(i), v) for i, v in enumerate(values)])).alias("node")
    rows = reps.select(first, "cid", *_PAYLOAD)
    hot = max(most_rows // 2, n * TREES // (8 * cores))
    if n > hot:  # nodes that would make a task too large are branched before they are exchanged; at most 8 * cores of them
        names = cut(reps.select(first).groupBy("node").agg(F.count("*").alias("sets")).where(F.col("sets") > hot))
        top = names.agg(F.max("sets")).first()[0]
        if top:
            marked = rows.join(F.broadcast(names.withColumn("hot", F.lit(True)).drop("sets")), "node", "left").select("node", "cid", *_PAYLOAD, "hot")
            parted = marked.where("hot").drop("hot").mapInArrow(_branched(max(1, int(np.ceil(np.log2(top / hot))))), _ROW)
            rows = marked.where("hot is null").drop("hot").union(parted)

    def compared(nodes: DataFrame, n_parts: int, **more) -> DataFrame:
        met = nodes.repartition(n_parts, "node").sortWithinPartitions("node")
        return cut(met.mapInArrow(_compared(similarity, limit, most, most_rows, deviations, **more), _OUT))

    found = []
    while True:
        out = compared(rows, parts)
        found.append(out.where("kind = 0").select(F.col("node").alias("a"), F.col("cid").alias("b")))
        rest = {r[0]: r[1] for r in out.where("kind > 0").groupBy("kind").count().collect()}
        if 2 in rest:
            blocks = _in_blocks(out.where("kind = 2").drop("kind"))
            met = compared(blocks, max(parts, -(-rest[2] // 10_000)), whole=True)
            found.append(met.where("kind = 0").select(F.col("node").alias("a"), F.col("cid").alias("b")))
        if 1 not in rest:
            break
        rows = out.where("kind = 1").drop("kind").mapInArrow(_branched(), _ROW)
    pairs = found[0]
    for f in found[1:]:
        pairs = pairs.union(f)
    return verify(cut(pairs.distinct()), reps, texts, similarity, least_len)


def _in_blocks(dense: DataFrame, block: int = 4096) -> DataFrame:
    """Rows of nodes as rows of nodes for each pair of blocks, so that all pairs of a node stand together in one of them."""
    sizes = dense.groupBy("node").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    placed = dense.join(sizes, "node").withColumn("mine", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    other = F.expr("transform(sequence(0, blocks - 1), o -> xxhash64(node, least(o, mine), greatest(o, mine)))")
    # A block alone needs no node of its own where it stands with another.
    other = F.when(F.col("blocks") > 1, F.filter(other, lambda x: x != F.xxhash64("node", "mine", "mine"))).otherwise(other)
    return placed.select(F.explode(other).alias("node"), *[c for c in dense.columns if c != "node"])


def verify(pairs: DataFrame, reps: DataFrame, texts: Callable[[DataFrame], DataFrame], similarity: float, least_len: int = 3) -> DataFrame:
    """Of candidate ``pairs`` (a, b) those whose sets really have the similarity. Only texts of candidates are read."""
    involved = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    asked = reps.select("cid", "rep", "h", "g").join(involved, "cid", "left_semi")
    got = tokens_of(texts(asked).select("cid", F.col("h").alias("__h"), F.col("g").alias("__g"), "text"), ["cid", "__h", "__g"], "text", least_len)
    sets = cut(got.where("h = __h and g = __g").groupBy("cid").agg(F.first("tokens").alias("tokens")))
    both = pairs.join(sets.toDF("a", "ta"), "a").join(sets.toDF("b", "tb"), "b").withColumn("k", F.size(F.array_intersect("ta", "tb")))
    return both.where(F.col("k") >= F.lit(similarity) * (F.size("ta") + F.size("tb") - F.col("k"))).select("a", "b")
