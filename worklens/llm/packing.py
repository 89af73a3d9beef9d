"""Filling containers of fixed capacity by exact complements.

The plan needs only how many items there are of each length: at most ``capacity`` numbers, whatever the corpus. It is a
list of patterns (which lengths share a container, how often), made on the driver from those counts; the items then find
their containers by length and rank, in one pass without a shuffle beyond the ranking.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from worklens.llm.bpe import encode_documents
from worklens.plans.lineage import cut


def _complement(gap: int, left: np.ndarray) -> tuple[int, ...] | None:
    """One, two or three lengths whose sum is exactly ``gap``, all of them available; the largest lengths first."""
    if left[gap]:
        return (gap,)
    lengths = np.flatnonzero(left[: gap + 1])
    lengths = lengths[(lengths > 0) & (lengths < gap)]
    if not len(lengths):
        return None
    big = lengths[lengths * 2 >= gap]
    small = gap - big
    ok = (left[small] > 0) & ((small != big) | (left[big] > 1))
    if ok.any():
        a = int(big[ok][-1])
        return a, gap - a
    have = left[: gap + 1] > 0
    for a in lengths[::-1].tolist():
        if a * 3 < gap:
            break
        rest = gap - a
        b = lengths[(lengths <= min(a, rest - 1)) & (lengths * 2 >= rest)]
        c = rest - b
        ok = have[c]
        same_ab, same_bc, same_ac = b == a, c == b, c == a
        ok &= left[b] >= 1 + same_ab + same_bc
        ok &= left[c] >= 1 + same_bc + same_ac
        ok &= left[a] >= 1 + same_ab + same_ac
        if ok.any():
            x = int(b[ok][-1])
            return a, x, rest - x
    return None


def plan_containers(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, times) that place every item of ``counts`` {length: number}, lengths from 1 to ``capacity``.

    The longest length left opens a container. If one, two or three available lengths fill its gap exactly, they close
    it; else the longest that fits goes in and the smaller gap is tried again. A pattern is repeated until one of its
    lengths runs out, so the number of steps follows the number of lengths, not of items.
    """
    left = np.zeros(capacity + 1, np.int64)
    for k, n in counts.items():
        if not 0 < k <= capacity:
            raise ValueError(f"length {k} is not within 1..{capacity}")
        left[k] += n
    plan: list[tuple[tuple[int, ...], int]] = []
    top = capacity
    while True:
        while top and not left[top]:
            top -= 1
        if not top:
            return plan
        trial, gap, chosen = left.copy(), capacity, []
        take: tuple[int, ...] | None = (top,)
        while take:
            for k in take:
                trial[k] -= 1
                gap -= k
                chosen.append(k)
            if not gap:
                break
            take = _complement(gap, trial)
            if take is None:
                fit = np.flatnonzero(trial[: gap + 1])
                take = (int(fit[-1]),) if len(fit) else None
        kinds, uses = np.unique(chosen, return_counts=True)
        times = int((left[kinds] // uses).min())
        left[kinds] -= uses * times
        plan.append((tuple(chosen), times))


def _places(plan: list[tuple[tuple[int, ...], int]], capacity: int) -> tuple[np.ndarray, ...]:
    """For each length, runs of ranks: (length, first rank, first container, items a container), ordered by length and rank."""
    used: dict[int, int] = {}
    rows = []
    base = 0
    for chosen, times in plan:
        kinds, uses = np.unique(chosen, return_counts=True)
        for k, u in zip(kinds.tolist(), uses.tolist()):
            rows.append((k, used.get(k, 0), base, u))
            used[k] = used.get(k, 0) + u * times
        base += times
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 4)
    return a[:, 0], a[:, 1], a[:, 2], a[:, 3]


def pack(items: DataFrame, id_col: str, size_col: str, capacity: int = 2048, buckets: int | None = None) -> DataFrame:
    """Containers of ``capacity`` for the items of ``items``: (container_id, id, part_no, part_start, part_size).

    An item larger than the capacity is cut into full parts, each a container of its own, and a rest that is packed like
    an item; no other item is cut. Null, zero and negative sizes are in no container. Every row is an item, so a repeated
    row is packed twice; ids may be null. An empty table gives an empty result.

    Ranks within a length are found in two steps (within hash buckets, then over the buckets' counts), so a length that
    a third of all items share is no single task. Collected to the driver: one count for each length.
    """
    spark = items.sparkSession
    kind = items.schema[id_col].dataType.simpleString()
    sized = items.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{size_col}`").cast("int").alias("__n")).where("__n > 0")
    parts = sized.select(
        "__id",
        F.explode(F.sequence(F.lit(0), F.expr(f"cast((__n - 1) div {capacity} as int)"))).alias("__part"),
        F.col("__n"),
    ).select("__id", "__part", F.expr(f"least({capacity}, __n - __part * {capacity})").alias("__size"))
    parts = cut(parts.withColumn("__at", F.spark_partition_id()).withColumn("__seq", F.monotonically_increasing_id()))
    counts = {r[0]: r[1] for r in parts.groupBy("__size").count().collect()}  # at most `capacity` rows
    total = sum(counts.values())
    buckets = buckets or max(1, -(-total // 500_000)) * 16
    plan = plan_containers(counts, capacity)
    lengths, firsts, bases, each = (spark.sparkContext.broadcast(x) for x in _places(plan, capacity))

    hashed = parts.withColumn("__b", F.pmod(F.xxhash64("__seq"), F.lit(buckets)))
    local = hashed.withColumn("__r", F.row_number().over(Window.partitionBy("__size", "__b").orderBy("__id", "__part", "__seq")) - 1)
    sizes = hashed.groupBy("__size", "__b").count()
    before = sizes.select("__size", "__b", (F.sum("count").over(Window.partitionBy("__size").orderBy("__b")) - F.col("count")).alias("__before"))
    ranked = local.join(before, ["__size", "__b"]).select("__id", "__part", "__size", (F.col("__r") + F.col("__before")).alias("__rank"))

    def place(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        big = np.int64(1) << 42  # ranks are below it
        keys = lengths.value * big + firsts.value
        for batch in stream:
            size = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
            k = np.searchsorted(keys, size * big + rank, side="right") - 1
            box = bases.value[k] + (rank - firsts.value[k]) // each.value[k]
            part = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int32)
            cols = [pa.array(box), batch.column(0), pa.array(part), pa.array(part * np.int32(capacity)), pa.array(size.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=["container_id", id_col, "part_no", "part_start", "part_size"])

    return ranked.mapInArrow(place, f"container_id bigint, `{id_col}` {kind}, part_no int, part_start int, part_size int")


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, vocab: str | None = None) -> DataFrame:
    """``pack`` for texts, measured in tokens of byte_bpe_50k. Texts are encoded once; empty and null ones are in no container."""
    return pack(encode_documents(df, id_col, text_col, vocab=vocab, lengths_only=True), id_col, "n_tokens", capacity)
