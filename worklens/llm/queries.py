"""Queries of the llm operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worklens.llm import bpe, cooccurrence, language, near_tickets, packing, splitting
from worklens.sources.tables import load


def p3_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair that stands on a current ticket, with its counts."""
    return cooccurrence.ticket_pairs(spark, sf_dir).scores().select("item_a", "item_b", "n_both", "n_a", "n_b", "n_baskets")


def p3_affected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of which a count changed when the current rows of tickets followed their oldest ones."""
    return cooccurrence.ticket_pairs(spark, sf_dir).scores(affected_only=True).select("item_a", "item_b", "n_both", "n_a", "n_b")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(load(spark, sf_dir, "documents"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(load(spark, sf_dir, "documents"))


def p5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item that is cut: how much of it the pieces hold, and whether all are bounded, overlap as they must and say what the item says."""
    cut = splitting.pieces(spark, sf_dir)
    texts = splitting.long_items(spark, sf_dir).select("item_kind", "item_id", "content")
    both = cut.join(texts, ["item_kind", "item_id"])
    overlap = F.when(F.col("piece_no") == 0, F.col("start") == 0).otherwise((F.col("new") - F.col("start") == 100) & (F.col("start") > 0))
    exact = F.col("piece") == F.expr("substring(content, cast(start as int) + 1, cast(end - start as int))")
    return both.groupBy("item_kind", "item_id").agg(
        F.sum(F.col("end") - F.col("new")).alias("covered"), F.max("end").alias("n_chars"), (F.max(F.col("end") - F.col("start")) <= 2000).alias("bounded"), F.every(overlap).alias("overlapping"), F.every(exact).alias("exact")
    )


def p6_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash of each document's text as decoded from its ids."""
    ids = bpe.encode_documents(load(spark, sf_dir, "documents"))
    return bpe.decode_documents(ids).select("doc_id", F.md5("text").alias("text_hash"))


def p7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether no container is over its capacity, each document is there whole and cut only if it must be, and the containers are
    at most half a percent more than all tokens need, or one."""
    parts = packing.pack_documents(load(spark, sf_dir, "documents"))
    boxes = parts.groupBy("container_id").agg(F.sum("part_size").alias("n"))
    docs = parts.groupBy("doc_id").agg(F.count("*").alias("parts"), F.sum("part_size").alias("n"), F.max(F.col("part_start") + F.col("part_size")).alias("end"))
    full = boxes.agg(F.coalesce(F.max("n") <= 2048, F.lit(True)).alias("bounded"), F.count("*").alias("boxes"), F.sum("n").alias("tokens"))
    few = F.coalesce(F.col("boxes") <= F.greatest(F.ceil(F.col("tokens") / 2048) + 1, F.col("tokens") / 2048 * 1.005), F.lit(True))
    whole = docs.agg(F.coalesce(F.every((F.col("n") == F.col("end")) & (F.col("parts") == F.ceil(F.col("n") / 2048))), F.lit(True)).alias("whole"))
    return full.join(F.broadcast(whole)).select("bounded", "whole", few.alias("few"))  # one row each


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": near_tickets.found,
    "p2_groups": near_tickets.groups,
    "p3_found": cooccurrence.found,
    "p3_scores": p3_scores,
    "p3_affected": p3_affected,
    "p5_found": splitting.found,
    "p5_pieces": splitting.pieces,
    "p5_rules": p5_rules,
    "p6_ids": p6_ids,
    "p6_round_trip": p6_round_trip,
    "p7_containers": p7_containers,
    "p7_rules": p7_rules,
    "p8_found": language.found,
    "p8_documents": language.document_languages,
    "p8_stretches": language.document_stretches,
}

_CURRENT = "cur as (select * from (select *, row_number() over (partition by issue_key order by updated desc) as rn from tickets) where rn = 1)"



def _items(rows: str, tail: str = "") -> str:
    """Common table expressions items, one, two and scored of the rows ``rows`` of tickets, their names ending in ``tail``."""
    return f"""raw{tail} as (
  select issue_key, 'l:' as p, unnest(labels) as x from {rows}
  union all select issue_key, 'c:' as p, unnest(components) as x from {rows}
),
items{tail} as (
  select distinct issue_key, p || regexp_replace(lower(regexp_replace(x, '^\\s+|\\s+$', '', 'g')), '[\\s_-]+', '-', 'g') as item
  from raw{tail} where regexp_replace(x, '\\s', '', 'g') <> ''
),
one{tail} as (select item, count(*) as n from items{tail} group by 1),
two{tail} as (select a.item as item_a, b.item as item_b, count(*) as k from items{tail} a join items{tail} b on a.issue_key = b.issue_key and a.item < b.item group by 1, 2),
scored{tail} as (
  select item_a, item_b, k as n_both, x.n as n_a, y.n as n_b, (select count(*) from {rows}) as n_baskets
  from two{tail} join one{tail} x on x.item = item_a join one{tail} y on y.item = item_b
)"""


_ITEMS = f"{_CURRENT}, {_items('cur')}"
_OLDEST = "was as (select * from (select *, row_number() over (partition by issue_key order by updated) as rn from tickets) where rn = 1)"

_PAIRS = f"""{_CURRENT},
words as (
  select distinct issue_key, lower(unnest(regexp_extract_all(coalesce(summary, '') || ' ' || coalesce(description, ''), '[A-Za-z0-9]{{3,}}'))) as w from cur
),
sizes as (select issue_key, count(*) as n from words group by 1 having count(*) >= 12),
common as (select a.issue_key as key_a, b.issue_key as key_b, count(*) as k from words a join words b on a.w = b.w and a.issue_key < b.issue_key group by 1, 2),
pairs as (select key_a, key_b from common join sizes x on x.issue_key = key_a join sizes y on y.issue_key = key_b where k >= 0.6 * (x.n + y.n - k))"""

_TEXTS = """items as (
  select 'page' as item_kind, id as item_id, content from (select *, row_number() over (partition by id order by indexed_at desc) as rn from pages) where rn = 1
  union all select 'chunk', id::varchar, max(content) from chunks group by id
)"""

_BLOCKS = f"""with recursive {_TEXTS},
split as (select item_kind, item_id, string_split(regexp_replace(content, '\\r\\n|\\r', chr(10), 'g'), chr(10)) as l from items where length(content) > 2000),
line as (select item_kind, item_id, i, l[i] as t from (select *, unnest(range(1, len(l) + 1 - (l[-1] = '')::int)) as i from split)),
kind as (select *, regexp_extract(t, '^ *(```|~~~)', 1) as fence, regexp_full_match(t, '[ \\t\\x{{A0}}]*') as blank, regexp_matches(t, '^#{{1,6}} ') as head from line),
mark as (select item_kind, item_id, i, fence, row_number() over (partition by item_kind, item_id order by i) as r from kind where fence <> ''),
walk as (
  select item_kind, item_id, i, r, fence as opened from mark where r = 1
  union all select m.item_kind, m.item_id, m.i, m.r, case when w.opened = '' then m.fence when w.opened = m.fence then '' else w.opened end
  from walk w join mark m on m.item_kind = w.item_kind and m.item_id = w.item_id and m.r = w.r + 1
),
known as (
  select k.*, coalesce(last_value(w.opened ignore nulls) over (partition by k.item_kind, k.item_id order by k.i rows between unbounded preceding and 1 preceding), '') as inside
  from kind k left join walk w using (item_kind, item_id, i)
),
part as (select *, inside = '' and fence = '' and not blank and not head as plain from known),
begin as (
  select *, inside = '' and fence <> '' or plain and not coalesce(lag(plain) over (partition by item_kind, item_id order by i), false) as opens, inside <> '' or fence <> '' or plain as held from part
),
numbered as (select *, sum(opens::int) over (partition by item_kind, item_id order by i) as block_no from begin)
select item_kind, item_id, block_no::int as block_no from numbered where held group by all having sum(length(t)) + count(*) - 1 > 2000"""

ORACLE: dict[str, str] = {
    "p6_round_trip": "select doc_id, md5(coalesce(text, '')) as text_hash from documents",
    "p7_rules": "select true as bounded, true as whole, true as few",
    "p5_found": _BLOCKS,
    "p5_rules": f"with {_TEXTS} select item_kind, item_id, length(content) as n_chars, length(content) as covered, true as bounded, true as overlapping, true as exact from items where length(content) > 2000",
    "p2_found": f"with {_PAIRS} select key_a, key_b from pairs",
    "p2_groups": f"""with recursive {_PAIRS},
link as (select key_a as k, key_b as o from pairs union all select key_b, key_a from pairs),
reach as (select k, o from link union select r.k, l.o from reach r join link l on l.k = r.o),
same as (select issue_key, string_agg(w, ' ' order by w) as s from words join sizes using (issue_key) group by 1),
class as (select issue_key, min(issue_key) over (partition by s) as class_key from same)
select issue_key, class_key, least(issue_key, coalesce((select min(o) from reach where k = issue_key), issue_key)) as group_key, (select count(*) from link where k = issue_key) as n_links from class""",
    "p3_found": f"with {_ITEMS} select item_a, item_b from scored where n_both >= 6 and n_both * n_baskets >= 3 * n_a * n_b",
    "p3_scores": f"with {_ITEMS} select * from scored",
    "p3_affected": f"with {_ITEMS}, {_OLDEST}, {_items('was', '_was')} select item_a, item_b, n_both, n_a, n_b from scored except select item_a, item_b, n_both, n_a, n_b from scored_was",
}
