"""Ranked full-text search over postings, derived or kept."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from worklens.plans.lineage import cut, cut_and_measure
from worklens.sources.buckets import Store, Table

K1, B = 1.2, 0.75
POSTINGS = "key string, word string, tf bigint, pos array<int>, len bigint"
#: Characters of the tokens of queries that are broadcast at once.
AT_ONCE = 16_000_000


def query_words(query: str) -> list[str]:
    """Words of a search text: operators and their signs removed, lower-cased, split where the index splits."""
    bare = re.sub(r"\b(?:NEAR|AND|OR|NOT)\b", " ", re.sub(r'[*"()^+-]', " ", query), flags=re.I)
    return list(dict.fromkeys(w for w in re.split(r"[^0-9a-z]+", bare.lower()) if w))


def _bare(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r'[*"()^+-]', " "), r"(?iU)\b(?:NEAR|AND|OR|NOT)\b", " ")


def query_words_of(c: Column) -> Column:
    """``query_words`` of a column."""
    return F.array_distinct(words_of(_bare(c)))


def query_phrases_of(c: Column) -> Column:
    """The terms of a search text: for each run without blanks the array of its words, of which more than one are a phrase."""
    terms = F.transform(F.split(_bare(c), r"(?U)\s+"), words_of)
    return F.array_distinct(F.filter(terms, lambda t: F.size(t) > 0))


def words_of(c: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^0-9a-z]+"), lambda w: w != "")


def _text(fields: list[str]) -> Column:
    """The words of all fields, with an empty word between two fields."""
    return reduce(lambda a, b: F.concat(a, F.array(F.lit("")), b), [words_of(F.col(f)) for f in fields])


def postings(docs: DataFrame, key: str, fields: list[str], kind: str = "string", only: DataFrame | None = None) -> DataFrame:
    """(key, word, tf, pos, len): each word of each row, how often and where it stands, and the row's number of words.

    Words are numbered through all fields, with a gap between two, so that no phrase spans them. Every row has one more
    row with an empty word, so that rows without words count too. Null fields count as empty. ``only``: words (word) beside
    which none are wanted; they are chosen before anything is exchanged.
    """
    gap = F.array(F.lit(""))
    text = _text(fields)
    each = docs.select(F.col(key).cast(kind).alias("key"), text.alias("w")).select("key", F.size(F.filter("w", lambda x: x != "")).cast("bigint").alias("len"), F.posexplode(F.concat("w", gap)).alias("p", "word"))
    if only is not None:
        wanted = only.select("word").distinct().withColumn("asked", F.lit(True))
        each = each.join(wanted, "word", "left").where("asked or word = ''").drop("asked")
    out = each.groupBy("key", "word").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("p")).alias("pos"), F.first("len").alias("len"))
    empty = F.col("word") == ""
    return out.select("key", "word", F.when(empty, 0).otherwise(F.col("tf")).alias("tf"), F.when(empty, F.array().cast("array<int>")).otherwise(F.col("pos")).alias("pos"), "len")


class Index:
    """Postings that are kept in hash buckets by row under a manifest: ``update`` rewrites the buckets of the rows that have
    changed or are gone, ``rebuild`` all of them; ``postings`` is what ``search`` takes."""

    def __init__(self, spark: SparkSession, root: str, key: str, fields: list[str], rows_a_bucket: int = 2_000_000) -> None:
        self.spark, self.key, self.fields = spark, key, fields
        self.store = Store(spark, root)
        self.table = Table(self.store, "postings", POSTINGS, ["key"], rows_a_bucket)

    @property
    def postings(self) -> DataFrame:
        return self.table.read()

    def rebuild(self, docs: DataFrame) -> None:
        self._take(docs, None, True)

    def update(self, changed: DataFrame, removed: DataFrame | None = None) -> None:
        """``changed``: rows as they are now, new ones among them; ``removed``: a column of keys."""
        self._take(changed, removed, False)

    def _take(self, docs: DataFrame, removed: DataFrame | None, whole: bool) -> None:
        folder = self.store.folder()
        fresh = Table(self.store, "fresh", POSTINGS, ["key"])
        rows = postings(docs, self.key, self.fields)
        if removed is not None:
            gone = removed.select(F.col(removed.columns[0]).cast("string").alias("key")).distinct()
            rows = rows.join(gone, "key", "left_anti").unionByName(gone.select("key", F.lit(None).cast("string").alias("word")), allowMissingColumns=True)
        at, seen = fresh.stage(rows, folder, self.table.n)
        kept = 0 if whole else self.store.state.get("rows", 0)
        n = self.table.grown(kept + seen["rows"])
        new = self.spark.read.schema(POSTINGS).parquet(*at.values()) if at else self.spark.createDataFrame([], POSTINGS)
        touched = list(self.table.places) if whole or n != self.table.n else list(at)
        old = self.table.read([] if whole else touched)
        merged = old.join(new.select("key").distinct(), "key", "left_anti").unionByName(new.where("word is not null"))
        places, written = self.table.stage(merged, folder, n)
        count = written["rows"] + (0 if whole or n != self.table.n else kept - old.count())
        self.store.commit({**self.store.state, "rows": count}, {**self.store.places, "postings": self.table.merged(places, touched)}, {**self.store.sizes, "postings": n})


def search(index: DataFrame, queries: DataFrame, limit: int | None = None, phrases: bool = True) -> DataFrame:
    """(query, key, score, rank): rows of an ``index`` (postings) in which every word of the query stands, best first, ties by key.

    ``queries`` is a table (query, text) with one row a query, or (query, text, most) with a limit for each. With
    ``phrases`` the words of one run without blanks (``a.b``, ``a_b``) must follow one another. Score: BM25 with k1 1.2,
    b 0.75 and idf ln(1 + (n - df + 0.5) / (df + 0.5)). A query's hits are looked for among the rows with its rarest word;
    nothing of queries or postings is collected. A query without words has no result.
    """
    return _answer(index, cut(_asked(queries, limit, phrases)), phrases)


def _asked(queries: DataFrame, limit: int | None, phrases: bool) -> DataFrame:
    """(query, most, term, size, place, word): the words of each query."""
    terms = query_phrases_of(F.col("text")) if phrases else F.transform(query_words_of(F.col("text")), lambda w: F.array(w))
    most = F.col("most") if "most" in queries.columns else F.lit(limit).cast("int")
    each = queries.select("query", most.alias("most"), F.posexplode(terms).alias("term", "words"))
    return each.select("query", "most", "term", F.size("words").alias("size"), F.posexplode("words").alias("place", "word"))


def _answer(index: DataFrame, asked: DataFrame, phrases: bool) -> DataFrame:
    words = asked.groupBy("query", "most").agg(F.count_distinct("word").alias("need")).join(asked.select("query", "word").distinct(), "query")
    held = cut(index.join(asked.select("word").distinct().withColumn("asked", F.lit(True)), "word", "left").where("asked or word = ''").drop("asked"))
    all_ = held.where("word = ''").agg(F.count("*").alias("n"), F.avg("len").alias("avg"))
    tf = held.where("word <> ''")
    df = tf.groupBy("word").agg(F.count("*").alias("df"))
    wanted = words.join(df, "word", "left").select("query", "most", "need", "word", F.coalesce("df", F.lit(0)).alias("df"))
    rarest = wanted.groupBy("query").agg(F.min(F.struct("df", "word")).alias("r")).where("r.df > 0").select("query", F.col("r.word").alias("word"))
    near = rarest.join(tf.select("key", "word"), "word").select("query", "key")
    met = near.join(wanted, "query").join(tf, ["key", "word"]).join(F.broadcast(all_))  # one row
    hits = met.groupBy("query", "key", "most", "need").agg(F.count("*").alias("have"), F.round(F.sum(_part()), 6).alias("score")).where("have = need")
    if phrases:
        parts = asked.where("size > 1").join(hits.select("query", "key"), "query").join(tf.select("key", "word", "pos"), ["key", "word"])
        starts = parts.groupBy("query", "key", "term").agg(F.collect_list(F.struct("place", F.transform("pos", lambda p: p - F.col("place")).alias("at"))).alias("x"))
        both = F.aggregate(F.slice("x", 2, F.size("x")), F.col("x")[0]["at"], lambda a, y: F.array_intersect(a, y["at"]))
        apart = starts.where(F.size(both) == 0).select("query", "key").distinct()
        hits = hits.join(apart, ["query", "key"], "left_anti")
    out = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "key")))
    return out.where(F.col("most").isNull() | (F.col("rank") <= F.col("most"))).select("query", "key", "score", "rank")


def ranked(docs: DataFrame, key: str, fields: list[str], queries: dict[str, str] | DataFrame, limit: int | None = None, phrases: bool = False) -> DataFrame:
    """(query, key, score, rank): ``search`` over postings derived from ``docs`` for these queries alone, {query: text} or a table (query, text)."""
    if isinstance(queries, dict):
        return _ranked_few(docs, key, fields, queries, limit)
    asked = cut(_asked(queries, limit, phrases))
    return _answer(postings(docs, key, fields, docs.schema[key].dataType.simpleString(), asked), asked, phrases).withColumnRenamed("key", key)


def _ranked_few(docs: DataFrame, key: str, fields: list[str], queries: dict[str, str], limit: int | None) -> DataFrame:
    """The same for queries that are parameters, without phrases: their words are part of the plan, and only postings of them are made."""
    asked = [(q, w) for q, text in queries.items() for w in query_words(text)]
    spark = docs.sparkSession
    if not asked:
        return spark.createDataFrame([], f"query string, {key} {docs.schema[key].dataType.simpleString()}, score double, rank int")
    need = {q: len(query_words(t)) for q, t in queries.items()}
    terms = F.array(*[F.lit(w) for w in sorted({w for _, w in asked})])
    sized = docs.select(F.col(key), F.concat(*[words_of(F.col(f)) for f in fields]).alias("w")).select(key, F.size("w").alias("len"), F.filter("w", lambda x: F.array_contains(terms, x)).alias("hits"))
    all_ = sized.agg(F.count("*").alias("n"), F.avg("len").alias("avg"))
    tf = sized.where(F.size("hits") > 0).select(key, "len", F.explode("hits").alias("word")).groupBy(key, "len", "word").agg(F.count("*").alias("tf"))
    wanted = spark.createDataFrame([(q, w, need[q]) for q, w in asked], "query string, word string, need int")
    df = tf.groupBy("word").agg(F.count("*").alias("df"))
    few = df.join(F.broadcast(wanted), "word").join(F.broadcast(all_))  # a row for each word of the parameters; one row
    hits = tf.join(F.broadcast(few), "word").groupBy("query", key).agg(F.count("*").alias("have"), F.max("need").alias("need"), F.round(F.sum(_part()), 6).alias("score"))
    out = hits.where("have = need").withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), key)))
    return (out.where(F.col("rank") <= limit) if limit else out).select("query", key, "score", "rank")


def search_rows(docs: DataFrame, key: str, fields: list[str], queries: DataFrame, limit: int | None = None, kind: str | None = None) -> DataFrame:
    """(query, key, score, rank) as of ``search`` with phrases, found in the rows of ``docs`` themselves.

    Queries with the same terms are answered once. A row becomes a list of the asked tokens in it, is tested where it stands
    by each query whose rarest token it holds, and only hits that are among the best of their part are exchanged, so that no
    pair of query and row is where all queries have a limit of at most 1,000. ``docs`` has one row a key; if it is partitioned
    by the key, its words are not exchanged either. Queries are broadcast, at most AT_ONCE characters at once.
    """
    asked, seen = _distinct(queries, limit)
    hits = _hits(docs, key, fields, asked, seen, True, kind)
    ranks = hits.where("key is not null").withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "key")))
    if not seen["open"]:
        ranks = ranks.where(F.col("rank") <= (seen["most"] or 0))
    each = ranks.join(asked.select("qid", "subs"), "qid").select(F.explode("subs").alias("s"), "key", "score", "rank")
    return each.where("s.most is null or rank <= s.most").select("s.query", "key", "score", "rank")


def matches(docs: DataFrame, key: str, fields: list[str], queries: DataFrame) -> DataFrame:
    """(query, key): rows in which all terms of the query stand, as of ``search_rows`` without order, so that no hit is exchanged."""
    asked, seen = _distinct(queries, None)
    return _hits(docs, key, fields, asked, seen, False, None).select(F.explode("subs.query").alias("query"), "key")


def _distinct(queries: DataFrame, limit: int | None) -> tuple[DataFrame, dict]:
    """(qid, terms, subs): the different lists of terms, each with the (query, most) that ask for it."""
    most = F.col("most") if "most" in queries.columns else F.lit(limit).cast("int")
    each = queries.select("query", most.alias("most"), F.array_sort(query_phrases_of(F.col("text"))).alias("terms")).where(F.size("terms") > 0)
    asked = each.groupBy("terms").agg(F.collect_list(F.struct("query", "most")).alias("subs")).withColumn("qid", F.monotonically_increasing_id())
    sizes = F.transform("terms", lambda t: F.size(t))
    length = F.length(F.array_join(F.flatten("terms"), " ")) + F.length(F.to_json("subs")) + 64
    most = F.array_max("subs.most")
    return cut_and_measure(asked, open=F.max(F.exists("subs.most", lambda m: m.isNull())), most=F.max(most), shortest=F.min(F.array_min(sizes)), longest=F.max(F.array_max(sizes)), chars=F.sum(length))


def _pairs(words: Column) -> Column:
    """Each word but the last with the one behind it."""
    return F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))


def _hits(docs: DataFrame, key: str, fields: list[str], asked: DataFrame, seen: dict, scored: bool, kind: str | None) -> DataFrame:
    """(qid, key, score), or (subs, key) where no scores are wanted.

    Tokens are the words and, for phrases, the pairs of words that follow one another: a pair stands in a row where its token
    does, a longer phrase where its pairs stand one behind the other.
    """
    longest = seen["longest"] or 0
    phrase = F.filter("terms", lambda t: F.size(t) > 1)
    words = F.flatten("terms") if scored else F.flatten(F.filter("terms", lambda t: F.size(t) == 1))
    pairs = F.flatten(F.transform(phrase, _pairs))
    asked = asked.withColumn("tokens", F.array_distinct(F.concat(words, pairs)))
    known, letters = cut_and_measure(asked.select(F.explode("tokens").alias("token")).distinct().withColumn("tok", F.monotonically_increasing_id()), n=F.sum(F.length("token") + 24))
    rows, all_ = _rows(docs, key, fields, known if (letters["n"] or 0) > AT_ONCE else F.broadcast(known), scored or seen["shortest"] == 1, longest, kind)

    df = rows.select(F.explode("toks").alias("tok")).groupBy("tok").agg(F.count("*").alias("df"))
    held = known.join(df, "tok")
    n, avg = all_["n"], (all_["total"] or 0) / max(1, all_["n"])
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    each = asked.select("qid", F.size("tokens").alias("need"), F.explode("tokens").alias("token")).join(held, "token")
    by = each.groupBy("qid", "need").agg(F.array_sort(F.collect_list(F.struct("df", "tok"))).alias("t"), F.collect_list(F.when(~F.col("token").contains(" "), F.struct("tok", idf.alias("idf")))).alias("words"))
    plan = by.where(F.size("t") == F.col("need")).select("qid", F.col("t")[0]["tok"].alias("first"), F.get("t", F.lit(1))["tok"].alias("second"), F.slice("t.tok", 3, F.size("t")).alias("rest"), "words")
    if longest > 2:
        spread = asked.select("qid", F.posexplode(F.transform(F.filter("terms", lambda t: F.size(t) > 2), _pairs)).alias("no", "run")).select("qid", "no", F.posexplode("run").alias("place", "token")).join(known, "token")
        runs = spread.groupBy("qid", "no").agg(F.array_sort(F.collect_list(F.struct("place", "tok"))).alias("run")).groupBy("qid").agg(F.collect_list("run.tok").alias("runs"))
        plan = plan.join(runs, "qid", "left")
    plan = cut(plan if scored else plan.drop("words").join(asked.select("qid", "subs"), "qid"))

    near = rows.select("*", F.explode("toks").alias("first"))
    found = None
    n_parts = 1 + (seen["chars"] or 0) // AT_ONCE
    for i in range(n_parts):
        part = plan if n_parts == 1 else plan.where(F.pmod(F.hash("qid"), F.lit(n_parts)) == i)
        more = near.join(F.broadcast(part), "first").where(F.col("second").isNull() | F.array_contains("toks", F.col("second")))
        found = more if found is None else found.unionByName(more)
    found = found.where((F.size("rest") == 0) | F.forall("rest", lambda r: F.array_contains("toks", r)))
    if longest > 2:
        found = found.where(F.col("runs").isNull() | F.forall("runs", _stands))
    if not scored:
        return found.select("subs", "key")
    tf = lambda w: F.get("tfs", (F.array_position("toks", w["tok"]) - 1).cast("int"))
    part = lambda w: w["idf"] * tf(w) * (K1 + 1) / (tf(w) + K1 * (1 - B + B * F.col("len") / F.lit(avg)))
    return found.select("qid", "key", F.round(F.aggregate("words", F.lit(0.0), lambda a, w: a + part(w)), 6).alias("score"))


def _rows(docs: DataFrame, key: str, fields: list[str], known: DataFrame, words: bool, longest: int, kind: str | None) -> tuple[DataFrame, dict]:
    """(key, len, toks, tfs, ats): of each row the tokens that are known, how often and, for phrases of three words or more, where they stand.
    Where all terms are phrases and no scores are wanted, ``words`` are not among the tokens."""
    base = docs.select(F.col(key).alias("key"), _text(fields).alias("w")).select("key", "w", F.size(F.array_remove("w", "")).alias("len"))
    tokens = F.concat(F.array(F.lit("")), *(["w"] if words else []), *([_pairs(F.col("w"))] if longest > 1 else []))
    each = base.select("key", "len", tokens.alias("tokens")).select("key", "len", F.posexplode_outer("tokens").alias("p", "token"))  # outer: no filter is inferred that makes the tokens twice
    each = each.join(known, "token", "left").where("tok is not null or token = ''")
    at = [F.collect_list("p").alias("at")] if longest > 2 else []
    counted = each.groupBy("key", "tok").agg(F.count("*").alias("tf"), F.first("len").alias("len"), *at)
    one = F.struct("tok", F.col("tf").cast("int").alias("tf"), *(["at"] if at else []))
    rows = counted.groupBy("key").agg(F.first("len").alias("len"), F.collect_list(F.when(F.col("tok").isNotNull(), one)).alias("x"))
    out = F.col("key").cast(kind).alias("key") if kind else F.col("key")
    return cut_and_measure(rows.select(out, "len", F.col("x.tok").alias("toks"), F.col("x.tf").alias("tfs"), *([F.col("x.at").alias("ats")] if at else [])), n=F.count("*"), total=F.sum("len"))


def _stands(run: Column) -> Column:
    """Whether the tokens of ``run`` stand in a row one behind the other."""
    places = lambda t: F.get("ats", (F.array_position("toks", t) - 1).cast("int"))
    starts = F.transform(run, lambda t, i: F.transform(places(t), lambda p: p - i))
    return F.size(F.aggregate(starts, F.get(starts, F.lit(0)), lambda a, s: F.array_intersect(a, s))) > 0


def _part() -> Column:
    """A word's share of the score, of columns n, avg, df, tf and len."""
    return F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg")))


def two_tier(chunk_hits: DataFrame, page_hits: DataFrame) -> DataFrame:
    """(query, tier, key, rank): of each query the hits among chunks, or those among pages if there are none."""
    chunks = chunk_hits.select("query", F.lit("chunk").alias("tier"), F.col("key").cast("string").alias("key"), "rank")
    return chunks.unionByName(page_hits.join(chunks.select("query").distinct(), "query", "left_anti").select("query", F.lit("page").alias("tier"), F.col("key").cast("string").alias("key"), "rank"))


def context(index: DataFrame | Callable[[DataFrame], DataFrame], chunks: DataFrame, texts: DataFrame) -> DataFrame:
    """(query, place, key, page_title, location): passages for each of ``texts`` (query, text): the five best chunks for each keyword,
    the three best for each two keywords that follow one another, the ten best for the first twelve words; of those with one page title
    and location only the first, in that order.

    ``chunks`` is (key, page_title, breadcrumb, heading), ``index`` its postings or a search of its rows, from (query, text, most)
    to (query, key, score, rank).
    """
    from worklens.functions.text import keywords

    k = texts.select("query", "text", keywords(F.col("text")).alias("k")).select("query", "text", "k", F.size("k").alias("n"))
    one = k.select("query", F.posexplode("k").alias("no", "text"), F.lit(5).alias("most"))
    pairs = F.when(F.col("n") > 1, F.expr("transform(sequence(1, n - 1), i -> concat_ws(' ', k[i - 1], k[i]))")).otherwise(F.array().cast("array<string>"))
    two = k.select("query", "n", F.posexplode(pairs).alias("no", "text")).select("query", (F.col("n") + F.col("no")).alias("no"), "text", F.lit(3).alias("most"))
    lead = k.select("query", (F.col("n") * 2).alias("no"), F.array_join(F.slice(F.split("text", r"\s+"), 1, 12), " ").alias("text"), F.lit(10).alias("most"))
    asked = cut(one.unionByName(two).unionByName(lead).withColumn("sub", F.struct("query", "no")))
    searches = asked.select(F.col("sub").alias("query"), "text", "most")
    hits = (search(index, searches) if isinstance(index, DataFrame) else index(searches)).select("query.*", "key", "rank")
    where = F.coalesce(F.nullif("breadcrumb", F.lit("")), "heading", F.lit(""))
    found = hits.join(chunks.select(F.col("key").cast("string").alias("key"), "page_title", where.alias("location")), "key")
    first = found.groupBy("query", "page_title", "location").agg(F.min(F.struct("no", "rank", "key")).alias("f"))
    order = Window.partitionBy("query").orderBy("f.no", "f.rank", "f.key")
    return first.select("query", F.row_number().over(order).alias("place"), F.col("f.key").alias("key"), "page_title", "location")


def snippet(c: Column, words: list[str] | Column, width: int = 48) -> Column:
    """About ``width`` words from five before the first hit on, with the hits between ``**`` and an ellipsis where text is left out."""
    if isinstance(words, list):
        words = F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")
    any_word = F.array_join(words, "|")  # plain words, as of query_words_of
    before, after = F.lit(r"(?is)((?:\S+\s+){0,5}\S*\b(?:"), F.lit(rf")\b\S*(?:\s+\S+){{0,{width - 6}}})")
    near = F.call_function("regexp_extract", c, F.concat(before, any_word, after), F.lit(1))
    marked = F.regexp_replace(near, F.concat(F.lit(r"(?i)\b("), any_word, F.lit(r")\b")), F.lit("**$1**"))
    at = F.locate("\u0000", F.replace(c, near, F.lit("\u0000")))
    more = F.length(F.rtrim(c)) > at - 1 + F.length(near)
    return F.when((F.size(words) == 0) | (near == ""), "").otherwise(F.concat(F.when(at > 1, "…").otherwise(""), marked, F.when(more, "…").otherwise("")))
