"""Languages of documents and of their stretches, by prediction by partial matching.

Each language has a context tree over bytes of normalised text: counts of the next byte after every context of up to
``ORDER`` bytes, with escape probabilities by method C (the number of distinct successors). The statistics are frozen, so
the code length of a byte depends only on the ``ORDER + 1`` bytes that end with it, and the trees of all languages
together are tables from such n-grams to one exact code length for each language.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worklens.plans.lineage import spread
from worklens.sources.tables import load

ORDER = 5
LEAST_CHARS = 25

# ISO 639 codes and English names of the languages in use.
NAMES = {
    "en": ("en", "eng", "english"),
    "de": ("de", "deu", "ger", "german"),
    "fr": ("fr", "fra", "fre", "french"),
    "es": ("es", "spa", "spanish", "castilian"),
    "it": ("it", "ita", "italian"),
    "nl": ("nl", "nld", "dut", "dutch", "flemish"),
    "pt": ("pt", "por", "portuguese"),
    "ru": ("ru", "rus", "russian"),
    "ja": ("ja", "jpn", "japanese"),
}
_BY_NAME = {n: code for code, names in NAMES.items() for n in names}


def named_language(label: str | None, codes: frozenset[str] = frozenset(NAMES)) -> str | None:
    """The two-letter code that a free-form label names, with or without a region; None if it names no language in use.

    ``codes``: the languages that samples are of; those that have no names here are named by their code alone.
    """
    word = re.match(r"[^\W\d_]+", (label or "").strip().lower())
    code = _BY_NAME.get(word.group(), word.group()) if word else None
    return code if code in codes or code in NAMES else None


_BREAK = re.compile(r"\r\n|\r|\n")
_FENCE = re.compile(r" *(```|~~~)")
_NO_LANGUAGE = re.compile(r"\s*(#{1,6}(\s|$)|\||\d{4}-\d\d-\d\d[T ]\d\d:\d\d|[\w.+-]+://\S*\s*$|=+\s*$|-+\s*$)")
_MARK = re.compile(r"[\s\ufeff]*(?:>\s*)*(?:[-*+]\s+|\d+[.)]\s+)?(?:\[[ xX]\]\s+)?")
_SENTENCE = re.compile(r"[.!?…]+[\"'”’»)\]]*(?=\s|$)|[。！？]+[」』）]*")
_NOISE = re.compile(r"\S+://\S+|\S+@\S+\.\S+|`[^`]*`|\S*[\d_=\\/{}<>|]\S*")
_APART = re.compile(r"[\W\d_]+")


def normalise(text: str) -> str:
    """Lower case without accents, addresses and words with digits; one blank between words."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
        text = "".join(c for c in text if not unicodedata.combining(c)).replace("ß", "ss").replace("ẞ", "ss")
    return _APART.sub(" ", _NOISE.sub(" ", text).lower()).strip()


def _spelt_out(text: str) -> str:
    """Umlauts as two letters, as they are often written where accents are lost."""
    return text.translate(str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue", "Ä": "Ae", "Ö": "Oe", "Ü": "Ue", "ß": "ss"}))


def segments(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of each sentence and list item of at least ``LEAST_CHARS`` code points.

    Fenced code, headings, tables, log lines and lines that are an address have no language. A list item of which every
    sentence is shorter is one segment. Texts of any length are gone through line by line.
    """
    fence, start = None, 0
    end = len(text)
    while start <= end:
        m = _BREAK.search(text, start)
        stop, after = (m.start(), m.end()) if m else (end, end + 1)
        f = _FENCE.match(text, start, stop)
        if f and fence in (None, f.group(1)):
            fence = None if fence else f.group(1)
        elif fence is None and stop - start >= LEAST_CHARS and not _NO_LANGUAGE.match(text, start, stop):
            first = _MARK.match(text, start, stop).end()
            at, some = first, False
            for s in _SENTENCE.finditer(text, first, stop):
                while at < s.end() and text[at].isspace():
                    at += 1
                if s.end() - at >= LEAST_CHARS:
                    yield at, s.end()
                    some = True
                at = s.end()
            while at < stop and text[at].isspace():
                at += 1
            if stop - at >= LEAST_CHARS:
                yield at, at + len(text[at:stop].rstrip())
                some = True
            if not some and len(text[first:stop].strip()) >= LEAST_CHARS:
                yield first, stop
        start = after


class _Hash:
    """From int64 keys to row numbers, by open addressing in numpy; -1 for none."""

    def __init__(self, keys: np.ndarray) -> None:
        self.shift = np.uint64(64 - max(4, int(len(keys) * 4).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.keys = np.full(size + 64, -1, np.int64)
        self.rows = np.full(size + 64, -1, np.int32)
        self.reach = 1
        for row, (key, slot) in enumerate(zip(keys.tolist(), self._slot(keys).tolist())):
            at = slot
            while self.keys[at] != -1:
                at += 1
            self.keys[at], self.rows[at] = key, row
            self.reach = max(self.reach, at - slot + 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        out = np.where(self.keys[at] == keys, self.rows[at], -1)
        open_ = np.flatnonzero((out < 0) & (self.keys[at] != -1))
        for d in range(1, self.reach):
            if not len(open_):
                break
            there = self.keys[at[open_] + d]
            hit = there == keys[open_]
            out[open_[hit]] = self.rows[at[open_[hit]] + d]
            open_ = open_[~hit & (there != -1)]
        return out


class Model:
    """Frozen context trees of all languages. ``samples``: (language, text)."""

    def __init__(self, samples: list[tuple[str, str]]) -> None:
        self.languages = sorted({lang for lang, _ in samples})
        self.cost: list[np.ndarray] = []
        self.escape: list[np.ndarray] = []
        self.grams: list[_Hash] = []
        self.contexts: list[_Hash] = []
        n = len(self.languages)
        full = []  # of each language, the n-gram that ends at each byte
        for lang in self.languages:
            forms = [f for other, text in samples if other == lang for f in dict.fromkeys((normalise(text), normalise(_spelt_out(text))))]
            full.append(self._grams(forms)[0])
        for o in range(ORDER + 1):
            per = [np.unique(g & self._mask(o), return_counts=True) for g in full]
            keys = np.unique(np.concatenate([k for k, _ in per]))
            count = np.zeros((len(keys), n))
            for i, (k, c) in enumerate(per):
                count[np.searchsorted(keys, k), i] = c
            contexts, owner = np.unique(keys >> 8, return_inverse=True)
            distinct, total = np.zeros((len(contexts), n)), np.zeros((len(contexts), n))
            np.add.at(distinct, owner, count > 0)
            np.add.at(total, owner, count)
            escape = np.where(distinct > 0, -np.log2(np.maximum(distinct, 1) / np.maximum(distinct + total, 1)), 0.0)
            lower = self._by_lower(keys, o - 1)
            seen = -np.log2(np.maximum(count, 1) / np.maximum(distinct + total, 1)[owner])
            self.cost.append(np.where(count > 0, seen, escape[owner] + lower).astype(np.float32))
            self.escape.append(escape.astype(np.float32))
            self.grams.append(_Hash(keys))
            self.contexts.append(_Hash(contexts))

    @staticmethod
    def _mask(o: int) -> int:
        return (1 << (8 * (o + 1))) - 1

    def _by_lower(self, gram: np.ndarray, order: int) -> np.ndarray:
        """The code lengths of the last byte of each n-gram by contexts of up to ``order`` bytes."""
        bits = np.zeros((len(gram), len(self.languages)), np.float32)
        todo = np.arange(len(gram))
        for o in range(order, -1, -1):
            g = gram[todo] & self._mask(o)
            row = self.grams[o].find(g)
            hit = row >= 0
            bits[todo[hit]] += self.cost[o][row[hit]]
            todo, g = todo[~hit], g[~hit]
            context = self.contexts[o].find(g >> 8)
            some = context >= 0
            bits[todo[some]] += self.escape[o][context[some]]
        bits[todo] += 8.0
        return bits

    def _grams(self, forms: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ``ORDER + 1`` bytes that end at each byte of the texts, as one number each, and the text it belongs to."""
        pieces = [self._bytes(f) for f in forms]
        data = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(sizes)
        counted = np.ones(len(data), bool)
        for i in range(ORDER):
            counted[ends - sizes + i] = False
        at = np.flatnonzero(counted)
        gram = np.zeros(len(at), np.int64)
        for i in range(ORDER, -1, -1):
            gram = (gram << 8) | data[at - i]
        return gram, np.repeat(np.arange(len(pieces)), sizes - ORDER)

    @staticmethod
    def _bytes(form: str) -> bytes:
        return b" " * ORDER + form.encode("utf-8", "replace") + b" "

    def code_lengths(self, forms: list[str]) -> np.ndarray:
        """Bits of each normalised text by each language."""
        gram, owner = self._grams(forms)
        return np.add.reduceat(self._by_lower(gram, ORDER), np.flatnonzero(np.diff(owner, prepend=-1)), axis=0)


def train(spark: SparkSession, samples: DataFrame, documents: DataFrame | None = None, most_samples: int = 20_000, most_documents: int = 2_000, sure: float = 0.95) -> Model:
    """Context trees from labelled rows: ``samples`` (lang, text), then also from ``documents`` (doc_id, lang, text).

    Bounds: at most ``most_samples`` samples and ``most_documents`` labelled documents, chosen by hash. Of a document only
    segments are learnt that the trees of the samples give, with a confidence of ``sure``, the language that its label
    names and that holds at least four fifths of it, so a wrong label teaches nothing. All statistics are frozen then.
    """
    rows = samples.where("lang is not null and text is not null").select("lang", "text").orderBy(F.xxhash64("text"), "text", "lang").limit(most_samples).collect()
    known = [(r[0], r[1]) for r in rows]
    first = Model(known)
    if documents is None:
        return first
    labelled = documents.where("lang is not null and lang <> '' and length(text) between 100 and 4000").select("doc_id", "lang", "text")
    rows = labelled.orderBy(F.xxhash64("doc_id"), "doc_id", "text", "lang").limit(most_documents).collect()
    learnt: dict[str, str] = {}
    size = np.zeros((len(rows), len(first.languages)))
    judged = list(judge(first, [r[2] for r in rows], temper=6.0))  # sharper than what is reported: ``sure`` is a margin here, not a chance
    codes = frozenset(first.languages)
    for i, a, b, k, _ in judged:
        size[i, k] += b - a
    for i, a, b, k, c in judged:
        lang = first.languages[k]
        if c >= sure and named_language(rows[i][1], codes) == lang and size[i, k] >= 0.8 * size[i].sum():
            learnt[rows[i][2][a:b]] = lang
    return Model(known + [(lang, text) for text, lang in sorted(learnt.items())])


def judge(model: Model, texts: list[str | None], temper: float = 14.0) -> Iterator[tuple[int, int, int, int, float]]:
    """(text number, start, end, language number, confidence) of each segment with a language.

    Confidence is the posterior of the language's code length against the others, tempered because neighbouring bytes
    are not independent; ``temper`` has the least log loss on held-out sentences of samples (of 721 sentences 0.005 from 12
    to 16, 0.008 at 6), where the mean confidence is the share that is right. A segment with too few letters to be a sentence has no language.
    """
    where: list[tuple[int, int, int]] = []
    forms: list[str] = []
    size = 0

    def flush() -> Iterator[tuple[int, int, int, int, float]]:
        bits = model.code_lengths(forms)
        best = bits.argmin(1)
        rest = np.exp2(np.clip((bits.min(1)[:, None] - bits) / temper, -60, 0)).sum(1)
        for (i, a, b), lang, total in zip(where, best.tolist(), rest.tolist()):
            yield i, a, b, lang, 1.0 / total

    for i, text in enumerate(texts):
        for a, b in segments(text or ""):
            form = normalise(text[a:b])
            if len(form) >= 12 and (form.count(" ") >= 2 or not form.isascii()):
                where.append((i, a, b))
                forms.append(form)
                size += len(form)
                if size > 400_000:
                    yield from flush()
                    where, forms, size = [], [], 0
    if forms:
        yield from flush()


def stretches(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """(id, stretch_no, start, end, lang, confidence, named): each run of segments in one language, by code points of the text.

    ``confidence`` from 0 to 1 is the mean over the segments by length; ``named`` says whether the row's label names the
    language. Null, empty and blank texts, and texts without a sentence, have no row. Each row of ``df`` is judged by
    itself: repeated rows and repeated or null ids give repeated results; other columns are not read. A narrow stage.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)  # size bounded by the labelled sample
    kind = df.schema[id_col].dataType.simpleString()
    src = spread(df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("__text"), F.col(f"`{label_col}`").cast("string").alias("__label")), id_col)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        codes = frozenset(m.languages)
        for whole in stream:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                labels = [named_language(x, codes) for x in batch.column(2).to_pylist()]
                row, no, start, end, lang, conf = [], [], [], [], [], []
                weight = 0.0
                for i, a, b, k, c in judge(m, batch.column(1).to_pylist()):
                    if row and row[-1] == i and lang[-1] == k:
                        conf[-1] = (conf[-1] * weight + c * (b - a)) / (weight + b - a)
                        weight += b - a
                        end[-1] = b
                    else:
                        no.append(no[-1] + 1 if row and row[-1] == i else 0)
                        row.append(i)
                        start.append(a)
                        end.append(b)
                        lang.append(k)
                        conf.append(c)
                        weight = float(b - a)
                names = [m.languages[k] for k in lang]
                cols = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(no, pa.int32()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(names, pa.string()), pa.array(conf, pa.float64())]
                cols.append(pa.array([labels[i] == x for i, x in zip(row, names)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(cols, names=[id_col, "stretch_no", "start", "end", "lang", "confidence", "named"])

    return src.mapInArrow(run, f"`{id_col}` {kind}, stretch_no int, start int, end int, lang string, confidence double, named boolean")


def _model(spark: SparkSession, sf_dir: str) -> Model:
    return train(spark, load(spark, sf_dir, "lang_samples"), load(spark, sf_dir, "documents"))


def document_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stretches(load(spark, sf_dir, "documents"), _model(spark, sf_dir))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages that a document holds and its label does not name."""
    return document_stretches(spark, sf_dir).where("not named").select("doc_id", "lang").distinct()


def document_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, confidence, label_state): one row for each document. The language with most code points; null for a text without sentences.

    confidence: its share of the code points times its mean confidence; label_state: right, wrong or missing.
    """
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang")
    size = F.col("end") - F.col("start")
    s = document_stretches(spark, sf_dir).groupBy("doc_id", "lang").agg(F.sum(size).alias("n"), F.sum(size * F.col("confidence")).alias("c"), F.first("named").alias("named"))
    top = s.groupBy("doc_id").agg(F.max(F.struct("n", "c", "lang", "named")).alias("t"), F.sum("n").alias("all"))
    top = top.select("doc_id", F.col("t.lang").alias("found"), (F.col("t.c") / F.col("all")).alias("confidence"), F.col("t.named").alias("named"))
    blank = F.coalesce(F.trim("lang"), F.lit("")).isin("", "und", "unknown", "xx", "n/a")
    state = F.when(F.col("found").isNull(), None).when(F.col("named"), "right").when(blank, "missing").otherwise("wrong")
    return docs.join(top, "doc_id", "left").select("doc_id", F.col("found").alias("lang"), "confidence", state.alias("label_state"))
