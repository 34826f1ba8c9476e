"""Reading level of documents.

The base is the familiar-word formula: the share of words outside a list of
words that stand in many documents of the corpus, and the length of sentences.
The formula alone can't tell children's texts full of rare long words from
theory in short common ones, so it is one part of the evidence here: each
sentence of a level emits its length, its share of unfamiliar words, and its
words. A document of a level is a mixture of sentences, mostly of that level.
The model is fitted by expectation-maximisation on a bounded sample of the
labelled documents, together with how often each rater errs.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.session import ship

LEVELS = 4
#: A word is familiar if it stands in this share of the documents. At most (mean distinct words of a document) / FAMILIAR_SHARE words are.
FAMILIAR_SHARE = 0.002
#: Bounds of the labelled sample: documents, taken in the order of a hash of their id, and characters of them together.
MOST_LABELLED, MOST_LABELLED_CHARS = 20_000, 40_000_000
#: Rounds of expectation-maximisation.
ROUNDS = 8
#: Weights of the formula, of the familiar-word kind: per cent of unfamiliar words, words per sentence.
UNFAMILIAR_WEIGHT, LENGTH_WEIGHT = 0.1579, 0.0496

_SENTENCE = re.compile(r"[.!?;。！？]+|\n\s*\n")
WORD_PATTERN = r"\p{L}+"  # the same here and on the JVM
_WORD = regex.compile(WORD_PATTERN)


def familiar_words(documents: DataFrame, share: float = FAMILIAR_SHARE) -> list[str]:
    """The words that stand in at least ``share`` of the documents with text; counted over all documents."""
    texts = documents.where(F.length(F.trim("text")) > 0)
    n = texts.count()
    words = texts.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORD_PATTERN), F.lit(0)))).alias("w"))
    return sorted(r.w for r in words.groupBy("w").count().where(F.col("count") >= max(1.0, share * n)).select("w").collect())


def sentences(text: str) -> list[list[str]]:
    parts = [_WORD.findall(s) for s in _SENTENCE.split(text.lower())]
    return [p for p in parts if p]


def formula(parts: list[list[str]], familiar: frozenset[str]) -> tuple[float, float, float]:
    """Share of unfamiliar words, mean sentence length, and their weighted sum."""
    n = sum(map(len, parts))
    if not n:
        return 0.0, 0.0, 0.0
    unfamiliar = sum(w not in familiar for p in parts for w in p) / n
    length = n / len(parts)
    return unfamiliar, length, UNFAMILIAR_WEIGHT * 100 * unfamiliar + LENGTH_WEIGHT * length


def _bins(words: list[str], familiar: frozenset[str]) -> tuple[int, int]:
    n = len(words)
    return min(7, int(np.log2(n) * 1.5)), min(5, int(6 * sum(w not in familiar for w in words) / n))


class LevelModel:
    """``level -> sentence levels -> words, length bin, unfamiliar bin``; fitted by :meth:`fit`, or falling back to cut points of the formula."""

    #: Cut points of the formula between the levels, for a corpus without a single label.
    CUTS = (2.0, 4.0, 7.0)

    def __init__(self, familiar: list[str]) -> None:
        self.familiar = frozenset(familiar)
        self.words: dict[str, int] = {}
        self.fitted = False

    def fit(self, texts: list[str], ratings: list[list[tuple[str, int]]], rounds: int = ROUNDS) -> LevelModel:
        docs = [sentences(t) for t in texts]
        keep = [i for i, d in enumerate(docs) if d and ratings[i]]
        if not keep:
            return self
        docs, ratings = [docs[i] for i in keep], [ratings[i] for i in keep]
        seen: dict[str, int] = defaultdict(int)
        for d in docs:
            for w in {w for s in d for w in s}:
                seen[w] += 1
        self.words = {w: i for i, w in enumerate(sorted(w for w, n in seen.items() if n > 1))}
        raters = {r: i for i, r in enumerate(sorted({r for x in ratings for r, _ in x}))}
        owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        rows, cols, length, strange = [], [], [], []
        k = 0
        for d in docs:
            for s in d:
                ids = [self.words[w] for w in s if w in self.words]
                rows += [k] * len(ids)
                cols += ids
                a, b = _bins(s, self.familiar)
                length.append(a)
                strange.append(b)
                k += 1
        rows, cols = np.array(rows, dtype=np.int64), np.array(cols, dtype=np.int64)
        length, strange = np.array(length), np.array(strange)
        # raters first err by one level in a tenth of the cases, to either side
        err = np.full((LEVELS, LEVELS), 0.004)
        for i in range(LEVELS):
            err[i, max(0, i - 1)] = err[i, min(LEVELS - 1, i + 1)] = 0.05
            err[i, i] = 0.9
        err /= err.sum(1, keepdims=True)
        confusion = np.repeat(err[None], len(raters), 0)
        self.mix = np.full((LEVELS, LEVELS), 0.02)
        for i in range(LEVELS):
            self.mix[i, max(0, i - 1)] = self.mix[i, min(LEVELS - 1, i + 1)] = 0.12
            self.mix[i, i] = 0.75
        self.mix /= self.mix.sum(1, keepdims=True)
        said = np.zeros((len(docs), LEVELS))
        for i, x in enumerate(ratings):
            for r, l in x:
                said[i] += np.log(confusion[raters[r]][:, l - 1])
        doc = np.exp(said - said.max(1, keepdims=True))
        doc /= doc.sum(1, keepdims=True)
        part = doc[owner]
        for _ in range(rounds):
            # words etc. given the levels of sentences
            counts = np.full((LEVELS, len(self.words)), 0.05)
            for l in range(LEVELS):
                np.add.at(counts[l], cols, part[rows, l])
            self.word = np.log(counts / counts.sum(1, keepdims=True))
            self.length = self._bin(length, part, 8)
            self.strange = self._bin(strange, part, 6)
            self.prior = np.log((doc.sum(0) + 1) / (len(doc) + LEVELS))
            like = np.zeros((len(owner), LEVELS))
            for l in range(LEVELS):
                np.add.at(like[:, l], rows, self.word[l][cols])
            like += self.length[:, length].T + self.strange[:, strange].T
            like -= like.max(1, keepdims=True)
            like = np.exp(like)
            each = np.log(like @ self.mix.T + 1e-12)  # sentence given the level of its document
            total = np.zeros((len(docs), LEVELS))
            np.add.at(total, owner, each)
            said = np.zeros((len(docs), LEVELS))
            for i, x in enumerate(ratings):
                for r, l in x:
                    said[i] += np.log(confusion[raters[r]][:, l - 1])
            doc = total + said + self.prior
            doc = np.exp(doc - doc.max(1, keepdims=True))
            doc /= doc.sum(1, keepdims=True)
            pair = doc[owner][:, :, None] * self.mix[None] * like[:, None, :]
            pair /= pair.sum((1, 2), keepdims=True)
            part = pair.sum(1)
            self.mix = pair.sum(0) + 1.0 + 9.0 * np.eye(LEVELS)
            self.mix /= self.mix.sum(1, keepdims=True)
            confusion = np.repeat(20 * err[None], len(raters), 0)
            for i, x in enumerate(ratings):
                for r, l in x:
                    confusion[raters[r]][:, l - 1] += doc[i]
            confusion /= confusion.sum(2, keepdims=True)
        self.fitted = True
        return self

    @staticmethod
    def _bin(values: np.ndarray, part: np.ndarray, n: int) -> np.ndarray:
        counts = np.full((LEVELS, n), 0.5)
        for l in range(LEVELS):
            np.add.at(counts[l], values, part[:, l])
        return np.log(counts / counts.sum(1, keepdims=True))

    def level(self, parts: list[list[str]]) -> int:
        if not self.fitted:
            return 1 + sum(formula(parts, self.familiar)[2] > c for c in self.CUTS)
        total = self.prior.copy()
        for s in parts:
            ids = [self.words[w] for w in s if w in self.words]
            a, b = _bins(s, self.familiar)
            like = self.word[:, ids].sum(1) + self.length[:, a] + self.strange[:, b]
            total += np.log(self.mix @ np.exp(like - like.max()) + 1e-12)
        return 1 + int(total.argmax())


def labelled_sample(documents: DataFrame, labels: DataFrame) -> tuple[list[str], list[list[tuple[str, int]]]]:
    """Texts and ratings of at most ``MOST_LABELLED`` labelled documents with at most ``MOST_LABELLED_CHARS`` characters together."""
    rated = labels.where(F.col("reading_level").between(1, LEVELS)).select("doc_id", F.coalesce("rater", F.lit("")).alias("rater"), "reading_level").distinct()
    rated = rated.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("rater", "reading_level"))).alias("said"))  # a few raters a document
    rows = documents.where(F.length(F.trim("text")) > 0).select("doc_id", "text").join(rated, "doc_id")
    rows = rows.withColumn("n", F.length("text")).orderBy(F.xxhash64("doc_id"), "doc_id").select("text", "said", "n").limit(MOST_LABELLED)
    texts, ratings, size = [], [], 0
    for r in rows.toLocalIterator():
        size += r.n
        if size > MOST_LABELLED_CHARS:
            break
        texts.append(r.text)
        ratings.append([(x.rater, x.reading_level) for x in r.said])
    return texts, ratings


def _rate(model_box, kind: str):
    def run(batches):
        model = model_box.value
        known: dict[str, int] = {}
        for batch in batches:
            texts = batch.column(1).to_pylist()
            if kind == "level":
                out = []
                for t in texts:
                    v = known.get(t) if len(t) < 2000 else None
                    if v is None:
                        v = model.level(sentences(t))
                        if len(known) > 20_000:
                            known.clear()
                        if len(t) < 2000:
                            known[t] = v
                    out.append(v)
                made = [pa.array(out, pa.int32())]
                names = ["k", "reading_level"]
            else:
                vals = [formula(sentences(t), model.familiar) for t in texts]
                made = [pa.array([v[i] for v in vals], pa.float64()) for i in range(3)]
                names = ["k", "unfamiliar_share", "mean_sentence", "score"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names)

    return run


def _with_text(documents: DataFrame) -> DataFrame:
    return documents.where(F.regexp_replace("text", r"(?U)\s+", "") != "").select(F.col("doc_id").alias("k"), F.col("text"))


def reading_levels(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, reading_level`` (1 to 4) of each document whose text is not null, empty or blank.

    Repeated rows stay, a null id too; texts count whole. A text without a
    letter gets the most common level. Labels that are null or beyond the
    scale, repeated ones, and those of unknown documents do no harm; without
    any, the level comes from fixed cut points of the formula.
    """
    spark = documents.sparkSession
    ship(spark)
    model = LevelModel(familiar_words(documents)).fit(*labelled_sample(documents, labels))
    kind = documents.schema["doc_id"].dataType.simpleString()
    rated = _with_text(documents).mapInArrow(_rate(spark.sparkContext.broadcast(model), "level"), f"k {kind}, reading_level int")
    return rated.select(F.col("k").alias("doc_id"), "reading_level")


def profile(documents: DataFrame) -> DataFrame:
    """``doc_id, unfamiliar_share, mean_sentence, score`` by the formula alone, for the same documents."""
    spark = documents.sparkSession
    ship(spark)
    model = LevelModel(familiar_words(documents))
    kind = documents.schema["doc_id"].dataType.simpleString()
    made = _with_text(documents).mapInArrow(_rate(spark.sparkContext.broadcast(model), "formula"), f"k {kind}, unfamiliar_share double, mean_sentence double, score double")
    return made.withColumnRenamed("k", "doc_id")
