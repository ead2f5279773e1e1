"""Toxicity by a classifier chain of linear models over hashed words (operator 8).

The chain has one binary category per link. The model of a link sees the words of a text and the
probabilities of all earlier links. For training these are out-of-fold predictions: each fold's are
made by models that have not seen it. For scoring they are the predictions of the models refitted on
the whole sample. Word features are weighted by the log ratio of their frequencies in the category's
positive and negative documents, so that words of no weight cannot add up.

The models are fitted on a bounded sample: of the labelled documents whose ids hash lowest, at most
``sample`` for each combination of labels. Every document of the table is scored by its whole text.

Defined results: null or empty text has no words and gets the constants' probabilities; with no
labelled document, or without both values of a category, that category has its smoothed prior for all;
null ids are scored and never used for fitting, nor are labels that are null or disagree; repeated
rows are scored each; an empty table gives no rows; other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkmill.llm.linear import Rows, calibration, fit, folds, log_odds, predict, sigmoid
from linkmill.llm.runtime import blobs, text_buffer, text_chunks
from linkmill.llm.text_features import word_sets

WIDTH, SAMPLE, FOLDS, LIMIT = 1 << 18, 6000, 3, 0.5
#: The chain: name and condition over the table of labels.
CATEGORIES = (("low_quality", "quality = 0"), ("toxic", "toxic = 1"))


class Link:
    """One category's model: the words' weights, those of the earlier links, a constant."""

    def __init__(self, x: Rows, earlier: np.ndarray, y: np.ndarray):
        yes, no = (np.bincount(x.columns, weights=(y == v)[x.row], minlength=x.width) for v in (1, 0))
        self.ratio = np.log((yes + 0.5) / (y.sum() + 1)) - np.log((no + 0.5) / ((1 - y).sum() + 1))
        self.ratio[(yes + no) < 3] = 0.0  # a word of one or two documents says little
        self.width = x.width
        self.theta = fit(self._rows(x, earlier), y, penalty=1.0)

    def _rows(self, x: Rows, earlier: np.ndarray) -> Rows:
        return Rows(x.bounds, x.columns, self.ratio[x.columns], x.width).with_dense(earlier - 0.5)

    def scores(self, x: Rows, earlier: np.ndarray) -> np.ndarray:
        return predict(self._rows(x, earlier), self.theta)

    def packed(self, a: float, b: float) -> tuple[np.ndarray, np.ndarray, float]:
        """Weights of words and of earlier links and the constant, with the calibration worked in."""
        words = (self.theta[: self.width] * self.ratio * a).astype(np.float32)
        late = self.theta[self.width : -1]
        return words, late * a, float(a * (self.theta[-1] - late.sum() / 2) + b)


class Chain:
    """links: (words' weights, weights of earlier probabilities, constant) in the chain's order."""

    def __init__(self, links: list[tuple[np.ndarray, np.ndarray, float]], width: int):
        self.links, self.width = links, width

    @classmethod
    def fitted(cls, x: Rows, ids: np.ndarray, labels: np.ndarray, parts: int = FOLDS) -> Chain:
        """labels: (rows, categories) of 0 and 1."""
        fold, earlier, links = folds(ids, parts), np.zeros((len(x), 0)), []
        for k in range(labels.shape[1]):
            y = labels[:, k].astype(float)
            out = np.full(len(x), log_odds(np.array([(y.sum() + 1) / (len(y) + 2)]))[0])
            if 0 < y.sum() < len(y):
                good = True
                for f in range(parts):
                    rest, own = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
                    if not len(own) or not 0 < y[rest].sum() < len(rest):
                        good = False
                        continue
                    out[own] = Link(x.take(rest), earlier[rest], y[rest]).scores(x.take(own), earlier[own])
                a, b = calibration(out, y) if good else (1.0, 0.0)
                out = a * out + b
                links.append(Link(x, earlier, y).packed(a, b))
            else:
                links.append((np.zeros(x.width, np.float32), np.zeros(k), float(out[0]) if len(out) else 0.0))
            earlier = np.column_stack([earlier, sigmoid(out)])
        return cls(links, x.width)

    def probabilities(self, x: Rows) -> np.ndarray:
        out = np.zeros((len(x), 0))
        for words, late, constant in self.links:
            out = np.column_stack([out, sigmoid(x.dot(words) + out @ late + constant)])
        return out


def _hashed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in text_chunks(batch):
            x = word_sets(*text_buffer(chunk["text"]), width)
            yield pa.RecordBatch.from_arrays([chunk["doc_id"], chunk["known"], blobs(x.columns.view(np.uint8), x.bounds * 4)], names=["doc_id", "known", "words"])


def _scored(batches: Iterator[pa.RecordBatch], chain: Chain, names: list[str], limit: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in text_chunks(batch):
            p = np.round(chain.probabilities(word_sets(*text_buffer(chunk["text"]), chain.width)), 6)
            columns = [chunk["doc_id"], *(pa.array(p[:, k]) for k in range(len(names))), *(pa.array(p[:, k] >= limit) for k in range(len(names)))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *(f"p_{n}" for n in names), *(f"is_{n}" for n in names)])


def fit_chain(docs: DataFrame, labels: DataFrame, *, categories=CATEGORIES, sample: int = SAMPLE, width: int = WIDTH) -> Chain:
    """docs: doc_id, text. labels: doc_id and what the conditions of the categories name."""
    flags = F.array(*(F.expr(f"cast({condition} as int)") for _, condition in categories))
    known = labels.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), flags.alias("known"))
    known = known.groupBy("doc_id").agg(F.min("known").alias("known"), F.max("known").alias("most")).where("known = most and not exists(known, x -> x is null)").drop("most")
    # The rows whose ids hash lowest. What cannot be among them by the share that is needed goes first, so that
    # the window of a combination of labels holds little more than the sample, however many rows there are.
    unit = F.xxhash64("doc_id") / F.lit(2.0**64) + F.lit(0.5)
    times = known.groupBy(F.col("known").alias("kind")).agg(F.count(F.lit(1)).alias("times"))
    known = known.join(F.broadcast(times), F.col("known") == F.col("kind")).where(unit * F.col("times") <= 1.2 * sample + 1000).select("doc_id", "known")
    order = Window.partitionBy("known").orderBy(F.xxhash64("doc_id"), "doc_id")
    known = known.withColumn("k", F.row_number().over(order)).where(F.col("k") <= sample).drop("k")
    # At most sample rows for each combination of labels: small enough to broadcast and to collect.
    # Of several texts of an id the one whose hash is lowest.
    rows = docs.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text", "known")).alias("row")).select("doc_id", "row.text", "row.known")
    rows = rows.mapInArrow(lambda batches: _hashed(batches, width), "doc_id long, known array<int>, words binary").toArrow()
    order = np.argsort(np.asarray(rows["doc_id"]), kind="stable")
    rows = rows.take(pa.array(order))
    words = [np.frombuffer(w.as_buffer(), np.int32) for w in rows["words"]]
    x = Rows(np.append(0, np.cumsum([len(w) for w in words])).astype(np.int64), np.concatenate([np.zeros(0, np.int32), *words]), np.ones(sum(map(len, words))), width)
    flags = np.array(rows["known"].to_pylist(), dtype=np.int64).reshape(len(words), len(categories))
    return Chain.fitted(x, np.asarray(rows["doc_id"]), flags)


def toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", categories=CATEGORIES, sample: int = SAMPLE, width: int = WIDTH, limit: float = LIMIT) -> DataFrame:
    """doc_id, and for each category its probability p_<name> and the verdict is_<name>."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    chain = fit_chain(rows, labels, categories=categories, sample=sample, width=width)
    names = [n for n, _ in categories]
    sent = docs.sparkSession.sparkContext.broadcast(chain)
    schema = ", ".join(["doc_id long", *(f"p_{n} double" for n in names), *(f"is_{n} boolean" for n in names)])
    return rows.mapInArrow(lambda batches: _scored(batches, sent.value, names, limit), schema)
