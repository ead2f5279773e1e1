"""Quality by co-training a text view and a metadata view (operator 1).

The text view sees the shape of a text (repetition, symbols, case, lines); the metadata view sees the
language, the source, and the stated length, never the text. Both are fitted on labelled documents.
Then, in rounds, each view scores all unlabelled documents, labels those it is surest of and hands them to
the other, at most ``grow`` per round and only beyond ``confident``. After the rounds each view is
calibrated on folds it was not fitted on, and the views are joined by a logistic model of their two
calibrated log odds. Every document is scored; it is kept if its probability is at least ``limit``.

The labelled rows that models are fitted on are bounded: ``sample`` documents, those whose ids hash lowest.
Nothing else is sampled: candidates for a pseudo-label are all documents without a label. Their features are
written once, and each round reads them; what a round collects is ``grow`` rows for each model and view.

Defined results: null text is empty, null metadata is a value of its own; null ids are scored, not
fitted on; labels that are null or disagree are not used; of a labelled id with several rows the one with the
lowest features is used; without both labels every document has the smoothed prior; repeated rows are scored
each; texts of any length are read whole; an empty table gives no rows; other columns, whatever their names,
come through unchanged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkmill.llm.linear import Rows, calibration, fit, folds, log_odds, predict, sigmoid
from linkmill.llm.pretoken import MULTIPLIER, mixed
from linkmill.llm.runtime import drop_staged, staged, text_buffer, text_chunks
from linkmill.llm.text_features import SHAPES, shapes

SAMPLE, ROUNDS, GROW, CONFIDENT, LIMIT = 12_000, 3, 500, 0.95, 0.5
#: Hashed values of the metadata columns.
META_WIDTH = 1 << 10
#: Steps of the quantile code of each shape.
BINS = 12


class TextView:
    """Shapes, coded by their quantiles in the sample (one column per bin)."""

    def __init__(self, sample: np.ndarray):
        q = np.linspace(0, 1, BINS + 1)[1:-1]
        self.edges = [np.unique(np.quantile(sample[:, k], q)) if len(sample) else np.zeros(0) for k in range(len(SHAPES))]
        # Equal steps of the range beside the quantiles: rare shapes lie beyond the last quantile.
        for k in range(len(SHAPES)):
            if len(sample):
                low, high = sample[:, k].min(), sample[:, k].max()
                self.edges[k] = np.unique(np.concatenate([self.edges[k], low + (high - low) * q]))
        self.place = np.append(0, np.cumsum([len(e) + 1 for e in self.edges]))

    def rows(self, x: np.ndarray) -> Rows:
        n, k = x.shape
        columns = np.stack([self.place[j] + np.searchsorted(self.edges[j], x[:, j], side="right") for j in range(k)], axis=1)
        return Rows(np.arange(n + 1) * k, columns.reshape(-1).astype(np.int32), np.ones(n * k), int(self.place[-1]))


def meta_rows(values: list[pa.Array], n_chars: np.ndarray) -> Rows:
    """Hashed (column, value) pairs, null a value of its own, and the stated length's power of two."""
    import zlib

    codes = []
    for k, column in enumerate(values):
        coded = column.dictionary_encode() if not pa.types.is_dictionary(column.type) else column
        names = [zlib.crc32(f"{k}={v}".encode()) % META_WIDTH for v in coded.dictionary.to_pylist()] + [zlib.crc32(f"{k}".encode()) % META_WIDTH]
        at = np.asarray(pc.fill_null(coded.indices, len(names) - 1))
        codes.append(np.array(names)[at])
    length = np.floor(2 * np.log2(np.maximum(np.nan_to_num(n_chars, nan=0.0), 0) + 1)).astype(np.int64)
    codes.append(META_WIDTH + np.clip(np.where(np.isnan(n_chars), 0, length + 1), 0, 127))
    columns = np.stack(codes, axis=1)
    return Rows(np.arange(len(columns) + 1) * len(codes), columns.reshape(-1).astype(np.int32), np.ones(columns.size), META_WIDTH + 128)


def coded_rows(codes: np.ndarray) -> Rows:
    """Rows from the columns of meta_rows()."""
    return Rows(np.arange(len(codes) + 1) * codes.shape[1], codes.reshape(-1), np.ones(codes.size), META_WIDTH + 128)


class Plan:
    """What a round asks of every unlabelled document: weights by model and view, the ids that a view has been
    given already, and how many it may be given of either label."""

    def __init__(self, text: TextView, thetas: list[list[np.ndarray]], given: list[list[np.ndarray]], most: tuple[int, int], confident: float):
        self.text, self.thetas, self.given, self.most, self.confident = text, thetas, given, most, confident

    def candidates(self, ids: np.ndarray, shape: np.ndarray, codes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(slot, rows, confidences), the surest first: a slot is a model, the view that judges and the label."""
        views = [self.text.rows(shape), coded_rows(codes)]
        turn = tie(ids)
        for m, both in enumerate(self.thetas):
            for v, theta in enumerate(both):
                p = np.round(sigmoid(predict(views[v], theta)), 9)
                open_ = ~np.isin(ids, self.given[m][1 - v])
                for value, sure in ((0, 1 - p), (1, p)):
                    rows = np.flatnonzero(open_ & (sure >= self.confident))
                    rows = rows[np.lexsort((ids[rows], turn[rows], -sure[rows]))][: self.most[value]]
                    if len(rows):
                        yield (2 * m + v) * 2 + value, rows, sure[rows]


def tie(ids: np.ndarray) -> np.ndarray:
    """The order of ids of which a view is equally sure."""
    return mixed(ids.astype(np.int64).view(np.uint64) * MULTIPLIER).view(np.int64)


#: From a plan, for each slot: ids, shapes and codes of the documents that it hands over, the surest first.
Nominate = Callable[[Plan], dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]


class CoTrained:
    """Two views, their calibrations and how they are joined."""

    def __init__(self, ids: np.ndarray, shape: np.ndarray, codes: np.ndarray, y: np.ndarray, nominate: Nominate, rounds: int = ROUNDS, grow: int = GROW, confident: float = CONFIDENT):
        """y: 1 or 0."""
        self.text = TextView(shape)
        self.prior = float(log_odds(np.array([((y == 1).sum() + 1) / (len(y) + 2)]))[0])
        self.plain = not 0 < (y == 1).sum() < len(y)
        if self.plain:
            return
        fold = folds(ids, 3)
        # One model on all labels, and for calibration one without each fold's labels, all in the same rounds.
        parts = [np.arange(len(y))] + [np.flatnonzero(fold != f) for f in range(3) if (fold == f).any() and 0 < y[fold != f].sum() < (fold != f).sum()]
        left = [None] + [f for f in range(3) if (fold == f).any() and 0 < y[fold != f].sum() < (fold != f).sum()]
        thetas = self._train(shape, codes, y, parts, nominate, rounds, grow, confident)
        scores, views = np.zeros((len(y), 2)), [self.text.rows(shape), coded_rows(codes)]
        for m, f in enumerate(left):
            if f is not None:
                own = np.flatnonzero(fold == f)
                for v in (0, 1):
                    scores[own, v] = predict(views[v].take(own), thetas[m][v])
        self.thetas = thetas[0]
        self.scales = [calibration(scores[:, v], y.astype(float)) for v in (0, 1)]
        both = np.stack([a * scores[:, v] + b for v, (a, b) in enumerate(self.scales)], axis=1) - self.prior
        self.join = fit(Rows(np.arange(len(y) + 1) * 2, np.tile(np.arange(2, dtype=np.int32), len(y)), both.reshape(-1), 2), y.astype(float), penalty=0.1, steps=200)

    def _train(self, shape, codes, y, parts: list[np.ndarray], nominate: Nominate, rounds: int, grow: int, confident: float) -> list[list[np.ndarray]]:
        none = (np.zeros(0, np.int64), np.zeros((0, shape.shape[1])), np.zeros((0, codes.shape[1]), np.int32), np.zeros(0))
        more = [[none, none] for _ in parts]  # by model and view: ids, shapes, codes and labels that the other view gave
        positive = int(round(grow * y.mean()))
        for turn in range(rounds + 1):
            thetas = []
            for m, rows in enumerate(parts):
                both = []
                for v in (0, 1):
                    _, s, c, label = more[m][v]
                    x = self.text.rows(np.concatenate([shape[rows], s])) if v == 0 else coded_rows(np.concatenate([codes[rows], c]))
                    both.append(fit(x, np.concatenate([y[rows].astype(float), label]), penalty=1.0, steps=60))
                thetas.append(both)
            if turn == rounds:
                return thetas
            plan = Plan(self.text, thetas, [[more[m][v][0] for v in (0, 1)] for m in range(len(parts))], (grow - positive, positive), confident)
            for slot, (i, s, c) in sorted(nominate(plan).items()):
                m, v, value = slot // 4, slot // 2 % 2, slot % 2
                more[m][1 - v] = tuple(np.concatenate(pair) for pair in zip(more[m][1 - v], (i, s, c, np.full(len(i), float(value))), strict=True))
        return thetas

    def probabilities(self, shape: np.ndarray, meta: Rows) -> np.ndarray:
        """Of the text view, the metadata view and both: (rows, 3)."""
        if self.plain:
            return np.full((len(shape), 3), sigmoid(np.array(self.prior)))
        odds = [a * predict(x, theta) + b for x, theta, (a, b) in zip((self.text.rows(shape), meta), self.thetas, self.scales, strict=True)]
        joined = (np.stack(odds, axis=1) - self.prior) @ self.join[:2] + self.join[2]
        return sigmoid(np.stack([*odds, joined], axis=1))


def _features(chunk: pa.RecordBatch, meta: list[str]) -> tuple[np.ndarray, Rows]:
    stated = np.asarray(pc.fill_null(chunk["n_chars"].cast(pa.float64()), float("nan")))
    return shapes(*text_buffer(chunk["text"])), meta_rows([chunk[f"meta{k}"] for k in range(len(meta))], stated)


def _featured(batches: Iterator[pa.RecordBatch], meta: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in text_chunks(batch):
            shape, rows = _features(chunk, meta)
            columns = rows.columns.reshape(len(shape), len(meta) + 1)
            yield pa.RecordBatch.from_arrays([chunk["doc_id"], pa.array(list(shape), pa.list_(pa.float64())), pa.array(list(columns), pa.list_(pa.int32()))], names=["id", "shape", "meta"])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), width)


def _nominated(batches: Iterator[pa.RecordBatch], plan: Plan, meta: list[str]) -> Iterator[pa.RecordBatch]:
    """The surest rows of this worker in each slot."""
    best: dict[int, tuple[np.ndarray, ...]] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, shape, codes = np.asarray(batch["id"]), _matrix(batch["shape"], len(SHAPES)), _matrix(batch["meta"], len(meta) + 1)
        for slot, rows, sure in plan.candidates(ids, shape, codes):
            found = (sure, ids[rows], shape[rows], codes[rows])
            if slot in best:
                found = tuple(np.concatenate(pair) for pair in zip(best[slot], found, strict=True))
            order = np.lexsort((found[1], tie(found[1]), -found[0]))[: plan.most[slot % 2]]
            best[slot] = tuple(x[order] for x in found)
    for slot, (sure, ids, shape, codes) in best.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(ids), slot, np.int32)), pa.array(sure), pa.array(tie(ids)), pa.array(ids), pa.array(list(shape), pa.list_(pa.float64())), pa.array(list(codes), pa.list_(pa.int32()))],
            names=["slot", "sure", "turn", "id", "shape", "meta"],
        )


def nominator(pool: DataFrame, meta: list[str], grow: int) -> Nominate:
    """The choice of a round among all rows of ``pool`` (id, shape, meta)."""

    def nominate(plan: Plan) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        sent = pool.sparkSession.sparkContext.broadcast(plan)
        rows = pool.mapInArrow(lambda b: _nominated(b, sent.value, meta), "slot int, sure double, turn long, id long, shape array<double>, meta array<int>")
        # The best of each worker, then of each 32nd of the ids, then of all: no task holds more than a few of these.
        by = (F.col("sure").desc(), "turn", "id", "shape")
        rows = rows.withColumn("part", F.pmod("turn", F.lit(32)))
        for keys in (("slot", "part"), ("slot",)):
            rows = rows.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where(F.col("k") <= grow).drop("k")
        found = rows.toPandas().sort_values(["slot", "sure", "turn", "id"], ascending=[True, False, True, True], kind="stable")
        sent.unpersist()
        out = {}
        for slot, group in found.groupby("slot"):
            group = group.iloc[: plan.most[slot % 2]]
            out[int(slot)] = (group["id"].to_numpy(np.int64), np.stack(group["shape"].to_list()), np.stack(group["meta"].to_list()).astype(np.int32))
        return out

    return nominate


def _scored(batches: Iterator[pa.RecordBatch], model: CoTrained, meta: list[str], limit: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in text_chunks(batch):
            p = np.round(model.probabilities(*_features(chunk, meta)), 6)
            yield pa.RecordBatch.from_arrays([chunk["row"], *(pa.array(p[:, k]) for k in range(3)), pa.array(p[:, 2] >= limit)], names=["row", "p_text", "p_meta", "p_quality", "kept"])


def _prepared(docs: DataFrame, id_col: str, text_col: str, length_col: str, meta: list[str]) -> DataFrame:
    return docs.select(
        F.struct(*docs.columns).alias("row"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        F.col(length_col).cast("double").alias("n_chars"),
        *(F.col(c).cast("string").alias(f"meta{k}") for k, c in enumerate(meta)),
    )


def fit_views(rows: DataFrame, labels: DataFrame, meta: list[str], sample: int, grow: int = GROW) -> CoTrained:
    told = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("least"), F.max("quality").alias("most"))
    told = told.select("doc_id", F.when((F.col("least") == F.col("most")) & F.col("least").isin(0, 1), F.col("least").cast("int")).alias("known"), F.lit(True).alias("told"))
    features = rows.where("doc_id is not null").drop("row").mapInArrow(lambda batches: _featured(batches, meta), "id long, shape array<double>, meta array<int>")
    features = staged(features.join(told, features["id"] == told["doc_id"], "left").select("id", "shape", "meta", "known", "told"), "features")
    # At most ``sample`` ids: small enough to broadcast, and their features to collect.
    some = told.where("known is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("id"))
    taken = features.where("known is not null").join(F.broadcast(some), "id").groupBy("id").agg(F.min(F.struct("shape", "meta", "known")).alias("row"))
    taken = taken.select("id", "row.*").orderBy("id").toArrow().combine_chunks()
    ids, y = np.asarray(taken["id"]), np.asarray(taken["known"]).astype(np.int64)
    shape = np.array(taken["shape"].to_pylist(), dtype=float).reshape(len(ids), len(SHAPES))
    codes = np.array(taken["meta"].to_pylist(), dtype=np.int32).reshape(len(ids), len(meta) + 1)
    model = CoTrained(ids, shape, codes, y, nominator(features.where("told is null").select("id", "shape", "meta"), meta, grow), grow=grow)
    drop_staged(features)
    return model


def classified(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", meta: tuple[str, ...] = ("lang", "source"), sample: int = SAMPLE, grow: int = GROW, limit: float = LIMIT) -> DataFrame:
    """row (a struct of the columns of ``docs``), p_text, p_meta, p_quality and kept. labels: doc_id, quality."""
    rows, meta = _prepared(docs, id_col, text_col, length_col, list(meta)), list(meta)
    model = fit_views(rows, labels, meta, sample, grow)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema["row"].dataType.simpleString()
    scored = rows.drop("doc_id")
    return scored.mapInArrow(lambda batches: _scored(batches, sent.value, meta, limit), f"row {kind}, p_text double, p_meta double, p_quality double, kept boolean")


def digests(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("row.doc_id").alias("doc_id"), "p_text", "p_meta", "p_quality", "kept")
