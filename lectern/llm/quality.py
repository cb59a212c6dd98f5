"""Quality classifier: a weak-label model trains a hashed linear scorer.

* Overlapping heuristic labellers vote good (1), bad (0) or abstain (2) on each document (``text_features``).
* Expectation-maximisation over the counts of all vote patterns (3 ** labellers at most, whatever the input's size)
  estimates each labeller's chance of a bad vote on good documents and on each of several kinds of bad ones. Kinds
  matter: labellers of one kind of junk agree with each other, so two classes alone can't explain their votes.
  Abstaining is no evidence. What is held before any votes are seen weighs ``PRIOR_ROWS`` documents and washes out.
* The posterior of each document's pattern is the soft label of a logistic scorer over hashed words and word shapes,
  fitted on about ``TRAIN_ROWS`` documents; the scorer, which sees none of the votes, then judges every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.batches import slices, texts
from lectern.llm.scratch import Scratch
from lectern.llm.text_features import DIMENSIONS, LABELLERS, describe

#: The scorer is fitted on about this many documents, drawn by a hash of their texts and ids.
TRAIN_ROWS = 8_000
#: Documents that the prior beliefs of the label model count for, each.
PRIOR_ROWS = 20.0
#: A slice is smaller than elsewhere: its features take several times its texts' bytes.
_SLICE = 1 << 20
_DRAWS = 1 << 30


class LabelModel(NamedTuple):
    """P(kind), where kind 0 is good, and each labeller's P(bad vote | it votes, kind) as [kind, labeller]."""

    kinds: np.ndarray
    bad: np.ndarray

    def joint(self, patterns: np.ndarray) -> np.ndarray:
        """P(kind | votes) as [kind, row]."""
        logs = np.log(self.bad) @ (patterns == 0).T + np.log1p(-self.bad) @ (patterns == 1).T + np.log(self.kinds)[:, None]
        odds = np.exp(logs - logs.max(0, initial=-np.inf, keepdims=True))
        return odds / odds.sum(0)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """P(good) of rows of votes."""
        return self.joint(patterns)[0]

    def accuracies(self) -> tuple[np.ndarray, np.ndarray]:
        """Each labeller's P(right vote | it votes) on good documents and on bad ones."""
        share = self.kinds[1:] / self.kinds[1:].sum()
        return 1 - self.bad[0], share @ self.bad[1:]


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 300, prior_rows: float = PRIOR_ROWS) -> LabelModel:
    """Maximum a posteriori expectation-maximisation, with a kind of bad documents for each labeller to begin with."""
    n = patterns.shape[1]
    bad = np.full((n + 1, n), 0.2)
    bad[0] = 0.01
    bad[np.arange(n) + 1, np.arange(n)] = 0.9
    prior = LabelModel(np.concatenate([[0.8], np.full(n, 0.2 / n)]), bad)
    model, said_bad, said_good = prior, (patterns == 0).astype(float), (patterns == 1).astype(float)
    for _ in range(rounds if counts.sum() else 0):
        weight = model.joint(patterns) * counts
        kinds = weight.sum(1) + prior_rows * prior.kinds
        yes, no = weight @ said_bad, weight @ said_good
        fitted = LabelModel(kinds / kinds.sum(), (yes + prior_rows * prior.bad) / (yes + no + prior_rows))
        done = np.abs(fitted.kinds - model.kinds).max() < 1e-7
        model = fitted
        if done:
            break
    return model


class Scorer(NamedTuple):
    weights: np.ndarray
    bias: float

    def score(self, rows: np.ndarray, indices: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        z = np.bincount(rows, self.weights[indices] * values, n) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_scorer(rows: np.ndarray, indices: np.ndarray, values: np.ndarray, soft: np.ndarray, rounds: int = 200) -> Scorer:
    """Logistic regression on soft labels by accelerated gradient steps, with a small ridge.

    Rows are in order; sums by row and by cell run over sorted copies.
    """
    n, w, v = len(soft), np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)
    share = float(soft.mean()) if n else 0.5
    b, vb = float(np.log((share + 1e-3) / (1 - share + 1e-3))), 0.0
    if not len(rows):
        return Scorer(w, b)
    by_row = np.flatnonzero(np.diff(rows, prepend=-1))
    order = np.argsort(indices, kind="stable")
    by_cell = np.flatnonzero(np.diff(indices[order], prepend=-1))
    cells, of_cell, at = indices[order][by_cell], rows[order], values[order]
    z = np.zeros(n)
    for _ in range(rounds):
        z[rows[by_row]] = np.add.reduceat((w + 0.9 * v)[indices] * values, by_row)
        error = 1 / (1 + np.exp(-np.clip(z + b + 0.9 * vb, -40, 40))) - soft
        gradient = 1e-5 * w
        gradient[cells] += np.add.reduceat(at * error[of_cell], by_cell) / n
        v, vb = 0.9 * v - 2.0 * gradient, 0.9 * vb - 2.0 * float(error.mean())
        w, b = w + v, b + vb
    return Scorer(w, b)


class QualityModel(NamedTuple):
    labels: LabelModel
    scorer: Scorer

    def judged(self, batch: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(quality, posterior, votes) of texts."""
        d = describe([t or b"" for t in batch])
        return self.scorer.score(*d[1:], len(batch)), self.labels.posterior(d.votes), d.votes


def _pattern(votes: np.ndarray) -> list[str]:
    return (votes + ord("0")).astype(np.uint8).view(f"S{len(LABELLERS)}").reshape(-1).astype(str).tolist()


_VOTED = "votes string, draw long, indices array<int>, weights array<float>"


def _vote(bound: int):
    """Votes of every row, and the features of those that are drawn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=_SLICE):
            own = [t or b"" for t in texts(batch)]
            draw = batch.column("draw").to_numpy()
            votes = describe(own, features=False).votes
            drawn = np.flatnonzero((draw & (_DRAWS - 1)) < bound)
            features: list[tuple] = [(None, None)] * len(own)
            d = describe([own[i] for i in drawn])
            cuts = np.searchsorted(d.rows, np.arange(len(drawn) + 1))
            for k, i in enumerate(drawn):
                features[i] = d.indices[cuts[k] : cuts[k + 1]].astype(np.int32), d.values[cuts[k] : cuts[k + 1]].astype(np.float32)
            yield pa.record_batch(
                {
                    "votes": pa.array(_pattern(votes), pa.string()),
                    "draw": batch.column("draw"),
                    "indices": pa.array([f[0] for f in features], pa.list_(pa.int32())),
                    "weights": pa.array([f[1] for f in features], pa.list_(pa.float32())),
                }
            )

    return run


def fit(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """The label model from all rows' vote patterns, the scorer from a bounded draw of rows."""
    own = documents.select(F.col(id_col).cast("long").alias("id"), _text(text_col).alias("text"))
    total = max(1, documents.count())
    bound = min(_DRAWS, max(1, TRAIN_ROWS * _DRAWS // total))
    scratch = Scratch(documents.sparkSession, "quality")
    voted = scratch.save(own.select("text", F.xxhash64("id", "text").alias("draw")).mapInArrow(_vote(bound), _VOTED))
    counted = voted.groupBy("votes").count().collect()  # 3 ** labellers at most
    votes = sorted((r["votes"], r["count"]) for r in counted)
    patterns = np.array([[int(v) for v in p] for p, _ in votes], np.int64).reshape(-1, len(LABELLERS))
    labels = fit_label_model(patterns, np.array([c for _, c in votes], np.float64))
    posterior = dict(zip([p for p, _ in votes], labels.posterior(patterns), strict=True))
    # Copies of one id and text are drawn together, so the draw is bounded here too; its order makes reruns agree.
    drawn = voted.filter(F.col("indices").isNotNull()).orderBy("draw", "votes").limit(2 * TRAIN_ROWS).toArrow().combine_chunks()
    scratch.drop(voted)
    lengths = pc.list_value_length(drawn["indices"]).to_numpy()
    flat = [drawn[c].combine_chunks().flatten().to_numpy() for c in ("indices", "weights")]
    soft = np.array([posterior[p] for p in drawn["votes"].to_pylist()])
    rows = np.repeat(np.arange(len(lengths)), lengths)
    return QualityModel(labels, fit_scorer(rows, flat[0].astype(np.int64), flat[1].astype(np.float64), soft))


def _text(text_col: str) -> Column:
    return F.col(text_col).cast("string")


def _score(model: QualityModel, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=_SLICE):
            quality, posterior, votes = model.judged(texts(batch))
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "quality": pa.array(quality, pa.float64()),
                    "posterior": pa.array(posterior, pa.float64()),
                    "votes": pa.array(_pattern(votes), pa.string()),
                    "keep": pa.array(quality >= threshold),
                }
            )

    return run


def classify(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per input row: doc_id, quality (the scorer's P(good)), posterior (the label model's), votes, keep.

    Null, empty and blank texts have no words: all labellers abstain, there are no features, and they are kept as long as
    most documents are good (the scorer's bias decides). Whole texts are read; rows with equal texts get equal verdicts;
    ids may be null; an empty table gives no rows; other columns of ``documents`` are ignored.
    """
    model = fit(documents, id_col, text_col)
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), _text(text_col).alias("text"))
    return rows.mapInArrow(_score(model, threshold), "doc_id long, quality double, posterior double, votes string, keep boolean")


def _passing(model: QualityModel, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=_SLICE):
            quality = model.judged(texts(batch))[0]
            yield batch.select(["row"]).filter(pa.array(quality >= threshold))

    return run


def _with_text(place: int, run):
    """The rows' text, a field of ``row``, as a column beside it, without a copy."""

    def widened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column("row"), pc.struct_field(b.column("row"), [place])], ["row", "text"])

    return lambda batches: run(widened(batches))


def keep_good(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The input's rows that the classifier keeps, with all their columns; each row is judged by its own text."""
    model, own = fit(documents, id_col, text_col), documents.columns
    rows = documents.withColumn(text_col, _text(text_col)).select(F.struct(*own).alias("row"))
    passing = _with_text(own.index(text_col), _passing(model, threshold))
    kept = rows.mapInArrow(passing, rows.schema).select(*[F.col("row")[c].alias(c) for c in own])
    return kept.withColumn(text_col, F.col(text_col).cast(documents.schema[text_col].dataType))
