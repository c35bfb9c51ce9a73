"""Toxicity by classifier chains.

Categories are predicted one after the other, each by a logistic model over
the words of a text and the log-odds of the categories before it. The earlier
log-odds that a later model is fitted on are out-of-fold predictions, so it learns how
far to trust them. The labels have two columns; the chain is low quality,
toxic, and severe (both at once).

The fit takes the ``FIT_ROWS`` labelled rows of smallest hash at most, on the
driver; words enter a model by how far their rates differ between the classes.
Scoring covers every text whole, one pass without a shuffle.

Defined results: null and empty texts score by the models' bias alone; with no
labelled rows, or labels of one class only, a category has its smoothed base
rate; null labels are not fitted; repeated rows score alike; an empty table
gives an empty result; further columns stay with ``score`` if it is asked to
keep them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .store import small_batches

#: Most labelled rows that the fit takes.
FIT_ROWS = 6000
#: Words are hashed to so many features; a model uses the most telling of them.
FEATURES = 1 << 18
CHOSEN = 2000
FOLDS = 3
CHAIN = ("low_quality", "toxic", "severe")
THRESHOLD = 0.5


def _features(data: np.ndarray, offs: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs of a block: text numbers and features; only the ``wanted`` ones if given."""
    data, offs = kernel.core_only(data, offs)
    start, end, text = kernel.words(data, offs)
    feature = (kernel.word_hashes(data, start, end) >> np.uint64(46)).astype(np.int64)
    if wanted is not None:
        known = wanted[feature]
        text, feature = text[known], feature[known]
    pairs = np.unique(text * FEATURES + feature)
    return pairs // FEATURES, pairs % FEATURES


def _word_sets(batches):
    for batch in batches:
        sets = []
        data, offs = kernel.as_bytes(batch.column(3))
        for first, end, raw, at in kernel.blocks(data, offs):
            text, feature = _features(raw, at)
            bounds = np.searchsorted(text, np.arange(end - first + 1))
            sets += [feature[a:b].astype(np.int32).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(sets, pa.binary())], ["id", "quality", "toxic", "words"])


class Logistic:
    """Sparse logistic regression: weights of chosen features, of the earlier log-odds, and a bias."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, earlier: np.ndarray, bias: float):
        self.ids, self.weights, self.earlier, self.bias = ids, weights, earlier, bias

    @classmethod
    def fit(cls, rows: np.ndarray, feats: np.ndarray, y: np.ndarray, extra: np.ndarray, chosen: int = CHOSEN, steps: int = 150) -> Logistic:
        """``rows`` and ``feats`` are the pairs of row and feature that are present; ``extra`` has a column for each earlier category."""
        n, ones = len(y), float(y.sum())
        base = np.log((ones + 0.5) / (n - ones + 0.5)) if n else -4.0
        if n == 0 or ones in (0, n):
            return cls(np.zeros(0, np.int64), np.zeros(0), np.zeros(extra.shape[1]), float(base))
        in_one = np.bincount(feats, weights=y[rows], minlength=FEATURES)
        seen = np.bincount(feats, minlength=FEATURES)
        p, q, pool = in_one / ones, (seen - in_one) / (n - ones), seen / n
        z = np.abs(p - q) / np.sqrt(np.maximum(pool * (1 - pool), 1e-9) * (1 / ones + 1 / (n - ones)))
        z[seen < 3] = 0
        ids = np.sort(np.argsort(-z, kind="stable")[:chosen])
        ids = ids[z[ids] > 2.5]
        place = np.full(FEATURES, -1)
        place[ids] = np.arange(len(ids))
        inside = place[feats] >= 0
        r, f = rows[inside], place[feats[inside]]
        w, v, b = np.zeros(len(ids)), np.zeros(extra.shape[1]), float(base)
        moment = [np.zeros(len(ids)), np.zeros(extra.shape[1]), np.zeros(1)]
        square = [np.zeros(len(ids)), np.zeros(extra.shape[1]), np.zeros(1)]
        for t in range(1, steps + 1):
            logit = np.bincount(r, weights=w[f], minlength=n) + extra @ v + b
            g = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / n
            grads = [np.bincount(f, weights=g[r], minlength=len(ids)) + 1e-4 * w, extra.T @ g + 1e-4 * v, np.array([g.sum()])]
            new = []
            for k, (x, gr) in enumerate(zip((w, v, np.array([b])), grads, strict=True)):
                moment[k] = 0.9 * moment[k] + 0.1 * gr
                square[k] = 0.99 * square[k] + 0.01 * gr * gr
                new.append(x - 0.1 * (moment[k] / (1 - 0.9**t)) / (np.sqrt(square[k] / (1 - 0.99**t)) + 1e-8))
            w, v, b = new[0], new[1], float(new[2][0])
        return cls(ids, w, v, b)

    def logit(self, n: int, rows: np.ndarray, feats: np.ndarray, extra: np.ndarray) -> np.ndarray:
        table = np.zeros(FEATURES)
        table[self.ids] = self.weights
        return np.clip(np.bincount(rows, weights=table[feats], minlength=n) + extra @ self.earlier + self.bias, -30, 30)


def fit_chain(sets: list[np.ndarray], targets: dict[str, np.ndarray], folds: int = FOLDS) -> list[tuple[str, Logistic]]:
    """One model for each category, in order; earlier log-odds come from models that did not see the row."""
    n = len(sets)
    rows = np.repeat(np.arange(n), [len(s) for s in sets]) if n else np.zeros(0, np.int64)
    feats = np.concatenate(sets).astype(np.int64) if n else np.zeros(0, np.int64)
    fold = np.arange(n) % folds
    extra, chain = np.zeros((n, 0)), []
    for name, y in targets.items():
        y = y.astype(float)
        unseen = np.zeros(n)
        for k in range(folds):
            learn, held = fold != k, fold == k
            if not held.any():
                continue
            number = np.cumsum(learn) - 1
            model = Logistic.fit(number[rows[learn[rows]]], feats[learn[rows]], y[learn], extra[learn])
            unseen[held] = model.logit(n, rows, feats, extra)[held]
        chain.append((name, Logistic.fit(rows, feats, y, extra)))
        extra = np.column_stack([extra, unseen])
    return chain


def train(docs: DataFrame, labels: DataFrame, key="doc_id", text="text", fit_rows: int = FIT_ROWS) -> list[tuple[str, Logistic]]:
    """The chain fitted on ``fit_rows`` labelled rows at most, those whose id hashes lowest."""
    small_batches(docs.sparkSession)
    clean = labels.filter(F.col(key).isNotNull() & F.col("toxic").isNotNull() & F.col("quality").isNotNull())
    some = clean.select(F.col(key).alias("__id"), "quality", "toxic").orderBy(F.xxhash64("__id"), "__id", "toxic", "quality").limit(fit_rows)
    # Bounded by fit_rows, three numbers each.
    joined = docs.join(F.broadcast(some), F.col(key) == F.col("__id")).select(F.col("__id").cast("long").alias("id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # Ids may repeat in the documents; the bound holds for the joined rows too.
    seen = joined.mapInArrow(_word_sets, "id long, quality int, toxic int, words binary").orderBy(F.xxhash64("id"), "id", "words").limit(fit_rows).toArrow()
    quality, toxic = (np.array(seen.column(k).to_pylist(), dtype=int) for k in ("quality", "toxic"))
    sets = [np.frombuffer(x, np.int32) for x in seen.column("words").to_pylist()]
    targets = {"low_quality": 1 - quality, "toxic": toxic, "severe": (1 - quality) * toxic}
    return fit_chain(sets, {name: targets[name] for name in CHAIN})


def _scorer(chain: list[tuple[str, Logistic]]):
    wanted = np.zeros(FEATURES, bool)
    for _, model in chain:
        wanted[model.ids] = True
    known = np.flatnonzero(wanted)

    def run(batches):
        mask = np.zeros(FEATURES, bool)
        mask[known] = True
        for batch in batches:
            data, offs = kernel.as_bytes(batch.column(batch.num_columns - 1))
            parts = []
            for first, end, raw, at in kernel.blocks(data, offs):
                rows, feats = _features(raw, at, mask)
                n, extra = end - first, np.zeros((end - first, 0))
                for _, model in chain:
                    extra = np.column_stack([extra, model.logit(n, rows, feats, extra)])
                parts.append(1 / (1 + np.exp(-extra)))
            p = np.concatenate(parts) if parts else np.zeros((0, len(chain)))
            kept = [batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(p[:, k], pa.float64()) for k in range(len(chain)))], [*batch.schema.names[:-1], *(f"p_{name}" for name, _ in chain)])

    return run


def score(docs: DataFrame, chain: list[tuple[str, Logistic]], keep: tuple[str, ...] = ("doc_id",), text="text", threshold: float = THRESHOLD) -> DataFrame:
    """The ``keep`` columns, a probability p_<category> for each category and the verdict ``toxic``."""
    small_batches(docs.sparkSession)
    base = docs.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in base.schema.fields[:-1])
    scored = base.mapInArrow(_scorer(chain), fields + ", ".join(f"p_{name} double" for name, _ in chain))
    return scored.withColumn("toxic", F.col("p_toxic") >= threshold)


def without_toxic(docs: DataFrame, chain: list[tuple[str, Logistic]], text="text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with the columns of ``docs``."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    plain = docs.toDF(*names)
    scored = score(plain, chain, tuple(names), names[docs.columns.index(text)], threshold)
    return scored.filter(~F.col("toxic")).select(*names).toDF(*docs.columns)
