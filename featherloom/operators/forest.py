"""Random forests of classes whose trees are grown in tasks, each over all training rows in bins.

MLlib keeps a count for each row and tree and reads them all at each level. Here a row is a byte a feature (bin and class), the rows go to all tasks as one broadcast, and a task grows whole trees without a shuffle. Sizes, bins, gain and
probabilities are MLlib's; the bootstrap draws as many rows as there are. Tables beyond MOST_BYTES don't fit a task and are left to MLlib.
"""

from __future__ import annotations

import threading

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_BYTES = 96 << 20
#: Rows that are looked at together, so that what is made of them stays in the cache.
BLOCK = 1 << 17
#: Rows from which cut points are found; MLlib takes 10,000.
CUT_ROWS = 100_000

_turn = threading.Lock()  # one forest fills the cluster; several would only hold more memory


def cut_points(values: np.ndarray, bins: int) -> np.ndarray:
    """MLlib's: between all neighbouring values if they are few, else where counts come nearest to equal shares."""
    v, n = np.unique(values, return_counts=True)
    between = (v[:-1] + v[1:]) / 2
    if len(between) < bins:
        return between
    kept, stride, count = [], len(values) / bins, int(n[0])
    target = stride
    for k in range(1, len(v)):
        before, count = count, count + int(n[k])
        if abs(before - target) < abs(count - target):
            kept.append(between[k - 1])
            target += stride
    return np.array(kept)


def binned(columns: list[np.ndarray], cuts: list[np.ndarray]) -> list[np.ndarray]:
    return [np.searchsorted(c, x, side="left") for x, c in zip(columns, cuts, strict=True)]


def grow(codes: np.ndarray, bins: list[int], classes: int, tried: int, depth: int, least: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A tree over codes[feature, row] = bin * classes + class: feature and last left bin of each inner node in heap order, and class shares at full depth. A leaf above sends all to the left."""
    rng, size = np.random.default_rng(seed), codes.shape[1]
    blocks = [codes[:, k : k + BLOCK] for k in range(0, size, BLOCK)]
    sizes = [b.shape[1] for b in blocks]
    drawn = [np.repeat(np.arange(n), np.bincount(rng.integers(0, n, m, dtype=np.uint32), minlength=n)) for n, m in zip(sizes, rng.multinomial(size, np.array(sizes) / size), strict=True)]
    feature, cut, shares = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, 1 << 16, np.int64), np.zeros((2**depth, classes))
    todo = [(0, 0, drawn, None)]
    del drawn
    while todo:
        level, place, rows, counts = todo.pop()
        at, best = 2**level - 1 + place, None
        if counts is None:
            counts = sum(np.bincount(b[0].take(r), minlength=bins[0] * classes) for b, r in zip(blocks, rows, strict=True)).reshape(-1, classes).sum(0)
        if rows is not None:
            size = int(counts.sum())
            whole = float((counts.astype(float) ** 2).sum() / size)
            for f in rng.choice(len(bins), tried, replace=False):
                own = [b[f].take(r) for b, r in zip(blocks, rows, strict=True)]
                left = sum(np.bincount(x, minlength=bins[f] * classes) for x in own).reshape(-1, classes).cumsum(0)[:-1]
                nl = left.sum(1)
                nr = size - nl
                fits = (nl >= least) & (nr >= least)
                if fits.any():
                    l, r = left.astype(float), (counts - left).astype(float)
                    score = np.where(fits, (l * l).sum(1) / np.maximum(nl, 1) + (r * r).sum(1) / np.maximum(nr, 1), -1.0)
                    b = int(score.argmax())
                    if score[b] - whole > 1e-12 * size and (best is None or score[b] > best[0]):
                        best = float(score[b]), int(f), b, own, left[b]
        if best is None:
            shares[place << (depth - level)] = counts / counts.sum()
            continue
        _, feature[at], cut[at], own, left = best
        goes = [x < (best[2] + 1) * classes for x in own]
        for side, n in ((0, left), (1, counts - left)):
            inner = level + 1 < depth and n.sum() >= 2 * least and n.max() < n.sum()
            todo.append((level + 1, 2 * place + side, [r.compress(~g if side else g) for r, g in zip(rows, goes, strict=True)] if inner else None, n))
    return feature, cut, shares


def votes(bins: np.ndarray, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """The mean class shares of all trees for bins[feature, row]."""
    flat, rows = bins.ravel(), bins.shape[1]
    total, row = np.zeros((rows, trees[0][2].shape[1])), np.arange(rows)
    for feature, cut, shares in trees:
        place, start = np.zeros(rows, np.int64), feature * rows
        for level in range(len(shares).bit_length() - 1):
            at = place + (2**level - 1)
            place = 2 * place + (flat.take(start.take(at) + row) > cut.take(at))
        total += shares.take(place, axis=0)
    return total / len(trees)


def predicted(model: RandomForestClassifier, train: DataFrame, test: DataFrame, columns: list[str], label: str = "label") -> DataFrame | None:
    """(label, prediction, probability) of the test rows; None if the forest is one for MLlib. columns are numbers without nulls, labels 0 .. C - 1."""
    spark = train.sparkSession
    known = model.getBootstrap() and model.getImpurity() == "gini" and model.getFeatureSubsetStrategy() == "auto" and model.getSubsamplingRate() == 1 and not model.isSet("weightCol") and not model.isSet("thresholds") and model.getMinInfoGain() == 0 and not model.getMinWeightFractionPerNode()
    rows, top = train.agg(F.count("*"), F.max(label)).first()
    if not known or not rows or not 0 < model.getMaxDepth() < 16 or model.getMaxBins() > 256:
        return None
    classes = int(top) + 1
    kind = np.uint8 if model.getMaxBins() * classes <= 256 else np.uint16
    if model.getMaxBins() * classes > 1 << 16 or rows * len(columns) * np.dtype(kind).itemsize > MOST_BYTES:
        return None
    with _turn:
        part = train.select(*columns)
        part = (part if rows <= CUT_ROWS else part.sample(CUT_ROWS / rows, model.getSeed())).toPandas()
        cuts = [cut_points(part[c].to_numpy(), model.getMaxBins()) for c in columns]

        def coded(batches):
            for b in batches:
                own = b.column(len(columns)).to_numpy().astype(np.int64)
                yield pa.RecordBatch.from_pydict({"codes": pa.array([np.stack([x * classes + own for x in binned([b.column(k).to_numpy() for k in range(len(columns))], cuts)]).astype(kind).tobytes()], pa.binary())})

        parts = train.select(*columns, label).mapInArrow(coded, "codes binary").toArrow()["codes"].to_pylist()
        codes = spark.sparkContext.broadcast(np.concatenate([np.frombuffer(p, kind).reshape(len(columns), -1) for p in parts], axis=1))
        del parts
        bins, tried = [len(c) + 1 for c in cuts], int(np.ceil(np.sqrt(len(columns))))
        depth, least, seed = model.getMaxDepth(), model.getMinInstancesPerNode(), model.getSeed()
        numbers = range(model.getNumTrees())
        trees = spark.sparkContext.parallelize(numbers, min(len(numbers), 10 * spark.sparkContext.defaultParallelism)).map(lambda k: grow(codes.value, bins, classes, tried, depth, least, [abs(seed), k])).collect()
        codes.destroy()
    grown = spark.sparkContext.broadcast(trees)

    def judged(batches):
        for b in batches:
            shares = votes(np.stack(binned([b.column(k).to_numpy() for k in range(len(columns))], cuts)), grown.value)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(0, shares.size + 1, classes, dtype=np.int32)), pa.array(shares.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(len(columns)), pa.array(shares.argmax(1).astype(float)), listed], names=["label", "prediction", "probability"])

    return test.select(*columns, F.col(label).cast("double")).mapInArrow(judged, "label double, prediction double, probability array<double>")
