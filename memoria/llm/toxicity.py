"""Toxicity by classifier chains over hashed text features."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import U64, lowered, mix, word_hashes_by

_BITS = 18
_GRAM = 5
#: Bytes between words here: all of ASCII but the letters.
_NOT_LETTER = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the hashed words and byte 5-grams of a whole text (with repeats), and four measures of its form."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    low = lowered(text)
    a = np.frombuffer(low, np.uint8)
    words = word_hashes_by(low, _NOT_LETTER)
    grams = np.zeros(max(len(a) - _GRAM + 1, 0), U64)
    for i in range(_GRAM if len(grams) else 0):
        grams = (grams << U64(8)) | a[i : i + len(grams)].astype(U64)
    places = np.concatenate([mix(words ^ U64(0x5851F42D4C957F2D)), mix(grams + U64(1))]) >> U64(64 - _BITS)
    b = np.frombuffer(raw, np.uint8)
    n = max(len(b), 1)
    upper = ((b >= 65) & (b <= 90)).sum() / n
    odd = (_NOT_LETTER[b] & (b != 32)).sum() / n
    repeated = 1 - len(np.unique(words)) / max(len(words), 1)
    return places.astype(np.int64), np.array([upper, odd, repeated, np.log1p(len(b)) / 10])


def _distinct(places: np.ndarray) -> np.ndarray:
    """The distinct places in order; no copy of what is so already."""
    return places if (places[1:] > places[:-1]).all() else np.unique(places)


@dataclass
class Linear:
    """A logistic model: a weight for each hashed place that is present, for each measure, and for each earlier category."""

    places: np.ndarray
    dense: np.ndarray
    bias: float

    def score(self, places: np.ndarray, dense: np.ndarray) -> float:
        found = places[self.places[places] != 0]
        z = self.places[np.unique(found)].sum() + self.dense @ dense + self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _fit(rows: list[np.ndarray], dense: np.ndarray, y: np.ndarray, weight: np.ndarray, most: int, steps: int, ridge: float) -> Linear:
    """Keep the places whose presence tells the classes apart best, then minimise the weighted logistic loss with a
    ridge by accelerated gradient steps. A row holds each of its places once."""
    size = 1 << _BITS
    # Row by row, in place: lists of all places with their owners and weights would take many times the rows' memory.
    counts, sums = np.zeros((2, size), np.int64), np.zeros((2, size))
    for r, c, w in zip(rows, y, weight):
        counts[c][r] += 1
        sums[c][r] += w
    seen = counts.sum(0)
    odds = np.log((sums[1] + 0.5) / (weight[y == 1].sum() + 1)) - np.log((sums[0] + 0.5) / (weight[y == 0].sum() + 1))
    z = np.where(seen >= 5, np.abs(odds) * np.sqrt(np.minimum(seen, 200)), 0)
    chosen = np.sort(np.argsort(-z, kind="stable")[:most])
    chosen = chosen[z[chosen] > 0]
    column = np.full(size, -1)
    column[chosen] = np.arange(len(chosen))
    x = np.zeros((len(rows), len(chosen) + dense.shape[1] + 1), np.float32)
    for i, r in enumerate(rows):
        inside = column[r]
        x[i, inside[inside >= 0]] = 1
    x[:, len(chosen) : -1] = dense
    x[:, -1] = 1
    weight, y = (weight / weight.sum()).astype(np.float32), y.astype(np.float32)
    norms = np.concatenate([(x[i : i + 256] ** 2).sum(1) for i in range(0, len(x), 256)])
    rate = 4 / (float((weight * norms).sum()) + 4 * ridge)
    penalty = np.full(x.shape[1], ridge, np.float32)
    penalty[-1] = 0
    theta = ahead = np.zeros(x.shape[1], np.float32)
    for step in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30)))
        new = ahead - rate * (x.T @ (weight * (p - y)) + penalty * ahead)
        ahead = new + step / (step + 3) * (new - theta)
        theta = new
    places = np.zeros(size, np.float32)
    places[chosen] = theta[: len(chosen)]
    return Linear(places, theta[len(chosen) : -1].astype(np.float64), float(theta[-1]))


@dataclass
class Chain:
    """Models of the categories in order; each also reads the probabilities of those before it."""

    names: list[str]
    models: list[Linear]
    cut: list[float]

    def probabilities(self, text: str | None) -> list[float]:
        places, dense = features(text)
        found: list[float] = []
        for m in self.models:
            found.append(m.score(places, np.concatenate([dense, found])))
        return found


def fit_chain(texts: list[tuple[np.ndarray, np.ndarray]], labels: dict[str, np.ndarray], weight: np.ndarray, folds: int = 3, most: int = 2000, steps: int = 300, ridge: float = 1e-5) -> Chain:
    """Fit the categories in the order given. A later model is trained on out-of-fold probabilities of the earlier ones,
    as it will meet at prediction: a model's own fit on its training rows would look too sure. A category's cut is where
    its out-of-fold probabilities give the best weighted F-half, which counts precision twice as much as recall."""
    rows = [_distinct(t[0]) for t in texts]
    dense = np.stack([t[1] for t in texts])
    fold = np.arange(len(rows)) % folds
    models, cuts = [], []
    for y in labels.values():
        y = y.astype(np.int64)
        out = np.zeros(len(rows))
        for k in range(folds):
            train, test = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            if len(test) and len(train):
                m = _fit([rows[i] for i in train], dense[train], y[train], weight[train], most, steps, ridge)
                out[test] = [m.score(rows[i], dense[i]) for i in test]
        models.append(_fit(rows, dense, y, weight, most, steps, ridge))
        order = np.argsort(-out, kind="stable")
        hit, took = np.cumsum((weight * y)[order]), np.cumsum(weight[order])
        f_half = 1.25 * hit / (took + 0.25 * (weight * y).sum() + 1e-9)
        best = int(f_half.argmax())
        below = out[order[best + 1]] if best + 1 < len(order) else 0.0
        cuts.append(float((out[order[best]] + below) / 2))
        dense = np.column_stack([dense, out])
    return Chain(list(labels), models, cuts)


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str = "doc_id", text_col: str = "text", per_class: int = 1500, **how) -> Chain | None:
    """Fit on a sample of at most about per_class labelled documents of each combination of categories (a documented
    bound: drawn by a hash of the id, evenly over all labels, each row weighted by how many it stands for). Rows with a
    null id or label are left out. None without labels."""
    names = list(categories)
    asked = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(*(F.max(c.cast("int")).alias(n) for n, c in categories.items())).dropna()
    combined = F.concat_ws(",", *names)
    counts = dict(asked.groupBy(combined.alias("c")).count().collect())
    if not counts:
        return None
    share = {c: min(1.0, per_class / n) for c, n in counts.items()}
    wanted = F.create_map(*(F.lit(v) for c, s in share.items() for v in (c, int(s * (1 << 30)))))
    asked = asked.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.element_at(wanted, combined))
    rows = docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("text"))
    # The sampled labels are at most about per_class * 2^categories rows.
    rows = rows.join(F.broadcast(asked), F.col("k") == F.col("id")).select("id", "text", *names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [features(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.unique(f[0]).astype("<i4").tobytes() for f in found], pa.binary()), pa.array([f[1].tobytes() for f in found], pa.binary()), *b.columns[2:]], names=["id", "places", "dense", *names])

    kind = docs.schema[id_col].dataType.simpleString()
    found = rows.mapInArrow(run, f"id {kind}, places binary, dense binary, {', '.join(f'`{n}` int' for n in names)}").collect()
    if not found:
        return None
    found.sort(key=lambda r: (r.id, bytes(r.places)))
    weight = np.array([1 / share[",".join(str(r[n]) for n in names)] for r in found])
    texts = [(np.frombuffer(r.places, "<i4"), np.frombuffer(r.dense)) for r in found]
    return fit_chain(texts, {n: np.array([r[n] for r in found]) for n in names}, weight, **how)


def score(docs: DataFrame, chain: Chain | None, names: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, and for each category p_<name> and the decision <name>.

    Every whole text is read. Null or empty text has a probability of 0 in every category and is never flagged; without
    a chain all documents are so. Null ids and repeated rows are scored each; extra columns are ignored; an empty table
    gives none.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [chain.probabilities(t) if chain and t else [0.0] * len(names) for t in b.column(1).to_pylist()]
            columns = [b.column(0)]
            for k, _ in enumerate(names):
                p = [f[k] for f in found]
                columns += [pa.array(p, pa.float64()), pa.array([bool(chain) and x > 0 and x >= chain.cut[k] for x in p], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, *(c for n in names for c in (f"p_{n}", n))])

    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"p_{n} double, `{n}` boolean" for n in names))
