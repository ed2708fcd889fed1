"""Language ID: a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import fresh, small_batches

PAD = 256
UNDETERMINED = "und"


@dataclass
class Network:
    """Weights of both directions, side by side: inputs (2, 3H, 257), recurrent (2, 3H, H), output (L, 2H), bias (L)."""

    inputs: np.ndarray
    recurrent: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    @classmethod
    def start(cls, hidden: int, labels: int, rng: np.random.Generator) -> Network:
        draw = lambda *shape, by: rng.normal(0, by, shape).astype(np.float32)
        inputs = draw(2, 3 * hidden, PAD + 1, by=0.3)
        return cls(inputs, draw(2, 3 * hidden, hidden, by=0.6 / np.sqrt(hidden)), draw(labels, 2 * hidden, by=0.3), np.zeros(labels, np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.inputs, self.recurrent, self.output, self.bias]


def _squash(x: np.ndarray, tmp: np.ndarray) -> None:
    """x / (1 + |x|) in place: the squashing function of the gates and of the candidate."""
    np.abs(x, out=tmp)
    tmp += 1
    x /= tmp


def _direction(net: Network, d: int, x: np.ndarray, keep: list | None) -> np.ndarray:
    """States (T, H, B) of one direction over bytes x (T, B); d = 1 runs from the end. A padded position keeps the state."""
    steps, batch = x.shape
    u = net.recurrent[d]
    hidden = u.shape[1]
    table = net.inputs[d]
    h = np.zeros((hidden, batch), np.float32)
    out = np.empty((steps, hidden, batch), np.float32)
    a = np.empty((3 * hidden, batch), np.float32)
    g, tmp = np.empty_like(a), np.empty_like(a)
    for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
        np.take(table, x[t], axis=1, out=a, mode="clip")
        np.matmul(u, h, out=g)
        gates, cand = a[: 2 * hidden], a[2 * hidden :]
        gates += g[: 2 * hidden]
        _squash(gates, tmp[: 2 * hidden])
        gates *= 0.5
        gates += 0.5
        np.multiply(gates[:hidden], g[2 * hidden :], out=tmp[:hidden])
        cand += tmp[:hidden]
        _squash(cand, tmp[:hidden])
        if keep is not None:
            keep.append((t, h.copy(), gates.copy(), cand.copy(), g[2 * hidden :].copy()))
        np.subtract(cand, h, out=tmp[:hidden])
        tmp[:hidden] *= gates[hidden:]
        h += tmp[:hidden]
        out[t] = h
    return out


def _probabilities(net: Network, x: np.ndarray, keep: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities (T, L, B) of every position, and the states."""
    h = np.concatenate([_direction(net, d, x, keep[d] if keep else None) for d in (0, 1)], axis=1)
    logits = np.matmul(net.output, h)
    logits += net.bias[:, None]
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits, h


def _gradients(net: Network, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over all positions of windows x (T, B) with labels y (B), and its gradients, by
    backpropagation through time."""
    kept: tuple[list, list] = ([], [])
    p, h = _probabilities(net, x, kept)
    real = (x != PAD).astype(np.float32)
    total = max(real.sum(), 1)
    picked = np.take_along_axis(p, np.broadcast_to(y, (len(x), 1, len(y))), axis=1)
    loss = float(-(np.log(picked[:, 0] + 1e-9) * real).sum() / total)
    dl = p.copy()
    np.put_along_axis(dl, np.broadcast_to(y, (len(x), 1, len(y))), picked - 1, axis=1)
    dl *= real[:, None] / total
    flat = dl.transpose(1, 0, 2).reshape(dl.shape[1], -1)
    d_out = flat @ h.transpose(1, 0, 2).reshape(h.shape[1], -1).T
    dh_all = np.matmul(net.output.T, dl)
    hidden = net.recurrent.shape[2]
    d_in, d_rec = np.zeros_like(net.inputs), np.zeros_like(net.recurrent)
    for d in (0, 1):
        back = np.zeros((hidden, x.shape[1]), np.float32)
        for t, before, gates, cand, inner in reversed(kept[d]):
            dh = back + dh_all[t, d * hidden : (d + 1) * hidden]
            r, z = gates[:hidden], gates[hidden:]
            dc = dh * z * (1 - np.abs(cand)) ** 2
            dz = dh * (cand - before) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
            dr = dc * inner * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
            da = np.concatenate([dr, dz, dc])
            dg = np.concatenate([dr, dz, dc * r])
            d_rec[d] += dg @ before.T
            order = np.argsort(x[t], kind="stable")
            seen, first = np.unique(x[t][order], return_index=True)
            d_in[d][:, seen] += np.add.reduceat(da[:, order], first, axis=1)
            back = dh * (1 - z) + net.recurrent[d].T @ dg
    d_in[:, :, PAD] = 0
    return loss, [d_in, d_rec, d_out, dl.sum(axis=(0, 2))]


def train(windows: list[bytes], labels: list[int], n_labels: int, hidden: int = 8, epochs: int = 8, batch: int = 128, rate: float = 0.02, seed: int = 7) -> Network:
    """Fit by Adam on windows of text bytes, every position of a window being labelled with its document's language."""
    rng = np.random.default_rng(seed)
    net = Network.start(hidden, n_labels, rng)
    # A padded position's update gate is shut, so the state passes it unchanged.
    net.inputs[:, :, PAD] = 0
    net.inputs[:, hidden : 2 * hidden, PAD] = -1e7
    size = max(map(len, windows))
    x = np.full((len(windows), size), PAD, np.int64)
    for i, w in enumerate(windows):
        x[i, : len(w)] = np.frombuffer(w, np.uint8)
    y = np.array(labels, np.int64)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parts()]
    step, steps = 0, epochs * -(-len(x) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(order), batch):
            pick = order[i : i + batch]
            step += 1
            _, grads = _gradients(net, np.ascontiguousarray(x[pick].T), y[pick])
            scale = min(1.0, 5.0 / (np.sqrt(sum(float((g**2).sum()) for g in grads)) + 1e-9))
            now = rate * (1 - step / (steps + 1))
            for p, g, (m, v) in zip(net.parts(), grads, moments, strict=True):
                g *= scale
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def label_bytes(net: Network, texts: list[bytes], window: int = 128, at_once: int = 2048) -> tuple[np.ndarray, list[np.ndarray]]:
    """Pooled probabilities (documents, L), the mean over every byte of each text, and the label of every byte. Texts
    are read whole, in windows that each start from an empty state."""
    counts = np.array([-(-len(t) // window) for t in texts], np.int64)
    x = np.full((int(counts.sum()), window), PAD, np.uint16)
    flat, at = x.reshape(-1), 0
    for text, n in zip(texts, counts, strict=True):
        flat[at : at + len(text)] = np.frombuffer(text, np.uint8)
        at += int(n) * window
    sums = np.zeros((len(x), len(net.bias)), np.float64)
    best = np.zeros(x.shape, np.int8)
    for i in range(0, len(x), at_once):
        part = np.ascontiguousarray(x[i : i + at_once].T.astype(np.int64))
        p, _ = _probabilities(net, part)
        best[i : i + at_once] = p.argmax(axis=1).T
        p *= (part != PAD)[:, None]
        sums[i : i + at_once] = p.sum(axis=0).T
    pooled = np.zeros((len(texts), len(net.bias)))
    full = np.flatnonzero(counts)
    if len(full):
        pooled[full] = np.add.reduceat(sums, (np.cumsum(counts) - counts)[full], axis=0)
        pooled[full] /= np.array([len(texts[i]) for i in full])[:, None]
    labels, at = [], 0
    for text, n in zip(texts, counts, strict=True):
        labels.append(best.reshape(-1)[at : at + len(text)])
        at += int(n) * window
    return pooled, labels


def _windows(length: int, each: int):
    """Up to `each` evenly spaced windows of every text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                room = max(len(raw) - length, 0)
                n = min(each, room // length + 1)
                out += ((lang, raw[at : at + length]) for at in (room * i // max(n - 1, 1) for i in range(n)))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.binary())], names=["lang", "raw"])

    return run


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def fit(docs: DataFrame, key: Column, text_col: str = "text", lang_col: str = "lang", per_label: int = 600, length: int = 64, each: int = 3, **how) -> tuple[Network, list[str]] | None:
    """Train on a sample of at most about per_label documents of each label (a documented bound: it is drawn by a hash
    of key, evenly over all rows) and `each` windows of `length` bytes of each. None where nothing is labelled."""
    rows = docs.where(F.col(lang_col).isNotNull() & has_letter(F.col(text_col))).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(key), F.lit(1 << 30)).alias("draw"))
    counts = dict(rows.groupBy("lang").count().collect())
    if not counts:
        return None
    share = F.create_map(*(F.lit(v) for lang, n in counts.items() for v in (lang, min(1 << 30, (per_label << 30) // n))))
    found = rows.where(F.col("draw") < F.element_at(share, F.col("lang"))).select("lang", "text").mapInArrow(_windows(length, each), "lang string, raw binary").collect()
    names = sorted({r.lang for r in found})
    if not names:
        return None
    found.sort(key=lambda r: (r.lang, bytes(r.raw)))
    return train([bytes(r.raw) for r in found], [names.index(r.lang) for r in found], len(names), **how), names


def predict(docs: DataFrame, model: tuple[Network, list[str]] | None, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """The documents with a predicted label and its pooled probability; `und` and 0 for a null text, one without a
    letter, or without a model. Only the text is read. Columns of those names are replaced."""
    small_batches(docs.sparkSession)
    names = model[1] if model else []
    net = model[0] if model else None

    @F.pandas_udf("label string, score double")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            preds, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            # Texts are taken in turns of about 4 MB, which bounds a task's memory.
            turn: list[tuple[int, bytes]] = []
            size = 0
            for i, text in enumerate([*texts, None]):
                if turn and (i == len(texts) or size > 4_000_000):
                    pooled, _ = label_bytes(net, [raw for _, raw in turn])
                    for (k, _), p in zip(turn, pooled, strict=True):
                        best = int(p.argmax())
                        preds[k], scores[k] = names[best], float(min(max(p[best], 0.0), 1.0))
                    turn, size = [], 0
                if text is not None and net is not None:
                    turn.append((i, text.encode("utf-8", "surrogatepass")))
                    size += len(turn[-1][1])
            yield pd.DataFrame({"label": preds, "score": scores})

    # Only the text goes to Python; the other columns wait in the JVM.
    docs = docs.drop(pred_col, score_col)
    (found,) = fresh(docs, "found")
    out = docs.withColumn(found, label(F.when(has_letter(F.col(text_col)), F.col(text_col).cast("string"))))
    return out.select(*docs.columns, F.col(f"{found}.label").alias(pred_col), F.col(f"{found}.score").alias(score_col))


def held_out(key: Column) -> Column:
    """Whether crc32 of the key as text leaves 2 when divided by 4; a null key is not held out."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def language_model(docs: DataFrame, id_col: str = "doc_id", **how) -> tuple[Network, list[str]] | None:
    """Fit on the labelled documents that are not held out; rows with a null id are left out as well."""
    return fit(docs.where(F.col(id_col).isNotNull() & ~held_out(F.col(id_col))), F.col(id_col), **how)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, lang_pred, score. Repeated rows are predicted each; an empty table gives
    none; extra columns and every column but the text have no influence on a prediction."""
    model = language_model(docs, id_col)
    rows = docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text_in"))
    return predict(rows.select(F.col(id_col), "held_out", F.col("text_in").alias("text")), model).select(id_col, "held_out", "lang_pred", "score")


def rejection_cut(docs: DataFrame, model: tuple[Network, list[str]] | None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", share: float = 0.9, most: float = 0.5) -> float:
    """The pooled probability below which a language counts as undetermined: `share` of the one that all but a
    thousandth of the held-out documents reach, and `most` at the most. It is fitted on all held-out documents whose label
    the model knows; 0 where there is none. Equal probabilities are counted before they meet, to six decimals, so the
    task that finds the quantile holds a million rows at most."""
    known = F.col(lang_col).cast("string").isin(model[1] if model else [])
    rows = docs.where(known & F.col(id_col).isNotNull() & held_out(F.col(id_col)) & has_letter(F.col(text_col)))
    scores = predict(rows.select(F.col(text_col).alias("text")), model).groupBy(F.round("score", 6).alias("score")).count()
    found = scores.agg(F.percentile("score", F.lit(0.001), F.col("count"))).first()[0]
    return 0.0 if found is None else min(most, share * found)


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float | None = None) -> DataFrame:
    """The documents whose language the network determines: those with a letter and a pooled probability of `least` or
    more, by default of rejection_cut. Null and empty texts go; repeated rows and null ids are judged by their text;
    columns named lang_pred or score stay as they are; an empty table stays empty."""
    pred, score = fresh(docs, "lang_pred", "score")
    model = language_model(docs, id_col)
    if least is None:
        least = rejection_cut(docs, model, id_col, text_col, lang_col)
    return predict(docs, model, text_col, pred, score).where((F.col(pred) != UNDETERMINED) & (F.col(score) >= least)).drop(pred, score)
