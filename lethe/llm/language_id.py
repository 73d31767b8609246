"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

``fit_all`` learns from every training row: the n-grams of each language are counted in the executors and summed as
vectors of fixed size, and a feature weighs the logarithm of its smoothed share (multinomial naive Bayes).  Each row, copies too, counts in one of two
halves by a hash of its text; every row is scored by the counts of the other half, and the temperature that makes
these scores probabilities is that with the least loss over all of them.

``fit`` reads all training rows once for document frequencies (summed as fixed-size
vectors) and takes a bounded sample of them, ``per_label`` rows of each language, those
whose hash is smallest.  The sample is fitted on the driver by follow-the-regularised-leader
with per-coordinate rates and an elastic net, which leaves most weights zero; a fifth of it
is held back and a temperature is fitted there so that scores are probabilities.

Defined cases: a text that is null or has no letter is ``und`` with score 0; rows without
a language are not learned from; without any labelled row all is ``und`` with score 0;
repeated rows are predicted alike; ties between languages go to the one that sorts first; columns
named like a result are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lethe.llm import _store
from lethe.llm._chars import text_features

ORDERS = (1, 2, 3)
BITS = 16
#: Rows of each language that are fitted.
PER_LABEL = 500
#: Brings relative frequencies times IDF to the scale of the learning rate.
SCALE = 20.0
MADE = ("lang_pred", "score")
UNKNOWN = "und"


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # label x feature, IDF and scale included
    bias: np.ndarray
    temperature: float
    bits: int = BITS
    orders: tuple[int, ...] = ORDERS


def _frequencies(bits: int, orders: tuple[int, ...]):
    def run(batches):
        df, rows = np.zeros(1 << bits, np.int64), 0
        for batch in batches:
            for _, _, f, at, _ in text_features(batch.column(0), orders, bits):
                for a, b in zip(at, at[1:], strict=False):
                    if b - a > 1 << (bits - 3):
                        seen = np.zeros(1 << bits, bool)
                        seen[f[a:b]] = True
                        df += seen
                    else:
                        df[np.unique(f[a:b])] += 1
                rows += len(at) - 1
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64()), pa.array([df.tobytes()], pa.binary())], names=["rows", "df"])

    return run


def _summed(batches):
    rows, df = 0, None
    for batch in batches:
        for n, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows += n
            df = np.frombuffer(b, np.int64).copy() if df is None else df + np.frombuffer(b, np.int64)
    if df is not None:
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64()), pa.array([df.tobytes()], pa.binary())], names=["rows", "df"])


def frequencies(texts: DataFrame, bits: int = BITS, orders: tuple[int, ...] = ORDERS) -> tuple[int, np.ndarray]:
    """Rows, and rows with each feature, over the first column of texts."""
    parts = texts.mapInArrow(_frequencies(bits, orders), "rows long, df binary")
    total = None
    for r in parts.repartition(16).mapInArrow(_summed, "rows long, df binary").toLocalIterator():
        df = np.frombuffer(bytes(r["df"]), np.int64)
        total = (r["rows"], df.copy()) if total is None else (total[0] + r["rows"], total[1] + df)
    return total or (0, np.zeros(1 << bits, np.int64))


def _sparse(bits: int, orders: tuple[int, ...]):
    def run(batches):
        for batch in batches:
            idx, val = [], []
            for _, _, f, at, _ in text_features(batch.column("text"), orders, bits):
                for a, b in zip(at, at[1:], strict=False):
                    i, c = np.unique(f[a:b], return_counts=True)
                    idx.append(i.astype("<i4").tobytes())
                    val.append((c / max(1, b - a)).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(idx, pa.binary()), pa.array(val, pa.binary())], names=["label", "idx", "val"])

    return run


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], labels: int, width: int, *, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, epochs: int = 4, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of a softmax fitted by FTRL-proximal with an elastic net."""
    z, n = np.zeros((labels, width)), np.zeros((labels, width))
    bz = np.zeros(labels)

    def weights(z, n):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for epoch in range(epochs):
        for r in np.random.default_rng(seed + epoch).permutation(len(rows)):
            i, x, y = rows[r]
            w = weights(zi := z[:, i], ni := n[:, i])
            s = w @ x + bz
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = p[:, None] * x
            z[:, i] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[:, i] = ni + g * g
            bz -= 0.01 * p
    return weights(z, n), bz


GRID = np.geomspace(0.05, 20, 120)


def temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """Divisor of the scores with the least log loss."""
    if not len(y):
        return 1.0

    def loss(t):
        s = scores / t
        s = s - s.max(1, keepdims=True)
        return -(s[np.arange(len(y)), y] - np.log(np.exp(s).sum(1))).mean()

    return float(GRID[int(np.argmin([loss(t) for t in GRID]))])


def fit(docs: DataFrame, *, text: str = "text", label: str = "lang", train: Column | None = None, per_label: int = PER_LABEL, bits: int = BITS, orders: tuple[int, ...] = ORDERS) -> Model:
    """A model learned from text and non-null label of the rows of docs for which train holds."""
    _store.ship(docs.sparkSession)
    rows = docs.filter(train) if train is not None else docs
    rows = rows.select(_store.column(docs, text, "string").alias("text"), _store.column(docs, label, "string").alias("label")).filter("text IS NOT NULL AND label IS NOT NULL")
    total, df = frequencies(rows.select("text"), bits, orders)
    idf = np.log((1 + total) / (1 + df)) + 1.0
    # Copies count as one row, so that they do not fill the sample; hashes are ranked, and only texts of those taken are dealt.
    keys = rows.select("label", F.xxhash64("text").alias("h")).distinct()
    few = keys.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy("h"))).filter(F.col("k") <= per_label).select("label", "h")
    sample = rows.withColumn("h", F.xxhash64("text")).join(F.broadcast(few), ["label", "h"]).select("text", "label").distinct()
    got = sample.mapInArrow(_sparse(bits, orders), "label string, idx binary, val binary").collect()
    labels = sorted({r["label"] for r in got})
    if not labels:
        return Model([], np.zeros((0, 1 << bits), np.float32), np.zeros(0), 1.0, bits, orders)
    data = []
    for r in got:
        i = np.frombuffer(bytes(r["idx"]), "<i4")
        if len(i):
            data.append((i, SCALE * idf[i] * np.frombuffer(bytes(r["val"]), "<f4"), labels.index(r["label"])))
    data.sort(key=lambda r: (r[2], len(r[0]), r[0].tobytes(), r[1].tobytes()))
    held = data[::5] if len(data) >= 50 else []
    kept = [r for k, r in enumerate(data) if k % 5] if held else data
    w, b = ftrl(kept, len(labels), 1 << bits)
    scores = np.array([w[:, i] @ x + b for i, x, _ in held]) if held else np.zeros((0, len(labels)))
    t = temperature(scores, np.array([y for _, _, y in held], int))
    return Model(labels, (w * (SCALE * idf)).astype(np.float32), b, t, bits, orders)


def _scores(m: Model, f: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each text whose features are f[at[i] : at[i + 1]] the score of each label, before the temperature."""
    size = np.diff(at)
    s, full = np.zeros((len(size), max(1, len(m.labels)))), np.flatnonzero(size)
    for c in range(len(m.labels)):
        if len(full):
            s[full, c] = np.add.reduceat(m.weights[c][f], at[:-1][full]) / size[full]
        s[:, c] += m.bias[c]
    return s


_COUNTED = "label string, half int, counts binary"


def _packed(sums: dict[tuple[str, int], np.ndarray]) -> pa.RecordBatch:
    keys = sorted(sums)
    columns = [pa.array([k for k, _ in keys], pa.string()), pa.array([h for _, h in keys], pa.int32()), pa.array([sums[k].tobytes() for k in keys], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["label", "half", "counts"])


def _counts(bits: int, orders: tuple[int, ...]):
    def run(batches):
        sums: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            keys = list(zip(batch.column("label").to_pylist(), batch.column("half").to_pylist(), strict=True))
            for lo, hi, f, at, _ in text_features(batch.column("text"), orders, bits):
                # The rows of a key lie apart; its features are counted together.
                for key in set(keys[lo:hi]):
                    rows = np.array([k == key for k in keys[lo:hi]])
                    sums.setdefault(key, np.zeros(1 << bits, np.int64))
                    sums[key] += np.bincount(f[np.repeat(rows, np.diff(at))], minlength=1 << bits)
        if sums:
            yield _packed(sums)

    return run


def _added(batches):
    sums: dict[tuple[str, int], np.ndarray] = {}
    for batch in batches:
        for label, half, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            more = np.frombuffer(b, np.int64)
            sums[label, half] = sums[label, half] + more if (label, half) in sums else more
    if sums:
        yield _packed(sums)


def _bayes(labels: list[str], counts: list[np.ndarray], bits: int, orders: tuple[int, ...], t: float = 1.0) -> Model:
    """Of every label the logarithm of each feature's share, half a count added to each; texts are scored by its mean over their features."""
    weights = [np.log((c + 0.5) / (c.sum() + 0.5 * len(c))) for c in counts]
    return Model(labels, np.array(weights, np.float32).reshape(len(labels), 1 << bits), np.zeros(len(labels)), t, bits, orders)


def _losses(shared):
    def run(batches):
        halves = shared.value
        place = {x: k for k, x in enumerate(halves[0].labels)}
        loss = np.zeros(len(GRID))
        for batch in batches:
            y, half = np.array([place[x] for x in batch.column("label").to_pylist()], int), np.array(batch.column("half").to_pylist(), int)
            for lo, hi, f, at, some in text_features(batch.column("text"), halves[0].orders, halves[0].bits):
                own = half[lo:hi]
                s = np.where(own[:, None] == 0, *(_scores(m, f, at) for m in halves)) if len(set(own)) > 1 else _scores(halves[own[0]], f, at)
                s, truth = s[some], y[lo:hi][some]
                s = s - s.max(1, keepdims=True)
                loss += [(np.log(np.exp(s / t).sum(1)) - s[np.arange(len(truth)), truth] / t).sum() for t in GRID]
        yield pa.RecordBatch.from_arrays([pa.array([loss.tolist()], pa.list_(pa.float64()))], names=["loss"])

    return run


def fit_all(docs: DataFrame, *, text: str = "text", label: str = "lang", train: Column | None = None, bits: int = BITS, orders: tuple[int, ...] = ORDERS) -> Model:
    """A model learned from text and non-null label of all rows of docs for which train holds."""
    spark = docs.sparkSession
    _store.ship(spark)
    rows = docs.filter(train) if train is not None else docs
    rows = rows.select(_store.column(docs, text, "string").alias("text"), _store.column(docs, label, "string").alias("label")).filter("text IS NOT NULL AND label IS NOT NULL")
    rows = rows.withColumn("half", F.xxhash64("text").bitwiseAND(F.lit(1)).cast("int"))
    sums: dict[tuple[str, int], np.ndarray] = {}
    for r in rows.mapInArrow(_counts(bits, orders), _COUNTED).repartition("label", "half").mapInArrow(_added, _COUNTED).toLocalIterator():
        sums[r["label"], r["half"]] = np.frombuffer(bytes(r["counts"]), np.int64)
    labels, none = sorted({x for x, _ in sums}), np.zeros(1 << bits, np.int64)
    whole = [sums.get((x, 0), none) + sums.get((x, 1), none) for x in labels]
    if len(labels) < 2:
        return _bayes(labels, whole, bits, orders)
    # A half is scored by the counts of the other one.
    halves = spark.sparkContext.broadcast([_bayes(labels, [sums.get((x, 1 - h), none) for x in labels], bits, orders) for h in (0, 1)])
    # One short row a task; collected, as an iterator would run the tasks one by one.
    losses = np.array([r["loss"] for r in rows.mapInArrow(_losses(halves), "loss array<double>").collect()])
    halves.destroy()
    return _bayes(labels, whole, bits, orders, float(GRID[int(np.argmin(np.sort(losses, 0).sum(0)))]) if len(losses) else 1.0)


def _predict(shared, text: str, schema: list[str]):
    def run(batches):
        m = shared.value
        for batch in batches:
            names, scores = [], []
            for _, _, f, at, some in text_features(batch.column(text), m.orders, m.bits):
                s = _scores(m, f, at) / m.temperature
                p = np.exp(s - s.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                best = p.argmax(1)
                known = some & bool(m.labels)
                names += [m.labels[k] if ok else UNKNOWN for k, ok in zip(best, known, strict=True)]
                scores.append(np.where(known, p[np.arange(len(p)), best], 0.0))
            made = {"lang_pred": pa.array(names, pa.string()), "score": pa.array(np.concatenate(scores) if scores else [], pa.float64())}
            yield pa.RecordBatch.from_arrays([made[c] if c in made else batch.column(c) for c in schema], names=schema)

    return run


def predict(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns ``keep``) with lang_pred and score, its calibrated probability."""
    spark = docs.sparkSession
    _store.ship(spark)
    carried = [c for c in (keep if keep is not None else docs.columns) if c.lower() not in MADE and not c.startswith(_store.OWN)]
    body = _store.OWN + "text"
    own = docs.select(*[F.col(f"`{c}`") for c in carried], _store.column(docs, text, "string").alias(body))
    fields = [*own.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return own.mapInArrow(_predict(spark.sparkContext.broadcast(model), body, [f.name for f in fields]), T.StructType(fields))


def keep_identified(docs: DataFrame, *, text: str = "text", label: str = "lang", train: Column | None = None, least: float = 0.5) -> DataFrame:
    """The rows of docs whose language is identified with a probability of ``least`` or more, by a model of all rows for which train holds."""
    names = docs.columns
    model = fit_all(docs, text=text, label=label, train=train)
    plain = docs.toDF(*[f"c{i}_" for i in range(len(names))])
    found = predict(plain, model, text=f"c{names.index(text)}_")
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(*[F.col(f"c{i}_").alias(n) for i, n in enumerate(names)])
