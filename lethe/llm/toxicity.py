"""Toxicity scores of text restored by a noisy channel.

Writers hide words by look-alike characters, by spacing letters out and by repeating them.  A
token with a look-alike next to a letter, a run of single letters or look-alikes, or a word with a doubled letter
is a lattice: a look-alike may stand for one of a few letters, a separator
between single letters or a repeated letter for nothing.  Viterbi decoding picks the path with the
least cost under a character trigram model and a fixed channel cost; text without such passages
has one path and stays.  The restored text is scored by logistic regression on the presence of
hashed words and character n-grams.

The trigram model counts all documents (summed as fixed-size vectors).  Labels are learned from a bounded
sample of the labelled rows, ``per_label`` of each label, those whose id hashes lowest.

Defined cases: null and empty texts get the score of a text without any feature; labels other
than 0 and 1, null labels and ids without a document are not learned from; an id with both labels
counts as toxic; without a labelled row of both kinds all scores are 0; repeated rows score alike; columns named
like a result are replaced.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lethe.llm import _store
from lethe.llm._chars import SPACE, hashed, letter_runs
from lethe.llm._words import pieces
from lethe.llm.language_id import ftrl, temperature

BITS = 18
ORDERS = (4, 5)
#: Rows of label 1 that are fitted, and for each of them rows of label 0.
PER_LABEL = 2500
CLEAN = 2
MADE = ("score", "predicted")
#: Channel: what a character may stand for, and what reading it so costs.
LOOKS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c"}
LOOK_COST, BREAK_COST, DROP_COST, GAP_COST, STAY_COST = 1.0, 6.0, 0.5, 0.2, 4.0
#: A letter that stands just twice is mostly meant; symbols at a passage's end are mostly punctuation.
PAIR_COST, END_COST = 3.0, 0.5
SYMBOLS = 59

_L, _S = r"[^\W\d_]", r"[0-9@$!|+€£(]"
_LEET = re.compile(rf"(?<![^\W_])(?<![@$!|+€£(])(?:{_L}++{_S}|{_S}++{_L})(?:{_L}|{_S})*+")
_LEET_HINT = re.compile(rf"{_S}{_L}|{_L}{_S}")
_RUN = re.compile(rf"(?<!{_L}){_L}*?({_L})\1{_L}*+")
_RUN_HINT = re.compile(rf"({_L})\1")
#: Single letters or look-alikes between up to three separators on a line; it ends in a letter or digit.
_SEP = r"(?:[^\w\n@$!|+€£(]|_){1,3}+"
_SPACED = re.compile(rf"(?<![^\W_])(?:{_L}|{_S})(?:{_SEP}(?:{_L}|{_S})){{2,}}(?<=[^\W_])(?![^\W_]|{_S})")


def _symbol(c: str) -> int:
    o = ord(c)
    return o - 96 if 97 <= o <= 122 else 27 + o % 32 if c.isalpha() else 0


def _options(c: str, before: str, spaced: bool, pair: bool = False, end: bool = False) -> list[tuple[str, float]]:
    if c.isalpha():
        return [(c, 0.0), ("", PAIR_COST if pair else DROP_COST)] if c == before else [(c, 0.0)]
    if spaced and c not in LOOKS and not c.isdigit():
        return [("", GAP_COST), (" ", STAY_COST)]
    return [*((x, LOOK_COST) for x in LOOKS.get(c, "")), *([("", DROP_COST)] if c == before else []), (" ", END_COST if end else BREAK_COST)]


def decode(passage: str, cost: np.ndarray, spaced: bool = False) -> str:
    """The most probable reading; cost[a, b, c] is that of symbol c after a and b."""
    paths = {(0, 0): (0.0, None)}
    before = ""
    low = passage.lower()
    tail = len(low.rstrip("@$!|+€£("))
    for i, c in enumerate(low):
        pair = c == before and low[i - 2 : i - 1] != c and low[i + 1 : i + 2] != c
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (sum_, path) in paths.items():
            for out, extra in _options(c, before, spaced, pair, i >= tail):
                if out == " " and b == 0 and path:
                    # One break is as good as several.
                    key, total, way = (a, b), sum_ + extra, path
                elif out:
                    s = _symbol(out)
                    key, total, way = (b, s), sum_ + extra + float(cost[a, b, s]), (path, out)
                else:
                    key, total, way = (a, b), sum_ + extra, path
                if key not in new or total < new[key][0]:
                    new[key] = (total, way)
        paths, before = new, c
    best = min(((v[0] + (float(cost[k[0], k[1], 0]) if k[1] else 0.0), v[1]) for k, v in paths.items()), key=lambda v: v[0])[1]
    out = []
    while best:
        best, c = best
        out.append(c)
    return "".join(reversed(out))


def restore(text: str, cost: np.ndarray, known: dict[tuple[str, bool], str] | None = None) -> str:
    """text with its lattices decoded."""
    known = {} if known is None else known

    def read(spaced):
        def one(m):
            if spaced and sum(c.isalpha() for c in m[0]) < 2:
                return m[0]
            k = (m[0], spaced)
            if k not in known:
                if len(known) > 200_000:
                    known.clear()
                known[k] = decode(m[0], cost, spaced)
            return known[k]

        return one

    text = _SPACED.sub(read(True), text)
    if _LEET_HINT.search(text):
        text = _LEET.sub(read(False), text)
    if _RUN_HINT.search(text):
        text = _RUN.sub(read(False), text)
    return text


def _trigrams(batches):
    total = np.zeros(SYMBOLS**3, np.int64)
    for batch in batches:
        for _, _, data, bounds in pieces(batch.column(0)):
            x, _ = letter_runs(data, bounds)
            s = np.where((x >= 97) & (x <= 122), x - 96, np.where(x == SPACE, 0, 27 + x % 32)).astype(np.int64)
            if len(s) > 2:
                total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["n"])


def _add(batches):
    total = None
    for batch in batches:
        for b in batch.column(0).to_pylist():
            total = np.frombuffer(b, np.int64).copy() if total is None else total + np.frombuffer(b, np.int64)
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["n"])


def character_model(texts: DataFrame) -> np.ndarray:
    """cost[a, b, c] = -log p(c | a, b) over the first column of texts."""
    _store.ship(texts.sparkSession)
    n = np.zeros(SYMBOLS**3, np.int64)
    for r in texts.mapInArrow(_trigrams, "n binary").repartition(16).mapInArrow(_add, "n binary").toLocalIterator():
        n += np.frombuffer(bytes(r["n"]), np.int64)
    n = n.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(np.float64)
    bi, uni = n.sum(0), n.sum((0, 1))
    p1 = (uni + 1) / (uni.sum() + SYMBOLS)
    p2 = (bi + 5 * p1) / (bi.sum(1, keepdims=True) + 5)
    p3 = (n + 5 * p2[None]) / (n.sum(2, keepdims=True) + 5)
    return -np.log(p3).astype(np.float32)


@dataclass
class Model:
    cost: np.ndarray
    weights: np.ndarray | None = None
    bias: float = 0.0
    temperature: float = 1.0
    known: dict = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"known": {}}


def _features(texts: list[str | None], cost: np.ndarray, known: dict):
    """Distinct features of the words and character n-grams of restored texts, slice by slice."""
    restored = pa.array([restore(t, cost, known) if t else "" for t in texts], pa.large_string())
    for lo, _, data, bounds in pieces(restored):
        x, at = letter_runs(data, bounds)
        f, to = hashed(x, at, ORDERS, BITS)
        # Whole words: the letters between spaces, folded into one hash.
        edge = np.ones(len(x), bool)
        edge[1:] = (x[1:] == SPACE) | (x[:-1] == SPACE)
        edge[at[:-1][at[:-1] < len(x)]] = True
        start = np.flatnonzero(edge & (x != SPACE))
        h = np.zeros(0, np.uint32)
        if len(start):
            place = np.arange(len(x)) - np.repeat(np.flatnonzero(edge), np.diff(np.append(np.flatnonzero(edge), len(x))))
            part = x * (np.uint32(0x9E3779B1) + place.astype(np.uint32) * np.uint32(0x85EBCA6A))
            every = np.flatnonzero(edge)
            h = np.add.reduceat(part, every, dtype=np.uint32)[x[every] != SPACE]
            h = ((h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - BITS)).astype(np.int32)
        first = np.searchsorted(start, at)
        for i in range(len(at) - 1):
            yield lo + i, np.unique(np.concatenate([f[to[i] : to[i + 1]], h[first[i] : first[i + 1]]]))


def _collect(cost):
    def run(batches):
        known: dict = {}
        for batch in batches:
            out = [f.astype("<i4").tobytes() for _, f in _features(batch.column("text").to_pylist(), cost.value, known)]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(out, pa.binary())], names=["y", "f"])

    return run


def _label_counts(batches):
    """Rows of each label, and rows of each label that have each feature."""
    total, seen = np.zeros(2, np.int64), np.zeros((2, 1 << BITS), np.int32)
    for batch in batches:
        for y, f in zip(batch.column("y").to_pylist(), batch.column("f"), strict=True):
            total[y] += 1
            seen[y, np.frombuffer(f.as_buffer(), "<i4")] += 1
    if total.any():
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([seen.tobytes()], pa.binary())], names=["n", "seen"])


def _chosen(at):
    """Of each row its label, a digest that orders rows, and the places of its chosen features."""

    def run(batches):
        for batch in batches:
            h, j = [], []
            for f in batch.column("f"):
                k = at.value[np.frombuffer(f.as_buffer(), "<i4")]
                h.append(hashlib.md5(f.as_buffer()).digest())
                j.append(k[k >= 0].astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(h, pa.binary()), pa.array(j, pa.binary())], names=["y", "h", "j"])

    return run


def fit(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", train: Column | None = None, per_label: int = PER_LABEL) -> Model:
    """A model of labels; the character model covers all of docs.  train selects rows of labels by their id column."""
    spark = docs.sparkSession
    model = Model(character_model(docs.select(_store.column(docs, text, "string")).na.drop()))
    rows = labels.filter(train) if train is not None else labels
    rows = rows.select(_store.column(labels, doc_id, "string").alias("id"), _store.column(labels, label, "int").alias("y")).filter("y IN (0, 1)").na.drop().groupBy("id").agg(F.max("y").alias("y"))
    order = Window.partitionBy("y").orderBy(F.xxhash64("id"), "id")
    # Bounded: per_label * (1 + CLEAN) rows.
    sample = rows.withColumn("k", F.row_number().over(order)).filter((F.col("k") <= per_label) | ((F.col("y") == 0) & (F.col("k") <= CLEAN * per_label))).select("id", "y")
    body = docs.select(_store.column(docs, doc_id, "string").alias("id"), _store.column(docs, text, "string").alias("text")).filter("text IS NOT NULL")
    again = Window.partitionBy("y").orderBy(F.xxhash64("id", "text"), "id", "text")
    got = body.join(F.broadcast(sample), "id").withColumn("k", F.row_number().over(again)).filter(F.col("k") <= CLEAN * per_label).select("y", "text")
    cost = spark.sparkContext.broadcast(model.cost)
    width = 1 << BITS
    with _store.scope(spark):
        # Features stay in a table; a fixed-size count of each label and then only the chosen ones come to the driver.
        rows = _store.stored(got.repartition(16, F.xxhash64("text")).mapInArrow(_collect(cost), "y int, f binary"), "features")
        seen, total = np.zeros((2, width)), np.zeros(2)
        for r in rows.mapInArrow(_label_counts, "n binary, seen binary").toLocalIterator():
            total += np.frombuffer(bytes(r["n"]), np.int64)
            seen += np.frombuffer(bytes(r["seen"]), np.int32).reshape(2, width)
        if not total.all():
            return model
        rate = (seen + 0.5) / (total[:, None] + 1)
        use = (seen[1] >= 3) & (rate[1] > 3 * rate[0])
        at = np.full(width, -1, np.int32)
        at[use] = np.arange(use.sum())
        chosen = rows.mapInArrow(_chosen(spark.sparkContext.broadcast(at)), "y int, h binary, j binary")
        data = sorted((r["y"], bytes(r["h"]), bytes(r["j"])) for r in chosen.toLocalIterator())
    x = [(np.frombuffer(j, "<i4"), np.ones(len(j) // 4), y) for y, _, j in data]
    held, kept = x[::5], [r for k, r in enumerate(x) if k % 5]
    w, b = ftrl(kept, 2, int(use.sum()), alpha=0.3, l1=0.2, l2=0.05, epochs=8)
    scores = np.array([w[:, i] @ v + b for i, v, _ in held])
    model.temperature = max(0.5, temperature(scores, np.array([y for _, _, y in held])))
    model.weights = np.zeros(width, np.float32)
    model.weights[use] = w[1] - w[0]
    model.bias = float(b[1] - b[0])
    return model


def _score(shared, text: str, schema: list[str]):
    def run(batches):
        m = shared.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            if m.weights is not None:
                for i, f in _features(batch.column(text).to_pylist(), m.cost, m.known):
                    out[i] = 1 / (1 + np.exp(-(float(m.weights[f].sum()) + m.bias) / m.temperature))
            made = {"score": pa.array(out), "predicted": pa.array((out >= 0.5).astype(np.int32))}
            yield pa.RecordBatch.from_arrays([made[c] if c in made else batch.column(c) for c in schema], names=schema)

    return run


def score(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns ``keep``) with score, from 0 to 1, and predicted."""
    spark = docs.sparkSession
    _store.ship(spark)
    carried = [c for c in (keep if keep is not None else docs.columns) if c.lower() not in MADE and not c.startswith(_store.OWN)]
    body = _store.OWN + "text"
    own = docs.select(*[F.col(f"`{c}`") for c in carried], _store.column(docs, text, "string").alias(body))
    fields = [*own.schema.fields[:-1], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return own.mapInArrow(_score(spark.sparkContext.broadcast(model), body, [f.name for f in fields]), T.StructType(fields))
