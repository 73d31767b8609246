"""Benchmark decontamination by winnowed fingerprints.

Every item and every document is cut into lower-cased words.  The k-gram hashes
of a text are winnowed: of every ``window - k + 1`` consecutive ones the smallest
is kept (the rightmost of equal ones).  Two texts that share ``window`` words in a
row share all k-grams in that span and so keep the same one; a document that has
none of an item's fingerprints has none of its windows.  Each fingerprint that
is found is extended to the windows that hold it, whose hashes decide.  Items of
fewer words than a window can fall between fingerprints, so each is looked
for as one whole gram.

Only the benchmark is sent to the executors, in blocks of bounded size, each one
against all documents in one pass without a shuffle; documents are never
collected.

Defined cases: a null or empty text has no words and is not contaminated; an item
without words never occurs; equal item ids count once and a null id is written as
an empty string; repeated documents are judged row by row; without items no
document is contaminated; input columns named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lethe.llm import _store
from lethe.llm._words import Words, grams, grams_at, pieces

WINDOW = 13
K = 5
#: Bytes of item texts sent to the executors at a time.
BLOCK_BYTES = 16 << 20
MADE = ("n_words", "n_hit", "items", "n_items", "items_sha256", "contaminated")
_SPANS, _ITEMS, _N = (_store.OWN + x for x in ("spans", "items", "n"))

_SPAN = T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))
_ARROW_SPAN = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def winnow(words: Words, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the k-grams that winnowing keeps."""
    h = grams(words.hash, k)
    n = len(h)
    best = h.copy()
    at = np.arange(n)
    for j in range(1, window - k + 1):
        if j >= n:
            break
        less = h[j:] <= best[: n - j]
        best[: n - j][less] = h[j:][less]
        at[: n - j][less] = np.flatnonzero(less) + j
    keep = np.zeros(n, bool)
    keep[at[words.room() >= window]] = True
    found = np.flatnonzero(keep)
    return found, h[found]


class Index:
    """Fingerprints and windows of one block of items."""

    def __init__(self, ids: list[str], texts: list[str], window: int, k: int):
        self.window, self.k, self.ids = window, k, ids
        marks, self.grams = [], {}
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for lo, hi, data, bounds in pieces(pa.array(texts, pa.large_string())):
            w = Words(data, bounds, "alnum")
            marks.append(winnow(w, window, k)[1])
            owner, count, room = w.doc(), w.counts(), w.room()
            for n in {min(int(c), window) for c in count if c}:
                pos = np.flatnonzero((room >= n) & (np.minimum(count, window)[owner] == n))
                found.setdefault(n, []).append((grams(w.hash, n)[pos], owner[pos] + lo))
        self.marks = np.unique(np.concatenate(marks)) if marks else np.zeros(0, np.uint64)
        for n, parts in found.items():
            h, item = (np.concatenate(x) for x in zip(*parts, strict=True))
            pair = np.unique(np.stack([h, item.astype(np.uint64)], 1), axis=0)
            keys, first = np.unique(pair[:, 0], return_index=True)
            self.grams[n] = (keys, np.append(first, len(pair)), pair[:, 1].astype(np.int64))

    def hits(self, w: Words) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first word, words, items) of each window of an item that occurs."""
        room = w.room()
        for n, (keys, first, item) in sorted(self.grams.items()):
            if n == self.window:
                pos, h = winnow(w, self.window, self.k)
                pos = pos[_among(h, self.marks)]
                spread = (pos[:, None] - np.arange(self.window - self.k + 1)).ravel()
                pos = np.unique(spread[spread >= 0])
                pos = pos[room[pos] >= n]
            else:
                pos = np.flatnonzero(room >= n)
            h = grams_at(w.hash, pos, n)
            ok = _among(h, keys)
            for p, at in zip(pos[ok], np.searchsorted(keys, h[ok]), strict=True):
                yield int(p), n, item[first[at] : first[at + 1]]


def _among(x: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(x), bool)
    return keys[np.minimum(np.searchsorted(keys, x), len(keys) - 1)] == x


def _scan(index_of, text: str, schema: pa.Schema):
    def run(batches):
        index = index_of.value
        for batch in batches:
            n_words, spans, items = [], [], []
            for _, _, data, bounds in pieces(batch.column(text)):
                w = Words(data, bounds, "alnum")
                doc, own = w.doc(), {}
                for p, n, its in index.hits(w):
                    d = own.setdefault(int(doc[p]), ([], set()))
                    d[0].append((p - int(w.ptr[doc[p]]), n))
                    d[1].update(its.tolist())
                for i, c in enumerate(w.counts().tolist()):
                    s, its = own.get(i, ((), ()))
                    n_words.append(c)
                    spans.append([{"a": a, "b": b} for a, b in _merge(s)])
                    items.append([index.ids[j] for j in its])
            made = {_N: pa.array(n_words, pa.int64()), _SPANS: pa.array(spans, _ARROW_SPAN), _ITEMS: pa.array(items, pa.list_(pa.string()))}
            old = {c: batch.column(c) for c in batch.schema.names}
            if _SPANS in old:
                made[_SPANS] = pa.array([a + b for a, b in zip(old[_SPANS].to_pylist(), spans, strict=True)], _ARROW_SPAN)
                made[_ITEMS] = pa.array([a + b for a, b in zip(old[_ITEMS].to_pylist(), items, strict=True)], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([made.get(c, old.get(c)) for c in schema], names=list(schema))

    return run


def _merge(spans) -> list[tuple[int, int]]:
    """Disjoint (start, end) that cover the (start, length) given."""
    out: list[list[int]] = []
    for p, n in sorted(spans):
        if out and p <= out[-1][1]:
            out[-1][1] = max(out[-1][1], p + n)
        else:
            out.append([p, p + n])
    return [tuple(x) for x in out]


def _covered():
    """Words that the spans of all blocks cover."""
    step = "struct(s.n + greatest(0L, x.b - greatest(x.a, s.e)) AS n, greatest(s.e, x.b) AS e)"
    return F.expr(f"aggregate(array_sort({_SPANS}), struct(0L AS n, 0L AS e), (s, x) -> {step}, s -> s.n)")


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, k: int = K, keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs (or its columns ``keep``) with the words and items hit in each row.

    Adds n_words, n_hit, items (the sorted ids), n_items, items_sha256 and contaminated
    (5 % of the words or more are hit).
    """
    spark = docs.sparkSession
    _store.ship(spark)
    items = benchmark.select(F.coalesce(_store.column(benchmark, item_id, "string"), F.lit("")).alias("i"), F.coalesce(_store.column(benchmark, item_text, "string"), F.lit("")).alias("t")).distinct()
    total = items.select(F.sum(F.octet_length("t") + F.octet_length("i"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    df = docs.withColumn(text, _store.column(docs, text, "string"))
    carried = [c for c in (keep if keep is not None else docs.columns) if c.lower() not in MADE and not c.startswith(_store.OWN)]
    df = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*carried, text])])
    base = df.schema
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).collect()
        index = spark.sparkContext.broadcast(Index([r["i"] for r in rows], [r["t"] for r in rows], window, k))
        fields = [*base.fields, T.StructField(_N, T.LongType()), T.StructField(_SPANS, _SPAN), T.StructField(_ITEMS, T.ArrayType(T.StringType()))]
        if b == blocks - 1:
            fields = [f for f in fields if f.name in carried or f.name.startswith(_store.OWN)]
        df = df.mapInArrow(_scan(index, text, [f.name for f in fields]), T.StructType(fields))
        if b < blocks - 1:
            df = _store.cut(df)
    df = df.select(*[F.col(f"`{c}`") for c in carried], F.col(_N).alias("n_words"), _covered().alias("n_hit"), F.array_sort(F.array_distinct(_ITEMS)).alias("items"))
    return df.withColumns({"n_items": F.size("items").cast("long"), "items_sha256": F.sha2(F.array_join("items", ","), 256), "contaminated": (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))})


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that are not contaminated, with docs' own columns."""
    names, text = docs.columns, options.pop("text", "text")
    own = docs.toDF(*[f"c{i}_" for i in range(len(names))])
    found = find_contamination(own, benchmark, text=f"c{names.index(text)}_", **options)
    return found.filter(~F.col("contaminated")).select(*[F.col(f"c{i}_").alias(n) for i, n in enumerate(names)])
