"""Substring deduplication by sliding spans of sentences.

A text is cut into sentences (after a word that ends in . ! or ? and at line ends; one of more than
``longest`` words is cut where the hash of two words is the least of its neighbours, so that the cuts of a shared
passage do not depend on what stands before it, and what is longer still after every ``longest`` words).  From each sentence the shortest run of
consecutive sentences that has ``several`` of them and ``words`` words is hashed, and likewise the
shortest run up to each sentence, so that a shared passage is covered to both of its ends.  Runs
meet by hash over the whole corpus; all occurrences but the first (by id, text hash and place)
lose the sentences they cover.

Runs travel packed, one row for each slice of texts and hash range; occurrences that are not
the first within their slice need not travel to be compared and are known at once, so a
passage that a third of all documents share is one entry for each slice.

Defined cases: null stays null and counts no sentences; empty texts stay; a document that loses
everything keeps its row with an empty text; rows of equal id and text are one document and
lose the same sentences; a null id comes after all others; an id that is not a number is
ordered by its hash; columns named like a result are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lethe.llm import _store
from lethe.llm._words import _GRAM, _powers, Words, ends, mix, pieces, room_for

SEVERAL = 3
WORDS = 20
LONGEST = 12
#: Words to either side among which a cut inside a long sentence has the least hash.
REACH = 3
BUCKET_BYTES = 96 << 20
MADE = ("n_sentences", "n_removed", "n_removed_words")
_RUN = np.dtype([("h", "<u8"), ("id", "<i8"), ("t", "<i8"), ("none", "u1"), ("s", "<u4"), ("e", "<u4")])
_ID, _NONE, _T, _TEXT, _CUTS = (_store.OWN + x for x in ("id", "none", "t", "text", "cuts"))


def sentences(w: Words, longest: int) -> np.ndarray:
    """First word of each sentence."""
    n = len(w)
    if not n:
        return np.zeros(0, np.int64)
    last = w.data[w.end - 1]
    stop = (last == ord(".")) | (last == ord("!")) | (last == ord("?"))
    lines = np.zeros(len(w.data) + 1, np.int64)
    np.cumsum(w.data == 10, out=lines[1:])
    stop[:-1] |= lines[w.start[1:]] > lines[w.end[:-1]]
    first = np.append(True, stop[:-1])
    first[w.ptr[:-1][w.ptr[:-1] < n]] = True
    at = np.flatnonzero(first)
    size = np.diff(np.append(at, n))
    place, of = np.arange(n) - np.repeat(at, size), np.repeat(size, size)
    first |= (of > longest) & _least(w.hash, place, of - place)
    at = np.flatnonzero(first)
    place = np.arange(n) - np.repeat(at, np.diff(np.append(at, n)))
    return np.flatnonzero(place % longest == 0)


def _least(h: np.ndarray, place: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Where the hash of a word and the one before it is least within REACH words of the same sentence; of equal ones, the first."""
    x = mix(np.append(np.uint64(0), h[:-1]) * _GRAM + h)
    ok = place > 0
    for d in range(1, min(REACH, len(h) - 1) + 1):
        ok[d:] &= (x[d:] < x[:-d]) | (place[d:] <= d)
        ok[:-d] &= (x[:-d] <= x[d:]) | (room[:-d] <= d)
    return ok


def runs(w: Words, several: int, words: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, word after the last, hash) of every run."""
    u, n = sentences(w, longest), len(w)
    if not len(u):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    edge = np.append(u, n)
    doc = np.searchsorted(w.ptr, u, "right") - 1
    lo, hi = np.searchsorted(u, w.ptr[:-1][doc]), np.searchsorted(u, w.ptr[1:][doc])
    k = np.arange(len(u))
    to = np.maximum(k + several, np.searchsorted(edge, u + words))
    ok = to <= hi
    fore = np.stack([k[ok], to[ok]], 1)
    by = np.minimum(k + 1 - several, np.searchsorted(edge, edge[1:] - words, "right") - 1)
    ok = by >= lo
    back = np.stack([by[ok], k[ok] + 1], 1)
    span = np.unique(np.concatenate([fore, back]), axis=0)
    s, e = edge[span[:, 0]], edge[span[:, 1]]
    up, down = _powers(room_for(max(n, len(w.data))))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(w.hash * up[:n], out=total[1:])
    return np.searchsorted(w.ptr, s, "right") - 1, s, e, mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))


def _first(x: np.ndarray) -> np.ndarray:
    """Which runs, sorted by hash and place, are or repeat the first one of their hash."""
    edge = np.flatnonzero(np.append(True, x["h"][1:] != x["h"][:-1]))
    lead = x[np.repeat(edge, np.diff(np.append(edge, len(x))))]
    return (lead["id"] == x["id"]) & (lead["t"] == x["t"]) & (lead["none"] == x["none"]) & (lead["s"] == x["s"])


def _sorted(x: np.ndarray) -> np.ndarray:
    return x[np.lexsort((x["s"], x["t"], x["id"], x["none"], x["h"]))]


def _pack(buckets: int, several: int, words: int, longest: int):
    """(bucket, blob): runs to compare by hash range, and below 0 runs known to go."""

    def run(batches):
        for batch in batches:
            ids, none, th = (batch.column(c).to_numpy(zero_copy_only=False) for c in (_ID, _NONE, _T))
            for lo, _, data, bounds in pieces(batch.column(_TEXT), 4 << 20):
                w = Words(data, bounds, "space")
                doc, s, e, h = runs(w, several, words, longest)
                x = np.empty(len(h), _RUN)
                x["h"], x["id"], x["t"], x["none"] = h, ids[lo + doc], th[lo + doc], none[lo + doc]
                x["s"], x["e"] = s - w.ptr[doc], e - w.ptr[doc]
                x = _sorted(x)
                first = _first(x) if len(x) else np.zeros(0, bool)
                go, x = x[~first], x[first]
                bucket = ((x["h"] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(x) else np.zeros(0, np.int64)
                rows = [int(bucket[i]) for i in edge]
                blobs = [x[a:b].tobytes() for a, b in zip(edge, ends(edge, len(x)), strict=True)]
                if len(go):
                    rows.append(-1 - int(go["h"][0] % np.uint64(buckets)))
                    blobs.append(go.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    return run


def _meet(table: pa.Table) -> pa.Table:
    """For each document of one hash range, the word spans that go."""
    x = np.concatenate([np.frombuffer(b.as_buffer(), _RUN) for b in table.column("blob")])
    if table.column("bucket")[0].as_py() >= 0:
        x = _sorted(x)
        x = x[~_first(x)]
    x = x[np.lexsort((x["s"], x["t"], x["id"], x["none"]))]
    key = x[["none", "id", "t"]]
    edge = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(x) else np.zeros(0, np.int64)
    spans = np.stack([x["s"], x["e"]], 1).astype("<u4") if len(x) else np.zeros((0, 2), "<u4")
    blobs = [spans[a:b].tobytes() for a, b in zip(edge, ends(edge, len(x)), strict=True)]
    return pa.table({_ID: pa.array(x["id"][edge]), _NONE: pa.array(x["none"][edge].astype(np.int64)), _T: pa.array(x["t"][edge]), _CUTS: pa.array(blobs, pa.binary())})


def _rewrite(text: str, schema: list[str], longest: int):
    def run(batches):
        for batch in batches:
            body, cuts = batch.column(_TEXT), batch.column(_CUTS).to_pylist()
            texts, n, gone, words = [], [], [], []
            null = body.is_null().to_pylist()
            for lo, hi, data, bounds in pieces(body):
                w = Words(data, bounds, "space")
                u = sentences(w, longest)
                at = np.searchsorted(u, w.ptr)
                for i in range(lo, hi):
                    a, b = int(w.ptr[i - lo]), int(w.ptr[i - lo + 1])
                    raw = data[bounds[i - lo] : bounds[i - lo + 1]]
                    out = np.zeros(b - a + 1, np.int32)
                    for blob in cuts[i] or ():
                        span = np.frombuffer(blob, "<u4").reshape(-1, 2)
                        np.add.at(out, span[:, 0], 1)
                        np.add.at(out, span[:, 1], -1)
                    out = np.cumsum(out)[:-1] > 0
                    if out.any():
                        # A word goes with the white space after it.
                        left = np.append(w.start[a:b], bounds[i - lo + 1]) - bounds[i - lo]
                        byte = np.zeros(len(raw) + 1, np.int32)
                        np.add.at(byte, left[:-1][out], 1)
                        np.add.at(byte, left[1:][out], -1)
                        raw = raw[np.cumsum(byte)[:-1] == 0]
                    texts.append(None if null[i] else raw.tobytes().decode("utf-8", "replace"))
                    n.append(int(at[i - lo + 1] - at[i - lo]))
                    gone.append(int(out[u[at[i - lo] : at[i - lo + 1]] - a].sum()))
                    words.append(int(out.sum()))
            made = {text: pa.array(texts, pa.string()), **{c: pa.array(v, pa.int64()) for c, v in zip(MADE, (n, gone, words), strict=True)}}
            yield pa.RecordBatch.from_arrays([made[c] if c in made else batch.column(c) for c in schema], names=schema)

    return run


def dedup(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", several: int = SEVERAL, words: int = WORDS, longest: int = LONGEST, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns ``keep`` and the text) without the sentences of repeated spans.

    Adds n_sentences, n_removed and n_removed_words.
    """
    spark = docs.sparkSession
    _store.ship(spark)
    carried = [c for c in (keep if keep is not None else docs.columns) if c.lower() not in MADE and c != text and not c.startswith(_store.OWN)]
    kind = dict(docs.dtypes).get(doc_id, "bigint")
    whole = kind in ("tinyint", "smallint", "int", "bigint")
    order = _store.column(docs, doc_id, "long") if whole else F.when(F.col(f"`{doc_id}`").isNotNull(), F.xxhash64(_store.column(docs, doc_id, "string")))
    body = _store.column(docs, text, "string")
    own = docs.select(*[F.col(f"`{c}`") for c in carried], F.coalesce(order, F.lit(0)).alias(_ID), order.isNull().cast("long").alias(_NONE), F.xxhash64(body).alias(_T), body.alias(_TEXT))
    size = docs.select(F.sum(F.octet_length(body))).first()[0] or 0
    # A sentence of about 40 bytes gives up to two runs.
    buckets = max(8, -(-(size // 20 * _RUN.itemsize) // BUCKET_BYTES))
    packed = own.select(_ID, _NONE, _T, _TEXT).mapInArrow(_pack(buckets, several, words, longest), "bucket long, blob binary")
    cuts = packed.groupBy("bucket").applyInArrow(_meet, f"{_ID} long, {_NONE} long, {_T} long, {_CUTS} binary")
    cuts = cuts.groupBy(_ID, _NONE, _T).agg(F.collect_list(_CUTS).alias(_CUTS))
    joined = own.join(cuts, [_ID, _NONE, _T], "left").select(*[F.col(f"`{c}`") for c in carried], _TEXT, _CUTS)
    fields = [*(f for f in joined.schema.fields if not f.name.startswith(_store.OWN)), T.StructField(text, T.StringType()), *(T.StructField(c, T.LongType()) for c in MADE)]
    return joined.mapInArrow(_rewrite(text, [f.name for f in fields], longest), T.StructType(fields))
