"""Exact Jaccard self-join of documents on word shingles by token-combination prefixes.

A document's set holds the hashes of its distinct shingles; equal sets form a class
and only classes are joined.  Tokens are ranked by the number of classes that hold
them, rarest first.  With an overlap of at least o two sets share a token among the
first n - o + 1 of each, and l tokens among the first n - o + l.  If the first shared token
is rare, it is indexed by itself.  Else all shared tokens are frequent: those are
dealt into c token classes by hash and the prefix is extended to l = c + 1, so that
some class holds two shared tokens, and the pairs within each class are indexed.  A
posting list of a frequent token is thus cut down to the sets that share two.

Counting sends every token once, packed by class and token range, and those that several classes hold back, packed by
range of class ids.  Sets in which too few tokens occur anywhere else cannot link and go no further.  Within a posting list
no pairs are formed at first: each member is verified against one centre, the links
merge components, and only members of components that are still apart are
compared further.  Those pairs must pass a bound on their symmetric difference: the tokens that
only one set of all holds, and the bits in which parity bitmaps of the others differ.  So a group of
copies costs about as many comparisons as it has members, and no link is lost.

Defined cases: null, empty and blank texts have no shingles and link with nothing;
fewer words than a shingle make one shingle of all of them; equal texts, repeated
rows and repeated ids share a class; an empty table gives no rows; a null id is
never the smallest; columns named like a result are replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lethe.llm import _store
from lethe.llm._graph import connect_members
from lethe.llm._words import Words, ends, grams, mix, pieces

SHINGLE = 5
#: A link: 100 * intersection >= 75 * union, so 7 * intersection >= 3 * (a + b).
PERCENT = 75
#: Tokens in at most this many classes are rare.
RARE = 32
#: Tokens that one counting task holds at a time.
BUCKET_TOKENS = 1_000_000
#: Rounds of comparing with centres before what is left is compared pairwise.
ROUNDS = 2
#: Longs of a parity bitmap.
LONGS = 8
_BITS = [f"b{k}" for k in range(LONGS)]
MADE = ("n_shingles", "component_id", "n_links")
_CLS, _N, _ID, _TEXT, _HASH, _ROOT = (_store.OWN + x for x in ("cls", "n", "id", "text", "hash", "root"))
_ENTRY = np.dtype([("t", "<u8"), ("f", "<u4")])


def need(a, b, percent: int = PERCENT):
    """Smallest intersection with which sets of a and b tokens link."""
    return -(-percent * (a + b) // (100 + percent))


def shingle_sets(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text, and how many each has."""
    count = w.counts()
    h = grams(w.hash, n)
    out, sizes = [], np.zeros(len(count), np.int64)
    for i in np.flatnonzero(count):
        lo, c = int(w.ptr[i]), int(count[i])
        s = np.sort(h[lo : lo + c - n + 1]) if c >= n else grams(w.hash[lo : lo + c], c)[:1]
        s = s[np.append(True, s[1:] != s[:-1])]
        out.append(s)
        sizes[i] = len(s)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), sizes


def class_ids(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """16 bytes that equal sets share; rows of empty sets are zero."""
    ids = np.zeros((len(sizes), 2), "<u8")
    full = np.flatnonzero(sizes)
    if len(full):
        first = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        ids[full, 0] = np.add.reduceat(mix(tokens ^ np.uint64(0x5851F42D4C957F2D)), first)
        ids[full, 1] = np.add.reduceat(mix(tokens + np.uint64(0x14057B7EF767814F)), first)
    return ids


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _digest(text: str, schema: list[str], n: int):
    def run(batches):
        for batch in batches:
            ids, sizes = [], []
            for _, _, data, bounds in pieces(batch.column(text)):
                tokens, count = shingle_sets(Words(data, bounds, "space"), n)
                ids.append(class_ids(tokens, count))
                sizes.append(count)
            raw = np.concatenate(ids) if ids else np.zeros((0, 2), "<u8")
            made = {_N: pa.array(np.concatenate(sizes) if sizes else np.zeros(0, np.int64)), _CLS: _binary(raw, np.arange(len(raw) + 1) * 16)}
            yield pa.RecordBatch.from_arrays([made.get(c) if c in made else batch.column(c) for c in schema], names=schema)

    return run


def _pack(n: int, buckets: int):
    """(bucket, blob): the classes of a slice of texts and their tokens in one token range."""

    def run(batches):
        for batch in batches:
            for _, _, data, bounds in pieces(batch.column(0)):
                tokens, sizes = shingle_sets(Words(data, bounds, "space"), n)
                ids = class_ids(tokens, sizes)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                first = np.zeros(len(sizes), bool)
                first[np.unique(ids.view("V16").ravel(), return_index=True)[1]] = True
                tokens, owner = tokens[first[owner]], owner[first[owner]]
                bucket = _bucket(tokens, buckets)
                order = np.argsort(bucket, kind="stable")
                tokens, owner, bucket = tokens[order], owner[order], bucket[order]
                edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
                rows, blobs = [], []
                for lo, hi in zip(edge, ends(edge, len(bucket)), strict=True):
                    at = np.flatnonzero(np.append(True, owner[lo + 1 : hi] != owner[lo : hi - 1]))
                    count = np.diff(np.append(at, hi - lo)).astype("<u4")
                    rows.append(int(bucket[lo]))
                    blobs.append(np.array([len(at)], "<u8").tobytes() + ids[owner[lo:hi][at]].tobytes() + sizes[owner[lo:hi][at]].astype("<u4").tobytes() + count.tobytes() + tokens[lo:hi].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    return run


def _bucket(tokens: np.ndarray, buckets: int) -> np.ndarray:
    return ((tokens >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _unpack(blobs, item: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of packed classes: ids, set sizes, how many items each has, and the items."""
    parts = []
    for b in blobs:
        k = int(np.frombuffer(b, "<u8", 1)[0])
        parts.append((np.frombuffer(b, "V16", k, 8), np.frombuffer(b, "<u4", k, 8 + 16 * k), np.frombuffer(b, "<u4", k, 8 + 20 * k), np.frombuffer(b, item, -1, 8 + 24 * k)))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _blobs(table: pa.Table) -> list:
    return [b.as_buffer() for b in table.column("blob")]


def _count(parts: int):
    """Of one token range: the tokens of each class that other classes hold too, packed by range of class ids."""

    def run(table: pa.Table) -> pa.Table:
        ids, sizes, counts, tokens = _unpack(_blobs(table), np.dtype("<u8"))
        first = np.zeros(len(ids), bool)
        first[np.unique(ids, return_index=True)[1]] = True
        tokens = tokens[np.repeat(first, counts)]
        ids, sizes, counts = ids[first], sizes[first], counts[first]
        order = np.argsort(tokens)
        s = tokens[order]
        edge = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        df = np.diff(np.append(edge, len(s)))
        freq = np.empty(len(s), np.uint32)
        freq[order] = np.repeat(df, df)
        shared = freq > 1
        entry = np.empty(int(shared.sum()), _ENTRY)
        entry["t"], entry["f"] = tokens[shared], freq[shared]
        per = np.bincount(np.repeat(np.arange(len(ids)), counts)[shared], minlength=len(ids))
        part = (np.ascontiguousarray(ids).view("<u8").reshape(-1, 2)[:, 0] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
        has = np.flatnonzero(per)
        has = has[np.argsort(part[has], kind="stable")]
        start = np.cumsum(per) - per
        rows, blobs = [], []
        edge = np.flatnonzero(np.append(True, part[has][1:] != part[has][:-1])) if len(has) else np.zeros(0, np.int64)
        for lo, hi in zip(edge, ends(edge, len(has)), strict=True):
            own = has[lo:hi]
            at = np.repeat(start[own] - np.append(0, np.cumsum(per[own])[:-1]), per[own]) + np.arange(per[own].sum())
            rows.append(int(part[own[0]]))
            blobs.append(np.array([len(own)], "<u8").tobytes() + ids[own].tobytes() + sizes[own].tobytes() + per[own].astype("<u4").tobytes() + entry[at].tobytes())
        return pa.table({"part": pa.array(rows, pa.int64()), "blob": pa.array(blobs, pa.binary())})

    return run


def _assemble(percent: int):
    """Of one range of class ids: each class that may link, with the tokens that others hold too.  Of n tokens at least percent % must be such."""

    def run(table: pa.Table) -> pa.Table:
        ids, sizes, counts, entry = _unpack(_blobs(table), _ENTRY)
        _, first, of = np.unique(ids, return_index=True, return_inverse=True)
        entry = entry[np.argsort(np.repeat(of, counts), kind="stable")]
        m = np.bincount(of, weights=counts, minlength=len(first)).astype(np.int64)
        n, to = sizes[first].astype(np.int64), np.append(0, np.cumsum(m))
        ok = np.flatnonzero(100 * m >= percent * n)
        names = np.ascontiguousarray(ids[first[ok]])
        raw = [entry[to[i] : to[i + 1]].tobytes() for i in ok]
        return pa.table({"cls": _binary(names.view(np.uint8), np.arange(len(ok) + 1) * 16), "n": pa.array(n[ok]), "entry": pa.array(raw, pa.binary())})

    return run


def bands(n: int) -> list[tuple[int, int]]:
    """(band, its smallest size) of the smaller set of any pair that a set of n may link in."""
    b = band(n)
    return [(x, math.ceil((4 / 3) ** x - 1e-9)) for x in (b - 1, b) if x >= 0]


def band(n: int) -> int:
    """Sizes of a band lie within a factor of 4/3, so a link joins the same or adjacent bands."""
    b = int(math.log(n) / math.log(4 / 3))
    while math.ceil((4 / 3) ** (b + 1) - 1e-9) <= n:
        b += 1
    while b and math.ceil((4 / 3) ** b - 1e-9) > n:
        b -= 1
    return b


def signatures(entry: np.ndarray, n: int, percent: int = PERCENT, rare: int = RARE) -> np.ndarray:
    """Index keys of a set: rare single tokens and pairs of frequent ones, by size band.

    entry: the tokens that others hold too, in rank order; the other n - len(entry) rank before.
    """
    alone, out = n - len(entry), []
    for b, smallest in bands(n):
        other = max(smallest, -(-percent * n // 100))
        least = int(need(n, other, percent))
        salt = mix(np.array([b + 1], np.uint64))[0]
        first = entry[: max(0, n - least + 1 - alone)]
        out.append(mix(first["t"][first["f"] <= rare] ^ salt))
        if not len(first) or first["f"][-1] <= rare:
            continue
        groups = max(1, min(128, smallest // 8))
        both = int(need(smallest, smallest, percent))
        if both < 2:  # one shared token can be all there is
            out.append(mix(first["t"][first["f"] > rare] ^ salt))
            continue
        groups = min(groups, both - 1)
        more = entry[: max(0, n - least + 1 + groups - alone)]
        t = np.sort(more["t"][more["f"] > rare])
        of = mix(t + np.uint64(7)) % np.uint64(groups)
        for g in np.unique(of):
            x = t[of == g]
            i, j = np.triu_indices(len(x), 1)
            out.append(mix(mix(x[i] ^ salt) + x[j] + np.uint64(1)))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def _index(percent: int, rare: int, emit: bool):
    """Of each class: its tokens in one blob, or its signatures."""

    def run(batches):
        for batch in batches:
            ids, ns = batch.column("cls").to_pylist(), batch.column("n").to_pylist()
            sets, sigs, of, held = [], [], [], []
            for i, blob in enumerate(batch.column("entry")):
                e = np.frombuffer(blob.as_buffer(), _ENTRY)
                held.append(len(e))
                if emit:
                    s = signatures(e[np.lexsort((e["t"], e["f"]))], ns[i], percent, rare)
                    sigs.append(s.view(np.int64))
                    of.append(np.full(len(s), i))
                else:
                    sets.append(np.sort(e["t"]).tobytes())
            if emit:
                at = pa.array(np.concatenate(of)) if of else pa.array([], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs) if sigs else [], pa.int64()), pa.array(ids, pa.binary()).take(at), pa.array(ns, pa.int64()).take(at), pa.array(held, pa.int64()).take(at)], names=["sig", "cls", "n", "m"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(ns, pa.int64()), pa.array(sets, pa.binary())], names=["cls", "n", "tokens"])

    return run


def parity(tokens: np.ndarray) -> np.ndarray:
    """Bitmap of the parities of token counts: sets differ in at least as many tokens as their bitmaps do in bits."""
    of = (mix(tokens + np.uint64(0x9E3779B9)) % np.uint64(64 * LONGS)).astype(np.int64)
    return np.packbits(np.bincount(of, minlength=64 * LONGS).astype(np.uint8) & 1).view(np.int64)


def _parities(batches):
    """The parity bitmap of each class."""
    for batch in batches:
        maps = [parity(np.frombuffer(b.as_buffer(), _ENTRY)["t"]) for b in batch.column("entry")]
        cols = np.array(maps, np.int64).reshape(-1, LONGS).T
        yield pa.RecordBatch.from_arrays([batch.column("cls"), *(pa.array(np.ascontiguousarray(c)) for c in cols)], names=["cls", *_BITS])


def _verify(batches):
    """Adds the intersection of the two sets of each pair."""
    for batch in batches:
        got = []
        for x, y in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), strict=True):
            got.append(len(np.intersect1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), assume_unique=True)))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "b", "na", "nb")), pa.array(got, pa.int64())], names=["a", "b", "na", "nb", "common"])


_PAIR = "a binary, b binary, na long, nb long, common long"


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that link."""
    one = pairs.join(sets.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta")), "a")
    both = one.join(sets.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb")), "b").select("a", "b", "na", "nb", "ta", "tb")
    return both.mapInArrow(_verify, _PAIR).filter(f"{100 + percent}L * common >= {percent}L * (na + nb)").select("a", "b")


def _rooted(docs: DataFrame, carried: list[str], text: str, doc_id: str, shingle: int, percent: int, rare: int) -> DataFrame:
    """Columns carried of docs, and the id, text hash, set size and root class (null without shingles) of each row."""
    spark = docs.sparkSession
    _store.ship(spark)
    own = docs.select(*[F.col(f"`{c}`") for c in carried], _store.column(docs, doc_id, "string" if dict(docs.dtypes).get(doc_id) == "string" else "long").alias(_ID), _store.column(docs, text, "string").alias(_TEXT)).withColumn(_HASH, F.xxhash64(_TEXT))
    fields = [*(f for f in own.schema.fields if f.name != _TEXT), T.StructField(_N, T.LongType()), T.StructField(_CLS, T.BinaryType())]
    with _store.scope(spark) as keep:
        rows = keep(_store.stored(own.mapInArrow(_digest(_TEXT, [f.name for f in fields], shingle), T.StructType(fields)), "shingles"))
        total = rows.select(F.sum(_N)).first()[0] or 0
        buckets = max(8, -(-total // BUCKET_TOKENS))

        packed = docs.select(_store.column(docs, text, "string").alias("text")).filter(F.col("text").isNotNull()).mapInArrow(_pack(shingle, buckets), "bucket long, blob binary")
        counted = packed.groupBy("bucket").applyInArrow(_count(buckets), "part long, blob binary")
        parts = _store.stored(counted.groupBy("part").applyInArrow(_assemble(percent), "cls binary, n long, entry binary"), "sets")
        sets = parts.mapInArrow(_index(percent, rare, False), "cls binary, n long, tokens binary")
        every = _store.stored(parts.mapInArrow(_index(percent, rare, True), "sig long, cls binary, n long, m long"), "signatures")
        may = f"{100 + percent}L * least(x_m, y_m) >= {percent}L * (x_n + y_n)"
        # Link: 2 * common = x_n + y_n - difference.
        differ = " + ".join(["x_n - x_m + y_n - y_m", *(f"bit_count(x_{b} ^ y_{b})" for b in _BITS)])
        near = f"{100 + percent}L * ({differ}) <= {100 - percent}L * (x_n + y_n)"
        maps = parts.mapInArrow(_parities, ", ".join(["cls binary", *(f"{b} long" for b in _BITS)]))
        # What a group's members were made from has the fewest tokens of its own.
        roots = keep(connect_members(every, ["n", "m"], may, lambda pairs: _verified(pairs, sets, percent), rounds=ROUNDS, central="n - m", near="x_n - x_m + y_n - y_m", last=(maps, near)))
    roots = roots.select(F.col("node").alias(_CLS), F.col("root").alias(_ROOT))
    return rows.join(roots, _CLS, "left").withColumn(_ROOT, F.when(F.col(_N) > 0, F.coalesce(_ROOT, _CLS)))


def find_components(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, percent: int = PERCENT, rare: int = RARE, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns ``keep``) with n_shingles and component_id, the smallest id reachable by links.

    Rows without shingles are their own component.
    """
    carried = [c for c in (keep if keep is not None else docs.columns) if c.lower() not in MADE and not c.startswith(_store.OWN)]
    rows = _rooted(docs, carried, text, doc_id, shingle, percent, rare)
    out = [*[F.col(f"`{c}`") for c in carried], F.col(_N).alias("n_shingles")]
    full = rows.filter(F.col(_N) > 0)
    least = full.groupBy(_ROOT).agg(F.min(_ID).alias("component_id"))
    return full.join(least, _ROOT).select(*out, "component_id").unionByName(rows.filter(F.col(_N) == 0).select(*out, F.col(_ID).alias("component_id")))


def keep_one(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, percent: int = PERCENT, rare: int = RARE) -> DataFrame:
    """One row of each component, and every row without shingles.

    The row with the smallest id stays (an id before none); of rows that repeat it the one whose text
    hashes lowest, and of rows that repeat that too any one.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{i}_" for i in range(len(names))])
    key, body = f"c{names.index(doc_id)}_", f"c{names.index(text)}_"
    rows = _rooted(plain, plain.columns, body, key, shingle, percent, rare)
    full = rows.filter(F.col(_N) > 0).withColumn("w", F.struct(F.col(_ID).isNull(), _ID, _HASH))
    ties = full.groupBy(_ROOT, "w").agg(F.count("*").alias("c"))
    best = ties.groupBy(_ROOT).agg(F.min(F.struct("w", "c")).alias("x")).select(_ROOT, F.col("x.w").alias("bw"), F.col("x.c").alias("bc"))
    first = full.join(best, _ROOT).filter("w IS NOT DISTINCT FROM bw")
    out = first.filter("bc = 1").select(plain.columns).unionByName(first.filter("bc > 1").dropDuplicates([_ROOT]).select(plain.columns))
    return out.unionByName(rows.filter(F.col(_N) == 0).select(plain.columns)).toDF(*names)
