"""Every stage of the pipeline against brute force on small tables, and what the operators leave behind."""

import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lethe.llm import _graph, _store, line_dedup, license_scan, quality

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_removed string, C0_ string"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark, rows):
    return spark.createDataFrame([(i, t, la, s, None if t is None else len(t), "own", None) for i, t, la, s in rows], SCHEMA)


def lines_of(text):
    return [re.sub(r"[\W_]+", " ", x.lower()).strip() for x in text.split("\n")] if text is not None else []


def distance(a, b, most):
    if abs(len(a) - len(b)) > most:
        return most + 1
    x, y = (np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in (a, b))
    row, k = np.arange(len(y) + 1), np.arange(len(y) + 1)
    for i in range(len(x)):
        new = np.append(i + 1, np.minimum(row[1:] + 1, row[:-1] + (y != x[i])))
        row = np.minimum.accumulate(new - k) + k
    return int(row[-1])


def near_pairs(lines):
    """All pairs of different lines whose edit similarity is 90 % or more."""
    size = np.array([len(x) for x in lines])
    bags = np.zeros((len(lines), 64), np.int32)
    for i, x in enumerate(lines):
        bags[i] = np.bincount([ord(c) % 64 for c in x], minlength=64)
    out = []
    for i in np.argsort(size):
        most = np.maximum(size, size[i]) * 10 // 100
        ok = (size >= size[i]) & (size - size[i] <= most) & (np.abs(bags - bags[i]).sum(1) <= 2 * most)
        out += [(int(i), int(j)) for j in np.flatnonzero(ok) if j != i and (size[j] > size[i] or j > i) and distance(lines[i], lines[j], int(most[j])) <= most[j]]
    return out


def test_fuzzy_lines_are_found_as_brute_force_finds_them(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    left = {}
    for r in line_dedup.dedup(docs, least_equal=1).collect():
        for x in lines_of(r["text"]):
            left[x] = left.get(x, 0) + 1
    every = sorted({x for r in docs.collect() for x in lines_of(r["text"]) if x.count(" ") >= line_dedup.LEAST_WORDS - 1})
    pairs = near_pairs(every)
    found = [left.get(every[i], 0) + left.get(every[j], 0) <= 1 for i, j in pairs]
    assert len(pairs) > 30 and np.mean(found) >= 0.9
    # Nothing goes that is not like another line.
    assert all(left.get(x) for x in set(every) - {every[k] for p in pairs for k in p})


@pytest.mark.parametrize("edit", ["letter", "word"])
def test_recall_of_edited_lines(spark, edit):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("etaoinshrdlucm") for _ in range(rng.randint(2, 8)))
    rows = []
    for i in range(100):
        line = [word() for _ in range(26)]
        other, k = list(line), rng.randrange(26)
        other[k] = word()[:5] if edit == "word" else "z" + other[k][1:]
        rows += [(2 * i, " ".join(line)), (2 * i + 1, " ".join(other))]
    got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).filter("n_removed = 1").count()
    assert got >= 90


def test_line_dedup_of_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, long, "mine"), (2, long + " more", "mine"), (3, "天地玄黃宇宙洪荒日月盈昃辰宿列張", "x"), (4, "天地玄黃宇宙洪荒日月盈昃辰宿列張\nक्या की का के को कु", "x"), (5, "क्या कि को के को कु", "x"), (5, None, "x"), (None, "क्या कि को के को कु", "x")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, N_LINES string, extra string")
    got = line_dedup.dedup(docs, least_equal=1)
    assert got.columns == ["doc_id", "extra", "text", "n_lines", "n_removed"]
    text = sorted((r["doc_id"] or 99, r["text"] or "", r["n_removed"]) for r in got.collect())
    assert text == sorted([(1, long, 0), (2, "", 1), (3, rows[2][1], 0), (4, "क्या की का के को कु", 1), (5, rows[4][1], 0), (5, "", 0), (99, "", 1)])
    assert line_dedup.dedup(docs.limit(0)).count() == 0


def test_components_and_what_is_left_in_the_shared_folder(spark):
    links = [(1, 2), (3, 2), (4, 5), (9, 8), (8, 7), (7, 6), (6, 4), (None, 1), (3, 3)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r["node"]: r["root"] for r in _graph.components(df).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: 4, 8: 4, 9: 4} and _graph.components(df.limit(0)).count() == 0
    few, _graph.FEW = _graph.FEW, 0
    try:
        assert {r["node"]: r["root"] for r in _graph.components(df).collect()} == got
    finally:
        _graph.FEW = few
    folder = _store.shared_dir(spark).removeprefix("file://").removeprefix("file:")
    before = set(os.listdir(folder))
    with _store.scope(spark) as keep:
        kept = keep(_store.stored(df, "kept"))
        _store.stored(df, "gone")
    assert {x.split("-")[1] for x in set(os.listdir(folder)) - before} == {"kept"} and kept.count() == len(links)


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(4)
    base = {la: [w for w in quality.COMMON[la]] for la in ("en", "de")}
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(3, 9)))
    text = lambda la, n: " ".join(rng.choice(base[la]) if rng.random() < 0.4 else word() for _ in range(n))
    rows = [(i, text("en", 60) + "\n" + text("en", 40), "en", "ab"[i % 2]) for i in range(60)] + [(100 + i, text("de", 80), "de", None) for i in range(40)]
    rows += [(200, rows[0][1].replace("\n", " \n"), "en", "a"), (201, rows[1][1].split("\n")[0] + "\n" + text("en", 50), "en", "b"), (202, None, "en", "a"), (203, "", None, "b"), (204, "12 34", "de", "a")]
    words = rows[5][1].split()
    near = " ".join([*words[:50], "changed", *words[51:]])
    rows += [(205, near, "en", "a"), (300, text("en", 30) + " " + " ".join(rows[40][1].split()[:20]), "en", "b"), (5, rows[5][1], "en", "b")]
    rows += [(306, " ".join(f"q{i}" for i in range(20)) + " " + text("en", 60), "en", "a")]
    docs = table(spark, rows)
    spark.createDataFrame([(1, " ".join(f"q{i}" for i in range(15))), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    names, at = docs.columns, [0]

    def run(k, df):
        at[0] += 1
        corpus_pipeline.STAGES[k][1](spark, df, str(tmp_path)).write.parquet(f"{tmp_path}/{at[0]}")
        return spark.read.parquet(f"{tmp_path}/{at[0]}")

    one = run(0, docs)
    assert one.columns == names and sorted(r["doc_id"] for r in one.collect()) == sorted(i for i, t, *_ in rows if t and re.search("[a-z]", t))
    two = run(1, one)
    first, want = {}, []
    kept = sorted((r for r in rows if r[1] and re.search("[a-z]", r[1])), key=lambda r: r[0])
    copies = {}
    for i, t, *_ in kept:
        lines = []
        for raw, norm in zip(t.split("\n"), lines_of(t), strict=True):
            owner = first.setdefault(norm, (i, t, len(lines)))
            if not norm or owner[:2] == (i, t):
                lines.append(raw)
        copies[(i, t)] = "\n".join(lines)
        if "\n".join(lines) == t or re.search(r"\S", "\n".join(lines)):
            want.append((i, "\n".join(lines)))
    got = two.collect()
    assert two.columns == names and sorted((r["doc_id"], r["text"]) for r in got) == sorted(want)
    assert all(r["n_removed"] == "own" and r["n_chars"] == len(r["text"]) for r in got)
    three = run(2, two)
    sets = {}
    for k, (i, t) in enumerate(sorted(want)):
        w = re.findall(WORD, t.lower())
        sets[k] = (i, {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    root = {k: k for k in sets}
    for a in sets:
        for b in sets:
            x, y = sets[a][1], sets[b][1]
            if x and 100 * len(x & y) >= 75 * len(x | y):
                lo, hi = sorted((root[a], root[b]))
                root = {k: lo if v == hi else v for k, v in root.items()}
    assert three.columns == names and sorted(r["doc_id"] for r in three.collect()) == sorted(sets[k][0] for k in set(root.values()))
    four = run(3, three)
    assert four.columns == names and {r["doc_id"] for r in three.collect()} - {r["doc_id"] for r in four.collect()} == {306}
    five = run(4, four).collect()
    size = {r["doc_id"]: len(re.findall(WORD, r["text"])) for r in four.collect()}
    assert all(r["copies"] in (1, 2) and r["taken"] == r["copies"] * size[r["doc_id"]] for r in five)
    for k in range(5):
        assert corpus_pipeline.STAGES[k][1](spark, docs.limit(0), str(tmp_path)).count() == 0
    bare = one.drop("n_chars")
    assert corpus_pipeline.dedup_lines(spark, bare, str(tmp_path)).columns == bare.columns


def test_run_is_the_stages_one_after_the_other(spark, tmp_path):
    got = corpus_pipeline.run(spark, SF)
    ids = {r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    rows = got.collect()
    assert rows and {r["doc_id"] for r in rows} <= ids and {"copies", "taken"} <= set(got.columns)


def test_archives_are_read_by_others(spark):
    import gzip

    from lethe.llm import warc

    big = "<p>" + "x" * 200
    rows = [(2, "http://b.org/ two", big), (1, "http://a.org/", big), (1, "http://a.org/", big), (5, None, big), (None, "http://c.org/", big), (7, "http://d.org/", "y" * 100_000), (8, "http://d.org/", None)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, RECORD_TYPE string")
    archive = warc.write(pages)
    got = sorted((r["page_id"] or "", r["record_type"], r["refers_to"]) for r in warc.read(archive).collect())
    assert got == [("", "revisit", "1"), ("1", "response", None), ("1", "response", None), ("2", "revisit", "1"), ("5", "revisit", "1"), ("7", "response", None), ("8", "response", None)]
    folder, heads = archive.path.removeprefix("file://").removeprefix("file:"), []
    for f in sorted(os.listdir(folder)):
        if f.endswith(".warc.gz"):
            with gzip.open(f"{folder}/{f}") as z:
                raw = z.read()
            at = 0
            while at < len(raw):
                head, _, rest = raw[at:].partition(b"\r\n\r\n")
                lines = head.decode().split("\r\n")
                heads.append((f, dict(x.split(": ", 1) for x in lines[1:])))
                assert lines[0] == "WARC/1.1"
                at += len(head) + 4 + int(heads[-1][1]["Content-Length"]) + 4
    firsts = {f: next(h for g, h in heads if g == f)["WARC-Type"] for f, _ in heads}
    assert set(firsts.values()) == {"warcinfo"}
    ids = {h["WARC-Record-ID"] for _, h in heads if h["WARC-Type"] == "response"}
    refers = [h for _, h in heads if h["WARC-Type"] == "revisit"]
    assert len(refers) == 3 and all(h["WARC-Refers-To"] in ids and h["WARC-Refers-To-Target-URI"] == "http://a.org/" for h in refers)


def repeated(words, n=8):
    seen = {}
    for i in range(len(words) - n + 1):
        seen.setdefault(tuple(words[i : i + n]), []).append(i)
    return len({j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + n)})


def test_quality_base_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in quality.assess(docs.select("doc_id", "text", "lang")).collect()}
    for r in docs.collect():
        t = r["text"] or ""
        w = re.findall(WORD, t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        again = repeated(w)
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), again, len(w) < 20 or 100 * again > 30 * len(w))
        assert tuple(got[r["doc_id"]][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == want, r["doc_id"]


def test_license_scan_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r["doc_id"], r["text"]) for r in docs] + [(10_001, "MIT License or the Apache License, Version 2.0, under the MIT license"), (10_002, "cc by cc by general public license all rights reserved"), (10_003, None)]
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
        starts, labels = [], set()
        for phrase, label in license_scan.BASE:
            p = phrase.split()
            here = [k for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
            starts += here
            labels |= {label} if here else set()
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)))
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_held_out_accuracy(spark):
    from lethe.llm import queries

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    got = queries.op8_language_id(spark, "/root/testdata/sf0.01").filter("held_out").join(docs.filter("lang IS NOT NULL"), "doc_id").filter("lang_pred != 'und'")
    assert got.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.97


@pytest.mark.parametrize("edit", ["letter", "word", "inserted", "scattered", "short"])
def test_recall_of_edited_lines_of_a_large_table(spark, edit, monkeypatch):
    monkeypatch.setattr(line_dedup, "EXACT", 0)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("etaoinshrdlucm") for _ in range(rng.randint(3, 8)))
    rows = []
    for i in range(100):
        line = [word() for _ in range(6 if edit == "short" else 26)]
        other, k = list(line), rng.randrange(len(line))
        for k in rng.sample(range(26), 5) if edit == "scattered" else [k]:
            other[k] = word()[:5] if edit == "word" else "z" + other[k][1:]
        if edit == "inserted":
            other = [*line[:k], "more", *line[k:]]
        rows += [(2 * i, " ".join(line)), (2 * i + 1, " ".join(other))]
    got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).filter("n_removed = 1").collect()
    assert len(got) >= 95 and all(r["doc_id"] % 2 for r in got)


def test_links_of_members_do_not_pile_up(spark, monkeypatch):
    """A bucket of copies, in each round of components, hands on at most a link for each member and each newly verified pair."""
    sizes, whole = [], _graph.components
    monkeypatch.setattr(_graph, "components", lambda links: sizes.append(links.count()) or whole(links))
    members = spark.range(60).selectExpr("explode(array(0, 1, 2)) AS sig", "id AS cls").select(F.col("sig").cast("long").alias("sig"), "cls")
    few = spark.createDataFrame([(x, y, -1) for x in range(60) for y in range(x + 1, 60)], "a long, b long, d int")
    roots = _graph.connect_members(members, [], "true", lambda pairs: pairs.select("a", "b"), pairs=few)
    assert {(r["node"], r["root"]) for r in roots.collect()} == {(x, 0) for x in range(60)} and max(sizes) <= 120
