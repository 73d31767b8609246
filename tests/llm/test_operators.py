"""Edge cases and brute-force comparisons of the operators on small tables."""

import hashlib
import re

import pytest

from lethe.llm import decontamination, language_id, license_scan, line_dedup, mixing, ngram_join, quality, substring_dedup, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_words string, score string"
PASSAGE = " ".join(f"w{i}" for i in range(12)) + ". " + " ".join(f"v{i}" for i in range(14)) + ". " + " ".join(f"u{i}" for i in range(30)) + "."
LONG = " ".join(f"x{i % 977}y{i}" for i in range(30_000))
ROWS = [
    (1, f"Own start of one. {PASSAGE} Own end of one.", "en", "a", "z", None),
    (2, f"Another start. {PASSAGE}", "en", "a", "z", None),
    (2, f"Another start. {PASSAGE}", "en", "a", "z", None),
    (3, None, None, None, None, None),
    (None, "No identity but some words stand here in a row.", "fr", "b", "z", "0"),
    (4, "", "fr", "b", None, None),
    (5, "   \n ", None, "b", None, None),
    (6, LONG, "de", "c", None, None),
    (7, "All rights reserved. Licensed under CC BY-NC 4.0 or the MIT License.", "en", "c", None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_substring_dedup(docs, none):
    got = sorted(substring_dedup.dedup(docs).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    text = {r["doc_id"]: r["text"] for r in got}
    assert len(got) == len(ROWS) and text[1] == ROWS[0][1] and text[3] is None and text[4] == "" and text[6] == LONG
    assert text[2] == "Another start. " and [r["n_removed"] > 0 for r in got if r["doc_id"] == 2] == [True, True]
    assert substring_dedup.dedup(none).count() == 0


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(1, " ".join(f"v{i}" for i in range(13))), (1, "w1 w2 w3"), (2, None), (None, "nothing of this kind occurs in any text of the table at all today")], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontamination.find_contamination(docs, items).collect()}
    assert got[1]["n_hit"] == 16 and got[1]["n_items"] == 1 and got[1]["contaminated"] and got[1]["items_sha256"] == hashlib.sha256(b"1").hexdigest()
    assert got[3]["n_words"] == 0 and not got[3]["contaminated"] and got[6]["n_hit"] == 0 and got[6]["n_words"] == 30_000
    assert decontamination.find_contamination(none, items).count() == 0
    assert decontamination.find_contamination(docs, items.limit(0)).filter("contaminated").count() == 0
    split = decontamination.find_contamination(docs, items, block_bytes=40)
    assert sorted((r["doc_id"] or 0, r["n_hit"], r["items_sha256"]) for r in split.collect()) == sorted((r["doc_id"] or 0, r["n_hit"], r["items_sha256"]) for r in decontamination.find_contamination(docs, items).collect())
    assert decontamination.drop_contaminated(docs, items).columns == docs.columns


def test_quality(docs, none):
    got = {r["doc_id"]: r for r in quality.assess(docs).collect()}
    assert got[3]["n_words"] == 0 and got[3]["base_failed"] and got[6]["kept"] and got[6]["n_repeat_words"] == 0
    assert quality.assess(none).count() == 0


def test_license_scan(docs, none):
    got = {r["doc_id"]: r for r in license_scan.scan(docs).collect()}
    assert got[7]["base_labels"] == "cc-by,reserved" and got[7]["labels"] == "cc-by,cc-by-nc,mit,reserved" and (got[7]["n_base"], got[7]["first_word"], got[7]["last_word"]) == (2, 0, 5)
    assert got[3]["n_words"] == 0 and got[3]["labels"] == "" and got[3]["score"] == 0.0 and got[3]["first_word"] is None
    assert license_scan.scan(none).count() == 0 and len(license_scan.RULES) >= 300


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return {i: (len(sets[i]), root[i]) for i in sets}


def test_ngram_join_equals_brute_force(spark):
    base = [f"t{i}" for i in range(60)]
    rows = [(i, " ".join(base[:k] + [f"n{i}"] + base[k + 1 :])) for i, k in enumerate((0, 1, 3, 3, 20, 30, 40, 59, 5, 6, 7, 8))]
    rows += [(20, " ".join(base)), (21, " ".join(base)), (22, "one two"), (23, "one  TWO"), (24, ""), (25, None), (26, " ".join(base[:45]))]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.find_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_signatures_meet_for_every_linked_pair():
    import numpy as np

    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 5, 9, 40, 200, 900):
        for frequency in (2, 40):
            for _ in range(40):
                pool = np.unique(rng.integers(1, 1 << 60, 2 * n + 4)).astype("<u8")
                a, b = pool[:n], np.append(pool[: max(1, int(n * rng.uniform(0.8, 1)))], pool[-int(rng.integers(0, 2 + n // 12)) :][: n // 8])
                b, common = np.unique(b), len(np.intersect1d(a, b))
                if 7 * common < 3 * (len(a) + len(b)):
                    continue
                both = np.intersect1d(a, b)
                entry = np.empty(common, ngram_join._ENTRY)
                entry["t"], entry["f"] = both, frequency
                assert len(np.intersect1d(ngram_join.signatures(entry, len(a)), ngram_join.signatures(entry, len(b))))


def test_parity_never_exceeds_the_difference():
    import numpy as np

    rng = np.random.default_rng(6)
    for _ in range(300):
        pool = np.unique(rng.integers(1, 1 << 60, int(rng.integers(2, 900)))).astype("<u8")
        a, b = pool[rng.random(len(pool)) < 0.9], pool[rng.random(len(pool)) < 0.9]
        bits = int(np.bitwise_count((ngram_join.parity(a) ^ ngram_join.parity(b)).view(np.uint64)).sum())
        assert bits <= len(np.setxor1d(a, b))


def test_ngram_join_of_a_large_group_equals_brute_force(spark):
    import random

    rng = random.Random(4)
    base = [f"t{i}" for i in range(90)]
    rows = []
    for i in range(160):
        words = list(base)
        for _ in range(rng.choice((1, 2, 3, 4))):
            words[rng.randrange(90)] = rng.choice(("p", "q", f"n{i}"))
        rows.append((i, " ".join(words)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.find_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows) and len({c for _, c in got.values()}) > 1


def test_similar_equals_edit_distance(spark):
    import random

    from pyspark.sql import functions as F

    rng, rows = random.Random(3), []
    for _ in range(1500):
        x = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 25))]
        y = list(x)
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(y))
            y[k : k + 1] = rng.choice(([], [y[k], "bb"], [y[k] + "a"], [y[k], "a"])) if len(y) > 1 else [y[k] + "b"]
        rows.append((" ".join(x), " ".join(y)))
    pairs = spark.createDataFrame(rows, "x string, y string").withColumns({"u": F.split("x", " "), "v": F.split("y", " ")})
    plain = "levenshtein(x, y) <= CAST(greatest(length(x), length(y)) * 10 DIV 100 AS INT)"
    assert {tuple(r) for r in pairs.selectExpr(f"{line_dedup._similar(90)} AS a", f"{plain} AS b").distinct().collect()} == {(True, True), (False, False)}


def test_line_dedup(spark, none):
    line = "the quick brown fox jumps over the lazy dog while forty two other animals look on from the far side of the wide river bank"
    rows = [(1, f"{line}\nfirst own line of the first document here"), (2, f"head\n{line.upper()}!\ntail"), (3, "a b\na b"), (4, None), (5, ""), (None, line), (2, f"head\n{line.upper()}!\ntail")]
    got = [(r["doc_id"], r["text"], r["n_removed"]) for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(1, rows[0][1], 0), (2, "head\ntail", 1), (2, "head\ntail", 1), (3, "a b\na b", 0), (4, None, 0), (5, "", 0), (None, "", 1)], key=str)


def test_warc_round_trip(spark):
    big = "<html>" + "ö" * 200 + "\r\n\r\n</html>"
    rows = [(3, "http://www.b.org:80/x?q#f", big), (1, "http://a.b.org/y", big), (2, None, None), (4, "http://a.b.org/y", "short"), (5, "ftp://c.net", "short")]
    archive = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), block_lines=2)
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read(archive).collect()}
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert got == {str(i): (len((t or "").encode()), sha(t), "revisit" if i == 3 else "response", "1" if i == 3 else None) for i, _, t in rows}
    assert sorted(r["page_id"] for r in warc.lookup(archive, ["http://a.b.org/y"])) == ["1", "4"] and warc.lookup(archive, ["http://zz.org/"]) == []
    assert [r["payload"] for r in warc.lookup(archive, ["http://a.b.org/y"]) if r["page_id"] == "1"] == [big.encode()]
    assert warc.read(warc.write(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def test_language_id(spark, none):
    rows = [(i, f"the cat and the dog number {i} went there", "en") for i in range(40)] + [(100 + i, f"der hund und die katze nummer {i} gingen dorthin", "de") for i in range(40)]
    rows += [(900, None, "en"), (901, "123 ...", "de"), (902, "the dog and the cat", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(docs, language_id.fit(docs)).collect()}
    assert got[900] == got[901] == ("und", 0.0) and got[902][0] == "en" and all(got[i][0] == "en" and got[100 + i][0] == "de" for i in range(40))
    assert language_id.predict(docs, language_id.fit(none)).filter("lang_pred <> 'und'").count() == 0


def test_mixing(docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS) and all(0 <= r["taken"] <= 2 * r["size"] for r in got) and mixing.mix(none).count() == 0
    total = sum(r["size"] for r in got)
    assert abs(sum({r["source"]: r["target"] for r in got}.values()) - 1.5 * total) < 1e-6 * total
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, got))


def test_toxicity(spark, none):
    rows = [(i, f"you are a fool number {chr(97 + i % 26)} of the town") for i in range(60)] + [(100 + i, f"this is a garden number {chr(97 + i % 26)} of the town") for i in range(120)]
    rows += [(900, "what a f00l"), (901, "f o o l !"), (902, None), (903, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in rows if i < 900] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    cost = toxicity.character_model(docs.select("text").na.drop())
    assert toxicity.restore("f o o l !", cost) == "fool !" and toxicity.restore("what a f00l", cost) == "what a fool"
    assert got[900] > got[903] and got[902] == got[903] < 0.5 and all(got[100 + i] < 0.5 <= got[j] for i in range(120) for j in range(60))
    assert toxicity.score(docs, toxicity.fit(none, labels.limit(0))).filter("score > 0").count() == 0


def test_language_model_of_the_pipeline_counts_every_row(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa

    from lethe.llm._chars import text_features

    rows = [(i, f"the cat {chr(97 + i % 26)} and dog {chr(97 + i // 26)} went", "en") for i in range(600)] + [(1000 + i, f"der hund {i % 7} und katze {chr(97 + i % 26)}", "de") for i in range(30)]
    rows += [rows[0]] * 3 + [(2000, None, "en"), (2001, "ni une ni deux", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    # The 500 rows of a language that were taken before cannot give these counts.
    monkeypatch.setattr(language_id, "fit", None)
    assert sorted(r["doc_id"] for r in language_id.keep_identified(docs).filter("doc_id < 2000").collect()) == sorted(i for i, *_ in rows if i < 2000)
    model = language_id.fit_all(docs)
    assert model.labels == ["de", "en"] and language_id.fit_all(docs.filter("lang = 'fr'")).labels == []
    for k, label in enumerate(model.labels):
        own = pa.array([t for _, t, x in rows if x == label and t is not None])
        counts = sum(np.bincount(f, minlength=1 << model.bits) for _, _, f, _, _ in text_features(own, model.orders, model.bits))
        assert np.allclose(model.weights[k], np.log((counts + 0.5) / (counts.sum() + 0.5 * len(counts))), atol=1e-5)
