"""What earlier forms of the operators left out."""

import random
import re

from lethe.llm import language_id, license_scan, line_dedup, quality, substring_dedup, toxicity


def spelled(parsed, full):
    """A text that a parsed regular expression matches: with every optional part, or with none and no space left out."""
    out = ""
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name == "IN":
            out += chr(arg[0][1][0] if str(arg[0][0]) == "RANGE" else arg[0][1])
        elif name == "MAX_REPEAT":
            out += spelled(arg[2], full) * (min(arg[0] + 1, arg[1]) if full else arg[0])
        elif name == "SUBPATTERN":
            out += spelled(arg[3], full)
        elif name == "BRANCH":
            out += spelled(arg[1][-1 if full else 0], full)
        else:
            assert name == "ASSERT", name
    return out


def test_quality_rejects_documents_without_common_words(spark):
    rng = random.Random(1)
    common = quality.COMMON["en"] + tuple(x.upper() for x in quality.COMMON["en"])

    def words(n, share, of=common):
        return " ".join(rng.choice(of) if rng.random() < share else "".join(rng.choice("aeinrst") for _ in range(6)) for _ in range(n))

    good = [(i, words(300, 0.18), "en") for i in range(30)]
    good += [(100 + i, words(300, 0.18, quality.COMMON["de"]), "de") for i in range(3)]
    good += [(200, words(300, 0.18, quality.COMMON["de"]), None), (201, words(300, 0.18), None)]
    junk = [(300, words(300, 0), "en"), (301, words(300, 0), "de"), (302, words(300, 0), None)]
    got = {r["doc_id"]: r for r in quality.assess(spark.createDataFrame(good + junk, "doc_id long, text string, lang string")).collect()}
    assert all(got[i]["kept"] for i, _, _ in good)
    assert all(got[i]["word_divergence"] > quality.WORD_LIMIT and not got[i]["kept"] for i, _, _ in junk)


def test_line_dedup_finds_lines_with_one_word_changed(spark):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("etaoinshrdlucm") for _ in range(rng.randint(2, 8))) for _ in range(2000)]
    rows = []
    for i in range(60):
        line = [rng.choice(vocabulary) for _ in range(26)]
        other = list(line)
        other[rng.randrange(26)] = "".join(rng.choice("etaoinshrdlucm") for _ in range(5))
        rows += [(2 * i, " ".join(line)), (2 * i + 1, " ".join(other))]
    got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).filter("n_removed = 1").collect()
    assert all(r["doc_id"] % 2 for r in got) and len(got) >= 50


def test_license_gate_passes_what_its_rules_match(spark):
    rows = [(k, spelled(re._parser.parse(r.pattern), full)) for k, r in enumerate(license_scan.RULES) for full in (False, True)]
    got = license_scan.scan(spark.createDataFrame(rows, "k int, text string")).collect()
    assert all(r["k"] in [p["k"] for p in r["places"]] for r in got)
    glued = ["GPLv2", "GPLv3", "GPL2", "released under the GPLv2+."]
    got = license_scan.scan(spark.createDataFrame([(x,) for x in glued], "text string")).collect()
    assert {r["text"]: r["labels"] for r in got} == dict(zip(glued, ("gpl-2.0", "gpl-3.0", "gpl-2.0", "gpl-2.0"), strict=True))


def test_license_statements(spark):
    spdx = ("MIT mit", "ISC isc", "MPL-2.0 mpl-2.0", "LGPL-2.1-or-later lgpl-2.1", "AGPL-3.0-only agpl-3.0", "EPL-2.0 epl-2.0", "Zlib zlib", "BSL-1.0 boost-1.0", "MIT-0 mit-0", "BSD-3-Clause bsd-3-clause", "Apache-2.0 apache-2.0")
    want = {f"x\n// SPDX-License-Identifier: {x.split()[0]}\ny": x.split()[1] for x in spdx}
    want |= {
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal": "mit",
        "Redistribution and use in source and binary forms, with or without modification, are permitted": "bsd",
        "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software": "bsd-3-clause",
        "see http://www.apache.org/licenses/LICENSE-2.0 for more": "apache-2.0",
        "it is under LGPL v2.1": "lgpl-2.1",
        "LGPL code": "lgpl",
        "AGPLv3": "agpl-3.0",
        "MIT licence": "mit",
        "EPL 1.0": "epl-1.0",
        "Mozilla Public License 1.1": "mpl-1.1",
        "Mozilla Public License, version 2.0": "mpl-2.0",
        "Creative Commons Attribution 3.0": "cc-by-3.0",
        "https://creativecommons.org/licenses/by-sa/4.0/": "cc-by-sa",
    }
    got = license_scan.scan(spark.createDataFrame([(x,) for x in want], "text string")).collect()
    assert {r["text"]: r["labels"] for r in got} == want
    cc = license_scan.scan(spark.createDataFrame([("CC BY 2.0",)], "text string")).first()
    assert cc["labels"] == "cc-by,cc-by-2.0"


def test_substring_dedup_finds_a_passage_in_mid_sentence_at_any_offset(spark):
    passage = " ".join(f"p{i}" for i in range(51))
    rows = [(i, " ".join([*(f"a{i}x{j}" for j in range(i)), passage, *(f"z{i}x{j}" for j in range(9))])) for i in range(26)]
    got = substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["n_removed_words"] >= 25 for r in got if r["doc_id"]) and sum(r["n_removed_words"] for r in got if not r["doc_id"]) == 0
    assert all(not re.search(r"(^| )[az]\d+x\d+", " ".join(w for w in rows[r["doc_id"]][1].split() if w not in r["text"].split())) for r in got)


def test_line_dedup_removes_equal_short_lines(spark):
    rows = [(1, "All rights reserved.\nHome\n--"), (2, "all rights reserved\nfirst own line\n--"), (3, "HOME!\nabout us")]
    got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), least_equal=1).collect()
    assert sorted((r["doc_id"], r["text"], r["n_removed"]) for r in got) == [(1, rows[0][1], 0), (2, "first own line\n--", 1), (3, "about us", 1)]


def test_toxicity_restores_trailing_spaced_and_doubled_forms(spark):
    plain = "you stupid idiot and fool, an ass is too good for all the small books in the pool of the city! "
    cost = toxicity.character_model(spark.createDataFrame([(plain * 50,)], "text string"))
    forms = {"idio7": "idiot", "a55": "ass", "f001": "fool", "s t u p 1 d": "stupid", "i  d  i  o  t": "idiot", "s/t/u/p/i/d": "stupid", '"i d i o t"': '"idiot"', "stuupid": "stupid", "iiddiioott": "idiot"}
    assert {x: toxicity.restore(x, cost) for x in forms} == forms
    assert toxicity.restore("too good for all the small books, 1 2 3 4", cost) == "too good for all the small books, 1 2 3 4"


def test_language_id_learns_from_distinct_texts(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = [(f"the cat and dog number {chr(97 + i)} went there", "en") for i in range(20)] + [(f"der hund und die katze {chr(97 + i)} gingen dorthin", "de") for i in range(20)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    first = docs.filter("lang = 'en'").orderBy(F.xxhash64("text")).first()
    seen, ftrl = [], language_id.ftrl
    monkeypatch.setattr(language_id, "ftrl", lambda data, *a, **k: seen.append(data) or ftrl(data, *a, **k))
    language_id.fit(docs.union(spark.createDataFrame([first] * 50, docs.schema)), per_label=10)
    assert all(len({i.tobytes() for i, _, y in seen[0] if y == k}) == sum(y == k for _, _, y in seen[0]) == 10 for k in (0, 1))


def test_line_dedup_of_a_small_table_leaves_out_no_similar_line(spark):
    import random

    rng, rows = random.Random(3), []
    for i in range(60):
        line = " ".join("".join(rng.choice("etaoinshrdlucm") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(5, 40)))
        at = [k for k, c in enumerate(line) if c != " "]
        other = list(line)
        # As many letters as the similarity allows are changed, each in another place.
        for k in rng.sample(at, len(line) // 10):
            other[k] = "z"
        rows += [(2 * i, line), (2 * i + 1, "".join(other))]
    at = [k for k, c in enumerate(rows[0][1]) if c != " "][: len(rows[0][1]) // 10 + 1]
    rows += [(999, "".join("q" if k in at else c for k, c in enumerate(rows[0][1])))]
    got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).filter("n_removed = 1").collect()
    assert sorted(r["doc_id"] for r in got) == [2 * i + 1 for i in range(60)]
