"""License detection by ordered signature rules.

A rule is a regular expression over the lower-cased words of a text, a label, a priority and a
keyword, a string that every match contains; it runs only on texts that hold it, inside a word or not.  Rules are licence names in phrasings around
them (every phrasing of every name is one rule), SPDX identifiers, and sentences and addresses of notices and bodies.  Of the places that rules match, one that
lies inside a place of the same or a stronger priority is dropped.  Fixed phrases are counted
besides and are never dropped.

Only DataFrame functions are used, row by row: nothing is shuffled and no text leaves its row.

Defined cases: null and empty texts have no words, no labels and score 0; equal places of two rules go
to the stronger priority, then to the rule that comes first; repeated rows have equal results; an empty table
gives no rows; columns named like a result are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lethe.llm import _store

#: Phrases of the base scan and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Names: label, keyword, expression over words.  A name without a version has a label without one.
_V = "(?:version |v ?)?"
_CC = (("cc-by-sa", "sa", "share ?alike"), ("cc-by-nc", "nc", "non ?commercial"), ("cc-by-nd", "nd", "no ?deriv(?:ative)?s"), ("cc-by-nc-sa", "nc sa", "non ?commercial share ?alike"), ("cc-by-nc-nd", "nc nd", "non ?commercial no ?deriv(?:ative)?s"))
NAMES = (
    ("apache-2.0", "apache", f"apache (?:software )?licen[cs]e {_V}2(?: 0)?"),
    ("apache-1.1", "apache", f"apache (?:software )?licen[cs]e {_V}1 1"),
    ("apache-1.0", "apache", f"apache (?:software )?licen[cs]e {_V}1 0"),
    ("apache-2.0", "apache", "apache(?: version)? 2 0(?: licen[cs]e)?"),
    ("mit", "mit licen", "mit licen[cs]e"),
    ("mit", "expat", "expat licen[cs]e"),
    ("mit-0", "mit no attribution", "mit no attribution(?: licen[cs]e)?"),
    ("bsd-2-clause", "bsd", "(?:simplified bsd|bsd 2 clause|2 clause bsd)(?: licen[cs]e)?"),
    ("bsd-3-clause", "bsd", "(?:modified bsd|new bsd|bsd 3 clause|3 clause bsd)(?: licen[cs]e)?"),
    ("bsd-4-clause", "bsd", "(?:original bsd|bsd 4 clause|4 clause bsd)(?: licen[cs]e)?"),
    ("0bsd", "bsd", "(?:0bsd|zero clause bsd|bsd zero clause)(?: licen[cs]e)?"),
    ("bsd", "bsd", "bsd licen[cs]e"),
    *((f"gpl-{n}.0", "general public license", f"(?:gnu )?general public license (?:version |v ?){n}(?: 0)?") for n in (1, 2, 3)),
    *((f"gpl-{n}.0", "gpl", f"(?:gnu )?gpl ?{_V}{n}(?: 0)?") for n in (1, 2, 3)),
    *((f"lgpl-{v}", "lesser general public license", f"(?:gnu )?lesser general public license {_V}{x}") for v, x in (("2.1", "2 1"), ("3.0", "3(?: 0)?"))),
    ("lgpl-2.0", "library general public license", f"(?:gnu )?library general public license(?: {_V}2(?: 0)?)?"),
    ("lgpl", "lesser general public license", "(?:gnu )?lesser general public license"),
    *((f"lgpl-{v}", "lgpl", f"(?:gnu )?lgpl ?{_V}{x}") for v, x in (("2.0", "2(?: 0)?"), ("2.1", "2 1"), ("3.0", "3(?: 0)?"))),
    ("lgpl", "lgpl", "(?:gnu )?lgpl"),
    ("agpl-3.0", "affero", f"(?:gnu )?affero general public license {_V}3(?: 0)?"),
    ("agpl", "affero", "(?:gnu )?affero general public license"),
    ("agpl-3.0", "agpl", f"(?:gnu )?agpl ?{_V}3(?: 0)?"),
    ("agpl", "agpl", "(?:gnu )?agpl"),
    *((f"gfdl-1.{n}", "free documentation", f"(?:gnu )?free documentation licen[cs]e {_V}1 {n}") for n in (1, 2, 3)),
    ("gfdl", "free documentation", "(?:gnu )?free documentation licen[cs]e"),
    *((f"mpl-{v}", "mozilla", f"mozilla public licen[cs]e {_V}{x}") for v, x in (("1.0", "1 0"), ("1.1", "1 1"), ("2.0", "2(?: 0)?"))),
    ("mpl", "mozilla", "mozilla public licen[cs]e"),
    *((f"mpl-{v}", "mpl", f"mpl ?{_V}{x}") for v, x in (("1.0", "1 0"), ("1.1", "1 1"), ("2.0", "2(?: 0)?"))),
    *((f"epl-{n}.0", "eclipse", f"eclipse public licen[cs]e {_V}{n}(?: 0)?") for n in (1, 2)),
    ("epl", "eclipse", "eclipse public licen[cs]e"),
    *((f"epl-{n}.0", "epl", f"epl ?{_V}{n}(?: 0)?") for n in (1, 2)),
    *((f"cddl-1.{n}", "cddl", f"cddl {_V}1 {n}") for n in (0, 1)),
    ("cddl", "cddl", "cddl"),
    *((f"eupl-1.{n}", "eupl", f"eupl ?{_V}1 {n}") for n in (1, 2)),
    ("eupl", "european union public licen", "european union public licen[cs]e"),
    ("isc", "isc licen", "isc licen[cs]e"),
    ("zlib", "zlib", "zlib(?: libpng)? licen[cs]e"),
    *((f"artistic-{n}.0", "artistic", f"artistic licen[cs]e {_V}{n} 0") for n in (1, 2)),
    ("artistic", "artistic", "artistic licen[cs]e"),
    ("boost-1.0", "boost", "boost software licen[cs]e(?: (?:version )?1 0)?"),
    ("unlicense", "unlicense", "(?:the )?unlicense"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("cc0", "cc0", "cc0(?: 1 0)?(?: universal)?"),
    *((f"cc-by-{v}", "cc by", f"cc by {v.replace('.', ' ')}") for v in ("1.0", "2.0", "2.5", "3.0", "4.0")),
    # Of the other Creative Commons licences one label holds all versions.
    *((label, "cc by", f"cc by {short}(?: [1-4] [05])?") for label, short, _ in _CC),
    *((f"cc-by-{v}", "creative commons", f"creative commons attribution {v.replace('.', ' ')}(?: international)?") for v in ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by", "creative commons", "creative commons attribution"),
    *((label, "creative commons", f"creative commons attribution {long}(?: [1-4] [05])?") for label, _, long in _CC),
    ("public-domain", "public domain", "public domain"),
    ("proprietary", "proprietary", "proprietary and confidential"),
)
#: Phrasings around a name, and their priority; 1 is the strongest.
PHRASES = (
    (1, "(?:is )?licen[cs]ed under (?:the )?(?:terms of )?(?:the )?{}"),
    (1, "(?:re)?distributed under (?:the )?(?:terms of )?(?:the )?{}"),
    (1, "released (?:in|into|under) (?:the )?(?:terms of )?(?:the )?{}"),
    (1, "(?:made )?available under (?:the )?(?:terms of )?(?:the )?{}"),
    (1, "published under (?:the )?(?:terms of )?(?:the )?{}"),
    (1, "(?:subject to|governed by|covered by) (?:the )?(?:terms of )?(?:the )?{}"),
    (2, "under (?:the )?(?:terms of )?(?:the )?{}"),
    (2, "(?:see|read) (?:the )?{}"),
    (3, "{}"),
)
#: SPDX identifiers: the label is the identifier in lower case, or as named.
SPDX = (
    *"0BSD AFL-2.1 AFL-3.0 AGPL-1.0 AGPL-3.0 Apache-1.0 Apache-1.1 Apache-2.0 APSL-2.0 Artistic-1.0 Artistic-2.0 BlueOak-1.0.0 BSD-1-Clause BSD-2-Clause BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause".split(),
    *"CC-BY-1.0 CC-BY-2.0 CC-BY-2.5 CC-BY-3.0 CC-BY-4.0 CDDL-1.0 CDDL-1.1 CECILL-2.1 CPL-1.0 ECL-2.0 EFL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 GFDL-1.1 GFDL-1.2 GFDL-1.3 GPL-1.0 GPL-2.0 GPL-3.0".split(),
    *"HPND IJG IPL-1.0 ISC LGPL-2.0 LGPL-2.1 LGPL-3.0 LPPL-1.3c MIT MIT-0 MPL-1.0 MPL-1.1 MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NCSA ODbL-1.0 OFL-1.0 OFL-1.1 OpenSSL OSL-2.1 OSL-3.0 PDDL-1.0 PHP-3.01".split(),
    *"PostgreSQL PSF-2.0 Python-2.0 QPL-1.0 Ruby SISSL Sleepycat TCL Unicode-DFS-2016 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1".split(),
)
SPDX_NAMED = (("boost-1.0", "BSL-1.0"), ("cc0", "CC0-1.0"), *((label, f"{label}-{v}") for label, _, _ in _CC for v in ("1.0", "2.0", "2.5", "3.0", "4.0")))
#: Sentences of notices and bodies, and addresses: label, keyword, expression.
BODIES = (
    ("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the above copyright notice and this permission notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "opensource org", "opensource org licen[cs]es? mit"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse or promote products", "neither the names? of (?:[a-z0-9]+ ){1,12}may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "all advertising materials mentioning", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("apache-2.0", "apache org licenses", "apache org licenses license 2 0"),
    ("apache-1.1", "apache org licenses", "apache org licenses license 1 1"),
    ("isc", "for any purpose with or without fee", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("zlib", "altered source versions", "altered source versions must be plainly marked as such"),
    ("zlib", "the origin of this software", "the origin of this software must not be misrepresented"),
    ("unlicense", "free and unencumbered software", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "unlicense org", "unlicense org"),
    ("wtfpl", "you just do what the", "you just do what the fuck you want to"),
    ("boost-1.0", "boost org", "boost org license 1 0"),
    ("boost-1.0", "machine executable object code", "solely in the form of machine executable object code generated by a source language processor"),
    *((f"{k}-{v}", f"{name}general public license as published", f"{name}general public license as published by the free software foundation (?:either )?version {x}") for k, name, vs in (("gpl", "", (("1.0", "1"), ("2.0", "2"), ("3.0", "3"))), ("lgpl", "lesser ", (("2.1", "2 1"), ("3.0", "3"))), ("lgpl", "library ", (("2.0", "2"),)), ("agpl", "affero ", (("3.0", "3"),))) for v, x in vs),
    *((f"{k}-{v}", "gnu org licenses", f"gnu org licenses (?:old licenses )?{k} {v[0] + '(?: 0)?' if v.endswith('.0') else v.replace('.', ' ')}") for k, vs in (("gpl", ("1.0", "2.0", "3.0")), ("lgpl", ("2.0", "2.1", "3.0")), ("agpl", ("3.0",)), ("gfdl", ("1.1", "1.2", "1.3"))) for v in vs),
    *((f"mpl-{v}", "mozilla org mpl", f"mozilla org mpl {v.replace('.', ' ')}") for v in ("1.1", "2.0")),
    ("mpl-2.0", "this source code form is subject", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    *((f"epl-{n}.0", "eclipse org legal", f"eclipse org legal epl (?:v ?)?{n} ?0") for n in (1, 2)),
    *((f"cc-by-{v}", "creativecommons org licenses", f"creativecommons org licenses by {v.replace('.', ' ')}") for v in ("1.0", "2.0", "2.5", "3.0", "4.0")),
    *((label, "creativecommons org licenses", f"creativecommons org licenses by {short} [1-4] [05]") for label, short, _ in _CC),
    ("cc0", "creativecommons org publicdomain", "creativecommons org publicdomain zero 1 0"),
    ("ofl-1.1", "sil open font licen", "sil open font licen[cs]e(?: version)? 1 1"),
    ("proprietary", "unauthorized copying of this file", "unauthorized copying of this file via any medium is strictly prohibited"),
)
#: Score of a document whose strongest place has this priority.
SCORES = {1: 1.0, 2: 0.9, 3: 0.7}
BASE_SCORE = 0.5
MADE = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "places", "score")
_P = _store.OWN


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    keyword: str
    pattern: str


def _rules():
    for label, keyword, name in NAMES:
        for priority, phrase in PHRASES:
            yield Rule(label, priority, keyword, phrase.format(name))
    for label, name in (*((x.lower(), x) for x in SPDX), *SPDX_NAMED):
        words = name.lower().replace("-", " ").replace(".", " ")
        # Each identifier gates itself, so that a text is searched for few of them.
        yield Rule(label, 1, f"spdx license identifier {words}", f"spdx license identifier {words}(?: (?:only|or later))?")
    for label, keyword, body in BODIES:
        yield Rule(label, 1, keyword, body)


RULES = tuple(Rule(r.label, r.priority, r.keyword, f"(?<= ){r.pattern}(?= )") for r in _rules())


def _quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _places(rules: tuple[Rule, ...]) -> Column:
    """array<struct<a, z, p, k, label>> of the places that rules match in the column s."""
    by_keyword: dict[str, list[str]] = {}
    for k, r in enumerate(rules):
        by_keyword.setdefault(r.keyword, []).append(f"named_struct('x', {_quoted(r.pattern)}, 'p', {r.priority}, 'k', {k}, 'label', {_quoted(r.label)})")
    gated = ", ".join(f"if(contains(s, {_quoted(word)}), array({', '.join(found)}), array())" for word, found in by_keyword.items())
    # The text between matches and the matches give the offset of each.
    start = "aggregate(slice(g, 1, i + 1), 0, (n, y) -> n + length(y)) + aggregate(slice(m, 1, i), 0, (n, y) -> n + length(y))"
    each = f"transform(m, (y, i) -> struct({start} AS a, {start} + length(y) AS z, r.p AS p, r.k AS k, r.label AS label))"
    found = f"transform(array(regexp_extract_all(s, r.x, 0)), m -> if(size(m) = 0, array(), transform(array(split(s, r.x, -1)), g -> {each})[0]))[0]"
    return F.expr(f"flatten(transform(filter(flatten(array({gated})), r -> regexp_like(s, r.x)), r -> {found}))")


def _kept(places: str) -> Column:
    """Places that do not lie inside an earlier one of the same or a stronger priority, by label and priority."""
    order = f"transform(sort_array(transform({places}, x -> struct(x.a AS a, -x.z AS z, x.p AS p, x.k AS k, x.label AS label))), x -> struct(x.a AS a, -x.z AS z, x.p AS p, x.label AS label))"
    inside = "(x.z <= s.m1 OR (x.p >= 2 AND x.z <= s.m2) OR (x.p >= 3 AND x.z <= s.m3))"
    found = f"if({inside}, s.found, array_union(s.found, array(struct(x.label AS label, x.p AS p))))"
    ends = ", ".join(f"if(x.p = {p}, greatest(s.m{p}, x.z), s.m{p}) AS m{p}" for p in (1, 2, 3))
    return F.expr(f"aggregate({order}, struct(CAST(array() AS array<struct<label: string, p: int>>) AS found, 0 AS m1, 0 AS m2, 0 AS m3), (s, x) -> struct({found} AS found, {ends}), s -> s.found)")


def scan(docs: DataFrame, *, text: str = "text", rules: tuple[Rule, ...] = RULES, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns ``keep``) with the base scan, the labels, the places of rules and a score.

    places holds every match of a rule as character offsets in the text's lower-cased words, joined by single spaces and
    set between two.
    """
    carried = [c for c in (keep if keep is not None else docs.columns) if c.lower() not in MADE and not c.startswith(_P)]
    names = {c: f"{_P}c{i}" for i, c in enumerate(carried)}
    low = F.translate(F.coalesce(_store.column(docs, text, "string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.concat(F.lit(" "), F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "), F.lit(" "))
    df = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], F.regexp_replace(words, r"^ +| +$", " ").alias("s"))
    df = df.withColumn("n_words", F.greatest(F.length("s") - F.length(F.replace(F.col("s"), F.lit(" "), F.lit(""))) - 1, F.lit(0)).cast("long"))

    def count(part: str) -> str:
        return f"CAST((length({part}) - length(replace({part}, ' ', ''))) / 2 AS BIGINT)"

    n, first, last, base = [], [], [], []
    for phrase, label in BASE:
        long = _quoted(" " + phrase.replace(" ", "  ") + " ")
        has, wide = f"contains(s, {_quoted(f' {phrase} ')})", "concat(' ', replace(trim(s), ' ', '  '), ' ')"
        size = len(phrase.split())
        n.append(f"if({has}, CAST((length({wide}) - length(replace({wide}, {long}, ''))) / {len(phrase.replace(' ', '  ')) + 2} AS BIGINT), 0L)")
        first.append(f"if({has}, {count(f'substring_index({wide}, {long}, 1)')}, NULL)")
        last.append(f"if({has}, n_words - {size}L - {count(f'substring_index({wide}, {long}, -1)')}, NULL)")
        base.append(f"if({has}, '{label}', NULL)")
    df = df.withColumns(
        {
            "n_base": F.expr(" + ".join(n)),
            "first_word": F.expr(f"least({', '.join(first)})"),
            "last_word": F.expr(f"greatest({', '.join(last)})"),
            "b": F.expr(f"array_sort(array_compact(array({', '.join(base)})))"),
            "places": _places(rules),
        }
    )
    df = df.withColumn("f", _kept("places"))
    best = F.expr("CASE array_min(transform(f, x -> x.p)) " + " ".join(f"WHEN {p} THEN {v}D" for p, v in SCORES.items()) + " END")
    return df.select(
        *[F.col(x).alias(c) for c, x in names.items()],
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("b", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("b", F.expr("transform(f, x -> x.label)"))), ",").alias("labels"),
        "places",
        F.coalesce(best, F.when(F.size("b") > 0, F.lit(BASE_SCORE)), F.lit(0.0)).alias("score"),
    )
