import json

import pytest

from lethe.operators import adjudicate as A
from lethe.operators import units


def made(*entries):
    return A.Answer(json.dumps(entries))


CHUNK = A.Chunk("ο Νίκος μένει εδώ\nτηλ. 12 και Νίκος", [(0, 0, 17), (1, 18, 20)])


def queue():
    return [A.Question("C1", "Νίκος", "POSSIBLE_PERSON", [(0, 2, 7)]), A.Question("C2", "12", None, [(1, 5, 7)])]


def answers(*given):
    left = list(given)
    return lambda messages: left.pop(0)


def test_a_whole_answer_is_taken_at_once():
    done = A.adjudicate(answers(made({"id": "c1", "action": "review", "category": "person"}, {"id": "C2", "action": "PRESERVE", "category": "MONEY"}, {"id": "NEW", "text": "εδώ", "action": "REDACT", "category": "LOCALITY"})), queue(), CHUNK)
    assert [(q.id, q.text, a, c, f) for q, a, c, f in done.decisions] == [("C1", "Νίκος", "REDACT", "POSSIBLE_PERSON", False), ("C2", "12", "PRESERVE", "MONEY", False), ("", "εδώ", "REDACT", "LOCALITY", True)]
    assert (done.unresolved, done.attempts) == ([], 1)


def test_an_id_answered_twice_counts_for_nothing_in_either_order():
    for pair in (("SKIP", "PRESERVE"), ("PRESERVE", "SKIP")):
        first = made(*({"id": "C1", "action": a, "category": "AFM"} for a in pair), {"id": "C2", "action": "REDACT", "category": "AFM"})
        got = A.judge(first, queue(), CHUNK, set(), 3)
        assert got.void == {"C1"} and got.rejected == ["C1 is answered more than once"] and list(got.decided) == ["C2"]
    done = A.adjudicate(answers(first, first), queue(), CHUNK)
    assert [k for k, *_ in done.unresolved] == ["candidate_duplicated"] and done.attempts == 2


def test_what_is_decided_stays_when_the_rest_is_asked_again():
    seen = []
    given = [made({"id": "C1", "action": "REDACT", "category": "x"}, {"id": "NEW", "text": "και", "action": "KEEP", "category": "AFM"}), made({"id": "C2", "action": "REDACT", "category": "AFM"}, {"id": "C3", "action": "PRESERVE", "category": "DATE"})]
    done = A.adjudicate(lambda m: seen.append(json.loads(m[1]["content"])["candidates"]) or given.pop(0), queue(), CHUNK)
    assert [[c["id"] for c in x] for x in seen] == [["C1", "C2"], ["C2", "C3"]]
    assert [(q.id, a, c) for q, a, c, _ in done.decisions] == [("C1", "REDACT", "POSSIBLE_PERSON"), ("C2", "REDACT", "AFM"), ("C3", "PRESERVE", "DATE")] and not done.unresolved


def test_answers_that_do_not_keep_to_the_queue_are_not_used():
    odd = made({"id": "C9", "action": "REDACT", "category": "AFM"}, {"id": "C1", "action": "REDACT", "category": "AFM"}, {"id": "NEW", "text": "μένει", "action": "REDACT", "category": "AFM"})
    done = A.adjudicate(answers(odd, made({"id": "C1", "action": "PRESERVE", "category": "DATE"}, {"id": "C2", "action": "PRESERVE", "category": "DATE"})), queue(), CHUNK)
    assert [(q.id, a) for q, a, *_ in done.decisions] == [("C1", "PRESERVE"), ("C2", "PRESERVE")]
    assert [(k, i) for k, _, i, _ in done.unresolved] == [("discovery_undecided", "C3")]
    for bad in (A.Answer("no array"), A.Answer("[]", "length"), A.Answer("", "stop"), A.Answer("[]", "stop", True), odd):
        with pytest.raises(A.Abandoned):
            A.adjudicate(answers(bad, bad), queue(), CHUNK)
    kept = A.adjudicate(answers(made({"id": "C1", "action": "REDACT", "category": "AFM"}), A.Answer("no array")), queue(), CHUNK)
    assert [q.id for q, *_ in kept.decisions] == ["C1"] and [k for k, *_ in kept.unresolved] == ["candidate_undecided"]


def test_new_findings_must_be_quotes_outside_the_queue():
    got = A.judge(made({"id": "NEW", "text": "nowhere", "action": "REDACT", "category": "AFM"}, {"id": "NEW", "text": "Νίκος", "action": "REDACT", "category": "AFM"}, {"id": "NEW", "text": "τηλ", "action": "REDACT", "category": "AFM"}, {"id": "NEW", "text": "τηλ", "action": "PRESERVE", "category": "DATE"}, {"id": "NEW", "text": "εδώ\nτηλ", "action": "REDACT", "category": "AFM"}, {"id": "NEW"}, 7), queue(), CHUNK, {(0, 2, 7)}, 3)
    assert got.found == [("Νίκος", "AFM", "REDACT", ((1, 12, 17),)), ("εδώ\nτηλ", "AFM", "REDACT", ((0, 14, 17), (1, 0, 3)))]
    assert [(q.id, q.text, q.because, len(q.recommendations)) for q in got.again] == [("C3", "τηλ", "discovery_conflicting", 2)]
    assert {k for k, *_ in got.lost} == {"discovery_unlocatable", "discovery_malformed"} and got.distrusted
    assert CHUNK.places("12") == [(1, 5, 7)] and CHUNK.places("1") == [] and CHUNK.places("") == []


def test_calls_are_tried_again_only_if_that_may_help():
    def client(*fails):
        left = list(fails)

        def ask(_):
            if left:
                raise A.ProviderError(left.pop(0))
            return A.Answer("[]")

        return ask

    waits = []
    assert A.call(client(429, None, 503), [], sleep=waits.append).text == "[]" and waits == [0, 1, 2]
    for fails in ((400,), (500, 500, 500, 500)):
        with pytest.raises(A.ProviderError):
            A.call(client(*fails), [], sleep=waits.append)


def test_first_pass_outcomes(spark):
    rows = [("ok", '[{"text":"a","action":"redact","category":"Person"}]', "stop"), ("none", "[]", "stop"), ("cut", "[", "length"), ("prose", "sorry", "stop"), ("null", None, "stop"), ("useless", '[{"text":"a","action":"SKIP","category":"AFM"}]', "stop"), ("filter", "[]", "content_filter")]
    got = {r["k"]: r["outcome"] for r in A.first_outcome(spark.createDataFrame(rows, "k string, body string, finish_reason string"), "k").collect()}
    assert got == {"ok": "success", "none": "success", "cut": "output_truncated", "prose": "parse_failure", "null": "parse_failure", "useless": "parse_failure", "filter": "parse_failure"}


def test_from_units_to_spans_of_the_second_pass(spark):
    schema = "doc_id string, unit_ord int, text string, part_name string, table_index int, row_index int, col_index int"
    rows = [("d", 0, "ΑΦΜ", "p", 0, 0, 0), ("d", 1, "Ποσό", "p", 0, 0, 1), ("d", 2, "0371", "p", 0, 1, 0), ("d", 3, "ο Νίκος εδώ", "p", None, None, None), ("d", 4, "με Νίκος εδώ", "p", None, None, None), ("e", 0, "μόνο", "p", None, None, None)]
    own = spark.createDataFrame(rows, schema)
    texts, placed = units.render(own.join(units.pack(own), ["doc_id", "unit_ord"]))
    texts, placed = texts.cache(), placed.cache()
    assert {(r["doc_id"], r["chunk"]): r["text"] for r in texts.collect()} == {("d", 0): "TABLE:\nΑΦΜ | Ποσό\n0371", ("d", 1): "ο Νίκος εδώ\nμε Νίκος εδώ", ("e", 0): "μόνο"}
    assert {(r["doc_id"], r["unit_ord"]): r["at"] for r in placed.collect()} == {("d", 0): 7, ("d", 1): 13, ("d", 2): 18, ("d", 3): 0, ("d", 4): 12, ("e", 0): 0}
    spans = spark.createDataFrame([("d", 3, 2, 7, "REVIEW", "POSSIBLE_PERSON", 0), ("d", 2, 0, 4, "REDACT", "AFM", 1)], "doc_id string, unit_ord int, start int, end int, action string, category string, ord int")
    findings = spark.createDataFrame([("d", 1, 0, "Νίκος", "REDACT", "POSSIBLE_PERSON"), ("d", 1, 1, "nowhere", "REDACT", "AFM"), ("d", 1, 2, "ν", "REDACT", "AFM")], "doc_id string, chunk int, ord int, text string, action string, category string")
    found = A.candidates(texts, placed, spans, findings).cache()
    got = {(r["chunk"], r["id"]): (r["text"], [(list(x["sources"]), x["action"]) for x in r["recommendations"]], [(p["unit_ord"], p["start"]) for p in r["places"]], r["before"], r["after"]) for r in found.collect()}
    assert got == {
        (0, "C1"): ("0371", [(["deterministic"], "REDACT")], [(2, 0)], "TABLE:\nΑΦΜ | Ποσό\n", ""),
        (1, "C1"): ("Νίκος", [(["deterministic"], "REVIEW"), (["pass1"], "REDACT")], [(3, 2)], "ο ", " εδώ\nμε Νίκος εδώ"),
        (1, "C2"): ("Νίκος", [(["pass1"], "REDACT")], [(4, 3)], "ο Νίκος εδώ\nμε ", " εδώ"),
    }
    outcomes = spark.createDataFrame([("d", 0, "success"), ("d", 1, "success"), ("e", 0, "success")], "doc_id string, chunk int, outcome string")
    todo = A.asked(texts, outcomes, found, ["doc_id", "chunk"])
    assert sorted((r["doc_id"], r["chunk"]) for r in todo.collect()) == [("d", 0), ("d", 1)]
    segments = placed.selectExpr("doc_id", "chunk", "struct(unit_ord, at, length(text) AS n) AS s").groupBy("doc_id", "chunk").agg({"s": "collect_list"}).withColumnRenamed("collect_list(s)", "segments")
    queues = found.selectExpr("doc_id", "chunk", "struct(id, text, category, recommendations, places, before, after) AS q").groupBy("doc_id", "chunk").agg({"q": "collect_list"}).withColumnRenamed("collect_list(q)", "queue")

    def client(messages):
        asked = json.loads(messages[1]["content"])["candidates"]
        return A.Answer(json.dumps([{"id": q["id"], "action": "REDACT", "category": "POSSIBLE_PERSON" if "Ν" in q["text"] else "AFM"} for q in asked] + [{"id": "NEW", "text": "με", "action": "REDACT", "category": "AFM"}] * ("Ν" in asked[0]["text"])))

    done = A.run_second(todo.join(segments, ["doc_id", "chunk"]).join(queues, ["doc_id", "chunk"], "left"), client)
    rows = done.cache().collect()
    assert sorted((r["chunk"], r["kind"], r["id"], r["text"], r["found"]) for r in rows if r["id"]) == [(0, "decided", "C1", "0371", False), (1, "decided", "C1", "Νίκος", False), (1, "decided", "C2", "Νίκος", False)]
    spans = A.pass2_spans(done.filter("kind = 'decided'"), own).collect()
    # A span that is nothing but a preposition has nothing left to redact.
    assert sorted((r["unit_ord"], r["start"], r["end"], r["text"], r["detector"], r["origin"]) for r in spans) == [(2, 0, 4, "0371", "llm_pass2", "llm_pass2"), (3, 2, 7, "Νίκος", "llm_pass2", "llm_pass2"), (4, 3, 8, "Νίκος", "llm_pass2", "llm_pass2")]


def test_carried_preserves_remediation_and_ledger(spark):
    spans = spark.createDataFrame([(1, 0, "MONEY", "PRESERVE", "deterministic"), (2, 0, "MONEY", "PRESERVE", "deterministic"), (1, 0, "DATE", "PRESERVE", "deterministic")], "doc_id int, unit_ord int, category string, action string, origin string")
    before = spark.createDataFrame([(1, 0, "abc"), (2, 0, "abc"), (2, 1, "x")], "doc_id int, unit_ord int, text string")
    after = spark.createDataFrame([(1, 0, "a.."), (2, 0, "a..")], "doc_id int, unit_ord int, text string")
    assert [(r["doc_id"], r["category"]) for r in A.carried(spans, before, after).collect()] == [(1, "MONEY")]
    findings = spark.createDataFrame([(1, 0, "AFM"), (1, 5, "AFM"), (1, 0, None)], "doc_id int, unit_ord int, category string")
    inside, outside = A.remediation(findings, before.selectExpr("doc_id", "unit_ord", "0 AS chunk"))
    assert [(r["unit_ord"], r["action"], r["origin"]) for r in inside.collect()] == [(0, "REVIEW", "postcheck")] and [r["unit_ord"] for r in outside.collect()] == [5]
    calls = spark.createDataFrame([(1, 10, 5, "stop"), (1, None, None, "length")], "doc_id int, tokens_in int, tokens_out int, finish_reason string")
    r = A.ledger(calls).first()
    assert (r["calls"], r["tokens_in"], r["tokens_out"], r["tokens"], r["untold"], r["truncated"]) == (2, 10, 5, 15, 1, 1)
