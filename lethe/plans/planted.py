"""Queries of detectors over planted sentences, each beside SQL that knows the places by construction.

A case is a sentence with numbers of a row in braces and the spans that must be found in double brackets, and what each of them
is; a case without spans must give none.  Rows take the cases in turn.  The SQL uses no pattern: places are lengths of what was put together.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lethe.operators.detect import detect, rules

TABLE, KEY = "customer", "c_custkey"
_K = f"CAST({KEY} AS BIGINT)"
#: Numbers of a row: n as it is, i<digits> with zeros in front, j<digits> another one, y a year.
NUMBERS = {"n": f"CAST({_K} AS STRING)", "y": f"CAST(2000 + {_K} % 25 AS STRING)"}
NUMBERS |= {f"i{d}": f"lpad(CAST(({_K} * 7919 + 37173570) % {10**d} AS STRING), {d}, '0')" for d in range(2, 19)}
NUMBERS |= {f"j{d}": f"lpad(CAST(({_K} * 104729 + 12345) % {10**d} AS STRING), {d}, '0')" for d in range(2, 19)}

Case = tuple[str, list[tuple]]


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _pieces(template: str) -> tuple[list[str], list[tuple[int, int]]]:
    """SQL of the parts of a sentence, and from which to which of them each span goes."""
    parts, spans, open_ = [], [], 0
    for x in re.split(r"(\[\[|\]\]|\{\w+\})", template):
        if x == "[[":
            open_ = len(parts)
        elif x == "]]":
            spans.append((open_, len(parts)))
        elif x.startswith("{") and x[1:-1] in NUMBERS:
            parts.append(NUMBERS[x[1:-1]])
        elif x:
            parts.append(_quoted(x))
    return parts, spans


def text_sql(cases: list[Case]) -> str:
    whens = " ".join(f"WHEN {i} THEN concat('', {', '.join(_pieces(t)[0])})" for i, (t, _) in enumerate(cases))
    return f"CASE {KEY} % {len(cases)} {whens} END"


def oracle(cases: list[Case]) -> str:
    selects = []
    for i, (template, found) in enumerate(cases):
        parts, spans = _pieces(template)
        assert len(spans) == len(found), template
        for (a, b), (category, action, confidence, detector) in zip(spans, found, strict=True):
            at = " + ".join(["0", *(f"length({x})" for x in parts[:a])])
            value = f"concat('', {', '.join(parts[a:b])})"
            selects.append(f"SELECT {KEY}, CAST({at} AS BIGINT) AS start, {value} AS value, '{category}' AS category, '{action}' AS action, CAST({confidence} AS DOUBLE) AS confidence, '{detector}' AS detector FROM {TABLE} WHERE {KEY} % {len(cases)} = {i}")
    return " UNION ALL ".join(selects)


def planted(names: tuple[str, ...], cases: list[Case]) -> tuple[Callable[[SparkSession, str], DataFrame], str]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spark.read.parquet(f"{sf_dir}/{TABLE}.parquet").select(KEY, F.expr(text_sql(cases)).alias("text"))
        found = detect(df, rules(*names))
        return found.select(KEY, F.col("start").cast("long").alias("start"), F.col("text").alias("value"), "category", "action", "confidence", "detector")

    return run, oracle(cases)


_V9 = NUMBERS["i9"]
_AFM_OK = "(" + " + ".join(f"CAST(substr({_V9}, {i + 1}, 1) AS INT) * {1 << (8 - i)}" for i in range(8)) + f") % 11 % 10 = CAST(substr({_V9}, 9, 1) AS INT)"


def _afm(label: float):
    return [("AFM", "REDACT", f"CASE WHEN {_AFM_OK} THEN 1.0 ELSE {label} END", "afm_checksum")]


def _one(category: str, action: str, confidence, detector: str):
    return [(category, action, confidence, detector)]


_PROPERTY = {x: ("PROPERTY_ID", "REDACT", 1.0, x) for x in ("atak", "kaek", "ot", "axk", "notice_number")}
_LABEL = ("FIELD_LABEL", "PRESERVE", 1.0, "field_label")
_ADDRESS = ("PRIVATE_ADDRESS", "REDACT", 0.85, "private_address_ctx")
_INLINE = ("INVOICE_TABLE_ID", "REDACT", 0.85, "invoice_inline")
_SERVICE, _LEGAL = ("PUBLIC_SERVICE", "PRESERVE", 0.9, "public_service_gazetteer"), ("LEGAL_REF", "PRESERVE", 0.9, "legal_ref_gazetteer")

CASES: dict[str, tuple[tuple[str, ...], list[Case]]] = {
    "detect_afm": (
        ("afm_checksum",),
        [
            ("με τον Α.Φ.Μ. [[{i9}]] κατοίκου", _afm(0.75)),
            ("ΑΦΜ   :           [[{i9}]].", _afm(0.75)),
            ("χωρίς [[{i9}]].", _afm(0.4)),
            ("αριθμός {i10} και {i8}", []),
            ("afm [[{i9}]], αφμ [[{i9}]]", _afm(0.75) * 2),
        ],
    ),
    "detect_email_spans": (
        ("email",),
        [
            ("γράψτε στο [[info@aade.gr]].", _one("PUBLIC_SERVICE", "PRESERVE", 0.95, "public_email_domain")),
            ("[[user.{n}@sub.aade.gr]], τέλος", _one("EMAIL", "REDACT", 0.95, "email_regex")),
            ("([[a_{n}+x@mail.example.com]])", _one("EMAIL", "REDACT", 0.95, "email_regex")),
            ("χωρίς διεύθυνση @{n} ή x@y", []),
            ("ΑΠΟ [[K{n}@GOV.GR]]!", _one("PUBLIC_SERVICE", "PRESERVE", 0.95, "public_email_domain")),
        ],
    ),
    "detect_protocol_spans": (
        ("protocol_number", "audit_order"),
        [
            ("αριθ. πρωτ. [[{i5}]]/{y} έγγραφο", _one("PROTOCOL_NUMBER", "REDACT", 0.85, "protocol_number")),
            ("αρ. πρωτ. [[{i5}]]/30-03-2026 και", _one("PROTOCOL_NUMBER", "REDACT", 0.85, "protocol_number")),
            ("αριθμό πρωτοκόλλου: [[ΓΠ{n}]]", _one("PROTOCOL_NUMBER", "REDACT", 0.85, "protocol_number")),
            ("πρωτόκολλο χωρίς αριθμό", []),
            ("εντολή ελέγχου [[{i4}]] & [[{j4}]]", [("AUDIT_ORDER", "REDACT", 0.85, "audit_order")] * 2),
            ("Πρόσκληση [[{i4}]]/15-03-2026", _one("AUDIT_ORDER", "REDACT", 0.85, "audit_order")),
        ],
    ),
    "detect_acts": (
        ("act_number", "invoice_number", "transaction_id"),
        [
            ("Πράξη [[{i4}/{y}]] του", _one("ACT_NUMBER", "REDACT", 0.85, "act_number")),
            ("Τιμολόγιο [[{n}]] και", _one("INVOICE_NUMBER", "REDACT", 0.85, "invoice_number")),
            ("Α/Α [[{n}]].", _one("INVOICE_NUMBER", "REDACT", 0.85, "invoice_number")),
            ("Συναλλαγή: [[AB{i6}]]", _one("TRANSACTION_ID", "REDACT", 0.85, "transaction_id")),
            ("πράξη χωρίς αριθμό, τιμολογίου {n}", []),
        ],
    ),
    "detect_challenged_spans": (
        ("challenged_act_ctx",),
        [
            ("κατά της υπ’ αριθ. [[{i4}]]/{y} Οριστικής Πράξης", _one("CHALLENGED_ACT_NUMBER", "REDACT", 0.9, "challenged_act_ctx")),
            ("με αριθ. [[{i4}]]/13-07-2021 πράξη επιβολής φόρου", _one("CHALLENGED_ACT_NUMBER", "REDACT", 0.9, "challenged_act_ctx")),
            ("με αριθ. {i4} απάντηση της υπηρεσίας", []),
            ("υπ' αρ. [[{i4}]] διορθωτικός προσδιορισμός προστίμου", _one("CHALLENGED_ACT_NUMBER", "REDACT", 0.9, "challenged_act_ctx")),
        ],
    ),
    "detect_dates_spans": (
        ("date_numeric", "date_greek"),
        [
            ("εκδόθηκε στις [[15/03/{y}]] από", _one("PROCEDURAL_DATE", "PRESERVE", 0.95, "procedural_date")),
            ("ημερομηνία κατάθεσης: [[5 Μαρτίου {y}]]", _one("PROCEDURAL_DATE", "PRESERVE", 0.9, "procedural_date")),
            ("Παπαδόπουλος Ιωάννης, [[03/05/1981]], ΑΦΜ", _one("DATE", "PRESERVE", 0.95, "date_numeric")),
            ("στις [[28η Οκτωβρίου {y}]].", _one("DATE", "PRESERVE", 0.9, "date_greek")),
            ("με αριθμό 1{i2}/03/{y} ή 5 Μάρτη {y}", []),
            ("ΕΚΔΌΘΗΚΕ ΣΤΙΣ [[1-2-{y}]]", _one("PROCEDURAL_DATE", "PRESERVE", 0.95, "procedural_date")),
        ],
    ),
    "detect_dou": (
        ("dou_gazetteer",),
        [
            ("η [[Δ.Ο.Υ. Γλυφάδας]] με", _one("DOU", "PRESERVE", 0.95, "dou_gazetteer")),
            ("στη [[ΔΟΥ Άνω Πόλης]] {n}", _one("DOU", "PRESERVE", 0.7, "dou_gazetteer")),
            ("της [[δου  ΚΗΦΙΣΙΑΣ]], {n}", _one("DOU", "PRESERVE", 0.7, "dou_gazetteer")),
            ("η Δ.Ο.Υ. αρμόδια {n}", []),
        ],
    ),
    "detect_legal_spans": (
        ("legal_ref_law", "legal_ref_pd", "legal_ref_short", "legal_ref_fek", "legal_ref_pol", "legal_ref_ste", "legal_ref_nsk", "legal_ref_aade", "article_ref", "court_decision"),
        [
            ("κατά το [[ν. {n}/2013]].", _one("LEGAL_REF", "PRESERVE", 0.95, "legal_ref_law")),
            ("το [[Π.Δ. {n}/1986]],", _one("LEGAL_REF", "PRESERVE", 0.9, "legal_ref_pd")),
            ("του [[Κ.Φ.Δ.]] {n}", _one("LEGAL_REF", "PRESERVE", 0.9, "legal_ref_short")),
            ("[[ΦΕΚ Β' {n}/2014]] {n}", _one("LEGAL_REF", "PRESERVE", 0.95, "legal_ref_fek")),
            ("την [[ΠΟΛ 1064/12-2017]] {n}", _one("LEGAL_REF", "PRESERVE", 0.95, "legal_ref_pol")),
            ("[[ΣτΕ {n}/1992]], [[ΝΣΚ {n}/2001]]", [("LEGAL_REF", "PRESERVE", 0.95, "legal_ref_ste"), ("LEGAL_REF", "PRESERVE", 0.95, "legal_ref_nsk")]),
            ("η [[Α.Α.Δ.Ε.]] {n}", _one("LEGAL_REF", "PRESERVE", 0.95, "legal_ref_aade")),
            ("[[άρθρο {n} παρ. 3]] και [[περ. β]]", [("ARTICLE_REF", "PRESERVE", 0.9, "article_ref")] * 2),
            ("απόφαση [[Α.{i4}/{y}]] χωρίς", _one("COURT_DECISION", "PRESERVE", 0.85, "court_decision")),
            ("άρθρα, ΠΟΛΗ {n}, ΦΕΚ χωρίς αριθμό", []),
        ],
    ),
    "detect_money_spans": (
        ("money_amount", "percentage", "tax_year", "fiscal_period"),
        [
            ("ποσό [[€ {i3},50]] οφειλή", _one("MONEY", "PRESERVE", 0.95, "money_amount")),
            ("ποσό [[1.234,56 ευρώ]] {n}", _one("MONEY", "PRESERVE", 0.95, "money_amount")),
            ("συντελεστής [[{i2}%]] και [[3,5 %]]", [("PERCENTAGE", "PRESERVE", 0.95, "percentage")] * 2),
            ("[[οικονομικό έτος {y}]], [[χρήση {y}]]", [("TAX_YEAR", "PRESERVE", 0.9, "tax_year")] * 2),
            ("[[01/01/{y} έως 31/12/{y}]]", _one("FISCAL_PERIOD", "PRESERVE", 0.9, "fiscal_period")),
            ("[[φορολογική περίοδος {y}]]", _one("FISCAL_PERIOD", "PRESERVE", 0.9, "fiscal_period")),
            ("ποσό 12.50, έτος {y}, {n} τοις εκατό", []),
        ],
    ),
    "detect_metadata": (
        ("decision_number", "decision_place_date"),
        [
            ("[[Αριθμός απόφασης: {n}]]", _one("DECISION_METADATA", "PRESERVE", 0.98, "decision_number")),
            ("[[Καλλιθέα, 15/03/{y}]]", _one("DECISION_METADATA", "PRESERVE", 0.98, "decision_place_date")),
            ("Σπάρτη, 15/03/{y}, αριθμός {n}", []),
        ],
    ),
    "detect_appellant": (
        ("appellant_name_ctx", "father_name_ctx"),
        [
            ("προσφυγή του [[ΜΙΧΟΥ ΝΙΚΟΛΑΟΥ]] [[του ΔΗΜΗΤΡΙΟΥ]] με ΑΦΜ {i9}", [("APPELLANT_NAME", "REDACT", 0.9, "appellant_name_ctx"), ("FATHER_NAME", "REDACT", 0.85, "father_name_ctx")]),
            ("ο κ. [[Παπαδόπουλος]] και {n}", _one("APPELLANT_NAME", "REDACT", 0.9, "appellant_name_ctx")),
            ("γιος [[της Μαρίας]] κατοίκου {n}", _one("FATHER_NAME", "REDACT", 0.85, "father_name_ctx")),
            ("και Άλλα {n}, προσφυγή του υπόχρεου", []),
        ],
    ),
    "detect_address": (
        ("private_address_ctx", "address_number", "postal_code"),
        [
            ("κατοίκου [[Χαλανδρίου]] Αττικής, {n}", [_ADDRESS]),
            ("οδός [[Βορείου Ηπείρου]], {n}", [_ADDRESS]),
            ("κατοίκου [[Θεσσαλονίκης]].", [_ADDRESS]),
            ("οδός [[Διομήδους]] αρ. [[{i2}]], Τ.Κ. [[{i5}]]", [_ADDRESS, ("PRIVATE_ADDRESS", "REDACT", 0.8, "address_number"), ("PRIVATE_ADDRESS", "REDACT", 0.9, "postal_code")]),
            ("υπ' αρ. {i3}/2020 δικαστική απόφαση, ΤΚ {i4}", []),
        ],
    ),
    "detect_companies": (
        ("company_ctx", "business_seat_ctx"),
        [
            ("η εταιρεία [[ΑΛΦΑ ΒΗΤΑ & ΓΑΜΑ Α.Ε.]] στη {n}", _one("PRIVATE_COMPANY_NAME", "REDACT", 0.85, "company_ctx")),
            ("με επωνυμία [[Delta Trading]] {n}", _one("PRIVATE_COMPANY_NAME", "REDACT", 0.85, "company_ctx")),
            ("η εταιρεία μας {n}", []),
            ("με έδρα την [[Πάτρα]], οδός {n}", _one("BUSINESS_SEAT", "REDACT", 0.85, "business_seat_ctx")),
        ],
    ),
    "detect_bank": (
        ("bank_account_ctx", "beneficiary_ctx"),
        [
            ("στον λογαριασμό [[{i12}]] και", _one("BANK_ACCOUNT", "REDACT", 0.85, "bank_account_ctx")),
            ("λογ. [[GR{i10}]], {n}", _one("BANK_ACCOUNT", "REDACT", 0.85, "bank_account_ctx")),
            ("η Τράπεζα Πειραιώς {n}", []),
            ("δικαιούχο τον [[Γεώργιο Παπαδόπουλο]] με {n}", _one("PRIVATE_BENEFICIARY", "REDACT", 0.9, "beneficiary_ctx")),
            ("δικαιούχο τον ίδιο, λογ. {i5}", []),
        ],
    ),
    "detect_fiscal": (
        ("fiscal_device_ctx", "partial_star"),
        [
            ("ΦΗΜ [[ABC{i6}]], και", _one("FISCAL_DEVICE_ID", "REDACT", 0.85, "fiscal_device_ctx")),
            ("συσκευή [[DCX *****{i3}]] εδώ", _one("FISCAL_DEVICE_ID", "REDACT", 0.9, "partial_star")),
            ("χωρίς μηχανή {n}, ** {n}", []),
        ],
    ),
    "detect_invoice_inline": (
        ("invoice_inline", "invoice_paragraph", "invoice_series"),
        [
            ("το ΤΙΜ. [[{n}]] σειρά [[Β]] εκδόθηκε", [_INLINE] * 2),
            ("ΤΠΥ [[{n}]], και", [_INLINE]),
            ("του τιμολογίου {n}, ο Επαμεινώνδας", []),
        ],
    ),
    "detect_labels": (
        ("field_label",),
        [
            ("με [[Α.Φ.Μ.]] {i9} και [[Τ.Κ.]] {i5}", [_LABEL] * 2),
            ("ΙΒΑΝ ΠΕΤΡΟΦ, ΙΒΑΝ 45 ετών, IBANEZ {n}", []),
            ("[[IBAN]] GR{i2} και [[ΙΒΑΝ]] ......", [_LABEL] * 2),
            ("[[κατοίκου]] Χαλανδρίου, [[οδός]] Διομήδους [[αρ.]] {n}", [_LABEL] * 3),
            ("[[Τηλέφωνο]]: {i10}, [[E-mail]]: a{n}@b.gr, [[Fax]] {n}", [_LABEL] * 3),
            ("Α.Τ.Κ. ΑΛΕΞΑΝΔΡΟΣ {n}", []),
            ("[[ΑΤΑΚ]] {i11}, [[αρ. πρωτ.]] ΓΠ{n}", [_LABEL] * 2),
        ],
    ),
    "detect_property_spans": (
        ("atak", "kaek", "ot", "axk", "notice_number"),
        [
            ("ΑΤΑΚ [[{i11}]], [[{j11}]] και [[{i11}]] στο", [_PROPERTY["atak"]] * 3),
            ("ΚΑΕΚ [[{i12}]]/0/0 και", [_PROPERTY["kaek"]]),
            ("ΚΑΕΚ [[{i12}/1/0]] και", [_PROPERTY["kaek"]]),
            ("Ο.Τ. [[12Α]] και [[13Β]] στο {n}", [_PROPERTY["ot"]] * 2),
            ("ο.τ. [[{n}α]].", [_PROPERTY["ot"]]),
            ("Α.Χ.Κ. [[76/{i5}]], [[77/{j5}]]", [_PROPERTY["axk"]] * 2),
            ("αριθμό ειδοποίησης [[{i7}]]/15-03-2026", [_PROPERTY["notice_number"]]),
            ("αριθμό ειδοποίησης [[{i7}]]/{y}", [_PROPERTY["notice_number"]]),
            ("ΑΤΑΚ χωρίς αριθμό, ΚΑΕΚ {i8}", []),
        ],
    ),
    "detect_case_court": (
        ("case_court_serial", "court_chamber"),
        [
            ("τη με αριθμό [[{i3}]]/2020 απόφαση του (Τμήμα [[1ο]] Τριμελές)", [("CASE_COURT_REFERENCE", "PRESERVE", 0.85, "case_court_serial"), ("CASE_COURT_REFERENCE", "PRESERVE", 0.85, "court_chamber")]),
            ("με αριθμό {i3}/2020 έγγραφο, ΣτΕ {n}/1992", []),
        ],
    ),
    "detect_locality_spans": (
        ("locality_authority", "locality_ctx"),
        [
            ("του Δήμου [[Χαλκιδέων]] αριθμός {n}", _one("LOCALITY", "REDACT", 1.0, "locality_authority")),
            ("στη συνοικία Η΄ [[Χαλκίδας]] {n}", _one("LOCALITY", "REDACT", 0.85, "locality_ctx")),
            ("του δήμου Χαλκιδέων, περιοχή με {n}", []),
        ],
    ),
    "review_hints": (
        ("greek_name_shape", "company_suffix", "street_shape", "medical_term_list"),
        [
            ("ο [[Ιωάννης Παπαδόπουλος]] ήταν {n}", _one("POSSIBLE_PERSON", "REVIEW", 0.45, "greek_name_shape")),
            ("η [[Άλφα Α.Ε.]] είχε {n}", _one("POSSIBLE_COMPANY", "REVIEW", 0.65, "company_suffix")),
            ("στην [[οδός Ερμού {i2}]]", _one("POSSIBLE_PRIVATE_LOCATION", "REVIEW", 0.6, "street_shape")),
            ("έχει [[Διαβήτης]] και [[θεραπεία]] {n}", [("MEDICAL_TERM", "REVIEW", 0.5, "medical_term_list")] * 2),
            ("ο άνθρωπος με {n} ΑΕΡΑΣ", []),
        ],
    ),
    "detect_phones": (
        ("phone_intl", "phone_00", "phone_local"),
        [
            ("τηλ. [[0030{i10}]], ώρες", _one("PHONE", "REVIEW", 0.9, "phone_00")),
            ("κιν. [[69{i8}]].", _one("PHONE", "REVIEW", 0.7, "phone_local")),
            ("αριθμός 99{i8}, 69{i9}", []),
        ],
    ),
}

#: Audited sentences: each span with its kind and severity.
AUDITED: list[Case] = [
    ("με ΑΦΜ [[037173570]] και {n}", [("residual_afm", "HIGH")]),
    ("αριθμός [[123456789]], {n}", [("afm_shape", "MEDIUM")]),
    ("ΑΜΚΑ [[{m}]] {n}", [("residual_amka", "HIGH")]),
    ("λογαριασμός [[GR1601101250000000012300695]], {n}", [("residual_iban", "HIGH")]),
    ("στο [[user{n}@example.com]].", [("residual_email", "HIGH")]),
    ("στο info{n}@aade.gr.", []),
    ("κινητό [[2101234567]] τέλος", [("phone_shape", "MEDIUM")]),
    ("Τηλέφωνο: 2101234567, {n}", []),
    ("σειρά [[91{i8}]].", [("digit_run", "MEDIUM")]),
    ("ο [[<REDACTED>]] και [[PERSON_{n}]]", [("wrong_placeholder", "HIGH")] * 2),
    ("τέλος [[……]] και [[…]] {n}", [("ellipsis_residue", "HIGH"), ("ellipsis_residue", "MEDIUM")]),
    ("αρ. πρωτ. [[{i5}/{y}]] και", [("case_ref_leak", "MEDIUM")]),
    ("δικαιούχο τον [[Γεώργιο Παπαδόπουλο]] με {n}", [("beneficiary_leak", "MEDIUM")]),
    ("συσκευή [[DCX **{i3}]] εδώ", [("partial_star_residue", "MEDIUM")]),
    ("ενδικοφανή προσφυγή του [[ΜΙΧΟΥ ΝΙΚΟΛΑΟΥ]] κατά {n}", [("person_name_leak", "MEDIUM")]),
    ("[[Αριθμός απόφασης: .....]] και [[..%]] {n}", [("over_redaction", "MEDIUM")] * 2),
    ("Ο.Τ. ..., [[12α]] και ...", [("residual_property_id", "HIGH")]),
    ("Ο.Τ. ... 2019 ήταν {n}", []),
    ("καθαρό κείμενο {n}", []),
]
NUMBERS["m"] = f"concat('01', '0', CAST(1 + {_K} % 9 AS STRING), '1', CAST({_K} % 10 AS STRING), '12345')"


def audit_oracle() -> str:
    selects = []
    for i, (template, found) in enumerate(AUDITED):
        parts, spans = _pieces(template)
        assert len(spans) == len(found), template
        for (a, b), (kind, severity) in zip(spans, found, strict=True):
            at = " + ".join(["0", *(f"length({x})" for x in parts[:a])])
            selects.append(f"SELECT {KEY}, CAST({at} AS BIGINT) AS start, concat('', {', '.join(parts[a:b])}) AS value, '{kind}' AS kind, '{severity}' AS severity FROM {TABLE} WHERE {KEY} % {len(AUDITED)} = {i}")
    return " UNION ALL ".join(selects)


def audit_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lethe.operators import audit

    df = spark.read.parquet(f"{sf_dir}/{TABLE}.parquet").select(KEY, F.expr(text_sql(AUDITED)).alias("text"))
    return audit.scan(df).select(KEY, F.col("start").cast("long").alias("start"), F.col("text").alias("value"), "kind", "severity")


#: A category, a span in curved brackets and what is left of it in double ones.
NARROWED: list[tuple[str, str]] = [
    ("AFM", "ο ⟦με Α.Φ.Μ. [[{i9}]]⟧ και"),
    ("PROTOCOL_NUMBER", "⟦«αρ. πρωτ. [[{i5}]]/{y}»⟧"),
    ("PROTOCOL_NUMBER", "⟦[[{i5}]]/30-03-2026⟧"),
    ("PROPERTY_ID", "Α.Χ.Κ. ⟦[[76/{i5}]]⟧"),
    ("PROPERTY_ID", "⟦αριθμό ειδοποίησης [[{i7}]]/15-03-2026⟧"),
    ("POSSIBLE_COMPANY", "⟦[[Στο Σπίτι {n}]]⟧"),
    ("POSSIBLE_PERSON", "⟦με [[Παπαδόπουλο {n}]],⟧"),
    ("POSSIBLE_PERSON", "⟦[[Ibanez {n}]]⟧"),
    ("AFM", "⟦ΑΦΜ:⟧ {n}"),
    ("PRIVATE_ADDRESS", "⟦κατοίκου [[Χαλανδρίου]] Αττικής⟧ {n}"),
    ("PRIVATE_ADDRESS", "⟦[[Αττικής]]⟧ {n}"),
    ("BANK_ACCOUNT", "⟦στον λογαριασμό [[GR{i10}]] .⟧"),
    ("AFM", "⟦ ,.;⟧ {n}"),
]


def _narrow_sql(template: str) -> tuple[str, str, str]:
    """SQL of the text, and of where the given span begins and ends."""
    ahead, _, rest = template.partition("⟦")
    inner, _, behind = rest.partition("⟧")
    length = lambda x: " + ".join(["0", *(f"length({p})" for p in _pieces(x)[0])])
    whole = f"concat('', {', '.join(_pieces(ahead + inner + behind)[0])})"
    return whole, f"({length(ahead)})", f"({length(ahead + inner)})"


def narrow_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    case = lambda xs: f"CASE {KEY} % {len(NARROWED)} " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(xs)) + " END"
    sql = [_narrow_sql(t) for _, t in NARROWED]
    df = spark.read.parquet(f"{sf_dir}/{TABLE}.parquet")
    return df.select(KEY, F.expr(case([x[0] for x in sql])).alias("text"), F.expr(case([x[1] for x in sql])).alias("start"), F.expr(case([x[2] for x in sql])).alias("end"), F.expr(case([_quoted(c) for c, _ in NARROWED])).alias("category"))


def narrow_oracle() -> str:
    selects = []
    for i, (_, template) in enumerate(NARROWED):
        parts, spans = _pieces(template.replace("⟦", "").replace("⟧", ""))
        for a, b in spans:
            at = " + ".join(["0", *(f"length({x})" for x in parts[:a])])
            selects.append(f"SELECT {KEY}, CAST({at} AS BIGINT) AS start, concat('', {', '.join(parts[a:b])}) AS value FROM {TABLE} WHERE {KEY} % {len(NARROWED)} = {i}")
    return " UNION ALL ".join(selects)


def package(paragraphs: list[str], kind: str = "docx", more: dict[str, bytes] | None = None, body: str = "") -> bytes:
    """A small Word package in memory."""
    import io
    import zipfile
    from xml.sax.saxutils import escape

    from lethe.sources import word

    types = {v: k for k, v in word.KINDS.items()}
    p = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(x, {chr(13): "&#13;"})}</w:t></w:r></w:p>' for x in paragraphs)
    parts = {
        word.TYPES: f'<?xml version="1.0"?><Types xmlns="{word.TYPES_NS}"><Default Extension="xml" ContentType="application/xml"/><Override PartName="/{word.MAIN}" ContentType="{types[kind]}"/></Types>'.encode(),
        word.RELS: f'<?xml version="1.0"?><Relationships xmlns="{word.RELS_NS}"><Relationship Id="r1" Type="{word.OFFICE_DOCUMENT}" Target="{word.MAIN}"/></Relationships>'.encode(),
        word.MAIN: f'<?xml version="1.0"?><w:document xmlns:w="{word.W}"><w:body>{body}{p}</w:body></w:document>'.encode(),
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in (parts | (more or {})).items():
            z.writestr(name, data)
    return out.getvalue()


def packages(frames):
    import pandas as pd

    for whole in frames:
        for at in range(0, len(whole), 100):
            f = whole.iloc[at : at + 100]
            yield pd.DataFrame({"document_id": [str(i) for i in f["doc_id"]], "content": [package((t or "").split("\n")) for t in f["text"]]})


def odd_packages(frames):
    """Of four packages one is a document, one no package, one of the old kind, one with macros."""
    import pandas as pd

    from lethe.sources import word

    for f in frames:
        for i, t in zip(f["doc_id"], f["text"], strict=True):
            made = (package([t or ""]), b"no package", word.OLE2 + b"x", package([t or ""], "docm", {"word/vbaProject.bin": b"x"}))[i % 4]
            yield pd.DataFrame({"document_id": [str(i)], "content": [made]})
