"""Detectors: rules over text units that propose spans.

All rules of a rule set are evaluated in one projection and exploded once, so the text is scanned
by one stage whatever the number of rules.  A rule names strings of which a text that it matches must hold one; the others
cost a search for those strings in the lower-cased text, not a regular expression.

Defined cases: a null or empty text has no spans; units without unit_type count as paragraphs; a cell without a header has
an empty one; repeated units are detected alike; no units give no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lethe.functions import scalars
from lethe.functions.spans import after, before, behind, cut, find_spans, none
from lethe.operators import gazetteers
from lethe.operators import patterns as P

Given = str | Callable[[Column, Column], Column]
_LOW = "__low"


@dataclass(frozen=True)
class Rule:
    """value after prefix; what is callable is computed from the text and a span of it."""

    detector: Given
    category: Given
    action: Given
    confidence: float | Callable[[Column, Column], Column]
    value: str
    prefix: str = ""
    suffix: str = ""
    flags: str = "iU"
    name: str = ""
    when: Callable[[Column, Column], Column] | None = None
    #: Moves or shortens a span.
    adjust: Callable[[Column, Column], Column] | None = None
    #: Splits what is left into the values that are spans of their own, and shortens those.
    each: str | None = None
    shorten: Callable[[Column], Column] | None = None
    #: Strings in lower case of which each text that matches holds one; none if it matches without.
    needs: tuple[str, ...] = ()
    #: "table_cell" or "paragraph" if it is for those only.
    unit: str = ""
    #: Names that are looked for instead of a pattern.
    entries: tuple[str, ...] = ()

    @property
    def key(self) -> str:
        return self.name or str(self.detector)


_DIGITS = tuple("0123456789")


def _pattern(name: str, category: Given, action: Given, confidence, *, detector: Given | None = None, suffix: str = "", flags: str = "iU", needs: tuple[str, ...] = (), **more) -> Rule:
    prefix, body = P.PATTERNS[name]
    return Rule(detector or name, category, action, confidence, body, prefix, suffix, flags, name, needs=needs, **more)


def _lead(t: Column, s: Column) -> Column:
    return F.length(s["lead"]) > 0


def _public(yes: str, no: str):
    return lambda t, s: F.when(F.lower(F.substring_index(s["text"], "@", -1)).isin(*P.PUBLIC_DOMAINS), yes).otherwise(no)


def _dated(yes: str, no: str):
    return lambda t, s: F.when(before(t, s["start"], 40).rlike(P.PROCEDURAL_CUE), yes).otherwise(no)


def _without_article(t: Column, s: Column) -> Column:
    """A patronymic keeps its article, but not after an appeal, whose article that is."""
    name = F.regexp_replace(s["text"], r"(?iUd)^τ(?:ου|ης)\s+", "")
    return F.when(before(t, s["start"], 24).rlike(P.APPEAL_BEFORE), behind(s, F.length(s["text"]) - F.length(name))).otherwise(s)


def _alternatives(entries: tuple[str, ...], end: str = "") -> str:
    """Entries as a pattern, longest first."""
    return "|".join(rf"\Q{x}\E{end}" for x in sorted(entries, key=len, reverse=True))


def _without_region(regions: tuple[str, ...]) -> Callable[[Column, Column], Column]:
    """A residence without the administrative region behind it, unless it is nothing else."""

    def adjust(t: Column, s: Column) -> Column:
        head = F.regexp_extract(s["text"], rf"(?iUd)^(.*?)\s*(?:{_alternatives(regions)})$", 1)
        lived = before(t, s["start"], 40).rlike(rf"(?iUd)(?:{P.RESIDENT})\s*$")
        return F.when(lived & (head != ""), cut(s, head)).otherwise(s)

    return adjust


def _office(offices: tuple[str, ...]) -> dict:
    """A label and the longest known office behind it, or else a run of capitalised words."""
    known = lambda t, s: F.when(s["text"].rlike(rf"(?Ud)^{P.DOU_LABEL}(?i:{_alternatives(offices)})$"), 0.95).otherwise(0.7)
    return {"confidence": known, "value": rf"{P.DOU_LABEL}(?:(?i:{_alternatives(offices, chr(92) + 'b')})|{P.NAMES})"}


def _fold(x: Column) -> Column:
    return F.replace(F.lower(x), F.lit("ς"), F.lit("σ"))


def _no_service(known: tuple[str, ...]) -> Callable[[Column, Column], Column]:
    """Whether a name holds no public service's."""

    def when(t: Column, s: Column) -> Column:
        services = F.array(*[F.lit(x.lower().replace("ς", "σ")) for x in known if x])
        return ~F.exists(services, lambda x: F.contains(_fold(s["text"]), x))

    return when


def _zero_suffix(v: Column) -> Column:
    return F.when(v.rlike(r"^[0-9]{12}(?:/0+)+$"), F.substring(v, 1, 12)).otherwise(v)


_LEGAL = (
    ("legal_ref_law", "LEGAL_REF", 0.95, ("ν",)),
    ("legal_ref_pd", "LEGAL_REF", 0.9, ("π.δ.",)),
    ("legal_ref_short", "LEGAL_REF", 0.9, ("κ.φ.δ.", "κ.ν.")),
    ("legal_ref_fek", "LEGAL_REF", 0.95, ("φεκ",)),
    ("legal_ref_pol", "LEGAL_REF", 0.95, ("πολ",)),
    ("legal_ref_ste", "LEGAL_REF", 0.95, ("στε",)),
    ("legal_ref_nsk", "LEGAL_REF", 0.95, ("νσκ",)),
    ("legal_ref_aade", "LEGAL_REF", 0.95, ("δε", "δ.", "ε.")),
    ("article_ref", "ARTICLE_REF", 0.9, ("άρ", "παρ", "εδάφιο", "περ.")),
    ("court_decision", "COURT_DECISION", 0.85, ("α.",)),
)
_INVOICE = ("τιμ", "τπυ", "δα", "απυ", "δελτιο")

RULES: tuple[Rule, ...] = (
    Rule("afm_checksum", "AFM", "REDACT", lambda t, s: F.when(scalars.afm_valid(s["text"]), 1.0).when(_lead(t, s), 0.75).otherwise(0.4), P.PATTERNS["afm"][1], rf"(?<!\d)(?:{P.PATTERNS['afm'][0]})?", r"(?!\d)"),
    Rule("amka_date", "AMKA", "REDACT", lambda t, s: F.when(scalars.amka_valid(s["text"]), 0.95).when(_lead(t, s), 0.75).otherwise(0.5), P.PATTERNS["amka"][1], rf"(?<!\d)(?:{P.PATTERNS['amka'][0]})?", r"(?!\d)"),
    Rule("iban_checksum", "IBAN", "REDACT", lambda t, s: F.when(scalars.iban_valid(s["text"]), 1.0).otherwise(0.3), rf"\b{P.PATTERNS['iban'][1]}\b"),
    Rule(_public("public_email_domain", "email_regex"), _public("PUBLIC_SERVICE", "EMAIL"), _public("PRESERVE", "REDACT"), 0.95, rf"\b{P.PATTERNS['email'][1]}\b", name="email", needs=("@",)),
    *(Rule(x, "PHONE", "REVIEW", c, rf"(?<!\d){P.PATTERNS[x][1]}(?!\d)", flags="U", needs=n) for x, c, n in (("phone_intl", 0.9, ("+30",)), ("phone_00", 0.9, ("0030",)), ("phone_local", 0.7, ()))),
    _pattern("protocol_number", "PROTOCOL_NUMBER", "REDACT", 0.85, adjust=lambda t, s: cut(s, scalars.serial_without_date_and_year(s["text"])), each=r"[^/&\s]+", needs=("πρωτ",)),
    _pattern("audit_order", "AUDIT_ORDER", "REDACT", 0.85, adjust=lambda t, s: cut(s, scalars.serial_without_date_and_year(s["text"])), each=r"[^/&\s]+", needs=("ελέγχου", "γνωστοποίησ", "παροχής", "πρόσκλησ", "πληροφοριακή", "αβμ", "εξ")),
    _pattern("act_number", "ACT_NUMBER", "REDACT", 0.85, needs=("πράξη",)),
    _pattern("invoice_number", "INVOICE_NUMBER", "REDACT", 0.85, needs=("τιμολόγιο", "α/α")),
    _pattern("transaction_id", "TRANSACTION_ID", "REDACT", 0.85, needs=("συναλλαγή", "id")),
    _pattern("challenged_act", "CHALLENGED_ACT_NUMBER", "REDACT", 0.9, detector="challenged_act_ctx", when=lambda t, s: after(t, s["end"], 100).rlike(P.TAX_ACT_CUE), adjust=lambda t, s: cut(s, scalars.serial_of(s["text"])), needs=("υπ", "αριθ")),
    _pattern("date_numeric", _dated("PROCEDURAL_DATE", "DATE"), "PRESERVE", 0.95, detector=_dated("procedural_date", "date_numeric")),
    _pattern("date_greek", _dated("PROCEDURAL_DATE", "DATE"), "PRESERVE", 0.9, detector=_dated("procedural_date", "date_greek"), needs=("ου",)),
    Rule("dou_gazetteer", "DOU", "PRESERVE", flags="U", needs=("δ.ο.υ.", "δου"), **_office(gazetteers.DOU)),
    *(_pattern(x, category, "PRESERVE", c, needs=n) for x, category, c, n in _LEGAL),
    _pattern("money", "MONEY", "PRESERVE", 0.95, detector="money_amount", needs=(",",)),
    _pattern("tax_year", "TAX_YEAR", "PRESERVE", 0.9, needs=("έτος", "χρήση")),
    _pattern("percentage", "PERCENTAGE", "PRESERVE", 0.95, needs=("%",)),
    _pattern("fiscal_period", "FISCAL_PERIOD", "PRESERVE", 0.9, needs=("έως", "περίοδος")),
    _pattern("decision_number", "DECISION_METADATA", "PRESERVE", 0.98, needs=("πόφασης",)),
    _pattern("decision_place_date", "DECISION_METADATA", "PRESERVE", 0.98, needs=("αθήνα", "καλλιθέα", "θεσσαλονίκη", "πάτρα", "ηράκλειο", "λάρισα", "βόλος", "ιωάννινα")),
    _pattern("appellant_name", "APPELLANT_NAME", "REDACT", 0.9, detector="appellant_name_ctx", flags="U", needs=("προσφυγή", "κ")),
    Rule("father_name_ctx", "FATHER_NAME", "REDACT", 0.85, P.FATHER_NAME, r"\b", P.FATHER_END, "U", adjust=_without_article, needs=("του", "της")),
    _pattern("private_address", "PRIVATE_ADDRESS", "REDACT", 0.85, detector="private_address_ctx", suffix=P.ADDRESS_END, flags="U", adjust=_without_region(gazetteers.REGIONS), needs=("κάτοικ", "κατοίκ", "οδ", "λεωφ", "πλατεία")),
    _pattern("address_number", "PRIVATE_ADDRESS", "REDACT", 0.8, suffix=P.STREET_NUMBER_END, needs=("αρ",)),
    _pattern("postal_code", "PRIVATE_ADDRESS", "REDACT", 0.9, suffix=r"\b", needs=("τ",)),
    _pattern("business_seat", "BUSINESS_SEAT", "REDACT", 0.85, detector="business_seat_ctx", suffix=P.SEAT_END, needs=("έδρα",)),
    Rule("company_ctx", "PRIVATE_COMPANY_NAME", "REDACT", 0.85, P.COMPANY_NAME, P.COMPANY_CUE, flags="U", when=_no_service(gazetteers.PUBLIC_SERVICES), needs=("επωνυμία", "εταιρ", "εκδότρια")),
    _pattern("bank_account", "BANK_ACCOUNT", "REDACT", 0.85, detector="bank_account_ctx", flags="U", needs=("λογ", "τράπεζα")),
    _pattern("beneficiary", "PRIVATE_BENEFICIARY", "REDACT", 0.9, detector="beneficiary_ctx", flags="U", needs=("δικαιούχ",)),
    _pattern("fiscal_id", "FISCAL_DEVICE_ID", "REDACT", 0.85, detector="fiscal_device_ctx", needs=("μητρώου", "ταμειακ", "φημ")),
    _pattern("partial_star", "FISCAL_DEVICE_ID", "REDACT", 0.9, flags="U", needs=("*",)),
    _pattern("invoice_paragraph", "INVOICE_TABLE_ID", "REDACT", 0.85, detector="invoice_inline", suffix=rf"(?:{P.SERIES}[Α-ΩA-Z])?", flags="U", needs=_INVOICE, unit="paragraph"),
    Rule("invoice_inline", "INVOICE_TABLE_ID", "REDACT", 0.85, "[Α-ΩA-Z]", "".join(P.PATTERNS["invoice_paragraph"]) + P.SERIES, flags="U", name="invoice_series", needs=("σειρά",), unit="paragraph"),
    _pattern("invoice_cell", "INVOICE_TABLE_ID", "REDACT", 0.85, detector="invoice_cell_shape", flags="U", needs=_INVOICE, unit="table_cell"),
    Rule("field_label", "FIELD_LABEL", "PRESERVE", 1.0, P.FIELD_LABEL, flags="U"),
    *(_pattern(x, "PROPERTY_ID", "REDACT", 1.0, each=P.VALUES[x], shorten=f, needs=n) for x, f, n in (("atak", None, ("τ",)), ("kaek", _zero_suffix, ("κ",)), ("ot", None, ("ο.",)), ("axk", None, ("χ",)), ("notice_number", scalars.serial_without_date_and_year, ("ειδοποίησης",)))),
    _pattern("case_court_serial", "CASE_COURT_REFERENCE", "PRESERVE", 0.85, suffix=P.CASE_END, needs=("απόφασ",)),
    _pattern("court_chamber", "CASE_COURT_REFERENCE", "PRESERVE", 0.85, needs=("τμήμα",)),
    _pattern("locality_authority", "LOCALITY", "REDACT", 1.0, flags="U", needs=("δήμ", "πρωτοδικείου", "εφετείου", "δικαστηρίου", "κοινότητ")),
    _pattern("locality_context", "LOCALITY", "REDACT", 0.85, detector="locality_ctx", flags="U", needs=("συνοικία", "περιοχή")),
    _pattern("greek_name_shape", "POSSIBLE_PERSON", "REVIEW", 0.45, flags="U"),
    _pattern("company_suffix", "POSSIBLE_COMPANY", "REVIEW", 0.65, flags="U", needs=("αε", "α.ε.", "επε", "ε.π.ε.", "οε", "ο.ε.", "ικε", "ι.κ.ε.")),
    _pattern("street_shape", "POSSIBLE_PRIVATE_LOCATION", "REVIEW", 0.6, flags="U", needs=("οδός", "λεωφ")),
    Rule("medical_term_list", "MEDICAL_TERM", "REVIEW", 0.5, "|".join(P.MEDICAL), needs=P.MEDICAL),
    *(
        Rule(name, category, "PRESERVE", 0.9, "", entries=entries)
        for name, category, entries in (("public_service_gazetteer", "PUBLIC_SERVICE", gazetteers.PUBLIC_SERVICES), ("legal_ref_gazetteer", "LEGAL_REF", gazetteers.LEGAL_REFS))
    ),
)
#: Rules that may match text without a Greek letter.
_LATIN = {"afm_checksum", "amka_date", "iban_checksum", "email", "phone_intl", "phone_00", "phone_local", "transaction_id", "date_numeric", "money", "percentage", "partial_star", "field_label"}
_DIGITLESS = {"email", "partial_star", "field_label", "transaction_id"}


def rules(*names: str) -> tuple[Rule, ...]:
    """The rules of these names, a name being that of the rule or of the detector that it reports."""
    return tuple(r for r in RULES if r.key in names or r.detector in names)


def override(given: tuple[Rule, ...], name: str, value: str, prefix: str | None = None) -> tuple[Rule, ...]:
    """Rules with another pattern for one of them; a pattern that is no regular expression or matches nothing at all is refused."""
    import re

    if re.compile(value).fullmatch("") is not None:
        raise ValueError(f"{name}: the pattern matches the empty string")
    if name not in {r.key for r in given}:
        raise ValueError(f"no rule is named {name}")
    return tuple(replace(r, value=value, prefix=r.prefix if prefix is None else prefix, needs=()) if r.key == name else r for r in given)


def with_lists(given: tuple[Rule, ...], dou: tuple[str, ...] = gazetteers.DOU, public_services: tuple[str, ...] = gazetteers.PUBLIC_SERVICES, legal_refs: tuple[str, ...] = gazetteers.LEGAL_REFS, regions: tuple[str, ...] = gazetteers.REGIONS) -> tuple[Rule, ...]:
    """Rules that look for the names of other lists."""
    new = {
        "dou_gazetteer": _office(dou),
        "public_service_gazetteer": {"entries": public_services},
        "legal_ref_gazetteer": {"entries": legal_refs},
        "private_address": {"adjust": _without_region(regions)},
        "company_ctx": {"when": _no_service(public_services)},
    }
    return tuple(replace(r, **new[r.key]) if r.key in new else r for r in given)


def _gazetteer(text: Column, entries: tuple[str, ...]) -> Column:
    """Places of every entry, also inside and across each other."""
    known = F.array(*[F.struct(F.lit(x).alias("e"), F.lit(x.lower().replace("ς", "σ")).alias("low")) for x in entries])
    here = F.filter(known, lambda x: F.contains(F.col("__folded"), x["low"]))
    return F.flatten(F.transform(here, lambda x: find_spans(text, F.concat(F.lit(r"\Q"), x["e"], F.lit(r"\E")), flags="iU")))


def _spans(text: Column, low: Column, r: Rule) -> Column:
    found = _gazetteer(text, r.entries) if r.entries else find_spans(text, r.value, r.prefix, r.suffix, r.flags)
    if r.when:
        found = F.filter(found, lambda s: r.when(text, s))
    if r.adjust:
        found = F.transform(found, lambda s: r.adjust(text, s))
    if r.each:

        def split(s: Column) -> Column:
            shorten = r.shorten or (lambda v: v)
            values = F.transform(find_spans(s["text"], r.each, flags="U"), lambda x: cut(x, shorten(x["text"])))
            return F.transform(values, lambda x: F.struct((s["start"] + x["start"]).alias("start"), (s["start"] + x["end"]).alias("end"), x["text"], x["lead"]))

        found = F.flatten(F.transform(found, split))
    get = lambda v, s: v(text, s) if callable(v) else F.lit(v)
    made = F.transform(F.filter(found, lambda s: s["end"] > s["start"]), lambda s: F.struct(s["start"], s["end"], s["text"], get(r.category, s).alias("category"), get(r.detector, s).alias("detector"), get(r.confidence, s).cast("double").alias("confidence"), get(r.action, s).alias("action")))
    gate = [] if r.key in _LATIN else [F.col("__greek")]
    if r.key in _LATIN - _DIGITLESS:
        gate.append(F.col("__digit"))
    if r.needs:
        any_ = F.contains(low, F.lit(r.needs[0]))
        for x in r.needs[1:]:
            any_ = any_ | F.contains(low, F.lit(x))
        gate.append(any_)
    for g in gate:
        made = F.when(g, made)
    return made


_KIND = "array<struct<start:int,end:int,text:string,category:string,detector:string,confidence:double,action:string>>"


def detect(units: DataFrame, which: tuple[Rule, ...] = RULES, text: str = "text", unit_type: str = "unit_type", header: str = "header") -> DataFrame:
    """A row for each span proposed, with the columns of its unit but the text.

    Of table cells (unit_type "table_cell", with their column's header) a known header decides on the whole cell.
    """
    keys = [c for c in units.columns if c != text]
    typed, t, low = unit_type in units.columns, F.col(text), F.col(_LOW)
    gated = units.withColumns({_LOW: F.lower(t), "__folded": _fold(t), "__greek": F.coalesce(t.rlike("[Ͱ-Ͽἀ-῿]"), F.lit(False)), "__digit": F.coalesce(t.rlike(r"(?U)\d"), F.lit(False))})
    cell = F.col(unit_type) == "table_cell" if typed else F.lit(False)
    every = []
    if typed:
        mapped = F.element_at(F.create_map(*[y for h, c, a, p in P.HEADERS for y in (F.lit(_key(h)), F.struct(F.lit(c).alias("category"), F.lit(a).alias("action"), F.lit(p).alias("confidence")))]), scalars.header_key(F.coalesce(F.col(header), F.lit("")) if header in units.columns else F.lit("")))
        gated = gated.withColumn("__mapped", F.when(cell & (F.trim(t) != ""), mapped))
        m = F.col("__mapped")
        whole = F.array(F.struct(F.lit(0).alias("start"), F.length(t).alias("end"), t.alias("text"), m["category"].alias("category"), F.lit("table_cell_header").alias("detector"), m["confidence"].alias("confidence"), m["action"].alias("action")))
        every.append(F.when(m.isNotNull(), whole))
    for r in which:
        made = _spans(t, low, r)
        if r.unit == "table_cell":
            made = F.when(cell & F.col("__mapped").isNull(), made) if typed else None
        elif r.unit and typed:
            made = F.when(~cell, made)
        if made is not None:
            every.append(made)
    found = F.flatten(F.array(*[F.coalesce(x.cast(_KIND), F.array().cast(_KIND)) for x in every or [F.lit(None)]]))
    return gated.select(*keys, F.explode(found).alias("s")).select(*keys, "s.*").withColumns({"reason": F.lit(""), "origin": F.lit("deterministic")})


def split_review(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spans that are resolved, and hints that only a second pass decides on."""
    return spans.filter(F.col("action").isin("REDACT", "PRESERVE")), spans.filter(F.col("action") == "REVIEW")


def _key(header: str) -> str:
    return " ".join(header.split()).lower().replace("ς", "σ")


def headers(spark) -> DataFrame:
    """Column headers that decide a whole table cell, by their folded form."""
    df = spark.createDataFrame([*P.HEADERS], "header string, category string, action string, confidence double")
    return df.withColumn("key", scalars.header_key(F.col("header"))).drop("header")


def detect_cells(cells: DataFrame, header: str = "header", text: str = "text") -> DataFrame:
    """Whole-cell spans of table cells whose column header is known."""
    known = F.broadcast(headers(cells.sparkSession))  # a fixed table of 16 rows
    return cells.withColumn("key", scalars.header_key(F.col(header))).join(known, "key").drop("key").withColumns({"start": F.lit(0), "end": F.length(text)})


def signatories(units: DataFrame, document: str, order: str = "unit_ord", text: str = "text") -> DataFrame:
    """(document, order): paragraphs that name the official who signs.

    In the last fifth of a document's paragraphs, behind a signature title the first of the next five that is nothing but a name in capitals, was not
    taken before, and has no cue of a private party from one paragraph before the title to five behind it.  Only flags of those paragraphs are gathered.
    """
    by = Window.partitionBy(document)
    n = F.count("*").over(by)
    at = F.row_number().over(by.orderBy(order)) - 1
    last = units.select(document, order, F.coalesce(text, F.lit("")).alias("t"), at.alias("at"), n.alias("n")).filter(F.col("at") >= F.floor(F.col("n") * 0.8))
    flags = F.struct("at", F.col(order).alias("o"), F.col("t").rlike(P.SIGNATURE_TITLE).alias("title"), F.col("t").rlike(P.ALLCAPS_NAME).alias("name"), F.col("t").rlike(P.PRIVATE_PARTY_CUE).alias("cue"))
    per = last.groupBy(document).agg(F.array_sort(F.collect_list(flags)).alias("u")).filter(F.exists("u", lambda x: x["title"]))
    ok = "u[k].name AND NOT array_contains(acc, k) AND NOT exists(sequence(greatest(i - 1, 0), least(i + 5, size(u) - 1)), j -> j <> k AND u[j].cue)"
    first = f"slice(filter(if(i + 1 < size(u), sequence(i + 1, least(i + 5, size(u) - 1)), CAST(array() AS array<int>)), k -> {ok}), 1, 1)"
    chosen = f"aggregate(filter(sequence(0, size(u) - 1), i -> u[i].title), CAST(array() AS array<int>), (acc, i) -> concat(acc, {first}))"
    return per.select(document, F.explode(F.expr(f"transform({chosen}, k -> u[k].o)")).alias(order))
