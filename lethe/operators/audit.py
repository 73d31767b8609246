"""Audit of masked text by rules of its own, independent of the detectors.

Findings are (unit columns but the text, kind, severity, start, end, text, category).  A finding with a category names a slice of text that a
second pass can be asked about; one without says where something is, and if it is of severity HIGH it blocks the document.

Defined cases: null and empty texts have no findings; matches never span two units; without an order a unit is judged by its own text
only; repeated units are audited alike; no units give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lethe.functions import scalars
from lethe.functions.spans import find_spans

# Kinds, severities and patterns.  The second group of digits of an AMKA is read as month, then day.
AFM = r"\b\d{9}\b"
AMKA = r"\b\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{5}\b"
IBAN = r"\bGR\d{2}\d{7}\d{16}\b"
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
PHONE = r"(?<!\d)(?:\+?30|0030)?[\s\-]?(?:69|2\d)[\d\s\-]{8,14}(?!\d)"
DIGIT_RUN = r"\b\d{9,11}\b"
PLACEHOLDER = r"\[(?:NAME|AFM|ADDRESS|COMPANY|ACT_NUMBER|REDACTED)\]|<REDACTED>|(?:PERSON|COMPANY)_\d+|\*{3,}\d+|\*{5,}"
NAME_RUN = r"(?-i:[Α-ΩΆΈΉΊΌΎΏΪΫ][Α-Ωα-ωΆ-ώ]+(?:[ \t]+[Α-ΩΆΈΉΊΌΎΏΪΫ][Α-Ωα-ωΆ-ώ]+)*)"
CASE_REF = (r"(?:υπ['’]\s*αρ(?:ιθ)?\.?|αρ\.?\s*πρωτ\.?|αριθμ[οό]\s+πρωτοκόλλου|εντολ[ήέ]ς?\s+(?:μερικού\s+)?ελέγχου|Γνωστοποίησ[ηεις]+|Αίτημ[αα]\s+Παροχής\s+Πληροφοριών|ΑΒΜ|ΕΞ)\s+", r"\d[0-9A-ZΑ-Ω./\-]{2,}")
BENEFICIARY = r"δικαιούχ[οη]\s+τ(?:ον|ην)\s+"
STAR = r"\b[A-ZΑ-Ω]{2,}\s*\*+[0-9A-ZΑ-Ω]+\b"
PERSON = r"(?:ενδικοφανή\s+προσφυγή\s+τ(?:ης|ου)\s+|με\s+ΑΦΜ\s+\.+\s+)"
OVER = r"Αριθμ[οό]ς\s+[Αα]πόφασης\s*:\s*\.{3,}|ν\.\s*\.{3,}|ΦΕΚ\s+\.{3,}|ΠΟΛ\s*\.{3,}|ΣτΕ\s*\.{3,}|ΝΣΚ\s*\.{3,}|\.{2,}%"
PROPERTY = (
    ("ΑΤΑΚ", r"Α\.?\s*Τ\.?\s*Α\.?\s*Κ\.?", r"\d{11}"),
    ("ΚΑΕΚ", r"Κ\.?\s*Α\.?\s*Ε\.?\s*Κ\.?", r"\d{12}(?:/\d+)*"),
    ("Ο.Τ.", r"Ο\.\s*Τ\.?", r"\d+[Α-ΩA-Zα-ωά-ώa-z]?"),
    ("Α.Χ.Κ.", r"Α\.?\s*Χ\.?\s*Κ\.?", r"\d+(?:/\d+)+|\d{3,}"),
    ("αριθμό ειδοποίησης", r"αριθμ[οό]\s+ειδοποίησης", r"\d[\d/\-]*"),
)
PROPERTY_BUDGET = 160
SEPARATOR = r"[ \t]*(?:,|και)[ \t]*"
DOMAINS = ("aade.gr", "gov.gr")
LABELS = ("Α.Φ.Μ.", "ΑΦΜ", "ΑΜΚΑ", "ΙΒΑΝ", "ΑΤΑΚ", "Α.Τ.Α.Κ.", "ΚΑΕΚ", "Ο.Τ.", "Α.Χ.Κ.", "Τ.Κ.", "κάτοικος", "κατοίκου", "οδός", "οδού", "Λεωφ.", "αρ.", "αριθμό πρωτοκόλλου", "αρ. πρωτ.", "αριθμό ειδοποίησης", "Πράξη", "Τιμολόγιο", "Τράπεζα", "Τηλέφωνο", "Ταχ. Δ/νση", "E-mail", "Fax")
CONTACT_LABEL = r"(?iUd)Τηλέφωνο|Τηλ\.?|τηλ\.?|Fax|Φαξ|Ταχ\."
HEADER_CONTEXT = r"(?iUd)ΕΛΛΗΝΙΚΗ\s+ΔΗΜΟΚΡΑΤΙΑ|Α\.?\s*Α\.?\s*Δ\.?\s*Ε\.?|ΑΑΔΕ|Δ\.?\s*Ε\.?\s*Δ\.?|ΔΕΔ|ΔΙΕΥΘΥΝΣΗ\s+ΕΠΙΛΥΣΗΣ\s+ΔΙΑΦΟΡΩΝ|ΥΠΟΔΙΕΥΘΥΝΣΗ\s+ΕΠΑΝΕΞΕΤΑΣΗΣ"
HEADER_REACH = 800
BODY_START = r"(?iUd)\bΑΠΟΦΑΣΗ\b"
INVOICE_HEADERS = ("ΠΑΡΑΣΤΑΤΙΚΟ", "ΠΑΡΑ ΣΤΑΤΙΚΟ", "ΑΡ. ΠΑΡΑΣΤΑΤΙΚΟΥ", "ΤΙΜΟΛΟΓΙΟ", "ΤΙΜ.", "ΑΡΙΘΜΟΣ", "ΣΤΟΙΧΕΙΟ")
#: The category that a second pass is asked about, by kind.
REMEDIABLE = {"residual_afm": "AFM", "afm_shape": "AFM", "residual_amka": "AMKA", "residual_iban": "IBAN", "residual_email": "EMAIL", "phone_shape": "PHONE", "digit_run": "TRANSACTION_ID", "case_ref_leak": "CASE_REF_NUMBER", "beneficiary_leak": "PRIVATE_BENEFICIARY", "partial_star_residue": "FISCAL_DEVICE_ID", "person_name_leak": "POSSIBLE_PERSON", "residual_property_id": "PROPERTY_ID"}

_SPAN = "struct<start:int,end:int,text:string,lead:string>"
_KIND = "array<struct<kind:string,severity:string,start:int,end:int,text:string>>"


def checksum_ok(value: Column) -> Column:
    """The last of nine digits checks the first eight."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(8)), F.lit(0), lambda s, i: s + F.substring(value, i, F.lit(1)).cast("int") * F.pow(F.lit(2), 9 - i).cast("int")) % 11 % 10 == F.substring(value, 9, 1).cast("int")


def _as(found: Column, kind, severity) -> Column:
    get = lambda v, s: v(s) if callable(v) else F.lit(v)
    return F.transform(found, lambda s: F.struct(get(kind, s).alias("kind"), get(severity, s).alias("severity"), s["start"], s["end"], s["text"])).cast(_KIND)


def _official(text: Column, s: Column) -> Column:
    """Whether a phone stands on a line of an authority's contact data, or in the header before the decision."""
    ahead = F.substring(text, F.lit(1), s["start"])
    line = F.concat(F.substring_index(ahead, "\n", -1), F.substring_index(F.substring(text, s["start"] + 1, F.length(text)), "\n", 1))
    titled = F.coalesce(F.col("__titled"), F.lit(False)) | ahead.rlike(BODY_START)
    own = F.substring(ahead, F.greatest(F.length(ahead) - HEADER_REACH, F.lit(0)) + 1, F.lit(HEADER_REACH))
    header = line.rlike(HEADER_CONTEXT) | own.rlike(HEADER_CONTEXT) | F.coalesce(F.col("__at") + s["start"] - F.col("__cue") <= HEADER_REACH, F.lit(False))
    return line.rlike(CONTACT_LABEL) | (~titled & header)


def _trimmed(s: Column) -> Column:
    """A span without the white space around its value."""
    left = F.length(s["text"]) - F.length(F.regexp_replace(s["text"], r"(?U)^\s+", ""))
    inner = F.regexp_replace(s["text"], r"(?U)^\s+|\s+$", "")
    return F.struct((s["start"] + left).alias("start"), (s["start"] + left + F.length(inner)).alias("end"), inner.alias("text"), s["lead"])


def _properties(t: Column, cue: str, value: str) -> Column:
    """Values that survive in the list behind a cue, whichever of the list they are."""
    item = rf"(?:{value}|\.+|…+)"
    run = rf"(?Ud)^{item}(?:{SEPARATOR}{item})*"

    def walk(c: Column) -> Column:
        window = F.substring_index(F.substring(t, c["end"] + 1, F.lit(PROPERTY_BUDGET)), "\n", 1)
        found = find_spans(F.regexp_extract(window, run, 0), value)
        return F.transform(found, lambda v: F.struct((c["end"] + v["start"]).alias("start"), (c["end"] + v["end"]).alias("end"), v["text"], v["lead"]))

    return F.flatten(F.transform(find_spans(t, rf"{cue}\s*:?\s*", flags="iU"), walk))


def _placed(units: DataFrame, text: str, document: str | None, order: str | None) -> DataFrame:
    """units with their offset, the place of the last header cue before them, and whether the decision has begun."""
    if document is None or order is None:
        return units.withColumns({"__at": F.lit(None).cast("long"), "__cue": F.lit(None).cast("long"), "__titled": F.lit(False)})
    ahead = Window.partitionBy(document).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    t = F.coalesce(F.col(text), F.lit(""))
    placed = units.withColumn("__at", F.coalesce(F.sum(F.length(t) + 1).over(ahead), F.lit(0)))
    last = F.aggregate(find_spans(t, HEADER_CONTEXT.removeprefix("(?iUd)"), flags="iU"), F.lit(None).cast("int"), lambda a, s: s["start"])
    return placed.withColumns({"__cue": F.max(F.col("__at") + last).over(ahead), "__titled": F.max(t.rlike(BODY_START)).over(ahead)})


def scan(units: DataFrame, text: str = "text", document: str | None = None, order: str | None = None) -> DataFrame:
    """Findings in the text of each unit; document and order tell what stands before it."""
    t, keys = F.col(text), [c for c in units.columns if c != text]
    units = _placed(units, text, document, order)
    amka = find_spans(t, AMKA)
    phones = F.filter(find_spans(t, PHONE), lambda s: ~s["text"].rlike("[\n\t]") & scalars.greek_phone(s["text"]).isNotNull())
    units = units.withColumns({"__amka": F.when(t.rlike("[0-9]{11}"), amka).otherwise(F.array().cast(f"array<{_SPAN}>")), "__phone": F.when(t.rlike("[0-9]"), phones).otherwise(F.array().cast(f"array<{_SPAN}>"))})
    crosses = lambda s, of: F.exists(F.col(of), lambda a: (a["start"] < s["end"]) & (s["start"] < a["end"]))
    runs = F.filter(find_spans(t, DIGIT_RUN), lambda s: (F.length(s["text"]) > 9) & ~crosses(s, "__amka") & ~crosses(s, "__phone") & scalars.greek_phone(s["text"]).isNull())
    digits = [
        _as(find_spans(t, AFM), lambda s: F.when(checksum_ok(s["text"]), "residual_afm").otherwise("afm_shape"), lambda s: F.when(checksum_ok(s["text"]), "HIGH").otherwise("MEDIUM")),
        _as(F.col("__amka"), "residual_amka", "HIGH"),
        _as(F.filter(find_spans(t, IBAN, flags="iU"), lambda s: scalars.iban_valid(s["text"])), "residual_iban", "HIGH"),
        _as(F.transform(F.filter(F.col("__phone"), lambda s: ~_official(t, s)), _trimmed), "phone_shape", "MEDIUM"),
        _as(runs, "digit_run", "MEDIUM"),
        _as(F.filter(find_spans(t, CASE_REF[1], CASE_REF[0], flags="iU"), lambda s: ~F.contains(s["text"], F.lit("."))), "case_ref_leak", "MEDIUM"),
        *(_as(_properties(t, cue, value), "residual_property_id", "HIGH") for _, cue, value in PROPERTY),
    ]
    public = lambda s: F.lower(F.substring_index(s["text"], "@", -1)).isin(*DOMAINS)
    parts = [
        *(F.when(t.rlike("[0-9]"), x) for x in digits),
        F.when(F.contains(t, F.lit("@")), _as(F.filter(find_spans(t, EMAIL), lambda s: ~public(s)), "residual_email", "HIGH")),
        _as(find_spans(t, PLACEHOLDER, flags="iU"), "wrong_placeholder", "HIGH"),
        F.when(F.contains(t, F.lit("…")), _as(find_spans(t, "…+"), "ellipsis_residue", lambda s: F.when(F.length(s["text"]) >= 2, "HIGH").otherwise("MEDIUM"))),
        F.when(F.contains(F.lower(t), F.lit("δικαιούχ")), _as(find_spans(t, NAME_RUN, BENEFICIARY, flags="iU"), "beneficiary_leak", "MEDIUM")),
        F.when(F.contains(t, F.lit("*")), _as(find_spans(t, STAR), "partial_star_residue", "MEDIUM")),
        _as(find_spans(t, NAME_RUN, PERSON, flags="iU"), "person_name_leak", "MEDIUM"),
        F.when(F.contains(t, F.lit("..")), _as(find_spans(t, OVER, flags="iU"), "over_redaction", "MEDIUM")),
    ]
    found = F.flatten(F.array(*[F.coalesce(p, F.array().cast(_KIND)) for p in parts]))
    return remediable(units.select(*keys, F.explode(found).alias("f")).select(*keys, "f.*"))


def remediable(findings: DataFrame) -> DataFrame:
    """findings with the category that a second pass is asked about, null where there is none."""
    known = F.create_map(*[F.lit(x) for kv in REMEDIABLE.items() for x in kv])
    return findings.withColumn("category", F.element_at(known, F.col("kind")))


def blocking(findings: DataFrame) -> DataFrame:
    """The HIGH findings that nothing can be asked about."""
    return findings.filter((F.col("severity") == "HIGH") & F.col("category").isNull())


def table_leaks(cells: DataFrame, header: str = "header", text: str = "text") -> DataFrame:
    """Cells below an invoice header in which digits survive."""
    known = [" ".join(x.split()).lower().replace("ς", "σ") for x in INVOICE_HEADERS]
    hit = cells.filter(scalars.header_key(F.col(header)).isin(*known) & F.col(text).rlike(r"(?U)\d"))
    return hit.select(*[c for c in cells.columns if c != text], F.lit("table_invoice_leak").alias("kind"), F.lit("MEDIUM").alias("severity"))


def label_deficit(before: DataFrame, after: DataFrame, key: str, labels: tuple[str, ...] = LABELS, text: str = "text") -> DataFrame:
    """Labels of which a document has fewer after masking than before."""

    def counts(df: DataFrame, name: str) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(x).alias("label"), F.regexp_count(text, F.lit(rf"(?iU)\Q{x}\E")).alias(name)) for x in labels]))
        return df.select(key, each.alias("x")).select(key, "x.*").groupBy(key, "label").agg(F.sum(name).cast("long").alias(name))

    both = counts(before, "n_before").join(counts(after, "n_after"), [key, "label"], "left")
    return both.withColumn("n_after", F.coalesce("n_after", F.lit(0))).filter("n_after < n_before")


def by_kind(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity", "kind").agg(F.count("*").alias("n"))


def verdicts(documents: DataFrame, findings: DataFrame, key: str) -> DataFrame:
    """Of each document the number of findings, whether it is clean, and whether one blocks it."""
    stop = (F.col("severity") == "HIGH") & F.col("category").isNull()
    per = findings.groupBy(key).agg(F.count("*").alias("findings_total"), F.max(stop).alias("blocked"))
    out = documents.select(key).distinct().join(per, key, "left")
    return out.select(key, F.coalesce("findings_total", F.lit(0)).cast("long").alias("findings_total"), F.col("findings_total").isNull().alias("clean"), F.coalesce("blocked", F.lit(False)).alias("blocked"))
