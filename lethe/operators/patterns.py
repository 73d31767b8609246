"""The patterns, cues and headers that decide which spans are found.

Patterns are those of the rules, unchanged; flags are given where they are used.
"""

from __future__ import annotations

APOSTROPHES = "’'ʼ᾽΄"
RESIDENT = r"κάτοικ(?:ος|η|οι)|κατοίκ(?:ου|ων|ους|ης)"
CAPITALIZED = "[Α-ΩΆΈΉΊΌΎΏΪΫ][Α-Ωα-ωΆ-ώϊϋΐΰ]+"
NAMES = rf"{CAPITALIZED}(?:\s+{CAPITALIZED})*"
REFERENCE = r"[A-Za-z0-9Α-Ωα-ωΆ-ώ/\-]*\d[A-Za-z0-9Α-Ωα-ωΆ-ώ/\-]*"

#: (prefix, body) by name; the span is that of the body.
PATTERNS = {
    "afm": (r"(?:Α\.?Φ\.?Μ\.?|AFM)\s*[:.]?\s*", r"\d{9}"),
    "amka": (r"(?:ΑΜΚΑ|AMKA)\s*[:.]?\s*", r"\d{11}"),
    "iban": ("", r"[A-Z]{2}\d{2}(?:[\s-]?[A-Z0-9]){1,30}"),
    "email": ("", r"[\w.+-]+@[\w-]+\.[\w.-]+"),
    "phone_intl": ("", r"\+30[\s-]?(?:\d[\s-]?){10}"),
    "phone_local": ("", r"(?:2|6)\d{9}"),
    "phone_00": ("", r"0030\d{10}"),
    "protocol_number": (r"(?:αριθμ[οό]\s+πρωτοκόλλου|αριθ\.?\s*πρωτ\.?|αρ\.?\s*πρωτ\.?|Πρωτ\.?)\s*[:.]?\s*", rf"{REFERENCE}(?:/\d{{2,4}})?"),
    "act_number": (r"Πράξη\s+", REFERENCE),
    "audit_order": (
        r"(?:εντολ[ήέ]ς?\s+(?:μερικού\s+)?ελέγχου|Γνωστοποίησ(?:η|εις)|Αίτημ(?:α|ατα)\s+Παροχής\s+Πληροφοριών|Πρόσκλησ(?:η|εις)|Πληροφοριακή\s+Έκθεση|ΑΒΜ|ΕΞ)\s+",
        r"[0-9]{2,}(?:\s*[/&]\s*[0-9]+)*(?:[/\-]\d{2,4}(?:[/\-.]\d{2,4})*)?",
    ),
    "invoice_number": (r"(?:Τιμολόγιο|Α/Α)\s+", r"\d+"),
    "transaction_id": (r"(?:Συναλλαγή|ID)\s*[:.]?\s*", r"[A-Za-z0-9]{6,}"),
    "date_numeric": ("", r"\b\d{1,2}[/\-.]\d{1,2}[/\-.]\d{4}\b"),
    "date_greek": ("", r"\b\d{1,2}η?\s+(?:Ιανουαρίου|Φεβρουαρίου|Μαρτίου|Απριλίου|Μαΐου|Ιουνίου|Ιουλίου|Αυγούστου|Σεπτεμβρίου|Οκτωβρίου|Νοεμβρίου|Δεκεμβρίου)\s+\d{4}\b"),
    "legal_ref_law": ("", r"[Νν]\.?\s*\d+/\d+|νόμος\s+\d+/\d+"),
    "legal_ref_pd": ("", r"Π\.Δ\.\s*\d+/\d+"),
    "legal_ref_short": ("", r"(?:Κ\.Φ\.Δ\.|Κ\.Ν\.)"),
    "article_ref": ("", r"(?:άρθρο|άρ\.)\s+\d+(?:\s*(?:παρ\.|παράγραφος)\s*\d+)?|(?:παρ\.|παράγραφος)\s+\d+|(?:εδάφιο|περ\.)\s+[α-ωΑ-Ω]"),
    "court_decision": ("", r"[ΑΑ]\.\d+/\d{4}"),
    "money": ("", r"(?:€\s*)?\d{1,3}(?:\.\d{3})*,\d{2}(?:\s*(?:€|ευρώ))?"),
    "tax_year": ("", r"(?:οικονομικό|φορολογικό)\s+έτος\s+\d{4}|χρήση\s+\d{4}"),
    "legal_ref_fek": ("", rf"ΦΕΚ\s+[Α-ΩA-Z{APOSTROPHES}]+\s*\d+(?:[/,.]\s*\d+(?:[./]\d+)*)?"),
    "legal_ref_pol": ("", r"ΠΟΛ\.?\s*\d{4}(?:[-/]\d{2,4}[-/]\d{2,4})?"),
    "legal_ref_ste": ("", r"ΣτΕ\s*\d+/\d{2,4}"),
    "legal_ref_nsk": ("", r"ΝΣΚ\s*\d+/\d{2,4}"),
    "legal_ref_aade": ("", r"Α\.Α\.Δ\.Ε\.|\bΑ[ΑA]ΔΕ\b|Δ\.Ε\.Δ\.|\bΔΕΔ\b|Κ\.Ε\.ΜΕ\.Φ\.|Κ\.Ε\.ΦΟ\.ΜΕ\.Π\.|Υ\.Ε\.Δ\.Δ\.Ε\."),
    "percentage": ("", r"\b\d+(?:[.,]\d+)?\s*%"),
    "fiscal_period": ("", r"\b\d{2}[-/.]\d{2}[-/.]\d{4}\s+έως\s+\d{2}[-/.]\d{2}[-/.]\d{4}|\bφορολογική\s+περίοδος\s+\d{4}"),
    "atak": (r"(?:Α\.?Τ\.?Α\.?Κ\.?)\s*[:.]?\s*", r"(?<!\d)\d{11}(?:\s*(?:,|και)\s*\d{11})*(?!\d)"),
    "kaek": (r"(?:Κ\.?Α\.?Ε\.?Κ\.?)\s*[:.]?\s*", r"(?<!\d)\d{12}(?:/\d+)*(?:\s*(?:,|και)\s*\d{12}(?:/\d+)*)*"),
    "ot": (r"Ο\.\s*Τ\.?\s*[:.]?\s*", r"(?<!\d)\d+[Α-ΩA-Z]?(?:\s*(?:,|και)\s*\d+[Α-ΩA-Z]?)*"),
    "axk": (r"Α\.?\s*Χ\.?\s*Κ\.?\s*[:.]?\s*", r"(?<!\d)(?:\d+(?:/\d+)+|\d{3,})(?:\s*(?:,|και)\s*(?:\d+(?:/\d+)+|\d{3,}))*"),
    "notice_number": (r"αριθμ[οό]\s+ειδοποίησης\s*[:.]?\s*", r"(?<!\d)\d[\d/\-]*"),
    "challenged_act": (rf"(?:υπ[{APOSTROPHES}]\s*αρ(?:ιθ)?\.?|με\s+αριθ\.?)\s+", r"[0-9Α-ΩA-Z][0-9Α-ΩA-Z./\-]+"),
    "decision_number": ("", r"Αριθμ[οό]ς\s+[Αα]πόφασης\s*:\s*\d+"),
    "decision_place_date": ("", r"(?:Αθήνα|Καλλιθέα|Θεσσαλονίκη|Πάτρα|Ηράκλειο|Λάρισα|Βόλος|Ιωάννινα)[,\s]+\d{2}[-/.]\d{2}[-/.]\d{4}"),
    "appellant_name": (r"(?i:(?:ενδικοφανή\s+προσφυγή|προσφυγή)\s+τ(?:ης|ου)|\bκ(?:\.|ον|ου|ο|α)(?![α-ωά-ώ])\.?)\s+", NAMES),
    "private_address": (r"(?i:(?:" + RESIDENT + r")\s+|οδ(?:ός|ού)\s+|Λεωφ(?:όρος|όρου)?\.?\s+|πλατεία[ς]?\s+)", NAMES),
    "address_number": (r"\bαρ\.?\s*", r"\d+[Α-ΩA-Z]?"),
    "postal_code": (r"\bΤ\.?\s*Κ\.?\s*[:.]?\s*", r"\d{5}"),
    "locality_authority": (r"(?:Δήμ(?:ου|ο|ος)|Πρωτοδικείου|Εφετείου|Δικαστηρίου|Κοινότητ(?:α|ας))\s+(?:[Α-ΩA-Z][΄’']\s+)?", NAMES),
    "locality_context": (r"(?:συνοικία[ς]?|περιοχή[ς]?)\s+(?:[Α-ΩA-Z][΄’']\s+)?", NAMES),
    "case_court_serial": (r"(?:υπ[’'ʼ᾽΄]\s*αριθ\.?|με\s+αριθμ[οό])\s+", r"\d+"),
    "court_chamber": (r"\bΤμήμα\s+", r"\d+[οαη]\w*"),
    "business_seat": (r"με\s+έδρα\s+(?:τ(?:ην|ον)\s+)?", r"[Α-ΩΆΈΉΊΌΎΏΪΫ][Α-Ωα-ωΆ-ώ,.\s\d]+?"),
    "bank_account": (r"(?i:λογ\.\s*|λογαριασμ[οό]ν?\s*|Τράπεζα[ς]?\s+)", r"[A-ZΑ-Ω]{2}[0-9A-ZΑ-Ω\s]{4,29}[0-9A-ZΑ-Ω]|[0-9]{6,26}"),
    "beneficiary": (r"(?i:δικαιούχ[οη]\s+τ(?:ον|ην))\s+", NAMES),
    "fiscal_id": (r"(?:αριθμ[οό]\s+μητρώου|ταμειακ[ήη]\s+(?:μηχαν[ήη]\s+)?|ΦΗΜ\s+)", r"[A-ZΑ-Ω0-9*]{2,}[\s\-]*[A-ZΑ-Ω0-9*]{2,}"),
    "partial_star": ("", r"\b[A-ZΑ-Ω]{2,}\s*\*+[0-9A-ZΑ-Ω]+\b"),
    "invoice_cell": ("", r"\b(?:ΤΙΜ\.?|ΤΠΥ|ΔΑ|ΑΠΥ|ΤΔΑ|ΔΕΛΤΙΟ)\s*[0-9Α-ΩA-Z./-]+(?:\s*σειρά\s*[Α-ΩA-Z])?"),
    "invoice_paragraph": (r"\b(?:ΤΙΜ\.?|ΤΠΥ|ΔΑ|ΑΠΥ|ΤΔΑ|ΔΕΛΤΙΟ)\s*", r"[0-9Α-ΩA-Z./-]+"),
    "greek_name_shape": ("", rf"\b{CAPITALIZED}\s+{CAPITALIZED}\b"),
    "company_suffix": ("", rf"\b(?:{NAMES})\s+(?:ΑΕ|Α\.Ε\.|ΕΠΕ|Ε\.Π\.Ε\.|ΟΕ|Ο\.Ε\.|ΙΚΕ|Ι\.Κ\.Ε\.)(?!\w)"),
    "street_shape": ("", rf"\b(?:οδός|Οδός|Λεωφ\.|Λεωφόρος)\s+{NAMES}(?:\s+αρ\.?\s*\d+|\s+\d+)?"),
}
SERIES = r"\s*σειρά\s*"
ADDRESS_END = r"(?=\s*(?:[.,;)]|$|\n|και\b|οδ(?:ός|ού)\b|Λεωφ|αρ\.|Τ\.?Κ\.?\b))"
SEAT_END = r"(?=\s{2,}|\.|,\s*(?:οδός|αρ\.|\d)|\n|$)"
STREET_NUMBER_END = r"\b(?!\s*[/\-]\s*\d)"
CASE_END = r"\s*/\s*\d{4}\s+απόφασ"
FATHER_NAME = rf"(?i:τ(?:ου|ης))\s+{NAMES}"
FATHER_END = rf"\s+(?i:με\s+Α\.?Φ\.?Μ\.?|{RESIDENT}|οδ(?:ός|ού)|ατομική)"
APPEAL_BEFORE = r"(?iUd)προσφυγ\w*\s*$"
COMPANY_CUE = r"(?i:με\s+επωνυμία\s+|εταιρε?ία\s+|εκδότρια\s+(?:νομική\s+οντότητα\s+)?)"
COMPANY_WORD = r"[Α-ΩΆΈΉΊΌΎΏΪΫA-Z][Α-Ωα-ωΆ-ώa-zA-Z.&\-]*"
COMPANY_NAME = rf"{COMPANY_WORD}(?:\s+(?:&\s+)?{COMPANY_WORD})*(?:\s+(?:Α\.?Ε\.?|Ε\.?Π\.?Ε\.?|Ι\.?Κ\.?Ε\.?|Ο\.?Ε\.?|Ε\.?Ε\.?))?"
DOU_LABEL = r"(?i:(?:Δ\.Ο\.Υ\.|ΔΟΥ)\s+)"
PROCEDURAL_CUE = r"(?iUd)(?:ημερομηνία\s+κατάθεσης|ημερομηνία\s+έκδοσης|εκδόθηκε\s+στις|κοινοποιήθηκε\s+στις)\s*[:.]?\s*$"
TAX_ACT_CUE = r"(?iUd)Οριστικ|Πράξ[ηή]|Διορθωτικ|Φ\.Π\.Α|Τελών|φόρου|προστίμου|Επιβολής"
#: The values of a captured list.
VALUES = {"atak": r"\d{11}", "kaek": r"\d{12}(?:/\d+)*", "ot": r"\d+[Α-ΩA-Zα-ωά-ώa-z]?", "axk": r"\d+(?:/\d+)+|\d{3,}", "notice_number": r"\d[\d/\-]*"}

PUBLIC_DOMAINS = ("aade.gr", "gov.gr")
MEDICAL = ("διάγνωση", "ασθένεια", "νόσος", "θεραπεία", "φαρμακευτική", "χειρουργείο", "καρκίνος", "διαβήτης")
HEADERS = (
    ("ΑΦΜ", "AFM", "REDACT", 0.9),
    ("Τηλέφωνο", "PHONE", "REVIEW", 0.85),
    ("Email", "EMAIL", "REDACT", 0.95),
    ("Όνομα", "POSSIBLE_PERSON", "REVIEW", 0.6),
    ("Διεύθυνση", "POSSIBLE_PRIVATE_LOCATION", "REVIEW", 0.6),
    ("ΠΑΡΑΣΤΑΤΙΚΟ", "INVOICE_TABLE_ID", "REDACT", 0.9),
    ("ΠΑΡΑ ΣΤΑΤΙΚΟ", "INVOICE_TABLE_ID", "REDACT", 0.9),
    ("ΑΡ. ΠΑΡΑΣΤΑΤΙΚΟΥ", "INVOICE_TABLE_ID", "REDACT", 0.9),
    ("ΤΙΜΟΛΟΓΙΟ", "INVOICE_TABLE_ID", "REDACT", 0.9),
    ("ΤΙΜ.", "INVOICE_TABLE_ID", "REDACT", 0.9),
    ("ΑΡΙΘΜΟΣ", "INVOICE_TABLE_ID", "REDACT", 0.85),
    ("ΣΤΟΙΧΕΙΟ", "INVOICE_TABLE_ID", "REDACT", 0.85),
    ("ΚΑΘΑΡΗ ΑΞΙΑ", "MONEY", "PRESERVE", 0.95),
    ("ΦΠΑ", "MONEY", "PRESERVE", 0.95),
    ("ΣΥΝΟΛΟ", "MONEY", "PRESERVE", 0.95),
    ("ΗΜ/ΝΙΑ", "DATE", "PRESERVE", 0.95),
)

#: Field labels: label and what must follow it.
_ID = r"[:.]?\s*(?:[Α-ΩA-Z]{0,4}\d|\.{2,}|…)"
_IBAN = r"[:.]?\s*(?:[A-ZΑ-Ω]{2}\s*\d{2}|\.{2,}|…)"
_NAME = r"[:.]?\s*(?:[Α-ΩΆΈΉΊΌΎΏΪΫ]|\.{2,}|…)"
_ANY = r"[:.]?\s*\S"
LABELS = (
    (r"Α\.?\s*Φ\.?\s*Μ\.?|AFM", _ID),
    (r"ΑΜΚΑ|AMKA", _ID),
    (r"ΙΒΑΝ|IBAN", _IBAN),
    (r"Α\.?\s*Τ\.?\s*Α\.?\s*Κ\.?", _ID),
    (r"Κ\.?\s*Α\.?\s*Ε\.?\s*Κ\.?", _ID),
    (r"Ο\.\s*Τ\.?", _ID),
    (r"Α\.?\s*Χ\.?\s*Κ\.?", _ID),
    (r"Τ\.?\s*Κ\.?", _ID),
    (r"αριθμ[οό]\s+πρωτοκόλλου|αριθμ?\.?\s*πρωτ\.?|αρ\.?\s*πρωτ\.?", _ID),
    (r"αριθμ[οό]\s+ειδοποίησης", _ID),
    (r"αρ\.?\s*καταχώρισης", _ID),
    (r"αρ\.", r"\s*(?:\d|\.{2,}|…)"),
    (RESIDENT, _NAME),
    (r"οδ(?:ός|ού)", _NAME),
    (r"Λεωφ(?:όρος|όρου)?\.?", _NAME),
    (r"Ταχ\.\s*Δ/νση|Ταχ\.\s*Κώδικας", _ANY),
    (r"Τηλέφωνο|Τηλ\.", _ANY),
    (r"Fax|Φαξ", _ANY),
    (r"E-?mail", _ANY),
)
FIELD_LABEL = r"(?<![Α-Ωα-ωΆ-ώA-Za-z0-9.])(?:" + "|".join(f"(?:{label})(?![Α-Ωα-ωΆ-ώA-Za-z0-9])(?={follower})" for label, follower in LABELS) + ")"

#: Narrowing of spans.
TRIM_CUE = (
    r"^(?:(?:"
    + "|".join(
        [label for label, _ in LABELS]
        + [
            r"Πράξη", r"Τμήμα", r"Ημερομηνία", r"Ημ/νία", r"Τράπεζα[ς]?", r"λογ\.", r"λογαριασμ[οό]ν?", r"κ(?:\.|ον|ου|ο|α)(?![α-ωά-ώ])",
            r"Τιμολόγιο", r"ΤΙΜ\.", r"Α/Α", r"Συναλλαγή", rf"υπ[{APOSTROPHES}]\s*αριθ\w*\.?", r"με\s+αριθμ[οό]", r"αριθμ[οό]ς?",
        ]
    )
    + r"))(?![Α-Ωα-ωΆ-ώA-Za-z0-9])\s*[:.\-]?\s*"
)
LEADING_PREPOSITION = rf"^(?:με|και|στο|στη|στην|στον|στα|σε|απ[όο]|για|προς|υπ[{APOSTROPHES}])(?![α-ωά-ώ])\s*"
TRAILING_YEAR = r"\s*/\s*(?:19|20)\d{2}$"
TRAILING_DATE = r"\s*[/\-]\s*\d{1,2}[/\-.]\d{1,2}[/\-.]\d{4}$"
NOTICE_CUE_BEFORE = r"(?iUd)αριθμ[οό]\s+ειδοποίησης\s*[:.]?\s*$"
EDGE_CHARS = " \t\n\r.,;:·()[]{}«»\"'’‚“”/-–—"
YEAR_SUFFIX = ("PROTOCOL_NUMBER", "AUDIT_ORDER", "CHALLENGED_ACT_NUMBER", "CASE_REF_NUMBER", "CASE_COURT_REFERENCE")
NAME_CATEGORIES = ("POSSIBLE_PERSON", "POSSIBLE_COMPANY", "APPELLANT_NAME", "FATHER_NAME", "PRIVATE_BENEFICIARY", "PRIVATE_COMPANY_NAME", "OFFICIAL_SIGNATORY")

#: Document-level detectors.
HEADER_CUES = r"(?iUd)ΕΛΛΗΝΙΚΗ\s+ΔΗΜΟΚΡΑΤΙΑ|ΔΙΕΥΘΥΝΣΗ\s+ΕΠΙΛΥΣΗΣ\s+ΔΙΑΦΟΡΩΝ|ΥΠΟΔΙΕΥΘΥΝΣΗ\s+ΕΠΑΝΕΞΕΤΑΣΗΣ|Α\.Α\.Δ\.Ε\.|Α[ΑA]ΔΕ|Ταχ\.\s*Δ/νση|Ταχ\.\s*Κώδικας|Τηλέφωνο|Fax|E-mail"
DECISION_TITLE = r"(?Ud)^\s*ΑΠΟΦΑΣΗ\b"
SIGNATURE_TITLE = r"(?iUd)Ακριβ[εέ]ς\s+[Αα]ντίγραφο|ΜΕ\s+ΕΝΤΟΛΗ|Με\s+εντολή|Ο\s+ΠΡΟΪΣΤΑΜΕΝΟΣ|Η\s+ΠΡΟΪΣΤΑΜΕΝΗ|Ο\s+ΔΙΕΥΘΥΝΤΗΣ|Η\s+ΔΙΕΥΘΥΝΤΡΙΑ|Υποδιεύθυνσης\s+Επανεξέτασης|Διοικητικής\s+Υποστήριξης"
ALLCAPS_NAME = r"(?Ud)^\s*[Α-ΩΆΈΉΊΌΎΏΪΫ]+(?:\s+[Α-ΩΆΈΉΊΌΎΏΪΫ]+){1,3}\s*$"
PRIVATE_PARTY_CUE = r"(?iUd)προσφεύγ|υπόχρε|ΑΦΜ|κάτοικ|έδρα|δικαιούχ|πατέρ|αδελφ|σύζυγ|λογαριασμ"
