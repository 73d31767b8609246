"""From documents to masked text, findings and a verdict: units, screening, detection, resolution, masking, audit.

Defined cases: a null text has no units and comes through unchanged; a document that a screening rule or a limit refuses gets a code and
no plan, no text and no findings; repeated ids are one document; no documents give empty tables; columns beyond id and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lethe.operators import audit, resolve, screen, units
from lethe.operators.detect import RULES, Rule, detect, split_review


@dataclass
class Anonymized:
    """documents: (document, code, findings_total, clean, blocked); units, plan, hints and findings hold the documents without a code."""

    documents: DataFrame
    units: DataFrame
    plan: DataFrame
    hints: DataFrame
    findings: DataFrame


def anonymize(docs: DataFrame, document: str = "doc_id", text: str = "text", which: tuple[Rule, ...] = RULES, most_chars: int = units.MAX_TEXT_CHARS) -> Anonymized:
    """Mask what the rules redact in docs and audit the result; every part is lazy."""
    own = docs.select(document, text)
    refused = screen.screen(own, text)
    size = F.sum(F.length(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\n", "")))
    limits = own.groupBy(document).agg(F.when(size > most_chars, F.lit("TEXT_TOO_LONG")).alias("code"))
    codes = limits.join(refused.groupBy(document).agg(F.max("refused_by").alias("rule")), document)
    codes = codes.select(document, F.when(F.col("rule").isNotNull(), "PROMPT_INJECTION").otherwise(F.col("code")).alias("code"))
    fine = codes.filter("code IS NULL").select(document)
    keys = [document, "unit_ord"]
    parts = units.text_units(own.join(fine, document, "left_semi"), document, text)
    spans, hints = split_review(detect(parts, which))
    plan = resolve.resolve(spans, keys)
    masked = resolve.mask(parts, plan, keys)
    findings = audit.scan(masked, "text", document, "unit_ord")
    verdict = audit.verdicts(fine, findings, document)
    return Anonymized(codes.join(verdict, document, "left"), masked, plan, hints, findings)
