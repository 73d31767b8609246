"""Rule files and settings: policy, patterns, lists and screening rules, checked before anything runs.

Files are JSON; a digest of their bytes tells which rules made a result.

Defined cases: a missing key takes the built-in value, an unknown one is refused; lists drop empty lines and comments; a number that is not finite, not
positive or beyond its ceiling is refused, and so are limits that contradict each other.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, field, fields

from lethe.functions.folding import fold
from lethe.operators import gazetteers, resolve
from lethe.operators import patterns as P
from lethe.operators.adjudicate import CATEGORIES
from lethe.operators.detect import RULES, Rule, override, with_lists
from lethe.operators.screen import RULES as SCREENING


class ConfigurationError(ValueError):
    """A rule file or a setting cannot be used."""


@dataclass(frozen=True)
class Policy:
    preserve_high: float = resolve.PRESERVE_HIGH
    redact_high: float = resolve.REDACT_HIGH
    redact: float = resolve.REDACT
    hard_preserve: tuple[str, ...] = resolve.HARD_PRESERVE
    hard_redact: tuple[str, ...] = resolve.HARD_REDACT
    preserve_email_domains: tuple[str, ...] = P.PUBLIC_DOMAINS


def policy(raw: Mapping | None) -> Policy:
    """A policy whose thresholds are shares in order and whose categories exist and are in one list only."""
    known = {f.name for f in fields(Policy)}
    if unknown := set(raw or {}) - known:
        raise ConfigurationError(f"unknown policy keys: {', '.join(sorted(unknown))}")
    made = Policy(**{k: tuple(v) if isinstance(v, list) else v for k, v in (raw or {}).items()})
    for name in ("preserve_high", "redact_high", "redact"):
        value = getattr(made, name)
        if isinstance(value, bool) or not isinstance(value, int | float) or not 0 <= value <= 1:
            raise ConfigurationError(f"{name} must be a number from 0 to 1")
    if made.redact > made.redact_high:
        raise ConfigurationError("redact must not exceed redact_high")
    listed = [*made.hard_preserve, *made.hard_redact]
    if wrong := sorted(set(listed) - set(CATEGORIES)):
        raise ConfigurationError(f"unknown categories: {', '.join(wrong)}")
    if both := sorted(set(made.hard_preserve) & set(made.hard_redact)):
        raise ConfigurationError(f"categories in both lists: {', '.join(both)}")
    return made


def entries(text: str) -> tuple[str, ...]:
    """The entries of a list file, one a line, each once."""
    lines = (x.strip() for x in text.splitlines())
    return tuple(dict.fromkeys(x for x in lines if x and not x.startswith("#")))


def detectors(raw: Mapping | None) -> tuple[Rule, ...]:
    """The rules with patterns of their own: {name: {prefix, body}}."""
    out = RULES
    for name, given in (raw or {}).items():
        try:
            re.compile(given.get("prefix", ""))
            out = override(out, name, given["body"], given.get("prefix"))
        except (re.error, KeyError, ValueError, AttributeError) as e:
            raise ConfigurationError(f"pattern {name}: {e}") from None
    return out


def screening(raw: list | None) -> tuple[tuple[str, str], ...]:
    """Screening rules as (id, pattern); patterns must be written for folded text and must not match nothing."""
    if raw is None:
        return SCREENING
    out: list[tuple[str, str]] = []
    for k, entry in enumerate(raw, 1):
        name, pattern = (str(entry.get(x, "")).strip() for x in ("id", "pattern")) if isinstance(entry, Mapping) else ("", "")
        if not re.fullmatch(r"[a-z0-9_]{1,64}", name) or name in {x for x, _ in out}:
            raise ConfigurationError(f"screening rule {k}: its id is missing, malformed or taken")
        if any("Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῿" for c in pattern if fold(c) != c):
            raise ConfigurationError(f"screening rule {name}: letters that folding changes")
        try:
            if not pattern or re.compile(pattern).search(""):
                raise ConfigurationError(f"screening rule {name}: it would refuse every document")
        except re.error as e:
            raise ConfigurationError(f"screening rule {name}: {e}") from None
        out.append((name, pattern))
    if not out:
        raise ConfigurationError("there must be a screening rule")
    return tuple(out)


@dataclass(frozen=True)
class RuleSet:
    policy: Policy = field(default_factory=Policy)
    detectors: tuple[Rule, ...] = RULES
    screening: tuple[tuple[str, str], ...] = SCREENING
    lists: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"dou": gazetteers.DOU, "public_services": gazetteers.PUBLIC_SERVICES, "legal_refs": gazetteers.LEGAL_REFS, "regions": gazetteers.REGIONS})
    digests: dict[str, str] = field(default_factory=dict)


def load(folder: str) -> RuleSet:
    """The rules of a folder: policy.json, patterns.json, screening.json and lists as <name>.txt; what is not there is built in."""
    digests, found = {}, {}
    for name in ("policy.json", "patterns.json", "screening.json", "dou.txt", "public_services.txt", "legal_refs.txt", "regions.txt"):
        path = os.path.join(folder, name)
        if os.path.exists(path):
            with open(path, "rb") as f:
                raw = f.read()
            digests[name] = hashlib.sha256(raw).hexdigest()
            try:
                found[name] = json.loads(raw) if name.endswith(".json") else entries(raw.decode("utf-8"))
            except ValueError as e:
                raise ConfigurationError(f"{name}: {e}") from None
    built = RuleSet()
    lists = {k: found.get(f"{k}.txt", v) for k, v in built.lists.items()}
    return RuleSet(policy(found.get("policy.json")), with_lists(detectors(found.get("patterns.json")), **lists), screening(found.get("screening.json")), lists, digests)


@dataclass(frozen=True)
class Settings:
    """Numbers of a run; ceilings are in CEILINGS."""

    document_deadline_s: float = 300.0
    llm_timeout_s: float = 60.0
    llm_concurrency: int = 8
    llm_max_tokens: int = 3000
    chunk_chars: int = 3000
    max_upload_bytes: int = 20_000_000
    max_zip_members: int = 500
    max_zip_member_bytes: int = 25_000_000
    max_zip_total_bytes: int = 60_000_000
    max_compression_ratio: float = 50.0
    max_text_chars: int = 400_000
    max_chunks: int = 150


CEILINGS = {"document_deadline_s": 3600.0, "llm_timeout_s": 600.0, "llm_concurrency": 64}


def dotenv(text: str) -> dict[str, str]:
    """KEY=VALUE lines; comments, blank lines and quotes around values go."""
    out = {}
    for line in text.splitlines():
        key, eq, value = line.strip().removeprefix("export ").partition("=")
        if eq and re.fullmatch(r"[A-Za-z_]\w*", key.strip()):
            value = value.strip()
            out[key.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"" else value
    return out


def settings(env: Mapping[str, str], file: Mapping[str, str] | None = None, prefix: str = "LETHE_") -> Settings:
    """Settings from the environment, which wins, and a file; each is finite, positive and below its ceiling."""
    given = {**(file or {}), **env}
    made = {}
    for f in fields(Settings):
        raw = given.get(prefix + f.name.upper())
        if raw is None or raw == "":
            continue
        try:
            value = int(raw) if isinstance(f.default, int) else float(raw)
        except ValueError:
            raise ConfigurationError(f"{f.name} must be a number") from None
        if not math.isfinite(value) or value <= 0 or value > CEILINGS.get(f.name, math.inf):
            raise ConfigurationError(f"{f.name} is out of range")
        made[f.name] = value
    out = Settings(**made)
    if out.max_zip_member_bytes > out.max_zip_total_bytes or out.llm_timeout_s > out.document_deadline_s or out.chunk_chars > out.max_text_chars:
        raise ConfigurationError("limits contradict each other")
    return out
