"""Text as it is matched by the screening rules: without accents, marks, case and format characters."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=65536)
def _fold_char(c: str) -> str:
    """What a character becomes; white space becomes one space each."""
    out = []
    for compatible in unicodedata.normalize("NFKC", c):
        if unicodedata.category(compatible) != "Cf":
            for x in unicodedata.normalize("NFD", compatible.casefold()):
                if unicodedata.category(x) != "Mn":
                    out.append(" " if x.isspace() else x)
    return "".join(out)


def fold(text: str | None) -> str | None:
    """Compatibility forms, without format characters, case-folded, decomposed, without marks; runs of white space are one space."""
    if text is None:
        return None
    if text.isascii():
        folded = "".join(" " if x.isspace() else x for x in text.lower()) if not text.isprintable() else text.lower()
    else:
        folded = "".join(map(_fold_char, text))
    return re.sub(" {2,}", " ", folded)


def place(text: str, at: int) -> int:
    """The index in text of the character that the folded character at ``at`` comes from."""
    n, last = 0, ""
    for i, c in enumerate(text):
        for x in _fold_char(c):
            if x == " " and last == " ":
                continue
            if n == at:
                return i
            n, last = n + 1, x
    return max(0, len(text) - 1)


def _fold_all(text: pd.Series) -> pd.Series:
    return text.map(fold)


def folded(text: Column) -> Column:
    """fold of a column, in Arrow batches."""
    return F.pandas_udf(_fold_all, "string")(text)
