"""Quality rules: base statistics, and divergence from the language's usual histograms.

Each document has a histogram of character classes and one of its language's most common words in
either case (and all others).  The mean histograms of a language's documents, with ``prior_docs`` mean documents of all
languages added (words by their place in the lists), are its references; a document's
Jensen-Shannon distance to them (0 to 1) must not exceed the limits.  Documents of fewer words
than ``least_words`` are too short to judge and are not.  Without a language the mean of all documents is the reference for
characters, and for words that of the language that comes nearest.

Only DataFrame functions are used.  Texts are read once; references are small aggregates.

Defined cases: null and empty texts have zero counts and fail the base rule; a language without a word list
is judged by characters alone; repeated rows are judged alike; an empty table gives no
rows; columns named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lethe.llm import _store

#: Common function words of each language.
COMMON = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "with", "on"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un"),
}
#: Character classes; what is in none of them is the last class.
CLASSES = ("[a-z]", "[A-Z]", "[0-9]", r"[\x20\x09-\x0D]", r"[.,;:!?'\"()\-]", r"[\x00-\x7F&&[^a-zA-Z0-9\x20\x09-\x0D.,;:!?'\"()\-]]", r"[^\x00-\x7F]")
CHAR_LIMIT = 0.33
#: A document without any common word lies at 0.30 to 0.31 on sf0.1, 99 % of those labelled good below 0.23 (see README).
WORD_LIMIT = 0.25
LEAST_WORDS = 50
#: Weight of the mean of all languages in each language's references, in documents.
PRIOR_DOCS = 10
MADE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_divergence", "word_divergence", "kept")
_P = _store.OWN


def _list(words) -> str:
    return ", ".join(f"'{x}'" for x in words)


def repeat_words(words: str, window: int = 8) -> Column:
    """Words in windows found twice or more, the first included, of the array column ``words``."""
    hashes = f"transform(array(transform({words}, x -> xxhash64(x))), v -> if(size(v) < {window}, array(), transform(sequence(1, size(v) - {window - 1}), i -> xxhash64(slice(v, i, {window})))))[0]"
    twice = "filter(a, (e, k) -> e.x <=> get(a, k - 1).x OR e.x <=> get(a, k + 1).x)"
    places = f"transform(array(sort_array(transform(h, (x, i) -> struct(x AS x, i AS i)))), a -> sort_array(transform({twice}, e -> e.i)))[0]"
    covered = f"aggregate({places}, struct(0L AS n, {-window} AS last), (s, p) -> struct(s.n + least({window}, p - s.last) AS n, p AS last), s -> s.n)"
    return F.expr(f"transform(array({hashes}), h -> if(size(array_distinct(h)) = size(h), 0L, {covered}))[0]")


def _distance(p: str, q: str) -> str:
    part = "(a, b) -> if(a > 0, a * log2(2 * a / (a + b)), 0D) + if(b > 0, b * log2(2 * b / (a + b)), 0D)"
    distance = f"sqrt(greatest(0D, least(1D, aggregate(zip_with({p}, {q}, {part}), 0D, (s, x) -> s + x) / 2)))"
    return f"if({p} IS NULL OR {q} IS NULL, NULL, {distance})"


def jensen_shannon(p: str, q: str) -> Column:
    """Distance of two distributions given as array columns; null if either is."""
    return F.expr(_distance(p, q))


def _shares(counts: str) -> str:
    """SQL: the shares of counted words and of all others among n_words."""
    return f"transform(concat({counts}, array(n_words - aggregate({counts}, 0D, (s, y) -> s + y))), x -> x / greatest(1D, CAST(n_words AS DOUBLE)))"


def _numbers(x: list[float] | None) -> Column:
    return F.lit(None).cast("array<double>") if x is None else F.array(*[F.lit(float(y)) for y in x])


def assess(docs: DataFrame, *, text: str = "text", lang: str = "lang", char_limit: float = CHAR_LIMIT, word_limit: float = WORD_LIMIT, least_words: int = LEAST_WORDS, prior_docs: int = PRIOR_DOCS, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns ``keep``) with the base statistics, both distances and the verdict."""
    carried = [c for c in (keep if keep is not None else docs.columns) if c.lower() not in MADE and not c.startswith(_P)]
    names = {c: f"{_P}c{i}" for i, c in enumerate(carried)}
    own = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], F.coalesce(_store.column(docs, text, "string"), F.lit("")).alias("t"), _store.column(docs, lang, "string").alias("lang"))
    own = own.withColumns(
        {
            "w": F.filter(F.split("t", r"[\x20\x09-\x0D]+"), lambda x: x != ""),
            "l": F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
            "usual": F.expr("CASE lang " + " ".join(f"WHEN '{k}' THEN array({_list(v)})" for k, v in COMMON.items()) + f" ELSE if(lang IS NULL, array({_list(x for v in COMMON.values() for x in v)}), NULL) END"),
        }
    )
    every = _list(sorted({x for v in COMMON.values() for x in v}))
    counts = F.expr(f"transform(array(filter(transform(w, x -> lower(x)), x -> x IN ({every}))), c -> transform(usual, y -> CAST(size(filter(c, x -> x = y)) AS DOUBLE)))[0]")
    stats = own.select(
        *names.values(),
        "lang",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("t", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        repeat_words("w").alias("n_repeat_words"),
        F.array(*[(F.length("t") - F.length(F.regexp_replace("t", c + "+", ""))).cast("double") for c in CLASSES]).alias("chars"),
        counts.alias("common"),
    )
    stats = _store.stored(stats, "quality")
    size = len(next(iter(COMMON.values())))
    stats = stats.withColumns(
        {
            "p": F.expr("transform(chars, x -> x / greatest(1D, aggregate(chars, 0D, (s, y) -> s + y)))"),
            # One histogram, or without a language one for each list.
            "wps": F.expr(f"transform(sequence(0, size(common) DIV {size} - 1), k -> {_shares(f'slice(common, k * {size} + 1, {size})')})"),
            "judged": F.col("n_words") >= least_words,
        }
    )

    def means(name: str, n: int) -> list[Column]:
        return [F.avg(F.get(F.col(name), F.lit(i))) for i in range(n)]

    judged = stats.filter("judged").withColumn("wp", F.when(F.col("lang").isNotNull(), F.get("wps", F.lit(0))))
    of_lang = judged.filter("lang IS NOT NULL").groupBy("lang").agg(F.count("*").alias("n"), F.array(*means("p", len(CLASSES))).alias("q"), F.array(*means("wp", size + 1)).alias("wq"))
    # One row of as many numbers as there are classes, and one for each word list.
    of_all = judged.agg(F.array(*means("p", len(CLASSES))).alias("q"), F.array(*means("wp", size + 1)).alias("wq")).first()
    listed = {r["lang"]: r for r in of_lang.filter(F.col("lang").isin(*COMMON)).collect()}
    whole, words = (_numbers(None if x[0] is None else x) for x in (of_all["q"], of_all["wq"]))
    mixed = "zip_with({0}, {1}, (a, b) -> (n * a + {2} * b) / (n + {2}))"
    df = stats.join(of_lang, "lang", "left").withColumns({"all_q": whole, "all_wq": words})
    df = df.withColumn("ref", F.when(F.col("lang").isNull(), F.col("all_q")).otherwise(F.expr(mixed.format("q", "all_q", prior_docs))))
    known = [_numbers([(listed[k]["n"] * x + prior_docs * y) / (listed[k]["n"] + prior_docs) for x, y in zip(listed[k]["wq"], of_all["wq"], strict=True)] if k in listed else None) for k in COMMON]
    df = df.withColumn("refs", F.when(F.col("lang").isNull(), F.array(*known)).otherwise(F.array(F.expr(mixed.format("wq", "all_wq", prior_docs)))))
    df = df.withColumns(
        {
            "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
            "char_divergence": F.when(F.col("judged"), jensen_shannon("p", "ref")),
            "word_divergence": F.when(F.col("judged"), F.expr(f"array_min(zip_with(wps, refs, (h, r) -> {_distance('h', 'r')}))")),
        }
    )
    near = F.coalesce(F.col("char_divergence") <= char_limit, F.lit(True)) & F.coalesce(F.col("word_divergence") <= word_limit, F.lit(True))
    return df.select(*[F.col(n).alias(c) for c, n in names.items()], *MADE[:6], "char_divergence", "word_divergence", (~F.col("base_failed") & near).alias("kept"))
