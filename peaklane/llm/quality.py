"""Quality rules by distribution divergence, in DataFrame operations only.

A document's histogram of character classes and its histogram of common words are compared with references of
languages by the Jensen-Shannon distance (base 2, so from 0 to 1). The reference nearest to the document counts, so
a wrong or missing language label does no harm. Short texts have unreliable histograms and are not judged by them.
The references given are those of four languages; ``learn_references`` makes others from a table of clean documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from peaklane.llm.names import own_names

#: Shares of word characters by class: ASCII letters, 0-9, beyond ASCII, the rest. Fixed values, measured on rows
#: of ``labels`` with quality 1. Capitals are letters like others, so a notice in capitals is no junk.
CLASSES = {
    "en": (0.971, 0.001, 0.000, 0.028),
    "de": (0.928, 0.001, 0.045, 0.026),
    "fr": (0.861, 0.001, 0.109, 0.029),
    "es": (0.878, 0.001, 0.093, 0.028),
}
#: Shares of common words, lower-cased, among all words. Fixed values, measured on the rows of ``labels`` of sf0.1 with quality 1
#: and an even crc32(doc_id as text); the other half is held out.
COMMON = {
    "en": {"the": 0.0556, "of": 0.0286, "and": 0.0229, "to": 0.0169, "a": 0.0140, "in": 0.0118, "is": 0.0106, "that": 0.0092, "it": 0.0080, "for": 0.0078, "was": 0.0068, "on": 0.0066,
           "with": 0.0059, "as": 0.0053, "be": 0.0049, "by": 0.0048, "this": 0.0046, "are": 0.0044, "at": 0.0041, "from": 0.0036, "an": 0.0033, "he": 0.0029, "or": 0.0023},
    "de": {"der": 0.0549, "die": 0.0290, "und": 0.0226, "in": 0.0169, "den": 0.0145, "von": 0.0118, "zu": 0.0101, "das": 0.0094, "mit": 0.0080, "sich": 0.0079, "des": 0.0068, "auf": 0.0068,
           "für": 0.0060, "ist": 0.0054, "im": 0.0051, "dem": 0.0047, "nicht": 0.0046, "eine": 0.0046, "ein": 0.0042, "als": 0.0034},
    "fr": {"de": 0.0551, "la": 0.0298, "le": 0.0222, "et": 0.0166, "les": 0.0140, "des": 0.0117, "en": 0.0112, "un": 0.0100, "du": 0.0081, "une": 0.0074, "que": 0.0063, "pour": 0.0066,
           "est": 0.0063, "dans": 0.0055, "qui": 0.0048, "par": 0.0042, "au": 0.0045, "sur": 0.0043, "pas": 0.0044, "avec": 0.0039, "ou": 0.0031},
    "es": {"de": 0.0545, "la": 0.0287, "que": 0.0228, "el": 0.0164, "en": 0.0142, "y": 0.0115, "los": 0.0101, "se": 0.0087, "las": 0.0089, "del": 0.0081, "un": 0.0068, "por": 0.0067,
           "con": 0.0058, "no": 0.0053, "una": 0.0046, "su": 0.0047, "para": 0.0043, "al": 0.0045, "es": 0.0039, "lo": 0.0036},
}
#: Farthest distance of the common words of n words: WORD_BASE + WORD_SLOPE / sqrt(n), since a short text's histogram is farther
#: from its own language by chance. Set on the measured half of ``labels`` and on paragraphs of public licences (100 words
#: or more: up to 0.314 at 136 words). A text without any common word has 0.358 or more.
WORD_BASE, WORD_SLOPE = 0.16, 1.85
_BLANK = r"[\x20\x09-\x0D]+"
_SIDES = " \t\n\x0b\f\r"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _words(text: str) -> Column:
    trimmed = F.trim(F.coalesce(F.col(text), F.lit("")), F.lit(_SIDES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _BLANK))


def _distance(p: Column, q: list[float]) -> Column:
    """Jensen-Shannon distance of a histogram (an array of shares) from a reference."""
    part = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
    terms = F.zip_with(p, F.array(*[F.lit(float(x)) for x in q]), lambda a, b: part(a, b) + part(b, a))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def _repeat_words(words: Column) -> Column:
    """Words inside windows of three words that occur twice or more, the first included.

    Windows are sorted as structs of a 64-bit hash and their place, and neighbours count as equal only if their words
    are.
    """

    def spread(w: Column) -> Column:
        codes = F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), F.lit(1), F.size(w) - 2)
        placed = lambda c: F.sort_array(F.transform(c, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        window = lambda x: F.slice(w, x.i + 1, F.lit(3))
        equal = lambda x, y: F.coalesce((x.h == y.h) & (window(x) == window(y)), F.lit(False))
        twice = lambda s: F.sort_array(F.transform(F.filter(s, lambda x, i: equal(x, F.get(s, i + 1)) | equal(x, F.get(s, i - 1))), lambda x: x.i))
        covered = lambda t: F.aggregate(F.transform(t, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(t, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
        return _let(codes, lambda c: F.when(F.size(F.array_distinct(c)) == F.size(c), 0).otherwise(_let(placed(c), lambda s: _let(twice(s), covered))))

    return F.when(F.size(words) < 4, 0).otherwise(spread(words)).cast("long")


def _class_counts(glued: str) -> dict[str, Column]:
    kept = lambda kind: F.length(glued) - F.length(F.regexp_replace(glued, kind, ""))
    return {"_letter": kept("[A-Za-z]+"), "_digit": kept("[0-9]+"), "_other": kept(r"[^\x00-\x7F]+")}


def learn_references(docs: DataFrame, lang: str, *, text: str = "text", top: int = 24) -> dict[str, dict]:
    """``classes`` and ``common`` for ``quality_rules``: of each language of clean ``docs`` the shares of its character classes
    and of its ``top`` commonest words, lower-cased (of equally common ones the first in order).

    The driver gets ``top + 1`` rows a language; a column of languages has few values. Rows without a language, and languages
    without words, count for nothing.
    """
    cut = docs.filter(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), _words(text).alias("_words")).withColumn("_glued", F.array_join("_words", ""))
    counts = cut.select("lang", F.length("_glued").cast("long").alias("n"), *[c.cast("long").alias(k) for k, c in _class_counts("_glued").items()]).groupBy("lang").agg(*[F.sum(c).alias(c) for c in ("n", "_letter", "_digit", "_other")])
    shares = {r.lang: [r._letter, r._digit, r._other, r.n - r._letter - r._digit - r._other] for r in counts.filter("n > 0").collect()}
    words = cut.select("lang", F.explode(F.transform("_words", F.lower)).alias("word")).groupBy("lang", "word").count()
    total, order = Window.partitionBy("lang"), Window.partitionBy("lang").orderBy(F.desc("count"), "word")
    best = words.withColumns({"share": F.col("count") / F.sum("count").over(total), "r": F.row_number().over(order)}).filter(F.col("r") <= top)
    common: dict[str, dict[str, float]] = {k: {} for k in shares}
    for r in best.orderBy("lang", "r").collect():
        common[r.lang][r.word] = r.share
    return {"classes": {k: tuple(x / sum(v) for x in v) for k, v in shares.items()}, "common": common}


@own_names("text")
def quality_signals(docs: DataFrame, *, text: str = "text", classes: dict = CLASSES, common: dict = COMMON) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class_distance and word_distance."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.length(F.trim(x, F.lit(_SIDES))) > 0)
    docs = docs.withColumn("_words", _words(text))
    listed = sorted({w for words in common.values() for w in words})
    docs = docs.withColumns({
        "n_words": F.size("_words").cast("long"),
        "_glued": F.array_join("_words", ""),
        "n_symbols": F.length(whole) - F.length(F.regexp_replace(whole, r"[#*$%&|<>]", "")),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": _repeat_words(F.col("_words")),
        "_common": F.transform(F.filter("_words", lambda x: F.lower(x).isin(listed)), F.lower),
    })
    docs = docs.withColumns({"word_chars": F.length("_glued").cast("long"), **_class_counts("_glued")})
    docs = docs.withColumn("n_symbols", F.col("n_symbols").cast("long"))
    counts = F.array("_letter", "_digit", "_other", F.col("word_chars") - F.col("_letter") - F.col("_digit") - F.col("_other"))
    shares = F.transform(counts, lambda c: c / F.greatest(F.col("word_chars"), F.lit(1)))
    docs = docs.withColumn("class_distance", _let(shares, lambda p: F.array_min(F.array(*[_distance(p, q) for q in classes.values()]))))

    # a share for each listed word, made once for all languages
    docs = docs.withColumn("_shares", F.array(*[(F.size("_common") - F.size(F.array_remove("_common", w))) / F.greatest(F.col("n_words"), F.lit(1)) for w in listed]))

    def by_word(shares: Column, words: dict) -> Column:
        named = F.array(*[F.get(shares, F.lit(listed.index(w))) for w in words])
        with_rest = _let(named, lambda p: F.concat(p, F.array(1 - F.aggregate(p, F.lit(0.0), lambda a, x: a + x))))
        return _let(with_rest, lambda p: _distance(p, [*words.values(), 1 - sum(words.values())]))

    docs = docs.withColumn("word_distance", _let(F.col("_shares"), lambda s: F.array_min(F.array(*[by_word(s, words) for words in common.values()]))))
    return docs.drop("_words", "_glued", "_common", "_shares", "_letter", "_digit", "_other")


def quality_rules(docs: DataFrame, *, text: str = "text", min_words: int = 50, max_repeat: int = 50, max_class: float = 0.25, word_base: float = WORD_BASE, word_slope: float = WORD_SLOPE, class_guard: int = 500, word_guard: int = 100, **references) -> DataFrame:
    """``quality_signals`` with ``base_failed`` (too short, or more than ``max_repeat`` percent of the words in
    repeated windows) and ``kept``.

    A document is not kept if it failed the base rules, or if it has ``class_guard`` word characters or more and its
    class histogram is farther than ``max_class`` from every reference, or ``word_guard`` words or more and its
    common words are farther than ``word_base + word_slope / sqrt(n_words)``. Null and empty texts have no words and fail. Rows are judged one by
    one, so repeated rows and ties don't matter; an empty table stays empty. Columns named like a new one are replaced.
    """
    docs = quality_signals(docs, text=text, **references)
    far = ((F.col("word_chars") >= class_guard) & (F.col("class_distance") > max_class)) | ((F.col("n_words") >= word_guard) & (F.col("word_distance") > word_base + word_slope / F.sqrt("n_words")))
    docs = docs.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words")))
    return docs.withColumn("kept", ~F.col("base_failed") & ~far)


def keep_good(docs: DataFrame, *, text: str = "text", **rules) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with the same columns and values, whatever their names.

    The row number keeps the filter above the projection that judges: pushed below, it would repeat every signal's
    expression inside the others.
    """
    judged = quality_rules(docs.select(F.struct("*").alias("_doc"), F.col(text).alias("text")), **rules).withColumn("_row", F.monotonically_increasing_id())
    return judged.filter("kept AND _row >= 0").select("_doc.*")
