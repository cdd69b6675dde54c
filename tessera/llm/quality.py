"""Per-document text statistics, and rules that tell prose from lists, tables and junk.

Method: all statistics are built-in column expressions (no Python per row): lengths, symbols, closing punctuation, bullets
and common words, in one pass without a shuffle. Fixed thresholds of published rule sets then apply, and each rule that
fails is recorded as a reason. Of the published rules some fail for prose too (broken lines, figures, short texts, a short list): these
are recorded as remarks and do not decide. As the published rules alone do not tell by which kind the larger part of the
characters is, a last rule judges lines and weighs them by characters.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Common words of English, German, French and Spanish (articles, pronouns, prepositions, auxiliaries).
COMMON_WORDS = {
    "en": "the of and to in is was that for on with as by at from it its be were are this these those had not which who what or an been has have but they their them we our us you he she his her after before between while because if when where than then so no nor neither only one ones each all some any more most other same such would should could can will may might must into over under about against during through until near per also there here out up down did does do",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine einen einer eines einem als auch es an werden aus er sie wir hat haben dass daß nach wird bei um am sind noch wie über zum zur war waren wurde wurden nur oder aber vor bis mehr durch man sein seine ihre dieser diese dieses ob denn wenn weil zwischen unter gegen während",
    "fr": "de la le les et des en un une du que qui est pour dans par plus pas au aux sur ne se ce cette ces il elle ils elles sont avec ou où mais comme son sa ses leur été être ont avait avaient a à on nous vous après avant entre car si dont tandis seulement chez lors qu",
    "es": "de la el los las y en que un una por con para del al lo su sus se como más pero fue fueron era eran es son ha han había entre sin sobre ya no ni o si desde hasta cuando porque según durante después antes también esta este estos estas otras otros cuya cuyo",
}
#: Characters that wrongly decoded text is full of.
GARBLED = "ÂÃãâ€œ¤§¶©¢¬�"
#: Marks at the start of a list item.
BULLET = r"^(?:[-*+•–—‣◦▪●○·#>~=]+|[#(]?\d{1,3}[.):\]]|#\d+|\(?[A-Za-z][.)]|\[[ xX]?\])\s"
#: Cell borders: tabs, pipes, tags, wide blanks, signs between menu entries.
CELLS = r"[\t|»›→]|</?[a-zA-Z]| {3,}\S"
MENU = r"(?: [/·•>] [^/·•>]*){3}"
#: A line with fewer than one blank in so many characters holds no words.
UNBROKEN = 45
CLOSED = r"[.!?…]['\"”’»)\]]*$"
#: A line this long may be a sentence of its own; a shorter one from MIN_BROKEN on may be part of a broken paragraph.
MIN_SENTENCE, MIN_BROKEN = 80, 38
MIN_COMMON, MIN_LETTERS, MAX_GARBLED, MIN_WORDS = 0.1, 0.7, 0.06, 3

#: Published thresholds. Gopher's quality rules (Rae et al. 2021, table A1): 50 to 100,000 words, mean word length 3
#: to 10, at most 0.1 hash signs or ellipses a word, at most 90 % of lines with a bullet and 30 % with an ellipsis at their
#: end, 80 % of words with a letter, two common words. FineWeb's (Penedo et al. 2024): at least 12 % of lines closed by
#: punctuation, at most 67 % of lines of 30 characters or fewer.
GOPHER_WORDS, GOPHER_WORD_LENGTH, GOPHER_SYMBOLS, GOPHER_BULLETS, GOPHER_ELLIPSES, GOPHER_LETTERS, GOPHER_COMMON = (50, 100_000), (3, 10), 0.1, 0.9, 0.3, 0.8, 2
FINEWEB_CLOSED, FINEWEB_SHORT, FINEWEB_SHORT_LINE = 0.12, 0.67, 30
BLANKS = " \t\r\n"


def published_stats(documents: DataFrame) -> DataFrame:
    """doc_id, words, mean_word_length, symbol_ratio, letter_word_share, lines, closed_line_share, bullet_line_share,
    ellipsis_line_share, short_line_share: the statistics that the published rules are stated for. Words are what blanks
    separate, lines are those that are not blank; shares of an empty text are null."""
    return _with_lines(documents).select("doc_id", *[c.alias(name) for name, c in _published().items()])


def _with_lines(documents: DataFrame) -> DataFrame:
    """doc_id, text (never null) and lines: those that are not blank."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.transform(F.split(text, "[\\r\\n]+"), lambda x: F.btrim(x, F.lit(BLANKS))), lambda x: x != "")
    return documents.select("doc_id", text.alias("text"), F.explode(F.array(lines)).alias("lines"))  # worked out once


def _published() -> dict[str, Column]:
    text, lines = F.col("text"), F.col("lines")
    word = f"[^{BLANKS}]"
    words = F.regexp_count(text, F.lit(f"{word}+"))
    symbols = F.length(text) - F.length(F.replace(text, F.lit("#"), F.lit(""))) + F.regexp_count(text, F.lit(r"\.\.\.|…"))
    share = lambda a, b: F.round(F.try_divide(a.cast("double"), b), 6)
    of_lines = lambda test: share(F.size(F.filter(lines, test)), F.size(lines))
    return {
        "words": words.cast("long"),
        "mean_word_length": share(_left(text, f"[{BLANKS}]+"), words),
        "symbol_ratio": share(symbols, words),
        "letter_word_share": share(F.regexp_count(text, F.lit(rf"{word}*\p{{L}}{word}*")), words),
        "lines": F.size(lines),
        "closed_line_share": of_lines(lambda x: F.right(x, F.lit(1)).isin(*".!?…\"'”’»)]")),
        "bullet_line_share": of_lines(lambda x: F.substring(x, 1, 1).isin(*"-*•‣◦▪●○·–—+")),
        "ellipsis_line_share": of_lines(lambda x: (F.right(x, F.lit(1)) == "…") | (F.right(x, F.lit(3)) == "...")),
        "short_line_share": of_lines(lambda x: F.length(x) <= FINEWEB_SHORT_LINE),
    }


def _bind(value: Column, then) -> Column:
    """then(value) with value computed once."""
    return F.transform(F.array(value), then)[0]


def _left(c: Column, pattern: str) -> Column:
    """Characters that are left without the matches of the pattern (the fewer matches, the cheaper)."""
    return F.length(F.regexp_replace(c, pattern, ""))


def document_stats(documents: DataFrame) -> DataFrame:
    """doc_id and statistics of each document's text.

    chars (without blanks at the ends of lines), words, common_words, word_chars, symbols, lines (not blank), closed_lines
    (ending in punctuation), bullet_lines, table_lines, and the characters of each kind of line: prose_chars, bullet_chars,
    table_chars, symbol_chars (mostly figures and signs, or no blanks), uncommon_chars (hardly a common word), fragment_chars (headings
    and items: short, not closed), broken_chars (not closed, but beside others like it), garbled_chars. Null texts count as empty: all zero.
    """
    common = sorted({w for words in COMMON_WORDS.values() for w in words.split()})
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), r"\r\n|[\n\r \u0085]"), lambda x: F.rtrim(x))
    text = F.coalesce("text", F.lit(""))
    whole = [_left(text, r"[^\p{L}\p{N}]+").alias("word_chars"), _left(text, r"[\p{L}\p{N}\s]+").alias("symbols")]
    cut = _with_lines(documents).select("doc_id", *whole, *[c.alias(f"published_{name}") for name, c in _published().items()], F.explode(F.array(lines)).alias("lines"))

    def is_closed(line: Column) -> Column:
        return F.right(line, F.lit(4)).rlike(CLOSED)

    def long_or_closed(line: Column) -> Column:
        return F.coalesce((F.length(line) >= MIN_BROKEN) | is_closed(line), F.lit(False))

    def measure(raw: Column, i: Column) -> Column:
        def kinds(x: Column) -> Column:
            line, size, n, known, closed = x["line"], x["size"], x["words"], x["known"], x["closed"]
            beside = long_or_closed(F.get("lines", i + 1)) | long_or_closed(F.get("lines", i - 1))
            running = closed | (size >= MIN_SENTENCE) | ((size >= MIN_BROKEN) & beside) | ((F.size("lines") == 1) & (n > MIN_WORDS))
            kind = (
                F.when(size == 0, "blank")
                .when(line.rlike(BULLET), "bullet")
                .when(line.rlike(CELLS) | (reduce(Column.__or__, [line.contains(f" {c} ") for c in "/·•>"]) & line.rlike(MENU)), "table")
                .when(size - _left(line, f"[{GARBLED}]+") > MAX_GARBLED * size, "garbled")
                .when((_left(line, r"[^\p{L} ]+") < MIN_LETTERS * size) | ((size >= UNBROKEN) & ((size - F.length(F.replace(line, F.lit(" "), F.lit("")))) * UNBROKEN < size)), "symbol")
                .when(~running | (n < MIN_WORDS), "fragment")
                .when(known < MIN_COMMON * n, "uncommon")
                .when(closed | (size >= MIN_SENTENCE), "prose")
                .otherwise("broken")
            )
            return F.struct(size.alias("size"), n.alias("words"), known.alias("known"), closed.alias("closed"), kind.alias("kind"))

        def counts(x: Column) -> Column:
            line, words = x["line"], x["words"]
            blank = lambda w: F.when(w == "", 1).otherwise(0)
            n = F.size(words) - blank(words[0]) - F.when(F.size(words) > 1, blank(F.element_at(words, -1))).otherwise(0)
            known = F.size(F.filter(words, lambda w: w.isin(common)))
            return _bind(F.struct(line.alias("line"), F.length(line).alias("size"), n.alias("words"), known.alias("known"), is_closed(line).alias("closed")), kinds)

        def words_of(line: Column) -> Column:
            # figures with their signs and abbreviations like n/a are no words
            plain = F.when(line.contains("/"), F.regexp_replace(F.lower(line), r"\p{L}*/\p{L}*", "/")).otherwise(F.lower(line))
            return _bind(F.struct(line.alias("line"), F.split(plain, r"[^\p{L}]+").alias("words")), counts)

        return _bind(F.btrim(raw, F.lit(" \t")), words_of)

    measured = cut.select("doc_id", "word_chars", "symbols", *[c for c in cut.columns if c.startswith("published_")], F.explode(F.array(F.transform("lines", measure))).alias("m"))
    total = lambda pick: F.aggregate("m", F.lit(0).cast("long"), lambda n, x: n + pick(x))
    of = lambda kind, what: total(lambda x: F.when(x["kind"] == kind, what(x)).otherwise(0))
    one = lambda x: F.lit(1)
    size = lambda x: x["size"]
    return measured.select(
        "doc_id",
        total(size).alias("chars"),
        total(lambda x: x["words"]).alias("words"),
        total(lambda x: x["known"]).alias("common_words"),
        F.col("word_chars").cast("long").alias("word_chars"),
        F.col("symbols").cast("long").alias("symbols"),
        total(lambda x: F.when(x["size"] > 0, 1).otherwise(0)).alias("lines"),
        total(lambda x: F.when(x["closed"], 1).otherwise(0)).alias("closed_lines"),
        of("bullet", one).alias("bullet_lines"),
        of("table", one).alias("table_lines"),
        of("fragment", one).alias("fragment_lines"),
        of("broken", one).alias("broken_lines"),
        *[of(k, size).alias(f"{k}_chars") for k in KINDS],
        *[c for c in measured.columns if c.startswith("published_")],
    )


KINDS = ("prose", "broken", "bullet", "table", "symbol", "uncommon", "fragment", "garbled")


def quality(documents: DataFrame) -> DataFrame:
    """doc_id, words, mean_word_length, symbol_ratio, closed_line_share, common_word_share, prose_share, is_prose, label,
    reasons, remarks.

    reasons lists the rules that fail; a text is prose if there are none. blank; word_length, symbols, bullets, ellipses,
    common_words (Gopher); and by characters of lines few_common_words, list, cells, unbroken,
    fragments, garbled (each more than half), little_prose (less than half in running sentences). remarks lists those
    published rules that fail for much prose as well: word_count, words_without_letters (Gopher), open_lines, short_lines (FineWeb).
    label names what a text is otherwise by the most characters: list, table or junk. Shares of an empty text are null.
    """
    share = lambda a, b: F.round(F.try_divide(F.col(a).cast("double"), F.col(b)), 6)
    s = document_stats(documents)
    # where there are as many fragments, lines that only might be parts of a broken paragraph are items of a list too
    items = F.col("fragment_lines") >= F.col("broken_lines")
    s = s.withColumns({"prose_chars": F.col("prose_chars") + F.when(items, 0).otherwise(F.col("broken_chars")), "fragment_chars": F.col("fragment_chars") + F.when(items, F.col("broken_chars")).otherwise(0)})
    listed = F.col("bullet_chars") + F.col("fragment_chars")
    junk = F.col("garbled_chars") + F.col("uncommon_chars") + F.col("symbol_chars")
    over = lambda c: F.col("chars") < 2 * c
    there = F.col("chars") > 0
    p = lambda name: F.col(f"published_{name}")
    failed = [
        (~there, "blank"),
        ((p("mean_word_length") < GOPHER_WORD_LENGTH[0]) | (p("mean_word_length") > GOPHER_WORD_LENGTH[1]), "word_length"),
        (p("symbol_ratio") > GOPHER_SYMBOLS, "symbols"),
        (p("bullet_line_share") > GOPHER_BULLETS, "bullets"),
        (p("ellipsis_line_share") > GOPHER_ELLIPSES, "ellipses"),
        (there & (F.col("common_words") < GOPHER_COMMON), "common_words"),
        (over(F.col("uncommon_chars")), "few_common_words"),
        (over(F.col("bullet_chars")), "list"),
        (over(F.col("table_chars")), "cells"),
        (over(F.col("symbol_chars")), "unbroken"),
        (over(F.col("fragment_chars")), "fragments"),
        (over(F.col("garbled_chars")), "garbled"),
        (there & (2 * F.col("prose_chars") < F.col("chars")), "little_prose"),
    ]
    remarks = [
        (there & ~p("words").between(*GOPHER_WORDS), "word_count"),
        (p("letter_word_share") < GOPHER_LETTERS, "words_without_letters"),
        (p("closed_line_share") < FINEWEB_CLOSED, "open_lines"),
        (p("short_line_share") > FINEWEB_SHORT, "short_lines"),
    ]
    named = lambda rules: F.filter(F.array(*[F.when(c, name) for c, name in rules]), lambda x: x.isNotNull())
    label = F.when((F.col("table_chars") >= junk) & (F.col("table_chars") >= listed) & (F.col("table_chars") > 0), "table").when((listed >= junk) & (listed > 0), "list").otherwise("junk")
    judged = s.select(
        "doc_id", "words",
        share("word_chars", "words").alias("mean_word_length"),
        share("symbols", "words").alias("symbol_ratio"),
        share("closed_lines", "lines").alias("closed_line_share"),
        share("common_words", "words").alias("common_word_share"),
        share("prose_chars", "chars").alias("prose_share"),
        label.alias("otherwise"), named(failed).alias("reasons"), named(remarks).alias("remarks"),
    )
    prose = F.size("reasons") == 0
    return judged.select(*judged.columns[:7], prose.alias("is_prose"), F.when(prose, "prose").otherwise(F.col("otherwise")).alias("label"), "reasons", "remarks")


def not_prose(documents: DataFrame) -> DataFrame:
    """doc_id of the documents that are no prose, blank texts included."""
    return quality(documents).where(~F.col("is_prose")).select("doc_id")
