"""Evaluation passages that leak into training text.

Method: one Aho-Corasick automaton over the normalised test passages, whose patterns are their overlapping windows of
WINDOW words, scans each text once. Text and passages are normalised alike: case, accents, punctuation, spaces, line breaks,
hyphens and invisible characters go, so a divided word matches as well. Windows that follow each other in passage and
text make runs; every run is extended word by word in both directions over single changed, added and missing words; a
stretch of MIN_WORDS words of the passage or more is a leak. Offsets are mapped back to the original text. Any three single
changes within MIN_WORDS words leave runs of WINDOW words that make up MIN_SEEDED words, so they are found.

Scale: the automaton is built from the test items, a table of bounded size that is checked before it is sent out; more
items take several automata. Texts are scanned where they lie, without a shuffle.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

WINDOW, MIN_SEEDED, MIN_WORDS = 4, 6, 18
#: Where a figure is replaced by another one, as many words on both sides must agree: sentences of one pattern with other
#: figures say something else.
BESIDE_FIGURES = 5
#: The most letters of a changed or added word.
LONGEST_WORD = 40
#: The most characters of the passages of one automaton, which takes some 500 bytes for each; and the most automata.
MOST_PASSAGE_CHARS, MOST_AUTOMATA = 5_000_000, 20

_BETWEEN_WORDS = re.compile("[^\\w\u0300-\u036f\u00ad\u200b-\u200d\u2060\ufeff]+|_")
_ALNUM = re.compile(r"[^\W_]+")
_INVISIBLE = re.compile("[\u0300-\u036f\u00ad\u200b-\u200d\u2060\ufeff]")
_NOT_ALNUM = re.compile(r"[\W_]+")
_OTHER_LETTERS = re.compile(r"[^\W\x00-\x7f]")
_ASCII_OUT = bytes(i for i in range(128) if not chr(i).isalnum())


def normalise(text: str) -> str:
    """Letters and digits only, in lower case, without accents."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).casefold()
        if _OTHER_LETTERS.search(text):
            return _NOT_ALNUM.sub("", text)
        text = text.encode("ascii", "ignore").decode()
    return text.lower().encode().translate(None, _ASCII_OUT).decode()


def words_of(text: str) -> list[str]:
    """The words of a passage, each normalised. Words end at anything but letters, digits and invisible marks in them."""
    return [w for w in map(normalise, _BETWEEN_WORDS.split(text)) if w]


def word_bounds(text: str, size: int) -> list[int]:
    """Where the words of a text begin, and the last one ends, in normalise(text) of that size."""
    plain = text if text.isascii() else _INVISIBLE.sub("", unicodedata.normalize("NFKD", text).casefold())
    bounds = [0, *accumulate(len(w) for w in _ALNUM.findall(plain))]
    return bounds if bounds[-1] == size else [0, *accumulate(len(w) for w in words_of(text))]


def offsets(text: str) -> list[int]:
    """For each character of normalise(text), the position in the text of the character that it comes from."""
    return [i for i, c in enumerate(text) for _ in normalise(c)]


class Passages:
    """The automaton of all passages, and what is needed to join its hits."""

    def __init__(self, passages: list[tuple[int, str]]):
        self.items: list[int] = []
        self.words: list[list[str]] = []
        self.starts: list[list[int]] = []  # of each word, in the normalised passage; last, its length
        windows: dict[str, list[tuple[int, int]]] = {}
        for item, text in passages:
            words = words_of(text or "")
            starts = [0]
            for w in words:
                starts.append(starts[-1] + len(w))
            at = len(self.items)
            self.items.append(item)
            self.words.append(words)
            self.starts.append(starts)
            for j in range(len(words) - WINDOW + 1):
                windows.setdefault("".join(words[j : j + WINDOW]), []).append((at, j))
        import ahocorasick  # only the scan needs it

        self.automaton = ahocorasick.Automaton()
        for window, places in windows.items():
            self.automaton.add_word(window, (len(window), places))
        self.empty = not windows
        if windows:
            self.automaton.make_automaton()

    def stretches(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """(item, first word, words, from, to) of each leaked stretch; from and to are positions in normalise(text)."""
        if self.empty:
            return []
        normal = normalise(text)
        runs: dict[tuple[int, int], list[list[int]]] = {}  # by passage and diagonal: [first, last word] of each run
        starts = self.starts
        for end, (size, places) in self.automaton.iter(normal):
            begin = end + 1 - size
            for at, j in places:
                key = (at, begin - starts[at][j])
                own = runs.get(key)
                if own is None:
                    runs[key] = [[j, j + WINDOW - 1]]
                elif own[-1][1] >= j - 1:
                    own[-1][1] = j + WINDOW - 1
                else:
                    own.append([j, j + WINDOW - 1])
        by_passage: dict[int, list[tuple[int, int, int]]] = {}
        for (at, diagonal), own in runs.items():
            place = by_passage.setdefault(at, [])
            for first, last in own:
                place.append((starts[at][first] + diagonal, first, last))
        out, bounds = [], None
        for at, found in by_passage.items():
            if found := _near(sorted(found), starts[at]):
                if bounds is None:
                    bounds = word_bounds(text, len(normal))
                out.extend(self._extend(at, found, normal, bounds))
        return out

    def _extend(self, at: int, found: list[tuple[int, int, int]], text: str, bounds: list[int]) -> Iterator[tuple[int, int, int, int, int]]:
        words, starts = self.words[at], self.starts[at]
        done: list[tuple[int, int, int, int]] = []
        for begin, first, last in found:
            end = begin + starts[last + 1] - starts[first]
            if any(a <= first and last <= b and x <= begin and end <= y for a, b, x, y in done):
                continue
            run = last - first + 1
            last, end = _follow(words, text, bounds, last + 1, end, 1, run)
            first, begin = _follow(words, text, bounds, first - 1, begin, -1, run)
            done.append((first, last, begin, end))
        for first, last, begin, end in done:
            inside = any((a, b, x, y) != (first, last, begin, end) and a <= first and last <= b and x <= begin and end <= y for a, b, x, y in done)
            if last - first + 1 >= MIN_WORDS and not inside:
                yield self.items[at], first, last - first + 1, begin, end


def _near(found: list[tuple[int, int, int]], starts: list[int]) -> list[tuple[int, int, int]]:
    """The runs (text position, first, last word; sorted) of MIN_SEEDED words, and those with another run so near in text
    and passage that both can be of one stretch of MIN_WORDS words with three single changes."""
    kept = set()
    for n, (begin, first, last) in enumerate(found):
        if last - first + 1 >= MIN_SEEDED:
            kept.add(n)
        far = starts[min(first + MIN_WORDS, len(starts) - 1)] - starts[first] + 3 * LONGEST_WORD
        for m in range(n + 1, len(found)):
            if found[m][0] - begin > far:
                break
            if first < found[m][1] <= first + MIN_WORDS:
                kept |= {n, m}
    return [found[n] for n in sorted(kept)]


def _matched(words: list[str], text: str, j: int, p: int, step: int, most: int) -> tuple[int, int, int]:
    """How many words from word j on (at most `most`) stand one after another at p, with the next word and place."""
    n = 0
    while 0 <= j < len(words) and n < most:
        w = words[j]
        if not text.startswith(w, p) if step > 0 else p < len(w) or not text.startswith(w, p - len(w)):
            break
        n, j, p = n + 1, j + step, p + step * len(w)
    return n, j, p


def _follow(words: list[str], text: str, bounds: list[int], j: int, p: int, step: int, run: int) -> tuple[int, int]:
    """The last word, and where it ends, that is reached from word j at p over single changed, added and missing words,
    after a run of so many words.

    bounds: where the words of the text begin and end. A run shorter than WINDOW words beyond such a word must be of whole
    words of the text. Of several ways on, the one with the longest next run is taken."""
    while True:
        n, j, p = _matched(words, text, j, p, step, len(words))
        run += n
        i = bisect_right(bounds, p) if step > 0 else bisect_left(bounds, p) - 1
        ways = [(j + step, p, 1)]
        if 0 <= i < len(bounds) and abs(bounds[i] - p) <= LONGEST_WORD:
            other = text[min(p, bounds[i]) : max(p, bounds[i])]
            figures = 0 <= j < len(words) and words[j].isdecimal() and other.isdecimal()
            ways = [(j + step, bounds[i], BESIDE_FIGURES if figures else 1), *ways, (j, bounds[i], 1)]
        best = (0, 0, 0)
        for word, place, least in ways:
            reached = _matched(words, text, word, place, step, MIN_WORDS)
            at = bisect_left(bounds, reached[2])
            if reached[0] > best[0] and min(run, reached[0]) >= least and (reached[0] >= WINDOW or (at < len(bounds) and bounds[at] == reached[2])):
                best = reached
        if not best[0]:
            return j - step, p
        run, j, p = best


_built: dict[str, Passages] = {}


def _passages(key: str, passages: list[tuple[int, str]]) -> Passages:
    """One automaton per Python worker, not one per task."""
    if key not in _built:
        _built.clear()
        _built[key] = Passages(passages)
    return _built[key]


COLUMNS = ["doc_id", "item_id", "first_word", "words", "char_from", "char_to"]


def leaks(documents: DataFrame, items: DataFrame, most_chars: int = MOST_PASSAGE_CHARS) -> DataFrame:
    """doc_id, item_id, first_word, words, char_from, char_to: each stretch of an item's passage found in a document.

    first_word counts the passage's words from 0; the characters are positions in the original text, half open. Null and
    empty texts and passages give nothing, passages of fewer than MIN_WORDS words neither; repeated documents give their
    rows again. Passages of more than most_chars together are dealt to several automata, each with a scan of its own; more
    than MOST_AUTOMATA are refused.
    """
    total = items.selectExpr("sum(length(passage)) as n").first()["n"] or 0
    parts = -(-total // most_chars) or 1
    if parts > MOST_AUTOMATA:
        raise ValueError(f"the passages have {total} characters; {MOST_AUTOMATA} automata hold {MOST_AUTOMATA * most_chars}")
    rows = sorted((r["item_id"], r["passage"]) for r in items.where("passage is not null").select("item_id", "passage").distinct().collect())
    kind = {f.name: f.dataType.simpleString() for f in [*documents.schema, *items.schema]}
    schema = f"doc_id {kind['doc_id']}, item_id {kind['item_id']}, first_word int, words int, char_from int, char_to int"
    texts = documents.select("doc_id", "text")
    return reduce(DataFrame.unionByName, [texts.mapInPandas(_scanner(documents.sparkSession, rows[i::parts]), schema) for i in range(parts)])


def _scanner(spark: SparkSession, rows: list[tuple[int, str]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    shared = spark.sparkContext.broadcast(rows)
    key = uuid.uuid4().hex

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        passages = _passages(key, shared.value)
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"].tolist(), pdf["text"].tolist(), strict=True):
                found = passages.stretches(text) if text else []
                if found:
                    place = offsets(text)
                    out.extend((doc_id, item, first, words, place[begin], place[end - 1] + 1) for item, first, words, begin, end in found)
            yield pd.DataFrame(out, columns=COLUMNS)

    return scan


def leaked(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id: the items each document gives away."""
    return leaks(documents, items).select("doc_id", "item_id").distinct()


def item_report(found: DataFrame) -> DataFrame:
    """item_id, documents, longest: in how many documents an item leaked, and its longest stretch in words."""
    return found.groupBy("item_id").agg({"doc_id": "count", "words": "max"}).toDF("item_id", "documents", "longest")
