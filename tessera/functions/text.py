"""Words, tokens, numbers and question classes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no evidence.
STOP_WORDS = "the a an of to and or in on for with by is was are were".split()
#: The classes of questions in order of precedence, with the pattern that tells them.
QUESTION_CLASSES = (
    ("evidence-gap", r"\b(missing|gap|unsupported|insufficient evidence|unknown)\b"),
    ("temporal", r"\b(when|as of|at the time|before|after|historical|changed|latest|current)\b"),
    ("causal-event", r"\b(cause|caused|causal|led to|triggered|why did|what led)\b"),
    ("comparative", r"\b(compare|versus|vs\.?|difference|similarities)\b"),
    ("multi-hop-path", r"\b(path|connected|relationship between|how .* relate)\b"),
    ("global-theme", r"\b(theme|overview|landscape|big picture|cluster|community|trend)\b"),
)


def tokens(text: Column) -> Column:
    """Index tokens: runs of ASCII letters, digits, underscores, colons and hyphens, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_:-]+"), F.lit(0))


def words(text: Column) -> Column:
    """The set of a text's words without stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda w: ~w.isin(STOP_WORDS)))


def numbers(text: Column) -> Column:
    """The set of a text's numbers, decimal commas as points; a percent sign stays part of the number."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?<![A-Za-z])[-+]?\d+(?:[.,]\d+)?%?"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda n: F.replace(n, F.lit(","), F.lit("."))))


def classify_question(question: Column, entities: Column | None = None, existing_graph: bool = True) -> Column:
    """The class of a question: the first pattern that matches; two linked entities make a path, one a neighbourhood."""
    n = F.lit(0) if entities is None else F.coalesce(entities, F.lit(0))
    text = F.lower(F.coalesce(question, F.lit("")))
    out = None
    for name, pattern in QUESTION_CLASSES:
        hit = text.rlike(pattern)
        if name == "multi-hop-path":
            hit = hit | (n >= 2)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.when(n == 1, "entity-local").otherwise("direct" if existing_graph else "entity-local")


def token_estimate(text: Column) -> Column:
    """Model tokens of a text, estimated as four thirds of its words, at least 1."""
    n = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))
    return F.greatest(F.lit(1), F.floor(n * 4 / 3).cast("int"))
