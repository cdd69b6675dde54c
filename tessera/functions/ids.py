"""Deterministic ids and content hashes as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Separator of the parts of an id.
UNIT = "\x1f"


def stable_key(*parts: Column, length: int = 24) -> Column:
    """The first hex digits of the SHA-256 over the parts; a null part counts as empty."""
    return F.substring(F.sha2(F.concat_ws(UNIT, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, length)


def stable_id(prefix: str, *parts: Column, length: int = 24) -> Column:
    return F.concat(F.lit(f"{prefix}:"), stable_key(*parts, length=length))


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t.isascii() else unicodedata.normalize("NFC", t), na_action="ignore")


def loose_id(prefix: str, *parts: Column, length: int = 16) -> Column:
    """Like stable_id over parts in NFC and lower case with single blanks."""
    loose = [F.lower(F.trim(F.regexp_replace(_nfc(F.coalesce(p.cast("string"), F.lit(""))), r"\s+", " "))) for p in parts]
    return stable_id(prefix, *loose, length=length)


def content_hash(content: Column) -> Column:
    """sha256:<hex> of a text or binary column."""
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def slug(text: Column, length: int = 48, empty: str = "research") -> Column:
    """Lower case, runs of other characters as one hyphen."""
    cleaned = F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, length)
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit(empty))


def run_id(target: Column, as_of: Column) -> Column:
    """run:<slug>:<12 hex digits>."""
    digest = F.substring(F.sha2(F.concat_ws(UNIT, F.trim(target), as_of.cast("string")), 256), 1, 12)
    return F.concat(F.lit("run:"), slug(target), F.lit(":"), digest)
