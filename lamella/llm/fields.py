"""Reading hand-typed fields: site codes, image numbers, split names; and small plan helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def record_key(c: Column) -> Column:
    """Canonical form of a hand-typed value: lower case, punctuation and white space folded to one blank.

    Null stays null; a value without letters or digits becomes the empty string.
    """
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def site_codes(c: Column) -> Column:
    """All runs of exactly eight letters or digits in a hand-typed field, as an array (empty for null)."""
    words = F.split(record_key(c), " ")
    return F.coalesce(F.filter(words, lambda w: F.length(w) == 8), F.array().cast("array<string>"))


def image_number(c: Column) -> Column:
    """The number of a source image, e.g. 945 of ``src/IMG_000000945_full.TIFF``; null where none is given."""
    digits = F.regexp_extract(F.lower(c), r"img[^0-9a-z]*([0-9]{1,18})", 1)
    return F.when(digits != "", digits.cast("bigint"))


def split_name(c: Column) -> Column:
    """train, val or test from a hand-typed split; null for a missing or unknown one. Held-out counts as test."""
    k = record_key(c)
    return (
        F.when(k.isin("train", "training"), "train")
        .when(k.isin("val", "validation", "valid", "dev"), "val")
        .when(k.isin("test", "testing", "held out", "heldout", "holdout"), "test")
    )


def fraction(c: Column) -> Column:
    """A rate as a fraction: values over 1 are percent; NaN counts as null."""
    c = F.when(~F.isnan(c), c)
    return F.when(c > 1, c / 100).otherwise(c)
