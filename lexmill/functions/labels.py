"""Delivered language labels, whatever their notation."""

from __future__ import annotations

from pyspark.sql import functions as F

# The notations of each language.
NAMES = {
    "en": ("en", "eng", "english"), "de": ("de", "deu", "ger", "german"), "fr": ("fr", "fra", "fre", "french"),
    "es": ("es", "spa", "spanish"), "it": ("it", "ita", "italian"), "nl": ("nl", "nld", "dut", "dutch"), "none": ("la", "lat", "latin"),
}
UNKNOWN = ("", "unknown", "und", "n/a", "null", "none")


def normal_label(c):
    """Label column as a key of NAMES ('none' for made-up Latin), another code, or null if it says nothing."""
    c = F.regexp_replace(F.lower(F.trim(c)), "^__label__", "")
    c = F.when(c.isin(*UNKNOWN), None).otherwise(F.regexp_replace(c, "[-_].*$", ""))
    out = c
    for code, names in NAMES.items():
        out = F.when(c.isin(*names), code).otherwise(out)
    return out
