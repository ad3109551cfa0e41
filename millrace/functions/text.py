"""Scalar text functions: columns to columns, inside generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The missing-value tokens of each kind of table.
FILLED_EMPTY = ("", "nan", "none")
DATASET_EMPTY = ("", "nan", "none", "null", "na", "n/a", "not_reported", "not reported", "not-report", "unknown")
VESSEL_EMPTY = (*DATASET_EMPTY, "unspecified", "not specified", "-", "--")
STIRRING_EMPTY = (*VESSEL_EMPTY, "<na>", "n.a.", "nr")
NEGATIVE_EMPTY = ("none", "null", "nan", "")
FIGURE_EMPTY = ("", "nan", "none", "null", "n/a", "na")

_CURLY, _PLAIN = "′’‘“”–—", "'''\"\"--"


def is_filled(text: Column, empty: Sequence[str] = FILLED_EMPTY) -> Column:
    """Neither null nor, trimmed and in lower case, one of the tokens."""
    return F.coalesce(~F.lower(F.trim(text)).isin(*empty), F.lit(False))


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def clean_text(text: Column, empty: Sequence[str] = DATASET_EMPTY) -> Column:
    """Plain quotes and dashes, no outer quotes, single spaces; a missing token becomes null."""
    plain = F.translate(F.trim(text), _CURLY, _PLAIN)
    inner = F.regexp_replace(F.regexp_replace(plain, '^"+|"+$', ""), "^'+|'+$", "")
    out = squeeze(inner)
    return F.when(~F.lower(out).isin(*empty), out)


def key_text(text: Column) -> Column:
    """clean_text in lower case, with the middle dot as a full stop."""
    out = squeeze(F.translate(F.lower(clean_text(text)), "·", "."))
    return F.when(out != "", out)


def normalize_doi(text: Column) -> Column:
    """A DOI from a link, a prefixed DOI or a PDF file name; null if there is none."""
    low = F.lower(clean_text(text))
    bare = F.regexp_replace(F.regexp_replace(low, r"^https?://(dx\.)?doi\.org/", ""), r"^doi:\s*", "")
    base = F.when(bare.endswith(".pdf"), F.element_at(F.split(bare, r"[\\/](?!.*[\\/])"), -1)).otherwise(bare)
    named = F.regexp_extract(base, r"10\.\d{4,9}[/_][^\s\\]+", 0)
    stem = F.regexp_replace(named, r"(?:_si)?\.pdf$", "")
    out = F.regexp_replace(stem, r"^(10\.\d{4,9})_", "$1/")
    return F.when(out != "", out)


def doi_stem(doi: Column) -> Column:
    """The file stem of a DOI: its slash as an underscore."""
    return F.replace(doi, F.lit("/"), F.lit("_"))


def doi_file(doi: Column, extension: str = "pdf") -> Column:
    return F.concat(doi_stem(doi), F.lit("." + extension))


def doi_url_decoded(text: Column) -> Column:
    """normalize_doi after percent-decoding."""
    return normalize_doi(F.try_url_decode(text))


def without_trailing_parenthesis(text: Column) -> Column:
    """A last "(...)" goes, unless it says anhydrous; one that holds a formula replaces the text."""
    inner = F.regexp_extract(text, r"\(([^()]*)\)\s*$", 1)
    outer = F.trim(F.regexp_replace(text, r"\s*\([^()]*\)\s*$", ""))
    formula = inner.rlike(r"^(?=.*\d)(?:[A-Z][a-z]?\d*)+$")
    return F.when(inner == "", text).when(F.lower(inner) == "anhydrous", text).when(formula, inner).otherwise(outer)


def dot_for_times(text: Column) -> Column:
    return F.translate(text, "×", "·")


def digits_only(text: Column) -> Column:
    """The digits of a deposit number, null without any."""
    out = F.regexp_replace(text, "[^0-9]", "")
    return F.when(out != "", out)


def one_line(text: Column) -> Column:
    """Control and zero-width characters go; line breaks become the two characters \\n."""
    plain = F.regexp_replace(text, "[\\u200B-\\u200D\\u2060\\uFEFF]", "")
    broken = F.regexp_replace(plain, "\r\n|\r|\n", "\\\\n")
    return F.trim(F.regexp_replace(F.translate(broken, "\t", " "), r"\p{Cntrl}", ""))


def path_slug(text: Column, most: int = 120) -> Column:
    """Letters, digits, dot and dash; all else as one underscore."""
    return F.substring(F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9.\-]+", "_"), "^_+|_+$", ""), 1, most)


def safe_truncate(text: Column, most: int = 400_000) -> Column:
    return F.substring(text, 1, most)


def split_alternatives(text: Column) -> Column:
    """Alternatives parted by | or |||, trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(text, r"\s*\|{1,3}\s*"), lambda x: F.trim(x)), lambda x: x != "")


def normalized_category(text: Column) -> Column:
    """Parts joined by "and", sorted."""
    return F.array_join(F.array_sort(F.transform(F.split(F.lower(F.trim(text)), r"\s+and\s+"), lambda x: F.trim(x))), " and ")


def yes_no(text: Column) -> Column:
    """Truthy and falsy words as yes and no, all else as not_reported."""
    low = F.lower(F.trim(text))
    return F.when(low.isin("yes", "y", "true", "1", "stable"), "yes").when(low.isin("no", "n", "false", "0", "unstable"), "no").otherwise("not_reported")


def word_count(text: Column) -> Column:
    """Runs of Unicode word characters."""
    return F.size(F.regexp_extract_all(text, F.lit(r"(?U)\w+"), F.lit(0))).cast("bigint")


def redact_secrets(text: Column) -> Column:
    return F.regexp_replace(text, r"sk-[A-Za-z0-9_\-]{8,}", "[redacted]")


def article_for(word: Column) -> Column:
    """The indefinite article by the first letter."""
    return F.when(F.lower(F.substring(F.trim(word), 1, 1)).isin("a", "e", "i", "o", "u"), "an").otherwise("a")


def split_tags(text: Column) -> Column:
    """Tags parted by ; , / or the word and."""
    return F.filter(F.transform(F.split(text, r"\s*[;,/]\s*|\s+and\s+"), lambda x: F.trim(x)), lambda x: x != "")


def varied_classes(text: Column, known: Sequence[str]) -> Column:
    """Which of the known classes a list parted by ; , or | names, in the known order."""
    named = F.transform(F.split(F.lower(text), r"[;,|]"), lambda x: F.trim(x))
    return F.filter(F.array(*map(F.lit, known)), lambda c: F.array_contains(named, c))


def display_value(name: Column, short: Column, both: bool = False) -> Column:
    """The cleaned name, else the short form; if both, "name (short)" where the name doesn't hold it."""
    a, b = clean_text(name), clean_text(short)
    single = F.coalesce(a, b)
    if not both:
        return single
    return F.when(a.isNotNull() & b.isNotNull() & ~F.contains(F.lower(a), F.lower(b)), F.concat(a, F.lit(" ("), b, F.lit(")"))).otherwise(single)


def distinct_in_order(values: Column) -> Column:
    """Cleaned values, the first of those with equal keys."""
    cleaned = F.filter(F.transform(values, lambda v: clean_text(v)), lambda v: v.isNotNull())
    keys = F.transform(cleaned, lambda v: key_text(v))
    return F.filter(cleaned, lambda v, i: F.array_position(keys, F.get(keys, i)) == i + 1)


def join_with_and(values: Column) -> Column:
    kept = distinct_in_order(values)
    return F.when(F.size(kept) > 0, F.array_join(kept, " and "))


def set_key(values: Column) -> Column:
    """Keys of the values, distinct and sorted, joined by " + "; "unknown" if there are none."""
    keys = F.array_sort(F.array_distinct(F.filter(F.transform(values, lambda v: key_text(v)), lambda v: v.isNotNull())))
    return F.when(F.size(keys) > 0, F.array_join(keys, " + ")).otherwise("unknown")


def cluster_key(**parts: Column) -> Column:
    """name=value pairs in the order given, joined by |."""
    return F.concat_ws("|", *(F.concat(F.lit(f"{name}="), F.coalesce(value, F.lit("unknown"))) for name, value in parts.items()))
