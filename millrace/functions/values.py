"""Reported values compared with accepted ones: names, quantities, alternatives, anchors and label probabilities.

What needs Unicode folding or alignment of texts works on Arrow batches of columns; everything else is column expressions.
"""

from __future__ import annotations

import difflib
import math
import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType

# What stands for no value, and for a reference that is not settled.
ABSENT = ("", "__absent__", "no hard value reported", "empty", "none", "null", "nan", "na", "n/a", "not reported", "not_reported")
UNKNOWN = ("__UNKNOWN__", "UNKNOWN", "UNRESOLVED")
# Units by dimension and their size.
UNITS = {
    "mol": ("mol", 1.0), "mmol": ("mol", 1e-3), "umol": ("mol", 1e-6), "nmol": ("mol", 1e-9), "kg": ("g", 1e3), "g": ("g", 1.0), "mg": ("g", 1e-3), "ug": ("g", 1e-6),
    "l": ("mL", 1e3), "ml": ("mL", 1.0), "ul": ("mL", 1e-3), "cm3": ("mL", 1.0), "d": ("h", 24.0), "day": ("h", 24.0), "days": ("h", 24.0), "h": ("h", 1.0), "hr": ("h", 1.0),
    "hrs": ("h", 1.0), "hour": ("h", 1.0), "hours": ("h", 1.0), "min": ("h", 1 / 60), "mins": ("h", 1 / 60), "minute": ("h", 1 / 60), "minutes": ("h", 1 / 60),
    "s": ("h", 1 / 3600), "sec": ("h", 1 / 3600), "seconds": ("h", 1 / 3600),
}
#: The shortest run of letters that names one thing within a longer name.
LEAST_RUN = 8
_NUMBER = r"[-+]?\d+(?:\.\d+)?(?:e[-+]?\d+)?"
_QUANTITY = re.compile(rf"(?<![\w.])({_NUMBER})\s*({'|'.join(sorted(UNITS, key=len, reverse=True))})\b")
_CODE = re.compile(r"(?<![A-Za-z0-9])[A-Z]{1,5}-\d+[A-Za-z]{0,2}(?![A-Za-z0-9])")


def fold(text: str | None) -> str:
    """Compatibility forms, case, primes, dashes and micro signs folded; single spaces."""
    plain = unicodedata.normalize("NFKC", text or "").casefold().translate(str.maketrans("µμ′’‘–−‐", "uu'''---"))
    return " ".join(plain.split())


@F.pandas_udf(StringType())
def folded_text(text: pd.Series) -> pd.Series:
    return text.map(fold, na_action="ignore")


def alternatives(value: str | None, more: Sequence[str] = ()) -> tuple[list[str], bool]:
    """The accepted values, and whether a missing value is accepted too; neither for references that are not settled."""
    if (value or "").strip().upper() in UNKNOWN:
        return [], False
    parts = [p.strip() for v in (value, *more) for p in re.split(r"\s*\|\|\|\s*|\s+\|\s+", v or "")]
    named = list(dict.fromkeys(p for p in parts if fold(p) not in ABSENT))
    return named, not named or any(p and fold(p) in ABSENT for p in parts)


def quantities(value: str | None, kind: str = "") -> dict[str, tuple[float, ...]]:
    """Amounts by dimension. kind: C, h or m2/g say what a bare number is; ranges keep their order and are ascending."""
    text = fold(value).replace(",", "")
    bare = re.fullmatch(_NUMBER, text)
    if bare:
        return {kind or "number": (float(text),)} if math.isfinite(float(text)) else {}
    degree = lambda v, u: v if u == "c" else v - 273.15 if u == "k" else (v - 32) * 5 / 9
    if kind == "C":
        unit = r"(?:°\s*|deg(?:rees?)?\.?\s*)?([ckf])"
        if m := re.fullmatch(rf"({_NUMBER})\s*{unit}", text):
            return {"C": (degree(float(m[1]), m[2]),)}
        if m := re.fullmatch(rf"({_NUMBER})\s*(?:{unit})?\s*(?:-|to)\s*({_NUMBER})\s*(?:{unit})?", text):
            ends = tuple(degree(float(v), u) for v, u in ((m[1], m[2] or m[4] or "c"), (m[3], m[4] or m[2] or "c")))
            return {"C range": ends} if ends[0] <= ends[1] else {}
        return {}
    if kind == "m2/g":
        m = re.fullmatch(rf"({_NUMBER})\s*m\s*\^?2\s*/?\s*g(?:\s*\^?-?1)?", text)
        return {"m2/g": (float(m[1]),)} if m else {}
    times = "|".join(sorted((u for u, (d, _) in UNITS.items() if d == "h"), key=len, reverse=True))
    if kind == "h" and (m := re.fullmatch(rf"({_NUMBER})\s*({times})?\s*(?:-|to)\s*({_NUMBER})\s*({times})?", text)):
        ends = tuple(float(v) * UNITS[u][1] for v, u in ((m[1], m[2] or m[4] or "h"), (m[3], m[4] or m[2] or "h")))
        return {"h range": ends} if ends[0] <= ends[1] else {}
    rest = _QUANTITY.sub("", text)
    # stages, ratios and concentrations are more than one number
    if rest.strip(" ,;()[]") not in ("", "approximately", "about", "~", "≈"):
        return {}
    out: dict[str, tuple[float, ...]] = {}
    for number, unit in _QUANTITY.findall(text):
        dimension, size = UNITS[unit]
        out[dimension] = (*out.get(dimension, ()), float(number) * size)
    return out


def same_quantity(a: str | None, b: str | None, kind: str = "", tolerance: float = 1e-6) -> bool:
    """Every dimension that both state agrees; there is one at least. Durations and temperatures keep their order."""
    x, y = quantities(a, kind), quantities(b, kind)
    arranged = (lambda v: v) if kind in ("C", "h") else sorted
    close = lambda u, v: len(u) == len(v) and all(math.isclose(p, q, rel_tol=tolerance, abs_tol=1e-9) for p, q in zip(arranged(u), arranged(v), strict=True))
    shared = x.keys() & y.keys()
    return bool(shared) and all(close(x[d], y[d]) for d in shared)


def value_agrees(value: str | None, reference: str | None, kind: str = "", aliases: dict[str, str] | None = None, more: Sequence[str] = ()) -> bool:
    """Whether a reported value is an accepted one. kind: name, C, h, m2/g, id or empty."""
    accepted, missing_too = alternatives(reference, more)
    if fold(value) in ABSENT:
        return missing_too and (reference or "").strip().upper() not in UNKNOWN
    called = lambda v: (aliases or {}).get(fold(v), fold(v))
    warm = re.compile(r"r\.?\s*t\.?|room[ -]temperature")
    for wanted in accepted:
        if called(value) == called(wanted) if kind == "name" else fold(value) == fold(wanted):
            return True
        if kind == "C" and warm.fullmatch(fold(value)) and warm.fullmatch(fold(wanted)):
            return True
        if kind == "id" and quantities(value) and quantities(value) == quantities(wanted):
            return True
        if kind not in ("name", "id") and same_quantity(value, wanted, kind):
            return True
    return False


def agrees(value: Column, reference: Column, kind: str = "", aliases: dict[str, str] | None = None) -> Column:
    @F.pandas_udf("boolean")
    def each(a: pd.Series, b: pd.Series) -> pd.Series:
        text = lambda v: None if v is None or v != v else v
        return pd.Series([value_agrees(text(x), text(y), kind, aliases) for x, y in zip(a, b, strict=True)], dtype=bool)

    return each(value.cast("string"), reference.cast("string"))


def name_runs(name: str | None) -> list[tuple[str, bool]]:
    """(token, whether within brackets) of a name; commas and hyphens inside a token are part of it."""
    out, depth = [], 0
    for piece in re.split(r"(\s+|[()\[\]{}]|,\s)", unicodedata.normalize("NFKD", name or "").lower()):
        depth = max(0, depth + (piece in "([{" and piece != "") - (piece in ")]}" and piece != ""))
        if token := re.sub("[^a-z0-9]", "", piece):
            out.append((token, depth > 0))
    return out


def names_match(a: str | None, b: str | None) -> bool:
    """One name within the other as whole tokens: long enough, or all that is left over stands in brackets. Or both have
    the same code (such as GU-3) and share a long word."""
    few, many = sorted((name_runs(a), name_runs(b)), key=len)
    run = [t for t, _ in few]
    for i in range(len(many) - len(run) + 1 if run else 0):
        if [t for t, _ in many[i : i + len(run)]] == run and (len("".join(run)) >= LEAST_RUN or all(inner for _, inner in many[:i] + many[i + len(run) :])):
            return True
    codes = [{c.lower() for c in _CODE.findall(x or "")} for x in (a, b)]
    words = [set(re.findall("[a-z]{6,}", (x or "").lower())) for x in (a, b)]
    return bool(codes[0]) and codes[0] == codes[1] and bool(words[0] & words[1])


@F.pandas_udf(BooleanType())
def loosely_same(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([names_match(x or None, y or None) for x, y in zip(a.fillna(""), b.fillna(""), strict=True)], dtype=bool)


@F.pandas_udf(DoubleType())
def name_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of aligned letters and digits of two names; 0 if either is empty."""
    key = lambda v: re.sub(r"[\W_]+", "", fold(v))
    pairs = zip(a.fillna("").map(key), b.fillna("").map(key), strict=True)
    return pd.Series([difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() if x and y else 0.0 for x, y in pairs], dtype=float)


def anchor_value(value: Column, parent: Column, numeric: bool, strict: bool = False) -> Column:
    """What a rule is to see: a blank number is the parent's, unless an explicit one is asked for."""
    blank = F.coalesce(F.lower(F.trim(value)).isin("", "none", "null", "nan"), F.lit(True))
    return F.when(~blank, value).otherwise(parent if numeric and not strict else F.lit(None).cast("string"))


def in_unit(value: Column, unit: Column, wanted: Column) -> Column:
    """A number in another unit of the same dimension; null where the dimensions differ."""
    table = lambda k: F.create_map(*(F.lit(x) for u, v in UNITS.items() for x in (u, v[k])))
    key = lambda u: F.lower(F.translate(F.trim(u), "µμ", "uu"))
    same = table(0)[key(unit)] == table(0)[key(wanted)]
    return F.when(same, value * table(1)[key(unit)] / table(1)[key(wanted)]).when(key(unit) == key(wanted), value)


def label_logprobs(tokens: Column, chosen: Column, labels: Sequence[str] = ("P", "N")) -> Column:
    """struct(one log-probability for each label, chosen_is_argmax) from array<struct<token, logprob, top_logprobs>>.

    They are read at the first token that is the chosen label, else at the first that is any label.
    """
    said = lambda t: F.upper(F.regexp_replace(t["token"], r"\s+", ""))
    any_label = F.filter(tokens, lambda t: said(t).isin(*labels))
    at = F.coalesce(F.get(F.filter(any_label, lambda t: said(t) == chosen), F.lit(0)), F.get(any_label, F.lit(0)))
    beside = F.coalesce(at["top_logprobs"], F.array().cast("array<struct<token:string,logprob:double>>"))

    def of(label: str) -> Column:
        alternative = F.get(F.transform(F.filter(beside, lambda t: (said(t) == label) & t["logprob"].isNotNull()), lambda t: t["logprob"].cast("double")), F.lit(0))
        return F.coalesce(F.when(said(at) == label, at["logprob"].cast("double")), alternative)

    most = F.greatest(*(of(x) for x in labels))
    complete = sum((of(x).isNull().cast("int") for x in labels[1:]), of(labels[0]).isNull().cast("int")) == 0
    own = F.coalesce(*(F.when(chosen == x, of(x)) for x in labels))
    return F.struct(*(of(x).alias(f"logprob_{x}") for x in labels), F.when(complete, own >= most).alias("chosen_is_argmax"))
