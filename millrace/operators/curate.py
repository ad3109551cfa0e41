"""Stages that curate extracted synthesis records: metals, linkers, solvents, temperatures, topologies; and their counts."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from millrace.functions import classes, formulas, precursors
from millrace.functions.numbers import finite
from millrace.functions.text import is_filled
from millrace.operators.dedup import prune_singletons
from millrace.operators.joins import small

Stage = tuple[str, Callable[[DataFrame], DataFrame]]


def run_stages(df: DataFrame, stages: Sequence[Stage]) -> tuple[DataFrame, list[dict]]:
    """The rows after all stages, and for each stage its rows before and after."""
    counts, before = [], df.count()
    for name, stage in stages:
        df = stage(df)
        after = df.count()
        counts.append({"stage": name, "before": before, "after": after, "dropped": before - after})
        before = after
    return df, counts


def stage_counts(stages: Sequence[tuple[str, DataFrame]], label: str) -> DataFrame:
    """(stage, label, n, dropped) of tables that follow one another: n rows of each label, and how many fewer than before."""
    out = None
    for k, (name, df) in enumerate(stages):
        rows = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n")).select(F.lit(k).alias("at"), F.lit(name).alias("stage"), "label", "n")
        out = rows if out is None else out.unionByName(rows)
    later = out.select((F.col("at") - 1).alias("at"), F.col("label").alias("l2"), F.col("n").alias("m"))
    last = len(stages) - 1
    joined = out.join(later.withColumnRenamed("at", "a2"), (F.col("at") == F.col("a2")) & F.col("label").eqNullSafe(F.col("l2")), "left")
    lost = F.when(F.col("at") < last, F.col("n") - F.coalesce("m", F.lit(0))).otherwise(0)
    return joined.select("stage", "label", "n", lost.alias("lost_next"))


def keep_any(*texts: Column) -> Column:
    """Whether one of the fields is filled."""
    out = F.lit(False)
    for t in texts:
        out = out | is_filled(t)
    return out


def with_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select("*", *(F.lit("").alias(n) for n in names if n not in df.columns))


def six_digits(number: Column) -> Column:
    """A number with six significant digits, as text without trailing zeros."""
    places = F.lit(5) - F.floor(F.log10(F.abs(number)))
    rounded = F.when(number == 0, F.lit(0.0)).otherwise(F.bround(number * F.pow(F.lit(10.0), places)) / F.pow(F.lit(10.0), places))
    plain = F.regexp_replace(F.regexp_replace(F.format_string("%.12f", rounded), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(number.isNotNull(), plain)


def clean_metals(df: DataFrame, slots: Sequence[str] = ("metal_1", "metal_2", "metal_3")) -> DataFrame:
    """One formula for each metal, the first one's amount in mmol where it can be told, and only rows that name a salt.

    Rows go without any amount, with a framework, cluster, salt or acid for a metal, without a formula, with a short
    formula that no other row has, and with a unit that is no amount unless the text has a ratio.
    """
    text, value, unit = (f"metal_1_amount_{k}" for k in ("text", "value", "unit"))
    slots = [s for s in slots if s in df.columns]
    df = with_columns(df, [text, value, unit]).filter(keep_any(F.col(text), F.col(value), F.col(unit)))
    said = F.regexp_extract_all(F.translate(F.col(text), "µμ", "uu"), F.lit(r"(?i)(\d+(?:\.\d+)?\s*(?:umol|mmol|mol))\b"), F.lit(1))
    last = F.element_at(said, -1)
    some = F.size(said) > 0
    df = df.withColumns({value: F.when(some, F.regexp_extract(last, r"^([\d.]+)", 1)).otherwise(F.col(value)), unit: F.when(some, F.lower(F.regexp_extract(last, r"([A-Za-z]+)$", 1))).otherwise(F.col(unit))})
    for s in slots:
        df = precursors.with_precursor(df, s, "_formula").withColumn(s, F.col("_formula")).drop("_formula")
    df = formulas.with_molar_mass(df, "metal_1", "_mass")
    number, u = finite(F.trim(F.col(value)).try_cast("double")), F.lower(F.translate(F.trim(F.col(unit)), "µμ", "uu"))
    grams = F.when(u == "g", number).when(u == "mg", number / 1000)
    mmol = F.when(u == "mol", number * 1000).when(u == "mmol", number).when(u == "umol", number / 1000).otherwise(F.when(F.col("_mass") > 0, grams / F.col("_mass") * 1000))
    df = df.withColumns({value: F.coalesce(six_digits(mmol), F.col(value)), unit: F.when(mmol.isNotNull(), "mmol").otherwise(F.col(unit))}).drop("_mass")
    df = df.filter(~precursors.denied(*(F.col(s) for s in slots)) & is_filled(F.col("metal_1")) & precursors.compliant(F.col("metal_1")))
    short = df.withColumn("_plain", F.when((F.length(F.trim("metal_1")) <= 10) & ~F.col("metal_1").rlike(r"[()]"), F.trim("metal_1")))
    counted = short.filter("_plain IS NOT NULL").groupBy("_plain").agg(F.count("*").alias("_n")).filter("_n = 1").select(F.col("_plain").alias("_once"))
    df = short.join(small(counted), F.col("_plain") == F.col("_once"), "left_anti").drop("_plain")
    odd = ~is_filled(F.col(unit)) | F.col(unit).isin("mL", "mM")
    return df.filter(~odd | F.coalesce(F.col(text).rlike(r"(?i)\beq\b|\bmolar\b|\bratio\b|:"), F.lit(False)))


def clean_linkers(df: DataFrame, weights: DataFrame, mapped: dict[str, str] | None = None, unwanted: Sequence[str] = ()) -> DataFrame:
    """Linkers by one name, their amount in mmol by a table (name, g_per_mol); adds linker_reason.

    Rows without any amount go, so do linkers that are no name, and units other than mmol, eq and equiv.
    """
    text, value, unit = (f"linker_1_amount_{k}" for k in ("text", "value", "unit"))
    df = with_columns(df, [text, value, unit, "linker_1"]).filter(keep_any(F.col(text), F.col(value), F.col(unit)))
    df = df.withColumn("_d", classes.linker_decision(F.col("linker_1"), mapped, unwanted)).withColumns({"linker_1": F.col("_d.name"), "linker_reason": F.col("_d.reason")}).drop("_d")
    df = df.filter(F.col("linker_reason").isin("mapped", "kept", "keep_empty"))
    table = weights.select(F.lower(F.trim("name")).alias("_name"), finite(F.col("g_per_mol").cast("string").try_cast("double")).alias("_w")).filter("_w IS NOT NULL").groupBy("_name").agg(F.max("_w").alias("_w"))
    df = df.join(small(table), F.lower(F.trim("linker_1")) == F.col("_name"), "left")
    number, u = F.trim(F.col(value)).try_cast("double"), F.lower(F.translate(F.trim(F.col(unit)), "µμ", "uu"))
    grams = F.when(u.isin("g", "gram", "grams"), number).when(u.isin("mg", "milligram", "milligrams"), number / 1000)
    mmol = F.when(u == "umol", number / 1000).when(u == "mol", number * 1000).otherwise(F.when(F.col("_w") > 0, grams * 1000 / F.col("_w")))
    df = df.withColumns({value: F.coalesce(six_digits(mmol), F.col(value)), unit: F.when(mmol.isNotNull(), "mmol").otherwise(F.col(unit))}).drop("_name", "_w")
    u = F.lower(F.trim(F.col(unit)))
    return df.filter((u == "mmol") | u.contains("equiv") | (u == "eq"))


# Densities in g/mL of solvents that are given by mass.
DENSITY = {"H2O": 1.0, "EtOH": 0.789, "DMF": 0.944}
_NUM = r"(\d+(?:\.\d+)?(?:/\d+)?)"
_ML = re.compile(rf"{_NUM}\s*mL", re.I)
_MIX = re.compile(r"([A-Za-z0-9\-()]+)\s*/\s*([A-Za-z0-9\-()]+)\s*\(([^)]*)\)")
_SHARES = re.compile(rf"([A-Za-z0-9\-()]+)\s*[:/]\s*([A-Za-z0-9\-()]+)\s*=\s*{_NUM}\s*:\s*{_NUM}.*?(?:total(?:\s*volume)?|in\s*total)\s*[:=]?\s*{_NUM}\s*mL", re.I | re.S)
#: How far a volume may stand from the solvent it belongs to, in characters.
NEAR = 40


def _float(text: str) -> float:
    top, _, bottom = text.partition("/")
    return float(top) / float(bottom) if bottom and float(bottom) else float(top)


class AmountText:
    """A text of amounts, read for one solvent: where its names, volumes and masses stand."""

    def __init__(self, text: str, short: str) -> None:
        canonical = next((s for s in classes.SOLVENTS if s.upper() == short.strip().upper()), None)
        names = classes.SOLVENTS[canonical][1] if canonical else (short.strip(),)
        self.density, self.water = DENSITY.get(canonical or ""), canonical == "H2O"
        self.text = text
        self.name = re.compile(rf"(?<![A-Za-z0-9])(?:{'|'.join(map(re.escape, names))})(?![A-Za-z0-9])", re.I) if short.strip() else re.compile(r"(?!)")
        self.volumes = [(m.start(), m.end(), _float(m[1])) for m in _ML.finditer(text)]
        self.mentions = [m.end() for m in self.name.finditer(text)]

    def _share(self, left: str, right: str, a: float, b: float, volume: float) -> float:
        is_left, is_right = bool(self.name.search(left)), bool(self.name.search(right))
        return 0.0 if is_left == is_right else volume * (a if is_left else b) / (a + b)

    def mixtures(self) -> tuple[float, float]:
        """(volume of the solvent in mixtures such as A/B (1:2, 30 mL), volume of all mixtures)"""
        own = every = 0.0
        for left, right, inner in _MIX.findall(self.text):
            volume = _ML.search(inner)
            if volume:
                ratio = re.search(rf"{_NUM}\s*:\s*{_NUM}", inner)
                a, b = (_float(x) or 1.0 for x in ratio.groups()) if ratio else (1.0, 1.0)
                every += _float(volume[1])
                own += self._share(left, right, a, b, _float(volume[1]))
        return own, every

    def added(self) -> float:
        """All volumes of a sum; mixtures count with the solvent's share."""
        own, every = self.mixtures()
        return sum(v for *_, v in self.volumes) - every + own if "+" in self.text and len(self.volumes) > 1 else 0.0

    def shared(self) -> float:
        """The solvent's part of a total volume in a stated ratio."""
        return sum(self._share(x, y, _float(a) or 1.0, _float(b) or 1.0, _float(v)) for x, y, a, b, v in _SHARES.findall(self.text))

    def beside(self) -> float:
        """Volumes right before or after the solvent, each once."""
        taken = {(s, v) for s, e, v in self.volumes if self.name.search(self.text[e : e + NEAR])}
        for at in self.mentions:
            taken |= {(s, v) for s, e, v in self.volumes if at <= s and e <= at + NEAR and not any(at <= s2 < s for s2, *_ in self.volumes)}
        return sum(v for _, v in taken)

    def weighed(self) -> float:
        """A mass beside the solvent, by its density."""
        masses = [(m.start(), m.end(), _float(m[1]) / (1000 if m[2].lower() == "mg" else 1)) for m in re.finditer(rf"{_NUM}\s*(g|mg)\b", self.text, re.I)]
        before = [g for _, e, g in masses if self.name.search(self.text[e : e + NEAR])]
        after = [g for at in self.mentions for s, e, g in masses if at <= s and e <= at + NEAR]
        return (before + after)[0] / self.density if self.density and before + after else 0.0

    def close_to_water(self) -> float:
        m = re.search(rf"H2O[^\d]{{0,15}}{_NUM}\s*mL|{_NUM}\s*mL[^\d]{{0,15}}H2O", self.text, re.I) if self.water else None
        return _float(m[1] or m[2]) if m else 0.0

    def read(self) -> tuple[float | None, str]:
        """The first reading that gives a volume, and which one it was."""
        for rule, reading in (("sum", self.added), ("ratio", self.shared), ("beside", self.beside), ("mixture", lambda: self.mixtures()[0]), ("mass", self.weighed), ("water", self.close_to_water)):
            if (ml := reading()) > 0:
                return ml, rule
        return None, ""


@F.pandas_udf(StructType().add("ml", DoubleType()).add("rule", StringType()))
def solvent_volume(text: pd.Series, short: pd.Series) -> pd.DataFrame:
    """The main solvent's volume in a text of amounts, in mL."""
    return pd.DataFrame([AmountText(t, s).read() if t.strip() else (None, "") for t, s in zip(text.fillna(""), short.fillna(""), strict=True)], columns=["ml", "rule"])


def clean_solvents(df: DataFrame) -> DataFrame:
    """Solvents by their canonical pair, and the main one's volume from its text where it is not given; adds solvent_rule.

    Rows without short form, text and volume go.
    """
    df = with_columns(df, [f"solvent_{k}{e}" for k in ("main", "secondary") for e in ("", "_abbr")] + ["solvent_main_amount_text", "solvent_main_ml"])
    for k in ("main", "secondary"):
        pair = classes.solvent_pair(F.col(f"solvent_{k}"), F.col(f"solvent_{k}_abbr"))
        df = df.withColumn("_p", pair).withColumns({f"solvent_{k}": F.col("_p.name"), f"solvent_{k}_abbr": F.col("_p.short")}).drop("_p")
    text, ml = F.col("solvent_main_amount_text"), F.col("solvent_main_ml")
    wanted = is_filled(text) & ~is_filled(ml)
    known = df.filter(wanted).select(text.alias("_t"), F.col("solvent_main_abbr").alias("_a")).distinct().withColumn("_v", solvent_volume("_t", "_a"))  # once for each text
    df = df.join(known, wanted & (text == F.col("_t")) & (F.col("solvent_main_abbr") == F.col("_a")), "left")
    df = df.withColumns({"solvent_main_ml": F.coalesce(six_digits(F.col("_v.ml")), ml), "solvent_rule": F.coalesce(F.col("_v.rule"), F.lit(""))}).drop("_t", "_a", "_v")
    return df.filter(keep_any(F.col("solvent_main_abbr"), text, ml))


def clean_temperatures(df: DataFrame, positive: bool = True) -> DataFrame:
    """Room temperature is 25 C; rows by microwave, evaporation or slow growth go, and rows without a temperature.

    Positive records go for the word part slow, negative ones for slow evaporation and diffusion only.
    """
    df = with_columns(df, ["temperature_c", "temperature_c_text"])
    text = F.coalesce("temperature_c_text", F.lit(""))
    room = ~is_filled(F.col("temperature_c")) & text.rlike(r"\bRT\b|(?i:room temperature)")
    out = text.rlike(r"(?i)microwave|evaporation|slow" if positive else r"(?i)\bmicrowave\b|\bevaporation\b|\bslow diffusion\b")
    df = df.withColumn("temperature_c", F.when(room, "25").otherwise(F.col("temperature_c"))).filter(~out)
    return df.filter(is_filled(F.col("temperature_c")))


def clean_topology(code: Column) -> Column:
    """A net's three letters, with an optional letter after a hyphen; anything else is empty."""
    return F.when(code.rlike(r"^[A-Za-z]{3}(-[A-Za-z])?$"), code).otherwise("")


def process_columns(df: DataFrame, vessel: str = "vessel_type", agitation: str = "stirring") -> DataFrame:
    """Raw columns as *_raw, and the classes of vessel, capacity and agitation in their place."""
    capacity = classes.vessel_capacity(F.col(f"{vessel}_raw"))
    out = df.withColumnsRenamed({vessel: f"{vessel}_raw", agitation: f"{agitation}_raw"})
    volume = F.when(capacity["status"] == "Capacity", six_digits(capacity["ml"])).otherwise(capacity["status"])
    return out.withColumns({"vessel_type": classes.vessel_class(F.col(f"{vessel}_raw")), "vessel_volume_mL": volume, "agitation": classes.agitation_class(F.col(f"{agitation}_raw")), "stirring_reported": classes.stirring_presence(F.col(f"{agitation}_raw"))})


def mark_present(df: DataFrame, files: DataFrame, key: str, stem: str, status: str = "status") -> DataFrame:
    """status 1 where a file of the key's stem is there, in any case; else the status as it was."""
    there = files.select(F.lower(stem).alias("_stem")).distinct().withColumn("_there", F.lit(True))
    return df.join(small(there), F.lower(key) == F.col("_stem"), "left").withColumn(status, F.when(F.col("_there"), 1).otherwise(F.col(status))).drop("_stem", "_there")


def prune_rare_formulas(df: DataFrame, column: str, longest: int = 10) -> DataFrame:
    return prune_singletons(df, column, longest)
