"""Element counts and molar masses of precursor formulas."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.numbers import finite
from millrace.functions.text import FILLED_EMPTY

# Atomic masses in g/mol.
MASSES = {
    "H": 1.0079, "Li": 6.941, "B": 10.811, "C": 12.011, "N": 14.0067, "O": 15.999, "F": 18.998, "Na": 22.989, "Mg": 24.305, "Al": 26.982,
    "Si": 28.085, "P": 30.974, "S": 32.065, "Cl": 35.453, "K": 39.098, "Ca": 40.078, "Sc": 44.956, "Ti": 47.867, "V": 50.942, "Cr": 51.996,
    "Mn": 54.938, "Fe": 55.845, "Co": 58.933, "Ni": 58.693, "Cu": 63.546, "Zn": 65.38, "Ga": 69.723, "Ge": 72.64, "As": 74.922, "Se": 78.96,
    "Br": 79.904, "Rb": 85.468, "Sr": 87.62, "Y": 88.906, "Zr": 91.224, "Nb": 92.906, "Mo": 95.95, "Ag": 107.868, "Cd": 112.411, "In": 114.818,
    "Sn": 118.71, "Sb": 121.760, "Te": 127.60, "I": 126.904, "Ba": 137.327, "La": 138.905, "Ce": 140.116, "Pr": 140.908, "Nd": 144.24, "Sm": 150.36,
    "Eu": 151.964, "Gd": 157.25, "Tb": 158.925, "Dy": 162.500, "Ho": 164.930, "Er": 167.259, "Tm": 168.934, "Yb": 173.04, "Lu": 174.967, "Hf": 178.49,
    "Ta": 180.948, "W": 183.84, "Re": 186.207, "Os": 190.23, "Ir": 192.217, "Pt": 195.084, "Au": 196.967, "Hg": 200.59, "Tl": 204.383, "Pb": 207.2,
    "Bi": 208.980, "Th": 232.038, "U": 238.029,
}
# What common short forms stand for.
SHORT_FORMS = {"MeCN": "C2H3N", "DMF": "C3H7NO", "DMSO": "C2H6OS", "OAc": "C2H3O2", "AcO": "C2H3O2", "OMc": "C4H5O2", "acac": "C5H7O2", "Cy": "C6H11", "Ph": "C6H5"}
# Short forms that stand inside a formula.
INNER_FORMS = {"OiPr": "OC3H7", "iPrO": "OC3H7", "OtBu": "OC4H9", "tBuO": "OC4H9"}

_SHORT = re.compile("|".join([*INNER_FORMS, *(rf"(?<![A-Za-z]){k}(?![A-Za-z])" for k in SHORT_FORMS)]))
_TOKEN = re.compile(r"(?P<number>\d+(?:\.\d+)?(?:/\d+)?)|(?P<element>[A-Z][a-z]?)|(?P<open>[(\[])|(?P<close>[)\]])")


def _number(token: str) -> float:
    top, _, bottom = token.partition("/")
    return float(top) / float(bottom) if bottom and float(bottom) else float(top)


def element_counts(formula: str) -> Counter:
    """Counts of a formula; parts after a middle dot may have a coefficient for the whole part.

    Groups are kept on a stack; a number multiplies what stands right before it, or, where a part or group begins
    with one, what comes right after it.
    """
    whole: Counter = Counter()
    for part in re.split("[·∙•⋅]", _SHORT.sub(lambda m: {**SHORT_FORMS, **INNER_FORMS}[m[0]], formula)):
        part = part.strip()
        if not part:
            continue
        lead = re.match(r"\d+(?:\.\d+)?(?:/\d+)?", part)
        outer = _number(lead[0]) if lead else 1.0
        at, stack, last, pending = lead.end() if lead else 0, [Counter()], None, 1.0
        waiting: list[float] = []
        while at < len(part):
            m = _TOKEN.match(part, at)
            if not m:
                raise ValueError(f"not a formula: {formula!r} at {part[at:]!r}")
            at = m.end()
            if m["element"]:
                last, pending = Counter({m["element"]: pending}), 1.0
                stack[-1].update(last)
            elif m["open"]:
                waiting.append(pending)
                stack.append(Counter())
                last, pending = None, 1.0
            elif m["close"]:
                if len(stack) == 1:
                    raise ValueError(f"not a formula: {formula!r}")
                factor = waiting.pop()
                last = Counter({e: n * factor for e, n in stack.pop().items()})
                stack[-1].update(last)
            elif last is not None:
                factor = _number(m["number"])
                stack[-1].update({e: n * (factor - 1) for e, n in last.items()})
                last = None
            else:
                pending = _number(m["number"])
        if len(stack) > 1:
            raise ValueError(f"not a formula: {formula!r}")
        whole.update({e: n * outer for e, n in stack[0].items()})
    return whole


def molar_mass(formula: str | None) -> float | None:
    """g/mol, or None for what is no formula or has unknown elements."""
    try:
        counts = element_counts(formula or "")
    except ValueError:
        return None
    if not counts or counts.keys() - MASSES.keys():
        return None
    return sum(MASSES[e] * n for e, n in counts.items())


def map_distinct(df: DataFrame, column: str, name: str, function: Callable[[str], object], kind: str) -> DataFrame:
    """Adds function(column), worked out once for each distinct value."""

    @F.pandas_udf(kind)
    def apply(values: pd.Series) -> pd.Series:
        return values.map(function)

    known = df.select(F.col(column).alias("_v")).filter(F.col("_v").isNotNull()).distinct().withColumn(name, apply("_v"))
    return df.join(known, F.col(column) == F.col("_v"), "left").drop("_v")


def with_molar_mass(df: DataFrame, formula: str, name: str = "molar_mass") -> DataFrame:
    return map_distinct(df, formula, name, molar_mass, "double")


# Names of elements in precursors, and of their ions.
ELEMENTS = {
    "lithium": "Li", "beryllium": "Be", "boron": "B", "sodium": "Na", "magnesium": "Mg", "aluminum": "Al", "aluminium": "Al", "silicon": "Si", "potassium": "K",
    "calcium": "Ca", "scandium": "Sc", "titanium": "Ti", "vanadium": "V", "chromium": "Cr", "manganese": "Mn", "iron": "Fe", "cobalt": "Co", "nickel": "Ni",
    "copper": "Cu", "zinc": "Zn", "gallium": "Ga", "germanium": "Ge", "rubidium": "Rb", "strontium": "Sr", "yttrium": "Y", "zirconium": "Zr", "niobium": "Nb",
    "molybdenum": "Mo", "technetium": "Tc", "ruthenium": "Ru", "rhodium": "Rh", "palladium": "Pd", "silver": "Ag", "cadmium": "Cd", "indium": "In", "tin": "Sn",
    "antimony": "Sb", "cesium": "Cs", "barium": "Ba", "lanthanum": "La", "cerium": "Ce", "praseodymium": "Pr", "neodymium": "Nd", "promethium": "Pm",
    "samarium": "Sm", "europium": "Eu", "gadolinium": "Gd", "terbium": "Tb", "dysprosium": "Dy", "holmium": "Ho", "erbium": "Er", "thulium": "Tm", "ytterbium": "Yb",
    "lutetium": "Lu", "hafnium": "Hf", "tantalum": "Ta", "tungsten": "W", "rhenium": "Re", "osmium": "Os", "iridium": "Ir", "platinum": "Pt", "gold": "Au",
    "mercury": "Hg", "thallium": "Tl", "lead": "Pb", "bismuth": "Bi", "thorium": "Th", "uranium": "U",
}
IONS = {
    "ferrous": ("Fe", 2), "ferric": ("Fe", 3), "cuprous": ("Cu", 1), "cupric": ("Cu", 2), "stannous": ("Sn", 2), "stannic": ("Sn", 4), "plumbous": ("Pb", 2),
    "plumbic": ("Pb", 4), "chromous": ("Cr", 2), "chromic": ("Cr", 3), "manganous": ("Mn", 2), "manganic": ("Mn", 3), "cerous": ("Ce", 3), "ceric": ("Ce", 4),
    "cobaltous": ("Co", 2),
}


def first_symbol(name: Column, short: Column | None = None, unknown: str | None = None) -> Column:
    """The metal of a precursor: a symbol that stands alone in its short form, else the first element named in words,
    else the symbol that the formula begins with, else one that stands alone in the name, else `unknown`."""
    names = {**ELEMENTS, **{k: e for k, (e, _) in IONS.items()}}
    word = F.regexp_extract(F.lower(name), rf"\b({'|'.join(names)})\b", 1)
    named = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))[F.nullif(word, F.lit(""))]
    some = lambda text, pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    alone = r"\b([A-Z][a-z]?)\b"
    tries = ([some(short, alone)] if short is not None else []) + [named, some(name, r"^[^A-Za-z]*([A-Z][a-z]?)"), some(name, alone)]
    return F.coalesce(*tries, F.lit(unknown).cast("string"))


def stirring_reported(text: Column) -> Column:
    """yes, no or not_reported: a denial or a static growth counts before any mention of stirring."""
    low = F.lower(text)
    denied = low.rlike(r"\b(without|no|not)\s+(any\s+)?(stir|agitat)|\b(static|undisturbed|left standing)\b")
    return F.when(denied, "no").when(low.rlike(r"\b(pre-?)?stir"), "yes").otherwise("not_reported")


def synthesis_features(df: DataFrame, slots: int = 3, concentration: str = "metel_concnertation") -> DataFrame:
    """Adds M_L_ratio and the concentration (by default in the column name that readers of such tables expect).

    The ratio divides the first metal by the first linker, to two decimals, if all their amounts that have a unit are in
    mmol; else it is 1 where the text says 1:1. The concentration is in mM, rounded half to even. Amounts may be
    fractions such as 1/2.
    """
    unit = lambda stem, i: F.lower(F.trim(F.col(f"{stem}_{i}_amount_unit")))
    others = [unit(s, i) for s in ("metal", "linker") for i in range(2, slots + 1) if f"{s}_{i}_amount_unit" in df.columns]
    both = F.coalesce((unit("metal", 1) == "mmol") & (unit("linker", 1) == "mmol"), F.lit(False))
    for u in others:
        both = both & F.coalesce(u.isin("mmol", *FILLED_EMPTY), F.lit(True))
    value = lambda c: finite(F.coalesce(F.trim(F.col(c)).try_cast("double"), fraction(F.col(c))))
    metal, linker, ml = value("metal_1_amount_value"), value("linker_1_amount_value"), value("solvent_main_ml")
    said = F.coalesce(F.col("metal_1_amount_text").rlike(r"(?<!\d)1\s*[:：]\s*1(?!\d)"), F.lit(False))
    ratio = F.when(both, F.bround(F.try_divide(metal, linker), 2)).when(said, 1.0)
    mm = F.when((unit("metal", 1) == "mmol") & (ml > 0), F.bround(metal / ml * 1000, 0))
    return df.withColumns({concentration: mm, "M_L_ratio": ratio})


def fraction(text: Column) -> Column:
    """a/b as a number; null for anything else."""
    parts = F.split(text, "/")
    return F.when(F.size(parts) == 2, F.try_divide(F.trim(F.get(parts, F.lit(0))).try_cast("double"), F.trim(F.get(parts, F.lit(1))).try_cast("double")))
