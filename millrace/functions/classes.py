"""Classes of free text by ordered rules: connectivity, vessels and their capacity, agitation, solvents, linkers.

A rule table is a list of (pattern, class); the first pattern that is found gives the class. Tables become one chain of
conditions over columns, so nothing leaves generated code. Null and missing texts are stated for each function.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import STIRRING_EMPTY, VESSEL_EMPTY, is_filled, squeeze

Rules = Sequence[tuple[str, str]]


def first_class(text: Column, rules: Rules, otherwise: str | None = None) -> Column:
    """The class of the first rule whose pattern is found in the text, in any case."""
    out = F.lit(otherwise).cast("string")
    for pattern, label in reversed(rules):
        out = F.when(text.rlike(f"(?iu){pattern}"), label).otherwise(out)
    return out


def folded(text: Column, empty: Sequence[str]) -> Column:
    """Lower case, plain hyphens and micro signs, single spaces, thousands without commas; missing tokens are empty."""
    plain = F.translate(F.lower(text), "‐‑‒–—−μµ ", "------uu ")
    plain = F.regexp_replace(plain, r"(?<=\d),(?=\d{3}(?:\D|$))", "")
    plain = squeeze(F.regexp_replace(plain, "​", ""))
    return F.when(plain.isin(*empty), "").otherwise(F.coalesce(plain, F.lit("")))


# Patterns of connectivity texts, in the order in which they count.
CONNECTIVITY: Rules = [
    (r"\bKeggin\b|PMo12|BW12|SiW12|PW12", "Keggin POM cluster SBU"),
    (r"\bDawson\b|P2W18", "Dawson POM cluster SBU"),
    (r"\bMo8O?26\b|(?:^|[^A-Za-z])Mo8([^A-Za-z]|$)|β-?Mo8|α-?Mo8|R-?Mo8", "Mo8 POM cluster SBU"),
    (r"\[(?:Mo|W)\(CN\)8\]", "POM cyanometal connectivity"),
    (r"paddle[- ]?wheel|\[M2\(COO\)4\]", "paddlewheel dimer SBU"),
    (r"\b(?:Cu|Zn|Co|Ni|Cd)2\b.*paddle|paddle.*\b(?:Cu|Zn|Co|Ni|Cd)2\b", "paddlewheel dimer SBU"),
    (r"\bμ?3[- ]?O[H]?\b|μ3-oxo|M3\(μ3-O", "trinuclear μ3-oxo trimer cluster SBU"),
    (r"\bcubane\b|D4R\b", "tetranuclear cubane cluster SBU"),
    (r"\bcage\b|nanocage|mop\b|polyhedron|metallamacrocycle", "cage cluster SBU"),
    (r"pinwheel|hourglass|wheel", "pinwheel cluster SBU"),
]
# Words for the number of metals in a cluster.
NUCLEARITY = {
    3: "trinuclear", 4: "tetranuclear", 5: "pentanuclear", 6: "hexanuclear", 7: "heptanuclear", 8: "octanuclear", 9: "nonanuclear", 10: "decanuclear",
    11: "undecanuclear", 12: "dodecanuclear", 14: "tetradecanuclear", 18: "octadecanuclear",
}
# What is left after clusters, rods by their inner patterns.
EXTENDED: Rules = [
    (r"\b2D\b.*(layer|sheet|grid|honeycomb)|\b\(4,4\)\b|\bsql\b|\bhcb\b|\bkagome|\bkgd\b|CdCl2-?type|CdSO4-?type", "2D layer connectivity"),
    (r"\bpillar[- ]?layer|\bpillared\b", "pillared layer connectivity"),
    (r"\bdia\b|diamond", "3D named-net connectivity (dia)"),
    (r"\bpcu\b|primitive cubic|a-?Po", "3D named-net connectivity (pcu)"),
    (r"\bpts\b", "3D named-net connectivity (pts)"),
    (r"\brht\b|\bscu\b|\bsrs\b|\bkgm\b", "3D named-net connectivity (other)"),
    (r"zeolit(ic|e)|\bSOD\b|AFI|D4R|D6R", "3D named-net connectivity (other)"),
    (r"\[Ni\(CN\)4\]|\[Pt\(CN\)4\]|\[Pd\(CN\)4\]|\bcyanide\b|Cu\(CN\)", "Hofmann-type cyanide connectivity"),
    (r"\(\s*\d+(?:\s*,\s*\d+)+\s*\)|\b\d+\s*-\s*connected\b|\b\d+\s*connected\b", "3D x-connected connectivity"),
    (r"\b3D\b.*(framework|network)|\bframework\b|\bnetwork\b", "3D multinodal connectivity"),
    (r"layer|sheet", "2D layer connectivity"),
    (r"chain|rod", "1D rod SBU (coordination chain)"),
]
RODS = r"(?iu)\brod SBU\b|\b1D\b.*chain|\binfinite .*chain|\bzig-?zag chain|\bhelical chain"
ROD_KINDS: Rules = [
    (r"(metal|M)[- ]?O[- ]?M|oxo|μ[- ]?OH|μ[- ]?O\b", "1D rod SBU (metal-oxo chain)"),
    (r"face[- ]?sharing|LnO9|anticube|dodecahedron", "1D rod SBU (lanthanide face-sharing)"),
]


def connectivity_class(text: Column) -> Column:
    """A label of a connectivity text that names no metal; empty for missing texts."""
    t = F.translate(squeeze(text), "–—·", "--.")
    words = [(rf"\b{word}\b", f"{word} cluster SBU") for word in NUCLEARITY.values()]
    numbers = [(rf"\b[A-Z][a-z]?\s*{n}\b|\b(?:RE|Ln)\s*{n}\b|\b{n}\s*-?\s*connected\b", f"{word} cluster SBU") for n, word in NUCLEARITY.items()]
    clusters = [*CONNECTIVITY, *words, *numbers, (r"\b[A-Z][a-z]?4O\b", "tetranuclear cluster SBU"), (r"\bcluster\b|\bSBU\b", "polynuclear cluster SBU")]
    rod = F.when(t.rlike(RODS), first_class(t, ROD_KINDS, "1D rod SBU (coordination chain)"))
    found = F.coalesce(first_class(t, clusters), rod, first_class(t, EXTENDED, "3D multinodal connectivity"))
    return F.when(is_filled(text), found).otherwise("")


# Parts of vessels that are not their body, and more than one vessel.
_PTFE_PARTS = (
    r"\bcap and (?:teflon|ptfe) liner\b|\bcapped with (?:a )?(?:teflon|ptfe) (?:vial|cup)\b|\b(?:teflon|ptfe)[- ]+(?:capped|sealed)\b|\b(?:teflon|ptfe)"
    r"(?:[- ]+(?:lined|coated|rubber|mechanical|screw(?:-top)?|faced|sealing|taped|wrapped|phenolic|supported)){0,4}[- ]+(?:caps?|capped|seals?|tape|stirrers?|"
    r"stir(?:ring)? bars?|adaptors?|adapters?|spacers?|lids?|screwcap|septum|septa|gaskets?|wads?|covers?|necks?)\b"
)
_AROUND = r"\b(?:in|within)\s+(?:a\s+)?(?:(?:ht |microwave )?reactor block|microwave reactor)\b.*|\bin\s+(?:a\s+)?(?:preheated\s+)?oven\b.*"
_SMALL = r"(?:vials?|tubes?|bottles?|ampoules?|ampules?|flasks?|beakers?|vessels?|bags?)"
_NESTED = "|".join([
    rf"{_SMALL}\b.*\b(?:inside|within|in|into)\b.*\b(?:vials?|tubes?|bottles?|autoclaves?|reactors?|containers?|vessels?)",
    r"\b(?:reactor|autoclave|vessel)\b.*\b(?:vial|tube)\b.*\b(?:inside|inserted)\b",
    r"\b(?:with|containing)\b.*\bvial\b.*\binside\b",
    rf"(?=.*\b(?:transferred|transfer|crystallization in)\b).*{_SMALL}.*{_SMALL}",
    rf"(?:{_SMALL}|\bautoclave\b)[^;]*;.*{_SMALL}",
    r"\binner (?:vial|tube|vessel)\b",
    r"\breactor\b.*\bimmersed in\b.*\bbottle\b",
])
_MICROWAVE = r"(?=.*\bmicrowave\b).*(?:vial|tube|vessel|reactor|bottle|autoclave|synthesizer)"
_PRESSURE = r"\bautoclaves?\b|\bbombs?\b|\bdigestion\b|(?=.*\bpressure\b).*\b(?:vessel|reactor|container)\b"
# Vessel classes by shape, then material. Classes below ten records of the reference cohort count as not reported.
VESSELS: Rules = [
    (r"\b(?:ampoules?|ampules?|ampullae?|ampulla)\b", "Ampoule"),
    (r"\bflasks?\b|erlenmeyer|round[- ]bottom|three[- ]neck(?:ed)? balloon", "Flask"),
    (r"\bbeakers?\b", "Beaker"),
    (r"\b(?:bottles?|jars?)\b", "Bottle / jar"),
    (r"\bvials?\b|scintillation", "Vial"),
    (r"\breactors?\b|\bkettles?\b|\breaction chambers?\b", "Reactor / reaction chamber"),
    (r"\btubes?\b|\bschlenk\b|\bcapillar(?:y|ies)\b", "Tube / capillary"),
    (r"\b(?:petri|culture|staining|evaporating) dishes?\b|\bdish\b|\bwell[- ]?plate\b|\bmultiwell\b", "Dish / well plate"),
    (r"crucible|dialysis (?:bag|membrane)|dialysis tubing|(?=.*\brotor\b).*\binsert\b", "Not reported"),
    (r"\bcell\b", "Reaction cell"),
    (r"(?=.*(?:glass|pyrex|borosilicate|quartz)).*(?:vessel|container|cell|liner|chamber)", "Glass vessel"),
    (r"(?=.*(?:polypropylene|polyethylene|\bhdpe\b|plastic)).*(?:vessel|container|cell)", "Polymer vessel"),
    (r"(?=.*\b(?:steel|metal)\b).*(?:vessel|container)", "Metal vessel"),
    (r"\b(?:vessels?|containers?|cells?|chambers?|inserts?|liners?)\b", "Not reported"),
]
_EQUIPMENT = r"heater|oven|furnace|oil bath|water bath|ultraso|lyophiliz|reflux|layer|soak|ambient|room temperature|diffusion|spray dryer"


def nested_vessels(folded_text: Column) -> Column:
    """More than one vessel; a lining, a heating block and an oven are none of their own."""
    return F.regexp_replace(folded_text, _AROUND, "").rlike(_NESTED)


def vessel_class(text: Column) -> Column:
    """The class of a vessel description; `Not reported` for missing ones and equipment alone."""
    t = folded(text, VESSEL_EMPTY)
    body = F.regexp_replace(t, _PTFE_PARTS, " ")
    ptfe, pressure = body.rlike(r"\b(?:teflon|ptfe|polytetrafluoroethylene)\b"), body.rlike(_PRESSURE)
    equipment = F.when(t.rlike(_EQUIPMENT), "Not reported").otherwise("Unresolved vessel description")
    return (
        F.when(t == "", "Not reported").when(nested_vessels(t), "Nested / multiple vessels").when(t.rlike(_MICROWAVE), "Microwave vessel")
        .when(ptfe & pressure, "PTFE-lined autoclave").when(pressure, "Autoclave / pressure vessel").when(ptfe, "PTFE vessel / liner")
        .otherwise(F.coalesce(first_class(t, VESSELS), equipment))
    )


_UNIT = r"(?:m\s*l|u\s*l|l|c\s*m\s*3|c\s*c)"
_CHARGE_BEFORE = r"(?:(?:reaction|solution|liquid|solvent|working|charge)\s+volume[^;,()]{0,30}|\b(?:containing|filled with|charged with)\s*)"
_CHARGE_AFTER = (
    r"\s*(?:(?:of )?(?:suspension|solution|reaction mixture|water|h2o|etoh|dmf|methanol|ethanol|acetone|acetonitrile)\b|(?:working|reaction|solution|liquid|solvent) volume\b)"
)


def vessel_capacity(text: Column) -> Column:
    """struct(ml, status) of a vessel description: one stated capacity, else `Not reported` or `Ambiguous`.

    Volumes of what is filled in are no capacity. Ranges, nested vessels, damaged units and several values are ambiguous.
    """
    t = folded(text, VESSEL_EMPTY)
    t = F.regexp_replace(t, r"(\d),(\d{1,2})(?=\s*(?:ml|ul|l)\b)", "$1.$2")
    amount = rf"(?<![\w.])[-+]?\d+(?:\.\d+)?\s*-?\s*{_UNIT}\b"
    own = F.regexp_replace(F.regexp_replace(t, rf"{_CHARGE_BEFORE}{amount}", " "), rf"{amount}(?={_CHARGE_AFTER})", " ")
    hits = F.regexp_extract_all(own, F.lit(rf"({amount})"), F.lit(1))
    unit = lambda h: F.regexp_replace(F.regexp_extract(h, rf"({_UNIT})$", 1), r"\s", "")
    scale = lambda h: F.when(unit(h) == "ul", 0.001).when(unit(h) == "l", 1000.0).otherwise(1.0)
    values = F.array_distinct(F.transform(hits, lambda h: F.round(F.regexp_extract(h, r"^([-+]?\d+(?:\.\d+)?)", 1).cast("double") * scale(h), 10)))
    one = F.get(values, F.lit(0))
    kind = vessel_class(text)
    none = F.when(t.rlike(rf"\d\s*-?\s*{_UNIT}\b"), "Not reported").when(t.rlike(r"\b(?:drams?|dr|ounces?|oz)\b|\d.*\b(?:ml|ul|cm3|cc)\b"), "Ambiguous").otherwise("Not reported")
    status = (
        F.when((t == "") | (t.rlike(_EQUIPMENT) & (kind == "Not reported") & first_class(t, VESSELS).isNull()), "Not reported")
        .when(nested_vessels(t) | t.rlike(rf"\d\s*(?:-|to|or|/)\s*\d+(?:\.\d+)?\s*-?\s*{_UNIT}\b|\d\s*(?:\?|�)\s*l\b"), "Ambiguous")
        .when(F.size(values) == 0, none).when((F.size(values) > 1) | (one <= 0) | ((kind == "Vial") & (one >= 1000)), "Ambiguous").otherwise("Capacity")
    )
    return F.struct(F.when(status == "Capacity", one).alias("ml"), status.alias("status"))


# Words of agitation and of its stage.
_STIR = r"\b(?:stir(?:red|ring|rer|rers)?|pre-?stir(?:red|ring)?|magnetic agitation)\b"
_SONIC = r"\b(?:ultraso\w*|sonicat\w*)\b"
_TURN = r"\b(?:shak\w*|shook|rotat\w*|rpb|vortex\w*)\b"
_MIX = r"\b(?:mix(?:ed|ing)?|premix(?:ed|ing)?|pre-mix(?:ed|ing)?|homogeniz\w*|homogenis\w*)\b"
_AGITATE = r"\bagitat\w*\b"
_NO_STIR = r"\b(?:without|no|not)\s+(?:any\s+)?(?:stir(?:red|ring)?|agitat\w*|rotation)\b"
_STATIC = r"\b(?:static|undisturbed|left standing|allowed to stand)\b"
_BEFORE = (
    r"\b(?:pre-?(?:mix\w*|stir\w*|heat\w*|reaction|seal\w*|treatment|dissolution|dispersion|aging)|premix\w*|initial(?:ly)?|"
    r"during (?:preparation|mixing|dissolution|addition|base addition|gel prep)|to (?:dissolve|mix))\b|\b(?:before|prior to)\b|"
    r"\bthen\s+(?:(?:sealed|capped)\s+(?:and\s+)?)?(?:heat\w*|reflux\w*|age\w*|layer\w*|seal\w*|incubat\w*|micro\w*|kept|held|solvent evaporation)\b|"
    r";\s*(?:layered slow diffusion|refluxed)\b|\buntil dissolved\b|\b(?:pre|premix)\s*\)"
)
_DURING = (
    r"\b(?:during|throughout)\s+(?:the\s+)?(?:reaction|synthesis|conversion|heating|reflux|crystallization|crystallisation)\b|\bunder reflux\b|"
    r"\bstirred\s*\(reflux\)|\bmaintained to end\b"
)
_EITHER = r"\b(?:with or without|with/without|stirred or static|static or stirred)\b|\b(?:not|non)[ -]?static\b"
MIXING = "Shaking, vortexing, rotation and mixing"


def agitation_class(text: Column) -> Column:
    """One of nine classes: the method, and whether it was before a static or the main synthesis; missing, contradictory
    and unresolved texts are `Not reported`."""
    t = F.regexp_replace(F.translate(folded(text, STIRRING_EMPTY), "_", " "), r"\s*-\s*", "-")
    positive = F.regexp_replace(F.regexp_replace(t, _NO_STIR, " "), r"\bstirr\w*\s+after cooling\b", " ")
    has = lambda pattern: positive.rlike(pattern)
    static = t.rlike(f"{_STATIC}|{_NO_STIR}")
    when_static = (
        F.when(t.rlike(r"\bstatic\b[^;]*\bthen\s+stirr\w*"), "Not reported").when(has(_STIR), "Stirred before static synthesis")
        .when(has(_SONIC), "Sonicated before static synthesis").when(has(_TURN), MIXING).when(has(_MIX), MIXING).when(has(_AGITATE), "Not reported").otherwise("No stirring")
    )
    early = ~t.rlike(_DURING) & t.rlike(_BEFORE)
    by_method = (
        F.when(has(_TURN), MIXING).when(has(_STIR), F.when(early, "Stirred before main synthesis").otherwise("Stirring reported"))
        .when(has(_SONIC), F.when(early, "Sonicated before main synthesis").otherwise("Sonication reported")).when(has(_MIX), MIXING).otherwise("Not reported")
    )
    return F.when((t == "") | t.rlike(_EITHER), "Not reported").when(static, when_static).otherwise(by_method)


def stirring_presence(text: Column) -> Column:
    """yes, no or not_reported, from the class of agitation: only stirring counts as yes."""
    kind = agitation_class(text)
    return F.when(kind == "No stirring", "no").when(kind.startswith("Stir"), "yes").otherwise("not_reported")


# Solvents, by their names and short forms.
SOLVENTS = {
    "H2O": ("water", ("water", "h2o", "di water", "deionized water", "deionised water", "distilled water", "doubly deionized water", "double deionized water", "milli-q water", "ultrapure water", "tap water")),
    "EtOH": ("ethanol", ("ethanol", "ethyl alcohol", "etoh", "absolute ethanol", "anhydrous ethanol", "95% ethanol", "denatured ethanol")),
    "MeOH": ("methanol", ("methanol", "methyl alcohol", "meoh", "anhydrous methanol")),
    "iPrOH": ("isopropanol", ("isopropanol", "isopropyl alcohol", "2-propanol", "ipa", "iproh")),
    "MeCN": ("acetonitrile", ("acetonitrile", "mecn", "acn")),
    "DMF": ("dimethylformamide", ("dimethylformamide", "n,n-dimethylformamide", "n,n-dimethyl formamide", "dmf")),
    "DMSO": ("dimethyl sulfoxide", ("dimethyl sulfoxide", "dimethylsulfoxide", "dmso")),
    "NMP": ("N-methyl-2-pyrrolidone", ("n-methyl-2-pyrrolidone", "n methyl 2 pyrrolidone", "n-methylpyrrolidone", "nmp")),
    "THF": ("tetrahydrofuran", ("tetrahydrofuran", "thf")),
    "toluene": ("toluene", ("toluene", "phme")),
    "acetone": ("acetone", ("acetone",)),
    "DMAc": ("N,N-dimethylacetamide", ("n,n-dimethylacetamide", "dmac", "dmac.")),
}
_GRADE = r"(?:absolute|anhydrous|dry|extra\s*dry|spectroscopic|hplc|reagent|acs|ultra\s*pure|degassed|deoxygenated|stabilized|saturated|technical|denatured|\d{2,3}\s*%)"


def solvent_pair(name: Column, short: Column) -> Column:
    """struct(name, short): the canonical pair, by the name (without grades and parentheses), else by the short form;
    unknown solvents keep what they have, trimmed, missing parts are empty."""
    low = F.translate(F.lower(F.trim(name)), "₂", "2")
    key = F.trim(F.regexp_replace(squeeze(F.regexp_replace(low, r"\([^)]*\)", "")), rf"(?i)(?:[,;\s-]+{_GRADE})+$", ""))
    by_name = F.create_map(*(F.lit(x) for s, (_, names) in SOLVENTS.items() for n in names for x in (n, s)))
    by_short = F.create_map(*(F.lit(x) for s, (_, names) in SOLVENTS.items() for n in dict.fromkeys([s.upper(), *(n.upper() for n in names if n.isalpha() and len(n) <= 5 or n == "h2o")]) for x in (n, s)))
    full = F.create_map(*(F.lit(x) for s, (n, _) in SOLVENTS.items() for x in (s, n)))
    known = F.coalesce(by_name[key], by_short[F.upper(F.trim(short))])
    kept = F.when(is_filled(name), F.trim(name)).otherwise("")
    return F.struct(F.coalesce(full[known], kept).alias("name"), F.coalesce(known, F.trim(short), F.lit("")).alias("short"))


# Linkers by their other names; keys are linker_key of the name.
LINKERS = {
    "terephthalic acid": ("terephthalic acid", "benzene-1,4-dicarboxylic acid", "1,4-benzenedicarboxylic acid", "p-phthalic acid", "bdc"),
    "2-aminoterephthalic acid": ("2-aminoterephthalic acid", "2-amino-1,4-benzenedicarboxylic acid", "nh2-bdc"),
    "1,3,5-Tris(4-carboxyphenyl)benzene": ("h3btb",),
    "benzene-1,3,5-tricarboxylic acid": ("1,3,5-benzenetricarboxylic acid", "benzene-1,3,5-tricarboxylic acid", "trimesic acid", "btc"),
    "isophthalic acid": ("isophthalic acid", "benzene-1,3-dicarboxylic acid", "1,3-benzenedicarboxylic acid"),
    "1,4-naphthalenedicarboxylic acid": ("1,4-naphthalenedicarboxylic acid", "naphthalene-1,4-dicarboxylic acid"),
    "2,6-naphthalenedicarboxylic acid": ("2,6-naphthalenedicarboxylic acid", "naphthalene-2,6-dicarboxylic acid"),
    "2,5-pyridinedicarboxylic acid": ("2,5-pyridinedicarboxylic acid", "pyridine-2,5-dicarboxylic acid"),
    "2,5-thiophenedicarboxylic acid": ("2,5-thiophenedicarboxylic acid", "thiophene-2,5-dicarboxylic acid"),
    "tetrafluoroterephthalic acid": ("tetrafluoroterephthalic acid", "2,3,5,6-tetrafluoro-1,4-benzenedicarboxylic acid"),
    "biphenyl-4,4'-dicarboxylic acid": ("biphenyl-4,4'-dicarboxylic acid", "4,4'-biphenyldicarboxylic acid", "bpdc"),
    "4,4'-bipyridine": ("4,4'-bipyridine",),
    "2-methylimidazole": ("2-methylimidazole", "2-methyl imidazole"),
    "1,4-diazabicyclo[2.2.2]octane": ("1,4-diazabicyclo[2.2.2]octane", "dabco"),
    "tetrakis(4-carboxyphenyl)porphyrin": ("tetrakis(4-carboxyphenyl)porphyrin", "tcpp"),
    "1,3-bis(4-pyridyl)propane": ("1,3-bis(4-pyridyl)propane", "bpp"),
    "1,4-bis(imidazol-1-ylmethyl)benzene": ("1,4-bis(imidazol-1-ylmethyl)benzene", "bimb"),
    "2,5-dihydroxyterephthalic acid": ("2,5-dihydroxyterephthalic acid", "2,5-dihydroxy-1,4-benzenedicarboxylic acid"),
    "2-nitroterephthalic acid": ("2-nitroterephthalic acid", "2-nitro-1,4-benzenedicarboxylic acid"),
    "bis(pyridylmethyl)piperazine": ("4-bpmp",),
}
# Names within longer ones.
LINKER_PARTS: Rules = [
    (r"\bbenzene[-\s]?1,4[-\s]?dicarboxylic acid\b|\b1,4[-\s]?benzenedicarboxylic acid\b", "terephthalic acid"),
    (r"\bbenzene[-\s]?1,3,5[-\s]?tricarboxylic acid\b|1,3,5-benzenetricarboxylic acid", "benzene-1,3,5-tricarboxylic acid"),
    (r"\bbenzene[-\s]?1,3[-\s]?dicarboxylic acid\b|1,3-benzenedicarboxylic acid", "isophthalic acid"),
    (r"\bnaphthalene[-\s]?1,4[-\s]?dicarboxylic acid\b", "1,4-naphthalenedicarboxylic acid"),
    (r"\bnaphthalene[-\s]?2,6[-\s]?dicarboxylic acid\b", "2,6-naphthalenedicarboxylic acid"),
    (r"\bpyridine[-\s]?2,5[-\s]?dicarboxylic acid\b", "2,5-pyridinedicarboxylic acid"),
    (r"\bthiophene[-\s]?2,5[-\s]?dicarboxylic acid\b", "2,5-thiophenedicarboxylic acid"),
    (r"4,4'-bipyridine", "4,4'-bipyridine"),
    (r"biphenyl-4,4'-dicarboxylic acid|4,4'-biphenyldicarboxylic acid", "biphenyl-4,4'-dicarboxylic acid"),
]


def linker_key(name: Column) -> Column:
    """Lower case, plain primes and hyphens, nothing around hyphens, primes and inside parentheses."""
    plain = F.lower(squeeze(F.translate(name, "′’‘–—−", "'''---")))
    tight = F.regexp_replace(F.regexp_replace(plain, r"\s*-\s*", "-"), r"\s*'\s*", "'")
    return F.regexp_replace(F.regexp_replace(tight, r"\(\s*", "("), r"\s*\)", ")")


def canonical_linker(name: Column) -> Column:
    """One name for a linker: by its key, else by a known name within it, else as it is; missing names stay."""
    key = linker_key(name)
    known = F.create_map(*(F.lit(x) for one, names in LINKERS.items() for n in names for x in (n, one)))
    return F.when(is_filled(name), F.coalesce(known[key], first_class(key, LINKER_PARTS), squeeze(name))).otherwise(name)


#: What names no linker, and why.
LINKER_DROPS: Rules = [
    (r"\bcomplex\b", "contains_complex"),
    (r"^\s*\(\s*H", "starts_with_(H"),
    (r"^\s*\(\s*[SD]\s*\)\s*-?\s*H\d+[A-Za-z0-9]{0,5}\s*$", "chiral_H_short"),
    (r"^\s*H\d+[A-Za-z0-9\-]{0,7}\s*$", "Hnum_short"),
    (r"^\s*L(\d{0,2})\s*$", "L_short"),
]


def linker_decision(name: Column, mapped: dict[str, str] | None = None, unwanted: Sequence[str] = ()) -> Column:
    """struct(name, reason): mapped, kept, keep_empty, or the reason why a row with this linker goes.

    mapped: other names (in lower case) and what they stand for; unwanted: names that go, compared without spaces.
    """
    low = F.lower(F.trim(name))
    table = F.create_map(*(F.lit(x) for pair in (mapped or {"": ""}).items() for x in pair))
    hit = table[low] if mapped else F.lit(None).cast("string")
    special = F.regexp_replace(low, r"\s+", "").isin(*("".join(u.lower().split()) for u in unwanted)) if unwanted else F.lit(False)
    reason = (
        F.when(~is_filled(name), "keep_empty").when(hit.isNotNull(), "mapped").when(special, "special_drop").otherwise(F.coalesce(first_class(name, LINKER_DROPS), F.lit("kept")))
    )
    return F.struct(F.coalesce(hit, F.when(is_filled(name), F.trim(name)).otherwise(name)).alias("name"), reason.alias("reason"))


def strength_free(name: Column, aliases: dict[str, str] | None = None) -> Column:
    """A modulator without strengths and grades ("37% HCl", "acetic acid (glacial)"), then by an alias table in lower case."""
    bare = squeeze(F.regexp_replace(F.regexp_replace(F.lower(name), r"\([^)]*\)|\d+(?:\.\d+)?\s*(?:%|wt%|m\b|mol/l|n\b)", " "), rf"(?i)\b(?:aqueous|aq\.?|glacial|conc\.?|concentrated|diluted?|solution|{_GRADE})\b", " "))
    table = F.create_map(*(F.lit(x) for pair in (aliases or {"": ""}).items() for x in pair))
    return F.coalesce(table[bare], F.nullif(bare, F.lit("")))
