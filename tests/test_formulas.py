import pytest
from pyspark.sql import functions as F

from millrace.functions import formulas
from millrace.plans.records import _FORMULAS


@pytest.mark.parametrize(("formula", "mass"), _FORMULAS)
def test_masses(formula, mass):
    got = formulas.molar_mass(formula)
    assert got == (None if mass is None else pytest.approx(mass, abs=0.02))


@pytest.mark.parametrize(("formula", "counts"), [("6H2O", {"H": 12, "O": 6}), ("Fe2(SO4)3·1/2H2O", {"Fe": 2, "S": 3, "O": 12.5, "H": 1}), ("[Zn(NH3)4]Cl2", {"Zn": 1, "N": 4, "H": 12, "Cl": 2}), ("Co(acac)2", {"Co": 1, "C": 10, "H": 14, "O": 4})])
def test_counts(formula, counts):
    assert formulas.element_counts(formula) == counts


@pytest.mark.parametrize("formula", ["Zn(NO3", "Zn)2", "zn", "Zn$"])
def test_no_formula(formula):
    with pytest.raises(ValueError, match="not a formula"):
        formulas.element_counts(formula)


def test_metals_of_precursors(spark):
    rows = [("Copper nitrate", None, "Cu"), ("silver nitrate", None, "Ag"), ("Iron chloride", None, "Fe"), ("PdCl2", None, "Pd"), ("Zinc acetate dihydrate", None, "Zn"), ("cupric acetate", None, "Cu")]
    rows += [("something", "Zr", "Zr"), ("1,3-(Co)", None, "Co"), (None, None, "Me_unknown"), ("123", None, "Me_unknown")]
    df = spark.createDataFrame(rows, "name string, short string, want string")
    got = df.select("want", formulas.first_symbol(F.col("name"), F.col("short"), "Me_unknown").alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]
