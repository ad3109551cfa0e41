import pytest
from pyspark.sql import functions as F

from millrace.functions import keys, numbers, text


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(column(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("value", "want"),
    [("  “Zinc  nitrate” ", "Zinc nitrate"), ("N/A", None), ("not reported", None), ("a–b’s", "a-b's"), ("", None), (None, None), ("\tx\u00a0y ", "x y")],
)
def test_clean_text(spark, value, want):
    assert one(spark, value, text.clean_text) == want


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("/x/10.1021_jacs.7b09983_SI.pdf", "10.1021/jacs.7b09983"), ("C:\\a\\10.1021_jacs.7b09983.pdf", "10.1021/jacs.7b09983"), ("https://dx.doi.org/10.1000/ABC.1", "10.1000/abc.1"),
        ("doi: 10.1000/abc", "10.1000/abc"), ("see 10.1000/abc here", "10.1000/abc"), ("nothing", None), (None, None),
    ],
)
def test_doi(spark, value, want):
    assert one(spark, value, text.normalize_doi) == want


@pytest.mark.parametrize(
    ("value", "want"),
    [("48–72 h", 72.0), ("1 day to 3 days", 72.0), ("2-3 weeks", 504.0), ("up to 3 days", 72.0), ("overnight", 12.0), ("several days", 144.0), ("serval weeks", 432.0), ("several months", 2160.0), ("immediately", 0.1), ("immediate, 3 tries", None), ("24 h", None), (None, None)],
)
def test_duration(spark, value, want):
    assert one(spark, value, numbers.duration_hours) == want


@pytest.mark.parametrize(("value", "want"), [("1:2", 0.5), ("1:1:1", 0.5), ("2.5", 2.5), ("3/4", 0.75), ("1:0", None), ("1:x", None), (None, None)])
def test_ratio(spark, value, want):
    assert one(spark, value, numbers.parse_ratio) == want


@pytest.mark.parametrize(("value", "want"), [("48-72 h", 48.0), ("about -1.5e3 g", -1500.0), (".5", 0.5), ("none", None)])
def test_first_number(spark, value, want):
    assert one(spark, value, numbers.first_number) == want


@pytest.mark.parametrize(("value", "want"), [("2015", 2015), ("2014.5", 2014), ("1700", None), ("x", None)])
def test_year(spark, value, want):
    assert one(spark, value, numbers.parse_year) == want


def test_sets_and_joins(spark):
    df = spark.createDataFrame([(["DMF", "dmf", None, "Water"],), ([],)], "a array<string>")
    rows = df.select(text.set_key(F.col("a")).alias("k"), text.join_with_and(F.col("a")).alias("j")).collect()
    assert [tuple(r) for r in rows] == [("dmf + water", "DMF and Water"), ("unknown", None)]


def test_amounts(spark):
    df = spark.createDataFrame([(16.613, "mg", 166.13), (2.0, "mol", None), (5.0, "µmol", None), (1.0, "g", 100.0), (1.0, "mL", 10.0)], "v double, u string, m double")
    got = [r["x"] for r in df.select(numbers.amount_mmol(F.col("v"), F.col("u"), F.col("m")).alias("x")).collect()]
    assert got == [pytest.approx(0.1), 2000.0, 0.005, 10.0, None]


def test_probability_and_json(spark):
    df = spark.createDataFrame([(0.0, 0.0), (-1000.0, 0.0), (0.0, -1000.0)], "a double, b double")
    assert [r["p"] for r in df.select(numbers.pair_probability(F.col("a"), F.col("b")).alias("p")).collect()] == [0.5, 0.0, 1.0]
    key = keys.canonical_json({"b": F.lit("  X ")}, {"a": F.lit(1.0), "c": F.lit(None)})
    assert spark.range(1).select(key.alias("k")).first()["k"] == '{"a":1.0,"b":"x","c":null}'


def test_small_text_functions(spark):
    assert one(spark, "Zn salt (anhydrous)", text.without_trailing_parenthesis) == "Zn salt (anhydrous)"
    assert one(spark, "zinc chloride (ZnCl2)", text.without_trailing_parenthesis) == "ZnCl2"
    assert one(spark, "zinc salt (pure)", text.without_trailing_parenthesis) == "zinc salt"
    assert one(spark, "a\r\nb\u200bc", text.one_line) == "a\\nbc"
    assert one(spark, "a | b ||| c", text.split_alternatives) == ["a", "b", "c"]
    assert one(spark, "key sk-abcdefghijkl", text.redact_secrets) == "key [redacted]"
    assert one(spark, "water and ethanol", text.normalized_category) == "ethanol and water"
    assert one(spark, "μm naïve", text.word_count) == 2
