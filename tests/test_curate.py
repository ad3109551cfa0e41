import json

import pytest
from pyspark.sql import functions as F

from millrace import cli
from millrace.functions import precursors, values
from millrace.operators import curate, evaluate, records


@pytest.mark.parametrize(
    ("text", "formula"),
    [("nickel(II) chloride hexahydrate", "NiCl2·6H2O"), ("Zn(NO3)2·4H2O·2H2O", "Zn(NO3)2·6H2O"), ("iron(III) nitrate", "Fe(NO3)3"), ("cerium sulfate", "Ce2(SO4)3"), ("Cu(NO3)2 × H2O", "Cu(NO3)2·1H2O"), ("ZrCl4, 99.9 %", "ZrCl4"), ("nan", None)],
)
def test_precursors(text, formula):
    assert precursors.normalize_precursor(text) == formula


def test_metals_by_stage(spark):
    rows = [
        ("copper nitrate trihydrate", "24.16 mg (0.1 mmol)", "24.16", "mg"), ("Cu(NO3)2·3H2O", "", "241.6", "mg"), ("UiO-66", "1 mmol", "1", "mmol"), ("ZrCl4", "1 mmol", "1", "mmol"), ("Cu(NO3)2·3H2O", "", "", ""),
        ("benzoic acid", "", "1", "mmol"), ("Cu(NO3)2·3H2O", "ratio 1:2", "", "mL"), ("Cu(NO3)2·3H2O", "some", "", "mL"),
    ]
    df = spark.createDataFrame(rows, "metal_1 string, metal_1_amount_text string, metal_1_amount_value string, metal_1_amount_unit string")
    got = sorted(map(tuple, curate.clean_metals(df).collect()))
    assert got == sorted([("Cu(NO3)2·3H2O", "24.16 mg (0.1 mmol)", "0.1", "mmol"), ("Cu(NO3)2·3H2O", "", "1.00001", "mmol"), ("Cu(NO3)2·3H2O", "ratio 1:2", "", "mL")])


def test_linkers_solvents_temperatures(spark):
    df = spark.createDataFrame([("X acid", "16.613", "mg"), ("H3L", "1", "mmol"), ("X acid", "2", "equiv"), ("Y", "1", "g"), ("X acid", "5", "umol")], "linker_1 string, linker_1_amount_value string, linker_1_amount_unit string")
    weights = spark.createDataFrame([("x acid", "166.13"), ("Y", None)], "name string, g_per_mol string")
    got = sorted((r.linker_1, r.linker_1_amount_value, r.linker_1_amount_unit) for r in curate.clean_linkers(df, weights).collect())
    assert got == [("X acid", "0.005", "mmol"), ("X acid", "0.1", "mmol"), ("X acid", "2", "equiv")]
    t = spark.createDataFrame([("", "RT"), ("80", "slow cooling"), ("", "microwave"), (None, ""), ("5", "slow evaporation")], "temperature_c string, temperature_c_text string")
    assert sorted(r.temperature_c for r in curate.clean_temperatures(t).collect()) == ["25"]
    assert sorted(r.temperature_c for r in curate.clean_temperatures(t, positive=False).collect()) == ["25", "80"]
    s = spark.createDataFrame([("water", "", "10 mL H2O", ""), ("", "", "", "")], "solvent_main string, solvent_main_abbr string, solvent_main_amount_text string, solvent_main_ml string")
    assert [(r.solvent_main, r.solvent_main_abbr, r.solvent_main_ml) for r in curate.clean_solvents(s).collect()] == [("water", "H2O", "10")]
    assert spark.range(1).select(curate.clean_topology(F.lit("pcu-a")), curate.clean_topology(F.lit("pcux"))).first()[:] == ("pcu-a", "")


def test_label_logprobs(spark):
    top = [{"token": " N", "logprob": -2.0}, {"token": "P", "logprob": -0.1}]
    rows = [("P", [{"token": "x", "logprob": -9.0, "top_logprobs": []}, {"token": "P ", "logprob": -0.1, "top_logprobs": top}]), ("N", [{"token": "P", "logprob": -0.1, "top_logprobs": top}]), ("P", [])]
    df = spark.createDataFrame(rows, "chosen string, t array<struct<token:string,logprob:double,top_logprobs:array<struct<token:string,logprob:double>>>>")
    got = [tuple(r.x) for r in df.select(values.label_logprobs(F.col("t"), F.col("chosen")).alias("x")).collect()]
    assert got == [(-0.1, -2.0, True), (-0.1, -2.0, False), (None, None, None)]


def test_controls_and_outcomes(spark):
    rows = spark.createDataFrame([("d", 1, "zinc nitrate", "0.1", "mmol"), ("d", 2, "zinc nitrate", "120", "umol"), ("d", 3, "copper nitrate", "0.1", "mmol")], "doc string, row int, metal string, m_amount_value string, m_amount_unit string")
    controls = spark.createDataFrame([("d", 9, "zinc nitrate", "0.102", "mmol")], "doc string, control int, metal string, m_amount_value string, m_amount_unit string")
    assert [(r.row, r.control) for r in evaluate.match_controls(rows, controls, "doc", "row", "control", {"metal": "name", "m_amount_value": "amount"}).collect()] == [(1, 9)]
    out = evaluate.row_outcomes(spark.createDataFrame([(["a"], True, False), (["a"], False, False), ([], True, True)], "changed array<string>, fits boolean, dropped boolean"), ["a", "b"], "changed", "fits", "dropped").collect()
    assert [(r.outcome_a, r.outcome_b) for r in out] == [("TP", "TN"), ("FP", None), (None, None)]
    anchors = spark.createDataFrame([(1, "metal", True), (1, "solvent", False), (2, "metal", True)], "w int, kind string, fits boolean")
    assert {r.w: (r.changed, r.fallback) for r in evaluate.changed_classes(anchors, ["w"], "kind", "fits").collect()} == {1: (["solvent"], False), 2: (["metal"], True)}


def test_guards(spark):
    df = spark.createDataFrame([(1, "m", "P", "P"), (2, "m", "N", "P"), (3, "m", "P", None)], "index int, model string, gold string, predicted string")
    got = evaluate.score_predictions(df, "index", "model", "gold", "predicted")
    assert got["coverage"] == 2 / 3 and got["accuracy"] == 0.5 and got["precision"] == 0.5 and got["recall"] == 1.0
    with pytest.raises(ValueError, match="repeated"):
        evaluate.score_predictions(df.union(df), "index", "model", "gold", "predicted")
    with pytest.raises(ValueError, match="probabilities"):
        evaluate.check_calibration(spark.createDataFrame([(1, 1.5)], "y int, p double"), "y", ["p"])
    assert [r["index"] for r in evaluate.check_resume(df.filter("index = 1"), df, "index", ["gold"]).orderBy("index").collect()] == [2, 3]
    with pytest.raises(ValueError, match="differ from"):
        evaluate.check_resume(df.withColumn("gold", F.lit("N")), df, "index", ["gold"])
    with pytest.raises(ValueError, match="differ"):
        evaluate.check_groups_alike(df.withColumn("g", F.lit(1)), "g", ["gold"])
    with pytest.raises(ValueError, match="stay"):
        evaluate.check_unchanged(df, df.filter("index > 1"), F.col("gold") == "P")
    with pytest.raises(ValueError, match="requests"):
        records.check_requests(2, 3, 1, 5)


def test_chat_fields_and_prompts(spark):
    prompt = "Inputs: time_h, and temperature_C.\n    Based on these inputs, answer."
    longer = records.extend_prompt(prompt, "time_h, and temperature_C.", ["stirring"], "    Based on these inputs,", "stirring: yes or no\n")
    assert longer == "Inputs: time_h, temperature_C, and stirring.\nstirring: yes or no\n    Based on these inputs, answer."
    chat = spark.createDataFrame([(1, [("system", prompt), ("user", '{"time_h": 3}'), ("assistant", "P")])], f"k int, {records.MESSAGES}")
    more = spark.createDataFrame([(1, "yes", None)], "k int, stirring string, vessel string")
    out = records.add_fields(chat, more, "k", ["stirring", "vessel"], lambda p: p.replace("answer", "say")).first().messages
    assert json.loads(out[1].content) == {"time_h": 3, "stirring": "yes", "vessel": None} and out[0].content.endswith("say.") and out[2].content == "P"
    with pytest.raises(ValueError, match="without process"):
        records.add_fields(chat, more.filter("k > 1"), "k", ["stirring"])
    kept, long = records.prompt_bundle(chat, lambda t: len(t.split()), 5)
    assert kept.count() == 0 and long.count() == 1 and records.check_bundle(chat, ["time_h"]) == {"P": 1}
    with pytest.raises(ValueError, match="stands 2 times"):
        records.replace_counted("a a", "a", "b")


def test_manual_rows_and_plans(spark, tmp_path):
    lines = [{"messages": [{"role": "user", "content": '{"x": 1}'}, {"role": "assistant", "content": " p "}], "record_id": "r"}, {"x": 2, "label": "n"}]
    (tmp_path / "m.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n\n")
    got = records.manual_rows(spark, str(tmp_path / "m.jsonl"), "Say", ["x"]).orderBy("label").collect()
    assert [(r.label, json.loads(r.text)["x"], len(r.messages)) for r in got] == [("N", "2", 2), ("P", 1, 1)]
    plans = spark.createDataFrame([(1, [1.0], None), (2, [], [])], "k int, t array<double>, h array<double>")
    assert [tuple(r) for r in records.flatten_plans(plans, ["k"], ["t", "h"]).collect()] == [(1, "[1.0]", "")]


def test_count_matched_negatives(spark):
    donors = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "x string, y int")
    rows = spark.createDataFrame([(i, "a", 1, 1 + i % 2) for i in range(4)], "k int, x string, y int, n int")
    out = records.count_matched_negatives(rows, donors, "k", ["x", "y"], "n", donors, 3).collect()
    assert {r.k for r in out} == set(range(4)) and len({(r.x, r.y) for r in out}) == 4
    known = {(r.x, r.y) for r in donors.withColumn("y", F.col("y").cast("string")).collect()}
    for r in out:
        assert (r.x != "a") + (r.y != "1") == 1 + r.k % 2 and (r.x, r.y) not in known
    with pytest.raises(ValueError, match="no synthetic"):
        records.count_matched_negatives(rows, donors.filter("x = 'a' AND y = 1"), "k", ["x", "y"], "n", donors, 3, attempts=2, rounds=1)


def test_files(tmp_path, spark):
    a = tmp_path / "a.txt"
    a.write_text("one")
    copy = records.working_copy(a, tmp_path / "c")
    assert copy.read_text() == "one" and records.working_copy(a, tmp_path / "c") == copy
    with pytest.raises(ValueError, match="input too"):
        records.refuse_aliases([tmp_path / "x" / ".." / "a.txt"], [a])
    records.store_payload(tmp_path / "p", {"1.json": 1, "2.json": 2})
    records.store_payload(tmp_path / "p", {"1.json": 3})
    assert [f.name for f in (tmp_path / "p").iterdir()] == ["1.json"]
    with pytest.raises(RuntimeError), records.RunRecord(tmp_path / "r.json", [a]):
        raise RuntimeError("no")
    assert json.loads((tmp_path / "r.json").read_text())["error"] == "no"
    assert records.shown_path(a, tmp_path) == "a.txt" and records.shown_path("/x/y", tmp_path) == ".../y"
    x, y = (spark.createDataFrame(r, "k int, v string") for r in ([(1, "1.0"), (2, "q")], [(1, "1.00000000001"), (2, "p"), (3, "z")]))
    assert sorted(map(tuple, records.golden_differences(x, y, ["k"]).collect())) == [(2, "v", "q", "p"), (3, "v", None, "z")]


def test_command_line(spark, tmp_path, capsys):
    spark.range(10).write.parquet(str(tmp_path / "in"))
    assert cli.main(["shards", str(tmp_path / "in"), "--key", "id", "--output", str(tmp_path / "out"), "--splits", "3"], spark) == 0
    assert json.loads(capsys.readouterr().out) == {"rows": 10, "splits": 3} and spark.read.parquet(str(tmp_path / "out")).count() == 10
    spark.createDataFrame([(1, "m", "P", "P")], "index int, model string, gold string, predicted string").write.parquet(str(tmp_path / "p"))
    assert cli.main(["score", str(tmp_path / "p")], spark) == 0 and json.loads(capsys.readouterr().out)["accuracy"] == 1.0
    spark.createDataFrame([(2,)], "y int").withColumn("p", F.lit(0.5)).write.parquet(str(tmp_path / "c"))
    assert cli.main(["calibration", str(tmp_path / "c")], spark) == 1
    assert set(cli.COMMANDS) >= {"curation", "prepare", "ablations", "grid", "match"}
