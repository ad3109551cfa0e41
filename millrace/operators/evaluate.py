"""Scores of extracted records: projections, matches of profiles, margins, outcomes, repeated rounds, guards of inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import is_filled
from millrace.functions.values import in_unit, loosely_same
from millrace.operators.joins import hamming_nearest, small
from millrace.operators.rules import expect_none, expect_unique

#: Amounts of two recipes that differ by this share of the larger one are equal.
AMOUNT_TOLERANCE = 0.05


def project_record(df: DataFrame, names: dict[str, str], amounts: Sequence[str], numbers: dict[str, str], keep: Sequence[str]) -> DataFrame:
    """The fields that are scored, with what stands in for an empty one.

    names: {name: short form}; amounts: stems whose text is else value and unit; numbers: {number: its text}.
    """
    filled = lambda c: F.when(is_filled(F.col(c)), F.trim(F.col(c).cast("string")))
    out = {n: F.coalesce(filled(n), filled(short)) for n, short in names.items()}
    for stem in amounts:
        made = F.when(filled(f"{stem}_amount_value").isNotNull(), F.concat_ws(" ", filled(f"{stem}_amount_value"), filled(f"{stem}_amount_unit")))
        out[f"{stem}_amount_text"] = F.coalesce(filled(f"{stem}_amount_text"), made)
    out |= {n: F.coalesce(filled(n), filled(text)) for n, text in numbers.items()}
    return df.select(*keep, *(F.coalesce(c, F.lit("")).alias(n) for n, c in out.items()))


def best_and_margin(scores: DataFrame, by: Sequence[str], candidate: str, score: str, close: float = 0.03) -> DataFrame:
    """(by, best, best_score, second_score, margin, ambiguous): the best candidate of each group, ties by the smaller one."""
    rank = Window.partitionBy(*by).orderBy(F.desc(score), candidate)
    two = scores.withColumn("_nth", F.row_number().over(rank)).filter("_nth <= 2").groupBy(*by).agg(
        F.max(F.when(F.col("_nth") == 1, F.col(candidate))).alias("best"), F.max(F.when(F.col("_nth") == 1, F.col(score))).alias("best_score"), F.max(F.when(F.col("_nth") == 2, F.col(score))).alias("second_score")
    )
    margin = F.col("best_score") - F.col("second_score")
    return two.withColumns({"margin": margin, "ambiguous": F.coalesce(margin <= close, F.lit(False))})


def differs(field: str, kind: str, tolerance: float = AMOUNT_TOLERANCE) -> Column:
    """Whether a candidate's field (c_ columns) is a change from its parent's (p_ columns).

    A blank parent is no conflict. Amounts are compared in the parent's unit; units of other dimensions cannot tell.
    kind: amount, number or name; names match as whole tokens or by their short forms.
    """
    c, p = F.col(f"c_{field}"), F.col(f"p_{field}")
    known, given = is_filled(p.cast("string")), is_filled(c.cast("string"))
    if kind == "name":
        low = lambda x: F.lower(F.trim(x))
        same = (low(c) == low(p)) | loosely_same(c, p)
        return F.when(~known, False).when(~given, True).otherwise(~F.coalesce(same, F.lit(False)))
    a, b = c.cast("string").try_cast("double"), p.cast("string").try_cast("double")
    if kind == "amount":
        unit = field.replace("_value", "_unit")
        a = in_unit(a, F.col(f"c_{unit}"), F.col(f"p_{unit}"))
        gap = F.abs(a - b) > tolerance * F.greatest(F.abs(a), F.abs(b), F.lit(1e-12))
        return F.when(~known, False).when(~given, True).otherwise(F.coalesce(gap, F.lit(False)))
    gap = F.abs(a - b) > tolerance * F.greatest(F.abs(a), F.abs(b), F.lit(1e-12))
    return F.when(~known, False).when(~given, True).otherwise(F.coalesce(gap, ~c.cast("string").eqNullSafe(p.cast("string"))))


def compare_with_parent(candidates: DataFrame, parents: DataFrame, on: dict[str, str], fields: dict[str, str], exempt: str | None = None) -> DataFrame:
    """Candidates with changed (the fields that differ from their parent, in order) and consistent.

    fields: {field: amount | number | name}. exempt: a column with the fields that a candidate may change.
    """
    units = [f.replace("_value", "_unit") for f, kind in fields.items() if kind == "amount"]
    c = candidates.select(*candidates.columns, *(F.col(f).alias(f"c_{f}") for f in (*fields, *units)))
    p = parents.select(*(F.col(b).alias(f"_on_{a}") for a, b in on.items()), *(F.col(f).alias(f"p_{f}") for f in (*fields, *units)))
    hit = None
    for a in on:
        one = F.col(a) == F.col(f"_on_{a}")
        hit = one if hit is None else hit & one
    joined = c.join(p, hit, "left")
    changed = F.array_compact(F.array(*(F.when(differs(f, kind), F.lit(f)) for f, kind in fields.items())))
    out = joined.withColumn("changed", changed)
    free = F.col(exempt) if exempt else F.array().cast("array<string>")
    return out.withColumn("consistent", F.size(F.array_except("changed", free)) == 0).select(*candidates.columns, "changed", "consistent")


def match_controls(rows: DataFrame, controls: DataFrame, doc: str, row: str, control: str, fields: dict[str, str]) -> DataFrame:
    """(row, control): the controls of a row's document whose known fields all agree and that lack no field of the row."""
    units = [f.replace("_value", "_unit") for f, kind in fields.items() if kind == "amount"]
    c = rows.select(doc, row, *(F.col(f).alias(f"c_{f}") for f in (*fields, *units)))
    p = controls.select(F.col(doc).alias("_doc"), control, *(F.col(f).alias(f"p_{f}") for f in (*fields, *units)))
    agree = F.lit(True)
    for f, kind in fields.items():
        extra = is_filled(F.col(f"c_{f}").cast("string")) & ~is_filled(F.col(f"p_{f}").cast("string"))
        agree = agree & ~differs(f, kind) & ~extra
    # a document has a few controls, so pairs are few times the rows
    return c.join(p, F.col(doc) == F.col("_doc")).filter(agree).select(row, control)


def row_outcomes(rows: DataFrame, classes: Sequence[str], changed: str, fits: str, dropped: str) -> DataFrame:
    """rows with an outcome column for each class: TP or FP where the row changed it, TN where it fits without, else null."""
    of = lambda c: F.when(F.col(dropped), None).when(F.array_contains(changed, c), F.when(F.col(fits), "TP").otherwise("FP")).when(F.col(fits), "TN")
    return rows.withColumns({f"outcome_{c}": of(c) for c in classes})


def changed_classes(anchors: DataFrame, by: Sequence[str], kind: str, parent_fits: str) -> DataFrame:
    """(by, changed, fallback): the classes of the anchors that the parent does not satisfy, else of all of them."""
    both = anchors.filter(F.col(kind).isNotNull()).groupBy(*by).agg(F.array_sort(F.collect_set(F.when(~F.col(parent_fits), F.col(kind)))).alias("_own"), F.array_sort(F.collect_set(kind)).alias("_all"))
    return both.select(*by, F.when(F.size("_own") > 0, F.col("_own")).otherwise(F.col("_all")).alias("changed"), (F.size("_own") == 0).alias("fallback"))


def window_table(rows: DataFrame, windows: DataFrame, window: str, doc: str, expected: str, fits: str = "fits") -> DataFrame:
    """(doc, window, expected, filled, missed, complete): how many rows fit each window, up to what it expects."""
    held = rows.filter(F.col(fits)).groupBy(F.col(window).alias("_w")).agg(F.count("*").alias("_n"))
    joined = windows.join(held, F.col(window) == F.col("_w"), "left")
    filled = F.least(F.coalesce("_n", F.lit(0)), F.col(expected)).cast("bigint")
    return joined.select(doc, window, F.col(expected).cast("bigint").alias("expected"), filled.alias("filled"), (F.col(expected) - filled).cast("bigint").alias("missed"), (filled >= F.col(expected)).alias("complete"))


def paper_table(windows: DataFrame, doc: str) -> DataFrame:
    """(doc, n_windows, n_complete, expected, filled, recall, complete) over a window table."""
    out = windows.groupBy(doc).agg(F.count("*").alias("n_windows"), F.count_if("complete").alias("n_complete"), F.sum("expected").alias("expected"), F.sum("filled").alias("filled"))
    return out.withColumns({"recall": F.try_divide("filled", "expected"), "complete": F.col("n_complete") == F.col("n_windows")})


def per_round(df: DataFrame, group: Sequence[str], rounds: str, value: Column, sample: bool = True) -> DataFrame:
    """(group, n_rounds, mean, sd) of a metric worked out in each round; sd of a sample or of all rounds."""
    each = df.groupBy(*group, rounds).agg(F.avg(value.cast("double")).alias("_m"))
    sd = F.stddev_samp("_m") if sample else F.stddev_pop("_m")
    return each.groupBy(*group).agg(F.count("*").alias("n_rounds"), F.avg("_m").alias("mean"), sd.alias("sd"))


def distance_counts(nearest: DataFrame, distance: str, single: str, fields: Sequence[str]) -> DataFrame:
    """(what, n): rows by distance (3 and more together), and rows whose only changed field may be each field."""
    d = F.when(F.col(distance) >= 3, "distance_ge3").otherwise(F.concat(F.lit("distance_"), F.col(distance).cast("string")))
    whats = F.concat(F.array(F.lit("rows"), d), F.transform(F.array_intersect(F.col(single), F.array(*map(F.lit, fields))), lambda f: F.concat(F.lit("single_"), f)))
    return nearest.select(F.explode(whats).alias("what")).groupBy("what").agg(F.count("*").alias("n"))


def recipe_key(doc: Column, fields: dict[str, Column]) -> Column:
    """One hash for equal recipes: fields by name, texts in lower case, numbers without their notation."""
    def plain(c: Column) -> Column:
        text = F.regexp_replace(F.lower(F.trim(F.translate(c.cast("string"), "′’", "''"))), r"\s+", " ")
        number = text.try_cast("double")
        return F.when(text.isin("", "none", "null", "nan"), None).when(number.isNotNull() & ~F.isnan(number), number.cast("string")).otherwise(text)

    return F.sha2(F.to_json(F.struct(F.lower(F.trim(doc)).alias("doc"), *(plain(fields[n]).alias(n) for n in sorted(fields))), {"ignoreNullFields": "false"}), 256)


def check_calibration(df: DataFrame, label: str, probabilities: Sequence[str]) -> DataFrame:
    """The rows as they are; an error for a label that is not 0 or 1, or a probability outside [0, 1]. No row is dropped."""
    bad = ~F.coalesce(F.col(label).isin(0, 1), F.lit(False))
    for p in probabilities:
        bad = bad | ~F.coalesce(F.col(p).between(0, 1) & ~F.isnan(p), F.lit(False))
    expect_none(df.filter(bad), "labels must be 0 or 1 and probabilities in [0, 1]")
    return df


def score_predictions(df: DataFrame, index: str, model: str, gold: str, predicted: str, labels: Sequence[str] = ("P", "N")) -> dict[str, float]:
    """Coverage, errors and scores of saved predictions; an error for repeated indices or more than one model."""
    expect_unique(df, [index])
    found = df.agg(F.count_distinct(model).alias("models")).first()
    if found["models"] > 1:
        raise ValueError("predictions of more than one model")
    first, answered = labels[0], F.col(predicted).isin(*labels)
    n = df.agg(
        F.count("*").alias("rows"), F.count_if(answered).alias("answered"), F.count_if(answered & (F.col(gold) == F.col(predicted))).alias("right"),
        F.count_if((F.col(gold) == first) & (F.col(predicted) == first)).alias("tp"), F.count_if((F.col(gold) != first) & (F.col(predicted) == first)).alias("fp"), F.count_if((F.col(gold) == first) & answered & (F.col(predicted) != first)).alias("fn"),
    ).first()
    over = lambda a, b: a / b if b else 0.0
    precision, recall = over(n["tp"], n["tp"] + n["fp"]), over(n["tp"], n["tp"] + n["fn"])
    return {"rows": n["rows"], "coverage": over(n["answered"], n["rows"]), "errors": n["rows"] - n["answered"], "accuracy": over(n["right"], n["answered"]), "precision": precision, "recall": recall, "f1": over(2 * precision * recall, precision + recall)}


def check_resume(saved: DataFrame, inputs: DataFrame, index: str, same: Sequence[str]) -> DataFrame:
    """The inputs that are still open; an error if a saved row is unknown or its fields are not those of its input."""
    a = saved.select(F.col(index).alias("_i"), *(F.col(c).alias(f"_{c}") for c in same))
    joined = a.join(inputs, F.col("_i") == F.col(index), "left")
    changed = F.col(index).isNull()
    for c in same:
        changed = changed | ~F.col(f"_{c}").eqNullSafe(F.col(c))
    expect_none(joined.filter(changed).select("_i"), "saved rows differ from the inputs")
    return inputs.join(a.select(F.col("_i").alias(index)).distinct(), index, "left_anti")


def check_groups_alike(df: DataFrame, group: str, same: Sequence[str]) -> None:
    """An error if the rows of a group differ in any of the columns."""
    expect_none(df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count_distinct(F.to_json(F.struct(*same), {"ignoreNullFields": "false"})).alias("n")).filter("n > 1"), "groups whose rows differ")


def check_unchanged(before: DataFrame, after: DataFrame, where: Column) -> None:
    """An error unless the rows where the condition holds are the same, with the same repeats, in both."""
    a, b = before.filter(where), after.filter(where).select(*before.columns)
    expect_none(a.exceptAll(b).unionByName(b.exceptAll(a)), "rows that had to stay have changed")


def nearest_positives(negatives: DataFrame, positives: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, nearest, distance) of each negative among the positives; an error for one that equals a positive."""
    out = hamming_nearest(negatives, positives.withColumnRenamed(key, "nearest"), key, "nearest", list(fields))
    expect_none(out.filter("distance = 0"), "negatives that equal a positive")
    return out


def readiness(rows: DataFrame, key: str, files: DataFrame, stem: str, text: str) -> DataFrame:
    """One row (rows, keys, repeated_keys, missing_files, empty_texts) of what is there to be read."""
    there = files.select(F.lower(stem).alias("_s")).distinct().withColumn("_there", F.lit(True))
    per = rows.groupBy(F.lower(key).alias("k")).agg(F.count("*").alias("n"), F.max(is_filled(F.col(text))).alias("any_text")).join(there, F.col("k") == F.col("_s"), "left")
    return per.agg(F.sum("n").alias("rows"), F.count("*").alias("keys"), F.count_if(F.col("n") > 1).alias("repeated_keys"), F.count_if(F.col("_there").isNull()).alias("missing_files"), F.count_if(~F.col("any_text")).alias("empty_texts"))


def reuse_counts(wanted: DataFrame, counted: DataFrame, columns: Sequence[str], count: str) -> DataFrame:
    """wanted with the count of a row that is the same in all columns, else null: what has to be counted again."""
    known = counted.groupBy(*(F.col(c).alias(f"_{c}") for c in columns)).agg(F.max(count).alias(count))
    hit = None
    for c in columns:
        one = F.col(c).eqNullSafe(F.col(f"_{c}"))
        hit = one if hit is None else hit & one
    return wanted.join(known, hit, "left").select(*wanted.columns, count)


def rewrite_units(rules: DataFrame, listed: DataFrame, doc: str, field: str, factors: dict[str, float]) -> DataFrame:
    """Rules of the listed documents with their values multiplied by the factor of the rule's field."""
    wanted = listed.select(F.col(doc).alias("_d")).distinct().withColumn("_in", F.lit(True))
    marked = rules.join(small(wanted), F.col(doc) == F.col("_d"), "left")
    by = F.lit(1.0)
    for name, factor in factors.items():
        by = F.when(F.col(field) == name, factor).otherwise(by)
    new = {v: F.when(F.col("_in") & F.col(v).try_cast("double").isNotNull() & (by != 1.0), (F.col(v).try_cast("double") * by).cast("string")).otherwise(F.col(v)) for v in ("value_1", "value_2")}
    return marked.withColumns(new).select(*rules.columns)
