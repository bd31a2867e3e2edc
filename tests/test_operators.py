"""Filters, scores, actions, merges, edits, medians and the price model."""

import datetime as dt
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestead import catalog as cat
from lodestead.operators import decision, medians, merge, price_model, reconcile, score
from lodestead.operators import people as people_rows
from lodestead.sources.preferences import HardFilter, Preferences, load_preferences, people, read_documents, select_person
from lodestead.sources.tables import conform


def listings(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def reasons(spark, rows, schema, **rules):
    df = listings(spark, rows, schema)
    person = Preferences("p", [HardFilter.parse(k, v) for k, v in rules.items()], {})
    got = score.score_wide(df, [person]).collect()
    return {r["listing_id"]: r["p_hard_filter_reasons"] for r in got}


def test_filters_and_nulls(spark):
    rows = [("a", 1300.0, "Glebe", 1), ("b", None, None, None), ("c", 900.0, "O'Brien", 0)]
    got = reasons(
        spark, rows, "listing_id string, weekly_rent_aud double, suburb string, pet_friendly int",
        max_weekly_rent_aud=1200, min_weekly_rent_aud=1000, excluded_suburb=["Glebe"], allowed_suburb=["Glebe"], pet_friendly_required=True,
    )
    assert got["a"] == "weekly_rent_aud = 1300.0 > max 1200.0; suburb = 'Glebe' is in excluded list ['Glebe']"
    assert got["b"] == "pet_friendly required but missing/false"
    assert got["c"] == (
        "weekly_rent_aud = 900.0 < min 1000.0; suburb = \"O'Brien\" not in allowed ['Glebe']; pet_friendly required but missing/false"
    )


def test_filter_grammar(spark):
    rows, schema = [("a", 3)], "listing_id string, bedrooms int"
    assert reasons(spark, rows, schema, max_nothing=1, allowed_suburbs=["x"], bedrooms_required=False)["a"] == ""
    assert reasons(spark, rows, schema, garden_required=True)["a"] == "garden required but missing/false"
    assert reasons(spark, rows, schema, allowed_bedrooms=[1, 2])["a"] == "bedrooms = 3 not in allowed [1.0, 2.0]"
    # prefixes come before the suffix
    assert HardFilter.parse("max_x_required", 1) == HardFilter("max", "x_required", 1)
    with pytest.raises(ValueError, match="rent_at_most"):
        HardFilter.parse("rent_at_most", 3)
    told = score.unknown_columns(listings(spark, rows, schema), [Preferences("p", [HardFilter("max", "moon", 1)])])
    assert [tuple(r) for r in told.collect()] == [("p", "max", "moon")]


def test_text_and_date_thresholds(spark):
    rows = [("a", dt.date(2026, 9, 1)), ("b", dt.date(2026, 12, 1))]
    got = reasons(spark, rows, "listing_id string, available_from date", max_available_from="2026-10-01")
    assert got == {"a": "", "b": "available_from = 2026-12-01 > max 2026-10-01"}


def test_scores(spark):
    rows = [("a", 100.0, 1, "Glebe"), ("b", 300.0, None, None), ("c", None, 0, "Bondi")]
    df = listings(spark, rows, "listing_id string, weekly_rent_aud double, pool int, suburb string")
    person = Preferences("p", [], {"weekly_rent_aud": -1.0, "pool": 0.5, "preferred_suburbs": 1.0, "gone": 3.0, "suburb": 0.0}, ["Glebe"])
    got = {r["listing_id"]: r for r in score.score_all(df, [person]).collect()}
    assert {k: r["raw_score"] for k, r in got.items()} == {"a": 1.5, "b": -0.75, "c": -0.5}
    assert (got["a"]["fit_score"], got["b"]["fit_score"]) == (10.0, 0.0)
    assert got["c"]["fit_score"] == 1.1 and got["c"]["hard_filter_pass"]


def test_flat_scores_are_neutral(spark):
    df = listings(spark, [("a", 5.0), ("b", 5.0)], "listing_id string, bathrooms double")
    got = score.score_all(df, [Preferences("p", [], {"bathrooms": 1.0}), Preferences("q")]).collect()
    assert {r["fit_score"] for r in got} == {5.0} and len(got) == 4
    assert score.score_wide(df, []).columns == df.columns


def test_combined(spark):
    df = listings(spark, [(9.0, 3.0), (0.0, 8.0), (7.0, 7.0)], "a double, b double")
    got = [r[0] for r in df.select(score.harmonic_mean([F.col("a"), F.col("b")])).collect()]
    assert got == [4.5, 0.0, 7.0]
    assert df.select(score.harmonic_mean([])).first()[0] is None


@pytest.mark.parametrize(
    "row, action",
    [
        ((" seen", True, True, 9.0, 9.0), " seen"),
        (("  ", False, False, 9.0, 9.0), "skip -- hard filter failed (x, y)"),
        ((None, True, False, 9.0, 9.0), "skip -- hard filter failed (y)"),
        ((None, True, True, None, 9.0), "awaiting rating"),
        ((None, True, True, 9.0, 6.0), "discuss -- scores diverge"),
        ((None, True, True, 7.0, 9.0), "worth inspecting"),
        ((None, True, True, 3.0, 2.0), "skip -- low rating"),
        ((None, True, True, 6.0, 7.0), "maybe"),
    ],
)
def test_actions(spark, row, action):
    df = listings(spark, [row], "status string, x_hard_filter_pass boolean, y_hard_filter_pass boolean, x_rating double, y_rating double")
    assert df.select(decision.suggested_action(["x", "y"])).first()[0] == action
    if action == "maybe":
        assert df.select(decision.suggested_action([])).first()[0] == "awaiting rating"


def test_preferences(spark, tmp_path):
    (tmp_path / "p.json").write_text(
        '{"person": "zoe", "hard_filters": {"max_weekly_rent_aud": 1200, "excluded_suburb": ["A", "B"], "pet_friendly_required": false}, "weights": {"pool": -0.5}}\n'
        '{"person": "example", "weights": {"pool": 1}}\n'
        '{"person": "abe", "preferred_suburbs": ["Glebe"]}\n'
    )
    loaded = load_preferences(*read_documents(spark, str(tmp_path / "p.json")))
    assert people(loaded) == ["abe", "zoe"]
    zoe = select_person(loaded, "zoe")
    assert zoe.filters == [
        HardFilter("max", "weekly_rent_aud", 1200.0), HardFilter("excluded", "suburb", ["A", "B"]), HardFilter("required", "pet_friendly", False),
    ]
    assert zoe.weights == {"pool": -0.5} and zoe.suburbs == []
    assert select_person(loaded, "abe") == Preferences("abe", [], {}, ["Glebe"])
    with pytest.raises(LookupError):
        select_person(loaded, "example")


def test_conform_keeps_what_it_does_not_know(spark):
    df = listings(spark, [("a", 1)], "listing_id string, of_my_own int")
    assert conform(df).columns == [*cat.LISTING_COLUMNS, "of_my_own"]
    assert conform(df, keep_extra=False).schema["available_from"].dataType == cat.DATE


def test_upsert_never_erases(spark):
    stored = listings(spark, [("a", 1, "x"), ("b", 2, "y")], "listing_id string, bedrooms int, status string")
    fresh = listings(spark, [("a", None, 5.0), ("c", 3, None)], "listing_id string, bedrooms int, lat double")
    once = merge.upsert(stored, fresh)
    rows = sorted(tuple(r) for r in once.collect())
    assert rows == [("a", 1, "x", 5.0), ("b", 2, "y", None), ("c", 3, None, None)]
    assert sorted(tuple(r) for r in merge.upsert(once, fresh).collect()) == rows


def test_fold_takes_the_last_known_value(spark):
    from lodestead.sources.pages import file_order

    batch = listings(spark, [("a", "z.html", 1, None), ("a", "b.htm", None, 2.0), ("a", "a.htm", 7, 3.0)], "listing_id string, source_file string, bedrooms int, lat double")
    assert tuple(merge.fold_batch(batch, "listing_id", file_order(F.col("source_file"))).first()) == ("a", "b.htm", 7, 2.0)


def test_overrides(spark):
    df = conform(listings(spark, [("a", 1, 2.0)], "listing_id string, bedrooms int, land_size_sqm double"))
    over = listings(
        spark,
        [("a", "bedrooms", "4.0", 1), ("a", "bedrooms", "5.0", 2), ("a", "available_from", "2026-01-02", 1), ("a", "land_size_sqm", "bad", 1), ("a", "nothing", "1", 1)],
        "listing_id string, column_name string, value string, set_at int",
    )
    row = merge.apply_overrides(df, over).first()
    assert (row["bedrooms"], row["land_size_sqm"], row["available_from"]) == (5, 2.0, dt.date(2026, 1, 2))


def test_publishing_then_reading_back_corrects_nothing(spark):
    rows = [("a", "1 X St", 1, 0, 12, dt.date(2026, 5, 6), 250.5), ("b", "2 X St", None, 1, None, None, None)]
    df = conform(listings(spark, rows, "listing_id string, address string, pool int, gym int, lease_term_months int, available_from date, land_size_sqm double"))
    snapshot = reconcile.detail_snapshot(df)
    sheet = reconcile.detail_sheet(df)
    assert reconcile.detail_corrections(sheet, snapshot).count() == 0
    assert reconcile.detail_issues(sheet).count() == 0
    edited = sheet.withColumn("Lease term (months)", F.lit("24")).withColumn("Available from", F.lit("soon"))
    got = sorted(tuple(r) for r in reconcile.detail_corrections(edited, snapshot).collect())
    assert got == [("a", "lease_term_months", "24.0"), ("b", "lease_term_months", "24.0")]
    assert {(r["subject"], r["raw"]) for r in reconcile.detail_issues(edited).collect()} == {("a", "soon"), ("b", "soon")}


def test_later_edit_rows_win(spark):
    sheet = listings(spark, [("a", "new", "3", 0), ("a", "old", "9", 1)], "listing_id string, status string, p_rating string, row long")
    assert reconcile.status_edits(sheet).first()["status"] == "old"
    got = reconcile.rating_edits(sheet, ["p", "q"]).collect()
    assert [(r["person"], r["score"], r["comment"]) for r in got] == [("p", 9.0, None)]


def test_medians(spark):
    values = [float((i * 7919) % 1009) / 7 for i in range(1001)] + [float("nan")]
    rows = [
        (v, v if i % 3 else None, None, 1e308 if i < 400 else -1e308, float(i % 2), float("inf") if i < 700 else float("-inf"))
        for i, v in enumerate(values)
    ]
    df = listings(spark, rows, "a double, b double, c double, d double, e double, f double")
    got = medians.exact_medians(df, list("abcdef"))
    known = [v for v in values if v == v]
    assert got["a"] == float(np.median(known))
    assert got["b"] == float(np.median([v for i, v in enumerate(values) if i % 3 and v == v]))
    assert (got["c"], got["d"], got["e"], got["f"]) == (None, -1e308, 0.5, float("inf"))


def test_median_of_a_number_and_infinity(spark):
    df = spark.createDataFrame([(1.0, None), (float("inf"), None)], "a double, b double")
    assert medians.exact_medians(df, ["a", "b"]) == {"a": float("inf"), "b": None}
    assert medians.exact_medians(df.limit(0), ["a"]) == {"a": None}


def rent_table(spark, n):
    rows = [
        (f"l{i}", 300.0 + 60 * (i % 5) + (i * 37 % 100), i % 5, i % 3 if i % 7 else None, f"s{i % 6}" if i % 11 else "rare", "House" if i % 2 else None, i % 2)
        for i in range(n)
    ]
    return conform(listings(spark, rows, "listing_id string, weekly_rent_aud double, bedrooms int, bathrooms int, suburb string, property_type string, pool int"))


def closed_form(matrix, y, train):
    x = matrix[train]
    mean, level = x.mean(axis=0), y[train].mean()
    centred = x - mean
    w = np.linalg.solve(centred.T @ centred + np.eye(x.shape[1]), centred.T @ (y[train] - level))
    return lambda rows: level + (rows - mean) @ w


def test_ridge_is_the_closed_form(spark):
    df = rent_table(spark, 80)
    pdf = price_model.feature_matrix(df).toPandas()
    scalars = pdf[price_model.ALL_FEATURES.scalar_columns].to_numpy(dtype=float)
    hot = [np.equal.outer(pdf[c].to_numpy(), sorted(set(pdf[c]))).astype(float) for c in ("property_label", "suburb_bucket")]
    matrix, y = np.hstack([scalars, *hot]), pdf["weekly_rent_aud"].to_numpy()
    folds = {r[0]: r[1] for r in df.select("listing_id", price_model.fold_of(F.col("listing_id"))).collect()}
    fold = np.array([folds[i] for i in pdf["listing_id"]])
    want = np.empty(len(y))
    for k in range(5):
        want[fold == k] = closed_form(matrix, y, fold != k)(matrix[fold == k])
    got = {r["listing_id"]: r["predicted_weekly_rent"] for r in price_model.predict_value(df).collect()}
    assert max(abs(got[i] - p) for i, p in zip(pdf["listing_id"], want)) < 1e-4
    assert set(pdf["property_label"]) == {"House", "unknown"} and "other" not in set(pdf["suburb_bucket"])


def test_small_tables_are_in_sample(spark):
    with pytest.warns(UserWarning, match="in-sample"):
        assert price_model.predict_value(rent_table(spark, 6)).count() == 6


def test_no_rents_no_signal(spark):
    df = rent_table(spark, 3).withColumn("weekly_rent_aud", F.lit(None).cast("double"))
    assert price_model.predict_value(df).count() == 0
    signal = price_model.with_price_signal(df)
    assert signal.count() == 3 and signal.first()["predicted_weekly_rent"] is None


def test_constant_rent(spark):
    df = rent_table(spark, 30).withColumn("weekly_rent_aud", F.lit(500.0))
    assert {round(r["predicted_weekly_rent"], 6) for r in price_model.predict_value(df).collect()} == {500.0}


def test_models_compared(spark):
    from functools import partial

    features = price_model.Features(numeric=("bedrooms",), flagged=(), amenities=(), categorical=False)
    models = {"ridge": price_model.ridge, "boosted_trees": partial(price_model.boosted_trees, rounds=2)}
    rows = price_model.compare_models(rent_table(spark, 120), models, features=features).collect()
    assert [r["model"] for r in rows] == ["ridge", "boosted_trees"] and all(r["n"] == 120 and r["mae"] < 60 for r in rows)


def test_people_as_rows(spark):
    """Scores of people in tables are those of people in columns, for every kind of rule and weight."""
    schema = "listing_id string, weekly_rent_aud double, suburb string, pet_friendly int, pool int, available_from date, bathrooms int"
    rows = [
        ("a", 1300.0, "Glebe", 1, 1, dt.date(2026, 9, 1), 1), ("b", None, None, None, None, None, None), ("c", 900.0, "O'Brien", 0, 0, dt.date(2026, 12, 1), 3),
        ("d", float("nan"), 'x "y"', 1, None, None, 2), ("e", 900.0, "", 0, 1, dt.date(2027, 1, 1), 2),
    ]
    df = listings(spark, rows, schema)
    rules = lambda **r: [HardFilter.parse(k, v) for k, v in r.items()]
    folk = [
        Preferences("p", rules(max_weekly_rent_aud=1200, excluded_suburb=["Glebe", "O'Brien"], allowed_suburb=["Glebe"], pet_friendly_required=True, suburb_required=True)),
        Preferences("q", rules(min_weekly_rent_aud=1000.5, max_available_from="2026-10-01", available_from_required=True, garden_required=True, max_moon=3, pool_required=False, allowed_bathrooms=[1, 2], excluded_bathrooms=[2.0], allowed_pool=[])),
        Preferences("r", [], {"weekly_rent_aud": -1.0, "pool": 0.5, "preferred_suburbs": 1.0, "gone": 3.0, "suburb": 0.2, "bathrooms": 0.3, "pet_friendly": 0.0, "available_from": 0.1}, ["Glebe", "O'Brien"]),
        Preferences("s"),
    ]
    key = lambda r: (r.listing_id, r.person)
    columns = ["listing_id", "person", "hard_filter_pass", "hard_filter_reasons", "raw_score", "fit_score"]
    expected = score.score_all(df, folk).select(columns).collect()
    tables = people_rows.tables_of(spark, folk)
    found = people_rows.score_people(df, *tables).select(columns).collect()
    assert sorted(found, key=key) == sorted(expected, key=key) and len(found) == 20
    told = people_rows.unknown_columns(tables[0], df.columns).collect()
    assert sorted(map(tuple, told)) == [("q", "max", "moon"), ("q", "required", "garden")]
    assert people_rows.score_people(df, *(t.limit(0) for t in tables)).count() == 0
    assert people_rows.score_people(df.limit(0), *tables).count() == 0
    wrong = spark.createDataFrame([("p", "rent_at_most", 3.0, None, None, None, 0)], "person string, key string, num double, text string, list array<string>, `on` boolean, pos int")
    with pytest.raises(Exception, match="rent_at_most"):
        people_rows.score_people(df, wrong, *tables[1:]).collect()


def test_two_thousand_people(spark, monkeypatch):
    """The plan does not grow with the people, with or without broadcasts."""
    df = listings(spark, [(str(i), 100.0 + i, i % 3) for i in range(40)], "listing_id string, weekly_rent_aud double, bathrooms int")
    weights = spark.range(4000).selectExpr("concat('p', CAST(id % 2000 AS STRING)) AS person", "CASE WHEN id < 2000 THEN 'weekly_rent_aud' ELSE 'bathrooms' END AS feature", "CAST(id % 7 - 3 AS DOUBLE) AS weight", "CAST(id AS INT) AS pos")
    filters = spark.range(2000).selectExpr("concat('p', CAST(id AS STRING)) AS person", "'max_weekly_rent_aud' AS key", "100e0 + id % 50 AS num", "CAST(NULL AS STRING) AS text", "CAST(NULL AS array<string>) AS list", "CAST(NULL AS boolean) AS `on`", "0 AS pos")
    suburbs = spark.createDataFrame([], "person string, suburb string")

    def plan(n):
        few = f"CAST(substring(person, 2) AS INT) < {n}"
        found = people_rows.score_people(df, filters.where(few), weights.where(few), suburbs)
        return found, len(found._jdf.queryExecution().optimizedPlan().toString().splitlines())

    many, size = plan(2000)
    assert size == plan(2)[1] and many.count() == 80_000
    one = {(r.listing_id, r.person): tuple(r) for r in many.collect()}
    assert one["7", "p1003"][2:4] == (False, "weekly_rent_aud = 107.0 > max 103.0") and one["7", "p1008"][2]
    person = Preferences("p9", [HardFilter("max", "weekly_rent_aud", 109.0)], {"weekly_rent_aud": float(9 % 7 - 3), "bathrooms": float(2009 % 7 - 3)})
    assert [one[r.listing_id, "p9"] for r in score.score_all(df, [person]).select(many.columns).collect()] == [tuple(r) for r in score.score_all(df, [person]).select(many.columns).collect()]
    monkeypatch.setattr(people_rows, "is_small", lambda df: False)
    assert {(r.listing_id, r.person): tuple(r) for r in plan(2000)[0].collect()} == one


def left_over(df, alpha=1.0):
    columns, model, used = price_model.ridge_models(df, price_model.ALL_FEATURES, 5, in_sample=False)
    x, fold = price_model._scalars(price_model.ALL_FEATURES), price_model.fold_of(F.col("listing_id"))
    return model, price_model.fold_ridge.gradients(price_model.priced(columns), model, x, fold, used, alpha, "weekly_rent_aud")


def many_listings(spark, n, suburbs):
    return conform(spark.range(n).selectExpr(
        "CAST(id AS STRING) AS listing_id", f"concat('s', CAST(id % {suburbs} AS STRING)) AS suburb", "concat('t', CAST(id % 3 AS STRING)) AS property_type",
        f"300e0 + id % {suburbs} % 7 * 20 + id % 3 * 50 + id % 11 AS weekly_rent_aud", "CAST(id % 5 AS INT) AS bedrooms",
    ))


def test_ridge_of_very_many_suburbs(spark):
    """Suburbs are no columns: 100,000 of them are eliminated one by one, and every fold's weights solve its own equations."""
    model, left = left_over(many_listings(spark, 300_000, 100_000))
    assert model.suburbs.count() == 100_000 and model.core.shape == (5, 1 + len(model.scalars) + 3)
    found = left.agg(F.count("*").alias("n"), F.max(F.abs("gradient")).alias("most")).first()
    assert found.n == 5 * (1 + len(model.scalars) + 3 + 100_000) and found.most < 1e-8


def test_gradients_tell_other_weights_apart(spark):
    df = many_listings(spark, 300, 20)
    assert left_over(df)[1].agg(F.max(F.abs("gradient"))).first()[0] < 1e-9
    assert left_over(df, alpha=1.5)[1].agg(F.max(F.abs("gradient"))).first()[0] > 1e-3


def test_sorted_signal_is_predicted_once(spark):
    """The sort of the price signal starts from predicted rows; it looks at them twice."""
    from lodestead.queries import QUERIES

    plan = QUERIES["value_signal_full"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort" in plan and "zip_with" not in plan and "Join" not in plan
