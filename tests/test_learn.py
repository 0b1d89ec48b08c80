from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerscope import schema as S
from ledgerscope.operators import learn, trials
from ledgerscope.operators.evaluate import ranking_report
from ledgerscope.operators.resample import permuted_pieces, permuted_rows
from ledgerscope.operators.split import temporal_split
from ledgerscope.plans import pipeline


@pytest.fixture(scope="module")
def invoices(spark):
    rng = random.Random(1)
    rows = []
    for i in range(900):
        key = f"{rng.randrange(25):011d}"
        bad = rng.random() < (0.55 if int(key) % 3 == 0 else 0.15)
        state = "Pendiente / Borrador" if rng.random() < 0.2 else "Rechazada" if bad else "Aceptada"
        issued = dt.datetime(2024, 1, 1) + dt.timedelta(days=i // 4)
        rows.append((i, f"F{i}", key, rng.choice(["Factura", "Boleta", None]), issued, issued + dt.timedelta(days=30),
                     rng.choice(["PEN", "USD"]), round(rng.uniform(10, 1000), 2), state))
    return spark.createDataFrame(
        rows, "row_no bigint, invoice_id string, supplier_key string, doc_type string, issued_ts timestamp, due_ts timestamp, currency string, amount double, state string"
    )


@pytest.fixture(scope="module")
def prepared(spark, invoices):
    registry = spark.createDataFrame(
        [(f"{i:011d}", f"Name {i}", "ACTIVO" if i % 3 else "BAJA", "HABIDO", int(i % 3 == 0)) for i in range(20)],
        "supplier_key string, legal_name string, key_status string, domicile string, irregular int",
    )
    return pipeline.prepare(invoices, registry).persist()


@pytest.fixture(scope="module")
def parts(prepared):
    rows = temporal_split(prepared.where("incident IS NOT NULL").withColumn("label", F.col("incident"))).persist()
    return {s: rows.where(F.col("split") == s) for s in ("train", "validation", "test")}


def few_models(*names):
    return [c for c in learn.candidates(trees=10, rounds=5) if c.name in names]


def test_preprocessor_fills_and_encodes(spark):
    train = spark.createDataFrame([("a", 1.0, 0), ("a", 3.0, 1), (None, None, 1), ("b'\\", 100.0, 0)], "doc_type string, amount double, label int")
    fitted = learn.fit_preprocessor(train, ["doc_type", "amount"])
    rows = spark.createDataFrame([(None, None), ("unseen", 2.0), ("b'\\", 2.0)], "doc_type string, amount double")
    got = [list(r[learn.FEATURES].toArray()) for r in fitted.transform(rows).collect()]
    assert got == [[1.0, 0.0, 3.0], [0.0, 0.0, 2.0], [0.0, 1.0, 2.0]]
    weights = learn.with_class_weight(train).groupBy("label").agg(F.sum(learn.WEIGHT).alias("w")).collect()
    assert {r["w"] for r in weights} == {2.0}


def test_missing_categories(spark):
    df = spark.createDataFrame([(None, None), ("a", 1.0)], "doc_type string, amount double")
    assert learn.fill_missing_categories(df).collect() == [("NA", None), ("a", 1.0)]


def test_settings_are_repeatable():
    grid = {"a": (1, 2, 3), "b": (1, 2, 3), "c": (1, 2)}
    drawn = learn.sample_settings(grid)
    assert len(drawn) == 8 and drawn == learn.sample_settings(grid)
    assert learn.sample_settings({"a": (1, 2)}) == [{"a": 1}, {"a": 2}]


def test_dummy_scores_the_majority(parts):
    dummy = learn.fit_candidate(few_models("dummy")[0], {}, parts["train"], S.BASE_FEATURES)
    assert learn.score_rows(dummy, parts["test"]).agg(F.max("score"), F.min("score")).first() == (0.0, 0.0)


def test_search(parts):
    table = learn.time_series_search(few_models("logistic")[0], parts["train"], S.BASE_FEATURES, max_settings=2)
    rows = table.collect()
    assert [r["folds"] for r in rows] == [3, 3] and rows[0]["mean_pr_auc"] >= rows[1]["mean_pr_auc"]
    assert set(learn.best_setting(few_models("logistic")[0], table, 2)) == {"C"}


def test_whole_pipeline(spark, prepared, parts, tmp_path):
    broken = learn.Candidate("broken", lambda setting, rows: None)
    bundle, comparison, scored = pipeline.train_and_score(
        prepared, experiments={"extended": S.FULL_FEATURES}, models=[*few_models("dummy", "logistic"), broken], search=False
    )
    metrics = {r["model"]: r for r in comparison.collect()}
    assert set(metrics) == {"dummy", "logistic"}
    assert metrics["logistic"]["pr_auc"] > metrics["dummy"]["pr_auc"]
    assert bundle.model == "logistic" and bundle.cuts[0] <= bundle.cuts[1]
    assert scored.count() == prepared.where("incident IS NULL").count()
    assert {r["tier"] for r in scored.select("tier").distinct().collect()} == set(S.TIERS)

    learn.save_bundle(spark, bundle, str(tmp_path / "bundle"))
    again = learn.load_bundle(spark, str(tmp_path / "bundle"))
    assert (again.features, again.threshold, again.cuts) == (bundle.features, bundle.threshold, bundle.cuts)
    rescored = pipeline.score_pending(prepared.where("incident IS NULL"), again)
    assert sorted(rescored.select("row_no", "tier").collect()) == sorted(scored.select("row_no", "tier").collect())
    with pytest.raises(ValueError, match="missing columns"):
        pipeline.score_pending(prepared.drop("amount"), again)


def test_calibration_evaluation_and_importance(parts):
    model = learn.fit_candidate(few_models("logistic")[0], {}, parts["train"], S.FULL_FEATURES)
    chosen, table = learn.calibrate(model, parts["validation"])
    rows = {r["method"]: r for r in table.collect()}
    assert set(rows) == {"original", "sigmoid", "isotonic"} and sum(r["selected"] for r in rows.values()) == 1
    assert rows["isotonic"]["brier"] <= rows["original"]["brier"]
    final = {r["metric"]: r for r in learn.final_evaluate(learn.score_rows(chosen, parts["test"]), 0.5, rounds=20).collect()}
    assert final["f1"]["low"] <= final["f1"]["high"] and final["roc_auc"]["low"] is None
    importance = learn.permutation_importance(model, parts["test"], S.FULL_FEATURES, repeats=2)
    assert importance.count() == len(S.FULL_FEATURES)
    # The same as when every copy is prepared anew.
    copies = permuted_rows(parts["test"].select("label", "row_no", *S.FULL_FEATURES), S.FULL_FEATURES, repeats=2)
    report = ranking_report(learn.score_rows(model, copies), within=["feature", "repeat"])
    base = ranking_report(learn.score_rows(model, parts["test"])).first()["pr_auc"]
    plain = {r["feature"]: base - r["m"] for r in report.groupBy("feature").agg(F.avg("pr_auc").alias("m")).collect()}
    assert {r["feature"]: pytest.approx(r["importance"], abs=1e-9) for r in importance.collect()} == plain


def test_features_exclude_outcomes():
    assert not set(S.FULL_FEATURES) & set(S.LEAKING_COLUMNS)
    assert len(S.BASE_FEATURES) == 20 and len(S.FULL_FEATURES) == 28


def test_broken_write_is_not_found(spark, parts, tmp_path):
    path = str(tmp_path / "bundle")
    with pytest.raises(ValueError, match="nothing published"):
        learn.load_bundle(spark, path)
    model = learn.fit_candidate(few_models("dummy")[0], {}, parts["train"], S.BASE_FEATURES)
    assert learn.save_bundle(spark, learn.Bundle(model, S.BASE_FEATURES, 0.25, (0.1, 0.2)), path) == 0

    class Broken:
        def write(self):
            model.write().save(f"{path}/versions/half/pipeline")
            raise OSError("no space left")

    with pytest.raises(OSError):
        learn.save_bundle(spark, learn.Bundle(Broken(), S.BASE_FEATURES, 0.75, (0.3, 0.4)), path)
    assert learn.load_bundle(spark, path).threshold == 0.25
    assert learn.save_bundle(spark, learn.Bundle(model, S.BASE_FEATURES, 0.5, (0.1, 0.2)), path) == 1
    assert learn.load_bundle(spark, path).threshold == 0.5


def test_trials_go_on_where_they_stopped(spark, parts, tmp_path):
    path, made = str(tmp_path / "trials"), []
    logistic = learn.Candidate("logistic", few_models("logistic")[0].build, {"C": (0.1, 1.0)}, scale=True)
    experiments = {"base": S.BASE_FEATURES, "extended": S.FULL_FEATURES}

    def breaks(*fit):
        made.append(fit)
        if len(made) == 4:
            raise OSError("executor lost for good")

    with pytest.raises(OSError):
        trials.run_trials(parts["train"], experiments, [logistic], path, at_once=1, fitted=breaks)
    kept = trials.finished_trials(spark, path).count()
    assert 3 <= kept < 12
    again = []
    found = trials.run_trials(parts["train"], experiments, [logistic], path, fitted=lambda *fit: again.append(fit))
    assert found.count() == 12 and len(again) == 12 - kept and len(set(again)) == len(again)
    none = []
    table = trials.search_table(trials.run_trials(parts["train"], experiments, [logistic], path, fitted=lambda *fit: none.append(fit)))
    assert none == [] and [r["folds"] for r in table.collect()] == [3] * 4
    plain = learn.time_series_search(logistic, parts["train"], S.BASE_FEATURES).collect()
    base = {r["setting"]: r["mean_pr_auc"] for r in table.where("experiment = 'base'").collect()}
    assert {r["setting"]: pytest.approx(r["mean_pr_auc"], abs=1e-6) for r in plain} == base
    fewer = trials.run_trials(parts["train"].where("row_no > 5"), {"base": S.BASE_FEATURES}, [logistic], path, fitted=lambda *fit: none.append(fit))
    assert len(none) == 6 and fewer.count() == 6


def test_stored_models_are_fitted_once(spark, parts, tmp_path):
    path, made, left_out = str(tmp_path / "models"), [], []
    experiments = {"base": S.BASE_FEATURES, "extended": S.FULL_FEATURES}

    def refuse(setting, rows):
        raise ValueError("no such setting")

    models = [*few_models("dummy", "logistic"), learn.Candidate("odd", refuse)]

    def breaks(*fit):
        made.append(fit)
        if len(made) == 3:
            raise OSError("executor lost for good")

    with pytest.raises(OSError):
        trials.stored_models(parts["train"], experiments, models, path, at_once=1, fitted=breaks)
    again = []
    trained = trials.stored_models(
        parts["train"], experiments, models, path, left_out=left_out, at_once=1, fitted=lambda *fit: again.append(fit)
    )
    assert not {("base", "dummy"), ("base", "logistic")} & set(again) and ("base", "odd") in again
    assert [e[:2] for e in left_out] == [("base", "odd"), ("extended", "odd")]
    none, rows = [], parts["train"].orderBy("row_no").repartition(3)
    read = trials.stored_models(rows, experiments, models[:2], path, fitted=lambda *fit: none.append(fit))
    assert none == [] and [(t.experiment, t.model) for t in read] == [(t.experiment, t.model) for t in trained]
    for before, after in zip(trained, read, strict=True):
        scores = [
            {r["row_no"]: r["score"] for r in learn.score_rows(t.pipeline, parts["validation"]).collect()} for t in (before, after)
        ]
        assert scores[0] == scores[1]
    assert learn.compare_trained(read, parts["validation"]).count() == 4
    trials.stored_models(parts["train"].where("row_no > 5"), {"base": S.BASE_FEATURES}, models[:1], path, fitted=lambda *fit: none.append(fit))
    assert none == [("base", "dummy")]


def test_stored_models_share_what_prepares_their_rows(parts, tmp_path, monkeypatch):
    experiments, models = {"base": S.BASE_FEATURES, "extended": S.FULL_FEATURES}, few_models("dummy", "logistic", "forest")
    alone = [learn.fit_candidate(m, {}, parts["train"], fs) for fs in experiments.values() for m in models]
    asked, prepared, medians, transform = [], [], learn._medians, learn.PipelineModel.transform
    monkeypatch.setattr(learn, "_medians", lambda df, columns: asked.append(list(columns)) or medians(df, columns))
    monkeypatch.setattr(learn.PipelineModel, "transform", lambda self, df: prepared.append(self) or transform(self, df))
    trained = trials.stored_models(parts["train"], experiments, models, str(tmp_path / "models"))
    monkeypatch.undo()
    assert len(asked) == 1 and len(prepared) == 4  # with and without standardization, on two sets of features
    for one, other in zip(alone, trained, strict=True):
        scores = [{r["row_no"]: r["score"] for r in learn.score_rows(m, parts["validation"]).collect()} for m in (one, other.pipeline)]
        assert scores[0] == scores[1]


def test_forest_remembers_the_nodes_of_its_rows(parts):
    forest, = few_models("forest")
    rows = learn.prepare_rows(learn.fit_preprocessor(parts["train"], S.FULL_FEATURES), learn.with_class_weight(parts["train"]))
    remembers = forest.build({}, 1)
    assert remembers.getCacheNodeIds()
    walks = remembers.copy().setCacheNodeIds(False)
    one, other = (e.fit(rows).toDebugString.split("\n", 1)[1] for e in (remembers, walks))
    assert one == other


def test_ranking_scores_each_row_once(spark):
    scored = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def score(i):
        scored.add(1)
        return (i * 7 % 101) / 101.0

    rows = spark.range(500).select((F.col("id") % 3 == 0).cast("int").alias("label"), score("id").alias("score"))
    assert ranking_report(rows).first()["pr_auc"] > 0
    assert scored.value == 500


def test_permuted_copies_are_made_in_many_tasks(spark):
    rows = spark.range(2000).select(F.col("id").alias("row_no"), F.array(F.col("id").cast("double"), F.lit(1.0), -F.col("id").cast("double")).alias("x"))
    copies = permuted_pieces(rows, "x", {"a": (0, 1), "b": (1, 2)}, repeats=3)
    sizes = [r["count"] for r in copies.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 12_000
    assert max(sizes) < 6_000
