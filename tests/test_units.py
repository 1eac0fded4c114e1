"""Edge rows, invariants and driver-side parts of the workload library."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import features as feats
from sparkloom.functions import text as T
from sparkloom.functions.registry import GROUP_NAMES, HISTORICAL_NAMES, FeatureSpec, base_names
from sparkloom.operators import analysis, etl, evaluation, parity, sampling, statistics, tfidf, training
from sparkloom.plans import catalogue, config, pipeline
from sparkloom.sources import artifacts, query_log
from sparkloom.streaming import scoring


def frame(spark, queries, **columns):
    rows = [(q, columns.get("user", "u"), columns.get("catalog"), columns.get("schema"), columns.get("hour", 12), columns.get("client", "")) for q in queries]
    return spark.createDataFrame(rows, "query string, user string, catalog string, schema string, hour int, clientInfo string")


def features(spark, query, **columns):
    vector = feats.with_features(frame(spark, [query], **columns)).first()["features"]
    return dict(zip(base_names(), vector))


def test_names_and_order(spark):
    assert feats.feature_names() == GROUP_NAMES
    assert len(base_names()) == 78 and len(HISTORICAL_NAMES) == 17
    assert base_names().index("ast_depth") == 45 and base_names().index("user_hash") == 55


GOLDEN = [
    ("SELECT FROM", {"ast_depth": 0.1, "ast_breadth": 0.01, "ast_with_count": 0.0, "ast_coalesce_null_if_count": 0.0}),
    ("SELECT * FROM t1 LEFT JOIN t2 ON a = b", {"left_join_count": 1.0, "join_count": 1.0, "table_count": 2.0, "has_select_star": 1.0}),
    ("SELECT a FROM t WHERE id IN (1, 2, 3, 4, 5)", {"in_clause_count": 1.0, "in_list_total_items": 5.0, "max_in_list_size": 5.0}),
    ("SELECT a FROM t WHERE min(x) > 1", {"in_clause_count": 1.0, "where_condition_count": 1.0}),
    ("SELECT 1; SELECT 2", {"has_multiple_statements": 0.0}),
    ("SELECT 1;;", {"has_multiple_statements": 1.0}),
    ("WITH c AS (SELECT 1) SELECT 2", {"is_select_query": 0.0, "ast_cte_count": 1 / 3, "with_clause_count": 1.0}),
    (")(()", {"parentheses_depth": 2.0}),
    ("SELECT EXTRACT(YEAR FROM d) FROM a.b.c.d", {"table_count": 2.0, "table_qualification_level": 2.0}),
    ("SELECT x FROM s.t", {"table_qualification_level": 1.0, "inferred_schema_count": 1.0, "inferred_catalog_count": 0.0}),
    ("SELECT x FROM t", {"table_qualification_level": 0.0, "has_qualified_tables": 0.0}),
    ("USE hive.sales; SELECT 1", {"inferred_catalog_count": 1.0, "inferred_schema_count": 1.0}),
    ("SELECT a FROM t GROUP BY a, b, c HAVING COUNT(*) > 1", {"group_by_count": 3.0, "having_clause_present": 1.0, "count_function_count": 1.0}),
    ("SELECT a\nFROM t -- x\n/* y */ LIMIT 25", {"line_count": 3.0, "limit_value": 25.0, "has_limit": 1.0}),
    ("SELECT delimiter FROM t", {"has_limit": 1.0, "limit_value": 0.0}),
    ("SELECT a UNION SELECT b EXCEPT SELECT c INTERSECT SELECT d", {"set_operation_total": 3.0}),
    ("SELECT a FROM t WHERE x IN (SELECT y FROM z)", {"correlated_subquery_likely": 1.0}),
    ("SELECT 'a😀b'", {"query_length": 12.0, "quoted_strings_count": 1.0}),
]


@pytest.mark.parametrize("query,expected", GOLDEN)
def test_golden_features(spark, query, expected):
    found = features(spark, query)
    assert {k: found[k] for k in expected} == pytest.approx(expected)
    assert all(math.isfinite(v) for v in found.values())


def test_no_where_gives_zeros(spark):
    found = features(spark, "SELECT a FROM t")
    assert all(found[n] == 0 for n in GROUP_NAMES["where"])


def test_blank_and_long_queries_give_zeros(spark):
    rows = feats.with_features(frame(spark, [None, "", "  ", "\n", "x" * 1_000_000, "x" * 1_000_001])).collect()
    assert [any(r["features"]) for r in rows] == [False, False, False, False, True, False]


def test_context(spark):
    for hour, business in ((0, 0.0), (9, 1.0), (17, 1.0), (18, 0.0), (23, 0.0)):
        found = features(spark, "SELECT 1", hour=hour)
        assert (found["is_business_hours"], found["hour_of_day"]) == (business, hour / 24)
        assert found["hour_sin"] == pytest.approx(math.sin(2 * math.pi * hour / 24))
    found = features(spark, "SELECT 1", user="", catalog="", schema=None, client="abc")
    assert (found["user_hash"], found["is_catalog_null"], found["is_schema_null"], found["client_info_length"]) == (0, 1, 1, 3)


def test_batch_and_single_row_agree(spark, sf):
    df = catalogue.log(spark, sf).limit(50)
    whole = {r["queryId"]: r["features"] for r in feats.with_features(df.repartition(3)).collect()}
    one = feats.with_features(df.where(F.col("queryId") == min(whole))).first()
    assert one["features"] == whole[min(whole)]
    plan = feats.with_features(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_spec():
    spec = FeatureSpec.default(historical=True)
    assert len(spec.active_names()) == 95
    spec.disable_group("structure")
    spec.disable_feature("query_length")
    assert len(spec.active_names()) == 84
    spec.set_importance({"token_count": 0.01, "line_count": 0.9})
    spec.importance_threshold = 0.5  # takes effect when set later
    assert "token_count" not in spec.active_names() and "line_count" in spec.active_names()
    assert FeatureSpec.from_json(spec.to_json()).active_names() == spec.active_names()
    assert spec.importance_report(1)["bottom"] == [("token_count", 0.01)]
    spec.enable_group("structure")
    spec.enable_feature("query_length")
    assert len(spec.active_names()) == 94
    with pytest.raises(KeyError):
        spec.disable_feature("none such")
    assert sum(r["active"] for r in spec.summary()) == 94


def test_label_edges(spark):
    rows = [("a", 299_999, 0, None), ("b", 300_000, 0, None), ("c", 0, 10 * 1024**3, None), ("d", 0, 10 * 1024**3 + 1, None), ("e", None, None, None), ("f", 0, 0, "EXCEEDED_CPU_LIMIT"), ("g", 0, 0, "OTHER")]
    df = spark.createDataFrame(rows, "queryId string, cpuTime bigint, peakUserMemoryBytes bigint, errorName string")
    assert {r["queryId"] for r in etl.with_labels(df).where("is_heavy = 1").collect()} == {"b", "d", "f"}
    assert etl.with_labels(df, cpu_seconds=0).where("is_heavy = 1").count() == 7  # a threshold of 0 is honoured


def test_filters_drop_nulls(spark):
    rows = [("NON-CURATED", "SELECT", "q"), (None, "SELECT", "q"), ("NON-CURATED", None, "q"), ("NON-CURATED", "EXPLAIN", "q"), ("NON-CURATED", "SELECT", "  "), ("NON-CURATED", "SELECT", None), ("x", "SELECT", "q")]
    df = spark.createDataFrame(rows, "clientInfo string, queryType string, query string")
    assert etl.filter_queries(df).count() == 1
    assert etl.filter_queries(df, require_non_curated=False, excluded_types=()).count() == 5


def test_required_columns(spark):
    with pytest.raises(ValueError, match="endTime"):
        query_log.require_columns(spark.createDataFrame([(1,)], "queryId int"))


def test_scan_pushes_the_range(spark, sf, tmp_path):
    path = str(tmp_path / "log")
    catalogue.log(spark, sf).write.parquet(path)
    df = query_log.read_log(spark, path, "2024-01-05", "2024-01-06", schema=query_log.SCHEMA).select("queryId")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(createTime" in plan and "query," not in plan.split("ReadSchema")[1]
    assert query_log.read_log(spark, path, "2024-01-01", "2024-03-01", 0.5).count() < catalogue.log(spark, sf).count()


def test_samples_do_not_depend_on_partitions(spark, sf):
    df = catalogue.labelled(spark, sf)
    ids = lambda d: sorted(r[0] for r in d.select("queryId").collect())
    assert ids(sampling.boundary_sample(df)) == ids(sampling.boundary_sample(df.repartition(7)))
    heavy, small = sampling.class_counts(df)
    exact = sampling.class_counts(sampling.exact_ratio_sample(df, 3.0))
    assert exact == (heavy, min(small, 3 * heavy))
    assert sampling.class_counts(sampling.exact_ratio_sample(df, 0.0))[1] == 0
    assert sampling.class_counts(sampling.exact_ratio_sample(df, 1e6))[1] == small
    close = sampling.boundary_sample(df, honour_guarantee=True)
    near = sampling.with_distance(df.where("is_heavy = 0")).where("boundary_distance < 0.5").count()
    assert sampling.with_distance(close.where("is_heavy = 0")).where("boundary_distance < 0.5").count() == near


def test_statistics_edges(spark):
    rows = [("u1", None, "s", 1000, 1 << 30, 0), ("u1", "", "s", None, None, 1), ("u2", "hive", None, None, None, 0)]
    df = spark.createDataFrame(rows, "user string, catalog string, schema string, cpuTime bigint, peakUserMemoryBytes bigint, is_heavy int")
    stats = statistics.compute(df, exact=True)
    users = {r["user"]: r for r in stats["user"].collect()}
    assert (users["u1"]["cpu_stddev"], users["u1"]["unique_catalogs"], users["u2"]["avg_cpu_seconds"]) == (0.0, 1, 0.0)
    assert {r["catalog"]: r["query_count"] for r in stats["catalog"].collect()} == {"NULL": 2, "hive": 1}
    document = statistics.validate_document(statistics.to_document(stats))
    assert json.loads(json.dumps(document))["total_queries"] == 3
    with pytest.raises(ValueError):
        statistics.compute(df.where("false"))
    with pytest.raises(ValueError):
        statistics.compute(df.drop("user"))
    ask = spark.createDataFrame([("u1", "NULL", "s"), ("new", "none", "such"), (None, "null", None), ("new", "hive", "such")], "user string, catalog string, schema string")
    got = statistics.with_historical(ask, stats).collect()
    assert [r["is_cold_start"] for r in got] == [0, 1, 0, 0]
    cold = next(r for r in got if r["is_cold_start"] == 1)
    expected = (0.0001, 0.1, 0.1, 1 / 3, 0.1, 0.01)
    assert tuple(cold[n] for n in HISTORICAL_NAMES[:6]) == pytest.approx(expected)


def test_checkpoints(spark, tmp_path):
    store = query_log.Checkpoints(spark, str(tmp_path))
    assert store.load("a") is None and not store.exists("a") and store.info("a") is None
    first = store.save(spark.range(3).toDF("x"), "a")
    assert first.count() == 3 and store.save(spark.range(9).toDF("x"), "a").count() == 3
    assert store.save(spark.range(9).toDF("x"), "a", force=True).count() == 9
    assert store.names() == ["a"] and store.info("a")["rows"] == 9
    assert store.expired() == [] and store.expired(now=4e9) == ["a"]
    store.drop("a")
    assert store.names() == []
    assert query_log.Checkpoints(spark, str(tmp_path), enabled=False).save(spark.range(2), "b").count() == 2


def test_artifacts(spark, tmp_path):
    store = artifacts.Artifacts(spark, str(tmp_path / "cache"), ttl_hours=24)
    uri = f"file://{tmp_path}/x.json"
    store.save_json({"a": 1}, uri)
    assert store.exists(uri) and store.load_json(uri) == {"a": 1}
    store.save_json({"a": 2}, uri)
    assert store.load_json(uri) == {"a": 1} and store.load_json(uri, use_cache=False) == {"a": 2}
    stale = artifacts.Artifacts(spark, str(tmp_path / "cache"), ttl_hours=1e-9)
    (tmp_path / "x.json").unlink()
    assert stale.load_json(uri) == {"a": 2}
    assert artifacts.split_uri("s3://bucket/a/b") == ("bucket", "a/b")
    with pytest.raises(ValueError):
        artifacts.split_uri("nothing")
    assert len(store.save_versioned({"v": 1}, f"file://{tmp_path}", "t", "3")) == 2
    local = tmp_path / "local.txt"
    local.write_text("hello")
    store.upload(str(local), f"file://{tmp_path}/up.txt")
    assert open(store.download(f"file://{tmp_path}/up.txt", str(tmp_path / "down.txt"))).read() == "hello"


def test_tfidf_paths_agree(spark, sf, tmp_path):
    df = catalogue.log(spark, sf).where(feats.valid_query())
    model = tfidf.SqlTfidf(min_df=5).fit(df)
    chosen = {r["term"]: r["idf"] for r in tfidf.chosen_terms(df, min_df=5, drop_keywords=True).collect()}
    assert dict(zip(model.vocabulary, model.idf)) == pytest.approx(chosen)
    rows = {(r["queryId"], r["term"]): r["weight"] for r in tfidf.unit_weights(df, "queryId", min_df=5, drop_keywords=True).collect()}
    for r in model.transform(df).limit(20).collect():
        for term, w in zip(model.vocabulary, r["tfidf"]):
            assert rows.get((r["queryId"], term), 0.0) == pytest.approx(w)
    one = df.first()
    assert model.transform_one(spark, one["query"]) == pytest.approx(model.transform(df.limit(1)).first()["tfidf"])
    model.save(str(tmp_path / "m"))
    again = tfidf.SqlTfidf().load(str(tmp_path / "m"))
    assert again.vocabulary == model.vocabulary and again.metadata()["fitted"]
    with pytest.raises(ValueError):
        tfidf.SqlTfidf().transform(df)
    rare = tfidf.SqlTfidf(min_df=5, max_df=0.2).fit(df)
    assert set(rare.vocabulary) < set(tfidf.SqlTfidf(min_df=5, max_df=1.0).fit(df).vocabulary)


def test_normalise_order(spark):
    q = "SELECT '2024-01-05 10:20:30', '2024-01-05', \"x\", 'y', 01/02/2024, 42"
    out = spark.createDataFrame([(q,)], "q string").select(T.normalise_sql(F.col("q"))).first()[0]
    # The date's placeholder stands inside quotes, which then become one literal.
    assert "TIMESTAMP_VALUE" not in out and out.count("STRING_LITERAL") >= 3 and "DATE_VALUE" in out and "NUMERIC" in out


def test_scalar_helpers(spark):
    row = spark.range(1).select(
        T.safe_divide(F.lit(1), F.lit(0)), T.safe_divide(F.lit(1), F.lit(4)), T.at_most_one(F.lit(30.0), 10), T.clamp(F.lit(5), 1, 3), T.clamp(F.lit(-5), 1, 3),
        T.count_of(F.lit("aaaa"), "aa"), T.hash_feature(F.lit(None).cast("string"), 10),
    ).first()
    assert list(row) == [0.0, 0.25, 1.0, 3, 1, 2.0, 0.0]


def test_evaluation_edges(spark):
    df = spark.createDataFrame([(0.0, 0), (0.2, 0), (0.4, 1), (0.4, 0), (0.9, 1)], "score double, is_heavy int")
    assert evaluation.roc_auc(df).first()[0] == pytest.approx(5.5 / 6)
    best = evaluation.best_threshold(df).first()
    assert (best["threshold"], best["fn"], best["fp"]) == (0.4, 0, 1)
    none = df.where("false")
    assert evaluation.derived(evaluation.confusion(none)).first()["recall"] == 0.0
    assert evaluation.roc_auc(none).first()[0] == 0.0
    checks = evaluation.compliance(spark.createDataFrame([(0.99, 0.01, 0.8)], "recall double, fnr double, f1 double"))
    assert {r["requirement"]: r["status"] for r in checks.collect()} == {"recall": "PASSED", "fnr": "PASSED", "f1": "WARNING", "roc_auc": "WARNING"}
    assert evaluation.overall_status(checks) == "WARNING"
    assert json.loads(evaluation.compliance_report(checks, "json"))["overall"] == "WARNING" and "missing" in evaluation.compliance_report(checks)
    evaluation.require_release(checks)
    bad = evaluation.compliance(spark.createDataFrame([(0.5, 0.5)], "recall double, fnr double"))
    assert evaluation.overall_status(bad) == "FAILED"
    with pytest.raises(ValueError):
        evaluation.require_release(bad)


def test_distribution_guard(spark):
    ratio = lambda n: spark.createDataFrame([(1,)] * 10 + [(0,)] * (10 * n), "is_heavy int")
    assert evaluation.distribution_guard(ratio(5), ratio(36))["warning"] is False
    assert evaluation.distribution_guard(ratio(5), ratio(12))["warning"] is True
    with pytest.raises(ValueError):
        evaluation.distribution_guard(ratio(5), ratio(5))


def test_parity_counts_nan_null_and_length(spark):
    rows = [([1.0, 2.0], [1.0, 2.0 + 5e-7]), ([1.0, 2.0], [1.0, float("nan")]), ([1.0, 2.0], [1.0, None]), ([1.0], [1.0, 2.0])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "k int, a array<double>, b array<double>")
    assert [r["mismatch"] for r in parity.row_parity(df, "k", "a", "b").orderBy("k").collect()] == [False, True, True, True]
    assert "FAILED" in parity.report(parity.parity(df, "a", "b"))
    assert parity.worst_features(df, "a", "b").first()["position"] == 1


def test_config():
    assert config.problems(config.DEFAULTS) == []
    merged = config.merged({"model": {"max_depth": 3}})
    assert merged["model"]["max_depth"] == 3 and merged["model"]["cv_folds"] == 5
    bad = {"data_loading": {"start_date": "2024-02-01", "end_date": "2024-01-01", "base_path": "x"}, "model": {"n_estimators": 0, "max_depth": "3", "learning_rate": 2.0}, "features": {"max_df": 0, "ngram_range": [2, 1]}}
    found = " | ".join(config.problems(bad))
    for part in ("end_date must come after", "n_estimators is out", "max_depth has the wrong", "learning_rate is out", "max_df is out", "ngram_range", "missing section", "missing key"):
        assert part in found
    with pytest.raises(ValueError):
        config.merged({"model": {"cv_folds": 1}})


def test_session_properties(spark):
    df = spark.createDataFrame([({"a": "b"},), ({"k" * 101: "v"},), ({"a": "v" * 10_001},), (None,)], "sessionProperties map<string,string>")
    assert [r[0] for r in df.select(etl.check_session_properties()).collect()] == [None, "property key is too long", "properties are too large", None]


def test_requests(spark):
    df = frame(spark, ["SELECT 1", " ", None, "x" * 1_000_001], user=" Bob ", catalog="", hour=0)
    rows = etl.check_requests(df).collect()
    assert [len(r["problems"]) for r in rows] == [0, 1, 1, 1]
    assert (rows[0]["user"], rows[0]["catalog"], rows[0]["hour"]) == ("bob", None, 0)
    assert "hour is out of range" in etl.check_requests(frame(spark, ["q"], hour=24)).first()["problems"]


def test_training_end_to_end(spark, sf, tmp_path):
    trained = pipeline.run(catalogue.log(spark, sf), "2024-01-01", "2024-01-31", rounds=5, depth=3)
    assert 0 <= trained.threshold <= 1 and set(trained.metrics) >= {"recall", "roc_auc", "tp"}
    assert len(trained.importance) == 95 and trained.importance[0][1] >= trained.importance[-1][1]
    training.save(trained.model, str(tmp_path / "gbt"))
    assert training.load(str(tmp_path / "gbt")).numFeatures == 95
    with pytest.raises(ValueError):
        training.importance(trained.model, ["one"])


def test_folds_and_spread(spark, sf):
    df = training.with_folds(catalogue.labelled(spark, sf))
    assert df.select("fold").distinct().count() == 5
    assert training.spread([{"fold": 0, "f1": 0.2}, {"fold": 1, "f1": 0.4}])["f1"] == pytest.approx((0.3, 0.1))


def test_report(spark, sf):
    assert "resource errors" in analysis.report(catalogue.labelled(spark, sf))


def test_streams(spark, sf, tmp_path):
    path = str(tmp_path / "in")
    catalogue.log(spark, sf).write.parquet(path)
    stream = scoring.read_stream(spark, path)
    for name, df, mode in (("feature_out", scoring.feature_stream(stream).select("queryId", "features"), "append"), ("rate_out", scoring.heavy_rate_stream(stream), "complete")):
        run = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        run.awaitTermination()
    batch = {r["queryId"]: r["features"] for r in feats.with_features(catalogue.log(spark, sf)).collect()}
    assert {r["queryId"]: r["features"] for r in spark.table("feature_out").collect()} == batch
    assert spark.table("rate_out").agg(F.sum("total")).first()[0] == len(batch)


def test_library_stands_without_the_text_operators(tmp_path):
    """The entry point imports, and lists the other queries, where the subpackage is gone."""
    import os
    import shutil
    import subprocess
    import sys

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in ("__spark_entry__.py", "bench.py"):
        shutil.copy(os.path.join(here, name), tmp_path)
    shutil.copytree(os.path.join(here, "sparkloom"), tmp_path / "sparkloom", ignore=lambda d, names: [n for n in names if n == "llm"])
    code = "import __spark_entry__ as e; q = e.queries(); assert 'user_stats' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    # As a removal leaves it: a folder with a cache, and the pipeline's file.
    (tmp_path / "sparkloom" / "llm" / "__pycache__").mkdir(parents=True)
    if os.path.exists(os.path.join(here, "corpus_pipeline.py")):
        shutil.copy(os.path.join(here, "corpus_pipeline.py"), tmp_path)
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_helper_columns_give_way(spark, sf):
    """Columns of the input that are named like helpers come back as they were."""
    names = ["_q", "_u", "_w", "_ok", "_query", "_upper", "_where", "_depth", "_valid", "_rank", "_weight", "_bucket", "_text", "_tokens", "_kept", "_vector", "label", "_row", "_cpu", "_mem", "_user_key", "_split", "row"]
    heavy = etl.with_date_parts(catalogue.labelled(spark, sf).where(feats.valid_query())).withColumns({n: F.lit(f"mine {n}") for n in names})
    stats = statistics.compute(heavy)
    vectors = feats.with_features(heavy)
    model = training.fit(vectors, rounds=2, depth=2)
    done = [
        vectors, sampling.exact_ratio_sample(heavy, 1.0), etl.first_of(heavy), statistics.with_historical(heavy, stats),
        tfidf.SqlTfidf(min_df=1).fit(heavy).transform(heavy), training.scored(model, vectors), etl.time_splits(heavy, "2000-01-01", "2100-01-01")["train"],
    ]
    for out in done:
        rows = out.select(*names).distinct().collect()
        assert [r.asDict() for r in rows] == [{n: f"mine {n}" for n in names}]


def test_ranges_do_not_show(spark):
    """Running sums in many ranges, with ties, nulls of the sketch's making and a single score."""
    rng = random.Random(2)
    rows = [(rng.choice([rng.random(), round(rng.random(), 1)]), int(rng.random() < 0.3)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "score double, is_heavy int")
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert evaluation.roc_auc(df).first()[0] == pytest.approx(wins / len(pos) / len(neg))
    for r in evaluation.sweep(df).collect()[::97]:
        assert (r["fn"], r["fp"]) == (sum(p < r["threshold"] for p in pos), sum(n >= r["threshold"] for n in neg))
    plan = evaluation.sweep(df)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("BroadcastExchange")[0]
    one = spark.createDataFrame([(0.5, 1), (0.5, 0)], "score double, is_heavy int")
    assert evaluation.roc_auc(one).first()[0] == 0.5 and evaluation.pr_auc(one).first()[0] == 0.5


def test_trained_models_come_back(spark, tmp_path):
    rng = random.Random(1)
    rows = [(str(i), y := int(rng.random() < 0.4), [y + rng.gauss(0, 0.3), rng.random()]) for i in range(400)]
    df = spark.createDataFrame(rows, "queryId string, is_heavy int, features array<double>")
    found = training.train(df, df, ["a", "b"], folds=3, rounds=4, depth=2)
    assert len(found.folds) == 3 and all(f["roc_auc"] > 0.9 and f["pr_auc"] > 0.9 for f in found.folds)
    assert 1 <= training.best_rounds(found.folds) <= 4 and training.spread(found.folds)["roc_auc"][0] > 0.9
    store = artifacts.Artifacts(spark)
    version = training.save_trained(found, store, f"{tmp_path}/models", "7")
    again = training.load_trained(store, f"{tmp_path}/models")
    assert version == "7" and (again.threshold, again.importance) == (found.threshold, found.importance)
    before = {r["queryId"]: r["score"] for r in training.scored(found.model, df).collect()}
    assert before == {r["queryId"]: r["score"] for r in training.scored(again.model, df).collect()}
    assert max(before[i] for i, y, _ in rows if not y) < 1 and found.importance[0][0] == "a"


def test_statistics_come_back_for_scoring(spark, sf):
    """Features from statistics that went through JSON equal those from the statistics themselves."""
    df = catalogue.labelled(spark, sf)
    stats = statistics.compute(df, exact=True)
    read = statistics.from_document(spark, json.loads(json.dumps(statistics.to_document(stats))))
    names = ["queryId", *HISTORICAL_NAMES]
    first, second = (sorted((r[0], *(round(x, 9) for x in r[1:])) for r in statistics.with_historical(df, s).select(names).collect()) for s in (stats, read))
    assert first == second


def test_structure_of_statements(spark):
    from sparkloom.functions.structure import structure_metrics

    query = """WITH RECURSIVE a AS (SELECT DISTINCT x FROM t), b AS (SELECT 1) -- a UNION in a comment
      SELECT CASE WHEN x = 'CASE WHEN' THEN 1 WHEN x = 2 THEN 2 ELSE 3 END, sum(y) OVER (PARTITION BY x), COALESCE(NULLIF(x, 1), 2)
      FROM (SELECT * FROM a) /* HAVING
      HAVING */ LATERAL VIEW explode(z) GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT CASE WHEN 1 THEN 2 END UNION SELECT 3"""
    df = spark.createDataFrame([(query,), (None,), ("",)], "query string")
    first, null, empty = df.select(*[c.alias(n) for n, c in structure_metrics(F.col("query")).items()]).collect()
    got = first.asDict()
    assert (got["with_count"], got["cte_count"], got["subquery_count"], got["case_when_count"], got["max_branches"]) == (1, 2, 1, 2, 2)
    assert (got["union_count"], got["union_all_count"], got["having_count"], got["lateral_view_count"], got["window_func_count"]) == (1, 1, 1, 1, 1)
    assert (got["coalesce_null_if_count"], got["distinct_count"], got["depth"]) == (2, 1, 2) and got["node_count"] > 60
    assert null == empty and null["node_count"] == 0 and null["breadth"] == 1
    rows = df.select(T.has_keyword(F.col("query"), "lateral"), T.has_keyword(F.col("query"), "lateral", True), T.count_pattern(F.col("query"), "select")).collect()
    assert tuple(rows[0]) == (True, False, 6) and tuple(rows[1]) == (False, False, 0)


def test_feature_sets_are_written(spark, sf, tmp_path):
    df = etl.with_date_parts(catalogue.labelled(spark, sf))
    pipeline.write_features({"train": pipeline.featurised(df, statistics.compute(df))}, str(tmp_path))
    back = query_log.read_splits(spark, str(tmp_path), ("train",))["train"]
    assert back.columns == query_log.FEATURE_COLUMNS and back.count() == df.count()
    assert back.select(F.size("features")).distinct().collect()[0][0] == 95


def test_comparison_report(spark):
    before = spark.createDataFrame([(1,)] * 10 + [(0,)] * 90, "is_heavy int")
    text = analysis.comparison_report(before, before.where("is_heavy = 0"), "drop")
    assert "heavy: 10 to 0, 10 removed (100.0 %)" in text and "warning" in text and "9.00 to none" in text
    assert analysis.summary(before) == {"total_queries": 100, "heavy_queries": 10, "small_queries": 90, "heavy_percentage": 10.0, "small_to_heavy_ratio": 9.0}


def test_config_of_the_cluster():
    bad = config.DEFAULTS | {"spark": {"app_name": " ", "driver_memory": "lots", "executor_cores": 0, "min_executors": 5, "max_executors": 2}, "storage": {}}
    found = " | ".join(config.problems(bad))
    for part in ("app_name must be a text", "driver_memory is not", "executor_cores is out of range", "min_executors is above", "storage: missing key container"):
        assert part in found
