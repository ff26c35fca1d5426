"""Every registered query against its SQL counterpart, whole results."""

import pytest
from compare import connect, spark_result, sql_result, type_differences

import __spark_entry__ as contract
from shelfcast.plans import oracle
from shelfcast.plans.queries import REGISTRY

SQL = oracle.statements()
# trees are fitted when the query runs; SQL repeats a model in test_operators.py
ROWS_ONLY = {"estimate_model", "model_errors", "tiered_estimate_model", "request_pipeline_model"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql_or_is_known_not_to():
    assert set(REGISTRY) - set(SQL) == ROWS_ONLY
    assert set(SQL) <= set(REGISTRY) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf_dir, duck, name):
    df = contract.queries()[name](spark, sf_dir)
    names, rows = spark_result(df)
    want_names, want_rows = sql_result(duck, SQL[name])
    assert names == want_names
    assert rows == want_rows
    assert type_differences(duck, SQL[name], df) == []


def test_entry(spark):
    rows = contract.entry(spark).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, 11))


def test_model_scores_known_publishers_only(spark, sf_dir):
    rows = contract.queries()["estimate_model"](spark, sf_dir).collect()
    assert {r["path"] for r in rows} == {"known", "unknown", "failed"}
    for r in rows:
        assert (r["predicted_days"] is not None) == (r["path"] == "known")
        assert (r["sentence"] is None) == (r["path"] == "failed")


def by_key(df, *key):
    return {tuple(r[k] for k in key): r for r in df.collect()}


def test_model_tier_reads_predictions_and_other_tiers_do_not_change(spark, sf_dir):
    plain = by_key(contract.queries()["tiered_estimate"](spark, sf_dir), "game_id", "platform")
    found = by_key(contract.queries()["tiered_estimate_model"](spark, sf_dir), "game_id", "platform")
    assert set(found) == set(plain)
    other = 0
    for key, r in found.items():
        assert (r["tier"], r["sample_size"]) == (plain[key]["tier"], plain[key]["sample_size"])
        if r["tier"] == "B. Model":
            other += r["predicted_total_days"] != plain[key]["predicted_total_days"]
        elif r["tier"][0] in "AD":
            assert r["predicted_months"] == plain[key]["predicted_months"]
    assert other > 100


def test_flow_with_a_model_decides_as_without(spark, sf_dir):
    plain = by_key(contract.queries()["request_pipeline"](spark, sf_dir), "request_id")
    found = by_key(contract.queries()["request_pipeline_model"](spark, sf_dir), "request_id")
    same = ["status", "game", "platform", "source", "stored_by", "voted"]
    assert {k: [r[c] for c in same] for k, r in found.items()} == {k: [r[c] for c in same] for k, r in plain.items()}
    assert {k for k, r in found.items() if r["sentence"]} == {k for k, r in plain.items() if r["sentence"]}
    assert sum(r["predicted_years"] != plain[k]["predicted_years"] for k, r in found.items()) > 10


def test_model_errors_are_of_unseen_items(spark, sf_dir):
    rows = contract.queries()["model_errors"](spark, sf_dir).collect()
    assert {r["platform"] for r in rows} == {"epic", "gamepass", "psplus", "humble"}
    assert all(r["items"] > 0 and r["model_error"] > 0 and r["mean_error"] > 0 for r in rows)
