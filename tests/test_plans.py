"""Plans must prune, push down and keep top-n limits ahead of the shuffle."""

import re

import pytest

from mapwright.plans import catalog
from conftest import SF


def plan(spark, name):
    return catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_only_what_is_used(spark):
    text = plan(spark, "s05_pruned_scan")
    assert "ReadSchema: struct<l_partkey:bigint,l_quantity:double,l_shipdate" in text
    assert "GreaterThanOrEqual(l_shipdate" in text


@pytest.mark.parametrize("name", ["w04_landmarks", "w01_keep_first", "w06_sampled_reviews", "t04_smallest_hashes_per_entity", "w08_popular_items"])
def test_top_n_is_limited_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan(spark, name)


@pytest.mark.parametrize("name", [
    "j08_record_linkage", "f12_name_resolution", "w02_percentile_size", "w11_balanced_domains", "k04_popularity_bands", "v01_tfidf",
    "a27_domain_effects", "j07_align_vectors"])
def test_no_nested_loop_joins(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["a01_rating_stats", "p05_match_key", "p28_shard_hash", "c07_prepared_reviews", "v01_tfidf"])
def test_hot_paths_stay_in_the_jvm(spark, name):
    text = plan(spark, name)
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text


def test_tfidf_shuffles_texts_once_and_no_term_counts(tables):
    """Counts and lengths are taken where a text was dealt to; before, all (id, term) pairs went through two shuffles."""
    from mapwright.plans import q_vectors

    plan = q_vectors.v01(tables)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(doc_id#\d+L?, term#", plan)
    assert len(re.findall(r"Exchange hashpartitioning\(doc_id#\d+L?, \d+\), REPARTITION_BY_NUM", plan)) == len(re.findall(r"Exchange hashpartitioning\(doc_id", plan))
