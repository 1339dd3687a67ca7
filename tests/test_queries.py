"""Registered queries against their SQL on the smallest tables.

A spread of fast queries runs by default; PARTWISE_ALL=1 runs every one.  The
rank-sum SQL states the large-sample branch only, so it is not run on these tiny
groups; the exact branch is checked by enumeration in test_ranks.
"""

import os

import pytest
from conftest import SMALL

import __spark_entry__ as entry
from tools.compare import compare

FAST = [
    "src02_tsv_reload_typed", "src05_sparse_triplet_scan", "src08_json_leaf_scan", "src11_streaming_row_pick",
    "prj02_canonical_label", "prj04_barcode_keys", "prj16_simplex_close", "prj22_unique_names", "joi05_tiered_key_join",
    "joi10_within_group_pairs", "joi13_constraint_cross_join", "joi14_keyed_full_outer_diff", "set05_version_changes",
    "agg06_constraint_score", "agg09_profile_and_variance", "agg17_spearman", "agg19_kendall_tau",
    "agg22_multi_regression", "agg26_rank_sum_test", "agg47_control_audit", "agg55_design_contrast", "res13_control_band",
    "agg28_concordance_index", "agg30_conformal_quantile", "agg50_content_hash", "win02_average_rank", "win05_balanced_sample",
    "win13_fold_assignment", "res01_within_group_label_permutation", "res02_cluster_bootstrap", "res09_two_sample_permutation",
    "fit01_nnls_batch", "fit07_batch_adjust", "qry13_atlas_counts",
]
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
NAMES = sorted(ORACLES) if os.environ.get("PARTWISE_ALL") else FAST


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_sql(spark, duck, name):
    status, n, _, note = compare(spark, duck, name, QUERIES[name], ORACLES[name], SMALL)
    assert status == "ok", note


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
