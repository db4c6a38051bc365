"""Spark plans against their DuckDB oracle at sf0.001 (a representative set)."""
import math
import os

import duckdb
import pytest

from conftest import SF_SMALL
from stancekit.plans import catalog

NAMES = ["classification_report", "load_split", "label_ids_folded", "hot_to_ids_nested", "explode_explained",
         "upsample_minority", "train_test_split_exact", "kshot_sample", "class_distribution", "parse_letter",
         "score_line", "compare_runs", "prior_context", "prior_context_turns", "row_index", "pack_window",
         "vocabulary", "tfidf_transform", "score_linear", "top_terms", "knn_cosine", "knn_lexical",
         "prompt_kshot_dialogue", "prompt_kshot_grouped", "inject_distribution", "relevance_linear", "conservation",
         "merge_words_max", "merge_words_sum", "split_contractions", "align_predictions", "audit_report",
         "read_responses", "read_list_predictions", "merge_hyphens", "merge_symbols", "align_to_words", "align_to_words_sum",
         "write_relevance", "write_metrics", "write_list_predictions_nested", "write_list_predictions_binary",
         "read_position_tsv_lines", "letter_vector_names", "binary_gold_nested", "train_linear_svm", "knn_cosine_lsh",
         "quarantine_failed", "prompt_typed_content", "prompt_retrieval"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF_SMALL):
        if f.endswith(".parquet"):
            c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{SF_SMALL}/{f}')")
    return c


def _canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def v(x):
        if isinstance(x, float):
            return round(x, 6) if not math.isnan(x) else "nan"
        return x
    return sorted((tuple(v(r[i]) for i in order) for r in rows), key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, con, name):
    qs = catalog.QUERIES_LOADED()
    df = qs[name](spark, SF_SMALL)
    res = con.execute(catalog.ORACLE[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _canon([tuple(r) for r in df.collect()], df.columns) == _canon(res.fetchall(), dcols)


def test_every_query_has_docstring_or_oracle():
    qs = catalog.QUERIES_LOADED()
    assert len(qs) >= 100
    missing = [n for n in qs if n not in catalog.ORACLE]
    assert set(missing) <= {"linear_baseline_report"}
