"""Benchmark the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 4),
BENCH_REPEAT (default 3, median reported). Each query is written to the
``noop`` sink so the whole plan runs without collecting to the driver.
"""
from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from stancekit.functions import labels as L  # noqa: E402
from stancekit.operators import attribution as A  # noqa: E402
from stancekit.operators import features as FE  # noqa: E402
from stancekit.operators import linear as LN  # noqa: E402
from stancekit.operators import metrics as M  # noqa: E402
from stancekit.operators import retrieval as R  # noqa: E402
from stancekit.operators import sampling as S  # noqa: E402
from stancekit.operators import windows as W  # noqa: E402
from stancekit.plans import catalog  # noqa: E402
from stancekit.session import local_session, materialize, scratch_scope, spread  # noqa: E402
from stancekit.sources import fixtures as fx  # noqa: E402

KEY = ["speech_id", "sent_idx"]


def noop(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    spark = local_session(cpus, partitions=max(8, 2 * int(cpus) if cpus.isdigit() else 16), memory="7g")
    spark.sparkContext.setLogLevel("ERROR")
    qs = catalog.QUERIES_LOADED()

    sent = fx.sentences(spark, sf_dir)
    test = sent.where(F.col("split") == "test").drop("split")
    train = sent.where(F.col("split") == "train").drop("split")

    def q_report():
        noop(qs["classification_report"](spark, sf_dir))

    def q_prior():
        noop(W.prior_context(test, 5))

    def q_upsample():
        noop(S.upsample_minority(train, 5))

    def q_vocab_tfidf():
        tw = S.upsample_weights(train)
        noop(FE.tfidf(tw, FE.fit_vocabulary(tw, weight_col="copies")))

    vecs = fx.vectors(spark, sf_dir)
    vq = vecs.where(F.col("role") == "query").select(F.col("vec_id").alias("qid"), "embedding")
    vc = vecs.where(F.col("role") == "corpus").select(F.col("vec_id").alias("cid"), "embedding")

    def q_knn():
        noop(R.knn_cosine(vq, vc, 8))

    def q_knn_blocked():
        noop(R.knn_cosine(vq, vc, 8, block_bytes=32 << 10))

    def q_knn_lexical():
        vocab = FE.fit_vocabulary(S.upsample_weights(train), weight_col="copies")
        q200 = S.log_sample(test, 200, seed=5).drop("sample_hash")
        noop(R.knn_lexical(FE.tfidf_rows(q200, vocab), FE.tfidf_rows(train, vocab), 8))

    def q_knn_lexical_all():
        noop(qs["knn_lexical"](spark, sf_dir))

    def q_svm():
        tw = S.upsample_weights(train)
        terms, idf = LN.collect_vocabulary(FE.fit_vocabulary(tw, weight_col="copies"))
        gold = FE.with_grams(spread(tw, *KEY)).withColumn("gold_vec", L.multi_hot(L.label_ids(F.col("class_code"))))
        vecs = materialize(LN.tfidf_vectors(gold, terms, idf).select("features", "gold_vec", "copies"), "bench-vectors")
        LN.train_linear_svm(vecs, terms, weight_col="copies", max_iter=50, k=1)

    def q_merge():
        noop(A.merged_rows(fx.bpe_arrays(spark, sf_dir), A.words_max("toks", "scores")))

    def q_prompt():
        noop(qs["prompt_prior_context"](spark, sf_dir))

    bench = {
        "classification_report": q_report,
        "prior_context": q_prior,
        "upsample_minority": q_upsample,
        "vocabulary_tfidf": q_vocab_tfidf,
        "knn_cosine": q_knn,
        "knn_cosine_blocked": q_knn_blocked,
        "knn_lexical": q_knn_lexical,
        "train_linear_svm": q_svm,
        "merge_words_max": q_merge,
        "prompt_prior_context": q_prompt,
    }
    # all test sentences against all train sentences: minutes at sf0.1, so only on demand
    if "knn_lexical_all" in os.environ.get("BENCH_ONLY", ""):
        bench["knn_lexical_all"] = q_knn_lexical_all
    only = [x for x in os.environ.get("BENCH_ONLY", "").split(",") if x]
    times = {}
    for name, fn in bench.items():
        if only and name not in only:
            continue
        runs = []
        for _ in range(repeat + 1):      # the first warms up; every run recomputes from the files
            with scratch_scope(spark):
                t0 = time.time()
                fn()
                runs.append(time.time() - t0)
        runs = runs[1:]
        times[name] = round(statistics.median(runs), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "sum of median query seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else sf_dir,
                      "cpus": cpus, "repeat": repeat}))


if __name__ == "__main__":
    main()
