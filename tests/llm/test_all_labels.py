"""Class counts read every labelled row of the learning folds, not the sample alone."""
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from stancekit.llm import features, quality


def test_quality_ratios_cover_labelled_rows_outside_the_sample(spark):
    texts = [(i, f"{'fine' if i % 2 else 'poor'} common w{i} v{i // 4}") for i in range(400)]
    docs = spark.createDataFrame([*texts, (900, "not labelled fine poor"), (None, "fine")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in texts], "doc_id long, quality int")
    model = quality.fit(docs, labels, cap=40)
    held = docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1).where("doc_id < 400").collect()
    size, count = 1 << quality.BITS, {}
    for side in (0, 1):
        flat, _ = features.indicators(pa.array([r["text"] for r in held if r["doc_id"] % 2 == side]), quality.BITS, quality.WORDS, quality.SHAPES)
        count[side] = np.bincount(flat, minlength=size)
    p, q = count[1], count[0]
    r = np.log((p + 1) / (p.sum() + size)) - np.log((q + 1) / (q.sum() + size))
    assert np.allclose(model.ratio2, r * r, rtol=1e-4, atol=1e-9)
    flat, _ = features.indicators(pa.array([r["text"] for r in held]), quality.BITS, quality.WORDS, quality.SHAPES)
    assert (np.abs(model.weights[np.unique(flat)][np.abs(r[np.unique(flat)]) > 0.1]) > 0).all()


def test_key_filter_keeps_every_key(spark):
    keys = spark.range(3000).select((F.col("id") * 7).alias("id"))
    may = features.key_filter(keys, "id", bits=14)
    got = {r[0] for r in spark.range(40_000).where(may(F.col("id"))).collect()}
    assert {7 * i for i in range(3000)} <= got and len(got) < 20_000
    assert spark.range(10).where(features.key_filter(keys.limit(0), "id")(F.col("id"))).count() == 0
