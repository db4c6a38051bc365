"""A small label table still finds its planted toxic documents."""
import corpus_pipeline as P
from stancekit.llm import common as C
from stancekit.llm import queries as Q

SF = "/root/testdata/sf0.001"


def toxic_found(rows, labels):
    """Toxic rows found, toxic rows, others flagged among the labelled ones."""
    y = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    both = [(y[k], said) for k, said in rows if y.get(k) is not None]
    return sum(t and s for t, s in both), sum(t for t, _ in both), sum(s and not t for t, s in both)


def test_toxic_documents_are_found_with_ten_confirmed_examples(spark):
    labels = C.table(spark, SF, "labels")
    found, toxic, wrong = toxic_found([(r["doc_id"], r["predicted"]) for r in Q.op3_toxicity(spark, SF).collect()], labels)
    assert found >= toxic / 2 and wrong == 0


def test_toxicity_stage_with_eight_confirmed_examples(spark):
    labels = C.table(spark, SF, "labels")
    docs = C.written(P.quality_stage(spark, C.table(spark, SF, "documents"), SF), "test-quality")
    kept = {r[0] for r in P.toxicity_stage(spark, docs, SF).select("doc_id").collect()}
    found, toxic, wrong = toxic_found([(r["doc_id"], r["doc_id"] not in kept) for r in docs.select("doc_id").collect()], labels)
    assert found >= toxic / 2 and wrong == 0
