"""Catalog: scoring in commits, broken off and taken up again."""
from __future__ import annotations

from pyspark.sql import functions as F

from stancekit.operators import annotate as AN
from stancekit.operators import prompts as P
from stancekit.operators import resume as RS
from stancekit.plans.catalog import register
from stancekit.plans.q_features import _test
from stancekit.plans.q_io import FAIL_SHARE
from stancekit.plans.sqlfrag import with_ctes
from stancekit.session import scratch_path

KEY = ["speech_id", "sent_idx"]


@register("annotate_resume", with_ctes(["annotated"], "SELECT speech_id, sent_idx, model_response, error, 1::BIGINT AS n_answers FROM annotated"))
def q_annotate_resume(spark, sf):
    """Test prompts scored in four commits, of which a first call makes one and a second the rest: every row has one answer."""
    path = scratch_path(spark, "audit-log")
    rows = P.prompt_zero_shot(_test(spark, sf)).drop("messages")
    RS.annotate_resumable(rows, AN.StubScorer, path, KEY, commits=4, most=1, fail_share=FAIL_SHARE)
    out = RS.annotate_resumable(rows, AN.StubScorer, path, KEY, commits=4, fail_share=FAIL_SHARE)
    per_row = out.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_answers"))
    return out.select(*KEY, "model_response", "error").join(per_row, KEY)
