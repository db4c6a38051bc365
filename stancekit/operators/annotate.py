"""Score rows with a pluggable model over partitions (Arrow batches).

The scorer is any callable ``list[str] -> list[str | Exception]`` built by a
factory once per partition (model loading stays per task, not per row).
Failures are kept as rows with a null answer and the error text, so the
job goes on; ``split_failed`` separates them. A scorer that raises is asked
again row by row, so only the rows that make it raise fail.
"""
from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stancekit.functions.answers import ANSWER_OPENING
from stancekit.functions.labels import FULL_LABELS, LETTERS
from stancekit.operators.sampling import CLASS_SHARES


SLICE_ROWS = 1024    # prompts handed to a scorer at once, at most


class StubScorer:
    """Deterministic test model: answer chosen by md5 of the prompt.

    A share of the prompts, chosen by other digits of the hash and never by length, fails:
    ``raising=False`` returns the error for the row, ``True`` raises it for the batch.
    """

    def __init__(self, fail_share: float = 0.02, raising: bool = False, shares=CLASS_SHARES):
        self.fail_share, self.raising = fail_share, raising
        self.cum = [sum(shares[: i + 1]) for i in range(len(shares))]
        self.names = [x.split(") ", 1)[1] for x in FULL_LABELS]

    @staticmethod
    def draws(prompt: str | None) -> tuple[float, float]:
        digest = hashlib.md5((prompt or "").encode("utf-8")).hexdigest()
        return int(digest[:8], 16) / 4294967296.0, int(digest[8:16], 16) / 4294967296.0

    def answer(self, prompt: str | None) -> str:
        u, fail = self.draws(prompt)
        if fail < self.fail_share:
            raise ValueError("generation failed")
        code = next((c for c, edge in enumerate(self.cum[:-1]) if u < edge), len(self.cum) - 1)
        return f"{LETTERS[code]}) {self.names[code]}"

    def __call__(self, prompts: list[str]) -> list:
        out = []
        for p in prompts:
            try:
                out.append(self.answer(p))
            except ValueError as e:
                if self.raising:
                    raise
                out.append(e)
        return out


def scored(scorer, prompts: list[str]) -> list:
    """The scorer's answers; where it raises, or returns too few, each row alone."""
    try:
        out = list(scorer(prompts))
        if len(out) == len(prompts):
            return out
        raise ValueError(f"{len(out)} answers for {len(prompts)} prompts")
    except Exception as e:  # noqa: BLE001  (a failed row must not end the job)
        return [e] if len(prompts) == 1 else [x for p in prompts for x in scored(scorer, [p])]


def annotate(df: DataFrame, scorer_factory, prompt: str = "prompt", max_units: int = 2,
             opening: str = ANSWER_OPENING) -> DataFrame:
    """Adds ``model_response`` (opening + answer cut at ``max_units`` words) and ``error``.

    A worker holds one Arrow batch and the Python values of ``SLICE_ROWS`` prompts."""
    schema = T.StructType(df.schema.fields + [T.StructField("model_response", T.StringType()),
                                              T.StructField("error", T.StringType())])

    def run(batches):
        scorer = scorer_factory()
        for whole in batches:
            for lo in range(0, whole.num_rows, SLICE_ROWS):
                # only the prompts become Python values; the other columns pass through as they came
                batch = whole.slice(lo, SLICE_ROWS)
                resp, err = [], []
                for r in scored(scorer, batch.column(prompt).to_pylist()):
                    failed = isinstance(r, Exception)
                    resp.append(None if failed else opening + " ".join(str(r).split(" ")[:max_units]))
                    err.append(f"{type(r).__name__}: {r}" if failed else None)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(resp, pa.string()), pa.array(err, pa.string())],
                                                 [*batch.schema.names, "model_response", "error"])

    return df.mapInArrow(run, schema)


def split_failed(annotated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ok, failed) branches over one written table (the model runs once; the table lives as
    long as its ``scratch_scope``)."""
    from stancekit.session import materialize

    a = materialize(annotated, "annotated")
    return a.where(F.col("error").isNull()), a.where(F.col("error").isNotNull())
