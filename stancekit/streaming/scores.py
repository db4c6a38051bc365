"""Running scores over answer files as they land (outside the survey, not counted there).

Model answers arrive as JSON-line files (one folder per run). A streaming
read parses each answer and keeps, per run, the label sums of the report
(a partial aggregate in the state store); every micro-batch rewrites the
small sums table, from which score lines are plain arithmetic. With
``availableNow`` it processes what is there and stops, so a batch job can
call it; on a cluster the checkpoint lives in the shared checkpoint folder,
which makes the job restartable after executor or driver loss.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stancekit.functions import labels as L
from stancekit.functions.answers import parse_answer
from stancekit.operators import metrics as M
from stancekit.session import scratch_path

STREAM_SCHEMA = ("run_tag string, speech_id string, sent_idx int, sentence string, class_code int, "
                 "model_response string")


def running_sums(spark: SparkSession, answers_path: str, sums_path: str, checkpoint: str | None = None,
                 max_files_per_trigger: int = 64, available_now: bool = True):
    """Start (and with ``available_now`` finish) the streaming aggregation."""
    stream = (spark.readStream.schema(STREAM_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
              .json(answers_path))
    scored = stream.select("run_tag",
                           L.multi_hot(L.label_ids(F.col("class_code"))).alias("gold_vec"),
                           L.letter_vector(parse_answer(F.col("model_response"))).alias("pred_vec"))
    sums = M.label_sums(scored, by=("run_tag",))

    def sink(batch: DataFrame, _epoch: int) -> None:
        batch.write.mode("overwrite").parquet(sums_path)

    w = (sums.writeStream.outputMode("complete").foreachBatch(sink)
         .option("checkpointLocation", checkpoint or scratch_path(spark, "stream-ckpt")))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    q = w.start()
    if available_now:
        q.awaitTermination()
    return q


def stream_score_line(spark: SparkSession, answers_path: str) -> DataFrame:
    """Score line per run from a stream over ``answers_path``."""
    out = scratch_path(spark, "stream-sums")
    running_sums(spark, answers_path, out)
    return M.score_line_from_sums(spark.read.parquet(out), "run_tag")
