"""A broken run is taken up again; no row is scored twice."""
import glob
import os

import pytest
from pyspark.sql import functions as F

from stancekit.operators import resume as RS

KEYS = ("speech_id", "sent_idx")


def counting():
    """The class by value: workers do not have the tests on their path."""
    class Counting:
        """Answers with the prompt, and leaves a file for each prompt it was asked for."""

        def __init__(self, folder: str, broken: str | None = None, failing: str | None = None, at: str = ""):
            self.folder, self.broken, self.failing, self.at = folder, broken, failing, at

        def __call__(self, prompts):
            if self.broken and os.path.exists(self.broken) and self.at in prompts:
                os._exit(3)                        # the worker dies, not just the row
            out = []
            for p in prompts:
                open(os.path.join(self.folder, f"{p}-{os.urandom(4).hex()}"), "w").close()
                out.append(ValueError("no") if self.failing and os.path.exists(self.failing) and p in ("p1", "p2") else f"{p} x y")
            return out

    return Counting


def rows(spark, n=60):
    return spark.createDataFrame([(f"s{i % 7}", i, f"p{i}") for i in range(n)], "speech_id string, sent_idx int, prompt string").repartition(4)


def asked(folder):
    return sorted(os.path.basename(f).split("-")[0] for f in glob.glob(f"{folder}/*"))


def test_a_broken_run_resumes(spark, tmp_path):
    asked_in, flag, path = tmp_path / "asked", tmp_path / "break", str(tmp_path / "log")
    asked_in.mkdir()
    flag.touch()
    df = rows(spark)
    at = df.where(F.pmod(F.xxhash64(*KEYS), F.lit(8)) == 4).first()["prompt"]      # in the fifth of eight commits
    kind = counting()
    make = lambda: kind(str(asked_in), str(flag), at=at)
    with pytest.raises(Exception):
        RS.annotate_resumable(df, make, path, KEYS, commits=8).count()
    before = {r["prompt"] for r in RS.answers(spark, path, df.withColumns({"model_response": F.lit(""), "error": F.lit("")}).schema).collect()}
    assert 0 < len(before) < 60 and at not in before
    for f in asked_in.iterdir():               # from here on only the second run counts
        f.unlink()
    flag.unlink()
    got = RS.annotate_resumable(df, make, path, KEYS, commits=8).collect()
    assert sorted(r["prompt"] for r in got) == sorted(f"p{i}" for i in range(60))
    assert all(r["model_response"].endswith(f"{r['prompt']} x") and r["error"] is None for r in got)
    assert asked(asked_in) == sorted({f"p{i}" for i in range(60)} - before)      # no committed row is asked again
    for f in asked_in.iterdir():
        f.unlink()
    assert RS.annotate_resumable(df, make, path, KEYS, commits=8).count() == 60 and asked(asked_in) == []


def test_unfinished_folders_do_not_count(spark, tmp_path):
    path = str(tmp_path / "log")
    df = rows(spark, 20)
    (tmp_path / "asked").mkdir()
    kind = counting()
    make = lambda: kind(str(tmp_path / "asked"))
    assert RS.annotate_resumable(df, make, path, KEYS, commits=4, most=2).count() < 20
    some = RS.committed(spark, path)
    os.unlink(os.path.join(some[0].removeprefix("file:"), "_SUCCESS"))
    assert RS.committed(spark, path) == some[1:]
    assert RS.annotate_resumable(df, make, path, KEYS, commits=4).count() == 20


def test_more_rows_and_failed_ones(spark, tmp_path):
    path, fail = str(tmp_path / "log"), tmp_path / "fail"
    (tmp_path / "asked").mkdir()
    fail.touch()
    kind = counting()
    make = lambda: kind(str(tmp_path / "asked"), None, str(fail))
    first = RS.annotate_resumable(rows(spark, 10), make, path, KEYS, commits=3)
    assert {r["prompt"] for r in first.where("error is not null").collect()} == {"p1", "p2"}
    fail.unlink()
    assert RS.annotate_resumable(rows(spark, 15), make, path, KEYS, commits=3).where("error is null").count() == 13
    again = RS.annotate_resumable(rows(spark, 15), make, path, KEYS, commits=3, retry_failed=True).collect()
    assert len(again) == 15 and all(r["error"] is None for r in again)
    assert asked(tmp_path / "asked").count("p3") == 1 and asked(tmp_path / "asked").count("p1") == 2
    with pytest.raises(ValueError):
        RS.annotate_resumable(rows(spark, 3).withColumn("sent_idx", F.lit(None).cast("int")), make, path, KEYS)


def test_batches_are_of_like_length(spark):
    got = list(RS.by_length(["ccc", None, "a", "bb", "dddd"], 2))
    assert got == [[1, 2], [3, 0], [4]]

    class Sizes:
        def __init__(self, tag):
            self.tag = tag

        def __call__(self, prompts):
            if len(prompts) > 3:
                raise RuntimeError("too many")
            return [f"{self.tag} {len(prompts)}" for _ in prompts]

    df = spark.createDataFrame([(i, "x" * (i % 5)) for i in range(20)], "k int, prompt string").coalesce(1)
    out = RS.annotate_batched(df, Sizes, batch_size=3, window=10, opening="", tag="t").collect()
    assert [r["k"] for r in out] == list(range(20)) and all(r["error"] is None for r in out)
    assert {r["model_response"] for r in out} == {"t 3", "t 1"}
