"""Catalog: window and context operators."""
from __future__ import annotations

from pyspark.sql import functions as F

from stancekit.operators import sampling as S
from stancekit.operators import windows as W
from stancekit.plans.catalog import register
from stancekit.plans.sqlfrag import lit, with_ctes
from stancekit.sources import fixtures as fx

KEY = ["speech_id", "sent_idx"]


def _test(spark, sf):
    return fx.sentences(spark, sf).where(F.col("split") == "test").drop("split")


def _ctx_sql(src: str) -> str:
    return f"""
SELECT speech_id, sent_idx,
       array_to_string(COALESCE(list(sentence) OVER w, []), chr(10)) AS context,
       len(COALESCE(list(sentence) OVER w, []))::BIGINT AS n_context
FROM {src}
WINDOW w AS (PARTITION BY speech_id ORDER BY sent_idx ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"""


def _ctx(df):
    c = W.prior_context(df, 5)
    return c.select(*KEY, F.array_join("context", "\n").alias("context"), F.size("context").alias("n_context"))


@register("prior_context", with_ctes(["test_rows"], _ctx_sql("test_rows")))
def q_prior_context(spark, sf):
    """Up to 5 preceding sentences of the same speech (test split)."""
    return _ctx(_test(spark, sf))


@register("prior_context_turns", with_ctes(["turns"], _ctx_sql("turns")))
def q_prior_context_turns(spark, sf):
    """Same over conversation turns (the limit of 5 is reached)."""
    return _ctx(fx.turns(spark, sf))


@register("speech_reset", with_ctes(["test_rows"], """
SELECT speech_id, sent_idx, CAST(lag(sent_idx) OVER (PARTITION BY speech_id ORDER BY sent_idx) IS NULL AS INT)::BIGINT AS is_start
FROM test_rows"""))
def q_speech_reset(spark, sf):
    return W.speech_reset(_test(spark, sf)).select(*KEY, "is_start")


@register("row_index", with_ctes(["sentences"], """
SELECT speech_id, sent_idx, (row_number() OVER (PARTITION BY speech_id ORDER BY sent_idx) - 1)::BIGINT AS row_idx
FROM sentences WHERE len(string_split(sentence, ' ')) BETWEEN 9 AND 31"""))
def q_row_index(spark, sf):
    """Position within the speech after the word-band filter (gaps closed)."""
    band = S.word_band(fx.sentences(spark, sf))
    return W.row_index(band, "speech_id", "sent_idx").select(*KEY, "row_idx")


@register("row_index_global", with_ctes(["sentences"], """
SELECT speech_id, sent_idx, (row_number() OVER (ORDER BY speech_id, sent_idx) - 1)::BIGINT AS row_idx FROM sentences"""))
def q_row_index_global(spark, sf):
    """Global 0-based position in key order."""
    t = fx.sentences(spark, sf).select(*KEY)
    return W.global_index(t, KEY)


_U63 = "list_slice(string_split(sentence, ' '), 1, 63)"


def _pad(n: str) -> str:
    return f"list_transform(range(0, greatest({n}, 0)), lambda x: {lit(W.PAD)})"


def _ones(n: str, v: int) -> str:
    return f"list_transform(range(0, greatest({n}, 0)), lambda x: {v})"


_PACK_SQL = f"""
SELECT speech_id, sent_idx, array_to_string(list_slice(seq || {_pad('512 - len(seq)')}, 1, 512), ' ') AS units,
       list_sum(list_slice(mask || {_ones('512 - len(mask)', 0)}, 1, 512))::BIGINT AS n_mask
FROM (
  SELECT speech_id, sent_idx,
         [{lit(W.CLS)}] || c || {_pad('64 - len(c)')} || [{lit(W.SEP)}] || nb || [{lit(W.SEP)}] AS seq,
         {_ones('len(c) + 1', 1)} || {_ones('64 - len(c)', 0)} || {_ones('len(nb) + 2', 1)} AS mask
  FROM (
    SELECT speech_id, sent_idx, {_U63} AS c,
           flatten(COALESCE(list({_U63}) OVER (PARTITION BY speech_id ORDER BY sent_idx ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), []))
           || flatten(COALESCE(list({_U63}) OVER (PARTITION BY speech_id ORDER BY sent_idx ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING), [])) AS nb
    FROM sentences
  )
)"""


@register("pack_window", with_ctes(["sentences"], _PACK_SQL))
def q_pack_window(spark, sf):
    """Centre sentence + 4 neighbours each side in 512 units, with mask."""
    p = W.pack_window(fx.sentences(spark, sf))
    return p.select(*KEY, F.array_join("units", " ").alias("units"),
                    F.aggregate("mask", F.lit(0), lambda a, x: a + x).alias("n_mask"))


@register("truncate_pad", with_ctes(["sentences"], f"""
SELECT speech_id, sent_idx,
       array_to_string(u || {_pad('128 - len(u)')}, ' ') AS units, len(u)::BIGINT AS n_mask
FROM (SELECT speech_id, sent_idx, list_slice(string_split(sentence, ' '), 1, 128) AS u FROM sentences)"""))
def q_truncate_pad(spark, sf):
    """Cut to 128 units, padded, with mask."""
    p = W.truncate_pad(fx.sentences(spark, sf), 128, True)
    return p.select(*KEY, F.array_join("units", " ").alias("units"),
                    F.aggregate("mask", F.lit(0), lambda a, x: a + x).alias("n_mask"))
