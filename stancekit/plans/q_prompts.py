"""Catalog: prompt datasets (compared by md5 and length of the flat text)."""
from __future__ import annotations

from pyspark.sql import functions as F

from stancekit.functions.labels import FULL_LABELS
from stancekit.functions.text import collapse_newlines
from stancekit.operators import prompts as P
from stancekit.operators import sampling as S
from stancekit.operators import windows as W
from stancekit.plans.catalog import register
from stancekit.plans.q_core import KSHOT
from stancekit.plans import q_retrieval  # noqa: F401  (registers the retrieved CTE)
from stancekit.plans.sqlfrag import H, KEY_SQL, cte, lit, with_ctes
from stancekit.sources import fixtures as fx

KEY = ["speech_id", "sent_idx"]
T = P.DEFAULT


def _test(spark, sf):
    return fx.sentences(spark, sf).where(F.col("split") == "test").drop("split")


def _train(spark, sf):
    return fx.sentences(spark, sf).where(F.col("split") == "train").drop("split")


def _out(df, col="prompt"):
    """md5 and length of the flat prompt, md5 and number of the messages."""
    typed = "type" in df.schema["messages"].dataType.simpleString()
    content = lambda m: F.array_join(F.transform(m["content"], lambda p: F.concat(p["type"], F.lit(":"), p["text"])), "") if typed else m["content"]
    flat = F.array_join(F.transform("messages", lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), content(m), F.lit("\n"))), "")
    return df.select(*KEY, F.md5(F.col(col)).alias("prompt_md5"), F.length(F.col(col)).alias("prompt_len"),
                     F.md5(flat).alias("messages_md5"), F.size("messages").alias("n_messages"))


# ---------------------------------------------------------------- SQL helpers
NL = "chr(10)"


def s_collapse(x: str) -> str:
    return f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')"


def s_q(s: str, tpl=T) -> str:
    return f"({lit(tpl.question_head)} || {s} || {lit(tpl.question_tail)})"


def s_msg(role: str, content: str) -> str:
    return f"('<|{role}|>' || chr(10) || {content} || chr(10))"


def s_render(*msgs: str) -> str:
    return s_collapse(" || ".join(msgs) + " || '<|assistant|>' || chr(10)")


def s_sys(tpl=T) -> str:
    return s_msg("system", lit(tpl.system if tpl.use_system else ""))


def s_out(msgs, src: str, n: str = "2", prompt: str | None = None) -> str:
    """``msgs``: the messages' SQL; ``n``: their number; ``prompt``: the flat text if it is not just theirs."""
    return (f"SELECT speech_id, sent_idx, md5(p) AS prompt_md5, length(p)::BIGINT AS prompt_len, md5(m) AS messages_md5, n::BIGINT AS n_messages "
            f"FROM (SELECT speech_id, sent_idx, {prompt or s_render(*msgs)} AS p, {' || '.join(msgs)} AS m, {n} AS n FROM {src})")


def s_zero_msgs(s: str, tpl=T) -> list[str]:
    return [s_sys(tpl), s_msg("user", f"{lit(tpl.instruction + chr(10) * 2)} || {s_q(s, tpl)}")]


def s_zero(s: str, tpl=T) -> str:
    return s_render(*s_zero_msgs(s, tpl))


cte("shots", ["train_rows"], f"""
SELECT speech_id, sent_idx, sentence, class_code, {H("'mix42'", KEY_SQL)} AS mix_hash
FROM (SELECT *, row_number() OVER (PARTITION BY class_code ORDER BY {H('42', KEY_SQL)}, speech_id, sent_idx) AS rn
      FROM train_rows WHERE len(string_split(sentence, ' ')) BETWEEN 9 AND 31)
WHERE rn <= {KSHOT // 4}""")
_letters = "['a', 'b', 'c', 'd']"
cte("shot_prefix", ["shots"], f"""
SELECT string_agg({s_msg('user', f"CASE WHEN rn = 1 THEN {lit(T.instruction + chr(10) * 2)} ELSE '' END || {s_q('sentence')}")}
                  || {s_msg('assistant', f"{lit(T.opening)} || {_letters}[class_code + 1] || ')'")}, '' ORDER BY rn) AS prefix,
       COUNT(*) AS n_shots
FROM (SELECT *, row_number() OVER (ORDER BY mix_hash, speech_id, sent_idx) AS rn FROM shots)""")
_full = "[" + ", ".join(lit(x) for x in FULL_LABELS) + "]"
cte("shot_groups", ["shots"], f"""
SELECT string_agg({lit(T.demo_head[0])} || {_full}[c + 1] || {lit(T.demo_head[1])} || COALESCE(b, '') || chr(10) || chr(10), '' ORDER BY c) AS block
FROM (SELECT c FROM range(0, 4) t(c)) cls
LEFT JOIN (SELECT class_code, string_agg('- ' || sentence, chr(10) ORDER BY mix_hash, speech_id, sent_idx) AS b FROM shots GROUP BY class_code) g
ON g.class_code = cls.c""")
cte("dist_text", ["train_rows"], f"""
SELECT {lit(T.shares[0])} || string_agg({lit(T.share[0])} || CAST(round(n * 100.0 / total)::BIGINT AS VARCHAR) || {lit(T.share[1])} || {_full}[class_code + 1] || {lit(T.share[2])}, {lit(T.shares[1])} ORDER BY class_code) || {lit(T.shares[2])} AS d
FROM (SELECT class_code, n, SUM(n) OVER () AS total FROM (SELECT class_code, COUNT(*) AS n FROM train_rows GROUP BY class_code))""")


# ---------------------------------------------------------------- queries
@register("prompt_zero_shot", with_ctes(["test_rows"], s_out(s_zero_msgs("sentence"), "test_rows")))
def q_prompt_zero_shot(spark, sf):
    return _out(P.prompt_zero_shot(_test(spark, sf)))


_TYPED = [s_msg("system", lit("text:" + T.system)), s_msg("user", f"{lit('text:' + T.instruction + chr(10) * 2)} || {s_q('sentence')}")]


@register("prompt_typed_content", with_ctes(["test_rows"], s_out(_TYPED, "test_rows", prompt=s_zero("sentence"))))
def q_prompt_typed_content(spark, sf):
    """Typed-part content; flattens to the same text."""
    return _out(P.prompt_typed_content(_test(spark, sf)))


@register("prompt_option_order", with_ctes(["test_rows"], s_out(s_zero_msgs("sentence", P.ALT_ORDER), "test_rows")))
def q_prompt_option_order(spark, sf):
    """Answer options in the alternative order."""
    return _out(P.prompt_zero_shot(_test(spark, sf), P.ALT_ORDER))


_CTX_BLOCK = (f"(CASE WHEN len(ctx) = 0 THEN {lit(T.prior_empty)} ELSE {lit(T.prior_head)} || "
              f"array_to_string(list_transform(ctx, lambda x: '- ' || x), chr(10)) END || {lit(T.prior_focus)})")
_CTX_SRC = ("(SELECT *, COALESCE(list(sentence) OVER (PARTITION BY speech_id ORDER BY sent_idx "
            "ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), []) AS ctx FROM test_rows)")


@register("prompt_prior_context", with_ctes(["test_rows"], s_out([
    s_sys(), s_msg("user", f"{lit(T.instruction + chr(10) * 2)} || {_CTX_BLOCK} || chr(10) || chr(10) || {s_q('sentence')}")], _CTX_SRC)))
def q_prompt_prior_context(spark, sf):
    """Bullets of up to 5 preceding sentences before the question."""
    c = W.prior_context(_test(spark, sf), 5)
    return _out(P.prompt_prior_context(c, "context"))


_RAG_SRC = "(SELECT t.*, r.retrieved FROM test_rows t LEFT JOIN retrieved r ON t.speech_id = r.speech_id AND t.sent_idx = r.sent_idx)"
_RAG_BLOCK = f"({lit(T.rag_head[0] + '8' + T.rag_head[1])} || COALESCE(retrieved, '') || {lit(T.rag_focus)})"


@register("prompt_retrieval", with_ctes(["test_rows", "retrieved"], s_out([
    s_sys(), s_msg("user", f"{lit(T.instruction + chr(10) * 2)} || {_RAG_BLOCK} || chr(10) || chr(10) || {s_q('sentence')}")], _RAG_SRC)))
def q_prompt_retrieval(spark, sf):
    """The 8 nearest train sentences (tf-idf) listed before the question."""
    from stancekit.plans.q_retrieval import retrieved
    t = _test(spark, sf).join(retrieved(spark, sf).select(*KEY, "retrieved"), KEY, "left")
    return _out(P.prompt_retrieval(t, "retrieved", 8))


def shots(spark, sf):
    return P.collect_shots(S.kshot_sample(_train(spark, sf), KSHOT, seed=42))


@register("prompt_kshot_dialogue", with_ctes(["test_rows", "shot_prefix"], s_out(
    [s_sys(), "prefix", s_msg("user", s_q("sentence"))], "test_rows, shot_prefix", "2 + 2 * n_shots")))
def q_prompt_kshot_dialogue(spark, sf):
    """16 shots as alternating turns, then the sentence."""
    return _out(P.prompt_kshot_dialogue(_test(spark, sf), shots(spark, sf)))


@register("prompt_kshot_grouped", with_ctes(["test_rows", "shot_groups"], s_out([
    s_sys(), s_msg("user", f"{lit(T.instruction + chr(10) * 2)} || block || {s_q('sentence')}")], "test_rows, shot_groups")))
def q_prompt_kshot_grouped(spark, sf):
    """16 shots as bullets under one heading per class."""
    return _out(P.prompt_kshot_grouped(_test(spark, sf), shots(spark, sf)))


@register("attach_kshot", with_ctes(["test_rows", "shot_prefix"], """
SELECT speech_id, sent_idx, md5(prefix) AS block_md5, n_shots::BIGINT AS n_shots FROM test_rows, shot_prefix"""))
def q_attach_kshot(spark, sf):
    """Every test row carries the same shot block."""
    a = P.attach_kshot(_test(spark, sf), shots(spark, sf))
    return a.select(*KEY, F.md5("shot_block").alias("block_md5"), "n_shots")


@register("inject_distribution", with_ctes(["test_rows", "dist_text"], s_out(
    s_zero_msgs("sentence"), "test_rows, dist_text",
    prompt=f"replace({s_zero('sentence')}, {lit(T.question_marker)}, d || chr(10) || chr(10) || {lit(T.question_marker)})")))
def q_inject_distribution(spark, sf):
    """Class shares of the train split put before the question."""
    dist = P.distribution_text(S.class_distribution(_train(spark, sf))).first()[0]  # one row
    return _out(P.inject_distribution(P.prompt_zero_shot(_test(spark, sf)), dist))


@register("collapse_newlines", """
SELECT doc_id, md5(regexp_replace(text, '\\n{3,}', chr(10) || chr(10), 'g')) AS text_md5,
       (length(text) - length(regexp_replace(text, '\\n{3,}', chr(10) || chr(10), 'g')))::BIGINT AS removed
FROM documents""")
def q_collapse_newlines(spark, sf):
    """Whole documents with runs of 3+ newlines cut to 2."""
    d = fx.table(spark, sf, "documents").select("doc_id", "text").withColumn("c", collapse_newlines(F.col("text")))
    return d.select("doc_id", F.md5("c").alias("text_md5"), (F.length("text") - F.length("c")).alias("removed"))


_INSTR = (f"{s_zero('s')} || {lit(T.opening)} || substring({_full}[class_code + 1], 2)")
_INSTR_SRC = ("(SELECT *, CASE WHEN len(string_split(sentence, ' ')) > 48 THEN array_to_string(list_slice(string_split(sentence, ' '), 1, 48), ' ') "
              "ELSE sentence END AS s, unnest(range(0, CASE WHEN class_code <> 0 THEN 6 ELSE 1 END)) AS copy_no FROM train_rows)")


@register("instruction_rows", with_ctes(["train_rows"], f"""
SELECT speech_id, sent_idx, copy_no::BIGINT AS copy_no, md5(p) AS text_md5, length(p)::BIGINT AS text_len
FROM (SELECT speech_id, sent_idx, copy_no, {_INSTR} AS p FROM {_INSTR_SRC})"""))
def q_instruction_rows(spark, sf):
    """Upsampled train rows as full training texts (prompt + answer)."""
    r = P.instruction_rows(S.upsample_minority(_train(spark, sf), 5))
    return r.select(*KEY, "copy_no", F.md5("text").alias("text_md5"), F.length("text").alias("text_len"))


@register("split_completion", with_ctes(["train_rows"], f"""
SELECT speech_id, sent_idx, md5(c) AS completion_md5, md5(left(p, length(p) - length(c))) AS prompt_md5
FROM (SELECT speech_id, sent_idx, p, string_split(p, '<|assistant|>' || chr(10))[-1] AS c
      FROM (SELECT speech_id, sent_idx, {_INSTR} AS p FROM (SELECT *, CASE WHEN len(string_split(sentence, ' ')) > 48 THEN array_to_string(list_slice(string_split(sentence, ' '), 1, 48), ' ') ELSE sentence END AS s FROM train_rows)))"""))
def q_split_completion(spark, sf):
    """Answer part vs prompt part of each training text."""
    r = P.split_completion(P.instruction_rows(_train(spark, sf)))
    return r.select(*KEY, F.md5("completion").alias("completion_md5"), F.md5("prompt_part").alias("prompt_md5"))
