"""DuckDB SQL fragments for the oracle side of the catalog.

Each fixture view is a CTE; ``with_ctes`` prefixes a query with the CTEs it
needs (dependencies first). Texts shared with the Spark side (templates,
names) come from the same Python constants.
"""
from __future__ import annotations

from stancekit.functions.answers import ANSWER_OPENING, KEYWORDS, LETTER_MARKS
from stancekit.functions.labels import FULL_LABELS, LETTERS
from stancekit.sources import fixtures as fx


def lit(s: str) -> str:
    """SQL string literal (DuckDB keeps raw newlines inside quotes)."""
    return "'" + s.replace("'", "''") + "'"


def H(seed: str, key: str) -> str:
    """Portable hash as BIGINT: first 8 hex digits of md5('<seed>:<key>')."""
    return f"(('0x' || substr(md5(CAST({seed} AS VARCHAR) || ':' || CAST({key} AS VARCHAR)), 1, 8))::BIGINT)"


def U(seed: str, key: str) -> str:
    return f"({H(seed, key)} / 4294967296.0)"


KEY_SQL = "(CAST(speech_id AS VARCHAR) || '-' || CAST(sent_idx AS VARCHAR))"


def arr(items) -> str:
    return "[" + ", ".join(lit(x) if isinstance(x, str) else str(x) for x in items) + "]"


def label_ids(c: str, fold4: bool = False) -> str:
    both = f"{c} IN (3, 4)" if fold4 else f"{c} = 3"
    return f"(CASE WHEN {both} THEN [1, 2] WHEN {c} BETWEEN 0 AND 2 THEN [{c}::INT] ELSE NULL END)"


def multi_hot(ids: str, k: int = 3) -> str:
    return "[" + ", ".join(f"CAST(list_contains({ids}, {j}) AS INT)" for j in range(k)) + "]"


def letter(c: str) -> str:
    return f"({arr(LETTERS)}[{c} + 1])"


def full_label(c: str) -> str:
    return f"({arr(FULL_LABELS)}[{c} + 1])"


def parse_letter(r: str) -> str:
    whens = " ".join(f"WHEN contains({r}, {lit(m)}) THEN {lit(l)}" for m, l in LETTER_MARKS)
    return f"(CASE {whens} END)"


def parse_keyword(r: str) -> str:
    whens = " ".join(f"WHEN contains(lower({r}), {lit(k)}) THEN {lit(l)}" for k, l in KEYWORDS)
    return f"(CASE {whens} END)"


def letter_vector(s: str) -> str:
    return (f"(CASE lower(trim({s})) WHEN 'a' THEN [1, 0, 0] WHEN 'b' THEN [0, 1, 0] "
            f"WHEN 'c' THEN [0, 0, 1] WHEN 'd' THEN [0, 1, 1] END)")


def words(s: str) -> str:
    return f"string_split({s}, ' ')"


def ratio(a: str, b: str) -> str:
    return f"COALESCE(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0), 0.0)"


CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, deps: list[str], body: str) -> None:
    CTES[name] = (deps, body)


def with_ctes(names: list[str], body: str) -> str:
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for d in CTES[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS (\n{CTES[n][1]}\n)" for n in order) + "\n" + body


cte("sentences", [], f"""
SELECT speech_id, sent_idx, sentence, class_code,
       CASE WHEN {U(str(fx.SPLIT_SEED), 'speech_id')} < {fx.TEST_SHARE} THEN 'test' ELSE 'train' END AS split
FROM (
  SELECT speech_id, class_code,
         unnest(sents) AS sentence,
         generate_subscripts(sents, 1) - 1 AS sent_idx
  FROM (
    SELECT d.doc_id AS speech_id, ((1 - l.quality) + 2 * l.toxic)::BIGINT AS class_code,
           list_filter(list_transform(string_split(regexp_replace(d.text, '([.!?])[ \\n]+', '\\1' || chr(31), 'g'), chr(31)),
                                      lambda x: trim(x)), lambda x: x <> '') AS sents
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id
  )
)""")

cte("test_rows", ["sentences"], "SELECT speech_id, sent_idx, sentence, class_code FROM sentences WHERE split = 'test'")
cte("train_rows", ["sentences"], "SELECT speech_id, sent_idx, sentence, class_code FROM sentences WHERE split = 'train'")

cte("turns", [], "SELECT conv_id AS speech_id, turn::BIGINT AS sent_idx, text AS sentence, role FROM conversations")

cte("vectors", [], """
SELECT vec_id, embedding, (label % 4)::BIGINT AS class_code,
       CASE WHEN vec_id % 10 = 0 THEN 'query' ELSE 'corpus' END AS role
FROM embeddings""")

_plain = [x.split(") ", 1)[1] for x in FULL_LABELS]
_runs = ", ".join(f"{{'seed': {s}, 'dist': {str(d).lower()}}}" for s, d in fx.RESPONSE_RUNS)
_short = fx.RESPONSE_MODEL.split("/")[-1]
_rkey = f"({KEY_SQL} || ':' || CAST(run.seed AS VARCHAR))"
cte("responses", ["test_rows"], f"""
SELECT {lit(_short)} || CASE WHEN run.dist THEN '_dist' ELSE '' END || '_k_0_seed_' || CAST(run.seed AS VARCHAR) AS run_tag,
       speech_id, sent_idx, sentence, class_code,
       CASE WHEN {U('13', _rkey)} < {fx.RESPONSE_FAILED} THEN NULL
            ELSE {lit(ANSWER_OPENING)} || (
              CASE WHEN {U('11', _rkey)} < {fx.RESPONSE_UNSURE} THEN 'unsure'
                   WHEN {U('11', _rkey)} < {fx.RESPONSE_NO_LETTER} THEN lower({arr(_plain)}[pcode + 1])
                   ELSE {arr(LETTERS)}[pcode + 1] || ') ' || {arr(_plain)}[pcode + 1] END)
       END AS model_response
FROM (
  SELECT t.*, run,
         CASE WHEN {U('5', _rkey)} < {fx.RESPONSE_AGREE} THEN class_code
              WHEN {U('7', _rkey)} < 0.92 THEN 0 WHEN {U('7', _rkey)} < 0.96 THEN 1
              WHEN {U('7', _rkey)} < 0.98 THEN 2 ELSE 3 END AS pcode
  FROM (SELECT *, unnest([{_runs}]) AS run FROM test_rows) t
)""")

cte("logits", ["test_rows"], f"""
SELECT speech_id, sent_idx, sentence, class_code,
       [{U('101', KEY_SQL)} - 0.5, {U('102', KEY_SQL)} - 0.5, {U('103', KEY_SQL)} - 0.5] AS logits
FROM test_rows""")


def _token_cte(name: str, seed: int, toks: str) -> None:
    cte(name, ["test_rows"], f"""
SELECT speech_id, sent_idx, pos, token,
       {U(str(seed), f"{KEY_SQL} || '-' || CAST(pos AS VARCHAR)")} - 0.5 AS score
FROM (
  SELECT speech_id, sent_idx, unnest(toks) AS token, generate_subscripts(toks, 1) - 1 AS pos
  FROM (SELECT speech_id, sent_idx, {toks} AS toks FROM test_rows)
)""")


_bpe = ("['<s>'] || flatten(list_transform(string_split(sentence, ' '), lambda x, i: "
        "CASE WHEN length(x) > 5 THEN [CASE WHEN i > 1 THEN 'Ġ' ELSE '' END || substring(x, 1, 5), substring(x, 6)] "
        "ELSE [CASE WHEN i > 1 THEN 'Ġ' ELSE '' END || x] END)) || ['</s>']")
_wp = ("flatten(list_transform(string_split(sentence, ' '), lambda x: "
       "CASE WHEN length(x) > 5 THEN [substring(x, 1, 5), '##' || substring(x, 6)] ELSE [x] END))")
_sym = f"regexp_extract_all(sentence, {lit(fx.SYMBOL_TOKEN)}, 0)"
_token_cte("bpe_tokens", 301, _bpe)
_token_cte("wordpiece_tokens", 302, _wp)
_token_cte("symbol_tokens", 303, _sym)
