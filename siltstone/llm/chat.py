"""Preference formatting, in DataFrame functions alone.

The longest common turn prefix of a chosen and a rejected conversation is rendered once, as the prompt; what follows in
either is a completion, with the spans of its assistant turns: those count for the loss, all else is masked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a turn is rendered: before the role, between role and text, after the text.
TEMPLATE = ("<|", "|>\n", "<|end|>\n")


def _render(turns: Column, template: tuple[str, str, str]) -> Column:
    a, b, c = template
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(a), t["role"], F.lit(b), t["text"], F.lit(c))), "")


def _spans(turns: Column, begin: Column, template: tuple[str, str, str], role: str) -> Column:
    """(start, end) in characters of the texts of the role's turns, each with its end mark, the first turn being at `begin`."""
    a, b, c = template
    start = F.struct(begin.cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        text = acc["at"] + len(a) + F.length(t["role"]) + len(b)
        end = text + F.length(t["text"]) + len(c)
        found = F.when(t["role"] == role, F.array(F.struct(text.alias("start"), end.alias("end")))).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], found).alias("spans"))

    return F.aggregate(turns, start, step)["spans"]


def conversations(turns: DataFrame, id_col: str, turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, turns): a row a conversation with its turns in order; a null role counts as "unknown", a null text as empty.

    A conversation is one row of the output, so its turns come together; nothing else does. Turns of equal number are
    ordered by role and text; repeated rows stay.
    """
    t = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("unknown")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = F.transform(F.array_sort(F.collect_list(t)), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    return turns.groupBy(F.col(id_col).alias("id")).agg(ordered.alias("turns"))


def preferences(chosen: DataFrame, rejected: DataFrame, template: tuple[str, str, str] = TEMPLATE, role: str = "assistant") -> DataFrame:
    """A row a pair of conversations (id, turns) of equal id: id, n_prompt_turns, prompt, and completion and spans of either.

    Spans count from the beginning of prompt + completion. Pairs without a common turn have an empty prompt, equal
    conversations empty completions. Ids that only one side has, and null ids, make no pair; ids are taken to be distinct
    on each side. Empty tables give no rows.
    """
    both = chosen.select("id", F.col("turns").alias("a")).join(rejected.select("id", F.col("turns").alias("b")), "id")
    same = F.zip_with("a", "b", lambda x, y: x.eqNullSafe(y))
    first = F.array_position(same, False)
    both = both.withColumn("n", F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int"))
    rest = {s: F.slice(s, F.col("n") + 1, F.greatest(F.size(s), F.lit(1))) for s in "ab"}
    both = both.select("id", "n", _render(F.slice("a", 1, F.col("n")), template).alias("prompt"), rest["a"].alias("a"), rest["b"].alias("b"))
    size = F.length("prompt")
    return both.select(
        "id",
        F.col("n").cast("bigint").alias("n_prompt_turns"),
        "prompt",
        *[x for s, name in (("a", "chosen"), ("b", "rejected")) for x in (_render(F.col(s), template).alias(name), _spans(F.col(s), size, template, role).alias(f"{name}_spans"))],
    )


def answers_swapped(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs from a table (conv_id, turn, role, text): each conversation up to its last answer, chosen as it is, and rejected
    with the last answer of the conversation whose id is next to its own (2k and 2k + 1).

    Conversations without an answer, or whose neighbour has none, make no pair.
    """
    whole = conversations(turns.where(F.col("conv_id").isNotNull()), "conv_id")
    last = F.aggregate(F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i + 1).otherwise(0)), F.lit(0), lambda x, y: F.greatest(x, y))
    whole = whole.withColumn("last", last).where("last > 0").select("id", F.slice("turns", 1, F.col("last")).alias("turns"))
    answer = whole.select(F.col("id").bitwiseXOR(1).alias("id"), F.element_at("turns", -1).alias("answer"))
    chosen = whole.join(answer.select("id"), "id", "left_semi")
    rejected = whole.join(answer, "id").select("id", F.concat(F.slice("turns", 1, F.size("turns") - 1), F.array("answer")).alias("turns"))
    return chosen, rejected


def digest(pairs: DataFrame) -> DataFrame:
    """preferences() rows with the spans as text."""
    shown = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return pairs.select(F.col("id").alias("conv_id"), "n_prompt_turns", "prompt", "chosen", shown("chosen_spans").alias("chosen_spans"), "rejected", shown("rejected_spans").alias("rejected_spans"))


#: digest(preferences(*answers_swapped(conversations))) in DuckDB's SQL.
SQL = """
WITH t AS (SELECT conv_id AS id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS txt,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS r
           FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT id, max(r) AS n FROM t WHERE role = 'assistant' GROUP BY id),
a AS (SELECT l.id, l.n, t.txt FROM l JOIN t ON t.id = l.id AND t.r = l.n),
p AS (SELECT a.id, a.n, a.txt AS good, b.txt AS bad FROM a JOIN a b ON b.id = xor(a.id, 1)),
s AS (SELECT p.id, p.n, p.good = p.bad AS same, t.r, '<|' || t.role || '|>' || chr(10) || t.txt || '<|end|>' || chr(10) AS turn_text
      FROM p JOIN t ON t.id = p.id AND t.r < p.n),
q AS (SELECT p.id, p.n - CASE WHEN p.good = p.bad THEN 0 ELSE 1 END AS n_prompt_turns,
             coalesce((SELECT string_agg(turn_text, '' ORDER BY r) FROM s WHERE s.id = p.id), '')
             || CASE WHEN p.good = p.bad THEN '<|assistant|>' || chr(10) || p.good || '<|end|>' || chr(10) ELSE '' END AS prompt,
             p.good, p.bad, p.good = p.bad AS same FROM p)
SELECT id AS conv_id, n_prompt_turns, prompt,
       CASE WHEN same THEN '' ELSE '<|assistant|>' || chr(10) || good || '<|end|>' || chr(10) END AS chosen,
       CASE WHEN same THEN '' ELSE (length(prompt) + 14)::VARCHAR || '-' || (length(prompt) + 14 + length(good) + 8)::VARCHAR END AS chosen_spans,
       CASE WHEN same THEN '' ELSE '<|assistant|>' || chr(10) || bad || '<|end|>' || chr(10) END AS rejected,
       CASE WHEN same THEN '' ELSE (length(prompt) + 14)::VARCHAR || '-' || (length(prompt) + 14 + length(bad) + 8)::VARCHAR END AS rejected_spans
FROM q
"""
