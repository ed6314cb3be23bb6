"""Preference formatting of chat turns (DataFrame expressions only).

The turns that the chosen and the rejected conversation of a pair begin with in common are rendered once, as the prompt;
what follows on each side is a completion, whose assistant text alone is trained on.

Defined cases: turns count in the order (turn, role, text); a null role or text is rendered as empty but differs from
an empty one; a pair without one of its sides has an empty completion there; if both sides are equal, all of it is prompt
and both completions are empty; rows without pair or side belong to no conversation and are not rendered; an empty table
gives an empty result; a row that is repeated is rendered as often; very long texts stay whole; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _head(t: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(t["role"], F.lit("")), F.lit("|>\n"))


def _rendered(t: Column) -> Column:
    return F.concat(_head(t), F.coalesce(t["text"], F.lit("")), F.lit("<|end|>\n"))


def _masks(turns: Column) -> Column:
    """[start, end) character ranges of the rendered turns that are trained on: assistant text and its end mark."""
    kind = "struct<at:int,spans:array<struct<start:int,end:int>>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")).cast(kind)

    def step(acc: Column, t: Column) -> Column:
        begin, end = acc["at"] + F.length(_head(t)), acc["at"] + F.length(_rendered(t))
        own = F.array(F.struct(begin.alias("start"), (end - 1).alias("end")))
        spans = F.when(t["role"] == "assistant", F.concat(acc["spans"], own)).otherwise(acc["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def format_preferences(turns: DataFrame) -> DataFrame:
    """turns (pair_id, side 'chosen' or 'rejected', turn, role, text). One row for each pair: pair_id, n_common, prompt,
    chosen, rejected (texts), chosen_mask, rejected_mask (ranges to train on)."""
    one = F.struct("turn", "role", "text")
    side = lambda s: F.sort_array(F.collect_list(F.when(F.col("side") == s, one)))
    rows = turns.filter("pair_id is not null and side in ('chosen', 'rejected')")
    pairs = rows.groupBy("pair_id").agg(side("chosen").alias("c"), side("rejected").alias("r"))
    for x in ("c", "r"):
        pairs = pairs.withColumn(x, F.transform(x, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))
    same = F.zip_with("c", "r", lambda a, b: a.eqNullSafe(b))
    pairs = pairs.withColumn("n_common", F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size("c").cast("long")))
    rest = lambda x: F.slice(x, (F.col("n_common") + 1).cast("int"), F.greatest(F.size(x), F.lit(1)))
    text = lambda t: F.array_join(F.transform(t, _rendered), "")
    return pairs.select(
        "pair_id", "n_common", text(F.slice("c", F.lit(1), F.col("n_common").cast("int"))).alias("prompt"),
        text(rest("c")).alias("chosen"), text(rest("r")).alias("rejected"), _masks(rest("c")).alias("chosen_mask"), _masks(rest("r")).alias("rejected_mask"),
    )


def derived_pairs(conversations: DataFrame) -> DataFrame:
    """Pairs from plain conversations: chosen is a conversation; rejected has its first 1 + conv_id mod 3 turns, and then
    the later turns of the conversation whose conv_id is one less."""
    turns = conversations.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    shared = turns.filter(F.col("turn") <= F.pmod(F.col("pair_id"), F.lit(3)))
    after = turns.withColumn("pair_id", F.col("pair_id") + 1).filter(F.col("turn") > F.pmod(F.col("pair_id"), F.lit(3)))
    after = after.join(turns.select("pair_id").distinct(), "pair_id", "left_semi")
    other = shared.unionByName(after).withColumn("side", F.lit("rejected"))
    return turns.withColumn("side", F.lit("chosen")).unionByName(other)


def op4_preference_format(spark, sf_dir: str) -> DataFrame:
    out = format_preferences(derived_pairs(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    ranges = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    digest = lambda c: F.sha2(F.col(c), 256).alias(f"{c}_sha256")
    return out.select("pair_id", "n_common", digest("prompt"), digest("chosen"), digest("rejected"), ranges("chosen_mask").alias("chosen_mask"), ranges("rejected_mask").alias("rejected_mask"))


_RENDER = "concat('<|', coalesce(role, ''), '|>', chr(10), coalesce(text, ''), '<|end|>', chr(10))"
OP4_SQL = f"""
WITH t AS (SELECT conv_id AS pair_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
rejected AS (
  SELECT * FROM t WHERE turn <= pair_id % 3
  UNION ALL
  SELECT n.pair_id, t.turn, t.role, t.text FROM t JOIN (SELECT DISTINCT pair_id FROM t) n ON n.pair_id = t.pair_id + 1 WHERE t.turn > n.pair_id % 3),
both_sides AS (SELECT 'c' AS side, * FROM t UNION ALL SELECT 'r', * FROM rejected),
r AS (SELECT side, pair_id, role, text, row_number() OVER (PARTITION BY side, pair_id ORDER BY turn, role, text) AS pos, {_RENDER} AS shown FROM both_sides),
lcp AS (
  SELECT pair_id, coalesce(min(pos) FILTER (WHERE NOT same) - 1, max(pos)) AS n_common
  FROM (SELECT coalesce(c.pair_id, x.pair_id) AS pair_id, coalesce(c.pos, x.pos) AS pos,
               c.pos IS NOT NULL AND x.pos IS NOT NULL AND c.role IS NOT DISTINCT FROM x.role AND c.text IS NOT DISTINCT FROM x.text AS same
        FROM (SELECT * FROM r WHERE side = 'c') c FULL JOIN (SELECT * FROM r WHERE side = 'r') x ON c.pair_id = x.pair_id AND c.pos = x.pos) GROUP BY 1),
placed AS (
  SELECT r.*, n_common, pos > n_common AS later,
         sum(length(shown)) OVER (PARTITION BY side, pair_id, pos > n_common ORDER BY pos) AS stop FROM r JOIN lcp USING (pair_id)),
out AS (
  SELECT pair_id, any_value(n_common) AS n_common,
    coalesce(string_agg(shown, '' ORDER BY pos) FILTER (WHERE side = 'c' AND NOT later), '') AS prompt,
    coalesce(string_agg(shown, '' ORDER BY pos) FILTER (WHERE side = 'c' AND later), '') AS chosen,
    coalesce(string_agg(shown, '' ORDER BY pos) FILTER (WHERE side = 'r' AND later), '') AS rejected,
    coalesce(string_agg(concat(stop - length(shown) + length(role) + 5, '-', stop - 1), ',' ORDER BY pos) FILTER (WHERE side = 'c' AND later AND role = 'assistant'), '') AS chosen_mask,
    coalesce(string_agg(concat(stop - length(shown) + length(role) + 5, '-', stop - 1), ',' ORDER BY pos) FILTER (WHERE side = 'r' AND later AND role = 'assistant'), '') AS rejected_mask
  FROM placed GROUP BY 1)
SELECT pair_id, n_common, sha256(prompt) AS prompt_sha256, sha256(chosen) AS chosen_sha256, sha256(rejected) AS rejected_sha256, chosen_mask, rejected_mask FROM out
"""
