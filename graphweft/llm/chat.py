"""Chat formatting after the collapse of cumulative snapshots (operator 9).

Logs often hold a conversation again and again, each time some turns longer. The state of a
conversation after a turn is the hash of its turns so far; a conversation whose last state
is an earlier state of another one is a snapshot and goes, by an anti-join on the hash. Of
conversations with the same turns the smallest id stays. What stays is rendered with one
template.

A state is the exclusive-or of 2 x 64-bit hashes of (turn, role, text), which is a running
sum: it needs no turn list, so a conversation of any length is hashed in blocks of turns
that are put together by a window over blocks. What is rendered together is a bounded number
of *rows*: rows are numbered within their conversation by ranges, whatever their turn numbers
are. Only DataFrame functions are used.

Defined results: a null role is ``unknown``, a null text is empty, a null turn comes after
all others, a null conv_id is an id of its own, the largest. Repeated rows of a conversation
count once; different rows with the same turn stand together, in order of role and text, and
a state includes all of them. Marker strings inside a text are broken up by a blank. An
empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from graphweft.llm.running import numbered
from graphweft.session import cut_lineage

_LAST = 9223372036854775807


@dataclass(frozen=True)
class ChatParams:
    """``block`` turn numbers are hashed together, and ``block`` rows of a conversation at most
    are rendered into one row; a longer conversation has several parts, in order."""

    block: int = 1024
    begin: str = "<|im_start|>"
    end: str = "<|im_end|>"


def _normal(turns: DataFrame, p: ChatParams) -> DataFrame:
    rows = turns.select("conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(_LAST)).alias("turn"),
                        F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("part", F.floor(F.col("turn") / p.block).cast("long"))


def states(turns: DataFrame, params: ChatParams | None = None) -> DataFrame:
    """State of every conversation after every turn: conv_id, turn, h1, h2, n (rows so far)
    and ``last`` (whether it is the conversation's last turn)."""
    p = params or ChatParams()
    rows = _normal(turns, p)
    code = [F.xxhash64(F.lit(seed), "turn", "role", "text").alias(f"h{seed}") for seed in (1, 2)]
    # 24 bytes for each row; repeated rows go before anything is put together
    coded = rows.select("conv_id", "part", "turn", *code).distinct()
    each = coded.groupBy("conv_id", "part", "turn").agg(
        F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"), F.count(F.lit(1)).alias("n"))
    blocks = each.groupBy("conv_id", "part").agg(
        F.bit_xor("h1").alias("b1"), F.bit_xor("h2").alias("b2"), F.sum("n").alias("bn"), F.max("turn").alias("block_last"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")
    blocks = blocks.select(F.col("conv_id").alias("c"), F.col("part").alias("k"),
                           F.coalesce(F.bit_xor("b1").over(before), F.lit(0)).alias("b1"),
                           F.coalesce(F.bit_xor("b2").over(before), F.lit(0)).alias("b2"),
                           F.coalesce(F.sum("bn").over(before), F.lit(0)).alias("bn"),
                           F.max("block_last").over(whole).alias("conv_last"))
    inside = Window.partitionBy("conv_id", "part").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    run = each.select("conv_id", "part", "turn", F.bit_xor("h1").over(inside).alias("h1"),
                      F.bit_xor("h2").over(inside).alias("h2"), F.sum("n").over(inside).alias("n"))
    joined = run.join(blocks, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("k")))
    return joined.select("conv_id", "turn", F.col("h1").bitwiseXOR(F.col("b1")).alias("h1"),
                         F.col("h2").bitwiseXOR(F.col("b2")).alias("h2"), (F.col("n") + F.col("bn")).alias("n"),
                         (F.col("turn") == F.col("conv_last")).alias("last"))


def maximal(turns: DataFrame, params: ChatParams | None = None) -> DataFrame:
    """Conversations to keep, one for each distinct turn sequence that is no proper prefix of
    another: conv_id, n (turns) and n_same (conversations with just these turns)."""
    every = cut_lineage(states(turns, params))
    state = ["h1", "h2", "n"]
    least = F.min(F.struct(F.col("conv_id").isNull().alias("no_id"), F.col("conv_id"))).alias("least")
    whole = every.filter("last").groupBy(*state).agg(least, F.count(F.lit(1)).alias("n_same"))
    earlier = every.filter("not last").select(*state).distinct()
    return whole.join(earlier, state, "left_anti").select(F.col("least.conv_id").alias("conv_id"), "n", "n_same")


def render(turns: DataFrame, kept: DataFrame, params: ChatParams | None = None) -> DataFrame:
    """Text of the conversations in ``kept`` (conv_id), in parts of ``block`` rows: conv_id,
    part, n_turns, text."""
    p = params or ChatParams()
    chosen = kept.select(F.col("conv_id").alias("c"))
    rows = _normal(turns, p).drop("part")
    rows = rows.join(chosen, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi").distinct()
    rows = numbered(rows, "conv_id", ["turn", "role", "text"], "row")
    rows = rows.withColumn("part", F.floor(F.col("row") / p.block).cast("long"))

    def plain(name: str) -> F.Column:
        c = F.col(name)
        for marker in (p.begin, p.end):
            c = F.replace(c, F.lit(marker), F.lit(f"{marker[:1]} {marker[1:]}"))
        return c

    line = F.concat(F.lit(p.begin), plain("role"), F.lit("\n"), plain("text"), F.lit(p.end), F.lit("\n"))
    listed = rows.groupBy("conv_id", "part").agg(
        F.array_sort(F.collect_list(F.struct("row", line.alias("line")))).alias("turns"))
    return listed.select("conv_id", "part", F.size("turns").cast("long").alias("n_turns"),
                         F.array_join(F.col("turns.line"), "").alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: all conversations that are no prefix of another, rendered."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return render(turns, maximal(turns))


#: The same by concatenated texts instead of hashes (conversations fit one value there).
ORACLE = """
WITH t AS (
  SELECT DISTINCT conv_id, coalesce(turn, 9223372036854775807) AS turn, coalesce(role, 'unknown') AS role,
         coalesce(text, '') AS text
  FROM conversations),
w AS (
  SELECT conv_id, turn, '[' || turn || '|' || length(role) || '|' || role || '|' || length(text) || '|' || text || ']' AS code,
         '<|im_start|>' || replace(replace(role, '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') || chr(10)
         || replace(replace(text, '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') || '<|im_end|>' || chr(10) AS line,
         role, text
  FROM t),
s AS (
  SELECT conv_id, turn, string_agg(code, '') OVER (PARTITION BY conv_id ORDER BY turn, role, text
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS state,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back,
         max(turn) OVER (PARTITION BY conv_id) AS conv_last,
         lead(turn) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS next_turn
  FROM w),
finals AS (SELECT state, min(conv_id) AS conv_id FROM s WHERE back = 1 GROUP BY state),
kept AS (
  SELECT conv_id FROM finals
  WHERE state NOT IN (SELECT state FROM s WHERE turn < conv_last AND next_turn > turn))
SELECT conv_id, CAST(floor((k - 1) / 1024.0) AS BIGINT) AS part, count(*) AS n_turns, string_agg(line, '' ORDER BY k) AS text
FROM (SELECT w.conv_id, w.line, row_number() OVER (PARTITION BY w.conv_id ORDER BY w.turn, w.role, w.text) AS k
      FROM w JOIN kept ON w.conv_id IS NOT DISTINCT FROM kept.conv_id)
GROUP BY 1, 2
"""
