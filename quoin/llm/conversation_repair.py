"""Repair of a conversation's structure by the cheapest edits, with a square-root checkpointed dynamic programme.

A row costs 0 to keep, 2 to give the other role and 3 to delete; an inserted turn without text costs 2; blank rows and
repeated ones must go, and a truncated row that stays costs 1 more. What remains must be an optional system turn and then
pairs of user and assistant turns, or nothing. Of the cheapest ways the one whose initials (D, I, K, R) are the least in
ASCII is taken.

A vector holds the least cost from a row to the end for each of four states: 0 nothing yet, 1 after system, 2 after user, 3
after assistant. Conversations are cut into blocks of about the square root of the longest one (256 rows at least); vectors
are kept at the borders of blocks only, the checkpoints, and a block's own vectors are computed again, from the checkpoint at
its end, while it is walked forward. Blocks of one conversation lie in different tasks: what a block does to a vector is a
table of 4 x 4 costs, and only these tables, one a block, meet in one place. Texts move twice: to be put in order, and to be
written out; the digest of a conversation is taken as a stream, since SHA-256 knows no other way.

Defined cases: rows are taken in the order (turn, role, text), null turns first; a null role or text is read as one space
by the query, and as blank by the operators; a role's initial is its first character, in its own case; a null conv_id is a
conversation like any other; rows that are repeated are duplicates of the first; a conversation without rows has an empty
audit; an empty table gives an empty result; very long texts stay whole; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quoin.operators.numbering import rank_within
from quoin.scratch import stored
from quoin.session import ship

#: Costs of edits; what a truncated row costs besides if it stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
NEVER = 1 << 40
#: The state after the turn that a state waits for (it is the user's but after a user), and after a kept row by its role's
#: place in ROLES.
ROLES, WANTED = "sua", ["user", "user", "assistant", "user"]
NEXT = [2, 2, 3, 2]
KEEP = [[1, 2, None, None], [None, 2, None, None], [None, None, 3, None], [None, 2, None, None]]
END = [0, 4, 2, 0]
BLANK = r"[^ \t-\r]"
LEAST_BLOCK = 256


# --- one block, in a Python worker ------------------------------------------------------------------------------------------


def _step(symbol: str, after: list[int]) -> list[int]:
    """The vector before a row, from the one after it. A symbol is 'a' + 3 * the role's place + fault (1: truncated, 2: must go)."""
    role, fault = divmod(ord(symbol) - 97, 3)
    v = []
    for q in range(4):
        best = DELETE + after[q]
        if fault < 2:
            best = min(best, fault * TRUNCATED + REROLE + after[NEXT[q]])
            if KEEP[q][role] is not None:
                best = min(best, fault * TRUNCATED + after[KEEP[q][role]])
        v.append(best)
    v[2], v[3] = min(v[2], INSERT + v[3]), min(v[3], INSERT + v[2])
    v[0], v[1] = min(v[0], INSERT + v[2]), min(v[1], INSERT + v[2])
    return v


def costs(symbols: str) -> list[int]:
    """The least costs from each state before the block to each state behind it, row by row: 4 x 4."""
    out = [[0] * 4 for _ in range(4)]
    for r in range(4):
        v = [0 if q == r else NEVER for q in range(4)]
        for s in reversed(symbols):
            v = _step(s, v)
        for q in range(4):
            out[q][r] = v[q]
    return [x for row in out for x in row]


def checkpoints(tables: list[list[int]]) -> list[list[int]]:
    """The vectors at the right borders of a conversation's blocks, from the tables of its second block on."""
    out = [END]
    for t in reversed(tables):
        right = out[-1]
        out.append([min(t[4 * q + r] + right[r] for r in range(4)) for q in range(4)])
    return out[::-1]


def walk(symbols: str, end: list[int], state: int, last: bool) -> tuple[int, str, int]:
    """(least cost from the block's begin, its edits, the state behind it): the vectors of the block, then forward."""
    vectors = [end]
    for s in reversed(symbols):
        vectors.append(_step(s, vectors[-1]))
    vectors.reverse()
    cost, edits, i = vectors[0][state], [], 0
    while i < len(symbols):
        role, fault = divmod(ord(symbols[i]) - 97, 3)
        now, after, kept = vectors[i][state], vectors[i + 1], KEEP[state][role]
        if now == DELETE + after[state]:
            edits.append("D")
        elif now == INSERT + vectors[i][NEXT[state]]:
            edits.append("I")
            state, i = NEXT[state], i - 1
        elif kept is not None and now == fault * TRUNCATED + after[kept]:
            edits.append("K")
            state = kept
        else:
            edits.append("R")
            state = NEXT[state]
        i += 1
    while last and END[state]:
        edits.append("I")
        state = NEXT[state]
    return cost, "".join(edits), state


# --- conversations ----------------------------------------------------------------------------------------------------------


def _met(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """A join in which a null key meets a null key."""
    for c in on:
        right = right.withColumnRenamed(c, f"_{c}")
    meets = [left[c].eqNullSafe(right[f"_{c}"]) for c in on]
    return left.join(right, meets, how).drop(*[f"_{c}" for c in on])


def placed_rows(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) in order: with pos from 1, fault ('blank', 'duplicate', 'truncated' or null, the first
    that holds) and symbol. Rows that are the same in every column are told apart, so that they may lie in many tasks."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("_tie", F.xxhash64(F.monotonically_increasing_id()))
    rows = stored(rank_within(rows, "conv_id", ["turn", "role", "text", "_tie"], "pos").drop("_tie"), "turns")
    blank = ~F.col("text").rlike(BLANK)
    same = F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text"), 256)
    rows = rows.withColumn("_blank", blank).withColumn("_same", F.when(~blank, same))
    firsts = rows.filter("not _blank").groupBy("conv_id", "_same").agg(F.min("pos").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    rows = _met(rows, firsts, ["conv_id", "_same"])
    last = F.substring(F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     ")), -1, 1)
    fault = F.when(F.col("_blank"), "blank").when(F.col("pos") > F.col("_first"), "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    rows = rows.withColumn("fault", fault)
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    weight = F.when(F.col("fault").isin("blank", "duplicate"), 2).when(F.col("fault") == "truncated", 1).otherwise(0)
    return rows.select("conv_id", "turn", "role", "text", "pos", "fault", F.chr(97 + 3 * role + weight).alias("symbol"))


def _illegal(one: Column, other: Column) -> Column:
    """Whether two neighbours are none of system-user, user-assistant and assistant-user."""
    role = lambda s: F.floor((F.ascii(s) - 97) / 3)
    return ~F.coalesce((F.concat(role(one), role(other))).isin("01", "12", "21"), F.lit(True))


def blocks_of(rows: DataFrame) -> DataFrame:
    """conv_id, block (from 0), symbols of the block's rows in order, following (the next block's first symbol, or null),
    illegal (pairs of neighbours, that with the next block included)."""
    longest = rows.agg(F.max("pos")).first()[0] or 0
    size = max(LEAST_BLOCK, isqrt(longest) + 1)
    some = rows.groupBy("conv_id", F.floor((F.col("pos") - 1) / size).alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", "symbol"))).alias("all"))
    some = some.select("conv_id", "block", F.transform("all", lambda r: r["symbol"]).alias("all"))
    some = some.withColumn("following", F.lead(F.col("all")[0]).over(Window.partitionBy("conv_id").orderBy("block")))
    beside = F.transform("all", lambda s, i: _illegal(s, F.coalesce(F.get("all", i + 1), "following")).cast("long"))
    return some.select("conv_id", "block", F.array_join("all", "").alias("symbols"), "following", F.aggregate(beside, F.lit(0).cast("long"), lambda a, x: a + x).alias("illegal"))


def cheapest_edits(rows: DataFrame) -> DataFrame:
    """placed_rows as conv_id, illegal, cost, audit."""
    ship(rows.sparkSession)
    blocks = stored(blocks_of(rows), "blocks")

    @F.pandas_udf("array<long>")
    def tables(symbols: pd.Series) -> pd.Series:
        return symbols.map(costs)

    @F.pandas_udf("array<array<long>>")
    def borders(all_tables: pd.Series) -> pd.Series:
        return all_tables.map(lambda some: checkpoints([list(t) for t in some]))

    @F.pandas_udf("array<int>")
    def exits(symbols: pd.Series, end: pd.Series) -> pd.Series:
        return pd.Series([[walk(s, list(e), q, False)[2] for q in range(4)] for s, e in zip(symbols, end, strict=True)], dtype=object)

    @F.pandas_udf("array<int>")
    def entries(all_exits: pd.Series) -> pd.Series:
        def chain(some: list) -> list[int]:
            out = [0]
            for e in some:
                out.append(int(e[out[-1]]))
            return out

        return all_exits.map(chain)

    @F.pandas_udf("cost long, edits string")
    def walked(symbols: pd.Series, end: pd.Series, state: pd.Series, last: pd.Series) -> pd.DataFrame:
        found = [walk(s, list(e), int(q), bool(z)) for s, e, q, z in zip(symbols, end, state, last, strict=True)]
        return pd.DataFrame({"cost": [f[0] for f in found], "edits": [f[1] for f in found]})

    def gathered(some: DataFrame, name: str) -> DataFrame:
        """One row a conversation with what its blocks say, in order: as many as the square root of its rows."""
        met = F.sort_array(F.collect_list(F.struct("block", name)))
        return some.groupBy("conv_id").agg(F.transform(met, lambda b: b[name]).alias("all"))

    # Most conversations are one block and need no table.
    ends = gathered(blocks.filter("block > 0").select("conv_id", "block", tables("symbols").alias("table")), "table")
    ends = ends.select("conv_id", F.posexplode(borders("all")).alias("block", "end"))
    held = _met(blocks, ends.withColumn("block", F.col("block").cast("long")), ["conv_id", "block"])
    held = held.withColumn("end", F.coalesce("end", F.array(*[F.lit(x).cast("long") for x in END])))
    held = stored(held, "checkpoints")
    left = gathered(held.filter("following is not null").select("conv_id", "block", exits("symbols", "end").alias("exits")), "exits")
    left = left.select("conv_id", F.posexplode(entries("all")).alias("block", "state"))
    held = _met(held, left.withColumn("block", F.col("block").cast("long")), ["conv_id", "block"])
    found = held.select("conv_id", "block", "illegal", walked("symbols", "end", F.coalesce("state", F.lit(0)), F.col("following").isNull()).alias("w"))
    edits = F.sort_array(F.collect_list(F.struct("block", "w.edits")))
    return found.groupBy("conv_id").agg(F.sum("illegal").alias("illegal"), F.max(F.when(F.col("block") == 0, F.col("w.cost"))).alias("cost"), F.array_join(F.transform(edits, lambda b: b["edits"]), "").alias("audit"))


def _written(batches: Iterator[pa.RecordBatch], rows: int = 2048) -> Iterator[list[tuple]]:
    """(conv_id, role, text) of the repaired turns, from each conversation's audit followed by its rows in order."""
    conv, audit, at, state, out = object(), "", 0, 0, []

    def inserted() -> None:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            out.append((conv, WANTED[state], ""))
            state, at = NEXT[state], at + 1

    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            part = batch.slice(k, rows)
            for c, said, role, text in zip(*(part.column(n).to_pylist() for n in ("conv_id", "audit", "role", "text")), strict=True):
                if said is not None:
                    conv, audit, at, state = c, said, 0, 0
                    inserted()
                    continue
                edit, at = audit[at], at + 1
                if edit == "K":
                    out.append((conv, role, text))
                    state = KEEP[state][ROLES.find(role[0])]
                elif edit == "R":
                    out.append((conv, WANTED[state], text))
                    state = NEXT[state]
                inserted()
            yield out
            out.clear()


def _in_order(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation in one task and in order: its audit, then its rows."""
    heads = found.select("conv_id", F.lit(0).cast("long").alias("pos"), "audit", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    both = heads.unionByName(rows.select("conv_id", "pos", F.lit(None).cast("string").alias("audit"), "role", "text"))
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "pos")


def repaired_turns(rows: DataFrame, found: DataFrame) -> DataFrame:
    """placed_rows and cheapest_edits as the repaired conversations: conv_id, turn (from 0), role, text."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, turn = object(), 0
        for some in _written(batches):
            turns = []
            for c, _, _ in some:
                conv, turn = c, turn + 1 if c == conv else 0
                turns.append(turn)
            if some:
                columns = [pa.array([s[0] for s in some], kind), pa.array(turns, pa.int64()), pa.array([s[1] for s in some], pa.string()), pa.array([s[2] for s in some], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["conv_id", "turn", "role", "text"])

    kind = to_arrow_type(rows.schema["conv_id"].dataType)
    return _in_order(rows, found).mapInArrow(run, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, turn long, role string, text string")


def repaired_digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of the repaired turns as `role:text`, joined by line breaks, for conversations that have any."""
    ship(rows.sparkSession)
    kind = to_arrow_type(rows.schema["conv_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest = object(), None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([digest.hexdigest()])], ["conv_id", "repaired_sha256"])

        for some in _written(batches):
            for c, role, text in some:
                if digest is None or c != conv:
                    if digest is not None:
                        yield row()
                    conv, digest = c, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
        if digest is not None:
            yield row()

    return _in_order(rows, found).mapInArrow(run, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) with the faults that the query mends, by the CRC of `conv_id:turn`."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    drawn = F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")), F.lit(20))
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), drawn.alias("_drawn")).filter("_drawn <> 0")
    text = F.when(F.col("_drawn") == 1, "").when(F.col("_drawn") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.withColumn("text", text).withColumn("role", F.when(F.col("_drawn") == 4, "user").otherwise(F.col("role")))
    return rows.withColumn("_copy", F.explode(F.when(F.col("_drawn") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_drawn", "_copy")


def summary(rows: DataFrame) -> DataFrame:
    """placed_rows as conv_id, gaps, blank, duplicate, truncated."""
    turns = rows.groupBy("conv_id", "turn").agg(*[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")])
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
    return turns.groupBy("conv_id").agg(gaps.cast("long").alias("gaps"), *[F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated")])


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = placed_rows(damaged(conversations))
    found = stored(cheapest_edits(rows), "edits")
    out = conversations.select("conv_id").distinct()
    for part in (summary(rows), found, repaired_digests(rows, found)):
        out = _met(out, part, ["conv_id"])
    count = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *count, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


# The oracle goes forward: the least (cost, audit) for each state and number of rows, with up to three turns inserted before each.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(k) + 1), lambda i: unicode(substring(k, i, 1))::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, _: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""
OP13_SQL = rf"""
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
drawn AS (SELECT *, {_CRC} % 20 AS h FROM keyed),
hurt AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE WHEN h = 1 THEN '' WHEN h = 2 THEN replace(replace(replace(text, '.', ''), '!', ''), '?', '') ELSE text END AS text
         FROM drawn, (VALUES (0), (1)) c(again) WHERE h <> 0 AND (again = 0 OR h = 3)),
seq AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS nth,
             left(role, 1) AS c, NOT regexp_matches(text, '[^ \t-\r]') AS void, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS tail
         FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM hurt)),
r AS MATERIALIZED (SELECT *, CASE WHEN void THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN tail NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
            lead(c) OVER (PARTITION BY conv_id ORDER BY pos) AS following FROM seq),
n AS (SELECT conv_id, max(pos) AS last, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
        count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
        count(*) FILTER (WHERE following IS NOT NULL AND c || following NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY 1),
ins(q, to_, cost, audit, rows_) AS (VALUES
  (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []),
  (0, 2, 2, 'I', ['user:']), (1, 2, 2, 'I', ['user:']), (2, 3, 2, 'I', ['assistant:']), (3, 2, 2, 'I', ['user:']),
  (0, 3, 4, 'II', ['user:', 'assistant:']), (1, 3, 4, 'II', ['user:', 'assistant:']), (2, 2, 4, 'II', ['assistant:', 'user:']), (3, 3, 4, 'II', ['user:', 'assistant:'])),
edit(q, c, to_, cost, letter, role) AS (VALUES (0, 's', 1, 0, 'K', NULL), (0, 'u', 2, 0, 'K', NULL), (1, 'u', 2, 0, 'K', NULL), (2, 'a', 3, 0, 'K', NULL), (3, 'u', 2, 0, 'K', NULL),
  (0, NULL, 2, 2, 'R', 'user'), (1, NULL, 2, 2, 'R', 'user'), (2, NULL, 3, 2, 'R', 'assistant'), (3, NULL, 2, 2, 'R', 'user'),
  (0, NULL, 0, 3, 'D', NULL), (1, NULL, 1, 3, 'D', NULL), (2, NULL, 2, 3, 'D', NULL), (3, NULL, 3, 3, 'D', NULL)),
dp AS (
  SELECT conv_id, 0::BIGINT AS pos, 0 AS q, {{'cost': 0::BIGINT, 'audit': '', 'kept': []::VARCHAR[]}} AS best FROM n
  UNION ALL
  SELECT d.conv_id, d.pos + 1, e.to_, min({{'cost': d.best.cost + i.cost + e.cost + CASE WHEN r.fault = 'truncated' AND e.letter <> 'D' THEN 1 ELSE 0 END, 'audit': d.best.audit || i.audit || e.letter,
      'kept': d.best.kept || i.rows_ || CASE e.letter WHEN 'D' THEN [] WHEN 'K' THEN [r.role || ':' || r.text] ELSE [e.role || ':' || r.text] END}})
  FROM dp d JOIN r ON r.conv_id IS NOT DISTINCT FROM d.conv_id AND r.pos = d.pos + 1 JOIN ins i ON i.q = d.q JOIN edit e ON e.q = i.to_
  WHERE (e.c IS NULL OR e.c = r.c) AND (e.letter = 'D' OR r.fault NOT IN ('blank', 'duplicate')) GROUP BY 1, 2, 3),
done AS (
  SELECT d.conv_id, min({{'cost': d.best.cost + i.cost, 'audit': d.best.audit || i.audit, 'kept': d.best.kept || i.rows_}}) AS best
  FROM dp d JOIN n ON n.conv_id IS NOT DISTINCT FROM d.conv_id AND n.last = d.pos JOIN ins i ON i.q = d.q AND i.to_ IN (0, 3) GROUP BY 1)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(done.best.cost, 0)::BIGINT AS cost, coalesce(done.best.audit, '') AS audit, sha256(coalesce(array_to_string(done.best.kept, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM o.conv_id
"""
