"""Conversation structure repair: the cheapest edits after which the roles of a conversation take turns.

A conversation's rows, by turn (nulls first, then role, then text), are brought into the form
``(system? (user assistant)+)?``, read from the first letters of the roles. Edits and their costs:
(K)eep 0, (R)erole to user or assistant 1, (D)elete 2, (I)nsert an empty row of user or assistant 5. Blank
rows and rows whose role and text stood earlier in the conversation must go; a truncated row that stays adds 5.
Of equally cheap ways the one whose edits' letters, in order, are smallest in ASCII.

Dijkstra's algorithm walks the lattice of (row, grammar state), which exists only as far as it is reached, with
(cost, letters) as its key. Rows are ranged by (conversation, turn), so a conversation of any length lies in
blocks of at most ``BLOCK`` rows, none of which is ever gathered with another one's texts. In each block the walk
starts once from each state it can be entered in; then the same walk over (block, state) takes these results as its
edges and stops at the first end node it pops that the grammar accepts. Two ways to a node never
cost the same with one's letters being a prefix of the other's, so the parts' least letters make the whole's.

Nulls and edges: a null role or text is one space; rows with a null conv_id are a conversation of their own; a null
turn stands first; equal rows are told apart by place, the first is the original; a conversation without rows isn't
returned; texts of any length are only hashed and looked at for their last character; an empty table gives empty
results. Columns but these four are ignored.
"""

from __future__ import annotations

import heapq
import sys
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from gitstrata.llm import store, text as T

#: log2 of the number of rows of a block.
BLOCK_BITS = 8
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
#: States: nothing yet, after system, after user, after assistant. What may be kept next, and whom an inserted row speaks for.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
SPEAKS = (2, 2, 3, 2)
ACCEPTED = (0, 3)
NODE = "struct<cost:bigint,audit:string,script:string>"


def edits(role: str, fault: str, state: int):
    """(letter, its form in the script, cost, next state) of what may be done to a row."""
    yield "D", "d", DELETE, state
    if fault != "x":
        extra = CUT_OFF if fault == "t" else 0
        if role in NEXT[state]:
            yield "K", "k", KEEP + extra, NEXT[state][role]
        yield "R", "?UA"[SPEAKS[state] - 1], REROLE + extra, SPEAKS[state]


@lru_cache(100_000)
def through(rows: str, entry: int) -> tuple:
    """rows: two letters a row, role and fault. For each state at the end (cost, letters, script) of the best way there, or None."""
    n, out = len(rows) // 2, [None] * 4
    heap, done = [(0, "", "", 0, entry)], set()
    while heap:
        cost, audit, script, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == n:
            out[state] = (cost, audit, script)
        else:
            for letter, form, more, then in edits(rows[2 * i], rows[2 * i + 1], state):
                heapq.heappush(heap, (cost + more, audit + letter, script + form, i + 1, then))
        speaks = SPEAKS[state]
        heapq.heappush(heap, (cost + INSERT, audit + "I", script + "?12"[speaks - 1], i, speaks))
    return tuple(out)


def cheapest(blocks: list) -> tuple[int, str, list[str]]:
    """blocks: for each its 16 ways (entry * 4 + exit). Cost, letters and scripts by block of the best way through all."""
    heap, done = [(0, "", 0, 0, None)], set()
    while heap:
        cost, audit, b, state, way = heapq.heappop(heap)
        if (b, state) in done:
            continue
        done.add((b, state))
        if b == len(blocks):
            if state in ACCEPTED:
                scripts = []
                while way:
                    way, script = way
                    scripts.append(script)
                return cost, audit, scripts[::-1]
            continue
        for then in range(4):
            edge = blocks[b][4 * state + then]
            if edge is not None:
                heapq.heappush(heap, (cost + edge["cost"], audit + edge["audit"], b + 1, then, (way, edge["script"])))
    raise AssertionError("all rows can go, so a way always exists")


def _ways() -> Callable:
    @F.pandas_udf(f"array<{NODE}>")
    def ways(rows: pd.Series) -> pd.Series:
        name = ("cost", "audit", "script")
        return pd.Series([[dict(zip(name, x)) if x else None for entry in range(4) for x in through(r, entry)] for r in rows])

    return ways


def _best() -> Callable:
    @F.pandas_udf("struct<cost:bigint,audit:string,scripts:array<string>>")
    def best(blocks: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([cheapest(list(b)) for b in blocks], columns=["cost", "audit", "scripts"])

    return best


def initial(role: Column) -> Column:
    first = F.left(role, F.lit(1))
    return F.when(first.isin("s", "u", "a"), first).otherwise("o")


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, _c (its key, never null), turn, role, text, pos (the order of all rows), block; written once."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role"), blank("text"))
    ranged = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv_id", "turn", "role", "text")
    ranged = ranged.withColumn("_c", F.coalesce(F.col("conv_id").cast("string"), F.lit(""))).withColumn("pos", F.monotonically_increasing_id())
    return store.written(ranged.withColumn("block", F.shiftright("pos", BLOCK_BITS)), "turns")


def faults(rows: DataFrame) -> DataFrame:
    """Rows of ``numbered`` without their texts: _c, turn, pos, block, role (its letter) and fault, the first of blank (b), duplicate (d), truncated (t), none (-)."""
    h1, h2 = T.hash128(F.struct("_c", "role", "text"))
    bare = T.strip(F.col("text"))
    look = rows.select("_c", "turn", "pos", "block", initial(F.col("role")).alias("role"), (bare == "").alias("_b"), F.right(bare, F.lit(1)).isin(".", "!", "?").alias("_whole"), h1.alias("_h1"), h2.alias("_h2"))
    look = store.written(look, "looks")
    first = look.groupBy("_h1", "_h2").agg(F.min("pos").alias("_first"))
    fault = F.when(F.col("_b"), "b").when(F.col("pos") != F.col("_first"), "d").when(~F.col("_whole"), "t").otherwise("-")
    return look.join(first, ["_h1", "_h2"]).select("_c", "turn", "pos", "block", "role", fault.alias("fault"))


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conversations: conv_id, turn, role, text. Two tables.

    The report: conv_id, gaps (turn numbers missing between the first and the last), blank, duplicate, truncated, illegal
    (neighbours whose roles don't take turns), cost, audit; a row for each conversation.
    The rows left: conv_id, block, lines (structs of edit, role, text, in order); blocks in order make the conversation."""
    rows = numbered(conversations)
    marked = store.written(faults(rows), "faults")
    code = F.concat("role", F.translate("fault", "bd", "xx"))
    listed = marked.groupBy("_c", "block").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", code.alias("code")))), lambda x: x.code), "").alias("rows"))  # a block's rows
    ways = store.written(listed.withColumn("ways", _ways()(F.col("rows"))), "ways")
    roles = F.regexp_replace(F.array_join(F.transform("b", lambda x: x.rows), ""), "(.).", "$1")
    legal = F.regexp_count(roles, F.lit("s(?=u)|u(?=a)|a(?=u)"))
    found = ways.groupBy("_c").agg(F.sort_array(F.collect_list(F.struct("block", "rows", "ways"))).alias("b")).withColumn("best", _best()(F.transform("b", lambda x: x.ways)))
    found = found.select("_c", F.transform("b", lambda x: x.block).alias("blocks"), (F.char_length(roles) - 1 - legal).cast("long").alias("illegal"), "best.*")
    found = store.written(found, "repairs")
    turns = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    n = lambda f: F.count_if(F.col("fault") == f)
    counts = marked.groupBy("_c").agg(F.coalesce(turns, F.lit(0)).alias("gaps"), n("b").alias("blank"), n("d").alias("duplicate"), n("t").alias("truncated"))
    number = F.when(F.col("_c") != "", F.col("_c").cast("long")).alias("conv_id")
    report = counts.join(found, "_c").select(number, "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    scripts = found.select("_c", F.explode(F.arrays_zip("blocks", "scripts")).alias("x")).select("_c", F.col("x.blocks").alias("block"), F.col("x.scripts").alias("script"))
    texts = rows.groupBy("_c", "block").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "role", "text"))), lambda x: F.struct(x.role.alias("role"), x.text.alias("text"))).alias("rows"))
    return report, texts.join(scripts, ["_c", "block"]).select(number, "block", _followed(F.col("rows"), F.col("script")).alias("lines"))


def _followed(rows: Column, script: Column) -> Column:
    """The rows left when a script is followed: k keeps, U and A rerole, d deletes the next row; 1 and 2 insert one."""

    def step(p: Column) -> Column:
        form = F.substring(script, p, 1)
        row = F.get(rows, F.char_length(F.regexp_replace(F.substring(script, F.lit(1), p), "[12]", "")) - 1)
        line = lambda edit, role, text: F.struct(F.lit(edit).alias("edit"), role.alias("role"), text.alias("text"))
        user, assistant = F.lit("user"), F.lit("assistant")
        return (
            F.when(form == "k", line("K", row.role, row.text)).when(form == "U", line("R", user, row.text)).when(form == "A", line("R", assistant, row.text))
            .when(form == "1", line("I", user, F.lit(""))).when(form == "2", line("I", assistant, F.lit("")))
        )

    places = F.when(F.char_length(script) > 0, F.sequence(F.lit(1), F.char_length(script))).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(places, step), lambda x: x.isNotNull())


def damaged(conversations: DataFrame) -> DataFrame:
    """A test bed: rows damaged by crc32 of ``conv_id:turn`` modulo 20. 0 drops the row, 1 empties its text, 2 takes its
    full stops, exclamation and question marks away, 3 repeats it, 4 makes it the user's; nulls are one space."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(one("conv_id"), F.lit(":"), one("turn")), "UTF-8")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), one("role").alias("role"), one("text").alias("text"), kind.alias("_k"))
    text = F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_k") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("_k") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.filter("_k <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")


def digests(left: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of the second table of ``repair``: lines ``role:text`` joined by newlines, hashed as they stream by."""

    def run(batches):
        import hashlib

        import pyarrow as pa

        at, sha, some = None, None, False

        def out():
            return pa.RecordBatch.from_pylist([{"conv_id": at[0], "repaired_sha256": sha.hexdigest()}], schema=pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())]))

        for batch in batches:
            for conv, lines in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if at is None or at[0] != conv:
                    if at is not None:
                        yield out()
                    at, sha, some = (conv,), hashlib.sha256(), False
                if lines is not None:
                    sha.update(("\n" * some + lines).encode("utf-8", "surrogatepass"))
                    some = True
        if at is not None:
            yield out()

    joined = F.array_join(F.transform("lines", lambda x: F.concat(x.role, F.lit(":"), x.text)), "\n")
    lines = left.select("conv_id", "block", F.when(F.size("lines") > 0, joined).alias("lines"))
    return lines.repartition("conv_id").sortWithinPartitions("conv_id", "block").select("conv_id", "lines").mapInArrow(run, "conv_id bigint, repaired_sha256 string")


# tasks get this code with their closures, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
