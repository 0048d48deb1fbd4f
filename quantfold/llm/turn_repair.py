"""Repairs the order of turns in conversations by a suffix-shared automaton.

Each row has a first fault: ``blank`` (no character but white space), ``duplicate`` (role and
text as in an earlier row) or ``truncated`` (its last such character ends no sentence).
Edits make the role initials of a conversation match ``(s?(ua)+)?``: Keep (0), Rerole to
user or assistant (2), Delete (3; blank and duplicate rows must go), Insert an empty user
or assistant turn (2); a truncated row that stays adds 1. The cheapest edits win, ties
by the ASCII-least string of their initials.

What edits cost depends on a conversation's signature only: one letter per row for its
role initial and fault. Different signatures are solved once: ordered by their reverse,
those with a common end follow each other, so an automaton that shares suffixes is built
along one path of nodes. A node (a different suffix) gets its cost-to-go and its best
first edit with the rest's audit as tail once per grammar state, and all
signatures that end so use it. The four options of a state begin with different letters,
so ties are settled by the first letter. Signatures are dealt out in ranges of
their reverse; at a border between ranges one path is made again.

Defined cases: null roles and texts are one space (so such a row is blank, or has no role that
can be kept); rows with a null turn come first; rows of one turn are ordered by role and
text; repeated rows are duplicates; a conversation without rows (in ``ids`` only) has
zeros and an empty audit; a null ``conv_id`` is a conversation; an empty table gives an
empty result; other columns are not read. Rows of a conversation are ordered by Spark's
external sort; its signature takes one letter per row, its audit at most two.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantfold.tables import Stage

START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
#: Role that a state asks for next, and the state after it.
NEXT = {START: ("u", AFTER_USER), AFTER_SYSTEM: ("u", AFTER_USER), AFTER_USER: ("a", AFTER_ASSISTANT), AFTER_ASSISTANT: ("u", AFTER_USER)}
NOT_SPACE = "[^\\x20\\x09-\\x0D]"
#: A signature could be as common as one in this many conversations; only fewer such than that exist.
COMMON = 1000


def _end() -> list:
    """Cost and audit (first letter, tail) per state where no rows are left."""
    close = ("I", None)
    return [(0, None), (2 * INSERT, ("I", close)), (INSERT, close), (0, None)]


def _node(symbol: str, rest: list) -> list:
    """The node of ``symbol`` followed by the suffix of node ``rest``: (cost, audit) per state."""
    gone, cut = symbol == "x", symbol.isupper()
    initial = symbol.lower()
    out = []
    for state in range(4):
        asked, after = NEXT[state]
        options = [(DELETE + rest[state][0], "D", rest[state][1])]
        if not gone:
            options.append((REROLE + CUT * cut + rest[after][0], "R", rest[after][1]))
            if initial == asked:
                options.append((KEEP + CUT * cut + rest[after][0], "K", rest[after][1]))
            if initial == "s" and state == START:
                options.append((KEEP + CUT * cut + rest[AFTER_SYSTEM][0], "K", rest[AFTER_SYSTEM][1]))
        cost, letter, tail = min(options, key=lambda o: o[:2])
        out.append((cost, (letter, tail)))
    # an inserted turn leads to another state of the same node; what it leads to never inserts back
    best = list(out)
    for state in (AFTER_USER, AFTER_ASSISTANT, START, AFTER_SYSTEM):
        cost, audit = best[NEXT[state][1]]
        if (INSERT + cost, "I") < (best[state][0], best[state][1][0]):
            best[state] = (INSERT + cost, ("I", audit))
    return best


def _solved(signatures):
    """cost and audit of signatures ordered by their reverse; only the path of the last one is held."""
    path, last = [_end()], ""
    for s in signatures:
        back = s[::-1]
        same = 0
        while same < min(len(back), len(last)) and back[same] == last[same]:
            same += 1
        del path[same + 1 :]
        for symbol in back[same:]:
            path.append(_node(symbol, path[-1]))
        last = back
        cost, link = path[-1][START]
        letters = []
        while link:
            letters.append(link[0])
            link = link[1]
        yield cost, "".join(letters)


def solve_signatures(signatures: DataFrame) -> DataFrame:
    """signature, n, cost, audit for different signatures (signature, n)."""

    def solve(batches):
        held = (row for b in batches for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        waiting, size = [], 0

        def known():
            for signature, n in held:
                waiting.append((signature, n))
                yield signature

        done = []

        def flush():
            batch = pa.RecordBatch.from_arrays(
                [pa.array([d[0] for d in done]), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64()), pa.array([d[3] for d in done])],
                names=["signature", "n", "cost", "audit"],
            )
            done.clear()
            return batch

        for cost, audit in _solved(known()):
            signature, n = waiting.pop()
            done.append((signature, n, cost, audit))
            size += len(signature) + len(audit)
            if size > 4 << 20:
                yield flush()
                size = 0
        if done:
            yield flush()

    back = F.reverse("signature")
    ordered = signatures.select("signature", "n").repartitionByRange(back).sortWithinPartitions(back)
    return ordered.mapInArrow(solve, "signature string, n long, cost long, audit string")


def edits_of(convs: DataFrame) -> DataFrame:
    """conv_id, edit, pos (row, null if inserted), place (in the result), role (user and assistant in turn) for each letter of an audit.

    Only a kept system row can stand before the first user turn: then the letters that stay in the result are odd in number."""
    stays = F.length(F.translate("audit", "D", ""))
    letters = convs.select("conv_id", stays.alias("stays"), F.posexplode(F.array_remove(F.split("audit", ""), "")).alias("at", "edit"))
    so_far = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tally = lambda no: F.sum(F.when(F.col("edit") == no, 0).otherwise(1)).over(so_far).cast("int")
    placed = letters.withColumns({"row": tally("I"), "place": tally("D")})
    user = (F.col("place") - F.col("stays") % 2) % 2 == 1
    return placed.select("conv_id", "edit", F.when(F.col("edit") != "I", F.col("row")).alias("pos"), "place", F.when(user, "user").otherwise("assistant").alias("role"))


def _initial(role: Column) -> Column:
    return F.substring(role, 1, 1)


def judged_rows(rows: DataFrame) -> DataFrame:
    """conv_id, turn, pos (from 1), role, text, fault, step (false where it does not follow the row before), symbol."""
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    told = rows.select("conv_id", "turn", space("role"), space("text")).repartition("conv_id")
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    told = told.withColumns({"pos": F.row_number().over(order), "before": F.lag(_initial(F.col("role"))).over(order)})
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("pos")) > 1
    last = F.regexp_extract("text", f"({NOT_SPACE})[\\x20\\x09-\\x0D]*$", 1)
    fault = F.when(last == "", "blank").when(again, "duplicate").when(~F.rlike(last, F.lit("^[.!?]$")), "truncated").otherwise("")
    told = told.withColumn("last", last).withColumn("fault", fault)
    initial = _initial(F.col("role"))
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(known)).otherwise(known)
    step = F.col("before").isNull() | F.concat("before", initial).isin("su", "ua", "au")
    return told.select("conv_id", "turn", "pos", "role", "text", "fault", step.alias("step"), symbol.alias("symbol"))


def repair_conversations(rows: DataFrame, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit; and the turns of the
    repaired conversations: conv_id, place (from 1), edit (K, R or I), pos (of the row, null if inserted), role, text.

    ``ids`` (conv_id) names conversations to be reported even without rows."""
    stage = Stage(rows.sparkSession, "repair")
    judged = stage.plain("rows", judged_rows(rows))
    number = lambda c: F.count(F.when(c, 1)).alias
    letters = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "symbol"))), lambda x: x["symbol"]), "")
    span = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    fault = F.col("fault")
    convs = judged.groupBy("conv_id").agg(
        F.coalesce(span, F.lit(0)).cast("long").alias("gaps"), number(fault == "blank")("blank"), number(fault == "duplicate")("duplicate"),
        number(fault == "truncated")("truncated"), number(~F.col("step"))("illegal"), letters.alias("signature"),
    )
    convs = stage.plain("convs", convs)
    solved = stage.plain("solved", solve_signatures(convs.groupBy("signature").agg(F.count("*").alias("n"))))
    # fewer than COMMON signatures can be that common: they are broadcast, the others joined by signature
    often = F.col("n") * COMMON > convs.count()
    answer = ["signature", "cost", "audit"]
    common = F.broadcast(solved.filter(often).select(*answer))
    convs = convs.join(common, "signature").unionByName(convs.join(common, "signature", "left_anti").join(solved.filter(~often).select(*answer), "signature"))
    convs = stage.plain("audits", convs.drop("signature"))

    edits = edits_of(convs)
    mine = F.col("e.conv_id").eqNullSafe(F.col("r.conv_id")) & (F.col("e.pos") == F.col("r.pos"))
    made = edits.filter("edit <> 'D'").alias("e").join(judged.select("conv_id", "pos", "role", "text").alias("r"), mine, "left")
    turns = made.select(
        "e.conv_id", "e.place", "e.edit", F.col("e.pos").alias("pos"), F.when(F.col("e.edit") == "K", F.col("r.role")).otherwise(F.col("e.role")).alias("role"),
        F.when(F.col("e.edit") == "I", "").otherwise(F.col("r.text")).alias("text"),
    )
    if ids is None:
        return convs, turns
    known = ids.select("conv_id").distinct().alias("i").join(convs.alias("c"), F.col("i.conv_id").eqNullSafe(F.col("c.conv_id")), "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return known.select("i.conv_id", *[F.coalesce(f"c.{c}", F.lit(0)).alias(c) for c in counts], F.coalesce("c.audit", F.lit("")).alias("audit")), turns
