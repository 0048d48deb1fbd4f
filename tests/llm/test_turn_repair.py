import hashlib
import heapq
import random

from pyspark.sql import functions as F
from quantfold.llm import turn_repair

SPACE = " \t\n\x0b\f\r"
NEXT = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        core = text.strip(SPACE)
        out.append("blank" if not core else "duplicate" if (role, text) in seen else "" if core[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def brute(rows):
    """Least (cost, audit) by searching all edits; with the repaired lines."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    found = faults(rows)
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    heap, done = [(0, "", 0, 0, ())], set()
    while True:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in (0, 3):
            return gaps, found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, cost, audit, "\n".join(lines)
        for role in ("user", "assistant"):
            if role[0] in NEXT[state]:
                heapq.heappush(heap, (cost + 2, audit + "I", i, NEXT[state][role[0]], (*lines, role + ":")))
        if i == len(rows):
            continue
        _, role, text = rows[i]
        cut = found[i] == "truncated"
        heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, lines))
        if found[i] in ("blank", "duplicate"):
            continue
        for letter, to, price in [("K", role, 0), ("R", "user", 2), ("R", "assistant", 2)]:
            if to[:1] in NEXT[state]:
                heapq.heappush(heap, (cost + price + cut, audit + letter, i + 1, NEXT[state][to[:1]], (*lines, f"{to}:{text}")))


def run(spark, rows, ids=None):
    schema = "conv_id long, turn long, role string, text string, pos int, place int, edit string, stays string"
    df = spark.createDataFrame([(*r, 1, 2, "x", "y") for r in rows], schema)
    convs, turns = turn_repair.repair_conversations(df, ids)
    lines = {}
    for r in turns.collect():
        lines.setdefault(r.conv_id, []).append((r.place, f"{r.role}:{r.text}"))
    whole = {k: "\n".join(x for _, x in sorted(v)) for k, v in lines.items()}
    assert all([p for p, _ in sorted(v)] == list(range(1, len(v) + 1)) for v in lines.values())
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, whole.get(r.conv_id, "")) for r in convs.collect()}


def wanted(rows):
    return {c: brute([r[1:] for r in rows if r[0] == c]) for c in {r[0] for r in rows}}


def test_against_a_search_of_all_edits(spark):
    rng = random.Random(4)
    rows = []
    for c in range(250):
        for _ in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            rows.append((c, rng.choice([None, *range(9)]), role, rng.choice(["a.", "b!", "c? ", "open", "", " \n", None, f"t{rng.random()}."])))
    rows += [(None, t, r, x) for _, t, r, x in rows[:5]]
    assert run(spark, rows) == wanted(rows)


def test_a_long_conversation(spark):
    rng = random.Random(6)
    rows = [(1, t, rng.choice(["user", "assistant"]), f"{t}{rng.choice('.x')}") for t in range(4000)]
    got = run(spark, rows)[1]
    assert got[0] == 0 and len(got[6].replace("I", "")) == 4000
    # kept and deleted rows alternate where roles do; the cost is that of the edits
    price = {"K": 0, "R": 2, "D": 3, "I": 2}
    left = [r for r, e in zip(rows, got[6].replace("I", "")) if e != "D"]
    assert got[5] == sum(price[e] for e in got[6]) + sum(r[3][-1] == "x" for r in left)


def test_edges(spark):
    ids = spark.createDataFrame([(5,), (7,), (7,), (None,)], "conv_id long")
    assert run(spark, [], ids) == {k: (0, 0, 0, 0, 0, 0, "", "") for k in (5, 7, None)}
    rows = [(7, 3, "user", "hi."), (7, 3, "user", "hi."), (7, 9, "assistant", "yes")]
    got = run(spark, rows, ids)
    assert got[7] == (5, 0, 1, 1, 1, 4, "KDK", "user:hi.\nassistant:yes") and len(got) == 3
    assert run(spark, [(1, None, None, None)])[1] == (0, 1, 0, 0, 0, 3, "D", "")


def test_common_signatures_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(turn_repair, "COMMON", 3)
    rows = [(c, t, r, "x.") for c in range(30) for t, r in enumerate(["user", "assistant"][: 1 + (c % 5 > 0)])] + [(90, 0, "tool", "q"), (91, 0, "system", "q.")]
    assert run(spark, rows) == wanted(rows)


def test_each_suffix_is_one_node(monkeypatch):
    made = []
    node = turn_repair._node
    monkeypatch.setattr(turn_repair, "_node", lambda symbol, rest: made.append(symbol) or node(symbol, rest))
    signatures = sorted({"ua", "uua", "sua", "uaua", "Uaua", "xua", "", "a"}, key=lambda s: s[::-1])
    assert len(list(turn_repair._solved(signatures))) == len(signatures)
    assert len(made) == len({s[i:] for s in signatures for i in range(len(s))})


def test_query_digest_is_that_of_the_repaired_lines(spark, sf_dir):
    from quantfold.llm.queries import damaged, op13_conversation_repair

    chats = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    got = {r.conv_id: r for r in op13_conversation_repair(spark, sf_dir).collect()}
    rows = [tuple(r) for r in damaged(chats).select("conv_id", "turn", "role", "text").collect()]
    want = wanted(rows)
    assert set(got) == {r.conv_id for r in chats.select("conv_id").distinct().collect()}
    for c, r in got.items():
        text = want[c][7] if c in want else ""
        assert r.repaired_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (r.cost, r.audit) == (want[c][5:7] if c in want else (0, ""))
    assert damaged(chats.filter(F.lit(False))).count() == 0
