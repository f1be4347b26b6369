import hashlib
import random
import re
import zlib
from itertools import pairwise

from linkloom.llm.conversation_repair import Costs, damaged, repaired, report

SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(rows, costs=Costs()):
    """All edits of a short conversation, by trying them: (cost, audit, repaired turns). ``rows`` are (role, text, fault)."""
    best = None
    limit = costs.delete * len(rows)  # to delete all is allowed

    def go(i, cost, audit, out):
        nonlocal best
        if cost > limit:
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
            best = cost, audit, out
        for role in ("user", "assistant"):
            if len(out) < len(rows) + 3:
                go(i, cost + costs.insert, audit + "I", [*out, (role, "")])
        if i < len(rows):
            role, text, fault = rows[i]
            go(i + 1, cost + costs.delete, audit + "D", out)
            if fault not in ("blank", "duplicate"):
                more = costs.truncated * (fault == "truncated")
                go(i + 1, cost + more, audit + "K", [*out, (role, text)])
                for r in ("user", "assistant"):
                    go(i + 1, cost + costs.rerole + more, audit + "R", [*out, (r, text)])

    go(0, 0, "", [])
    return best


def expected(rows):
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda v: (v[0] is not None, v[0] or 0, v[1], v[2]))
    seen, marked, faults = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        inside = re.sub(r"[\x20\x09-\x0D]+", "", text)
        fault = "blank" if not inside else "duplicate" if (role, text) in seen else "truncated" if inside[-1] not in ".!?" else None
        seen.add((role, text))
        marked.append((role, text, fault))
        if fault:
            faults[fault] += 1
    cost, audit, out = cheapest(marked)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in pairwise(marked))
    text = "\n".join(f"{r}:{x}" for r, x in out)
    return (gaps, *faults.values(), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()), out


def conversations(n, seed):
    rnd = random.Random(seed)
    found = {}
    for c in range(n):
        roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "uber", "User"]
        texts = ["Hello there.", "No end", "What?", "", " \t", None, "a.\n", "Ünï!", "b"]
        found[c] = [(rnd.choice([None, 0, 1, 2, 3, 5, 9]), rnd.choice(roles[: rnd.choice([3, 5, 10])]), rnd.choice(texts)) for _ in range(rnd.randint(1, 4))]
    return found


def test_equals_all_edits(spark):
    found = conversations(150, 4)
    df = spark.createDataFrame([(c, *r) for c, rows in found.items() for r in rows], SCHEMA)
    got = {r["conv_id"]: tuple(r)[1:] for r in report(df.withColumn("kind", df["turn"]).withColumn("real", df["turn"])).collect()}
    want = {c: expected(rows) for c, rows in found.items()}
    assert got == {c: w[0] for c, w in want.items()}
    turns = {}
    for r in repaired(df).orderBy("conv_id", "place").collect():
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert turns == {c: w[1] for c, w in want.items() if w[1]}


def test_other_costs(spark):
    costs, found = Costs(rerole=1, delete=2, insert=3, truncated=0), conversations(60, 9)
    df = spark.createDataFrame([(c, *r) for c, rows in found.items() for r in rows], SCHEMA)
    for r in report(df, costs=costs).collect():
        rows = sorted(((t, x or "" if x == "" else x or " ", y if y is not None else " ") for t, x, y in found[r["conv_id"]]), key=lambda v: (v[0] is not None, v[0] or 0, v[1], v[2]))
        seen, marked = set(), []
        for _, role, text in rows:
            inside = re.sub(r"[\x20\x09-\x0D]+", "", text)
            marked.append((role, text, "blank" if not inside else "duplicate" if (role, text) in seen else "truncated" if inside[-1] not in ".!?" else None))
            seen.add((role, text))
        assert (r["cost"], r["audit"]) == cheapest(marked, costs)[:2]


def test_named_only_and_empty(spark):
    rows = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (None, 0, "user", "Hi."), (None, 1, "assistant", "Yes.")], SCHEMA)
    ids = spark.createDataFrame([(1,), (7,), (None,)], "conv_id long")
    got = {r["conv_id"]: r for r in report(rows, ids).collect()}
    assert set(got) == {1, 7, None} and got[1]["audit"] == got[None]["audit"] == "KK"
    assert tuple(got[7])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert report(rows.limit(0), ids.limit(0)).collect() == [] and repaired(rows.limit(0)).collect() == []


def test_a_long_conversation(spark):
    n = 20_000
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"text {i}.") for i in range(n)]
    rows[501] = (1, 501, "user", "text 501.")
    got = report(spark.createDataFrame(rows, SCHEMA)).collect()[0]
    assert got["cost"] == 2 and got["audit"] == "K" * 501 + "R" + "K" * (n - 502) and got["illegal"] == 2


def test_damage(spark):
    rows = [(c, t, "assistant", "Well. Yes!") for c in range(6) for t in range(40)] + [(None, None, None, None)]
    got = {}
    for r in damaged(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault((r["conv_id"], r["turn"]), []).append((r["role"], r["text"]))
    for c, t, role, text in rows:
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        whole = {0: [], 1: [(role, "")], 2: [(role, re.sub("[.!?]", "", text))], 3: [(role, text)] * 2, 4: [("user", text)]}
        assert got.get((c, t), []) == whole.get(fate, [(role, text)])
