import hashlib
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F

from emberlog.llm import queries, repair

LEGAL = re.compile(r"(s?(ua)+)?")


def cheapest(letters, most=3):
    """By search through all states (place, roles so far as a state), in order of cost and audit: no recursion, no memory of suffixes."""
    import heapq

    seen, heap = set(), [(0, "", 0, "")]
    while heap:
        cost, audit, i, roles = heapq.heappop(heap)
        if i == len(letters) and LEGAL.fullmatch(roles):
            return cost, audit
        if (i, roles) in seen:
            continue
        seen.add((i, roles))
        steps = [("I", 3, i, roles + r) for r in "ua"]
        if i < len(letters):
            x, late = letters[i].lower(), 3 * letters[i].isupper()
            steps.append(("D", 4, i + 1, roles))
            if letters[i] != "-":
                steps += [("K", late, i + 1, roles + x)] + [("R", 3 + late, i + 1, roles + r) for r in "ua"]
        for edit, c, j, now in steps:
            if re.fullmatch(r"s?(ua)*u?", now) and len(now) <= 2 * len(letters) + most:
                heapq.heappush(heap, (cost + c, audit + edit, j, now))
    raise AssertionError


def test_every_short_signature_is_solved_at_least_cost_with_the_least_audit():
    for n in range(5):
        for letters in map("".join, itertools.product("suaxUA-", repeat=n)):
            cost, audit, plan, state = repair.solve(letters)
            assert (cost, audit) == cheapest(letters), letters
            assert state in (repair.START, repair.ASSISTANT) and (len(plan) == n)
            roles = "".join(letter.lower() if c == "." else c.lower() for letter, does in zip(letters, plan) for c in does)
            assert LEGAL.fullmatch(roles)


def test_random_signatures():
    rng = random.Random(3)
    for _ in range(150):
        letters = "".join(rng.choices("suaxSUAX-", k=rng.randint(5, 9)))
        assert repair.solve(letters)[:2] == cheapest(letters), letters


def test_a_long_signature_needs_no_deep_recursion():
    letters = "".join(random.Random(1).choices("suaxUA-", k=5_000))
    cost, audit, plan, _ = repair.solve(letters)
    assert len(plan) == 5_000 and cost == 4 * audit.count("D") + 3 * (audit.count("I") + audit.count("R")) + sum(3 for x, p in zip(letters, plan) if x.isupper() and set(p) & set(".UA"))


def plain(rows):
    """The contract, conversation by conversation in memory, on damaged rows (conv_id, turn, role, text)."""
    out = {}
    for c in {r[0] for r in rows}:
        mine = sorted([(t, r if r is not None else " ", x if x is not None else " ") for i, t, r, x in rows if i == c], key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, letters, n = set(), "", dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in mine:
            body = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                n[fault] += 1
            letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
            letters += "-" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
        cost, audit, plan, _ = repair.solve(letters)
        lines = []
        for (_, role, text), does in zip(mine, plan):
            for d in does:
                lines.append({".": f"{role}:{text}", "u": "user:", "a": "assistant:", "U": f"user:{text}", "A": f"assistant:{text}"}[d])
        turns = [t for t, _, _ in mine if t is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(mine, mine[1:])]
        out[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *n.values(), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def told(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


TURNS = "conv_id long, turn long, role string, text string"


def test_faults_ties_nulls_and_clashing_columns(spark):
    rows = [
        (1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 1, "user", "Hi."), (1, 4, "assistant", "Well"), (1, 5, "assistant", " \t"),
        (2, None, "assistant", "So!"), (2, None, None, None), (2, 3, "tool", "x?"), (2, 9, "", "y."),
        (None, 1, "user", "Q?"), (None, 2, "assistant", "A."), (None, 2, "assistant", "A.  "),
        (3, None, None, None), (4, -5, "user", "é　"), (4, 1 << 62, "user", "?"), (5, 0, "user", "w " * 50_000 + "."),
    ]
    turns = spark.createDataFrame(rows, TURNS).withColumn("at", F.lit("clash")).withColumn("lines", F.lit(1))
    got, want = told(repair.repair_report(turns)), plain(rows)
    assert got == want
    assert want[1][1:4] == (1, 1, 1) and want[2][0] == 5 and want[3][6] == "D" and want[None][6] == "KKD" or want[None][6] == "KKIK"
    back = repair.repaired(turns).where("conv_id = 1").orderBy("place").collect()
    assert [(r.role, r.edit) for r in back] == [("system", "keep"), ("user", "keep"), ("assistant", "keep")]
    assert repair.repaired(turns.where("false")).collect() == [] and repair.repair_report(turns.where("false")).collect() == []


def test_conversations_of_many_chapters(spark, monkeypatch):
    monkeypatch.setattr(repair, "CHAPTER", 4)
    rng = random.Random(5)
    rows = [(c, t, rng.choice(("system", "user", "user", "assistant", "assistant", "tool")), rng.choice(("Yes.", "no", "", f"word {t}.", f"more {t}"))) for c in range(12) for t in range(rng.choice((1, 3, 30, 70)))]
    assert told(repair.repair_report(spark.createDataFrame(rows, TURNS).repartition(7))) == plain(rows)


def test_the_query_on_a_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    hurt = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{c}:{t}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            hurt += [(c, t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    want = {c: (0,) * 6 + ("", hashlib.sha256(b"").hexdigest()) for c, *_ in rows} | plain(hurt)
    assert told(queries.op11_conversation_repair(spark, sf)) == want
