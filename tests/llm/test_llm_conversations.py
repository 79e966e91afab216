"""Conversation repair against a plain search over whole conversations."""

import hashlib
import random
import re
import zlib

from webtables.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string, fault string, present string, n long, `odd name.x` string"
PATTERN = re.compile(r"(s?(ua)+)?")


def faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain(rows):
    """Summary of the rows (turn, role, text) of one conversation, in order: best (cost, audit, text) per state, row by row."""
    found = faults(rows)
    step = {"": "su", "s": "u", "u": "a", "a": "u"}  # last initial put out, initials that may follow

    def widened(best):
        for _ in range(4):
            for state, (cost, audit, out) in list(best.items()):
                for initial in step[state].replace("s", ""):
                    new = (cost + 5, audit + "I", out + [("user" if initial == "u" else "assistant") + ":"])
                    if initial not in best or new[:2] < best[initial][:2]:
                        best[initial] = new
        return best

    best = {"": (0, "", [])}
    for (_, role, text), fault in zip(rows, found):
        new = {}
        for state, (cost, audit, out) in widened(best).items():
            edits = [(state, 2, "D", [])]
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                if role[:1] and role[:1] in step[state]:
                    edits.append((role[0], more, "K", [f"{role}:{text}"]))
                edits += [(r[0], 1 + more, "R", [f"{r}:{text}"]) for r in ("user", "assistant") if r[0] in step[state]]
            for then, more, letter, put in edits:
                item = (cost + more, audit + letter, out + put)
                if then not in new or item[:2] < new[then][:2]:
                    new[then] = item
        best = new
    best = widened(best)
    cost, audit, out = min((best[s] for s in ("", "a") if s in best), key=lambda x: x[:2])
    assert PATTERN.fullmatch("".join(o[0] for o in out))
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[found.count(f) for f in ("blank", "duplicate", "truncated")],
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def damage(rows):
    """Rows (conv, turn, role, text) by conversation, in the order of the operator."""
    out = {}
    for conv, turn, role, text in rows:
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        out.setdefault(conv, [])
        out[conv] += [(turn, "user" if hit == 4 else role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    return {c: in_order(v) for c, v in out.items()}


def in_order(rows):
    key = lambda r: hashlib.sha256(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).digest()
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, key(r)))


def samples():
    draw, rows = random.Random(4), []
    for conv in list(range(60)) + [None]:
        for turn in range(draw.choice([0, 1, 2, 3, 5, 8, 30])):
            role = draw.choice(["user", "assistant"] if draw.random() < 0.8 else ["system", "tool", "", None, "unknown", "User"])
            text = draw.choice(["Yes.", "No", None, "", " \n", "ends!\t", f"own {draw.random()}.", f"own {draw.random()}", "é." * 40])
            rows.append((conv, None if draw.random() < 0.05 else turn * draw.choice([1, 1, 1, 2]), role, text))
    rows += [(900, t, "user" if t % 2 else "assistant", f"{t}") for t in range(700)]  # forgets nothing: all truncated
    rows += [(901, t, "system" if not t else "user" if t % 2 else "assistant", f"{t}.") for t in range(500)]
    rows += [(902, 1, "user", "the same.")] * 300 + [(902, 2, "assistant", "b.")]
    rows += [(903, t, "user", "again.") for t in range(400)]
    rows += [(904, 5, None, None)] * 3
    return [r + ("f", "p", 3, "odd") for r in rows]


def check(spark, rows, parts):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    kept = [r[:4] for r in rows]
    found = conversations.damaged(df)
    got = {r.conv_id: tuple(r)[1:] for r in conversations.repair_summary(found, found["present"]).collect()}
    wanted = {c: plain(v) for c, v in damage(kept).items()}
    assert got.keys() == wanted.keys()
    for conv in wanted:
        assert got[conv][:6] + got[conv][6:] == wanted[conv], conv


def test_against_plain_search(spark):
    check(spark, samples(), 3)


def test_long_conversations_in_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(conversations, "ROWS", 7)
    check(spark, samples(), 5)
    monkeypatch.setattr(conversations, "ROWS", 1)
    check(spark, [r for r in samples() if r[0] is not None and (r[0] < 20 or r[0] == 902)], 2)


def test_nothing_and_text_ids(spark):
    assert conversations.repair_summary(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = conversations.repair_summary(spark.createDataFrame([("x", 1, "user", "Hi."), ("x", 2, "assistant", "Ho.")], "conv_id string, turn int, role string, text string")).collect()
    assert [(r.conv_id, r.audit, r.cost) for r in rows] == [("x", "KK", 0)]


def test_repaired_turns_fit_the_pattern(spark):
    df = spark.createDataFrame(samples(), SCHEMA)
    turns = {}
    for r in conversations.repaired_turns(df).orderBy("chunk", "place").collect():
        turns.setdefault(r.conv_id, []).append(r.role[0])
    assert turns and all(PATTERN.fullmatch("".join(t)) for t in turns.values())


def test_registered_query(spark):
    from webtables.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r)[1:] for r in QUERIES["op13_conversation_repair"](spark, folder).collect()}
    assert got == {c: plain(v) for c, v in damage(rows).items()}
