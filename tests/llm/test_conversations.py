"""Brute-force twin of the conversation repair: all states with their whole audits, row by row."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from reelspark.llm import conversations, queries

SCHEMA = "conv_id long, turn long, role string, text string, seq long, block string, code int, digest string"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20
        if fault == 0:
            continue
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if fault == 3 else 1)
    return out


def cheapest(rows, faults):
    """(cost, audit, repaired lines): every state keeps its cheapest and then least audit."""
    after = lambda state, x: {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}.get((state, x))
    best = {"": (0, "", [])}

    def keep(into, state, found):
        if state is not None and (state not in into or found[:2] < into[state][:2]):
            into[state] = found

    def inserted(states):
        for _ in range(2):
            for state, (cost, audit, lines) in list(states.items()):
                for x, role in (("u", "user"), ("a", "assistant")):
                    keep(states, after(state, x), (cost + 3, audit + "I", [*lines, f"{role}:"]))
        return states

    for (_, _, role, text), fault in zip(rows, faults, strict=True):
        new = {}
        for state, (cost, audit, lines) in inserted(dict(best)).items():
            keep(new, state, (cost + 4, audit + "D", lines))
            if fault in (None, "truncated"):
                more = 3 if fault else 0
                keep(new, after(state, role[:1]), (cost + more, audit + "K", [*lines, f"{role}:{text}"]))
                for to in ("user", "assistant"):
                    keep(new, after(state, to[0]), (cost + 3 + more, audit + "R", [*lines, f"{to}:{text}"]))
        best = new
    ends = inserted(dict(best))
    return min(ends[s] for s in ("", "a") if s in ends)


def brute(rows, with_damage=True):
    convs = {r[0] for r in rows}
    rows = damage(rows) if with_damage else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    out = []
    for conv in convs:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
        faults, seen = [], set()
        for _, _, role, text in own:
            solid = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else None if solid[-1] in ".!?" else "truncated")
            seen.add((role, text))
        turns = {r[1] for r in own} - {None}
        cost, audit, lines = cheapest(own, faults)
        assert GRAMMAR.fullmatch("".join(x[0] for x in lines))
        pairs = [a[2][:1] + b[2][:1] for a, b in itertools.pairwise(own)]
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
                    sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    cols = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    assert df.columns == list(cols)
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = brute(rows)
    assert got(queries.op11_conversation_repair(spark, sf)) == want and len({x[7] for x in want}) > 10


def odd(n=400, convs=(1, 2, None, 4, 5, 6)):
    rnd = random.Random(5)
    roles, texts = ["user", "assistant", "system", "tool", "", None], ["Yes.", "no", "", "  \n", "What?! ", "é ü.", None, "cut off", "x" * 5000 + "."]
    return [(rnd.choice(convs), rnd.choice([None, *range(60)]), rnd.choice(roles[:3] if rnd.random() < 0.8 else roles), rnd.choice(texts)) for _ in range(n)]


@pytest.mark.parametrize("block", [1024, 7])
@pytest.mark.parametrize("chunk", [4 << 20, 100])
def test_odd_rows(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(conversations, "BLOCK", block)
    monkeypatch.setattr(conversations, "CHUNK", chunk)
    rows = odd() + [(9, t, r, "Fine.") for t, r in enumerate(["user", "assistant"] * 30)] + [(10, 0, "user", "Hm.")] * 30
    df = spark.createDataFrame([(*r, 1, "b", 2, "d") for r in rows], SCHEMA)
    assert got(conversations.damaged_and_repaired(df)) == brute(rows)
    assert got(conversations.repairs(df)) == brute(rows, with_damage=False)


def test_repaired_turns(spark, monkeypatch):
    monkeypatch.setattr(conversations, "BLOCK", 7)
    rows = odd()
    df = spark.createDataFrame([(*r, 1, "b", 2, "d") for r in rows], SCHEMA)
    texts = {}
    for r in conversations.repaired_turns(df).orderBy("place").collect():
        texts.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert {c: hashlib.sha256("\n".join(x).encode()).hexdigest() for c, x in texts.items()} == {x[0]: x[8] for x in brute(rows, with_damage=False)}


def test_small(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert got(conversations.damaged_and_repaired(none)) == [] and conversations.repaired_turns(none).count() == 0
    lost = [(c, 0, "user", "Hi.") for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    df = spark.createDataFrame(lost, "conv_id long, turn long, role string, text string")
    assert got(conversations.damaged_and_repaired(df)) == brute(lost) and got(conversations.damaged_and_repaired(df))[0][7:] == ("", hashlib.sha256(b"").hexdigest())


def test_divide_and_conquer_is_the_plain_search():
    """Random codes: each row's letters, of runs of rows and of runs of blocks."""
    rnd = random.Random(1)
    for n in [1, 2, 3, 5, 8, 40] * 20:
        codes = bytes(rnd.choice((0, 1, 2, 3, 4, 12, 13, 14)) for _ in range(n))
        names, faults = ("s", "u", "a", "x"), (None, "blank", "duplicate", "truncated")
        cost, audit, _ = cheapest([(0, 0, names[c % 4], "") for c in codes], [faults[c // 4] for c in codes])
        states = conversations.crossings(conversations.Rows(codes), 0, conversations.CLOSING)
        assert "".join(conversations.closed(conversations.audit(codes, 0, conversations.CLOSING), states[-1])) == audit
        cuts = sorted({0, n, *(rnd.randrange(n + 1) for _ in range(4))})
        ops = [tuple(conversations.Rows(codes).forward(conversations.unit(s), a, b) for s in range(4)) for a, b in itertools.pairwise(cuts)]
        assert conversations.crossings(conversations.Blocks(ops), 0, conversations.CLOSING) == [states[b - 1] for b in cuts[1:]]
