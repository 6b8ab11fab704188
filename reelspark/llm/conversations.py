"""Conversation structure repair: cheapest edits by Hirschberg's divide and conquer.

A repaired conversation's roles read `(s?(ua)+)?` by their initials, which an automaton of four states accepts: start, after the system turn, after a user
turn, after an assistant turn. Row by row, an operator holds for each entry and exit state the least cost of the edits that lead from one to the other and the place of
their letters in the order of all exits; operators of runs of rows compose in the same form. An insertion belongs to the row that follows it, the last ones to
the end, so letters of equal rows that lead to other states differ before either ends, and comparing places is comparing whole audits.

Forward vectors (cost and place of the letters by state) and backward vectors (cost by state) meet mid-way; the crossing of least cost, and of the least letters
among those, splits the conversation, and each half is solved alike, so nothing but the rows' codes and two vectors are held.

Rows stand in one global order, dealt over range partitions, and are cut into blocks of BLOCK rows. Conversations inside a block are solved there. Of longer
ones each block gives its operator; the same divide and conquer over a conversation's blocks (a row of some 300 bytes for BLOCK rows) gives each block its
entry and exit state, and then blocks are solved apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.llm.common import WORD, few, written
from reelspark.operators.ranks import row_numbers

BLOCK = 1024
CHUNK = 4 << 20  # bytes of repaired text that a task holds of a conversation that spans blocks
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)  # where an inserted or re-roled turn leads, by state
#: Where a kept turn leads, by initial (s, u, a, any other one) and state.
KEPT = ({START: SYSTEM}, {START: USER, SYSTEM: USER, ASSISTANT: USER}, {USER: ASSISTANT}, {})
SOUND, BLANK, DUPLICATE, CUT = range(4)
NEVER = 1 << 60
#: Costs of closing a conversation by insertions, by state.
CLOSING = (0, 2 * INSERT, INSERT, 0)
LEGAL = {(0, 1), (1, 2), (2, 1)}

Vector = tuple[tuple[int, int], ...]  # (cost, place of the letters) by exit state
Operator = tuple[Vector, ...]  # by entry state


@lru_cache(None)
def edits(code: int) -> dict[tuple[int, int], tuple[int, str]]:
    """(entry, exit) -> (cost, letters) of the best edits of a row, insertions before it included. code is 4 * fault + initial."""
    fault, initial = divmod(code, 4)
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for entry in range(4):
        state = entry
        for n in range(3):
            options = [(state, DELETE, "D")]
            if fault in (SOUND, CUT):
                more = TRUNCATED if fault == CUT else 0
                options.append((NEXT[state], REROLE + more, "R"))
                if state in KEPT[initial]:
                    options.append((KEPT[initial][state], KEEP + more, "K"))
            for end, cost, letter in options:
                found = (n * INSERT + cost, "I" * n + letter)
                best[entry, end] = min(best.get((entry, end), found), found)
            state = NEXT[state]
    return best


@lru_cache(None)
def row_operator(code: int) -> Operator:
    out = []
    for entry in range(4):
        ends = {t: found for (s, t), found in edits(code).items() if s == entry}
        order = sorted(ends, key=lambda t: ends[t][1])
        out.append(tuple((ends[t][0], order.index(t)) if t in ends else (NEVER, 0) for t in range(4)))
    return tuple(out)


def unit(state: int) -> Vector:
    return tuple((0 if s == state else NEVER, 0) for s in range(4))


def ahead(v: Vector, op: Operator) -> Vector:
    """The forward vector behind one more operator."""
    found = {}
    for t in range(4):
        ways = [(v[s][0] + op[s][t][0], v[s][1], op[s][t][1]) for s in range(4) if v[s][0] < NEVER and op[s][t][0] < NEVER]
        if ways:
            found[t] = min(ways)
    order = sorted(found, key=lambda t: found[t][1:])
    return tuple((found[t][0], order.index(t)) if t in found else (NEVER, 0) for t in range(4))


def back(v: tuple[int, ...], op: Operator) -> tuple[int, ...]:
    """The backward vector before one more operator."""
    return tuple(min([v[t] + op[s][t][0] for t in range(4) if v[t] < NEVER and op[s][t][0] < NEVER], default=NEVER) for s in range(4))


@lru_cache(100_000)
def _ahead(v: Vector, code: int) -> tuple[int, Vector]:
    w = ahead(v, row_operator(code))
    least = min(c for c, _ in w)
    return least, tuple((c - least if c < NEVER else NEVER, r) for c, r in w)


@lru_cache(100_000)
def _back(v: tuple[int, ...], code: int) -> tuple[int, ...]:
    w = back(v, row_operator(code))
    least = min(w)
    return tuple(c - least if c < NEVER else NEVER for c in w)


class Rows:
    """A run of row codes. Vectors are kept relative to their least cost, so that few differ and each step is looked up."""

    def __init__(self, codes: bytes):
        self.codes = codes

    def __len__(self) -> int:
        return len(self.codes)

    def operator(self, i: int) -> Operator:
        return row_operator(self.codes[i])

    def forward(self, v: Vector, lo: int, hi: int) -> Vector:
        base = 0
        for code in self.codes[lo:hi]:
            more, v = _ahead(v, code)
            base += more
        return tuple((c + base if c < NEVER else NEVER, r) for c, r in v)

    def backward(self, v: tuple[int, ...], lo: int, hi: int) -> tuple[int, ...]:
        """Relative to the least cost."""
        for code in reversed(self.codes[lo:hi]):
            v = _back(v, code)
        return v


class Blocks(Rows):
    """A run of operators."""

    def __init__(self, operators: list[Operator]):
        self.operators = operators

    def __len__(self) -> int:
        return len(self.operators)

    def operator(self, i: int) -> Operator:
        return self.operators[i]

    def forward(self, v: Vector, lo: int, hi: int) -> Vector:
        return reduce(ahead, self.operators[lo:hi], v)

    def backward(self, v: tuple[int, ...], lo: int, hi: int) -> tuple[int, ...]:
        return reduce(back, reversed(self.operators[lo:hi]), v)


def crossings(run: Rows, entry: int, end: tuple[int, ...]) -> list[int]:
    """The states behind each element of the run on its best way from the entry state, where end holds the costs of what follows the run."""
    out, todo = [], [(0, len(run), entry, end)]
    while todo:
        lo, hi, entry, end = todo.pop()
        if hi - lo == 1:
            v, w = run.operator(lo)[entry], end
        else:
            mid = (lo + hi) // 2
            v, w = run.forward(unit(entry), lo, mid), run.backward(end, mid, hi)
        state = min((v[s][0] + w[s], v[s][1], s) for s in range(4) if v[s][0] < NEVER and w[s] < NEVER)[2]
        if hi - lo == 1:
            out.append(state)
        else:
            only = tuple(0 if s == state else NEVER for s in range(4))
            todo += [(mid, hi, state, end), (lo, mid, entry, only)]
    return out


def audit(codes: bytes, entry: int, end: tuple[int, ...]) -> list[str]:
    """The letters of each row."""
    out = []
    for code, state in zip(codes, crossings(Rows(codes), entry, end), strict=True):
        out.append(edits(code)[entry, state][1])
        entry = state
    return out


def closed(letters: list[str], state: int) -> list[str]:
    """With the insertions that close the conversation."""
    return [*letters[:-1], letters[-1] + "I" * (CLOSING[state] // INSERT)]


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy): the rows with faults planted by their crc32, nulls in role and text being one space."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    fault = F.pmod(F.crc32(key.cast("binary")), F.lit(20))
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    text = F.when(fault == 1, F.lit("")).when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    got = rows.select("conv_id", "turn", F.when(fault == 4, F.lit("user")).otherwise(role).alias("role"), text.alias("text"), fault.alias("fault"), copies.alias("copies"))
    return got.where("fault <> 0").select("conv_id", "turn", "role", "text", F.explode("copies").alias("copy"))


def ordered(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, seq, block, digest): nulls in role and text as one space; rows in the order of conv_id and turn, nulls first, then of role and the text's digest."""
    got = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    got = got.withColumn("digest", F.md5(F.col("text").cast("binary")))
    got = row_numbers(got, "conv_id", "turn", "role", "digest", name="seq")
    return got.withColumn("block", F.floor((F.col("seq") - 1) / BLOCK))


def coded(placed: DataFrame) -> DataFrame:
    """(conv_id, turn, seq, block, code) of ordered() rows."""
    key = ["conv_id", "role", "digest"]
    firsts = placed.groupBy(*key).agg(F.min("seq").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    firsts = written(firsts.select(*(F.col(c).alias(f"f_{c}") for c in key), "first"), "firsts")  # read back, so that the join can split a hot key
    initial = F.substring("role", 1, 1)
    place: Column = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    light = placed.select(
        *key, "turn", "seq", "block", place.alias("initial"), (~F.col("text").rlike(WORD)).alias("blank"), (~F.col("text").rlike("[.!?][\\x20\\x09-\\x0D]*\\z")).alias("cut")
    )
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"f_{c}")) for c in key))
    fault = F.when(F.col("blank"), BLANK).when(F.coalesce(F.col("seq") > F.col("first"), F.lit(False)), DUPLICATE).when(F.col("cut"), CUT).otherwise(SOUND)
    return light.join(firsts, same, "left").select("conv_id", "turn", "seq", "block", (4 * fault + F.col("initial")).cast("int").alias("code"))


_COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
_PIECE = (
    "block long, seq long, whole boolean, entry int, letters array<string>, codes binary, operator array<long>, least_turn long, most_turn long, n_turns long, "
    "last_turn long, first_turn long, first_initial int, last_initial int, " + _COUNTS
)


def _piece(conv, block: int, seq: int, turns: list[int | None], codes: bytes, whole: bool) -> dict:
    real = [t for t in turns if t is not None]
    n_turns = len(set(real))
    initials, faults = [c % 4 for c in codes], [c // 4 for c in codes]
    out = {
        "conv_id": conv, "block": block, "seq": seq, "whole": whole, "least_turn": min(real, default=None), "most_turn": max(real, default=None), "n_turns": n_turns, "first_turn": turns[0],
        "last_turn": turns[-1], "first_initial": initials[0], "last_initial": initials[-1], "gaps": real[-1] - real[0] + 1 - n_turns if real else 0, "blank": faults.count(BLANK),
        "duplicate": faults.count(DUPLICATE), "truncated": faults.count(CUT), "illegal": sum(p not in LEGAL for p in zip(initials, initials[1:])), "entry": START,
    }
    if whole:
        letters, state = audit(codes, START, CLOSING), START
        for code, x in zip(codes, letters, strict=True):
            cost, state = next((edits(code)[s, t][0], t) for s, t in edits(code) if s == state and edits(code)[s, t][1] == x)
            out["cost"] = out.get("cost", 0) + cost
        out |= {"letters": closed(letters, state), "cost": out["cost"] + CLOSING[state]}
    else:
        out |= {"codes": codes, "operator": [x for s in range(4) for end in Rows(codes).forward(unit(s), 0, len(codes)) for x in end]}
    return out


def _operator(flat: list[int]) -> Operator:
    return tuple(tuple((flat[8 * s + 2 * t], flat[8 * s + 2 * t + 1]) for t in range(4)) for s in range(4))


def pieces(codes: DataFrame) -> DataFrame:
    """A row for each conversation and block. Where the conversation lies inside the block it is solved (whole, letters); else the row has its operator."""
    schema = f"conv_id {codes.schema['conv_id'].dataType.simpleString()}, {_PIECE}"
    names = [f.split()[0] for f in schema.split(", ")]

    def of_block(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("seq")
        conv, turn, seq, block, code = (rows.column(c).to_pylist() for c in ("conv_id", "turn", "seq", "block", "code"))
        cuts = [0, *(i for i in range(1, len(conv)) if conv[i] != conv[i - 1]), len(conv)]
        # only the block's first and last conversations can go on in others
        got = [_piece(conv[a], block[a], seq[a], turn[a:b], bytes(code[a:b]), 0 < a and b < len(conv)) for a, b in zip(cuts, cuts[1:])]
        types = {"whole": pa.bool_(), "letters": pa.list_(pa.string()), "codes": pa.binary(), "operator": pa.list_(pa.int64()), "conv_id": rows.schema.field("conv_id").type}
        types |= dict.fromkeys(("entry", "first_initial", "last_initial"), pa.int32())
        return pa.table({n: pa.array([p.get(n) for p in got], types.get(n, pa.int64())) for n in names})

    return codes.groupBy("block").applyInArrow(of_block, schema)


def chained(parts: DataFrame) -> DataFrame:
    """(conv_id, block, entry, exit, pieces, last, counts): for each conversation that may span blocks, each block's entry and exit state; its sums stand with its first block."""
    schema = f"conv_id {parts.schema['conv_id'].dataType.simpleString()}, block long, entry int, exit int, pieces long, first boolean, last boolean, {_COUNTS}"
    sums = ("blank", "duplicate", "truncated", "illegal")

    def of_conversation(rows: pa.Table) -> pa.Table:
        ps = rows.sort_by("block").to_pylist()
        run = Blocks([_operator(p["operator"]) for p in ps])
        states = crossings(run, START, CLOSING)
        total = {n: sum(p[n] for p in ps) for n in sums}
        total["illegal"] += sum((a["last_initial"], b["first_initial"]) not in LEGAL for a, b in zip(ps, ps[1:]))
        n_turns = sum(p["n_turns"] for p in ps) - sum(a["last_turn"] is not None and a["last_turn"] == b["first_turn"] for a, b in zip(ps, ps[1:]))
        real = [p for p in ps if p["n_turns"]]
        total["gaps"] = max(p["most_turn"] for p in real) - min(p["least_turn"] for p in real) + 1 - n_turns if real else 0
        total["cost"] = min(c + CLOSING[s] for s, (c, _) in enumerate(run.forward(unit(START), 0, len(run))) if c < NEVER)
        out = [{"conv_id": p["conv_id"], "block": p["block"], "entry": s, "exit": t, "pieces": len(ps), "first": i == 0, "last": i == len(ps) - 1} for i, (p, s, t) in enumerate(zip(ps, [START, *states], states))]
        out[0] |= total
        types = {"conv_id": rows.schema.field("conv_id").type, "entry": pa.int32(), "exit": pa.int32(), "first": pa.bool_(), "last": pa.bool_()}
        names = [f.split()[0] for f in schema.split(", ")]
        return pa.table({n: pa.array([r.get(n) for r in out], types.get(n, pa.int64())) for n in names})

    return parts.drop("codes", "letters").groupBy("conv_id").applyInArrow(of_conversation, schema)


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        letters = []
        for codes, entry, state, last in zip(*(batch.column(c).to_pylist() for c in ("codes", "entry", "exit", "last")), strict=True):
            one = audit(codes, entry, tuple(0 if s == state else NEVER for s in range(4)))
            letters.append(closed(one, state) if last else one)
        kept = [batch.column(c) for c in ("conv_id", "block", "seq", "entry", "pieces")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(letters, pa.list_(pa.string()))], ["conv_id", "block", "seq", "entry", "pieces", "letters"])


def solved(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(audits, counts) of ordered() rows: audits (conv_id, block, seq, entry, pieces, letters), a row for each conversation and block; counts, a row for each conversation."""
    got = written(pieces(coded(placed)), "pieces")
    parts = got.where("not whole")
    chain = written(chained(parts), "chain")
    own = F.struct("conv_id", "block")
    both = parts.select("conv_id", "block", "seq", "codes", own.alias("own")).join(chain.select(own.alias("other"), "entry", "exit", "pieces", "last"), F.col("own").eqNullSafe(F.col("other")))
    kind = parts.schema["conv_id"].dataType.simpleString()
    apart = both.drop("own", "other").mapInArrow(_solved, f"conv_id {kind}, block long, seq long, entry int, pieces long, letters array<string>")
    whole = got.where("whole")
    audits = whole.select("conv_id", "block", "seq", "entry", F.lit(1).cast("long").alias("pieces"), "letters").unionByName(apart)
    names = [f.split()[0] for f in _COUNTS.split(", ")]
    return audits, whole.select("conv_id", *names).unionByName(chain.where("first").select("conv_id", *names))


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, block, pieces, seq, letters, turns, last) of each row: turns are the (role, text) that stand for it. A block's audits come before its rows."""
    block = letters = None
    known: dict[int, tuple] = {}
    for batch in few(batches):
        for conv, b, kind, seq, entry, n, own, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "block", "kind", "seq", "entry", "pieces", "letters", "role", "text")), strict=True):
            if b != block:
                block, known = b, {}
            if kind == 0:
                known[seq] = (own, entry, n)
                continue
            if seq in known:
                letters, state, pieces_ = known[seq]
                at = 0
            turns, names = [], ("user", "user", "assistant", "user")
            for x in letters[at]:
                if x == "K":
                    turns.append((role, text))
                    state = KEPT["sua".find(role[:1])][state]
                elif x != "D":
                    turns.append((names[state], "" if x == "I" else text))
                    state = NEXT[state]
            at += 1
            yield conv, block, pieces_, seq, letters[at - 1], turns, at == len(letters)


def _with_rows(audits: DataFrame, placed: DataFrame) -> DataFrame:
    left = audits.withColumn("kind", F.lit(0))
    right = placed.select("conv_id", "block", "seq", "role", "text").withColumn("kind", F.lit(1))
    return left.unionByName(right, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "kind", "seq")


def repaired_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, letters): the repaired conversations, a row a turn, place counting from 1 in a conversation's order with gaps where rows went;
    letters are the edits that the turn's original row took. Rows, nulls and ties as in repairs()."""
    placed = ordered(rows)
    audits, _ = solved(placed)
    kind = rows.schema["conv_id"].dataType.simpleString()

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0
        names = ["conv_id", "place", "role", "text", "letters"]
        types = None

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept) if kept else [[]] * 5, types)], names)

        def watched():
            nonlocal types
            for b in batches:
                types = [b.schema.field("conv_id").type, pa.int64(), pa.string(), pa.string(), pa.string()]
                yield b

        for conv, _, _, seq, letters, got, _ in _edited(watched()):
            for i, (role, text) in enumerate(got):
                kept.append((conv, 8 * seq + i, role, text, letters))
                size += len(text) + 64
            if size > CHUNK:
                yield batch()
                kept, size = [], 0
        if kept:
            yield batch()

    return _with_rows(audits, placed).mapInArrow(turns, f"conv_id {kind}, place long, role string, text string, letters string")


def repairs(rows: DataFrame) -> DataFrame:
    """A row per conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows stand by turn, nulls first, then by role and the text's digest, as equal turns have no order of their own. A null in role or text is read as one space; rows
    of null conv_id are one conversation. A role is known by its first letter; one without a letter of s, u, a can't be kept. Repeated rows are duplicates but for the
    first. Texts of any length are read as a whole, and streamed. An empty table gives no rows. Other columns, whatever their names, are not read."""
    placed = ordered(rows.select("conv_id", "turn", "role", "text"))
    audits, counts = solved(placed)
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, block long, part long, audit string, sha string, chunk binary"

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for a conversation inside the block; else chunks of its repaired text (null for none)."""
        types = None

        def watched():
            nonlocal types
            for b in batches:
                types = [b.schema.field("conv_id").type, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
                yield b

        def batch(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], ["conv_id", "block", "part", "audit", "sha", "chunk"])

        found, size = [], 0
        sha, some, letters, lines, bytes_, part = hashlib.sha256(), False, [], [], 0, 0
        for conv, block, n, _, own, turns, last in _edited(watched()):
            letters.append(own)
            for role, text in turns:
                line = f"{role}:{text}".encode()
                if n == 1:
                    sha.update(b"\n" + line if some else line)
                    some = True
                else:
                    lines.append(line)
                    bytes_ += len(line)
            if last and n == 1:
                found.append((conv, block, 0, "".join(letters), sha.hexdigest(), None))
            elif n > 1 and (last or bytes_ > CHUNK):
                found.append((conv, block, part, "".join(letters), None, b"\n".join(lines) if lines else None))
                size += bytes_
                letters, lines, bytes_, part = [], [], 0, part + 1
            if last:
                sha, some, letters, part = hashlib.sha256(), False, [], 0
            if len(found) >= 512 or size > CHUNK:
                yield batch(found)
                found, size = [], 0
        if found:
            yield batch(found)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Audits and digests of conversations whose chunks come in order."""
        own, sha, some, letters, types = None, hashlib.sha256(), False, [], None

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(([own[0]], ["".join(letters)], [sha.hexdigest()]), types)], ["conv_id", "audit", "sha"])

        for b in batches:
            types = [b.schema.field("conv_id").type, pa.string(), pa.string()]
            for conv, part, chunk in zip(*(b.column(c).to_pylist() for c in ("conv_id", "audit", "chunk")), strict=True):
                if own != (conv,):
                    if own:
                        yield batch()
                    own, sha, some, letters = (conv,), hashlib.sha256(), False, []
                letters.append(part)
                if chunk is not None:
                    sha.update(b"\n" + chunk if some else chunk)
                    some = True
        if own:
            yield batch()

    got = written(_with_rows(audits, placed).mapInArrow(digests, schema), "digests")
    long = got.where("sha is null").repartition("conv_id").sortWithinPartitions("conv_id", "block", "part").mapInArrow(joined, f"conv_id {kind}, audit string, sha string")
    ends = got.where("sha is not null").select("conv_id", "audit", "sha").unionByName(long)
    ends = ends.withColumnRenamed("conv_id", "e_conv")
    return counts.join(ends, F.col("conv_id").eqNullSafe(F.col("e_conv"))).drop("e_conv").withColumnRenamed("sha", "repaired_sha256")


def damaged_and_repaired(rows: DataFrame) -> DataFrame:
    """repairs() of damaged() rows, with a row for each conv_id of the table: one that lost all rows has zeros, an empty audit and the digest of an empty text."""
    got = repairs(damaged(rows))
    every = rows.select(F.col("conv_id").alias("own")).distinct()
    names = [f.split()[0] for f in _COUNTS.split(", ")]
    out = every.join(got, F.col("own").eqNullSafe(F.col("conv_id")), "left")
    ends = (F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
    return out.select(F.col("own").alias("conv_id"), *(F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in names), *ends)
