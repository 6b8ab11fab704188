"""Spelling variant grouping: words of a corpus that differ by one edit, found by composing finite-state machines.

The minimised acceptor of the vocabulary, composed with the one-edit transducer and the acceptor again, accepts the near pairs. In its states (q, edit spent, q'), both
sides stand on one state until the edit is spent and read equal letters after it. The machine is enumerated in partitions, each begun where both sides have read a
common beginning: half of the shorter word's letters. One edit leaves the first or the last half as it is, so a second machine of reversed words finds
pairs whose edit lies in the first half. A pair belongs to the partition of its shorter length, and to the forward machine if that can accept it, so it is found once.

A partition of more than MOST words is begun one letter later, for each letter apart. Its pairs that spend the edit on that letter go on as equal remainders, so
they meet by them: at most an alphabet of words a remainder.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.llm.common import discard, few, written

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LEAST_LETTERS, LEAST_COUNT, RATIO = 5, 3, 2
DAMAGED = 97  # of the hashes of (document, word), one in so many loses a letter
KEPT_COUNTS = 200_000  # counts that a task holds before it hands them on
MOST = 20_000


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): the corpus's words of LEAST_LETTERS letters or more, each document's planted misspellings included, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}

        def handed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

        for batch in few(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own: dict[str, int] = {}
                for w in RUN.findall(text.lower().decode() if text else ""):  # bytes: A-Z only
                    own[w] = own.get(w, 0) + 1
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for w, n in own.items():
                    h = zlib.crc32(w.encode(), start)
                    if h % DAMAGED == 0:
                        at = h % len(w)
                        w = w[:at] + w[at + 1 :]
                    if len(w) >= LEAST_LETTERS:
                        counts[w] = counts.get(w, 0) + n
                if len(counts) > KEPT_COUNTS:
                    yield handed()
                    counts.clear()
        yield handed()

    got = docs.select(F.col("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "word string, n long")
    return got.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


class Acceptor:
    """The minimal acyclic automaton of sorted distinct words."""

    def __init__(self, words: Iterable[str]):
        self.arcs: list[dict[str, int]] = [{}]
        self.final = [False]
        known: dict[tuple, int] = {}
        path, last = [0], ""

        def settle(depth: int) -> None:
            """States of the last word beyond the depth get no more arcs: equal ones become one."""
            while len(path) - 1 > depth:
                state = path.pop()
                self.arcs[path[-1]][last[len(path) - 1]] = known.setdefault((self.final[state], *self.arcs[state].items()), state)

        for w in words:
            n = 0
            while n < min(len(w), len(last)) and w[n] == last[n]:
                n += 1
            settle(n)
            for c in w[n:]:
                self.arcs.append({})
                self.final.append(False)
                self.arcs[path[-1]][c] = len(self.arcs) - 1
                path.append(len(self.arcs) - 1)
            self.final[path[-1]] = True
            last = w
        settle(0)

    def common(self, p: int, q: int, but: str = "") -> Iterator[str]:
        """Words that both states accept, of those that don't begin with `but`."""
        todo = [(p, q, "")]
        while todo:
            p, q, x = todo.pop()
            if self.final[p] and self.final[q]:
                yield x
            own, other = self.arcs[p], self.arcs[q]
            for c in own if len(own) <= len(other) else other:
                if c in own and c in other and not (c == but and not x):
                    todo.append((own[c], other[c], x + c))

    def spent_at(self, q: int) -> list[tuple[str, str]]:
        """Pairs of what can follow where both sides stand on q and the edit is spent on the next letter: a replaced one, or one that the first side has more and that isn't the other's next."""
        arcs = list(self.arcs[q].items())
        found = [(a + x, b + x) for i, (a, p) in enumerate(arcs) for b, r in arcs[i + 1 :] for x in self.common(p, r)]
        return found + [(a + x, x) for a, p in arcs for x in self.common(p, q, but=a)]

    def near_pairs(self) -> Iterator[tuple[str, str]]:
        """All accepted pairs of words one edit apart, once, the longer word first."""
        order, todo, seen = [], [0], {0}  # every state before those that it leads to, or they are sorted so below
        while todo:
            q = todo.pop()
            order.append(q)
            for r in self.arcs[q].values():
                if r not in seen:
                    seen.add(r)
                    todo.append(r)
        spent = {q: s for q in order if (s := self.spent_at(q))}
        leads: dict[int, list[int]] = {}
        for q in order:
            for r in self.arcs[q].values():
                leads.setdefault(r, []).append(q)
        live, todo = set(spent), list(spent)  # states from which the edit can still be spent
        while todo:
            for q in leads.get(todo.pop(), ()):
                if q not in live:
                    live.add(q)
                    todo.append(q)
        todo2 = [(0, "")]
        while todo2:
            q, x = todo2.pop()
            for a, b in spent.get(q, ()):
                yield x + a, x + b
            todo2 += [(r, x + c) for c, r in self.arcs[q].items() if r in live]


_PART = ["m", "side", "start", "rest", "word", "n"]


def partitions(words: DataFrame) -> DataFrame:
    """(m, side, start, rest, word, n): each word in the partitions of pairs whose shorter word has m letters: by its first half (side 0), and, reversed, by its last (side 1)."""
    n, half = F.length("word"), F.floor(F.col("m") / 2).cast("int")
    rows = words.withColumn("m", F.explode(F.array(n, n - 1))).where(F.col("m") >= LEAST_LETTERS)
    rows = rows.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    read = F.when(F.col("side") == 0, F.col("word")).otherwise(F.reverse("word"))
    at = F.when(F.col("side") == 0, half).otherwise(F.col("m") - half)
    return rows.select("m", "side", F.substring(read, F.lit(1), at).alias("start"), F.substring(read, at + 1, n).alias("rest"), "word", "n")


def later(parts: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(parts, spent): partitions of more than MOST words begun later, until none is left; spent (m, side, start, rest, word, n, tag), rows that meet by equal (m, side, start, rest) there."""
    parts, spent = written(parts, "parts"), None
    key = ["m", "side", "start"]
    while True:
        big = written(parts.groupBy(*key).agg(F.count("*").alias("size")).where(F.col("size") > MOST).drop("size"), "big")
        if big.isEmpty():
            return parts, spent
        hot = parts.join(big, key, "left_semi")
        more: Column = F.length("word") > F.col("m")
        # s: all but its next letter, d: the same of a longer word, v: the whole of a shorter one
        tail, start, next_ = F.expr("substring(rest, 2)"), F.concat("start", F.expr("substring(rest, 1, 1)")), F.expr("substring(rest, 1, 1)")
        lost = hot.where(F.length("rest") > 0).select(*key, tail.alias("rest"), "word", "n", F.when(more, F.lit("d")).otherwise(F.lit("s")).alias("tag"), next_.alias("letter"))
        whole = hot.where(~more).select(*key, "rest", "word", "n", F.lit("v").alias("tag"), F.expr("substring(rest, 1, 1)").alias("letter"))
        now = written(lost.unionByName(whole), "spent")
        spent = now if spent is None else spent.unionByName(now)
        moved = hot.where(F.length("rest") > 0).select("m", "side", start.alias("start"), tail.alias("rest"), "word", "n")
        parts, done = written(parts.join(big, key, "left_anti").select(*_PART).unionByName(moved), "parts"), parts
        discard(done, big)


def _summed(pairs: Iterable[tuple[str, str]], m: int, side: int, counts: dict[str, int], out: dict[str, list]) -> None:
    """Adds to out[word]: near words, and the most frequent one, the least of equals."""
    half = m // 2
    for a, b in pairs:
        if side and a[:half] == b[:half]:
            continue  # the forward machine has it
        for w, x in ((a, b), (b, a)):
            found = out.setdefault(w, [0, (0, "")])
            found[0] += 1
            best = (-counts[x], x)
            found[1] = min(found[1], best) if found[1][0] else best


def _rows(out: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(out.keys(), pa.string()), pa.array([v[0] for v in out.values()], pa.int64()), pa.array([-v[1][0] for v in out.values()], pa.int64()), pa.array([v[1][1] for v in out.values()], pa.string())],
        ["word", "n_near", "near_n", "near"],
    )


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in few(batches, 4096):
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


_NEAR = "word string, n_near long, near_n long, near string"


def _by_machines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (m, side, start, rest, word, n): what each partition's machine accepts, summed by word."""
    out: dict[str, list] = {}
    for (m, side, start), group in groupby(_records(batches), itemgetter(0, 1, 2)):
        rows = list(group)
        if len(rows) > 1 and any(len(r[4]) == m for r in rows):
            of = {r[3]: r[4] for r in rows}
            near = ((of[a], of[b]) for a, b in Acceptor(of).near_pairs() if len(start) + len(b) == m)
            _summed(near, m, side, {r[4]: r[5] for r in rows}, out)
        if len(out) > 10_000:
            yield _rows(out)
            out = {}
    yield _rows(out)


def _by_rests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (m, side, start, rest, word, n, tag, letter) of later(): the pairs of equal remainders, summed by word."""
    out: dict[str, list] = {}
    for (m, side, _, _), group in groupby(_records(batches), itemgetter(0, 1, 2, 3)):
        rows = list(group)
        by = {t: [r for r in rows if r[6] == t] for t in "sdv"}
        near = [(a[4], b[4]) for i, a in enumerate(by["s"]) for b in by["s"][i + 1 :]] + [(d[4], v[4]) for v in by["v"] for d in by["d"] if d[7] != v[7]]
        _summed(near, m, side, {r[4]: r[5] for r in rows}, out)
        if len(out) > 10_000:
            yield _rows(out)
            out = {}
    yield _rows(out)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, near_n, near) of each word that has near words in `words` (word, n): how many, and the most frequent one, the least of equals."""
    parts, spent = later(partitions(words))
    found = parts.select(*_PART).repartition("m", "side", "start").sortWithinPartitions(*_PART[:4]).mapInArrow(_by_machines, _NEAR)
    if spent is not None:
        found = found.unionByName(spent.repartition("m", "side", "start", "rest").sortWithinPartitions(*_PART[:4]).mapInArrow(_by_rests, _NEAR))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.less")).alias("near_n"), F.col("best.near").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): each chain of forms followed to its end by doubled steps. A form has twice its word's count, so chains are short and have no circles."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.select(F.col("word").alias("at"), F.col("root").alias("on"))
        new = written(now.join(step, now["root"] == step["at"], "left").select("word", F.coalesce("on", "root").alias("root"), F.col("on").isNotNull().alias("moved")), "roots")
        discard(now)
        now = new.select("word", "root")
        now._work_path = new._work_path
        if new.where("moved").isEmpty():
            return now


def variants(docs: DataFrame) -> DataFrame:
    """A row per word: word, form, root, n, n_near, form_n.

    Words are the runs of letters, A-Z lower-cased, of LEAST_LETTERS letters and LEAST_COUNT occurrences. A null or empty text has none; a null doc_id counts as an empty one;
    repeated rows count each. Texts and words of any length are read as a whole. An empty table gives no rows. Other columns, whatever their names, are not read."""
    words = written(word_counts(docs), "words")
    near = written(near_words(words), "near")
    formed = words.join(near, "word", "left").withColumn("formed", F.col("near_n") >= RATIO * F.col("n"))
    formed = formed.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("formed"), F.col("near")).alias("form"), F.when(F.col("formed"), F.col("near_n")).alias("form_n"))
    formed = written(formed, "forms")
    ends = roots(formed.where("form is not null"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
