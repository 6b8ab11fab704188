"""Benchmark decontamination with a generalised suffix automaton over the items' words.

The automaton of all item word sequences follows a document's words and knows, after each, the
longest match that ends there. A match of `window` words or more is a hit over its whole length, as
each of its windows stands in one item; an item shorter than a window is a window as a whole. Spans
are removed if they reach `span` words or cover `coverage` of the document.

Items are cut into pieces of PIECE_WORDS that overlap by a window less one word, so no window is lost, and pieces are dealt to parts of about PART_BYTES. Tasks build a
part's automaton each and leave it as a file in the shared folder, opened by pyarrow's file systems; tasks on documents open PASS_PARTS of them in one pass. A larger
benchmark takes more passes and not more memory, and the driver gets no more of it than the files' names.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelspark.llm.common import few, quoted, work_dir, written

PART_BYTES, PASS_PARTS, PIECE_WORDS = 1_000_000, 4, 8_000
#: Bytes that end a word become a blank, A-Z become a-z, the rest stay: bytes above 0x7F belong to words.
_NORMAL = bytes(i if i >= 0x80 or 0x30 <= i <= 0x39 or 0x61 <= i <= 0x7A else i + 32 if 0x41 <= i <= 0x5A else 0x20 for i in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_NORMAL).split()


class Automaton:
    """Generalised suffix automaton of word sequences, and for each state the items and windows that end in it."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        own: list[list[int]] = [[]]  # items, by the states of their prefixes
        self.short: list[list[tuple[int, str]]] = [[]]  # (words, item) of items below a window that end in the state
        self.items = [k for k, _ in items]
        for number, (key, ws) in enumerate(items):
            at = 0
            for w in ws:
                at = self._extend(at, self.ids.setdefault(w, len(self.ids)), own)
                own[at].append(number)
            if 0 < len(ws) < window:
                self.short[at].append((len(ws), key))
        # items in which a state's words occur: its own and those of the states whose link leads to it
        order = sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True)
        occur: list[set[int]] = [set(x) for x in own]
        for s in order:
            if (p := self.link[s]) > 0 and self.len[p] >= window:
                occur[p] |= occur[s]
        self.found = [frozenset(x) if self.len[s] >= window else frozenset() for s, x in enumerate(occur)]
        # for a match in s: the ancestor (or s) that holds the windows' last `window` words, and the nearest proper ancestor with short items
        self.at_window, self.at_short = [0] * len(self.len), [0] * len(self.len)
        for s in reversed(order):
            p = self.link[s]
            self.at_window[s] = s if self.len[s] >= window > self.len[p] else self.at_window[p] if self.len[p] >= window else 0
            self.at_short[s] = p if p > 0 and self.short[p] else self.at_short[p] if p > 0 else 0
        self.any_short = any(self.short)

    def _new(self, length: int, own: list, like: int | None = None) -> int:
        self.len.append(length)
        self.next.append({} if like is None else dict(self.next[like]))
        self.link.append(0 if like is None else self.link[like])
        own.append([])
        self.short.append([])
        return len(self.len) - 1

    def _split(self, p: int, q: int, w: int, own: list) -> int:
        clone = self._new(self.len[p] + 1, own, q)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        # short items of at most this length now end in the clone
        self.short[clone] = [x for x in self.short[q] if x[0] <= self.len[clone]]
        self.short[q] = [x for x in self.short[q] if x[0] > self.len[clone]]
        return clone

    def _extend(self, last: int, w: int, own: list) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.len[q] == self.len[last] + 1 else self._split(last, q, w, own)
        new = self._new(self.len[last] + 1, own)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._split(p, q, w, own)
        return new

    def spans(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(disjoint spans of hit words, items with occurring windows)."""
        ids, step, link, length, window = self.ids, self.next, self.link, self.len, self.window
        state = n = 0
        out: list[tuple[int, int]] = []
        items: set[str] = set()
        seen: set[int] = set()
        shorts = self.any_short
        for i, w in enumerate(map(ids.get, ws)):
            if w is None:
                state = n = 0
                continue
            t = step[state].get(w)
            if t is None:
                while t is None and state:
                    state = link[state]
                    n = length[state]
                    t = step[state].get(w)
                if t is None:
                    n = 0
                    continue
            state = t
            n += 1
            if n >= window:
                first = i + 1 - n
                while out and out[-1][1] >= first:
                    first = min(first, out.pop()[0])
                out.append((first, i + 1))
                seen.add(self.at_window[state])
            if shorts and (self.short[state] or self.at_short[state]):
                s = state
                while s:
                    for size, key in self.short[s]:
                        if size <= n:
                            items.add(key)
                            first = i + 1 - size
                            end = i + 1
                            while out and out[-1][1] >= first:
                                a, b = out.pop()
                                first, end = min(first, a), max(end, b)
                            out.append((first, end))
                    s = self.at_short[s]
        for s in seen:
            items.update(self.items[k] for k in self.found[s])
        return out, items


def pieces(items: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """(i, ws): the items' words, separated by blanks, in overlapping pieces; written, repeated ones once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches, 64):
            ids, out = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ws = words(text)
                for a in range(0, max(1, len(ws) - window + 1), PIECE_WORDS):
                    ids.append(i)
                    out.append(b" ".join(ws[a : a + PIECE_WORDS + window - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(out, pa.binary())], ["i", "ws"])

    own = items.where(F.col(text_col).isNotNull()).select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).cast("binary").alias("t"))
    return written(own.mapInArrow(run, "i string, ws binary").distinct(), "pieces")


def automata(items: DataFrame, window: int, id_col: str, text_col: str) -> list[str]:
    """Files of the parts' automata, built by a task each."""
    own = pieces(items, window, id_col, text_col)
    total = own.agg(F.coalesce(F.sum(F.octet_length("ws") + 16), F.lit(0)).alias("b")).first().b
    folder = work_dir(items.sparkSession, "automata")

    def build(part: pd.DataFrame) -> pd.DataFrame:
        made = Automaton(sorted((i, bytes(ws).split()) for i, ws in zip(part.i, part.ws, strict=True)), window)
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name = f"{int(part.part.iloc[0])}-{uuid.uuid4().hex}"  # each attempt has a file of its own
        with store.open_output_stream(f"{root}/{name}") as out:
            out.write(pickle.dumps(made))
        return pd.DataFrame({"path": [f"{folder}/{name}"]})

    parts = own.withColumn("part", F.pmod(F.xxhash64("ws"), F.lit(max(1, -(-total // PART_BYTES)))))
    return sorted(r.path for r in written(parts.groupBy("part").applyInPandas(build, "path string"), "parts").collect())  # a row a part


@lru_cache(maxsize=PASS_PARTS)
def opened(path: str) -> Automaton:
    """An automaton, kept by the worker for its next task."""
    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_stream(name) as f:
        return pickle.loads(f.read())


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _with_spans(docs: DataFrame, items: DataFrame, window: int, id_col: str, item_text: str) -> DataFrame:
    """docs (with __text binary) plus __n words, __spans and __items, one pass over docs for each PASS_PARTS parts of the benchmark."""
    docs = docs.withColumn("__n", F.lit(0).cast("long")).withColumn("__spans", F.array().cast("array<array<long>>")).withColumn("__items", F.array().cast("array<string>"))
    at = docs.columns.index("__text")
    paths = automata(items, window, id_col, item_text)
    for first in range(0, max(1, len(paths)), PASS_PARTS):

        def run(batches: Iterator[pa.RecordBatch], paths=paths[first : first + PASS_PARTS]) -> Iterator[pa.RecordBatch]:
            automata = [opened(p) for p in paths]
            for batch in few(batches):
                n = batch.num_columns
                counts, all_spans, all_items = [], [], []
                for text, s, i in zip(batch.column(at), batch.column(n - 2), batch.column(n - 1), strict=True):
                    ws = words(text.as_py())
                    spans, found = [tuple(x) for x in s.as_py()], set(i.as_py())
                    for a in automata:
                        more, others = a.spans(ws)
                        spans, found = spans + more, found | others
                    counts.append(len(ws))
                    all_spans.append(merged(spans))
                    all_items.append(sorted(found))
                made = [pa.array(counts, pa.int64()), pa.array(all_spans, pa.list_(pa.list_(pa.int64()))), pa.array(all_items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-3], *made], batch.schema.names)

        docs = docs.mapInArrow(run, docs.schema)
        if first + PASS_PARTS < len(paths):
            docs = written(docs, "matched")
    return docs


def find(docs: DataFrame, items: DataFrame, window: int = 10, keep: tuple[str, ...] = ("doc_id",), id_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The columns `keep` of every document, n_words, n_hit, n_items, items_sha256, contaminated, spans (array of [first, end) words).

    Null and empty texts have no words and no hits; a text of any length is followed as a whole. Items without words have no windows; items of one id count once.
    Repeated documents each get a row; an empty table gives none. An empty benchmark finds nothing. Columns in `keep` may have any names that don't begin with __."""
    got = _with_spans(docs.select(*map(quoted, keep), F.col("text").cast("binary").alias("__text")), items, window, id_col, item_text)
    got = got.withColumn("n_hit", F.aggregate("__spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0]))
    return got.select(
        *map(quoted, keep), F.col("__n").alias("n_words"), "n_hit", F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("__items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.col("__spans").alias("spans"),
    )


def clean(docs: DataFrame, items: DataFrame, window: int = 10, span: int = 10, coverage: float = 0.5) -> DataFrame:
    """docs with the words of found spans cut out of `text` where a span reaches `span` words or, together, spans cover
    `coverage` of the document; documents of which no word is left go. Other columns stay, whatever their names. Rows, null, empty and long texts as in find(): without hits a row stays as it is."""
    names = docs.columns
    others = F.struct(*(quoted(c) for c in names if c != "text"), F.lit(0).alias("never_empty")).alias("others")
    got = _with_spans(docs.select(others, F.col("text").cast("binary").alias("__text")), items, window, "item_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            texts, kept = batch.column("__text").to_pylist(), []
            for i, spans in enumerate(batch.column("__spans").to_pylist()):
                if spans:
                    n = batch.column("__n")[i].as_py()
                    gone = spans if sum(b - a for a, b in spans) >= coverage * n else [s for s in spans if s[1] - s[0] >= span]
                    if sum(b - a for a, b in gone) == n:
                        continue
                    texts[i] = cut(texts[i], gone)
                kept.append(i)
            yield pa.RecordBatch.from_arrays([batch.column("others"), pa.array(texts, pa.binary())], ["others", "text"]).take(pa.array(kept, pa.int64()))

    got = got.mapInArrow(run, T.StructType([got.schema["others"], T.StructField("text", T.BinaryType())]))
    return got.select(*(F.decode("text", "UTF-8").alias("text") if c == "text" else F.col("others").getField(c).alias(c) for c in names))


def cut(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """raw without the bytes from the first to the last word of each span."""
    flat, at, places = raw.translate(_NORMAL), 0, []
    for w in flat.split():
        at = flat.index(w, at)
        places.append((at, at + len(w)))
        at += len(w)
    out, done = [], 0
    for a, b in spans:
        out.append(raw[done : places[a][0]])
        done = places[b - 1][1]
    return b"".join([*out, raw[done:]])
