"""Secret scans: fixed patterns, and a battery of randomness tests over encoded-looking tokens.

A token's encoding is the smallest alphabet that holds its characters; words and numbers joined by - _ / + are
judged by their letters and digits alone, a capital at a word's start as a small letter. The battery asks how far it
is from a uniform draw of that alphabet: chi-squared over the symbols, runs about the alphabet's middle, the correlation
of neighbours, where the alphabet has them the shares of the letters that are commonest and rarest in words and the number of neighbours of which one is a vowel, and where it encodes bytes the share of those that print as ASCII. Their least
p-value, allowing for their number, becomes a score: near 0 for uniform draws, the higher the less uniform.

The hypothesis under test is that a token is ordinary: made of words and numbers. How ordinary tokens of an encoding and
length class score is found from made-up ones of several families: words joined in the encoding's manner (camelCase, numbers, marks), by usual letters
and by the corpus's own letter pairs; words of languages of other letters; acronyms; counters and time stamps. The median and
lower spread of each turn a score into a p-value, of which the largest holds, so a token has to be unlike all of them; short tokens, which tell little, get large ones.
Benjamini-Hochberg over the distinct tokens of all documents bounds the share of ordinary ones among those reported as `random`.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.functions.columns import erfc
from reelspark.llm.common import few, written
from reelspark.operators.ranks import prefix_sums

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
WORDLIKE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
MARKS = re.compile("[-_/+]+")
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALPHABETS = {
    "digits": DIGITS, "upper": UPPER, "lower": LOWER,
    "hex": DIGITS + LOWER[:6], "HEX": DIGITS + UPPER[:6], "base32": UPPER + "234567", "base36": DIGITS + LOWER, "BASE36": DIGITS + UPPER,
    "base62": DIGITS + UPPER + LOWER, "base64": UPPER + LOWER + DIGITS + "+/", "base64url": UPPER + LOWER + DIGITS + "-_",
}
PLACES = {k: {c: i for i, c in enumerate(v)} for k, v in ALPHABETS.items()}
LEAST = 20
COMMON = frozenset("aeinorst")  # over six tenths of the letters of English, French, German and Spanish texts
RARE = frozenset("jkqvwxyz")  # under a tenth of the letters of such texts, and of acronyms
BY_SIZE = sorted(PLACES, key=lambda k: len(PLACES[k]))
MARKED = {"base64": "+/", "base64url": "-_"}
MADE_UP = 4_000  # ordinary tokens of a family drawn for each stratum
FAMILIES = 5
VOWELS = "aeiouy"
BYTES = {"hex": (16, 2, 1), "HEX": (16, 2, 1), "base32": (32, 8, 5), "base62": (64, 4, 3), "base64": (64, 4, 3), "base64url": (64, 4, 3)}  # encodings of bytes: base, characters and bytes of a group
ORDERS = {16: DIGITS + LOWER[:6], 32: UPPER + "234567", 64: UPPER + LOWER + DIGITS + "+/"}  # each base's digits
#: Fixed value: small letters from the commonest in prose to the rarest.
USUAL = "etaoinshrdlcumwfgypbvkjxqz"
EXPECTED = 2_000  # pairs of usual letters that are added to those of the corpus
_LETTER = np.zeros(256, np.int64)
_LETTER[[*range(65, 91)]] = _LETTER[[*range(97, 123)]] = range(1, 27)
_NORMAL = NormalDist()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, in order."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)])


def tested(token: str) -> str:
    """The characters that the battery reads: without padding; of words and numbers, LEAST letters and digits or none, without marks, a word's capital as a small letter."""
    body = token.rstrip("=")
    parts = [x for x in MARKS.split(body) if x]
    if all(map(WORDLIKE.fullmatch, parts)):
        body = "".join(x if x.isupper() else x.lower() for x in parts)
    return body if len(body) >= LEAST else ""


def encoding(token: str) -> str | None:
    """The smallest alphabet; none for words and numbers of too few characters, and where no alphabet holds them."""
    seen = set(tested(token))
    return next((k for k in BY_SIZE if seen <= PLACES[k].keys()), None) if seen else None


_tail = np.frompyfunc(lambda z: math.erfc(abs(z) / math.sqrt(2)), 1, 1)
_above = np.frompyfunc(lambda z: 0.5 * math.erfc(z / math.sqrt(2)), 1, 1)


@lru_cache(4096)
def at_least(n: int, share: float) -> np.ndarray:
    """P(a binomial count of n is m or more) for m = 0 .. n."""
    gamma = math.lgamma
    each = [math.exp(gamma(n + 1) - gamma(i + 1) - gamma(n - i + 1) + i * math.log(share) + (n - i) * math.log1p(-share)) for i in range(n + 1)]
    return np.minimum(1.0, np.cumsum(each[::-1])[::-1])


@lru_cache(None)
def _common(kind: str) -> np.ndarray | None:
    """Which symbols are common letters; none for alphabets without all of them."""
    is_common = np.array([c.lower() in COMMON for c in ALPHABETS[kind]])
    return is_common if COMMON <= {c.lower() for c in ALPHABETS[kind]} else None


@lru_cache(None)
def _seldom(kind: str) -> np.ndarray:
    """Which symbols are rare letters."""
    return np.array([c.lower() in RARE for c in ALPHABETS[kind]])


@lru_cache(None)
def _vowels(kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Which symbols are vowels, and which other letters."""
    letters = [c.lower() if c.isalpha() else "" for c in ALPHABETS[kind]]
    return np.array([c != "" and c in VOWELS for c in letters]), np.array([c != "" and c not in VOWELS for c in letters])


@lru_cache(None)
def _printing() -> np.ndarray:
    """Which bytes print as ASCII, blanks and line ends included."""
    return np.array([0x20 <= i <= 0x7E or i in (9, 10, 13) for i in range(256)])


@lru_cache(None)
def _values(kind: str) -> np.ndarray:
    """The value of each symbol as a digit of the encoding's base."""
    digits = ORDERS[BYTES[kind][0]]
    return np.array([digits.index({"-": "+", "_": "/"}.get(c, c.lower() if kind == "HEX" else c)) for c in ALPHABETS[kind]])


def decoded(v: np.ndarray, kind: str) -> np.ndarray:
    """The bytes that tokens encode, whole groups only."""
    base, chars, size = BYTES[kind]
    whole = v.shape[1] // chars
    groups = _values(kind)[v[:, : whole * chars]].reshape(len(v), whole, chars)
    number = np.zeros((len(v), whole), np.int64)
    for i in range(chars):
        number = number * base + groups[:, :, i]
    return np.stack([(number >> (8 * (size - 1 - i))) & 255 for i in range(size)], axis=2).reshape(len(v), -1)


def battery(v: np.ndarray, kind: str) -> np.ndarray:
    """p-values of tokens (a row of places in the alphabet each, all of one length): small for tokens that are no uniform draws."""
    m, n = v.shape
    k = len(ALPHABETS[kind])
    counts = np.bincount((np.arange(m)[:, None] * k + v).ravel(), minlength=m * k).reshape(m, k)
    chi = k / n * (counts * counts).sum(axis=1) - n
    df = (k - 1) * n / (n - 1)  # a gamma variable of the statistic's own mean and variance; Wilson-Hilferty
    uniform = _above((np.cbrt(np.maximum(0.0, chi) / (k - 1)) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))
    high = v >= k / 2
    by_runs = _tail(((high[:, 1:] != high[:, :-1]).sum(axis=1) - (n - 1) / 2) / math.sqrt((n - 1) / 4))
    x = v - (k - 1) / 2
    serial = _tail((x[:, 1:] * x[:, :-1]).sum(axis=1) / ((k * k - 1) / 12) / math.sqrt(n - 1))
    ps = [uniform, by_runs, serial]
    if (common := _common(kind)) is not None:
        ps.append(at_least(n, float(common.mean()))[common[v].sum(axis=1)])
        seldom = _seldom(kind)
        ps.append(at_least(n, 1 - float(seldom.mean()))[n - seldom[v].sum(axis=1)])
        vowel, other = _vowels(kind)
        turns = (vowel[v[:, 1:]] & other[v[:, :-1]]) | (other[v[:, 1:]] & vowel[v[:, :-1]])
        ps.append(at_least(n - 1, float(2 * vowel.mean() * other.mean()))[turns.sum(axis=1)])
    if kind in BYTES:
        prints = _printing()[decoded(v, kind)]
        ps.append(at_least(prints.shape[1], float(_printing().mean()))[prints.sum(axis=1)])
    least = np.min(np.array(ps, float), axis=0)
    return -np.expm1(len(ps) * np.log1p(-np.minimum(least, 1 - 1e-16)))


def places(token: str, kind: str) -> np.ndarray:
    return np.array([PLACES[kind][c] for c in tested(token)])


def randomness(token: str, kind: str) -> float:
    """p-value of the battery: small for tokens that are no uniform draws."""
    return float(battery(places(token, kind)[None, :], kind)[0])


def scores(p: np.ndarray) -> np.ndarray:
    """The normal deviate of each p-value: about 0 for uniform draws, high for others; kept in a range that doubles can tell."""
    return np.array([_NORMAL.inv_cdf(1 - x) if x > 1e-9 else -_NORMAL.inv_cdf(max(x, 1e-300)) for x in np.clip(p, 0, 1 - 1e-3)])


def stratum(kind: str, n: int) -> str:
    """Encoding and length class: two classes for each doubling of the length, one from 1024 on."""
    return f"{kind}:{int(2 * math.log2(min(n, 1024)))}"


def least_length(name: str) -> int:
    """The shortest length of a stratum's class, where ordinary tokens look most like draws."""
    return max(LEAST, math.ceil(2 ** (int(name.partition(":")[2]) / 2) - 1e-9))


def letter_pairs(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """Counts of the pairs of neighbouring letters of a text outside the spans, 27 x 27 flat, in any case; 0 is anything else."""
    own = _LETTER[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)]
    for a, b in spans:
        own[a:b] = 0
    own = np.concatenate([[0], own, [0]])
    pairs = np.bincount(own[:-1] * 27 + own[1:], minlength=729)
    pairs[0] = 0
    return pairs


def chain(pairs: np.ndarray) -> np.ndarray:
    """27 x 27 chances of the next letter (0: the word's end), from counted pairs and EXPECTED ones by USUAL."""
    usual = np.zeros(27)
    usual[[ord(c) - 96 for c in USUAL]] = np.exp(-np.arange(26) / 7.5)
    usual /= usual.sum()
    share = np.append(1.0, usual[1:])  # a word of five letters or so in the mean
    prior = np.outer(share / share.sum(), np.append(0.2, 0.8 * usual[1:]))
    prior[0] = share[0] / share.sum() * usual
    table = pairs.reshape(27, 27) + EXPECTED * prior
    table[0, 0] = 0
    return table / table.sum(axis=1, keepdims=True)


def numbers(n: int, count: int, rnd: np.random.Generator) -> list[np.ndarray]:
    """Two families of count x n digits: counters, dates and padding, of which half repeat the one before and a quarter follow it; and time stamps, with a fraction of a second,
    one after another."""
    steady, at = np.zeros((count, n), np.int64), rnd.integers(0, 10, count)
    for i in range(n):
        u = rnd.random(count)
        at = np.where(u < 0.5, at, np.where(u < 0.75, (at + 1) % 10, rnd.integers(0, 10, count)))
        steady[:, i] = at
    limits = ((1990, 2040, 4), (1, 13, 2), (1, 29, 2), (0, 24, 2), (0, 60, 2), (0, 60, 2), (0, 10**6, 6))
    stamps = []
    while sum(x.shape[1] for x in stamps) < n:
        for low, high, width in limits:
            x = rnd.integers(low, high, count)
            stamps.append(np.stack([x // 10**i % 10 for i in reversed(range(width))], axis=1))
    return [steady, np.concatenate(stamps, axis=1)[:, :n]]


def foreign(flat: float = 0.31) -> np.ndarray:
    """Chances of the next letter in languages of other letters than the usual ones: a share `flat` of them any; words end after a fifth of the letters, as consonants and vowels take turns half of the time."""
    usual = chain(np.zeros(729))[0, 1:]
    vowel = np.array([c in VOWELS for c in LOWER])
    some = lambda of: flat * of / of.sum() + (1 - flat) * usual * of / (usual * of).sum()
    table = np.zeros((27, 27))
    table[0, 1:] = some(np.ones(26))
    table[1:, 1:] = 0.8 * (0.5 * np.where(vowel[:, None], some(~vowel), some(vowel)) + 0.5 * some(np.ones(26)))
    table[1:, 0] = 0.2
    return table


def acronyms(steps: np.ndarray) -> np.ndarray:
    """Chances of the next letter where each is like a word's first one, half of them any; an end after a quarter of the letters."""
    first = 0.75 * steps[0] / steps[0].sum() + 0.25 * (np.arange(27) > 0) / 26
    table = np.tile(0.75 * first, (27, 1))
    table[0] = first
    table[1:, 0] = 0.25
    return table


def ordinary(kind: str, n: int, steps: np.ndarray, count: int = MADE_UP, seed: int = 5) -> np.ndarray:
    """count x n places of made-up ordinary tokens of an encoding with letters: words by the chain of letters, each followed by a number or a mark where the
    alphabet has them; capitals begin words where it has both cases."""
    rnd = np.random.default_rng([seed, n, BY_SIZE.index(kind)])
    place, alphabet = PLACES[kind], ALPHABETS[kind]
    digit = np.array([place[c] for c in alphabet if c in DIGITS])
    out = np.zeros((count, n), np.int64)
    small, large = ([place.get(c, -1) for c in letters] for letters in (LOWER, UPPER))
    known = np.array([False, *(max(a, b) >= 0 for a, b in zip(small, large, strict=True))])
    both = min(small[0], large[0]) >= 0
    capital = np.array([0, *(b if b >= 0 else a for a, b in zip(small, large, strict=True))])
    plain = np.array([0, *(a if a >= 0 else b for a, b in zip(small, large, strict=True))])
    mark = np.array([place[c] for c in MARKED.get(kind, "")])
    go = steps[:, 1:] * known[1:]
    go = np.cumsum(go / go.sum(axis=1, keepdims=True), axis=1)
    drawn = 1 + np.minimum(25, [np.searchsorted(g, (np.arange(4096) + 0.5) / 4096) for g in go])  # the letter for each of 4096 equal parts of [0, 1)
    letter, left, fresh = np.zeros(count, np.int64), np.zeros(count, np.int64), np.zeros(count, bool)
    for i in range(n):
        u, w, x = rnd.random((3, count))
        ended = (letter > 0) & (x < steps[letter, 0])
        letter[ended], fresh[ended] = 0, True
        began = fresh & (letter == 0) & (left == 0) & (w < (0.5 if len(digit) else 0.0))
        left[began] = rnd.geometric(0.5, int(began.sum()))
        marked = fresh & (letter == 0) & (left == 0) & (w > 0.5) & (len(mark) > 0)
        number = left > 0
        word = ~number & ~marked
        starts = word & (letter == 0)
        letter[word] = drawn[letter[word], (u[word] * 4096).astype(int)]
        upper = starts & (rnd.random(count) < 0.9) if both else starts & False
        out[:, i] = np.where(upper, capital[letter], plain[letter])
        if len(digit):
            out[number, i] = digit[(x[number] * len(digit)).astype(int)]
        if len(mark):
            out[marked, i] = mark[(u[marked] * len(mark)).astype(int)]
        left[number] -= 1
        fresh[:] = False
    return out


def families(kind: str, n: int, pairs: np.ndarray) -> list[np.ndarray]:
    """Made-up ordinary tokens of an encoding, a matrix of places each: at most five, the same number for all encodings."""
    if kind == "digits":
        found = numbers(n, MADE_UP, np.random.default_rng([6, n]))
    else:
        usual, own = chain(np.zeros(729)), chain(pairs)
        capitals = (acronyms(usual), acronyms(own)) if kind == "upper" else ()
        found = [ordinary(kind, n, steps) for steps in (usual, own, foreign(), *capitals)]
    return [found[i % len(found)] for i in range(FAMILIES)]


def calibrated(strata: list[str], pairs: np.ndarray) -> dict[str, tuple[float, ...]]:
    """Stratum -> median and lower spread of the scores of each family of its ordinary tokens."""
    out = {}
    for name in strata:
        kind, n, found = name.partition(":")[0], least_length(name), []
        for made in families(kind, n, pairs):
            low, middle = np.quantile(scores(battery(made, kind)), [0.005, 0.5])
            found += [float(middle), float(max(middle - low, 0.5) / 2.576)]
        out[name] = tuple(found)
    return out


def deviate(score: float, known: tuple[float, ...]) -> float:
    """How far a score lies below or above those of ordinary tokens, in spreads, for the family that makes it the most ordinary."""
    return max((score - known[i]) / known[i + 1] for i in range(0, len(known), 2))


TOKEN_FIELDS = "start: long, end: long, stratum: string, score: double, same: binary"


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, counts, base spans and tested tokens of every document; and in a batch's first row its letter pairs outside spans and tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            counts, base, digest, tokens = ([], [], []), [], [], []
            groups: dict[tuple[str, int], list[tuple[dict, str]]] = defaultdict(list)
            pairs = np.zeros(729, np.int64)
            for text in batch.column(1).to_pylist():
                text = text or ""
                spans = base_spans(text)
                for k in range(3):
                    counts[k].append(sum(s[1] == k for s in spans))
                names = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
                digest.append(hashlib.sha256(names.encode()).hexdigest())
                base.append([{"start": a, "kind": k, "end": b} for a, k, b in spans])
                found, closed, i, reach = [], [(a, b) for a, _, b in spans], 0, -1
                for m in TOKEN.finditer(text):
                    a, b = m.span()
                    closed.append((a, b))
                    while i < len(spans) and spans[i][0] < b:
                        reach, i = max(reach, spans[i][2]), i + 1
                    if reach <= a and (kind := encoding(m[0])):
                        n = len(tested(m[0]))
                        found.append({"start": a, "end": b, "stratum": stratum(kind, n), "same": hashlib.md5(m[0].encode()).digest()})
                        groups[kind, n].append((found[-1], m[0]))
                tokens.append(found)
                pairs += letter_pairs(text, closed)
            for (kind, _), some in groups.items():
                for (token, _), s in zip(some, scores(battery(np.stack([places(t, kind) for _, t in some]), kind)), strict=True):
                    token["score"] = float(s)
            span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
            token = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("stratum", pa.string()), ("score", pa.float64()), ("same", pa.binary())])
            letters = pa.array([pairs.tolist()] * min(1, len(base)) + [None] * (len(base) - 1), pa.list_(pa.int64()))
            cols = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digest, pa.string()), pa.array(base, pa.list_(span)), pa.array(tokens, pa.list_(token)), letters]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "base", "tokens", "letters"])

    schema = f"doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, base array<struct<start: long, kind: int, end: long>>, tokens array<struct<{TOKEN_FIELDS}>>, letters array<long>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def known_strata(scans: DataFrame) -> dict[str, tuple[float, ...]]:
    """calibrated() for the strata that the scans hold, with the letter pairs of all texts."""
    strata = [r.stratum for r in scans.select(F.explode("tokens.stratum").alias("stratum")).distinct().collect()]  # encodings times length classes
    if not strata:
        return {}
    pairs = np.zeros(729, np.int64)
    for r in scans.where("letters is not null").select(F.posexplode("letters").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).collect():  # 729 rows
        pairs[r.i] = r.n
    return calibrated(sorted(strata), pairs)


def secret_up_to(z: DataFrame, rate: float) -> float | None:
    """The Benjamini-Hochberg cut of the deviates z of distinct tokens: those of it or a smaller one are no ordinary ones. Distinct values are ranked exactly, in two passes."""
    each = z.groupBy("z").agg(F.count("*").alias("n"))
    ranked = prefix_sums(each, {"n": "upto"}, ["z"]).withColumn("p", 0.5 * erfc(-F.col("z") / math.sqrt(2)))
    of = F.broadcast(each.agg(F.sum("n").alias("of")))
    return ranked.join(of, F.lit(True)).where(F.col("p") <= F.lit(rate) * F.col("upto") / F.col("of")).agg(F.max("z").alias("cut")).first().cut


def scan(docs: DataFrame, rate: float = 0.05) -> DataFrame:
    """A row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end, by start), n_random, n_tested.

    `rate` bounds the expected share of ordinary tokens among the distinct ones reported as random. Null and empty texts have no spans; a text of any
    length is read as a whole. A null doc_id is kept. Repeated rows get equal answers, and a token counts once in the ranking however often it occurs;
    equal p-values stand or fall together. Without tokens, no spans are added. An empty table gives no rows. Other columns, whatever their names, are not read."""
    got = written(scanned(docs), "scans")
    known = known_strata(got)
    of = lambda t, i: F.element_at(F.create_map(*(F.lit(x) for k, v in sorted(known.items()) for x in (k, v[i]))), t["stratum"])
    z = lambda t: F.greatest(*((t["score"] - of(t, i)) / of(t, i + 1) for i in range(0, 2 * FAMILIES, 2)))
    cut = None
    if known:
        each = got.select(F.explode("tokens").alias("t")).groupBy("t.same").agg(F.first("t").alias("t"))  # a token's stratum and score follow from itself
        cut = secret_up_to(each.select(z(F.col("t")).alias("z")), rate)
    random = F.transform(F.filter("tokens", lambda t: z(t) <= F.lit(cut) if cut is not None else F.lit(False)), lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end")))
    every = F.array_sort(F.concat("base", random))
    names = F.array(*map(F.lit, KINDS))
    joined = F.array_join(F.transform(every, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
    return got.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", joined.alias("spans"), F.size(random).cast("long").alias("n_random"), F.size("tokens").cast("long").alias("n_tested"))
