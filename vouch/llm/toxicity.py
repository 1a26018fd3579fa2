"""Toxicity scores behind a noisy channel: obfuscated spellings are restored first, then the restored text is scored.

Restoring: a token with signs for letters (leetspeak), marks between letters, letters spaced apart or repeated letters
is a lattice of what each character may stand for. Viterbi decoding takes the path of the least cost: that of the
channel (substituting, dropping, collapsing) plus that of the text under a character trigram model, whose counts are
taken over all documents. Plain tokens have one path, so only the others are decoded, each once per worker. Tokens of any
length are decoded, in linear time; a long one with separators (a sentence spaced apart) is decoded a second time with
separators that are as likely to stay as to go, and in the pieces between its double separators.

Scoring: word and word-prefix weights come from labelled rows that are not held out. At most `max_fit_rows` of them are
used, those with the least hash of their doc_id: the bound of this fit. Half of them give the weights, the other half
the logistic curve from a document's strongest weights to its score. Labels, lang, source and doc_id are no inputs.

Null and empty texts are scored like any text without a known word. Rows that repeat a doc_id are scored each on their
own. Without labelled rows every score is 0. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vouch.llm.common import arrow_schema, slices, thrifty, whole_texts, written

MAX_FIT_ROWS = 16_000
#: A weight rests on so many toxic rows at least, and on this share of them: the words of a few copies are no evidence.
MIN_ROWS, MIN_SHARE, MIN_WEIGHT = 4, 0.01, 3.0
#: Weights kept at most, the strongest first; this bounds the model, whatever the vocabulary.
MAX_WEIGHTS = 4_000
KNOWN_TOKENS = 150_000
THRESHOLD = 0.3
PREFIXES = (4, 5, 6, 7)

#: What signs may stand for.
SIGNS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
SEPARATORS = " .-_*~'­​‌‍⁠﻿"
#: Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans("аеорсухіѕ", "aeopcyxis")

#: Symbols of the character model: a-z (accents taken off), a word's edge, any other letter.
_EDGE, _OTHER, _SIZE = 26, 27, 28
_SIGN, _REPEAT, _DROP_SEPARATOR, _KEEP_SPACE, _DROP_SIGN = 0.5, 0.5, 0.3, 2.0, 12.0
#: A token with separators and more characters than this may be several words.
_SEVERAL_WORDS = 24


def _symbol(c: str) -> int:
    base = unicodedata.normalize("NFD", c.lower())[:1]
    if "a" <= base <= "z":
        return ord(base) - ord("a")
    return _OTHER if c.isalpha() else _EDGE


_TABLE = np.array([_symbol(chr(i)) for i in range(0x250)] + [_OTHER], np.int64)


def trigram_counts(docs: DataFrame) -> DataFrame:
    """key (three symbols, base 28) and n over all documents; runs of edges count once. 21,952 rows at most."""
    ddl = "key int, n long"
    schema = arrow_schema(ddl)

    def run(batches):
        for batch in batches:
            sums = np.zeros(_SIZE**3, np.int64)
            for part in slices(batch):
                points = np.frombuffer("\n".join(["", *part.column(1).to_pylist(), ""]).encode("utf-32-le"), np.uint32)
                s = _TABLE[np.minimum(points, len(_TABLE) - 1)]
                s = s[np.append(True, (s[1:] != _EDGE) | (s[:-1] != _EDGE))]
                s = np.append(s, [_EDGE, _EDGE])
                sums += np.bincount((s[:-2] * _SIZE + s[1:-1]) * _SIZE + s[2:], minlength=_SIZE**3)
            keys = np.flatnonzero(sums)
            yield pa.record_batch([pa.array(keys.astype(np.int32)), pa.array(sums[keys])], schema=schema)

    return whole_texts(docs).mapInArrow(run, ddl).groupBy("key").agg(F.sum("n").alias("n"))


def trigram_costs(counts: np.ndarray) -> np.ndarray:
    """-ln P(c | a, b), shrunk towards P(c | b) and that towards P(c)."""
    counts = counts.reshape(_SIZE, _SIZE, _SIZE).astype(float)
    two, one = counts.sum(axis=0), counts.sum(axis=(0, 1))
    p1 = (one + 1) / (one + 1).sum()
    p2 = (two + 20 * p1) / (two.sum(axis=1, keepdims=True) + 20)
    p3 = (counts + 20 * p2[None]) / (counts.sum(axis=2, keepdims=True) + 20)
    return -np.log(p3)


_PLAIN = re.compile(r"[^\W\d_]+", re.UNICODE)
_TRIPLE = re.compile(r"([^\W\d_])\1")
_SPACED = re.compile(r"(?<!\S)(?:[^\W_][ .\-_*~]{1,2}){2,}[^\W_](?!\S)")
_DOUBLE = re.compile(r"[ .\-_*~]{2,}")
_TRIM = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "…“”«»"


class Restorer:
    """Viterbi decoding of character lattices under the trigram costs."""

    def __init__(self, costs: np.ndarray):
        self.costs = costs.tolist()

    @staticmethod
    def lattice(token: str, keep_space: float = _KEEP_SPACE) -> list[list[tuple[str, float]]]:
        """For each run of a character, what it may stand for and at what cost."""
        out, i = [], 0
        while i < len(token):
            c, j = token[i], i + 1
            while j < len(token) and token[j] == c:
                j += 1
            n, i = j - i, j
            if c.isalpha():
                out.append([(c, _REPEAT * (n - 1) * (n < 3) + _REPEAT * (n > 1))] + ([(c * 2, 0.0 if n == 2 else _REPEAT)] if n > 1 else []))
            elif c in SIGNS:
                doubled = [(x * 2, _SIGN) for x in SIGNS[c]] if n > 1 else []
                out.append([(x, _SIGN + _REPEAT * (n > 1)) for x in SIGNS[c]] + doubled + [("", _DROP_SIGN)])
            elif c in SEPARATORS:
                out.append([("", _DROP_SEPARATOR), (" ", keep_space)])
            else:
                out.append([(" ", _KEEP_SPACE), ("", _DROP_SIGN)])
        return out

    def decode(self, token: str, keep_space: float = _KEEP_SPACE) -> str:
        # a path is its last letters and the path before them
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(_EDGE, _EDGE): (0.0, None)}
        for options in [*self.lattice(token, keep_space), [(" ", 0.0)]]:
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (cost, path) in states.items():
                for letters, price in options:
                    x, y, total = a, b, cost + price
                    for c in letters:
                        s = _symbol(c)
                        if s == _EDGE and y == _EDGE:
                            continue
                        total += self.costs[x][y][s]
                        x, y = y, s
                    if (x, y) not in after or total < after[x, y][0]:
                        after[x, y] = (total, (letters, path))
            states = after
        path, text = min(states.values(), key=lambda x: x[0])[1], []
        while path:
            letters, path = path
            text.append(letters)
        return "".join(reversed(text)).strip()

    def words(self, token: str) -> list[str]:
        """The words that a token (lower case) stands for: itself, and its restored spelling if it is obfuscated."""
        bare = token.translate(LOOKALIKES).strip(_TRIM)
        plain = _PLAIN.findall(bare)
        if not plain and not any(c in SIGNS for c in bare):
            return plain
        if len(plain) == 1 and plain[0] == bare and not _TRIPLE.search(bare):
            return plain + (self.decode(token.rstrip(_TRIM)).split() if token[0] in SIGNS else [])
        if bare.isdigit():
            return []
        found = [*plain, *self.decode(bare).split()]
        if len(bare) > _SEVERAL_WORDS and any(c in SEPARATORS for c in bare):
            found += self.decode(bare, _DROP_SEPARATOR).split()
            if len(pieces := _DOUBLE.split(bare)) > 1:
                found += [w for x in pieces for w in self.decode(x).split()]
        if any(c in SIGNS for c in token):  # signs at an end may be letters too
            found += self.decode(token.translate(LOOKALIKES)).split()
        return found


def _tokens(text: str) -> set[str]:
    """Distinct tokens of a text, in lower case; letters spaced apart make one."""
    low = text.lower()
    found = set(low.split())
    for m in _SPACED.finditer(low):
        found.add(m[0])
    return found


def features(words: list[str]) -> list[str]:
    out = []
    for word in words:
        if len(word) >= 3:
            out.append("=" + word)
            out += [word[:n] for n in PREFIXES if len(word) >= n]
    return out


def training_rows(docs: DataFrame, labels: DataFrame, max_fit_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """doc_id and toxic (0 or 1) of at most max_fit_rows labelled rows that are not held out."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    present = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    return present.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_fit_rows)


def _fit_counts(restorer: Restorer):
    ddl = "feature string, toxic long, clean long"
    schema = arrow_schema(ddl)

    def run(batches):
        known: dict[str, list[str]] = {}
        counts = {0: Counter(), 1: Counter()}

        def told() -> pa.RecordBatch:
            keys = list(counts[0] | counts[1])
            return pa.record_batch([pa.array(keys, pa.string()), pa.array([counts[1][k] for k in keys], pa.int64()), pa.array([counts[0][k] for k in keys], pa.int64())], schema=schema)

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = set()
                for token in _tokens(text):
                    if (of := known.get(token)) is None:
                        if len(known) > KNOWN_TOKENS // 4:  # each with a list of features
                            known.clear()
                        of = known[token] = features(restorer.words(token))
                    found.update(of)
                counts[toxic].update(found)
                if len(counts[0]) + len(counts[1]) > KNOWN_TOKENS:  # counts of one feature are added up later
                    yield told()
                    counts = {0: Counter(), 1: Counter()}
        yield told()

    return thrifty(run), ddl


class Model:
    def __init__(self, costs: np.ndarray, weights: dict[str, float], curve: np.ndarray | None):
        self.restorer, self.weights, self.curve = Restorer(costs), weights, curve
        self.known: dict[str, float] = {}

    def weight(self, token: str) -> float:
        found = self.known.get(token)
        if found is None:
            if len(self.known) > KNOWN_TOKENS:
                self.known.clear()
            found = self.known[token] = max((self.weights.get(f, 0.0) for f in features(self.restorer.words(token))), default=0.0)
        return found

    def evidence(self, text: str) -> tuple[float, float, float]:
        """The strongest weight, the sum of the next three, and their share among the tokens."""
        tokens = _tokens(text)
        found = sorted((w for w in map(self.weight, tokens) if w), reverse=True)
        return (found[0] if found else 0.0, sum(found[1:4]), sum(found[:20]) / (10 + len(tokens)))

    def scores(self, evidence: np.ndarray) -> np.ndarray:
        if self.curve is None:
            return np.zeros(len(evidence))
        return 1 / (1 + np.exp(-np.clip(_design(evidence) @ self.curve, -30, 30)))


def _design(evidence: np.ndarray) -> np.ndarray:
    evidence = evidence.reshape(-1, 3)
    return np.column_stack([np.ones(len(evidence)), evidence[:, 0] > 0, evidence])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40) -> np.ndarray:
    """Newton's method with a ridge on all but the constant."""
    beta = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        beta = beta - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ beta)
    return beta


def fit(docs: DataFrame, labels: DataFrame, max_fit_rows: int = MAX_FIT_ROWS) -> Model:
    """Only bounded results reach the driver: trigram counts, MAX_WEIGHTS weights, three numbers for each fitted row."""
    counts = np.zeros(_SIZE**3, np.int64)
    for row in trigram_counts(docs).collect():
        counts[row.key] = row.n
    costs = trigram_costs(counts)
    rows = F.broadcast(training_rows(docs, labels, max_fit_rows))  # max_fit_rows rows of two numbers
    # the fit reads its rows several times, and not all texts each time
    texts = written(whole_texts(docs).join(rows, "doc_id").withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2))), "fit-rows")
    run, ddl = _fit_counts(Restorer(costs))
    first = texts.filter("half = 0").select("text", F.col("toxic").cast("int"))
    total = first.groupBy().agg(F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("toxic") == 0).alias("clean")).first()
    if not total.toxic or not total.clean:
        return Model(costs, {}, None)
    odds = F.log((F.col("toxic") + 0.3) / (total.toxic + 0.6)) - F.log((F.col("clean") + 0.3) / (total.clean + 0.6))
    found = first.mapInArrow(run, ddl).groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    strong = found.filter(F.col("toxic") >= max(MIN_ROWS, MIN_SHARE * total.toxic)).withColumn("weight", odds).filter(F.col("weight") > MIN_WEIGHT).orderBy(F.desc(F.col("weight") * F.log1p("toxic")), "feature").limit(MAX_WEIGHTS)
    model = Model(costs, {row.feature: row.weight for row in strong.collect()}, None)
    second = evidence(texts.filter("half = 1").select("doc_id", "text", "toxic"), model, "toxic").collect()
    x, y = np.array([[r.strongest, r.next, r.share] for r in second], float).reshape(-1, 3), np.array([r.toxic for r in second], float)
    if len(y) and 0 < y.sum() < len(y):
        model.curve = _logistic(_design(x), y)
    return model


def evidence(docs: DataFrame, model: Model, *more: str) -> DataFrame:
    """doc_id, more columns, and the evidence and score of each row."""
    kinds = dict(docs.dtypes)
    ddl = ", ".join(["doc_id long", *(f"`{c}` {kinds[c]}" for c in more), "strongest double, next double, share double, score double"])
    schema = arrow_schema(ddl)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MAX_WEIGHTS

    def run(batches):
        own = shared.value
        for batch in batches:
            for part in slices(batch):
                found = np.array([own.evidence(t) for t in part.column(1).to_pylist()], float).reshape(-1, 3)
                yield pa.record_batch([part.column(0), *part.columns[2:], *map(pa.array, (*found.T.copy(), own.scores(found)))], schema=schema)
        own.known.clear()

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more).mapInArrow(thrifty(run), ddl)


def scored(docs: DataFrame, labels: DataFrame, max_fit_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    out = evidence(docs, fit(docs, labels, max_fit_rows))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, max_fit_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """docs without the rows whose score reaches the threshold; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_fit_rows))
    at = docs.columns.index("text")

    def run(batches):
        own = shared.value
        for batch in batches:
            for part in slices(batch):
                found = np.array([own.evidence(t or "") for t in part.column(at).to_pylist()], float).reshape(-1, 3)
                yield part.filter(pa.array(own.scores(found) < THRESHOLD))
        own.known.clear()

    return docs.mapInArrow(thrifty(run), docs.schema)
