"""Scores of texts under a causal self-attention model on subword ids, trained in numpy, beside a smoothed word model.

Texts are lower-cased in A-Z and cut into words; each word, with a space before it, is encoded by a local rank file. A subword
belongs to a class: the most frequent have one each, the others share a few by what they look like. The model gives the
next class from the classes before it: one layer of masked attention over a window, then a softmax over groups of classes and one
within the group. The share of a subword within its class is counted. Windows overlap: each scores its last STRIDE places and sees up to WINDOW - STRIDE
before them, so every subword and every text's end is scored once. One call of masked attention scores a block of windows.

What is learned comes from all training texts: word counts by a shuffle, subword counts from those, and the weights by
rounds in which every task trains on passages of its own texts from the same start and Spark averages the weights (by the
number of windows). Passages are cut from whole texts all along and dealt to rounds by a hash; the rounds' shares
(PASSAGES_PER_ROUND) add up to DEAL, so every passage of every training text is trained on once. The driver holds weights and subword counts, whose sizes are those of
the model and the vocabulary file.

The word model needs the count of each word. The most frequent words (HEAD_WORDS at most) are sent to all tasks; the
others, few in each text, are joined with the count table by a shuffle.

Null and empty texts are their end alone. Without training texts nothing is known: base_score is 0 and the untrained
model gives the score. Rows that repeat a doc_id are scored each on their own (a null doc_id is trained on), an empty
table gives an empty result, and no columns but doc_id and text are read. The longest text bounds a task's memory (some
60 bytes a byte of it).
"""

from __future__ import annotations

import base64
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouch.llm import words
from vouch.llm.common import arrow_schema, slices, text_bytes, thrifty, written

WINDOW, STRIDE, SIZE = 32, 24, 32
#: Subwords with a class of their own; SHARED classes hold all others, and the end has one: groups of IN_GROUP each, by frequency.
OWN_CLASSES, SHARED, IN_GROUP = 247, 8, 16
N_CLASSES = OWN_CLASSES + 1 + SHARED
#: Beyond these, exponentials are taken after the greatest term is subtracted.
_SAFE = 60
PASSAGE_BYTES, DEAL, PASSAGES_PER_ROUND = 2048, 32, (1, 3, 28)
RATE, BATCH, SCORE_BATCH = 0.01, 32, 192
HEAD_WORDS, SLICE = 1 << 19, 4 << 20
#: Words that a Python worker keeps the ids of; a slice with more distinct ones is encoded all the same.
KNOWN_WORDS = 300_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

Weights = dict[str, np.ndarray]


# --- subwords -----------------------------------------------------------------------------------------------------


@cache
def _vocabulary(ranks: bytes, pattern: str):
    """The encoding, and the number of bytes of each id."""
    import tiktoken

    pairs = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    sizes = np.zeros(max(pairs.values()) + 1, np.int64)
    for piece, rank in pairs.items():
        sizes[rank] = len(piece)
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=pairs, special_tokens={}), sizes


def subwords(distinct: list[bytes], ranks: bytes, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of words (each with a space before it), one after another, and where each word's begin (and the last's end)."""
    encoding, sizes = _vocabulary(ranks, pattern)
    texts = [" " + w.decode("utf-8", "replace") for w in distinct]
    ids = np.array(encoding.encode_ordinary("".join(texts)), np.int64)
    ends, wanted = np.cumsum(sizes[ids]), np.cumsum([len(t.encode()) for t in texts])
    at = np.searchsorted(ends, wanted)
    if len(wanted) and (ends[np.minimum(at, len(ends) - 1)] != wanted).any():
        # white space beyond ASCII on both sides of a join can be matched together
        each = [encoding.encode_ordinary(t) for t in texts]
        return np.array([i for e in each for i in e], np.int64), np.append(0, np.cumsum([len(e) for e in each])).astype(np.int64)
    return ids, np.append(0, at + 1).astype(np.int64)


class KnownWords:
    """Ids of the words met so far, one after another; forgotten when they are more than KNOWN_WORDS."""

    def __init__(self, ranks: bytes, pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self._clear()

    def _clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ids, self.first = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def of(self, distinct: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the words, and all known ids with where each number's begin (and the last's end)."""
        if len(self.number) + len(distinct) > KNOWN_WORDS:
            self._clear()
        number = self.number
        if new := [w for w in distinct if w not in number]:
            ids, first = subwords(new, self.ranks, self.pattern)
            number.update(zip(new, range(len(number), len(number) + len(new)), strict=True))
            self.ids, self.first = np.append(self.ids, ids), np.append(self.first, first[1:] + self.first[-1])
        return np.fromiter(map(number.__getitem__, distinct), np.int64, len(distinct)), self.ids, self.first


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Number of each word among the distinct ones, those (binary), and each text's first word (one more at the end)."""
    data, at = text_bytes(texts)
    data = _LOWER[data]
    starts, ends, bounds = words.spans(data, at)
    inside = words.covered_bytes(len(data), starts, ends)
    places = np.append(0, np.cumsum(ends - starts)).astype(np.int64)
    values = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(data[inside].tobytes())])
    coded = values.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, bounds


def _gathered(first: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the subwords of a row of words, and where each word's begin there (and the last's end)."""
    size = (first[1:] - first[:-1])[which]
    at = np.append(0, np.cumsum(size)).astype(np.int64)
    return np.arange(at[-1]) - np.repeat(at[:-1] - first[which], size), at


# --- the model ----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    """Weights; the class of each id (the end comes last); log10 of an id's share of its class."""

    weights: Weights
    class_of: np.ndarray
    share: np.ndarray

    @property
    def end(self) -> int:
        return int(self.class_of[-1])


def classes(counts: np.ndarray, ranks: bytes, pattern: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of each id, log10 of its share of the class, and the log of each class's share of all, from counts by id (the end last)."""
    encoding, sizes = _vocabulary(ranks, pattern)
    n = len(counts)
    class_of = np.zeros(n, np.int64)
    for i in range(n - 1):
        piece = encoding.decode_single_token_bytes(i) if sizes[i] else b""
        letters = any(0x61 <= b < 0x7B or 0x41 <= b < 0x5B for b in piece)
        class_of[i] = OWN_CLASSES + 1 + 4 * piece.startswith(b" ") + 2 * letters + any(b >= 0x80 for b in piece)
    own = np.lexsort((np.arange(n - 1), -counts[:-1]))[:OWN_CLASSES]
    class_of[own] = np.arange(len(own))
    class_of[-1] = OWN_CLASSES
    total = np.bincount(class_of, counts + 0.5, N_CLASSES)
    share = np.log10((counts + 0.5) / total[class_of])
    used = np.maximum(total, 0.5)
    return class_of, share, np.log(used / used.sum())


def untrained(class_of: np.ndarray, share: np.ndarray, prior: np.ndarray) -> Model:
    rng = np.random.default_rng(13)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    weights = {"e": draw(N_CLASSES, SIZE, scale=0.3), "p": draw(WINDOW, SIZE, scale=0.1)}
    weights |= {k: draw(SIZE, SIZE, scale=SIZE**-0.5) for k in ("q", "k", "v", "o")}
    of_group = np.log(np.exp(prior).reshape(-1, IN_GROUP).sum(axis=1))
    weights |= {"g": draw(N_CLASSES // IN_GROUP, SIZE, scale=0.02), "c": of_group.astype(np.float32), "u": draw(N_CLASSES, SIZE, scale=0.02), "b": prior.astype(np.float32)}
    return Model(weights, class_of, share)


#: Which places of a window (columns) each of its last STRIDE places (rows) must not see.
_UNSEEN = np.arange(WINDOW)[None, :] > np.arange(WINDOW - STRIDE, WINDOW)[:, None]
_MASK = np.where(_UNSEEN, np.float32(-1e9), np.float32(0))


def windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of so many targets each: text of each window, its first place in the flat row (see _flat), and its number in the text.

    The flat row is an end, then each text's classes with its end: the target at place k is predicted from those before.
    """
    count = -(-sizes // STRIDE)
    text = np.repeat(np.arange(len(sizes)), count)
    number = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    begin = np.append(0, np.cumsum(sizes))[:-1]
    return text, begin[text] + number * STRIDE - (WINDOW - STRIDE), number


def _block(flat: np.ndarray, first: np.ndarray, number: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, targets, and which targets count, of some windows; last: the flat place of the text's last target, less one."""
    at = first[:, None] + np.arange(WINDOW)
    scored = at[:, WINDOW - STRIDE :]
    inputs = flat[np.clip(at, 0, len(flat) - 1)]
    return inputs, flat[np.minimum(scored + 1, len(flat) - 1)], scored <= last[:, None]


def _by_group(targets: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order of the targets by group, and for each group that occurs its number and where it lies in that order."""
    group = (targets // IN_GROUP).astype(np.uint8)
    order = np.argsort(group, kind="stable")
    ends = np.cumsum(np.bincount(group, minlength=N_CLASSES // IN_GROUP)).tolist()
    return order, [(g, a, b) for g, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)) if b > a]


def _softmax_loss(z: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """The weighted sum of -log p(target), and its gradient in z."""
    z = z - z.max(axis=1, keepdims=True)
    rows, p = np.arange(len(z)), np.exp(z)
    total = p.sum(axis=1)
    loss = float(((np.log(total) - z[rows, target]) * weight).sum())
    p /= total[:, None]
    p[rows, target] -= 1
    p *= weight[:, None]
    return loss, p


def gradients(w: Weights, inputs: np.ndarray, targets: np.ndarray, counts: np.ndarray, opening: np.ndarray) -> tuple[float, Weights]:
    """Mean loss (nats) and its gradients; opening: windows that begin a text, whose first places hold nothing."""
    n, shown, kind = len(inputs), WINDOW - STRIDE, w["e"].dtype
    flat2 = lambda y: y.reshape(-1, SIZE)
    by = lambda y, m: (flat2(y) @ m).reshape(y.shape)  # noqa: E731  (one product, not one a window)
    x = w["e"][inputs] + w["p"]
    xs = np.ascontiguousarray(x[:, shown:])
    q, k, v = by(xs, w["q"]), by(x, w["k"]), by(x, w["v"])
    scale = kind.type(SIZE**-0.5)
    s = q @ k.transpose(0, 2, 1) * scale + _MASK
    s[opening, :, :shown] = -1e9
    a = np.exp(s - s.max(axis=2, keepdims=True))
    a /= a.sum(axis=2, keepdims=True)
    c = a @ v
    h = flat2(xs + by(c, w["o"]))
    target, many = targets.ravel(), max(int(counts.sum()), 1)
    weight = (counts.ravel() / many).astype(kind)
    loss, dz = _softmax_loss(h @ w["g"].T + w["c"], target // IN_GROUP, weight)
    g: Weights = {"g": dz.T @ h, "c": dz.sum(axis=0), "u": np.zeros_like(w["u"]), "b": np.zeros_like(w["b"])}
    dh = dz @ w["g"]
    order, groups = _by_group(target)
    hs, z = h[order], np.empty((len(h), IN_GROUP), kind)
    for i, begin, end in groups:
        own = slice(i * IN_GROUP, (i + 1) * IN_GROUP)
        z[begin:end] = hs[begin:end] @ w["u"][own].T + w["b"][own]
    within, dz = _softmax_loss(z, target[order] % IN_GROUP, weight[order])
    back = np.empty_like(hs)
    for i, begin, end in groups:
        own = slice(i * IN_GROUP, (i + 1) * IN_GROUP)
        g["u"][own], g["b"][own] = dz[begin:end].T @ hs[begin:end], dz[begin:end].sum(axis=0)
        np.matmul(dz[begin:end], w["u"][own], out=back[begin:end])
    dh[order] += back
    dh = dh.reshape(n, STRIDE, SIZE)
    g["o"] = flat2(c).T @ flat2(dh)
    dc = by(dh, w["o"].T)
    da = dc @ v.transpose(0, 2, 1)
    ds = a * (da - (da * a).sum(axis=2, keepdims=True)) * scale
    dq, dk, dv = ds @ k, ds.transpose(0, 2, 1) @ q, a.transpose(0, 2, 1) @ dc
    g["q"], g["k"], g["v"] = flat2(xs).T @ flat2(dq), flat2(x).T @ flat2(dk), flat2(x).T @ flat2(dv)
    dx = by(dk, w["k"].T) + by(dv, w["v"].T)
    dx[:, shown:] += dh + by(dq, w["q"].T)
    g["p"] = dx.sum(axis=0)
    g["e"] = np.zeros_like(w["e"])
    order = np.argsort(inputs.ravel().astype(np.uint8), kind="stable")
    classes_in, first = np.unique(inputs.ravel()[order], return_index=True)
    g["e"][classes_in] = np.add.reduceat(flat2(dx)[order], first, axis=0)
    return loss + within, g


class Trainer:
    """Adam over batches of windows."""

    def __init__(self, weights: Weights, rate: float = RATE):
        self.w = {k: v.copy() for k, v in weights.items()}
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.s = {k: np.zeros_like(v) for k, v in weights.items()}
        self.rate, self.steps, self.windows, self.losses = rate, 0, 0, []

    def step(self, inputs: np.ndarray, targets: np.ndarray, counts: np.ndarray, opening: np.ndarray) -> None:
        loss, g = gradients(self.w, inputs, targets, counts, opening)
        self.steps += 1
        self.windows += len(inputs)
        self.losses.append(loss)
        rate = self.rate / (1 + self.steps / 200) ** 0.5 * (1 - 0.999**self.steps) ** 0.5 / (1 - 0.9**self.steps)
        for k, d in g.items():
            self.m[k] += 0.1 * (d - self.m[k])
            self.s[k] += 0.001 * (d * d - self.s[k])
            self.w[k] -= (rate * self.m[k] / (np.sqrt(self.s[k]) + 1e-8)).astype(np.float32)


def _log_sums(z: np.ndarray) -> np.ndarray:
    """The logs of sums of exponentials of each row."""
    if z.max() <= _SAFE and z.min() >= -_SAFE:
        return np.log(np.exp(z) @ np.ones(z.shape[1], z.dtype))
    most = z.max(axis=1)
    return np.log(np.exp(z - most[:, None]).sum(axis=1)) + most


@dataclass
class Scorer:
    """Scores windows with tables of what each class adds to queries, keys and values."""

    model: Model
    tables: Weights = field(default_factory=dict)

    def __post_init__(self):
        w, shown = self.model.weights, WINDOW - STRIDE
        scale, value = np.float32(SIZE**-0.5), w["v"] @ w["o"]
        own = lambda m, one: np.hstack([m, np.full((len(m), 1), one, np.float32)])
        # values carry a one, so that what attention adds up holds the sum of its weights
        self.tables = {"eq": w["e"] @ w["q"] * scale, "pq": w["p"][shown:] @ w["q"] * scale, "ek": w["e"] @ w["k"], "pk": w["p"] @ w["k"], "ev": own(w["e"] @ value, 1), "pv": own(w["p"] @ value, 0)}
        self.tables |= {"g": np.ascontiguousarray(np.vstack([w["g"].T, w["c"]])), "u": np.ascontiguousarray(own(w["u"], 0).reshape(-1, IN_GROUP, SIZE + 1).transpose(0, 2, 1))}
        self.tables["u"][:, -1, :] = w["b"].reshape(-1, IN_GROUP)

    def block(self, inputs: np.ndarray, targets: np.ndarray, opening: np.ndarray) -> np.ndarray:
        """log10 of the probability of each target's class."""
        t, w, shown = self.tables, self.model.weights, WINDOW - STRIDE
        own = inputs[:, shown:]
        q, k, v = t["eq"][own], t["ek"][inputs], t["ev"][inputs]
        q += t["pq"]
        k += t["pk"]
        v += t["pv"]
        s = q @ k.transpose(0, 2, 1)
        s += _MASK
        s[opening, :, :shown] = -1e9
        if s.max() > _SAFE or np.diagonal(s, shown, 1, 2).min() < -_SAFE:
            s -= s.max(axis=2, keepdims=True)
        np.exp(s, out=s)
        c = s @ v
        h = np.ones((len(inputs), STRIDE, SIZE + 1), np.float32)
        h[:, :, :-1] = w["e"][own]
        h[:, :, :-1] += w["p"][shown:]
        h[:, :, :-1] += c[:, :, :-1] / c[:, :, -1:]
        h, target = h.reshape(-1, SIZE + 1), targets.ravel()
        z = h @ t["g"]
        logs = z[np.arange(len(z)), target // IN_GROUP] - _log_sums(z)
        order, groups = _by_group(target)
        hs, z = h[order], np.empty((len(h), IN_GROUP), np.float32)
        for i, begin, end in groups:
            np.matmul(hs[begin:end], t["u"][i], out=z[begin:end])
        logs[order] += z[np.arange(len(z)), target[order] % IN_GROUP] - _log_sums(z)
        return (logs / np.float32(math.log(10))).reshape(targets.shape)

    def scores(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The sum over each text's targets; flat: an end, then each text's classes with its end."""
        text, first, number = windows(sizes)
        last = np.cumsum(sizes) - 1
        out = np.zeros(len(sizes))
        for at in range(0, len(text), SCORE_BATCH):
            some = slice(at, at + SCORE_BATCH)
            inputs, targets, counts = _block(flat, first[some], number[some], last[text[some]])
            logs = np.where(counts, self.block(inputs, targets, number[some] == 0), 0).sum(axis=1, dtype=float)
            out += np.bincount(text[some], logs, len(sizes))
        return out


# --- what is counted ----------------------------------------------------------------------------------------------


def _remainder(n: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % n, F.lit(0))


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and whether the row is held out of all learning."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), (_remainder(5) == 1).alias("held_out"))


def word_counts(texts: DataFrame) -> DataFrame:
    """word (lower-cased, binary) and c, over all rows of texts."""
    schema = arrow_schema("word binary, c long")

    def run(batches):
        for batch in batches:
            for part in slices(batch, most=SLICE):
                which, distinct, _ = _words(part.column(0))
                yield pa.record_batch([distinct.cast(pa.binary()), pa.array(np.bincount(which, minlength=len(distinct)), pa.int64())], schema=schema)

    return texts.select("text").mapInArrow(thrifty(run), "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def subword_counts(counts: DataFrame, ranks, pattern: str, ends: int) -> np.ndarray:
    """How often each id occurs in the counted words; the end comes last."""
    ddl = "id int, c long"
    schema = arrow_schema(ddl)

    def run(batches):
        total = None
        for batch in batches:
            ids, first = subwords(batch.column(0).to_pylist(), ranks.value, pattern)
            c = np.repeat(batch.column(1).to_numpy(), np.diff(first))
            found = np.bincount(ids, c, len(_vocabulary(ranks.value, pattern)[1])).astype(np.int64)
            total = found if total is None else total + found
        if total is not None:
            used = np.flatnonzero(total)
            yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(total[used])], schema=schema)

    out = np.zeros(len(_vocabulary(ranks.value, pattern)[1]) + 1, np.int64)
    for i, c in counts.select("word", "c").mapInArrow(run, ddl).groupBy("id").agg(F.sum("c").alias("c")).collect():
        out[i] = c
    out[-1] = ends
    return out


# --- training -----------------------------------------------------------------------------------------------------


def passages(data: np.ndarray, at: np.ndarray, keys: np.ndarray, wanted: range) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the passages (PASSAGE_BYTES each, the last of a text shorter) of texts that a hash of key and number deals to `wanted`."""
    count = np.maximum(-(-np.diff(at) // PASSAGE_BYTES), 1)
    text = np.repeat(np.arange(len(count)), count)
    number = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    place = words.mixed(words.mixed(keys.astype(np.uint64))[text] + number.astype(np.uint64)) % np.uint64(DEAL)
    dealt = (place >= wanted.start) & (place < wanted.stop)
    begin = at[:-1][text[dealt]] + number[dealt] * PASSAGE_BYTES
    return begin, np.minimum(begin + PASSAGE_BYTES, at[1:][text[dealt]])


def _flat(which: np.ndarray, bounds: np.ndarray, distinct: pa.Array, known: KnownWords, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The flat row of classes (an end, then each text's with its end), the number of targets of each text, and its within-class part of the score."""
    number, ids, first = known.of(distinct.to_pylist())
    which = number[which]
    places, at = _gathered(first, which)
    sizes = np.diff(at[bounds]) + 1
    flat = np.full(int(sizes.sum()) + 1, model.end, np.int64)
    text = np.repeat(np.arange(len(sizes)), sizes - 1)
    used = ids[places]
    flat[np.arange(len(places)) + 1 + text] = model.class_of[used]
    return flat, sizes, np.bincount(text, model.share[used], len(sizes)) + model.share[-1]


def _batches_of_windows(flat: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    text, first, number = windows(sizes)
    last = np.cumsum(sizes) - 1
    for at in range(0, len(text), BATCH):
        some = order[at : at + BATCH]
        yield *_block(flat, first[some], number[some], last[text[some]]), number[some] == 0


def _train(model, ranks, pattern: str, wanted: range) -> Callable:
    schema = arrow_schema("place int, n long, v double")

    def run(batches):
        trainer, rng, known = Trainer(model.value.weights), np.random.default_rng(7), KnownWords(ranks.value, pattern)
        for batch in batches:
            for part in slices(batch, most=SLICE):
                data, at = text_bytes(part.column(1))
                keys = part.column(0).fill_null(0).to_numpy(zero_copy_only=False)
                begin, end = passages(data, at, keys, wanted)
                size = end - begin
                if not len(begin):
                    continue
                bounds = np.append(0, np.cumsum(size))
                chosen = data[np.arange(bounds[-1]) - np.repeat(bounds[:-1] - begin, size)]
                # a passage may begin within a word, or a character
                some = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(chosen.tobytes())])
                which, distinct, first_word = _words(some)
                flat, sizes, _ = _flat(which, first_word, distinct, known, model.value)
                order = rng.permutation(int((-(-sizes // STRIDE)).sum()))
                for given in _batches_of_windows(flat, sizes, order):
                    trainer.step(*given)
        if trainer.windows:
            every = np.concatenate([trainer.w[k].ravel() for k in sorted(trainer.w)]).astype(float)
            yield pa.record_batch([pa.array(np.arange(len(every), dtype=np.int32)), pa.array([trainer.windows] * len(every), pa.int64()), pa.array(every * trainer.windows)], schema=schema)

    return run


def trained(texts: DataFrame, model: Model, ranks, pattern: str) -> Model:
    """The model after all rounds: in each, tasks start from the same weights, and their results are averaged by windows."""
    sc, begin = texts.sparkSession.sparkContext, 0
    for share in PASSAGES_PER_ROUND:
        shared = sc.broadcast(model)
        rows = texts.select("doc_id", "text").mapInArrow(thrifty(_train(shared, ranks, pattern, range(begin, begin + share))), "place int, n long, v double")
        sums = sorted(rows.groupBy("place").agg((F.sum("v") / F.sum("n")).alias("v")).collect())
        begin += share
        shared.destroy()
        if sums:
            every, at, weights = np.array([v for _, v in sums], np.float32), 0, {}
            for k in sorted(model.weights):
                size = model.weights[k].size
                weights[k] = every[at : at + size].reshape(model.weights[k].shape)
                at += size
            model = replace(model, weights=weights)
    return model


# --- scoring ------------------------------------------------------------------------------------------------------


def frequent_words(counts: DataFrame, most: int) -> pa.Table:
    """word and c of all words from some count on, `most` of them at most: their number bounds what is collected."""
    step = F.floor(16 * F.log2("c")).cast("int")
    least, n = None, 0
    for row in sorted(counts.groupBy(step.alias("step")).count().collect(), key=lambda r: -r.step):
        n += row["count"]
        if n > most:
            break
        least = row.step
    kept = counts.filter(step >= least) if least is not None else counts.limit(0)
    return kept.select("word", "c").toArrow()


@dataclass(frozen=True)
class Head:
    """Frequent words by their hash, to be compared in full: another word of the same hash is not found here."""

    hashes: np.ndarray
    words: pa.Array
    counts: np.ndarray

    @staticmethod
    def of(found: pa.Table) -> Head:
        listed = found.column("word").combine_chunks().cast(pa.large_binary())
        h = _word_hashes(listed)
        order = np.argsort(h, kind="stable")
        return Head(h[order], listed.take(pa.array(order)), found.column("c").to_numpy()[order])

    def count(self, distinct: pa.Array) -> np.ndarray:
        """The count of each word; -1 where it is not here."""
        if not len(self.hashes) or not len(distinct):
            return np.full(len(distinct), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, _word_hashes(distinct)), len(self.hashes) - 1)
        same = pc.equal(self.words.take(pa.array(at)), distinct).to_numpy(zero_copy_only=False)
        return np.where(same, self.counts[at], -1)


def _word_hashes(listed: pa.Array) -> np.ndarray:
    data, at = text_bytes(listed)
    return words.hashes(data, at[:-1], at[1:])


_SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<struct<word:binary,n:long>>"


def _score(model, head, ranks, pattern: str, n_tokens: int, n_distinct: int, ends: int) -> Callable:
    schema = arrow_schema(_SCORED)
    rest = math.log10(n_tokens + 0.5 * (n_distinct + 1))

    def run(batches):
        scorer, known_words = Scorer(model.value), KnownWords(ranks.value, pattern)
        for batch in batches:
            for part in slices(batch, most=SLICE):
                which, distinct, bounds = _words(part.column(2))
                flat, sizes, within = _flat(which, bounds, distinct, known_words, model.value)
                score = scorer.scores(flat, sizes) + within
                c = head.value.count(distinct)
                text = np.repeat(np.arange(len(part)), np.diff(bounds))
                found = c[which] >= 0
                logs = np.log10(np.maximum(c, 0) + 0.5)
                base = np.bincount(text[found], logs[which[found]], len(part)) + math.log10(ends + 0.5) - rest * (np.diff(bounds) + 1)
                known = np.bincount(text[found], minlength=len(part)) + (ends > 0)
                # a text's other words, each once with how often it occurs
                pair, n = np.unique(text[~found] * (len(distinct) + 1) + which[~found], return_counts=True)
                of, word = pair // (len(distinct) + 1), pair % (len(distinct) + 1)
                rare = pa.StructArray.from_arrays([distinct.take(pa.array(word)).cast(pa.binary()), pa.array(n, pa.int64())], ["word", "n"])
                at = pa.array(np.searchsorted(of, np.arange(len(part) + 1)).astype(np.int32))
                listed = pa.ListArray.from_arrays(at, rare).cast(schema.field("rare").type)
                columns = [pa.array(np.diff(bounds) + 1, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(score), listed]
                yield pa.record_batch([part.column(0), part.column(1), part.column(3), *columns], schema=schema)

    return run


def scored(docs: DataFrame, rank_file: str, pattern: str, head_words: int = HEAD_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (the word model's log10 probability) and score (the attention model's)."""
    spark = docs.sparkSession
    with open(rank_file, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())  # a vocabulary file: its size doesn't grow with the data
    texts = _texts(docs)
    learned = texts.filter(~F.col("held_out"))
    counts = written(word_counts(learned), "word-counts")
    ends = learned.count()
    n_words, n_distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    n_tokens, n_distinct = n_words + ends, n_distinct + (ends > 0)
    class_of, share, prior = classes(subword_counts(counts, ranks, pattern, ends), ranks.value, pattern)
    model = trained(learned, untrained(class_of, share, prior), ranks, pattern)
    sent = spark.sparkContext.broadcast(model)
    head = spark.sparkContext.broadcast(Head.of(frequent_words(counts, head_words)))
    numbered = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", "held_out")
    found = written(numbered.mapInArrow(thrifty(_score(sent, head, ranks, pattern, n_tokens, n_distinct, ends)), _SCORED), "scored")
    sent.destroy()
    head.destroy()
    rare = found.select("row", F.explode("rare").alias("w")).select("row", "w.word", "w.n").join(counts, "word", "left")
    c = F.coalesce("c", F.lit(0))
    sums = rare.groupBy("row").agg(F.sum(F.col("n") * F.log10(c + 0.5)).alias("rare_base"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("rare_known"))
    joined = found.drop("rare").join(sums, "row", "left")
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(n_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"), "score",
    )
