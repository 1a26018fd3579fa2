"""The attention model by finite differences and plain loops, and the word model by brute force."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from vouch.llm import lm_scoring as L
from vouch.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RANK_FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
with open(RANK_FILE, "rb") as f:
    RANKS = f.read()
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tiny(seed=0):
    rng = np.random.default_rng(seed)
    counts = np.zeros(50257, np.int64)
    counts[rng.integers(0, 50256, 900)] = rng.integers(1, 99, 900)
    counts[-1] = 40
    model = L.untrained(*L.classes(counts, RANKS, public_tokenizers.PATTERN))
    for k in "ug":
        model.weights[k][:] = rng.standard_normal(model.weights[k].shape) * 0.3
    return model


def flat_of(texts, end):
    sizes = np.array([len(t) + 1 for t in texts])
    return np.array([end] + [c for t in texts for c in [*t, end]]), sizes


def plain_score(model, text):
    """Each target by itself: its window's places one by one."""
    w, end, total = model.weights, model.end, 0.0
    inputs, targets = [end, *text], [*text, end]
    for i, target in enumerate(targets):
        begin = (i // L.STRIDE) * L.STRIDE - (L.WINDOW - L.STRIDE)
        x = {j: w["e"][inputs[j]] + w["p"][j - begin] for j in range(max(begin, 0), i + 1)}
        s = {j: float((x[i] @ w["q"]) @ (x[j] @ w["k"])) / math.sqrt(L.SIZE) for j in x}
        most = max(s.values())
        weight = {j: math.exp(v - most) for j, v in s.items()}
        c = sum(weight[j] * (x[j] @ w["v"]) for j in x) / sum(weight.values())
        h, group = x[i] + c @ w["o"], target // L.IN_GROUP
        own = slice(group * L.IN_GROUP, (group + 1) * L.IN_GROUP)
        for z, at in ((h @ w["g"].T + w["c"], group), (h @ w["u"][own].T + w["b"][own], target % L.IN_GROUP)):
            total += float(z[at] - np.log(np.exp(z.astype(float)).sum())) / math.log(10)
    return total


def test_windows_score_each_target_once():
    model, rng = tiny(), np.random.default_rng(2)
    texts = [rng.integers(0, L.OWN_CLASSES, n).tolist() for n in (0, 1, 5, 23, 24, 25, 47, 48, 100, 0)]
    flat, sizes = flat_of(texts, model.end)
    text, first, number = L.windows(sizes)
    inputs, targets, counts = L._block(flat, first, number, (np.cumsum(sizes) - 1)[text])
    assert counts.sum() == sizes.sum()
    assert Counter(targets[counts].tolist()) == Counter(flat[1:].tolist())
    assert np.allclose(L.Scorer(model).scores(flat, sizes), [plain_score(model, t) for t in texts], rtol=1e-4, atol=1e-3)


def test_gradients_by_finite_differences():
    model, rng = tiny(3), np.random.default_rng(4)
    w = {k: v.astype(float) for k, v in model.weights.items()}
    flat, sizes = flat_of([rng.integers(0, 200, 40).tolist(), [], [3, 1]], model.end)
    text, first, number = L.windows(sizes)
    given = (*L._block(flat, first, number, (np.cumsum(sizes) - 1)[text]), number == 0)
    _, g = L.gradients(w, *given)
    for k, v in w.items():
        for _ in range(4):
            direction = rng.standard_normal(v.shape)
            step = 1e-4
            up, down = ({**w, k: v + sign * step * direction} for sign in (1, -1))
            slope = (L.gradients(up, *given)[0] - L.gradients(down, *given)[0]) / (2 * step)
            assert slope == pytest.approx(float((g[k] * direction).sum()), rel=2e-3, abs=1e-4), k


def test_probabilities_add_up_to_one():
    model, rng = tiny(5), np.random.default_rng(6)
    shares = np.bincount(model.class_of, 10.0**model.share, L.N_CLASSES)
    assert np.allclose(shares[np.unique(model.class_of)], 1)
    inputs = rng.integers(0, 200, (1, L.WINDOW))
    p = sum(10.0 ** L.Scorer(model).block(inputs, np.full((1, L.STRIDE), c), np.array([False])).astype(float) for c in range(L.N_CLASSES))
    assert np.allclose(p, 1, atol=1e-4)


def test_large_weights_do_not_overflow():
    model = tiny(7)
    model.weights["b"][3] = 300
    model.weights["c"][:] = -200
    flat, sizes = flat_of([[3, 4, 3]], model.end)
    assert np.isfinite(L.Scorer(model).scores(flat, sizes)).all()


def test_training_lowers_the_loss():
    model, rng = tiny(8), np.random.default_rng(9)
    texts = [list(np.tile(rng.integers(0, 200, 3), 30)) for _ in range(4)]
    flat, sizes = flat_of([t for t in texts for _ in range(8)], model.end)
    trainer = L.Trainer(model.weights)
    for _ in range(30):
        for given in L._batches_of_windows(flat, sizes, rng.permutation(int((-(-sizes // L.STRIDE)).sum()))):
            trainer.step(*given)
    assert trainer.losses[-1] < 0.6 * trainer.losses[0]


def test_subwords_of_words():
    listed = [b"the", "é".encode(), b"it's", "a\xa0".encode(), "\xa0b".encode(), b"\xff\xfe", b"x" * 300, "日本".encode(), b"1234567", b"--!!"]
    encoding, _ = L._vocabulary(RANKS, public_tokenizers.PATTERN)
    for some in (listed, listed[:3], listed[5:], [], [b"a"]):
        ids, first = L.subwords(some, RANKS, public_tokenizers.PATTERN)
        expected = [encoding.encode_ordinary(" " + w.decode("utf-8", "replace")) for w in some]
        assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == expected


def test_known_words_are_forgotten_and_found(monkeypatch):
    monkeypatch.setattr(L, "KNOWN_WORDS", 6)
    known = L.KnownWords(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(1)
    for _ in range(30):
        some = [f"w{i}é".encode() for i in rng.sample(range(12), rng.randint(0, 9))]
        number, ids, first = known.of(some)
        expected, ends = L.subwords(some, RANKS, public_tokenizers.PATTERN)
        assert [ids[first[k] : first[k + 1]].tolist() for k in number] == [expected[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]


def test_passages_are_dealt_once():
    rng = np.random.default_rng(1)
    at = np.append(0, np.cumsum(rng.integers(0, 9000, 300)))
    keys = rng.integers(0, 50, 300)
    covered = np.zeros(at[-1], int)
    for place in range(L.DEAL):
        for a, b in zip(*L.passages(np.zeros(at[-1], np.uint8), at, keys, range(place, place + 1)), strict=True):
            covered[a:b] += 1
    assert (covered == 1).all()


def test_rounds_train_on_every_passage():
    """The rounds' shares follow each other and leave no passage of a training text out."""
    rng = np.random.default_rng(2)
    at = np.append(0, np.cumsum(rng.integers(0, 9000, 300)))
    covered, begin = np.zeros(at[-1], int), 0
    for share in L.PASSAGES_PER_ROUND:
        for a, b in zip(*L.passages(np.zeros(at[-1], np.uint8), at, np.arange(300), range(begin, begin + share)), strict=True):
            covered[a:b] += 1
        begin += share
    assert (covered == 1).all()


def brute(rows):
    tokens = {k: [*WORD.findall((t or "").translate(LOWER)), None] for k, (_, t) in enumerate(rows)}
    held = {k: i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for k, (i, _) in enumerate(rows)}
    c = Counter(w for k, ws in tokens.items() if not held[k] for w in ws)
    n, v = sum(c.values()), len(c)
    return [(i, held[k], len(tokens[k]), sum(c[w] > 0 for w in tokens[k]), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens[k])) for k, (i, _) in enumerate(rows)]


@pytest.mark.parametrize("head_words", [0, 20, 1 << 19])
def test_query_on_odd_rows(spark, head_words):
    rng = random.Random(head_words)
    pool = ["The", "the", "é", "É", "a\xa0b", "zebra", "x" * 400, "1,2", "q"] + [f"w{i}" for i in range(40)]
    texts = [None, "", " \n", "the"] + [rng.choice(" \t\n").join(rng.choice(pool) for _ in range(rng.randint(1, 90))) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (None, "zebra only here"), (None, None)]
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, row int, word string").repartition(3)
    found = L.scored(docs, RANK_FILE, public_tokenizers.PATTERN, head_words).collect()
    key = lambda r: tuple((x is not None, x) for x in r[:5])
    for own, theirs in zip(sorted(found, key=key), sorted(brute(rows), key=key), strict=True):
        assert tuple(own[:5]) == theirs[:5] and own.base_score == pytest.approx(theirs[5], abs=1e-9)
        assert -math.inf < own.score < 0


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert L.scored(docs, RANK_FILE, public_tokenizers.PATTERN).collect() == []
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    docs = spark.createDataFrame([(held[0], "a b"), (held[1], None)], "doc_id long, text string")
    rows = sorted(L.scored(docs, RANK_FILE, public_tokenizers.PATTERN).collect())
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 9)) for r in rows) == [(1, 0, 0, 0.0), (3, 0, 0, 0.0)]


def test_held_out_texts_are_likelier_than_shuffled_ones(spark):
    """The trained model prefers held-out texts to their own subwords in another order."""
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    texts = L._texts(docs)
    learned = texts.filter("not held_out")
    ranks = spark.sparkContext.broadcast(RANKS)
    counts = L.word_counts(learned)
    model = L.untrained(*L.classes(L.subword_counts(counts, ranks, public_tokenizers.PATTERN, learned.count()), RANKS, public_tokenizers.PATTERN))
    after = L.trained(learned, model, ranks, public_tokenizers.PATTERN)
    held = pa.array([r.text for r in texts.filter("held_out").collect()])
    which, distinct, bounds = L._words(held)
    flat, sizes, _ = L._flat(which, bounds, distinct, L.KnownWords(RANKS, public_tokenizers.PATTERN), after)
    own = L.Scorer(after).scores(flat, sizes)
    assert own.sum() > L.Scorer(model).scores(flat, sizes).sum()
    rng, mixed = np.random.default_rng(2), flat.copy()
    for begin, size in zip(np.append(0, np.cumsum(sizes))[:-1] + 1, sizes, strict=True):
        mixed[begin : begin + size - 1] = rng.permutation(mixed[begin : begin + size - 1])
    assert (own > L.Scorer(after).scores(mixed, sizes))[sizes > 50].mean() > 0.9
