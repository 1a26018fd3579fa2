"""Periodic runs against plain searches."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from vouch.llm import periodic_runs as P

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(seq, least, times):
    """Every stretch with smallest period q that cannot grow, found by trying all periods."""
    out, n = {}, len(seq)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if seq[i] != seq[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and seq[j] == seq[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, times * q):
                smaller = any(all(seq[k] == seq[k + r] for k in range(i, i + length - r)) for r in range(1, q))
                if not smaller:
                    out[i, q] = length
            i = j + 1
    return sorted((s, length, q) for (s, q), length in out.items())


def plain_row(doc_id, text, loop=True):
    ws = WORD.findall(text or "")
    n, h = len(ws), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if loop and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ws = [w if i < a else ws[a + (i - a) % p] for i, w in enumerate(ws)]
    runs = plain_runs(ws, 24, 3)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    kept = " ".join(w for i, w in enumerate(ws) if i not in drop)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in sorted(runs, key=lambda r: (r[0], r[2])))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4), sha(lines), sha(kept))


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(1)
    for size, letters in ((1, 1), (2, 1), (40, 1), (60, 2), (80, 3), (200, 5)):
        s = rng.integers(0, letters, size)
        sa, isa, lcp = P.suffix_array(s)
        own = sorted(range(size), key=lambda i: s[i:].tolist())
        assert sa.tolist() == own
        assert isa[sa].tolist() == list(range(size))
        for k in range(1, size):
            a, b = s[own[k - 1] :].tolist(), s[own[k] :].tolist()
            assert lcp[k] == next((j for j, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("least,times", [(2, 2), (24, 3), (6, 3)])
def test_runs_of_random_texts(least, times):
    rng = random.Random(least * times)
    for trial in range(150):
        texts = []
        for _ in range(rng.randint(1, 4)):
            seq = []
            while len(seq) < rng.randint(0, 70):
                block = [rng.randint(0, rng.choice((1, 2, 9))) for _ in range(rng.randint(1, 9))]
                seq += block * rng.randint(1, 6)
            texts.append(seq)
        bounds = np.append(0, np.cumsum([len(t) for t in texts]))
        symbols = np.array([t * 100 + x for t, seq in enumerate(texts) for x in seq], np.int64)
        found = P.find_runs(symbols, bounds, least, times)
        assert [tuple(r) for r in found.tolist()] == [(t, s, n, q) for t, seq in enumerate(texts) for s, n, q in plain_runs(seq, least, times)], (trial, texts)


def test_small_test_blocks(monkeypatch):
    monkeypatch.setattr(P, "TEST_BLOCK", 3)
    seq = [0, 1, 0, 1, 0, 1, 2, 2, 2, 2, 0, 1, 0, 1, 0, 1]
    assert [tuple(r[1:]) for r in P.find_runs(np.array(seq), np.array([0, len(seq)]), 4, 2).tolist()] == plain_runs(seq, 4, 2)


def test_one_word_repeated_in_a_long_text():
    found = P.find_runs(np.zeros(30_000, np.int64), np.array([0, 30_000]))
    assert found.tolist() == [[0, 0, 30_000, 1]]


def test_query_on_odd_rows(spark):
    rng = random.Random(5)
    texts = [None, "", " \n\t", "a", "a " * 40, "x y " * 30 + "z", "é ß " * 20, "a\x0bb\x0cc\rd " * 12, "a\xa0b " * 30, "b " * 30 + "c " * 30, " ".join(["p q r s"] * 6 + ["p q r"]), " ".join(["p q r s"] * 5 + ["p"])]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 160))) for _ in range(60)]
    rows = [(i, t, 7, "n") for i, t in enumerate(texts)] + [(4, texts[4], 1, None), (None, "u " * 30, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int, n string").repartition(3)
    found = P.digests(P.with_runs(P.looped_tails(docs)))
    key = lambda r: tuple((x is not None, x) for x in r)
    expected = [plain_row(i, t, i is not None) for i, t, *_ in rows]
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted(expected, key=key)
    assert found.filter("n_runs > 0").count() > 5


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert P.digests(P.with_runs(P.looped_tails(docs))).collect() == []


def test_collapsed_text(spark):
    docs = spark.createDataFrame([(1, "x  " + "a b\n" * 12 + " c")], "doc_id long, text string")
    row = P.with_runs(docs).first()
    assert row.collapsed == "x a b c" and row.runs[0].asDict() == {"start": 1, "length": 24, "period": 2} and row.n_words == 26
