"""Quality rules by distribution divergence.

A document fails the base rules with too few words or too many words in repeated 3-word windows. The others are held
against their language's reference: the Jensen-Shannon distance between the histograms of character classes, and
between those of common words. A distance counts only for documents of a minimum length; shorter ones have no verdict
against them.

References are sums over all documents of a language (null: the language ''): counts of character classes, and of
words of up to 8 bytes, of which the `n_common` most frequent, ties by the word's bytes, are the common words; all other
words are one further class. Words are lower-cased in A-Z for this. Null and empty texts have no words, and so fail.
Rows that repeat a doc_id are judged each on their own; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vouch.llm import words
from vouch.llm.common import arrow_schema, slices, text_bytes, written

N_COMMON, MIN_CHARS, MIN_WORDS = 48, 200, 120
#: Well-written documents stay below 0.28 and 0.33 on the labelled sample at small scale, bulk junk lies above 0.34 and 0.4.
CLASS_DISTANCE, WORD_DISTANCE = 0.31, 0.4
#: References are broadcast up to so many languages, and joined beyond.
BROADCAST_LANGUAGES = 4096

_CLASSES = ("lower", "upper", "digit", "space", "line end", "stop", "mark", "symbol", "letter beyond ASCII", "other")
_CLASS = np.full(256, 9, np.uint8)
_CLASS[0x61:0x7B] = 0
_CLASS[0x41:0x5B] = 1
_CLASS[0x30:0x3A] = 2
_CLASS[[0x20, 0x09]] = 3
_CLASS[[0x0A, 0x0B, 0x0C, 0x0D]] = 4
_CLASS[[ord(c) for c in ".,"]] = 5
_CLASS[[ord(c) for c in ";:!?'\"()-"]] = 6
_CLASS[[ord(c) for c in "#*$%&|<>@+=/\\_{}[]~^`"]] = 7
_CLASS[0xC3:0xE0] = 8
#: Bytes within a character count in no class.
_CLASS[0x80:0xC0] = len(_CLASSES)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

_COUNT_DDL = "lang string, kind int, key long, n long"
_OUT_DDL = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double"


def _class_counts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Characters of each class, a row for each text."""
    n, size = len(bounds) - 1, len(_CLASSES) + 1
    text = np.repeat(np.arange(n) * size, np.diff(bounds))
    return np.bincount(text + _CLASS[data], minlength=n * size).reshape(n, size)[:, :-1]


def _short_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which words have up to 8 bytes, and those bytes, A-Z lowered, as one integer."""
    short = ends - starts <= 8
    padded = np.concatenate([_LOWER[data], np.zeros(8, np.uint8)])
    at, size = starts[short], (ends - starts)[short]
    eight = np.lib.stride_tricks.as_strided(padded.view(), (len(padded) - 7, 8), (1, 1))[at].copy().view("<u8").ravel()
    return short, eight & (np.uint64(0xFFFFFFFFFFFFFFFF) >> ((8 - size) * 8).astype(np.uint64))


def _language_counts():
    schema = arrow_schema(_COUNT_DDL)

    def run(batches):
        for batch in batches:
            sums: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
            for part in slices(batch):
                data, bounds = text_bytes(part.column(1))
                languages, which = np.unique(np.array(part.column(0).to_pylist(), object).astype(str), return_inverse=True)
                starts, ends, first_word = words.spans(data, bounds)
                short, key = _short_words(data, starts, ends)
                lang_of_word = np.repeat(which, np.diff(first_word))
                classes = _class_counts(data, bounds)
                for i, lang in enumerate(languages):
                    here = lang_of_word == i
                    # all words of the language count as key 0 of kind 1; no word is the integer 0 unless it is NUL alone
                    found, n = np.unique(key[here[short]], return_counts=True)
                    per_class = classes[which == i].sum(axis=0)
                    sums.setdefault(lang, []).append((np.concatenate([np.zeros(len(per_class)), np.full(1, 1), np.full(len(found), 2)]), np.concatenate([np.arange(len(per_class), dtype=np.int64), [0], found.view(np.int64)]), np.concatenate([per_class, [here.sum()], n])))
            for lang, parts in sums.items():
                kind, key, n = (np.concatenate(x) for x in zip(*parts, strict=True))
                order = np.lexsort((key, kind))
                kind, key, n = kind[order], key[order], n[order]
                new = np.flatnonzero(np.append(True, (kind[1:] != kind[:-1]) | (key[1:] != key[:-1])))
                yield pa.record_batch([pa.array([lang] * len(new)), pa.array(kind[new].astype(np.int32)), pa.array(key[new]), pa.array(np.add.reduceat(n, new).astype(np.int64))], schema=schema)

    return run


def references(docs: DataFrame, n_common: int = N_COMMON) -> DataFrame:
    """A row for each language: its class counts, its number of words, its common words and their counts."""
    texts = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    counts = texts.mapInArrow(_language_counts(), _COUNT_DDL).groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "key")))
    kept = ranked.filter((F.col("rank") <= max(n_common, len(_CLASSES))) & ((F.col("kind") < 2) | (F.col("rank") <= n_common)))
    listed = lambda kind: F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("key", "n"))))
    return kept.groupBy("lang").agg(listed(0).alias("classes"), F.max(F.when(F.col("kind") == 1, F.col("n"))).alias("words"), listed(2).alias("common")).select(
        "lang", F.col("classes.n").alias("ref_classes"), F.col("words").alias("ref_words"), F.col("common.key").alias("ref_keys"), F.col("common.n").alias("ref_counts")
    )


def distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (root of the divergence in bits) of each row of counts from the reference; 0 for empty rows."""
    total = counts.sum(axis=1, keepdims=True)
    p = counts / np.maximum(total, 1)
    q = np.broadcast_to(reference / max(reference.sum(), 1), p.shape)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        divergence = (np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)).sum(axis=1) / 2
    return np.where(total[:, 0] > 0, np.sqrt(np.maximum(divergence, 0)), 0.0)


def repeated_window_words(hashes: np.ndarray, first_word: np.ndarray, size: int = 3) -> np.ndarray:
    """For each text, its words in windows of `size` words that the text has twice or more."""
    at, text = words.windows_within(first_word, size)
    if not len(at):
        return np.zeros(len(first_word) - 1, np.int64)
    h = words.window_hashes(hashes, size)[at]
    order = np.lexsort((h, text))
    same = (h[order][1:] == h[order][:-1]) & (text[order][1:] == text[order][:-1])
    repeated = np.zeros(len(at), bool)
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    inside = words.covered(at[repeated], size, len(hashes))
    return np.diff(np.append(0, np.cumsum(inside))[first_word])


def _duplicate_lines(text: str) -> int:
    lines = [line for line in text.split("\n") if line.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def judged(docs: DataFrame, n_common: int = N_COMMON, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS, class_distance: float = CLASS_DISTANCE, word_distance: float = WORD_DISTANCE) -> DataFrame:
    """doc_id, the base counts, base_failed, the two distances and kept."""
    refs = written(references(docs, n_common), "references")
    few = refs.limit(BROADCAST_LANGUAGES + 1).count() <= BROADCAST_LANGUAGES
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("lang"))
    schema = arrow_schema(_OUT_DDL)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                data, bounds = text_bytes(part.column(1))
                starts, ends, first_word = words.spans(data, bounds)
                n_words = np.diff(first_word)
                h = words.hashes(data, starts, ends)
                leading = np.append(0, np.cumsum((data & 0xC0) != 0x80))
                word_chars = np.append(0, np.cumsum(leading[ends] - leading[starts]))
                symbols = np.append(0, np.cumsum(_SYMBOL[data]))
                repeat = repeated_window_words(h, first_word)
                classes = _class_counts(data, bounds)
                short, key = _short_words(data, starts, ends)
                text_of_word = np.repeat(np.arange(len(part)), n_words)
                by_class, by_word = np.zeros(len(part)), np.zeros(len(part))
                languages, which = np.unique(np.array(part.column(2).to_pylist(), object).astype(str), return_inverse=True)
                for i in range(len(languages)):
                    rows = np.flatnonzero(which == i)
                    ref_classes, ref_words, ref_keys, ref_counts = (part.column(k)[int(rows[0])].as_py() for k in range(3, 7))
                    by_class[rows] = distance(classes[rows], np.array(ref_classes, float))
                    ref_keys, ref_counts = np.array(ref_keys, np.int64).view(np.uint64), np.array(ref_counts, float)
                    order = np.argsort(ref_keys)
                    ref_keys, ref_counts = ref_keys[order], ref_counts[order]
                    # words of the language's texts: a column for each common word, the last for all others
                    here = which[text_of_word] == i
                    column = np.full(len(here), len(ref_keys))
                    if len(ref_keys):
                        at = np.minimum(np.searchsorted(ref_keys, key), len(ref_keys) - 1)
                        column[short] = np.where(ref_keys[at] == key, at, len(ref_keys))
                    place = np.zeros(len(part), np.int64)
                    place[rows] = np.arange(len(rows))
                    size = len(ref_keys) + 1
                    counts = np.bincount(place[text_of_word[here]] * size + column[here], minlength=len(rows) * size).reshape(len(rows), size)
                    by_word[rows] = distance(counts, np.append(ref_counts, ref_words - ref_counts.sum()))
                failed = (n_words < 50) | (100 * repeat > 50 * n_words)
                by_class = np.where(classes.sum(axis=1) >= min_chars, by_class, 0.0)
                by_word = np.where(n_words >= min_words, by_word, 0.0)
                kept = ~failed & (by_class <= class_distance) & (by_word <= word_distance)
                dup = [_duplicate_lines(t) for t in part.column(1).to_pylist()]
                columns = [n_words, np.diff(word_chars[first_word]), np.diff(symbols[bounds]), dup, repeat, failed, kept, by_class, by_word]
                yield pa.record_batch([part.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True))], schema=schema)

    return texts.join(F.broadcast(refs) if few else refs, "lang").select("doc_id", "text", "lang", "ref_classes", "ref_words", "ref_keys", "ref_counts").mapInArrow(run, _OUT_DDL)
