"""Removal of long repeated byte strings, by suffix arrays.

A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller doc_id. Strings are
judged on the input, not on what is left.

Every window of `length` bytes has an anchor (see repeats). Windows whose anchor stands in one document alone cannot
repeat and are left out. The others go, as contexts (runs of windows with one anchor), to the anchor's bucket, so equal
windows meet in one bucket. A bucket is a shard: its distinct contexts are laid end to end, their suffix array is built
by induced sorting, the permuted common prefixes cut it into groups of equal windows, and each group's least doc_id
answers for all of them.

An anchor around which chunks have more distinct contexts than a part of a bucket holds is hot: one near the end of a
passage that many documents share, say, as windows there reach into each document's own bytes. The windows of a hot
anchor are dealt by their own hash instead (96 bits of hashes decide that two are equal), so they spread over buckets.

Null and empty texts have no bytes; documents shorter than `length` lose nothing. Rows that repeat a doc_id are each
judged on their own, and remove nothing from each other. An empty table gives an empty result; no columns but doc_id
and text are read.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vouch.llm import words
from vouch.llm.repeats import Chunk, Exchange, among, anchor_blocks, anchored_windows, answer_rows, dealt, found_windows, least_replies, packed_extent, removed_windows, repeated_hashes, repeated_replies, runs, spread, unpacked_extent, window_blocks
from vouch.llm.suffix_array import permuted_common_prefixes, suffix_array

LENGTH, GRAM = 50, 16
#: An anchor is hot if it has more contexts than a bucket has units of so many bytes; a context is 50 to 84 bytes and some more.
HOT_BYTES = 512
_DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


class _Contexts:
    """The runs of windows with one anchor in a chunk: first window, number of windows, text, anchor hash and own hash.

    Texts are taken some at a time, so that the arrays over their bytes stay in the processor's cache.
    """

    def __init__(self, chunk: Chunk, length: int, gram: int, part_bytes: int = 1 << 18):
        parts, i, bounds = [], 0, chunk.bounds
        while i < len(bounds) - 1:
            j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + part_bytes, side="right")) - 1)
            parts.append(self._part(chunk.data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], length, gram, bounds[i], i))
            i = j
        parts = parts or [self._part(chunk.data, bounds, length, gram, 0, 0)]
        self.start, self.count, self.text, self.anchor, self.key = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.size = self.count + length - 1

    @staticmethod
    def _part(data: np.ndarray, bounds: np.ndarray, length: int, gram: int, first_byte: int, first_text: int) -> tuple[np.ndarray, ...]:
        at = np.arange(max(len(data) - gram + 1, 0))
        sums = words.prefix_sums(words.byte_values(data))
        grams = words.range_hashes(sums, at, at + gram)
        at, text, anchor = anchored_windows(grams, bounds, length, gram)
        cut = runs(anchor, text)
        first = cut[:-1]
        start, count = at[first], np.diff(cut)
        return start + first_byte, count, text[first] + first_text, grams[anchor[first]], words.range_hashes(sums, start, start + count + length - 1)


def _say_anchors(length: int, gram: int):
    def say(chunk: Chunk, earlier: dict, n_buckets: int) -> dict[int, bytes]:
        found = _Contexts(chunk, length, gram)
        return anchor_blocks(found.anchor, found.text, n_buckets, found.key)

    return say


def _say_contexts(length: int, gram: int):
    def say(chunk: Chunk, earlier: dict, n_buckets: int) -> dict[int, bytes]:
        found = _Contexts(chunk, length, gram)
        repeated, hot = (among(found.anchor, repeated_hashes(found.anchor, earlier, n_buckets, part)) for part in (0, 1))
        keep = np.flatnonzero(repeated & ~hot)
        key, doc = found.key[keep], chunk.doc_id[found.text[keep]]
        order = np.lexsort((doc, key))
        key, doc, keep = key[order], doc[order], keep[order]
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        last = np.append(new[1:], len(key))[: len(new)] - 1
        least, most, keep = doc[new], doc[last], keep[new]
        order, at = dealt(found.anchor[keep], n_buckets)
        out = {}
        for b in range(n_buckets):
            rows = order[at[b] : at[b + 1]]
            if len(rows):
                of = keep[rows]
                content = chunk.data[spread(found.start[of], found.size[of])]
                out[b] = _packed(found.count[of], least[rows], most[rows], content)
        split = np.flatnonzero(repeated & hot)
        if len(split):
            at, doc = spread(found.start[split], found.count[split]), np.repeat(chunk.doc_id[found.text[split]], found.count[split])
            values = words.byte_values(chunk.data)
            key = words.range_hashes(words.prefix_sums(values), at, at + length)
            check = words.range_hashes(words.prefix_sums(words.mixed(values)), at, at + length) >> np.uint64(32)
            out |= {n_buckets + b: x for b, x in window_blocks(key, check, doc, n_buckets).items()}
        return out

    return say


def _packed(count: np.ndarray, least: np.ndarray, most: np.ndarray, content: np.ndarray) -> bytes:
    """A block of contexts."""
    return b"".join([np.uint32(len(count)).tobytes(), count.astype(np.uint8).tobytes(), *packed_extent(least, most), content.tobytes()])


def _unpacked(block: pa.Buffer) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(block, np.uint32, 1)[0])
    least, most, at = unpacked_extent(block, n, 4 + n)
    return least, most, np.frombuffer(block, np.uint8, n, 4).astype(np.int64), np.frombuffer(block, np.uint8, offset=at)


def _reply(length: int):
    def reply(blocks: list[pa.Buffer]) -> list[bytes]:
        parts = [_unpacked(b) for b in blocks]
        least, _, count, content = (np.concatenate(x) for x in zip(*parts, strict=True))
        size = count + length - 1
        place = np.cumsum(size) - size
        key = words.range_hashes(words.prefix_sums(words.byte_values(content)), place, place + size)
        # distinct contexts, each with the least document that holds it
        distinct, first, which = np.unique(key, return_index=True, return_inverse=True)
        by_context = np.full(len(distinct), np.iinfo(np.int64).max)
        np.minimum.at(by_context, which, least)
        count, size, place = count[first], size[first], place[first]
        # end to end, with a separator after each; no byte of UTF-8 is 0xFF, so there is room for it
        at = np.cumsum(size + 1) - (size + 1)
        text = np.zeros(int((size + 1).sum()), np.uint8)
        text[spread(at, size)] = content[spread(place, size)] + np.uint8(1)
        array = suffix_array(text)
        window = np.full(len(text), -1, np.int64)
        window_at = np.append(0, np.cumsum(count))
        window[spread(at, count)] = np.arange(window_at[-1])
        # what two windows share is the least prefix between them in the array, where suffixes of other places may stand
        places = np.flatnonzero(window[array] >= 0)
        ordered, common = array[places], permuted_common_prefixes(text, array)[array]
        shared = np.minimum.reduceat(common[: places[-1] + 1], places[:-1] + 1) if len(places) > 1 else common[:0]
        group = np.flatnonzero(np.append(True, shared < length)[: len(ordered)])
        document = np.repeat(by_context, count)[window[ordered]]
        least_of = np.empty(window_at[-1], np.int64)
        if len(group):
            least_of[window[ordered]] = np.repeat(np.minimum.reduceat(document, group), np.diff(np.append(group, len(ordered))))
        out, row = [], 0
        for _, most, counts, _ in parts:
            keys, of = key[row : row + len(counts)], which[row : row + len(counts)]
            row += len(counts)
            out.append(answer_rows(keys, np.append(0, np.cumsum(counts)), least_of[spread(window_at[of], counts)], most).tobytes())
        return out

    return reply


def _conclude(length: int, gram: int, n_buckets: int):
    def conclude(chunk: Chunk, answers: dict[int, pa.Buffer]) -> list:
        found = _Contexts(chunk, length, gram)
        starts = removed_windows({b: x for b, x in answers.items() if b < n_buckets}, found.key, found.start, chunk.doc_id[found.text])
        if split := [x for b, x in answers.items() if b >= n_buckets and len(x)]:
            at, text = words.windows_within(chunk.bounds, length)
            key = words.range_hashes(words.prefix_sums(words.byte_values(chunk.data)), at, at + length)
            starts = np.append(starts, at[found_windows(split, key, chunk.doc_id[text])])
        gone = words.covered(starts, length, len(chunk.data))
        before = np.append(0, np.cumsum(gone))
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        edges = chunk.bounds[:-1][chunk.bounds[:-1] < chunk.bounds[1:]]
        begins[edges] = gone[edges]
        spans = np.append(0, np.cumsum(begins))
        kept, left = chunk.data[~gone].tobytes(), chunk.bounds - before[chunk.bounds]
        digests = [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(left[:-1], left[1:], strict=True)]
        return [chunk.ids, np.diff(chunk.bounds), np.diff(before[chunk.bounds]), np.diff(spans[chunk.bounds]), digests]

    return conclude


def deduplicated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, **sizes) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for every row of docs."""
    exchange = Exchange(docs, **sizes)
    marks = partial(repeated_replies, most=exchange.bucket_bytes // HOT_BYTES)
    repeated = exchange.answer(exchange.ask(_say_anchors(length, gram)), marks)
    least = exchange.answer(exchange.ask(_say_contexts(length, gram), repeated), _reply(length), least_replies)
    return exchange.finish(_conclude(length, gram, exchange.n_buckets), _DDL, least)
