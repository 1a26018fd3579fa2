"""Removal of long repeated passages of words, by fixed-block anchors.

A word goes if a window of `window` words that covers it also starts in a document with a smaller doc_id. Windows are
judged on the input, not on what is left.

Each document's non-overlapping blocks of half a window are the reference: every window holds a whole block of its own
document. They are indexed by hash in buckets, and every rolling run of as many words, in all documents, probes them.
Probes whose anchor (see repeats) stands in one document alone are left out beforehand; they cannot hit. A hit is then
extended by up to half a window to either side: of every window that holds a hit the hash goes, with the chunk's least
doc_id, to the bucket of that hash, where the least doc_id of all documents that hold the window answers. Two documents
that hold a window both send it, as the blocks of either hit the other's probes. Windows are equal if 96 bits of hashes
over their words are.

Words are runs of anything but space and U+0009 to U+000D. Null and empty texts have none; documents shorter than a
window lose nothing. Rows that repeat a doc_id are each judged on their own, and remove nothing from each other. An
empty table gives an empty result; no columns but doc_id and text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vouch.llm import words
from vouch.llm.repeats import Chunk, Exchange, among, anchor_blocks, anchored_windows, dealt, found_windows, least_replies, repeated_hashes, repeated_replies, runs, spread, window_blocks

WINDOW, GRAM = 50, 8
_DDL = "doc_id long, n_words long, n_removed long, kept_sha256 string"


class _Probes:
    """The words of a chunk and its rolling blocks: start, text, hash and the run of blocks with one anchor."""

    def __init__(self, chunk: Chunk, window: int, gram: int):
        self.block, self.window = window // 2, window
        self.starts, self.ends, self.first_word = words.spans(chunk.data, chunk.bounds)
        self.words = words.hashes(chunk.data, self.starts, self.ends)
        grams = words.window_hashes(self.words, gram)
        self.at, self.text, anchor = anchored_windows(grams, self.first_word, self.block, gram)
        self.cut = runs(anchor, self.text)
        self.anchor, self.anchor_text = grams[anchor[self.cut[:-1]]], self.text[self.cut[:-1]]

    def hashes(self) -> np.ndarray:
        return words.window_hashes(self.words, self.block)[self.at]

    def near(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and texts of the windows that hold one of these blocks (a few more next to a text's end)."""
        reach = self.window - self.block
        marked = words.covered(np.maximum(self.at[rows] - reach, 0), reach + 1, len(self.words))
        at, text = words.windows_within(self.first_word, self.window)
        return at[marked[at]], text[marked[at]]


def _say_anchors(window: int, gram: int):
    def say(chunk: Chunk, earlier: dict, n_buckets: int) -> dict[int, bytes]:
        found = _Probes(chunk, window, gram)
        return anchor_blocks(found.anchor, found.anchor_text, n_buckets)

    return say


def _say_probes(window: int, gram: int):
    def say(chunk: Chunk, earlier: dict, n_buckets: int) -> dict[int, bytes]:
        found = _Probes(chunk, window, gram)
        keep = np.repeat(among(found.anchor, repeated_hashes(found.anchor, earlier, n_buckets)), np.diff(found.cut))
        h, text = found.hashes()[keep], found.text[keep]
        aligned = (found.at[keep] - found.first_word[text]) % found.block == 0
        order = np.lexsort((text, h))
        h, text, aligned = h[order], text[order], aligned[order]
        new = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
        last = np.append(new[1:], len(h))[: len(new)] - 1
        flags = np.logical_or.reduceat(aligned, new).astype(np.uint8) + np.uint8(2) * (text[new] != text[last]) if len(new) else np.zeros(0, np.uint8)
        h = h[new]
        order, at = dealt(h, n_buckets)
        return {b: h[order[at[b] : at[b + 1]]].tobytes() + flags[order[at[b] : at[b + 1]]].astype(np.uint8).tobytes() for b in range(n_buckets) if at[b] < at[b + 1]}

    return say


def _reply_hits(blocks: list[pa.Buffer]) -> list[bytes]:
    """The hashes of a block that are a reference block somewhere and stand in two documents or more."""
    sizes = [b.size // 9 for b in blocks]
    h = np.concatenate([np.frombuffer(b, np.uint64, n) for b, n in zip(blocks, sizes, strict=True)])
    flags = np.concatenate([np.frombuffer(b, np.uint8, n, 8 * n) for b, n in zip(blocks, sizes, strict=True)])
    _, which, n = np.unique(h, return_inverse=True, return_counts=True)
    reference = np.zeros(len(n), bool)
    reference[which[(flags & 1) > 0]] = True
    hit = reference[which] & ((n[which] > 1) | (flags > 1))
    return [a[x].tobytes() for a, x in zip(np.split(h, np.cumsum(sizes)[:-1]), np.split(hit, np.cumsum(sizes)[:-1]), strict=True)]


def _say_windows(window: int, gram: int):
    def say(chunk: Chunk, earlier: dict, n_buckets: int) -> dict[int, bytes]:
        found = _Probes(chunk, window, gram)
        hits = np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x, np.uint64) for x in earlier.values())]))
        at, text = found.near(np.flatnonzero(among(found.hashes(), hits)))
        check = words.window_hashes(words.mixed(found.words), window)[at] >> np.uint64(32)
        return window_blocks(words.window_hashes(found.words, window)[at], check, chunk.doc_id[text], n_buckets)

    return say


def _conclude(window: int, gram: int):
    def conclude(chunk: Chunk, answers: dict[int, pa.Buffer]) -> list:
        found = _Probes(chunk, window, gram)
        at, text = words.windows_within(found.first_word, window)
        starts = at[found_windows(list(answers.values()), words.window_hashes(found.words, window)[at], chunk.doc_id[text])]
        kept = ~words.covered(starts, window, len(found.words))
        # kept words with a space after each, then each text without its last space
        size = (found.ends - found.starts)[kept] + 1
        content = np.concatenate([chunk.data, np.zeros(1, np.uint8)])[spread(found.starts[kept], size)]
        ends = np.cumsum(size)
        content[ends - 1] = 0x20
        n_kept = np.append(0, np.cumsum(kept))[found.first_word]
        cut, content = np.append(0, ends)[n_kept], content.tobytes()
        digests = [hashlib.sha256(content[a : max(a, b - 1)]).hexdigest() for a, b in zip(cut[:-1], cut[1:], strict=True)]
        n_words = np.diff(found.first_word)
        return [chunk.ids, n_words, n_words - np.diff(n_kept), digests]

    return conclude


def deduplicated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, **sizes) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 for every row of docs; window is even."""
    exchange = Exchange(docs, **sizes)
    repeated = exchange.answer(exchange.ask(_say_anchors(window, gram)), repeated_replies)
    hits = exchange.answer(exchange.ask(_say_probes(window, gram), repeated), _reply_hits)
    least = exchange.answer(exchange.ask(_say_windows(window, gram), hits), least_replies)
    return exchange.finish(_conclude(window, gram), _DDL, least)


#: The rows of deduplicated() in DuckDB, over the table documents: hits are window starts, spans their unions.
ORACLE_SQL = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
starts AS (
    SELECT doc_id, unnest(range(1, len(words) - 48)) AS pos,
        unnest(list_transform(range(1, len(words) - 48), lambda i: md5(array_to_string(words[i : i + 49], ' ')))) AS content
    FROM docs
),
judged AS (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY content) AS least FROM starts),
hits AS (SELECT doc_id, pos, pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS step FROM judged WHERE least < doc_id),
runs AS (SELECT doc_id, pos, sum(CASE WHEN step <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM hits),
spans AS (SELECT doc_id, min(pos) AS a, max(pos) + 49 AS b FROM runs GROUP BY doc_id, run),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
cut AS (
    SELECT doc_id, sum(b - a + 1) AS n_removed, max(b) AS last,
        flatten(list(CASE WHEN a > before + 1 THEN words[before + 1 : a - 1] ELSE [] END ORDER BY a)) AS head
    FROM gaps JOIN docs USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
    sha256(coalesce(array_to_string(list_concat(coalesce(head, []), words[coalesce(last, 0) + 1 :]), ' '), '')) AS kept_sha256
FROM docs LEFT JOIN cut USING (doc_id)
"""
