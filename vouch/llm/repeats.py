"""Common ground of the two operators that remove long exact repeats: anchors, chunks of documents, and exchanges.

Anchors. Of every window of some length the least hash of its short grams is the window's anchor. It depends on the
window's content alone, so equal windows have equal anchors; about one position in nine to eighteen is an anchor.

Chunks. Documents are dealt to chunks of about `chunk_bytes` by the hash of their doc_id. A chunk sends what it has to
say about an anchor (or another hash) to the bucket that the hash belongs to, a block of bytes for each bucket, and gets
an answer block back. A chunk sends each distinct value once, whatever the number of its documents that hold it. All
steps read the same exchange of documents by chunk; each sorts a chunk's rows, so all see them in the same order.

Windows by their own hash. What surrounds a shared passage differs from document to document, so whatever is dealt by a
part of the passage and carries its surroundings gathers all holders in one bucket. Windows dealt by the hash of the
whole window do not: equal windows meet, one entry for each chunk, and different ones spread over all buckets.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vouch.llm import words
from vouch.llm.common import arrow_schema, text_bytes, whole_texts

CHUNK_BYTES, BUCKET_BYTES = 2 << 20, 6 << 20
_BLOCK_DDL = "bucket int, chunk int, content binary"
_ORDER_BITS = np.uint64(28)


def sliding(values: np.ndarray, size: int, least: Callable) -> np.ndarray:
    """least (or most) of each run of `size` values, by doubling."""
    have = 1
    while have * 2 <= size:
        values = least(values[:-have], values[have:])
        have *= 2
    return least(values[: len(values) - (size - have)], values[size - have :]) if size > have else values


def anchored_windows(item_hashes: np.ndarray, bounds: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows within texts, the text of each, and the position of its anchor gram.

    item_hashes: the hash of the gram that starts at each position (grams that cross the end of a text are not used).
    """
    at, text = words.windows_within(bounds, window)
    width = window - gram + 1
    if not len(at):
        return at, text, at
    # an anchor is less than a window from its start, so the low bits of its place tell where it is, in texts of any length
    mask = (1 << int(_ORDER_BITS)) - 1
    ordered = (item_hashes >> _ORDER_BITS << _ORDER_BITS) | (np.arange(len(item_hashes), dtype=np.uint64) & np.uint64(mask))
    low = sliding(ordered, width, np.minimum)[at].astype(np.int64)
    return at, text, at + ((low - at) & mask)


def runs(anchor: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Where a run of windows of one text with one anchor begins; one more at the end."""
    if not len(anchor):
        return np.zeros(1, np.int64)
    new = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    return np.concatenate([[0], np.flatnonzero(new) + 1, [len(anchor)]])


class Chunk:
    """Documents of a chunk in the order of doc_id (then text)."""

    def __init__(self, table: pa.Table):
        table = table.select(["doc_id", "text"]).combine_chunks()
        table = table.take(pc.sort_indices(table, [("doc_id", "ascending"), ("text", "ascending")]))
        text = table.column("text").cast(pa.large_string()).combine_chunks()
        text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
        self.data, self.bounds = text_bytes(text)
        # a missing doc_id is taken as the largest
        self.doc_id = table.column("doc_id").fill_null(np.iinfo(np.int64).max).to_numpy()
        self.ids = table.column("doc_id")


class Exchange:
    """docs by chunk, and the exchanges of blocks between chunks and buckets."""

    def __init__(self, docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES):
        texts = whole_texts(docs)
        size = texts.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first().n or 0
        self.n_chunks, self.n_buckets = 1 + size // chunk_bytes, 1 + size // bucket_bytes
        self.bucket_bytes = bucket_bytes
        self.docs = texts.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(self.n_chunks)).cast("int"))

    def ask(self, say: Callable, answers: DataFrame | None = None) -> DataFrame:
        """say(chunk, earlier answers by bucket) gives (bucket hashes, parts): see blocks()."""
        schema, n = arrow_schema(_BLOCK_DDL), self.n_buckets

        def blocks(key: int, table: pa.Table, earlier: pa.Table | None) -> pa.Table:
            found = say(Chunk(table), _by_bucket(earlier), n)
            return pa.table([pa.array(list(found), pa.int32()), pa.array([key] * len(found), pa.int32()), pa.array(list(found.values()), pa.binary())], schema=schema)

        return self._over_chunks(blocks, _BLOCK_DDL, answers)

    def answer(self, blocks: DataFrame, reply: Callable, beyond: Callable | None = None) -> DataFrame:
        """reply(list of blocks of one bucket) gives an answer block for each; beyond: the same for buckets from n_buckets on."""
        schema, n = arrow_schema(_BLOCK_DDL), self.n_buckets

        def answered(table: pa.Table) -> pa.Table:
            table = table.combine_chunks()
            table = table.take(pc.sort_indices(table, [("chunk", "ascending")]))
            of_bucket = reply if table.column("bucket")[0].as_py() < n else beyond
            replies = of_bucket([x.as_buffer() for x in table.column("content")])
            return pa.table([table.column("bucket"), table.column("chunk"), pa.array(replies, pa.binary())], schema=schema)

        return blocks.groupBy("bucket").applyInArrow(answered, _BLOCK_DDL)

    def finish(self, conclude: Callable, ddl: str, answers: DataFrame) -> DataFrame:
        """conclude(chunk, answers by bucket) gives the columns of the result."""
        schema = arrow_schema(ddl)

        def rows(key: int, table: pa.Table, earlier: pa.Table | None) -> pa.Table:
            columns = conclude(Chunk(table), _by_bucket(earlier))
            return pa.table([c if isinstance(c, pa.ChunkedArray) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        return self._over_chunks(rows, ddl, answers)

    def _over_chunks(self, of_chunk: Callable, ddl: str, answers: DataFrame | None) -> DataFrame:
        empty = arrow_schema(ddl).empty_table()
        by_chunk = self.docs.groupBy("chunk")
        if answers is None:

            def alone(key: tuple, table: pa.Table) -> pa.Table:
                return of_chunk(key[0].as_py(), table, None)

            return by_chunk.applyInArrow(alone, ddl)

        def both(key: tuple, table: pa.Table, earlier: pa.Table) -> pa.Table:
            return of_chunk(key[0].as_py(), table, earlier) if len(table) else empty

        return by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(both, ddl)


def _by_bucket(earlier: pa.Table | None) -> dict[int, pa.Buffer]:
    if earlier is None:
        return {}
    return {b.as_py(): content.as_buffer() for b, content in zip(earlier.column("bucket"), earlier.column("content"), strict=True)}


def dealt(hashes: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that puts hashes into buckets, in their own order within each, and where each bucket's begin."""
    bucket = (hashes % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n_buckets + 1))


# --- which anchors stand in two documents or more -----------------------------------------------------------------


def anchor_blocks(anchors: np.ndarray, text: np.ndarray, n_buckets: int, content: np.ndarray | None = None) -> dict[int, bytes]:
    """Distinct anchor hashes (six bytes each: a clash there costs a candidate, no result), and whether two documents of the chunk hold them.

    content: hashes of what is around each anchor; then the number of distinct ones goes with each anchor that has several.
    """
    order = np.lexsort((text, anchors))
    h, t = anchors[order], text[order]
    new = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    last = np.append(new[1:], len(h)) - 1 if len(new) else new
    many = t[new] != t[last]
    h = h[new]
    n_content = np.ones(len(h), np.int64)
    if content is not None and len(h):
        n_content = np.bincount(np.searchsorted(h, anchors[np.unique(content, return_index=True)[1]]), minlength=len(h))
    order, at = dealt(h, n_buckets)
    n_content = np.minimum(n_content[order], 0xFFFF)
    six = (h[order] >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6]
    many = many[order]

    def counts(x: slice) -> bytes:
        several = n_content[x] > 1
        return b"" if content is None else np.packbits(several).tobytes() + n_content[x][several].astype("<u2").tobytes()

    return {b: np.uint32(n).tobytes() + six[x].tobytes() + np.packbits(many[x]).tobytes() + counts(x) for b in range(n_buckets) if (n := at[b + 1] - at[b]) and (x := slice(at[b], at[b + 1]))}


def _n_content(block: pa.Buffer, n: int) -> np.ndarray:
    at = 4 + 6 * n + -(-n // 8)
    several = np.unpackbits(np.frombuffer(block, np.uint8, -(-n // 8), at), count=n).astype(bool)
    out = np.ones(n, np.int64)
    out[several] = np.frombuffer(bytes(block)[at + -(-n // 8) :], "<u2")
    return out


def repeated_replies(blocks: list[pa.Buffer], most: int | None = None) -> list[bytes]:
    """For each hash of each block, whether two documents of the corpus hold it; with `most`, then also whether more than
    that many contents, added up over chunks, are around it."""
    sizes = [int(np.frombuffer(b, np.uint32, 1)[0]) for b in blocks]
    six = np.concatenate([np.frombuffer(b, np.uint8, 6 * n, 4).reshape(n, 6) for b, n in zip(blocks, sizes, strict=True)])
    h = np.pad(six, ((0, 0), (0, 2))).view("<u8").ravel()
    many = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8, offset=4 + 6 * n), count=n).astype(bool) for b, n in zip(blocks, sizes, strict=True)])
    _, at, n = np.unique(h, return_inverse=True, return_counts=True)
    cuts = np.cumsum(sizes)[:-1]
    replies = [np.packbits(x).tobytes() for x in np.split((n[at] > 1) | many, cuts)]
    if most is None:
        return replies
    n_content = np.concatenate([_n_content(b, n) for b, n in zip(blocks, sizes, strict=True)])
    hot = np.bincount(at, weights=n_content)[at] > most
    return [a + np.packbits(x).tobytes() for a, x in zip(replies, np.split(hot, cuts), strict=True)]


def repeated_hashes(anchors: np.ndarray, answers: dict[int, pa.Buffer], n_buckets: int, part: int = 0) -> np.ndarray:
    """Of the chunk's distinct anchor hashes, sorted, those that the buckets call repeated (part 1: those with too many contents)."""
    h = np.unique(anchors)
    order, at = dealt(h, n_buckets)
    found = [h[order[at[b] : at[b + 1]]][np.unpackbits(np.frombuffer(content, np.uint8, offset=part * -(-int(at[b + 1] - at[b]) // 8)), count=at[b + 1] - at[b]).astype(bool)] for b, content in answers.items()]
    return np.sort(np.concatenate([np.zeros(0, np.uint64), *found]))


def among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


# --- the least document that holds each window of a context --------------------------------------------------------


def run_replies(context_of: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of equal least documents along each context's windows: start of each run among all windows, length, least document."""
    if not len(least):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), least
    start = np.flatnonzero(np.append(True, (least[1:] != least[:-1]) | (context_of[1:] != context_of[:-1])))
    return start, np.diff(np.append(start, len(least))), least[start]


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, as many as its count."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)


ANSWER = np.dtype([("context", "<u8"), ("run", "u1"), ("length", "u1"), ("least", "<i8")])


def answer_rows(keys: np.ndarray, window_at: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Rows of ANSWER for those contexts whose windows can be removed in some document of the chunk.

    window_at: where each context's windows begin among all (one more at the end); most: the largest document of the
    chunk that holds the context.
    """
    counts = np.diff(window_at)
    context_of = np.repeat(np.arange(len(keys)), counts)
    start, length, value = run_replies(context_of, least)
    of = context_of[start] if len(start) else start
    keep = value < most[of]
    out = np.zeros(int(keep.sum()), ANSWER)
    out["context"], out["run"], out["length"], out["least"] = keys[of[keep]], (start - window_at[of])[keep], length[keep], value[keep]
    return out


def removed_windows(answers: dict[int, pa.Buffer], keys: np.ndarray, first_window: np.ndarray, doc_of: np.ndarray) -> np.ndarray:
    """Starts of the windows to remove, from the answers and the chunk's contexts (key, first window, document of each)."""
    rows = np.concatenate([np.zeros(0, ANSWER), *(np.frombuffer(a, ANSWER) for a in answers.values())])
    rows = rows[np.argsort(rows["context"], kind="stable")]
    low, high = np.searchsorted(rows["context"], keys, "left"), np.searchsorted(rows["context"], keys, "right")
    occurrence = np.repeat(np.arange(len(keys)), high - low)
    row = rows[spread(low, high - low)]
    keep = row["least"] < doc_of[occurrence]
    row, occurrence = row[keep], occurrence[keep]
    return spread(first_window[occurrence] + row["run"].astype(np.int64), row["length"].astype(np.int64))


# --- the least document that holds each window, by the window's own hash --------------------------------------------

LEAST = np.dtype([("key", "<u8"), ("least", "<i8")])


def packed_extent(least: np.ndarray, most: np.ndarray) -> list[bytes]:
    """Least doc_ids by planes of bytes (most are zero), and the largest only where it differs."""
    differ = least != most
    planes = least.astype("<i8").view(np.uint8).reshape(-1, 8).T
    return [np.packbits(differ).tobytes(), planes.tobytes(), most[differ].astype("<i8").tobytes()]


def unpacked_extent(block: pa.Buffer, n: int, at: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Least and largest doc_ids of n values, from `at` on, and where they end."""
    differ = np.unpackbits(np.frombuffer(block, np.uint8, -(-n // 8), at), count=n).astype(bool)
    at += -(-n // 8)
    least = np.frombuffer(block, np.uint8, 8 * n, at).reshape(8, n).T.copy().view("<i8").ravel()
    most, at = least.copy(), at + 8 * n
    most[differ] = np.frombuffer(block[at : at + 8 * int(differ.sum())], "<i8")
    return least, most, at + 8 * int(differ.sum())


def window_blocks(key: np.ndarray, check: np.ndarray, doc: np.ndarray, n_buckets: int) -> dict[int, bytes]:
    """Each distinct window once, dealt by its hash: key (64 bits), check (32 more), least and largest doc_id of the chunk.

    doc does not decrease.
    """
    order = np.argsort(key, kind="stable")
    key, check, doc = key[order], check[order], doc[order]
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    last = np.append(new[1:], len(key))[: len(new)] - 1
    key, check, least, most = key[new], check[new], doc[new], doc[last]
    order, at = dealt(key, n_buckets)
    cuts = ((b, order[at[b] : at[b + 1]]) for b in range(n_buckets) if at[b] < at[b + 1])
    return {b: b"".join([np.uint32(len(x)).tobytes(), key[x].tobytes(), check[x].astype("<u4").tobytes(), *packed_extent(least[x], most[x])]) for b, x in cuts}


def least_replies(blocks: list[pa.Buffer]) -> list[bytes]:
    """Rows of LEAST for those windows of each block that can be removed in some document of its chunk."""
    parts = []
    for b in blocks:
        n = int(np.frombuffer(b, np.uint32, 1)[0])
        parts.append((np.frombuffer(b, "<u8", n, 4), np.frombuffer(b, "<u4", n, 4 + 8 * n), *unpacked_extent(b, n, 4 + 12 * n)[:2]))
    key, check, least, _ = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((check, key))
    k, c = key[order], check[order]
    new = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (c[1:] != c[:-1]))[: len(k)])
    least_of = np.empty(len(k), np.int64)
    least_of[order] = np.repeat(np.minimum.reduceat(least[order], new), np.diff(np.append(new, len(k))))
    out, row = [], 0
    for keys, _, _, most in parts:
        found = least_of[row : row + len(keys)]
        row += len(keys)
        keep = found < most
        rows = np.zeros(int(keep.sum()), LEAST)
        rows["key"], rows["least"] = keys[keep], found[keep]
        out.append(rows.tobytes())
    return out


def found_windows(answers: list[pa.Buffer], keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which windows (hash and document of each) stand in a smaller document, from the answers."""
    rows = np.concatenate([np.zeros(0, LEAST), *(np.frombuffer(a, LEAST) for a in answers)])
    rows = rows[np.argsort(rows["key"])]
    if not len(rows):
        return np.zeros(0, np.int64)
    # a table of the first 20 bits leaves few windows to search for
    known = np.zeros(1 << 20, bool)
    known[rows["key"] >> np.uint64(44)] = True
    maybe = np.flatnonzero(known[keys >> np.uint64(44)])
    row = np.minimum(np.searchsorted(rows["key"], keys[maybe]), len(rows) - 1)
    return maybe[(rows["key"][row] == keys[maybe]) & (rows["least"][row] < doc[maybe])]
