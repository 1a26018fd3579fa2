"""Periodic runs: stretches of words that repeat with a period, by the branching-tandem test on an enhanced suffix array.

The words of a slice of texts are numbered, each text with numbers of its own, and sorted into one suffix array by prefix
doubling; the ranks of each doubling give the common prefixes (LCP) of neighbours, and nearest smaller values of those the
LCP intervals, in place of tree nodes. For an interval of depth d, every suffix i of all children but the largest is
tested: where i + d or i - d (by the inverse suffix array, ISA) lies in the interval, but in another child, the earlier of
the two starts a square of period d that the word after it ends. Each run ends in one such square, so squares are rotated
to the left as far as the period holds, and those that a shorter period of the same end covers are merged into its run.

Whatever a text holds is searched; memory grows with the longest single text (some 200 bytes a word of it), else with the
slice. Null and empty texts have no words and no runs, rows that repeat a doc_id are searched each on their own, an empty
table gives an empty result, and no column but doc_id and text is read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouch.llm import words
from vouch.llm.common import arrow_schema, slices, text_bytes, thrifty, whole_texts

LEAST_WORDS, LEAST_TIMES = 24, 3
#: Suffixes of smaller children that are tested at a time, and rotations that all squares make together.
TEST_BLOCK, ROTATIONS = 1 << 20, 32

_DDL = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffix array of whole numbers, its inverse, and lcp[k], the common prefix of the suffixes at k - 1 and k."""
    n = len(symbols)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    sa = np.argsort(symbols, kind="stable")
    head = np.append(True, symbols[sa][1:] != symbols[sa][:-1])
    # a rank is the place of the first suffix of its group; one past the end ranks below all
    rank = np.full(n + 1, -1, np.int32)
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    levels, width = [rank], 1
    while True:
        shared = ~head
        shared[:-1] |= ~head[1:]
        places = np.flatnonzero(shared)
        if not len(places):
            break
        rank, at = levels[-1], sa[places]
        key = rank[at].astype(np.int64) * (n + 1) + rank[np.minimum(at + width, n)] + 1
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        sa[places] = at
        opens = np.append(True, key[1:] != key[:-1])
        head = head.copy()
        head[places] = opens
        rank = rank.copy()
        rank[at] = np.maximum.accumulate(np.where(opens, places, 0))
        levels.append(rank)
        width *= 2
    lcp = np.zeros(n, np.int64)
    pairs = np.flatnonzero(levels[0][sa[1:]] == levels[0][sa[:-1]]) + 1
    a, b = sa[pairs - 1], sa[pairs]
    same = np.zeros(len(pairs), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        same += (levels[level][a + same] == levels[level][b + same]).astype(np.int64) << level
    lcp[pairs] = same
    isa = np.empty(n, np.int64)
    isa[sa] = np.arange(n)
    return sa, isa, lcp


def _nearest_smaller(values: np.ndarray) -> np.ndarray:
    """For each value the place of the last smaller one before it, or -1."""
    padded = np.append(values, -1)
    left = np.arange(-1, len(values) - 1)
    pending = np.flatnonzero(padded[left] >= values)
    while len(pending):
        left[pending] = left[left[pending]]
        pending = pending[padded[left[pending]] >= values[pending]]
    return left


def intervals(lcp: np.ndarray) -> tuple[np.ndarray, ...]:
    """The children of all LCP intervals: interval number, bounds of the interval, its depth, and bounds of the child."""
    left = _nearest_smaller(lcp)
    right = len(lcp) - 1 - _nearest_smaller(lcp[::-1])[::-1]
    cuts = np.flatnonzero(lcp > 0)
    cuts = cuts[np.lexsort((right[cuts], left[cuts]))]
    opens = np.append(True, (left[cuts][1:] != left[cuts][:-1]) | (right[cuts][1:] != right[cuts][:-1])) if len(cuts) else np.zeros(0, bool)
    first = np.flatnonzero(opens)
    number = np.cumsum(opens) - 1
    # an interval with m cuts has m + 1 children: one from its left bound, and one from each cut
    place = np.arange(len(cuts)) + number + 1
    starts = np.empty(len(cuts) + len(first), np.int64)
    starts[place] = cuts
    starts[place[first] - 1] = left[cuts[first]]
    ends = np.empty(len(starts), np.int64)
    ends[:-1] = starts[1:]
    last = np.append(place[first][1:] - 2, len(starts) - 1) if len(first) else first
    ends[last] = right[cuts[first]]
    of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(cuts))) + 1)
    return of, left[cuts[first]][of], right[cuts[first]][of], lcp[cuts[first]][of], starts, ends


def branching_squares(symbols: np.ndarray, longest: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Start and period of every square that the next symbol does not continue; longest: for each position the greatest period of use."""
    sa, isa, lcp = suffix_array(symbols)
    n = len(sa)
    of, low, high, depth, starts, ends = intervals(lcp)
    size = ends - starts
    if not len(size):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # the first of an interval's largest children is left out
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    by_size = np.lexsort((np.arange(len(of)), -size, of))
    tested = np.ones(len(of), bool)
    tested[by_size[first]] = False
    if longest is not None:
        tested &= depth <= longest[sa[starts]]
    tested = np.flatnonzero(tested)
    total = np.cumsum(size[tested])
    found, at = [], 0
    while at < len(tested):
        done = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + TEST_BLOCK, side="right")))
        some = tested[at:to]
        child = np.repeat(some, size[some])
        within = np.arange(len(child)) - np.repeat(np.cumsum(size[some]) - size[some], size[some])
        i, d = sa[starts[child] + within], depth[child]
        for start, other in ((i, i + d), (i - d, i - d)):
            fits = (other >= 0) & (other < n)
            k, place = child[fits], isa[other[fits]]
            hit = (place >= low[k]) & (place < high[k]) & ~((place >= starts[k]) & (place < ends[k]))
            found.append(start[fits][hit] * (n + 1) + d[fits][hit])
        at = to
    keys = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return keys // (n + 1), keys % (n + 1)


def _rotated(symbols: np.ndarray, start: int, period: int, first: int) -> int:
    """How far to the left (not before `first`) the period holds from a square's start, by doubling blocks."""
    block = ROTATIONS
    while start > first:
        low = max(first, start - block)
        differs = np.flatnonzero(symbols[low:start] != symbols[low + period : start + period])
        if len(differs):
            return low + int(differs[-1]) + 1
        start, block = low, block * 2
    return start


def find_runs(symbols: np.ndarray, bounds: np.ndarray, least: int = LEAST_WORDS, times: int = LEAST_TIMES) -> np.ndarray:
    """Runs (text, start in it, length, period), by text, start and period; texts are symbols[bounds[t]:bounds[t + 1]].

    Symbols of different texts must differ. A run is as long as `least` and as `times` periods (two or more) at least.
    """
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    size = np.diff(bounds)
    start, period = branching_squares(symbols, (size // times)[text])
    end = start + 2 * period
    first = bounds[:-1][text[start]] if len(start) else start
    moving = np.arange(len(start))
    for _ in range(ROTATIONS):
        at = start[moving]
        moving = moving[at > first[moving]]
        moving = moving[symbols[start[moving] - 1] == symbols[start[moving] - 1 + period[moving]]]
        if not len(moving):
            break
        start[moving] -= 1
    long_enough = end - start >= np.maximum(least, times * period)
    long_enough[moving] = True
    kept = np.flatnonzero(long_enough)
    kept = kept[np.lexsort((period[kept], end[kept]))]
    rotates = np.zeros(len(start), bool)
    rotates[moving] = True
    out, here, last = [], [], -1
    for k in kept.tolist():
        s, p, e = int(start[k]), int(period[k]), int(end[k])
        if e != last:
            here, last = [], e
        if any(p % q == 0 and r <= e - 2 * p for q, r in here):
            continue
        if rotates[k]:
            s = _rotated(symbols, s, p, int(first[k]))
        if e - s >= max(least, times * p):
            here.append((p, s))
            out.append((int(text[s]), s - int(first[k]), e - s, p))
    return np.array(sorted((t, s, p, n) for t, s, n, p in out), np.int64).reshape(-1, 4)[:, [0, 1, 3, 2]]


def dropped_words(runs: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which words some run contains after its first period."""
    steps = np.zeros(int(bounds[-1]) + 1, np.int64)
    begin = bounds[runs[:, 0]] + runs[:, 1]
    np.add.at(steps, begin + runs[:, 3], 1)
    np.add.at(steps, begin + runs[:, 2], -1)
    return np.cumsum(steps[:-1]) > 0


def _numbered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: np.ndarray) -> np.ndarray:
    """A number for each word, equal where text and word are."""
    size = ends - starts
    inside = words.covered_bytes(len(data), starts, ends)
    at = np.append(0, np.cumsum(size)).astype(np.int64)
    values = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(data[inside].tobytes())])
    number = values.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return text * (int(number.max()) + 1) + number if len(number) else number


def _found(batch: pa.RecordBatch, least: int, times: int, schema: pa.Schema) -> pa.RecordBatch:
    data, at = text_bytes(batch.column(1))
    starts, ends, bounds = words.spans(data, at)
    text = np.repeat(np.arange(len(batch)), np.diff(bounds))
    runs = find_runs(_numbered(data, starts, ends, text), bounds, least, times)
    kept = ~dropped_words(runs, bounds)
    # kept words, each with a space after it but for a text's last
    where, size = starts[kept], (ends - starts)[kept] + 1
    out = np.append(0, np.cumsum(size))
    source = np.arange(out[-1]) - np.repeat(out[:-1] - where, size)
    joined = np.append(data, np.uint8(0x20))[source]
    joined[out[1:] - 1] = 0x20
    n_kept = np.diff(np.append(0, np.cumsum(kept))[bounds])
    last = np.cumsum(n_kept)
    final = last[n_kept > 0]
    solid = np.ones(len(joined), bool)
    solid[out[final] - 1] = False
    lengths = out[last] - out[last - n_kept] - (n_kept > 0)
    collapsed = pa.Array.from_buffers(pa.large_string(), len(batch), [None, pa.py_buffer(np.append(0, np.cumsum(lengths)).astype(np.int64)), pa.py_buffer(joined[solid].tobytes())])
    per_text = np.searchsorted(runs[:, 0], np.arange(len(batch) + 1)).astype(np.int32)
    structs = pa.StructArray.from_arrays([pa.array(runs[:, c], pa.int64()) for c in (1, 2, 3)], ["start", "length", "period"])
    listed = pa.ListArray.from_arrays(pa.array(per_text), structs).cast(schema.field("runs").type)
    return pa.record_batch([batch.column(0), pa.array(np.diff(bounds), pa.int64()), listed, collapsed.cast(pa.string())], schema=schema)


def with_runs(docs: DataFrame, least: int = LEAST_WORDS, times: int = LEAST_TIMES) -> DataFrame:
    """doc_id, n_words, runs (start, length and period in words, by start and period), and collapsed: the text's words without those
    that a run contains after its first period, joined by one space."""
    schema = arrow_schema(_DDL)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                yield _found(part, least, times, schema)

    return whole_texts(docs).mapInArrow(thrifty(run), _DDL)


def looped_tails(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text), of which a tenth (crc32 of the doc_id) repeats words from some place to its end: with n words
    and g the tenth part of that crc32, those from a = g % n on repeat the first 1 + (n - a) / (3 + g % 8) of them."""
    h = F.crc32(F.col("doc_id").cast("string"))
    split = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    marked = docs.select("doc_id", "text", F.when(h % 10 == 0, split).alias("w"), F.floor(h / 10).alias("g")).withColumn("n", F.size("w"))
    a = F.col("g") % F.col("n")
    placed = marked.withColumn("a", F.when(F.col("n") > 0, a)).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    moved = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    return placed.select("doc_id", F.when(F.col("n") > 0, F.array_join(moved, " ")).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """with_runs() in digests: doc_id, n_runs, the run of the greatest length / period (ties: first start, then period; null
    without one), and SHA-256 of all runs and of the collapsed text."""
    better = lambda a, b: b["length"] * a["period"] > a["length"] * b["period"]
    best: Column = F.aggregate("runs", F.get("runs", F.lit(0)), lambda a, b: F.when(better(a, b), b).otherwise(a))
    line = lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    top = found.withColumn("best", best)
    return top.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
