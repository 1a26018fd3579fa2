"""N-gram Jaccard self-join by chosen paths.

A document is the set of its 5-word shingles. Documents with equal sets form a class, and one set stands for each class.
The tokens of a set are the least shingle hashes of `BINS` ranges of the hash (so two sets share about as many of them
as their similarity says). A run splits all sets recursively on sampled shared tokens: along each path a set goes to the
bucket of every token of its own that the path samples, `SHARED` of them on average for each that two sets at the
threshold share. Buckets of one set end. Small ones are compared by brute force. In a larger one, a set that is on
average similar to the bucket (`CENTRAL`, from the tokens that others there share) is compared with all of it, in
blocks, and leaves; the others are split again, until no bucket is large. Two similar sets stay together somewhere in a
run, at whatever depth it ends, with the probability q that solves q = 1 - exp(-SHARED q), so runs repeat until the
target recall is met at the threshold.

Brute force has two steps: the tokens of a bucket's sets are compared first, and only sets with a partner that may be
similar fetch their whole shingle sets; similarities are exact, from those. A pair that meets in several buckets counts
in the first. No pair is written: a task returns for each set its number of links and a spanning star of the links it
found; these give the near-duplicate groups. Counting all links among n near copies takes n * n comparisons; they are
dealt in blocks of `COMPARED` sets.

The words are runs of anything but space and U+0009 to U+000D, unchanged; fewer than five words make one shingle, and a
text without words (null, empty) has an empty set, no links and a group of its own. Rows that repeat a doc_id and a text
are copies of each other; a missing doc_id is larger than any. Sets are taken as equal if 128 bits of hashes are, and
shingles if 64 bits are. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vouch.llm import bloom, words
from vouch.llm.common import arrow_schema, joined_by_group, slices, text_bytes, thrifty, written
from vouch.llm.components import components

#: The recall is for two sets at the threshold, however deep the splitting goes; at the first depth they miss each other once in some 160,000 times.
SHINGLE, THRESHOLD, TARGET_RECALL = 5, 0.8, 0.999
BINS, SHARED, BUCKET = 32, 1.5, 1024
#: A set is central in a bucket if on average it shares this part of its tokens with the others there. CENTRAL * SHARED /
#: THRESHOLD is below 1, so the paths of the other sets grow fewer from depth to depth.
CENTRAL = 0.5
#: Sets of a large bucket are judged in blocks of so many; a token that fewer than one in RARE sets there have counts as unshared.
BLOCK, RARE = 4096, 64
#: Sets in a block of a comparison, where a bucket is large.
COMPARED = 256
#: Sets whose tokens are less similar than the threshold by so much (over four standard deviations) are not fetched.
MARGIN = 0.3

_SET_DDL = "doc_id long, row_key long, node long, check long, n_shingles int, tokens binary"
_FREQUENT_DDL = "path long, n long, token long, held long"
_SPLIT_DDL = "path long, node long, share double, children array<long>"
_MEMBER_DDL = "task long, leaf long, side int, node long, size long, ends array<long>, central array<boolean>, shingles binary"
_FOUND_DDL = "node long, n_class_links long, n_links long, root long"


def runs_for(recall: float, shared: float) -> int:
    """Runs until two sets at the threshold have met with this probability, however deep the splitting goes."""
    q = 1.0
    for _ in range(200):
        q = 1 - math.exp(-shared * q)
    return math.ceil(math.log(1 - recall) / math.log(1 - q))


def shingle_sets(batch: pa.RecordBatch, column: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all texts, sorted within each, and where each text's begin."""
    data, bounds = text_bytes(batch.column(column))
    starts, ends, first_word = words.spans(data, bounds)
    h = words.hashes(data, starts, ends)
    at, text = words.windows_within(first_word, size)
    found = words.window_hashes(h, size)[at] if len(at) else np.zeros(0, np.uint64)
    # a text of fewer words is one shingle
    n_words = np.diff(first_word)
    few = np.flatnonzero((n_words > 0) & (n_words < size))
    if len(few):
        found = np.concatenate([found, words.range_hashes(words.prefix_sums(h), first_word[few], first_word[few + 1])])
        text = np.concatenate([text, few])
    order = np.lexsort((found, text))
    found, text = found[order], text[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (text[1:] != text[:-1])
    return found[new], np.searchsorted(text[new], np.arange(len(batch) + 1))


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    totals = np.append(np.uint64(0), np.cumsum(values, dtype=np.uint64))
    return totals[at[1:]] - totals[at[:-1]]


def _node(sets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set."""
    return words.mixed(_sums(words.mixed(sets), at)), words.mixed(_sums(words.mixed(sets ^ np.uint64(0x5DEECE66D)), at))


_BIN_SHIFT = np.uint64(64 - BINS.bit_length() + 1)


def _tokens(sets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least shingle hash in each range of the hash, for each set, and where each set's begin."""
    own = np.repeat(np.arange(len(at) - 1), np.diff(at))
    place = own * BINS + (sets >> _BIN_SHIFT).astype(np.int64)
    first = np.append(True, place[1:] != place[:-1])[: len(sets)]
    return sets[first], np.append(0, np.cumsum(first))[at]


def _binaries(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((8 * at).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _described(size: int):
    schema = arrow_schema(_SET_DDL)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                sets, at = shingle_sets(part, 2, size)
                node, check = _node(sets, at)
                tokens = _binaries(*_tokens(sets, at))
                yield pa.record_batch([part.column(0), part.column(1), pa.array(node.view(np.int64)), pa.array(check.view(np.int64)), pa.array(np.diff(at).astype(np.int32)), tokens], schema=schema)

    return thrifty(run)


def _draws(path: np.ndarray, tokens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every token of every row: the row, what the row's path draws for it, and that as a number from 0 to 1."""
    row = np.repeat(np.arange(len(path)), np.diff(at))
    drawn = words.mixed(tokens ^ words.mixed(path)[row])
    return row, drawn, (drawn >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _first_paths(runs: int, per_set: float):
    """key and node: the buckets of each set at the first depth of every run."""
    ddl = "key long, node long"
    schema = arrow_schema(ddl)

    def run(batches):
        for batch in batches:
            node = batch.column(0).to_numpy()
            tokens, at = text_bytes(batch.column(1))
            tokens, at = tokens.view(np.uint64), at // 8
            keys, nodes = [], []
            for k in range(runs):
                row, drawn, level = _draws(np.full(len(node), k + 1, np.uint64), tokens, at)
                chosen = level < per_set / np.diff(at)[row]
                keys.append(words.mixed(drawn[chosen] + np.uint64(1)))
                nodes.append(node[row[chosen]])
            yield pa.record_batch([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(nodes))], schema=schema)

    return thrifty(run), ddl


def _frequent():
    """Of a block of a large bucket the tokens that at least one in 2 * RARE of its sets have: 2 * RARE * BINS at most."""
    schema = arrow_schema(_FREQUENT_DDL)

    def frequent(sets: pa.Table) -> pa.Table:
        tokens = text_bytes(sets.column("tokens").combine_chunks().cast(pa.large_binary()))[0].view(np.int64)
        found, held = np.unique(tokens, return_counts=True)
        often = (held > 1) & (held * 2 * RARE >= len(sets))
        found, held = found[often], held[often]
        n = len(found)
        return pa.table([pa.array(np.full(n, sets.column("path")[0].as_py(), np.int64)), pa.array(np.full(n, sets.column("n")[0].as_py(), np.int64)), pa.array(found), pa.array(held.astype(np.int64))], schema=schema)

    return frequent


def _split(per_set: float):
    """For each set of a block of a large bucket its share (the mean, over its tokens, of the part of the other sets there
    that have them) and the buckets that it is split into."""
    schema = arrow_schema(_SPLIT_DDL)

    def split(key: tuple, sets: pa.Table, frequent: pa.Table) -> pa.Table:
        if not len(sets):
            return schema.empty_table()
        path, node = sets.column("path").to_numpy(), sets.column("node").to_numpy()
        tokens, at = text_bytes(sets.column("tokens").combine_chunks().cast(pa.large_binary()))
        tokens, at = tokens.view(np.uint64), at // 8
        known = np.array(frequent.column("found")[0].values.field("token") if len(frequent) else [], np.int64)
        held = np.array(frequent.column("found")[0].values.field("held") if len(frequent) else [], np.int64)
        order = np.argsort(known)
        known, held = known[order], np.append(held[order], 1)
        place = np.searchsorted(known, tokens.view(np.int64))
        place[(place == len(known)) | (np.append(known, 0)[place] != tokens.view(np.int64))] = len(known)
        row, drawn, level = _draws(path.view(np.uint64), tokens, at)
        n_tokens = np.diff(at)
        share = np.bincount(row, weights=held[place] - 1, minlength=len(node)) / n_tokens / (sets.column("n")[0].as_py() - 1)
        chosen = level < per_set / n_tokens[row]
        children = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(row[chosen], minlength=len(node)))).astype(np.int32)), pa.array(words.mixed(drawn[chosen] + np.uint64(1)).view(np.int64)))
        return pa.table([pa.array(path), pa.array(node), pa.array(share), children], schema=schema)

    return split


def _counted(members: DataFrame) -> DataFrame:
    """key, n and two hashes of the members, of all buckets of two sets or more."""
    return members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("x2")).filter("n > 1")


def _buckets(classes: DataFrame, runs: int, bucket: int) -> tuple[DataFrame, DataFrame | None]:
    """Where all splitting ends: small buckets (key, node), and large ones with central sets (key, node, central, n, n_central)."""
    per_set = SHARED / THRESHOLD
    run, ddl = _first_paths(runs, per_set)
    members = written(classes.select("node", "tokens").mapInArrow(run, ddl), "paths")
    levels, counts, grids, n_split, n_buckets = [], [], [], 0, 0
    while True:
        counted = written(_counted(members), "counted", rows=members.count())
        levels.append(members)
        counts.append(counted.filter(F.col("n") <= bucket))
        large = counted.filter(F.col("n") > bucket).select(F.col("key").alias("path"), "n")
        n_inside = large.agg(F.sum("n")).first()[0] or 0
        n_buckets += counted.count()
        if not n_inside:
            break
        n_split += n_inside
        inside = joined_by_group(members.select(F.col("key").alias("path"), "node"), large, "path", "n")
        inside = written(inside.withColumn("block", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / BLOCK))), "inside", rows=n_inside)
        # tokens of the sets inside alone are shuffled, and not those of all sets at every depth
        asked = bloom.marked(inside.select("node"), n_inside)
        inside = inside.join(classes.select("node", "tokens").filter(asked(F.col("node"))), "node").select("path", "n", "tokens", "node", "block")
        inside = written(inside, "blocks", rows=n_inside)
        # of a bucket's tokens those that many sets there have: RARE * BINS at most
        frequent = inside.groupBy("path", "block").applyInArrow(_frequent(), _FREQUENT_DDL)
        frequent = frequent.groupBy("path", "token").agg(F.sum("held").alias("held"), F.max("n").alias("n")).filter(F.col("held") * RARE >= F.col("n"))
        frequent = frequent.groupBy("path").agg(F.max("n").alias("n"), F.collect_list(F.struct("token", "held")).alias("found"))
        frequent = frequent.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / BLOCK) - 1)).alias("block"), "found")
        told = inside.groupBy("path", "block").cogroup(frequent.groupBy("path", "block")).applyInArrow(_split(per_set), _SPLIT_DDL)
        told = written(told.select("path", "node", "children", (F.col("share") >= CENTRAL).alias("central")), "told", rows=n_inside)
        grids.append(told.select(F.col("path").alias("key"), "node", "central"))
        members = written(told.filter("NOT central").select(F.explode("children").alias("key"), "node"), "paths")
    # buckets of the same sets: one is enough
    small = _union(counts).groupBy("n", "x1", "x2").agg(F.min("key").alias("key")).select("key")
    small = _union(levels).join(written(small, "small", rows=n_buckets), "key")
    return small, _merged(_union(grids), n_split) if grids else None


def _merged(large: DataFrame, n: int) -> DataFrame:
    """key, node, central, n, n_central: large buckets, as one where they have most of their central sets in common.

    Near copies are together in many buckets; so they are compared once and not in each.
    """
    sizes = written(large.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if("central").alias("n_central")).filter("n_central > 0"), "sizes", rows=n)
    lists = large.filter("central").groupBy("node").agg(F.collect_set("key").alias("keys")).filter(F.size("keys") > 1)
    pairs = lists.select(F.explode("keys").alias("a"), "keys").select("a", F.explode("keys").alias("b")).filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    n_central = lambda name: sizes.select(F.col("key").alias(name), F.col("n_central").alias("of_" + name))
    links = pairs.join(n_central("a"), "a").join(n_central("b"), "b").filter(2 * F.col("shared") >= F.least("of_a", "of_b"))
    found = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), n).withColumnRenamed("node", "key")
    names = written(sizes.select("key", "n").join(found, "key", "left").select("key", "n", F.coalesce("component", "key").alias("cluster")), "names", rows=n)
    merged = joined_by_group(large, names, "key", "n").groupBy(F.col("cluster").alias("key"), "node").agg(F.bool_or("central").alias("central"))
    merged = written(merged, "merged", rows=n)
    sizes = merged.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if("central").alias("n_central"))
    return joined_by_group(merged, written(sizes, "sizes", rows=n), "key", "n").select("key", "node", "central", "n", "n_central")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _grouped(batches, column: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with one value of the (ordered) column, across batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        value = batch.column(column).to_numpy()
        cuts = [0, *(np.flatnonzero(value[1:] != value[:-1]) + 1).tolist(), len(batch)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and held[0].column(column)[0].as_py() != value[a]:
                yield _one(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield _one(held)


def _one(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _promising(threshold: float):
    """Of each small bucket (key, node, tokens; ordered by key) the sets with a partner whose tokens are similar enough."""
    ddl = "key long, node long"
    schema = arrow_schema(ddl)

    def run(batches):
        keys, nodes, n_held = [], [], 0
        for group in _grouped(batches, 0):
            tokens, at = text_bytes(group.column(2))
            tokens, at = tokens.view(np.uint64), at // 8
            m = len(group)
            row = np.repeat(np.arange(m), np.diff(at))
            here = np.zeros((m, BINS), np.uint64)
            full = np.zeros((m, BINS), bool)
            place = (tokens >> _BIN_SHIFT).astype(np.int64)
            here[row, place], full[row, place] = tokens, True
            both = np.zeros((m, m), np.int16)
            either = np.zeros((m, m), np.int16)
            for b in range(BINS):
                x, f = here[:, b], full[:, b]
                both += (x[:, None] == x[None, :]) & f[:, None] & f[None, :]
                either += f[:, None] | f[None, :]
            similar = both >= (threshold - MARGIN) * either
            np.fill_diagonal(similar, False)
            found = np.flatnonzero(similar.any(axis=1))
            if len(found):
                keys.append(np.full(len(found), group.column(0)[0].as_py(), np.int64))
                nodes.append(group.column(1).to_numpy()[found])
                n_held += len(found)
            if n_held > 10_000:
                yield pa.record_batch([pa.array(np.concatenate(keys)), pa.array(np.concatenate(nodes))], schema=schema)
                keys, nodes, n_held = [], [], 0
        if n_held:
            yield pa.record_batch([pa.array(np.concatenate(keys)), pa.array(np.concatenate(nodes))], schema=schema)

    return thrifty(run), ddl


def _members(size: int, bucket: int):
    """A row for each task that a set takes part in, with its whole shingle set."""
    schema = arrow_schema(_MEMBER_DDL)

    def run(batches):
        rows, held = [], 0
        for batch in batches:
            for part in slices(batch):
                sets, at = shingle_sets(part, 0, size)
                node = _node(sets, at)[0].view(np.int64)
                for i, (own, n, ends) in enumerate(zip(*(part.column(k).to_pylist() for k in range(1, 4)), strict=True)):
                    if own != node[i]:  # another text with the same row key
                        continue
                    content = sets[at[i] : at[i + 1]].tobytes()
                    leaves, central = [e["key"] for e in ends], [e["central"] for e in ends]
                    for end in ends:
                        for task, side in _tasks(end, own, bucket):
                            rows.append((task, end["key"], side, own, n, leaves, central, content))
                            held += len(content)
                            if held > 4 << 20 or len(rows) > 5000:
                                yield _batch(rows, schema)
                                rows, held = [], 0
        if rows:
            yield _batch(rows, schema)

    return thrifty(run)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _tasks(end: dict, own: int, bucket: int) -> Iterator[tuple[int, int]]:
    """The tasks of a set in a bucket, and its side in each (0: both). In a large bucket blocks of central sets are compared
    with each other and with blocks of the rest."""
    if not end["n"]:
        yield end["key"], 0
        return
    bucket = min(bucket, COMPARED)
    blocks, others = -(-end["n_central"] // bucket), -(-(end["n"] - end["n_central"]) // bucket)
    # hashes of integers are alike in every process
    if end["central"]:
        mine = hash((own, 1)) % blocks
        for j in range(blocks):
            yield hash((end["key"], min(mine, j), max(mine, j))), (j > mine) + 2 * (j < mine)
        for j in range(others):
            yield hash((end["key"], mine, blocks + j)), 1
    else:
        mine = hash((own, 2)) % others
        for i in range(blocks):
            yield hash((end["key"], i, blocks + mine)), 2


def _compared(group: pa.RecordBatch, threshold: float) -> list[tuple[int, int, int, int]]:
    """Links among the sets of one bucket, or between those of two blocks: (node, classes linked, documents linked, root)."""
    nodes, side = group.column(3).to_numpy(), group.column(2).to_numpy()
    # rows that repeat a doc_id and a text have sent the same set twice
    _, first = np.unique(np.stack([nodes, side.astype(np.int64)]), axis=1, return_index=True)
    group = group.take(pa.array(np.sort(first)))
    nodes, side = group.column(3).to_numpy(), group.column(2).to_numpy()
    m, leaf = len(group), group.column(1)[0].as_py()
    ends, central = group.column(5).to_pylist(), group.column(6).to_pylist()
    allowed = side[:, None] != side[None, :] if side.any() else ~np.eye(m, dtype=bool)
    if not allowed.any():
        return []
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column(7)]
    sizes = np.array([len(s) for s in sets], np.int64)
    common = _intersections(sets)
    linked = allowed & (common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-9)
    if not linked.any():
        return []
    # pairs that meet in an earlier bucket count there
    number = {e: k for k, e in enumerate(sorted({e for row in ends for e in row if e < leaf}))}
    if number:
        anywhere, as_central = np.zeros((m, len(number)), np.float32), np.zeros((m, len(number)), np.float32)
        for i in range(m):
            for e, c in zip(ends[i], central[i], strict=True):
                if e < leaf:
                    anywhere[i, number[e]], as_central[i, number[e]] = 1, c
        met = as_central @ anywhere.T
        linked &= (met + met.T) == 0
    weight = group.column(4).to_numpy()
    classes, documents = linked.sum(axis=1), linked @ weight
    root = np.arange(m)
    seen = np.zeros(m, bool)
    for i in np.flatnonzero(classes):
        if seen[i]:
            continue
        frontier = found = np.zeros(m, bool)
        frontier[i] = True
        while frontier.any():
            found = found | frontier
            frontier = linked[frontier].any(axis=0) & ~found
        seen |= found
        root[found] = i
    return [(int(nodes[i]), int(classes[i]), int(documents[i]), int(nodes[root[i]])) for i in np.flatnonzero(classes)]


def _intersections(sets: list[np.ndarray], columns: int = 1 << 22) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of 0/1 matrices over the shingles that two sets or more have."""
    m = len(sets)
    if m == 2:
        n = np.intersect1d(sets[0], sets[1], assume_unique=True).size
        return np.array([[0, n], [n, 0]])
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    values, column, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = n > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], number[column[keep]]
    common = np.zeros((m, m), np.float64)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    step = max(1, columns // m)
    for a in range(0, int(shared.sum()), step):
        lo, hi = np.searchsorted(column, (a, a + step))
        table = np.zeros((m, min(step, int(shared.sum()) - a)), np.float32)
        table[row[lo:hi], column[lo:hi] - a] = 1
        common += table @ table.T
    return common


def _comparer(threshold: float):
    schema = arrow_schema(_FOUND_DDL)

    def run(batches):
        out: list[tuple[int, int, int, int]] = []
        for group in _grouped(batches, 0):
            out += _compared(group, threshold)
            if len(out) > 5000:
                yield _batch(out, schema)
                out = []
        if out:
            yield _batch(out, schema)

    return thrifty(run)


def _links(texts: DataFrame, classes: DataFrame, n_classes: int, shingle: int, threshold: float, recall: float, bucket: int) -> DataFrame:
    """node, n_class_links, n_links, root: what every comparison found."""
    small, grid = _buckets(classes, runs_for(recall, SHARED), bucket)
    run, ddl = _promising(threshold)
    tokens = small.join(classes.select("node", "tokens"), "node").select("key", "node", "tokens")
    promising = tokens.repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(run, ddl)
    zero = F.lit(0).cast("long")
    ends = promising.select("key", "node", F.lit(True).alias("central"), zero.alias("n"), zero.alias("n_central"))
    ends = ends.unionByName(grid) if grid is not None else ends
    wanted = ends.groupBy("node").agg(F.collect_list(F.struct("key", "central", "n", "n_central")).alias("ends"))
    wanted = written(wanted.join(classes.select("node", F.col("rep.row_key").alias("row_key"), "size"), "node"), "wanted", rows=n_classes)
    asked = bloom.marked(wanted.select("row_key"), wanted.count())
    members = texts.filter(asked(F.col("row_key"))).join(wanted, "row_key").select("text", "node", "size", "ends").mapInArrow(_members(shingle, bucket), _MEMBER_DDL)
    return members.repartition(F.col("task")).sortWithinPartitions("task").mapInArrow(_comparer(threshold), _FOUND_DDL)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, row_key and whole text (null text: empty); row_key stands for the doc_id and the text."""
    return docs.select("doc_id", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("row_key"), F.coalesce("text", F.lit("")).alias("text"))


def _classed(docs: DataFrame, shingle: int, threshold: float, recall: float, bucket: int) -> DataFrame:
    """doc_id, row_key, least and copy (both (no doc_id, doc_id, row_key)), n_links and n_class_links for every row of docs."""
    texts = _keyed(docs)
    described = written(texts.select("doc_id", "row_key", "text").mapInArrow(_described(shingle), _SET_DDL), "sets")
    row = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row_key")
    classes = described.filter("n_shingles > 0").groupBy("node", "check").agg(F.min(row).alias("rep"), F.count(F.lit(1)).alias("size"), F.any_value("tokens").alias("tokens"))
    classes = written(classes, "classes", rows=described.count())
    n_classes = classes.count()
    found = written(_links(texts, classes, n_classes, shingle, threshold, recall, bucket), "found")
    links = found.groupBy("node").agg(F.sum("n_class_links").alias("n_class_links"), F.sum("n_links").alias("n_links"))
    groups = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")), found.count())
    named = written(groups.join(classes.select("node", "rep"), "node"), "named", rows=n_classes)
    least = written(named.groupBy("component").agg(F.min("rep").alias("least"), F.count(F.lit(1)).alias("n")), "least", rows=n_classes)
    of_node = joined_by_group(named.select("node", "component"), least, "component", "n").select("node", "least")
    of_class = classes.select("node", "check", "rep", "size").join(of_node, "node", "left").join(links, "node", "left")
    zero = F.lit(0).cast("long")
    of_class = of_class.select("node", "check", F.coalesce("least", "rep").alias("least"), F.col("rep").alias("copy"), (F.coalesce("n_links", zero) + F.col("size") - 1).alias("n_links"), F.coalesce("n_class_links", zero).alias("n_class_links"), "size")
    of_class = written(of_class, "of-class", rows=n_classes)
    shingled = described.filter("n_shingles > 0").select("doc_id", "row_key", "node", "check")
    joined = joined_by_group(shingled, of_class, ["node", "check"], "size").select("doc_id", "row_key", "least", "copy", "n_links", "n_class_links")
    alone = described.filter("n_shingles = 0").select("doc_id", "row_key", row.alias("least"), row.alias("copy"), zero.alias("n_links"), zero.alias("n_class_links"))
    return joined.unionByName(alone)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, recall: float = TARGET_RECALL, bucket: int = BUCKET) -> DataFrame:
    """doc_id, class_id (least doc_id of the near-duplicate group), copy_id (least doc_id with an equal set), n_links
    (other documents at the threshold or above, copies included) and n_class_links (other sets) for every row of docs."""
    return _classed(docs, shingle, threshold, recall, bucket).select("doc_id", F.col("least.doc_id").alias("class_id"), F.col("copy.doc_id").alias("copy_id"), "n_links", "n_class_links")


def one_of_each_group(docs: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, recall: float = TARGET_RECALL, bucket: int = BUCKET) -> DataFrame:
    """docs without those whose near-duplicate group has a smaller doc_id (of equal ones, one text stays, and all rows that
    repeat it); texts without words all stay. Only rows that may go are shuffled."""
    classed = _classed(docs, shingle, threshold, recall, bucket)
    dropped = classed.filter(F.col("row_key") != F.col("least.row_key")).select(F.col("row_key").alias("key"), "doc_id").distinct()
    return bloom.without(docs, F.xxhash64("doc_id", F.coalesce("text", F.lit(""))), written(dropped, "dropped"))
