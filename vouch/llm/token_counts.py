"""Edit-aware token counts.

A document keeps a segment tree over its pre-tokens: the leaves hold the length in characters and the token count of
each pre-token, the levels of nodes above hold sums, and the tree is stored with them. An edit replaces the characters
[start, start + removed) by a text. Only the pre-tokens that the edit touches are split and encoded anew, with boundary
context: from three pre-tokens before it (what the split pattern looks at ends at most three characters beyond the
start, and one beyond the end, of a match) until the new split falls in step with the old one beyond the edit. Their
leaves are replaced and the sums on their paths updated; all other leaves keep their counts.

Null texts count as empty: no leaves, 0 tokens. Edits of a document apply in the order of `seq`; positions refer to the
text as the edits before have left it, and are cut to its length. Documents without edits keep their counts. Rows that
repeat a doc_id are counted each on their own, with all edits of that doc_id. An empty table gives an empty result; no
columns but doc_id, text, edits and the tree's are read, whatever others are called.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vouch.llm.common import arrow_schema, slices

KNOWN_PRETOKENS = 400_000
FAN_OUT = 64
EDIT = "struct<seq:int,start:long,removed:long,added:string>"
_DDL = "doc_id long, n_tokens long, n_tokens_before long, n_pretokens long, n_reencoded long, tree binary"


class Counter:
    """Splits texts into pre-tokens and counts the tokens of each; counts of known pre-tokens are kept."""

    def __init__(self, ranks: bytes, pattern: str):
        import tiktoken

        pairs = (line.split() for line in ranks.splitlines() if line)
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def counts(self, pretokens: list[str]) -> list[int]:
        known = self.known
        if missing := {p for p in pretokens if p not in known}:
            if len(known) + len(missing) > KNOWN_PRETOKENS:
                known.clear()
                missing = set(pretokens)
            known.update((p, len(self.encoding.encode_ordinary(p))) for p in missing)
        return [known[p] for p in pretokens]

    def leaves(self, pretokens: list[str]) -> np.ndarray:
        """A row for each pre-token: its characters and its tokens."""
        return np.array([[len(p) for p in pretokens], self.counts(pretokens)], np.int64).reshape(2, -1).T

    def tree(self, text: str) -> Tree:
        return Tree(self.leaves(self.pattern.findall(text)))


@cache
def _counter(ranks: bytes, pattern: str) -> Counter:
    return Counter(ranks, pattern)


class Node:
    """A block of leaves, or a node of up to 2 * FAN_OUT children; sums: characters, tokens and blocks below it."""

    __slots__ = ("children", "leaves", "sums")

    def __init__(self, leaves: np.ndarray | None = None, children: list[Node] | None = None, sums: tuple[int, int, int] | None = None):
        self.leaves, self.children = leaves, children
        if sums is None:
            sums = (*leaves.sum(axis=0).tolist(), 1) if children is None else tuple(map(sum, zip(*(c.sums for c in children), strict=True)))
        self.sums = sums


def _parents(nodes: list[Node]) -> list[Node]:
    """Nodes over these, evenly filled, with 2 * FAN_OUT children at most."""
    n = -(-len(nodes) // (2 * FAN_OUT)) if len(nodes) > 2 * FAN_OUT else 1
    cuts = [len(nodes) * i // n for i in range(n + 1)]
    return [Node(children=nodes[x:y]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)] if nodes else []


class Tree:
    """A tree of many levels: leaves (characters, tokens) in blocks of FAN_OUT at most, and nodes with sums above them.

    A place is found, and blocks are replaced, along paths from the root: FAN_OUT steps a level.
    """

    def __init__(self, leaves: np.ndarray):
        self.root = self._grown([Node(children=[Node(block) for block in self._cut(leaves)])])

    @staticmethod
    def _cut(leaves: np.ndarray) -> list[np.ndarray]:
        return [leaves[i : i + FAN_OUT] for i in range(0, len(leaves), FAN_OUT)] or [leaves]

    @staticmethod
    def _grown(nodes: list[Node]) -> Node:
        while len(nodes) > 1 or len(nodes[0].children) > 2 * FAN_OUT:
            nodes = _parents(nodes[0].children) if len(nodes) == 1 else _parents(nodes)
        while len(nodes[0].children) == 1 and nodes[0].children[0].children is not None:
            nodes = nodes[0].children
        return nodes[0]

    @property
    def n_tokens(self) -> int:
        return self.root.sums[1]

    @property
    def n_blocks(self) -> int:
        return self.root.sums[2]

    def blocks(self) -> Iterator[Node]:
        below = [self.root]
        while below:
            node = below.pop()
            if node.children is None:
                yield node
            else:
                below.extend(reversed(node.children))

    def leaves(self) -> np.ndarray:
        return np.concatenate([node.leaves for node in self.blocks()])

    def block_at(self, char: int) -> int:
        """The number of the block that holds the character (the last, beyond the end)."""
        node, number = self.root, 0
        while node.children is not None:
            for child in node.children[:-1]:
                if char < child.sums[0]:
                    break
                char, number = char - child.sums[0], number + child.sums[2]
            else:
                child = node.children[-1]
            node = child
        return number

    def block(self, number: int) -> tuple[np.ndarray, int]:
        """A block's leaves, and the character at which it starts."""
        node, start = self.root, 0
        while node.children is not None:
            for child in node.children:
                if number < child.sums[2]:
                    break
                number, start = number - child.sums[2], start + child.sums[0]
            node = child
        return node.leaves, start

    def span(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Leaves of the blocks first to last (inclusive), and the characters at which they start, the end included."""
        found = [self.block(i) for i in range(first, last + 1)]
        leaves = np.concatenate([block for block, _ in found])
        return leaves, found[0][1] + np.append(0, np.cumsum(leaves[:, 0]))

    def put(self, first: int, last: int, leaves: np.ndarray) -> None:
        """New leaves in place of the blocks first to last; only the sums on their paths change."""
        new = [Node(block) for block in self._cut(leaves)] if len(leaves) or self.n_blocks == last - first + 1 else []
        self.root = self._grown(self._replaced(self.root, first, last + 1, new))

    @classmethod
    def _replaced(cls, node: Node, begin: int, end: int, new: list[Node]) -> list[Node]:
        """The nodes in place of this one, with `new` in place of its blocks from begin to end (exclusive)."""
        children = node.children
        if children[0].children is None:
            return _parents([*children[:begin], *new, *children[end:]])
        out, at = [], 0
        for child in children:
            n = child.sums[2]
            if begin < at + n and end > at:
                out += cls._replaced(child, max(begin - at, 0), min(end - at, n), new)
                new = []
            else:
                out.append(child)
            at += n
        return _parents(out)

    def to_bytes(self) -> bytes:
        """Levels from the top (how many children each node has, and its sums), then the leaves, in the narrowest width that fits."""
        levels, nodes = [], [self.root]
        while nodes[0].children is not None:
            levels.append((np.array([len(n.children) for n in nodes], "<u4"), np.array([n.sums for n in nodes], "<i8")))
            nodes = [c for n in nodes for c in n.children]
        leaves = np.concatenate([n.leaves for n in nodes])
        width = next(w for w in (1, 2, 4) if leaves.max(initial=0) < 1 << (8 * w - 1))
        head = np.array([len(levels), width, *(len(counts) for counts, _ in levels), len(nodes)], "<u4")
        blocks = np.array([len(n.leaves) for n in nodes], "<u4"), np.array([n.sums for n in nodes], "<i8")
        return b"".join(x.tobytes() for x in (head, *(y for level in levels for y in level), *blocks, leaves.astype(f"<i{width}")))

    @classmethod
    def from_bytes(cls, stored: bytes) -> Tree:
        """The stored tree; sums are read, not added up again."""
        depth, width = np.frombuffer(stored, "<u4", 2).tolist()
        sizes, at, levels = np.frombuffer(stored, "<u4", depth + 1, 8).tolist(), 8 + 4 * (depth + 1), []
        for n in sizes:
            levels.append((np.frombuffer(stored, "<u4", n, at).tolist(), [tuple(x) for x in np.frombuffer(stored, "<i8", 3 * n, at + 4 * n).reshape(n, 3).tolist()]))
            at += 28 * n
        leaves = np.frombuffer(stored, f"<i{width}", offset=at).astype(np.int64).reshape(-1, 2)
        cuts = np.append(0, np.cumsum(levels[-1][0])).tolist()
        nodes = [Node(leaves[x:y], sums=sums) for x, y, sums in zip(cuts[:-1], cuts[1:], levels[-1][1], strict=True)]
        for counts, sums in reversed(levels[:-1]):
            cuts = np.append(0, np.cumsum(counts)).tolist()
            nodes = [Node(children=nodes[x:y], sums=one) for x, y, one in zip(cuts[:-1], cuts[1:], sums, strict=True)]
        tree = cls.__new__(cls)
        tree.root = nodes[0]
        return tree


def edited(counter: Counter, tree: Tree, text: str, start: int, removed: int, added: str) -> tuple[str, int]:
    """The text after the edit and the number of pre-tokens encoded anew; the tree is updated."""
    start = min(max(start, 0), len(text))
    stop = min(start + max(removed, 0), len(text))
    after, beyond, shift = text[:start] + added + text[stop:], start + len(added), len(added) - (stop - start)
    # a block has FAN_OUT leaves or fewer after edits, so go back block by block until the context is in
    first, last = tree.block_at(max(start - 1, 0)), tree.block_at(stop)
    leaves, starts = tree.span(first, last)
    while (left := int(np.searchsorted(starts, start)) - 3) < 0 and first:
        first -= 1
        leaves, starts = tree.span(first, last)
    left = max(left, 0)
    fresh, old = [], left
    for match in counter.pattern.finditer(after, int(starts[left])):
        at = match.start() - shift
        if match.start() >= beyond:
            while old == len(leaves) or starts[old] < at:
                if old < len(leaves):
                    old += 1
                elif last + 1 < tree.n_blocks:
                    last += 1
                    leaves, starts = tree.span(first, last)
                else:
                    break
            if old < len(leaves) and starts[old] == at:
                break
        fresh.append(match[0])
    else:
        last, old = tree.n_blocks - 1, None
    tail = leaves[old:] if old is not None else leaves[:0]
    tree.put(first, last, np.concatenate([leaves[:left], counter.leaves(fresh), tail]))
    return after, len(fresh)


def with_trees(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id, text (null: empty) and `tree`: each text's pre-tokens counted once, to be stored."""
    with open(rank_file, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: its size doesn't grow with the data
    schema = arrow_schema("doc_id long, text string, tree binary")

    def run(batches):
        counter = _counter(ranks.value, pattern)
        for batch in batches:
            for part in slices(batch):
                trees = [counter.tree(text).to_bytes() for text in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(trees, pa.binary())], schema=schema)

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, text string, tree binary")


def edited_counts(docs: DataFrame, rank_file: str, pattern: str, tree: str | None = None) -> DataFrame:
    """For each row of docs (doc_id, text, edits, and a stored tree in the column that `tree` names): n_tokens after its edits, n_tokens_before,
    n_pretokens, n_reencoded (pre-tokens encoded anew by edits) and the tree to store.

    edits: an array of EDIT, in any order; null: none. with_edits() makes it from a table of edits.
    """
    with open(rank_file, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: its size doesn't grow with the data
    schema = arrow_schema(_DDL)

    def run(batches):
        counter = _counter(ranks.value, pattern)
        for batch in batches:
            for part in slices(batch):
                rows = []
                for text, edits, stored in zip(*(part.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                    tree, again = counter.tree(text) if stored is None else Tree.from_bytes(stored), 0
                    before = tree.n_tokens
                    for edit in sorted(edits or (), key=lambda x: x["seq"]):
                        text, n = edited(counter, tree, text, edit["start"], edit["removed"], edit["added"] or "")
                        again += n
                    rows.append((tree.n_tokens, before, sum(len(block.leaves) for block in tree.blocks()), again, tree.to_bytes()))
                yield pa.record_batch([part.column(0), *(pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(schema)[1:], strict=True))], schema=schema)

    stored = (F.col(tree) if tree else F.lit(None)).cast("binary").alias("tree")
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("edits").cast(f"array<{EDIT}>"), stored).mapInArrow(run, _DDL)


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """doc_id and text of docs, and `edits`: their edits (a table of doc_id, seq, start, removed, added) as an array."""
    edit = F.struct(F.col("seq").cast("int").alias("seq"), F.col("start").cast("long").alias("start"), F.col("removed").cast("long").alias("removed"), F.col("added").cast("string").alias("added"))
    return docs.select("doc_id", "text").join(edits.groupBy("doc_id").agg(F.collect_list(edit).alias("edits")), "doc_id", "left")


def derived_edits(docs: DataFrame, tree: str | None = None) -> DataFrame:
    """doc_id, text (and tree) of docs, and `edits`: three each, from their own texts: a piece copied in, a stretch cut out, an end of line put in."""
    size = F.char_length(F.coalesce("text", F.lit("")))
    at = lambda salt: F.pmod(F.xxhash64("doc_id", F.lit(salt)), size + 1).cast("long")
    edit = lambda seq, start, removed, added: F.struct(F.lit(seq).alias("seq"), start.alias("start"), F.lit(removed).cast("long").alias("removed"), added.alias("added"))
    piece = F.coalesce(F.substring("text", at(0).cast("int"), 40), F.lit(""))
    return docs.select("doc_id", "text", *((tree,) if tree else ()), F.array(edit(0, at(1), 0, piece), edit(1, at(2), 25, F.lit("")), edit(2, at(3), 3, F.lit(" 42's\n\n end"))).alias("edits"))
