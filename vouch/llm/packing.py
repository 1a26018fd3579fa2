"""Sum-of-squares online packing of tokenised documents into fixed-length sequences.

Each partition packs its documents in the order in which they come. Full windows of a long document become sequences of
their own; what is left of it goes to the fill level that keeps the sum of squared counts of partially filled windows
least. The counts stand in a level array, one entry for each fill level. When a partition ends (or has more than
`most_open` open windows), the emptiest windows are cut up to fill the fullest, and the last remainder is cut into
lengths that are powers of two, which need no padding. So a partition leaves no padding, whatever its size, and no
shuffle is needed: a sequence never spans two partitions.

Tokens: the ids that the library gives each text without special tokens added, then `end_id`. The tokenizer drops white
space and never merges across it, so the ids of the words at spaces and line ends, concatenated, are those of the text;
a Python worker keeps the ids of words it has seen (up to `KNOWN_WORDS`, then it starts anew). Texts that hold the
string of an added token, which the library reads as that token, go through it whole. Null and empty texts have the end
id alone. Rows that repeat a doc_id are packed each on their own. An empty table has no pieces.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame

from vouch.llm.common import arrow_schema, slices, thrifty, whole_texts

KNOWN_WORDS, KNOWN_PIECES = 200_000, 150_000
_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Sequence ids of a partition: its number in the bits above these.
_LOCAL_BITS = 36


class WordTokens:
    """Ids of whole texts by a tokenizer that drops white space, with the ids of known words and pre-tokens kept.

    Where the tokenizer normalises by NFC and lower case and splits by one pattern into byte-level pre-tokens, words of
    Latin letters are split here and only their new pre-tokens go to its model; all other words go through it whole.
    """

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.tokenizer, config = Tokenizer.from_str(tokenizer_json), json.loads(tokenizer_json)
        self.model, self.pattern = self.tokenizer.model, _split_pattern(config)
        self.added = [x["content"].lower() for x in config.get("added_tokens") or []]
        self.known: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        whole = {i for i, text in enumerate(texts) if self._has_added(text)}
        found = iter(self._by_words([text for i, text in enumerate(texts) if i not in whole]))
        return [np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes() if i in whole else next(found) for i, text in enumerate(texts)]

    def _has_added(self, text: str) -> bool:
        low = text.lower()
        return any(content in low for content in self.added)

    def _by_words(self, texts: list[str]) -> list[bytes]:
        words = [self._words(text) for text in texts]
        if missing := set().union(*words).difference(self.known):
            if len(self.known) + len(missing) > KNOWN_WORDS:
                self.known, missing = {}, set().union(*words)
            self._learn(missing)
        return [b"".join(map(self.known.__getitem__, found)) for found in words]

    @staticmethod
    def _words(text: str) -> list[str]:
        # up to U+00FF the normal form changes nothing, and lower-casing is the tokenizer's own, letter by letter
        if not _BEYOND.search(text):
            text = text.lower()
        return text.replace("\n", " ").split(" ")

    def _learn(self, words: set[str]) -> None:
        rest = []
        if len(self.pieces) > KNOWN_PIECES:
            self.pieces.clear()
        for word in words:
            if self.pattern and _LATIN.fullmatch(word):
                self.known[word] = b"".join([self.pieces.get(piece) or self._piece(piece) for piece in self.pattern.findall(word)])
            else:
                rest.append(word)
        if rest:
            self._whole(rest)

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces[piece] = array("I", [token.id for token in self.model.tokenize(piece.encode().decode("latin-1").translate(_BYTE_LEVEL))]).tobytes()
        return ids

    def _whole(self, words: list[str]) -> None:
        """One call for all words: a token belongs to the word in which it starts."""
        found = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        ids = np.array(found.ids, "<u4").tobytes()
        at = np.array(found.offsets, np.int64).reshape(-1, 2)[:, 0]
        starts = np.cumsum([0, *(len(word) + 1 for word in words)])
        ends = 4 * np.searchsorted(at, starts)
        for word, a, b in zip(words, ends[:-1], ends[1:], strict=True):
            self.known[word] = ids[a:b]


_BEYOND = re.compile("[^\\x00-\xff]")
#: Lower-case Latin words with their marks: no letter here changes under NFC or the tokenizer's lower-casing.
_LATIN = re.compile("[!-@\\[-~¡-¿ß-öø-ÿ÷]*")


def _byte_level() -> dict[int, str]:
    """The printable stand-ins of byte-level vocabularies: printable bytes stand for themselves, the others for U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


_BYTE_LEVEL = _byte_level()


def _split_pattern(config: dict) -> regex.Pattern | None:
    """The split pattern of a tokenizer of the kind that WordTokens knows, else nothing."""
    normalizers = [x.get("type") for x in (config.get("normalizer") or {}).get("normalizers", [])]
    steps = (config.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if normalizers != ["NFC", "Replace", "Lowercase"] or [x.get("type") for x in steps] != ["Split", "ByteLevel"]:
        return None
    split, level = steps
    if split.get("behavior") != "Removed" or not split.get("invert") or level.get("add_prefix_space") or level.get("use_regex"):
        return None
    return regex.compile(split["pattern"]["Regex"])


@cache
def _tokens(tokenizer_json: str) -> WordTokens:
    return WordTokens(tokenizer_json)


class Packer:
    """Open windows by fill level, and the pieces of closed ones.

    A piece: (doc_id, start, ids, doc_tokens). A closed window: its pieces in order.
    """

    def __init__(self, length: int, most_open: int):
        self.length, self.most_open = length, most_open
        self.levels = np.zeros(length + 1, np.int64)  # N(h): open windows filled to h
        self.windows: dict[int, list[list[tuple]]] = defaultdict(list)
        self.n_open = 0

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[list[tuple]]:
        n, size = len(ids) // 4, self.length
        whole = n - n % size
        for start in range(0, whole, size):
            yield [(doc_id, start, ids[4 * start : 4 * (start + size)], n)]
        if whole < n:
            yield from self._place((doc_id, whole, ids[4 * whole :], n), n - whole)
        if self.n_open > self.most_open:
            yield from self._filled(self._take_all(), last=False)

    def _place(self, piece: tuple, size: int) -> Iterator[list[tuple]]:
        """Raising a window from h to h + size changes the sum of squares by 2 N(h + size) - 2 N(h) + 2; a new one (h = 0) by 2 N(size) + 1; one that becomes full by 1 - 2 N(h)."""
        counts = self.levels
        change = 2 * counts[size : self.length] - 2 * counts[: self.length - size] + 2
        change[counts[: self.length - size] == 0] = np.iinfo(np.int64).max
        change = np.append(change, 1 - 2 * counts[self.length - size] if counts[self.length - size] else np.iinfo(np.int64).max)
        change[0] = 2 * counts[size] + 1
        # of equal changes the fullest window
        h = len(change) - 1 - int(np.argmin(change[::-1]))
        window = self._take(h) if h else []
        window.append(piece)
        if h + size == self.length:
            yield window
        else:
            self._put(window, h + size)

    def _take(self, h: int) -> list[tuple]:
        self.levels[h] -= 1
        self.n_open -= 1
        return self.windows[h].pop()

    def _put(self, window: list[tuple], h: int) -> None:
        self.levels[h] += 1
        self.n_open += 1
        self.windows[h].append(window)

    def _take_all(self) -> list[list[tuple]]:
        return [self._take(h) for h in np.flatnonzero(self.levels)[::-1] for _ in range(self.levels[h])]

    def finish(self) -> Iterator[list[tuple]]:
        yield from self._filled(self._take_all(), last=True)

    def _filled(self, windows: list[list[tuple]], last: bool) -> Iterator[list[tuple]]:
        """windows, fullest first: the pieces of the emptiest, cut where need be, fill up the fullest."""
        pool: list[tuple] = []
        while windows:
            window = windows.pop(0)
            room = self.length - sum(len(p[2]) // 4 for p in window)
            while room and (pool or windows):
                if not pool:
                    pool = windows.pop()
                doc_id, start, ids, n = pool.pop()
                cut = min(room, len(ids) // 4)
                window.append((doc_id, start, ids[: 4 * cut], n))
                if 4 * cut < len(ids):
                    pool.append((doc_id, start + cut, ids[4 * cut :], n))
                room -= cut
            if not room:
                yield window
            elif last:
                yield from self._powers_of_two(window)
            else:
                self._put(window, self.length - room)
            if pool and not windows:
                windows, pool = [pool], []

    @staticmethod
    def _powers_of_two(window: list[tuple]) -> Iterator[list[tuple]]:
        left, rest = sum(len(p[2]) // 4 for p in window), window[::-1]
        while left:
            size = room = 1 << (left.bit_length() - 1)
            part = []
            while room:
                doc_id, start, ids, n = rest.pop()
                cut = min(room, len(ids) // 4)
                part.append((doc_id, start, ids[: 4 * cut], n))
                if 4 * cut < len(ids):
                    rest.append((doc_id, start + cut, ids[4 * cut :], n))
                room -= cut
            yield part
            left -= size


def packed(docs: DataFrame, tokenizer_file: str, end_id: int = 2, length: int = 4096, most_open: int = 512, with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and its ids if asked for."""
    with open(tokenizer_file, encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())  # its size doesn't grow with the data
    ddl = _DDL + ", ids binary" * with_ids
    schema, end = arrow_schema(ddl), np.array([end_id], "<u4").tobytes()

    def run(batches):
        tokens, packer = _tokens(vocabulary.value), Packer(length, most_open)
        number = TaskContext.get().partitionId() << _LOCAL_BITS
        rows: list[tuple] = []

        def keep(windows):
            nonlocal number
            for window in windows:
                offset = 0
                for doc_id, start, ids, n in window:
                    rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), n, number, offset, *[ids] * with_ids))
                    offset += len(ids) // 4
                number += 1

        def batch_of_rows():
            out = pa.record_batch([pa.array(column, field.type) for column, field in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            rows.clear()
            return out

        for batch in batches:
            for part in slices(batch):
                for doc_id, ids in zip(part.column(0).to_pylist(), tokens.encode(part.column(1).to_pylist()), strict=True):
                    keep(packer.add(doc_id, ids + end))
                if rows:
                    yield batch_of_rows()
        keep(packer.finish())
        if rows:
            yield batch_of_rows()

    return whole_texts(docs).mapInArrow(thrifty(run), ddl)
