"""Byte-level BPE: encoding by segment trees over the ranks of adjacent pairs, and decoding.

A word is a row of symbols. The tree's leaf i holds the rank of the pair that begins at symbol i (and i itself, so equal
ranks keep their order); a node holds the smaller of its two children. The root therefore names the leftmost pair of
lowest rank. A merge changes three leaves, each in a logarithmic number of steps, and the word is done when the root
holds no pair. Words of a batch that are not known yet are merged together, one row of a matrix each; a long word has a
tree of its own.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepost.llm.frames import free_name, whole, with_fields

# The pattern that cuts a text into words before the merges, with white space by its Unicode property.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""

# The same cut for texts of characters up to U+02AF, where letters, numbers and white space can be listed.
LATIN_TEXT = re.compile("[\x00-\u02af]*")
_LETTERS, _NUMBERS, _SPACES = "A-Za-zªµºÀ-ÖØ-öø-\u02af", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
LATIN_WORDS = re.compile(
    f" ?[{_LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{_NUMBERS}]+| ?[^{_SPACES}{_LETTERS}{_NUMBERS}]+"
    f"|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"
)

NO_PAIR = np.int32(2**31 - 1)
#: Words up to so many bytes are merged in a matrix; longer ones alone.
MATRIX_BYTES = 64
#: So many words are merged in one matrix.
MATRIX_ROWS = 4096
#: Bytes that the words a worker remembers may take, roughly, before it starts anew; longer words are never remembered.
REMEMBERED_BYTES, REMEMBERED_LETTERS, WORD_BYTES = 64 << 20, 256, 200


def printable_bytes() -> list[str]:
    """The character that stands for each byte: itself where it prints, else the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names, free = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in names:
            names[b], free = chr(free), free + 1
    return [names[b] for b in range(256)]


class Vocabulary:
    """The tables of a byte-level BPE file: pair ranks, merged symbols, bytes of each id, special tokens."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            read = json.load(file)
        ids, names = read["model"]["vocab"], printable_bytes()
        byte_of = {c: b for b, c in enumerate(names)}
        self.first = np.array([ids[c] for c in names], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ", 1) for m in read["model"]["merges"]]
        self.width = max(ids.values()) + 2
        left, right = (np.array([ids[p[i]] for p in pairs], np.int64) for i in (0, 1))
        order = np.argsort(left * self.width + right)
        self.keys, self.ranks = (left * self.width + right)[order], order.astype(np.int32)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int32)
        bytes_ = np.arange(65536)
        self.byte_ranks = self.pair_ranks(self.first[bytes_ >> 8], self.first[bytes_ & 255])
        self.rank_of = dict(zip((left * self.width + right).tolist(), range(len(pairs)), strict=True))
        self.specials = {t["content"]: t["id"] for t in read.get("added_tokens", []) if t["content"]}
        self.bytes_of = {i: bytes(byte_of[c] for c in s) for s, i in ids.items() if all(c in byte_of for c in s)}
        self.bytes_of |= {i: s.encode() for s, i in self.specials.items()}
        self.any_words = regex.compile(WORD_PATTERN)
        by_length = sorted(self.specials, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, by_length)) + ")") if by_length else None
        self.known: dict[str, bytes] = {}
        self.held = 0

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, ``NO_PAIR`` where a pair has none or a side is missing (-1)."""
        key = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], NO_PAIR)

    def merge_matrix(self, words: list[bytes]) -> list[bytes]:
        """Ids of short words, as little-endian 32-bit integers; one segment tree a row.

        All matrices are kept flat: cell (row, i) of the symbols is row * (size + 1) + i, where column ``size`` stands for
        "no neighbour", and node (row, i) of the trees is row * 2 * size + i.
        """
        rows, size = len(words), 4
        while size < max(map(len, words)):
            size *= 2
        wide = size + 1
        cells = np.arange(wide, dtype=np.int32)
        raw = np.zeros((rows, wide), np.uint8)
        length = np.array([len(w) for w in words], np.int32)[:, None]
        there = cells < length
        raw[there] = np.frombuffer(b"".join(words), np.uint8)
        symbol = np.where(there, self.first[raw], -1).astype(np.int32).ravel()
        after = np.where(cells + 1 < length, cells + 1, size).astype(np.int32).ravel()
        before = np.where((cells > 0) & there, cells - 1, size).astype(np.int32).ravel()
        tree = np.full((rows, 2 * size), NO_PAIR, np.int32)
        rank = self.byte_ranks[raw[:, :-2].astype(np.int32) * 256 + raw[:, 1:-1]]
        tree[:, size : 2 * size - 1] = np.where((cells[1:-1] < length) & (rank < NO_PAIR), rank * size + cells[:-2], NO_PAIR)
        level = size
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        tree = tree.ravel()
        active = np.flatnonzero(tree[1 :: 2 * size] < NO_PAIR)
        while len(active):
            row, base = active * wide, active * (2 * size)
            root = tree[base + 1]
            here, rank = root % size, root // size
            gone = after[row + here]
            next_ = after[row + gone]
            last = before[row + here]
            new = self.merged[rank]
            symbol[row + here] = new
            symbol[row + gone] = -1
            after[row + here] = next_
            before[row + next_] = here
            tree[base + size + gone] = NO_PAIR
            tree[base + size + here] = self.leaf(new, symbol[row + next_], here, size)
            has = last < size
            tree[(base + size + last)[has]] = self.leaf(symbol[row + last], new, last, size)[has]
            leaves = np.concatenate([base + gone, base + here, (base + last)[has]])
            # Node n of a tree lies at base + n; a leaf's node is size + leaf, its ancestors are halves of that.
            node = np.concatenate([gone, here, last[has]]) + size
            base = leaves - (node - size)
            while node[0] > 1:
                node = node >> 1
                tree[base + node] = np.minimum(tree[base + 2 * node], tree[base + 2 * node + 1])
            active = active[tree[active * (2 * size) + 1] < NO_PAIR]
        symbol = symbol.reshape(rows, wide)[:, :-1]
        left = symbol >= 0
        joined = symbol[left].astype("<u4").tobytes()
        ends = np.cumsum(left.sum(axis=1)) * 4
        return [joined[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def leaf(self, left: np.ndarray, right: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        """Leaf values of pairs of symbols that begin at cells ``at``."""
        rank = self.pair_ranks(left, right)
        return np.where(rank < NO_PAIR, rank * size + at, NO_PAIR)

    def merge_long(self, word: bytes) -> bytes:
        """Ids of one word of any length, by a segment tree of its own."""
        symbol = self.first[np.frombuffer(word, np.uint8)].tolist()
        count, size = len(symbol), 1
        while size < count:
            size *= 2
        # "No pair" lies above every leaf, so that words of any length keep all their merges.
        none, width, rank_of = len(self.merged) * size, self.width, self.rank_of
        tree = [none] * (2 * size)
        for i in range(count - 1):
            rank = rank_of.get(symbol[i] * width + symbol[i + 1])
            if rank is not None:
                tree[size + i] = rank * size + i
        for node in range(size - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        after, before = list(range(1, count + 1)), list(range(-1, count))

        def put(leaf: int, value: int) -> None:
            node = leaf + size
            tree[node] = value
            while node > 1:
                node >>= 1
                low = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == low:
                    break
                tree[node] = low

        def pair(i: int, j: int) -> int:
            rank = rank_of.get(symbol[i] * width + symbol[j]) if i >= 0 and j < count else None
            return none if rank is None else rank * size + i

        while tree[1] < none:
            rank, here = divmod(tree[1], size)
            gone = after[here]
            symbol[here] = int(self.merged[rank])
            symbol[gone] = -1
            after[here] = after[gone]
            if after[gone] < count:
                before[after[gone]] = here
            put(gone, none)
            put(here, pair(here, after[here]))
            if before[here] >= 0:
                put(before[here], pair(before[here], here))
        return np.array([s for s in symbol if s >= 0], "<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        """Encode words that are not known yet, shortest first, so that rows of a matrix are of like length."""
        todo = sorted(((w, w.encode("utf-8")) for w in words), key=lambda x: len(x[1]))
        at = 0
        while at < len(todo) and len(todo[at][1]) <= MATRIX_BYTES:
            end = at
            while end < len(todo) and end - at < MATRIX_ROWS and len(todo[end][1]) <= max(8, len(todo[at][1]) * 2):
                end += 1
            part = todo[at:end]
            for (word, _), ids in zip(part, self.merge_matrix([b for _, b in part]), strict=True):
                self.known[word] = ids
            at = end
        for word, raw in todo[at:]:
            self.known[word] = self.merge_long(raw)

    def split(self, text: str) -> list[str]:
        """The words of a text, white space and all."""
        return (LATIN_WORDS if LATIN_TEXT.fullmatch(text) else self.any_words).findall(text)

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        if self.held > REMEMBERED_BYTES:
            self.known, self.held = {}, 0
        cut = [self.cut.split(t) if self.cut and any(s in t for s in self.specials) else [t] for t in texts]
        found = [[self.split(part) for part in parts[::2]] for parts in cut]
        new = set()
        for parts in found:
            for part in parts:
                new.update(part)
        fresh = [w for w in new if w not in self.known]
        self.learn(fresh)
        self.held += sum(WORD_BYTES + 2 * len(w) for w in fresh)
        out, known = [], self.known
        for parts, split in zip(cut, found, strict=True):
            ids = [b"".join(map(known.__getitem__, split[0]))]
            for special, part in zip(parts[1::2], split[1:], strict=True):
                ids.append(self.specials[special].to_bytes(4, "little"))
                ids.append(b"".join(map(known.__getitem__, part)))
            out.append(b"".join(ids))
        for word in fresh:
            if len(word) > REMEMBERED_LETTERS:
                del known[word]
                self.held -= WORD_BYTES + 2 * len(word)
        return out

    def decode_ids(self, packed: bytes) -> str:
        """The text of packed ids; ids out of the vocabulary give nothing, bytes that are no UTF-8 give U+FFFD."""
        return b"".join([self.bytes_of.get(i, b"") for i in np.frombuffer(packed, "<u4").tolist()]).decode("utf-8", "replace")


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, read once by each worker."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


#: Texts of about so many characters are cut into words at a time.
GROUP_CHARS = 4_000_000


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = "decoded") -> DataFrame:
    """All columns of ``docs`` and the ids of each whole text (binary, little-endian unsigned 32-bit integers), without
    added special tokens; the strings of special tokens inside a text become their ids. With ``decoded``, also the text
    that those ids give back. ``path`` is the vocabulary file as the workers see it.

    A null text counts as empty and has no ids. Repeated rows stay repeated. Names that ``docs`` has already are taken
    with underscores in front.
    """
    ids = free_name(docs, ids)
    decoded = free_name(docs, decoded) if decoded else None
    fed = free_name(docs, "bpe_text")
    source = docs.withColumn(fed, whole(docs[f"`{text}`"].cast("string")))
    schema = with_fields(docs, **{ids: "binary"}, **({decoded: "string"} if decoded else {}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(fed))
            begin = 0
            for end in _ends(column):
                texts = column.slice(begin, end - begin).to_pylist()
                packed = words.encode_texts(texts)
                part = batch.slice(begin, end - begin).drop_columns([fed])
                arrays = [*part.columns, pa.array(packed, pa.binary())]
                names = [*part.schema.names, ids]
                if decoded:
                    arrays.append(pa.array([words.decode_ids(p) for p in packed], pa.string()))
                    names.append(decoded)
                yield pa.RecordBatch.from_arrays(arrays, names)
                begin = end

    return source.mapInArrow(run, schema)


def _ends(column: pa.Array) -> Iterator[int]:
    """Where to cut a column of texts so that each part has about ``GROUP_CHARS`` bytes."""
    size = 0
    for i, n in enumerate(pc.binary_length(column).to_pylist(), 1):
        size += n
        if size >= GROUP_CHARS or i == len(column):
            yield i
            size = 0


def digests(encoded: DataFrame, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of ids and decoded text, for ``encode``'s result."""
    return encoded.select(
        "doc_id",
        (F.length(ids) / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col(ids), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded).cast("binary"), 256).alias("decoded_sha256"),
    )
