"""Byte-level BPE by a segment tree over adjacent pair ranks.

A text is cut at the tokenizer's added tokens and then into pre-tokens by its pattern. The leaves of a pre-token's tree
hold the ranks of its adjacent pairs; the root tells the leftmost pair of lowest rank. A merge changes three leaves and
the paths above them, and the pre-token is done when the root holds no rank. A pre-token of n bytes so takes
O(n log n) steps, however long it is. New pre-tokens of up to 64 bytes have their trees side by side in arrays, one array
for all trees of a size, and every step merges one pair in each; longer ones have a tree of their own. Results of
pre-tokens are kept in a table of bounded size per task.

Defined cases: null text is the empty text, which has no ids; every text is encoded whole; repeated rows repeat;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from auditspark.llm.common import map_batches, tokenizer_path

#: The pre-token pattern of byte-level BPE (fixed value); \s is spelled out as Unicode white space.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + SPACE + r"\p{L}\p{N}]+|[" + SPACE + r"]+(?![^" + SPACE + r"])|[" + SPACE + r"]+")
#: Pre-tokens whose ids a task remembers; a full table becomes the older of two, which changes no result.
CACHE = 200_000
#: Characters of the texts whose pre-tokens are looked up together (one text at least).
TOGETHER = 1_000_000
NONE = 1 << 40
#: Most leaves of a tree in the arrays, and the entry of a pair there that can't be merged (others are rank * WIDEST + leaf).
WIDEST, NO_PAIR = 64, 2**31 - 1


class PairTree:
    """Minimum of the pair ranks, with the leftmost position of it."""

    def __init__(self, ranks: list[int]):
        self.size = size = 1 << max(0, len(ranks) - 1).bit_length()
        self.nodes = nodes = [NONE] * size + ranks + [NONE] * (size - len(ranks))
        for i in range(size - 1, 0, -1):
            nodes[i] = min(nodes[2 * i], nodes[2 * i + 1])

    def set(self, leaf: int, rank: int) -> None:
        nodes, i = self.nodes, self.size + leaf
        nodes[i] = rank
        while i > 1:
            i >>= 1
            low = min(nodes[2 * i], nodes[2 * i + 1])
            if nodes[i] == low:
                break
            nodes[i] = low

    def lowest(self) -> int:
        """Leaf of the leftmost lowest rank; -1 if no pair can be merged."""
        nodes, i = self.nodes, 1
        low = nodes[1]
        if low == NONE:
            return -1
        while i < self.size:
            i = 2 * i if nodes[2 * i] == low else 2 * i + 1
        return i - self.size


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself, or the next free one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


class ByteBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.first = [vocab[c] for c in letters]  # id of each single byte
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        to_byte = {c: b for b, c in enumerate(letters)}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.pieces = [b""] * size
        for token, i in vocab.items():
            self.pieces[i] = bytes(to_byte[c] for c in token)
        for token, i in self.added.items():
            self.pieces[i] = token.encode()
        self.split_added = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.words = regex.compile(PATTERN)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.base = size
        made = sorted((a * size + b, rank, new) for (a, b), (rank, new) in self.merges.items())
        self.pair_keys, self.pair_ranks = (np.array([m[i] for m in made] or [-1], np.int64) for i in (0, 1))
        self.made_by = np.zeros(len(made), np.int32)
        self.made_by[self.pair_ranks[:len(made)]] = [m[2] for m in made]
        self.first_ids = np.array(self.first, np.int32)

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        ids = [self.first[b] for b in word]
        n, merges = len(ids), self.merges
        if n < 2:
            return ids
        found = merges.get
        ranks = [found(p, (NONE,))[0] for p in zip(ids, ids[1:])]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = PairTree(ranks)
        while (i := tree.lowest()) >= 0:
            j = after[i]
            ids[i] = merges[ids[i], ids[j]][1]
            ids[j] = -1
            k = after[i] = after[j]
            if j < n - 1:
                tree.set(j, NONE)
            if k < n:
                before[k] = i
                tree.set(i, found((ids[i], ids[k]), (NONE,))[0])
            else:
                tree.set(i, NONE)
            if (h := before[i]) >= 0:
                tree.set(h, found((ids[h], ids[i]), (NONE,))[0])
        return [x for x in ids if x >= 0]

    def _entries(self, left: np.ndarray, right: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """Tree entries of pairs: their rank and, to tell the leftmost, their leaf."""
        key = left.astype(np.int64) * self.base + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at] * WIDEST + leaf, NO_PAIR).astype(np.int32)

    def merge_side_by_side(self, words: list[bytes], size: int) -> list[bytes]:
        """Ids of pre-tokens of at most *size* bytes, a power of two; row i of every array belongs to words[i]."""
        n, lengths = len(words), np.array([len(w) for w in words])
        place = np.arange(size)
        ids = self.first_ids[np.frombuffer(b"".join(w.ljust(size, b"\0") for w in words), np.uint8)].reshape(n, size)
        after = np.tile(np.arange(1, size + 1, dtype=np.int32), (n, 1))
        before = np.tile(np.arange(-1, size, dtype=np.int32), (n, 1))
        nodes = np.full((n, 2 * size), NO_PAIR, np.int32)
        pairs = self._entries(ids[:, :-1], ids[:, 1:], place[:-1])
        nodes[:, size:-1] = np.where(place[1:] < lengths[:, None], pairs, NO_PAIR)
        width = size
        while width > 1:
            nodes[:, width // 2:width] = np.minimum(nodes[:, width:2 * width:2], nodes[:, width + 1:2 * width:2])
            width //= 2
        rows = np.flatnonzero(nodes[:, 1] != NO_PAIR)
        while len(rows):
            low = nodes[rows, 1]
            i, new = low % WIDEST, self.made_by[low // WIDEST]
            j = after[rows, i]
            k, h = after[rows, j], before[rows, i]
            ids[rows, i], ids[rows, j] = new, -1
            after[rows, i], before[rows, k] = k, i
            right = np.where(k < lengths[rows], self._entries(new, ids[rows, np.minimum(k, size - 1)], i), NO_PAIR)
            left = np.where(h >= 0, self._entries(ids[rows, h], new, h), right)
            paths = [size + j, size + i, size + np.where(h >= 0, h, i)]
            for leaf, entry in zip(paths, (NO_PAIR, right, left)):
                nodes[rows, leaf] = entry
            width = size
            while width > 1:
                width //= 2
                for step, at in enumerate(paths):
                    paths[step] = at = at >> 1
                    nodes[rows, at] = np.minimum(nodes[rows, 2 * at], nodes[rows, 2 * at + 1])
            rows = rows[nodes[rows, 1] != NO_PAIR]
        kept = (ids >= 0) & (place < lengths[:, None])
        flat, ends = ids[kept].astype("<u4").tobytes(), np.cumsum(kept.sum(axis=1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]

    def merge_all(self, words: list[str]) -> dict[str, bytes]:
        """Ids of every pre-token."""
        out, by_size = {}, {}
        for word in words:
            raw = word.encode()
            if len(raw) > WIDEST:
                out[word] = np.array(self.merge(raw), "<u4").tobytes()
            else:
                by_size.setdefault(max(2, 1 << (len(raw) - 1).bit_length()), []).append((word, raw))
        for size, some in by_size.items():
            out.update(zip((w for w, _ in some), self.merge_side_by_side([r for _, r in some], size)))
        return out

    def _table(self, words: set[str]) -> dict[str, bytes]:
        """A table that holds the ids of all these pre-tokens."""
        known = self.known
        missing = words - known.keys()
        again = {w: self.older[w] for w in missing if w in self.older}
        known.update(again)
        known.update(self.merge_all([w for w in missing if w not in again]))
        if len(known) > CACHE:
            self.known, self.older = {}, known
        return known

    def _cut(self, text: str) -> list[list[str] | bytes]:
        """Runs of pre-tokens, and the ids of the added tokens between them."""
        if self.split_added is None or not any(t in text for t in self.added):
            return [self.words.findall(text)]
        out, at = [], 0
        for m in self.split_added.finditer(text):
            out += [self.words.findall(text[at:m.start()]), np.array([self.added[m[0]]], "<u4").tobytes()]
            at = m.end()
        return [*out, self.words.findall(text[at:])]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit integers."""
        out, at = [], 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end]) <= TOGETHER):
                chars += len(texts[end])
                end += 1
            cuts = [self._cut(t) for t in texts[at:end]]
            table = self._table({w for cut in cuts for run in cut if isinstance(run, list) for w in run})
            out += [b"".join(run if isinstance(run, bytes) else b"".join(map(table.__getitem__, run)) for run in cut) for cut in cuts]
            at = end
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        """Bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def encoded(docs: DataFrame, name: str = "byte_bpe_50k.json", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and ids (little-endian unsigned 32-bit) and decoded if *with_ids*."""
    path = tokenizer_path(name)

    def rows(batch: pa.RecordBatch, bpe: ByteBpe) -> pa.RecordBatch:
        ids = bpe.encode_all([t or "" for t in batch.column(1).to_pylist()])
        texts = [bpe.decode(x) for x in ids]
        cols = {"doc_id": batch.column(0), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                "decoded_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts])}
        if with_ids:
            cols |= {"ids": pa.array(ids, pa.binary()), "decoded": pa.array(texts, pa.string())}
        return pa.RecordBatch.from_pydict(cols)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * with_ids
    return map_batches(docs.select("doc_id", "text"), rows, schema, lambda: ByteBpe(path))
