"""Token counts that survive edits.

For each document a segment tree is kept over its pre-tokens: a leaf has a pre-token's length in code points and its
number of tokens, every node the sums of its two halves. An edit (position, deleted code points, inserted text) goes down
the tree to the pre-tokens it touches, steps back over those whose match may have looked at the edited place, encodes
from there until the new cuts meet an old one behind the edit, puts the new pre-tokens in the first of the replaced
leaves, empties the others and updates the sums above them. A leaf may so hold a list of pre-tokens. The total is the root.

Why that is enough: the pattern looks at most LOOK code points beyond the end of a match and never back, so pre-tokens
that end LOOK or more before the edit stay, and once a new cut behind the edit equals an old one, the rest is the same.

Defined cases: null text is the empty text with no pre-tokens and 0 tokens; positions are cut to the text's length, a
null edit list changes nothing and null parts of an edit are 0 or empty; edits apply one after another, each to the result
of those before; repeated rows repeat; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspark.llm.bpe_segment_tree import CACHE, PATTERN
from auditspark.llm.common import map_batches, tokenizer_path

#: Code points behind a match that decide it: two for "'re", two for white space before a word.
LOOK = 2
#: A pre-token this long or longer is counted without being remembered.
LONG_WORD = 64
#: Rows handled at a time, which bounds a task's memory.
SLICE = 500


class Counter(dict):
    """Number of tokens of a pre-token, by the tiktoken library; remembers short ones."""

    def __init__(self, path: str):
        import tiktoken

        super().__init__()
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        # special tokens' strings are ordinary text here, so that every cut is the pattern's
        self.encoding = tiktoken.Encoding("pre-tokens", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.words = regex.compile(PATTERN)

    def __missing__(self, word: str) -> int:
        n = len(self.encoding.encode_ordinary(word))
        if len(word) < LONG_WORD:
            if len(self) >= CACHE:
                self.clear()
            self[word] = n
        return n

    def leaves(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and token counts of a text's pre-tokens."""
        words = self.words.findall(text)
        return (np.fromiter(map(len, words), np.int32, len(words)), np.fromiter(map(self.__getitem__, words), np.int32, len(words)))


class SegmentTree:
    """Sums of lengths and counts over leaves that hold lists of pre-tokens."""

    def __init__(self, lengths: np.ndarray, counts: np.ndarray):
        n = max(1, len(lengths))
        self.size = 1 << (n - 1).bit_length()
        self.sums = np.zeros((2, 2 * self.size), np.int64)
        self.sums[:, self.size:self.size + len(lengths)] = lengths, counts
        level = self.size
        while level > 1:
            below = self.sums[:, level:2 * level]
            level //= 2
            self.sums[:, level:2 * level] = below[:, ::2] + below[:, 1::2]
        self.lists: dict[int, tuple[list[int], list[int]]] = {}  # leaves that don't hold exactly one pre-token

    @property
    def length(self) -> int:
        return int(self.sums[0, 1])

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def leaf(self, i: int) -> tuple[list[int], list[int]]:
        if i in self.lists:
            return self.lists[i]
        length, count = self.sums[:, self.size + i].tolist()
        return ([length], [count]) if length else ([], [])

    def put(self, i: int, lengths: list[int], counts: list[int]) -> None:
        self.lists[i] = (lengths, counts)
        at = self.size + i
        change = np.array([sum(lengths), sum(counts)]) - self.sums[:, at]
        while at:
            self.sums[:, at] += change
            at >>= 1

    def find(self, position: int) -> tuple[int, int]:
        """The leaf in which the code point at *position* lies (the last filled one for the end), and where it starts."""
        at, start, sums = 1, 0, self.sums[0]
        position = min(position, self.length - 1)
        while at < self.size:
            at *= 2
            if position >= start + sums[at]:
                start += int(sums[at])
                at += 1
        return at - self.size, start

    def edit(self, text: str, position: int, deleted: int, inserted: str, count: Counter) -> tuple[str, int]:
        """Apply an edit of *text*; returns the new text and how many pre-tokens were encoded anew."""
        position = max(0, min(position, len(text)))
        deleted = max(0, min(deleted, len(text) - position))
        new = text[:position] + inserted + text[position + deleted:]
        if not text:
            lengths, counts = count.leaves(new)
            self.put(0, lengths.tolist(), counts.tolist())
            return new, len(lengths)
        first, at = self.find(max(0, position - LOOK))
        start = at
        keep_lengths, keep_counts = [], []  # of the first leaf, what ends LOOK or more before the edit
        for length, n in zip(*self.leaf(first)):
            if start + length + LOOK > position:
                break
            keep_lengths.append(length)
            keep_counts.append(n)
            start += length
        shift, behind = len(inserted) - deleted, position + deleted
        old_leaf, old_at = first, at
        old_lengths, old_counts = self.leaf(first)
        old_index, made_lengths, made_counts, here = 0, [], [], start
        while here < len(new):
            word = count.words.match(new, here)[0]
            made_lengths.append(len(word))
            made_counts.append(count[word])
            here += len(word)
            if here - shift >= behind and here >= position + len(inserted):
                while old_at < here - shift:  # on to the old cut at or behind this one
                    if old_index == len(old_lengths):
                        old_leaf += 1
                        old_lengths, old_counts = self.leaf(old_leaf)
                        old_index = 0
                        continue
                    old_at += old_lengths[old_index]
                    old_index += 1
                if old_at == here - shift:
                    break
        else:
            old_leaf, old_lengths, old_counts = self.size - 1, *self.leaf(self.size - 1)
            old_index = len(old_lengths)
        encoded = len(made_lengths)
        rest = old_lengths[old_index:], old_counts[old_index:]
        for leaf in range(first + 1, old_leaf + 1):
            if self.sums[0, self.size + leaf] or leaf in self.lists:
                self.put(leaf, [], [])
        self.put(first, keep_lengths + made_lengths + rest[0], keep_counts + made_counts + rest[1])
        return new, encoded

    def leaves(self) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and counts of all pre-tokens, in order."""
        single, parts, at = self.sums[:, self.size:].astype(np.int32), [], 0
        for i in [*sorted(self.lists), self.size]:
            between = single[:, at:i]
            parts.append(between[:, between[0] > 0])
            if i < self.size:
                parts.append(np.array(self.lists[i], np.int32).reshape(2, -1))
            at = i + 1
        both = np.concatenate(parts, 1)
        return both[0], both[1]


EDITS = "array<struct<position:int,deleted:int,inserted:string>>"


def trees(docs: DataFrame, name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """The columns of *docs* and the leaves of each text's tree: `leaf_lengths`, `leaf_tokens` (32-bit integers)."""
    path, kept = tokenizer_path(name), [c for c in docs.columns if c not in ("leaf_lengths", "leaf_tokens")]

    def rows(batch: pa.RecordBatch, count: Counter) -> pa.RecordBatch:
        made = [count.leaves(t or "") for t in batch.column(kept.index("text")).to_pylist()]
        more = [pa.array([m[side].tobytes() for m in made], pa.binary()) for side in (0, 1)]
        return pa.RecordBatch.from_arrays([*batch.columns, *more], [*kept, "leaf_lengths", "leaf_tokens"])

    schema = docs.select(*kept).schema.add("leaf_lengths", "binary").add("leaf_tokens", "binary")
    return map_batches(docs.select(*kept), lambda batch, count: (rows(batch.slice(i, SLICE), count) for i in range(0, batch.num_rows, SLICE)), schema, lambda: Counter(path))


def recounted(with_trees: DataFrame, edits: Column, name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """doc_id, n_pretokens, n_tokens before, n_edits, encoded_pretokens, n_tokens_edited, n_chars_edited, and the edited
    text and leaves, from trees and a column of edits."""
    path = tokenizer_path(name)

    def rows(batch: pa.RecordBatch, count: Counter) -> pa.RecordBatch:
        out: dict[str, list] = {k: [] for k in ("n_pretokens", "n_tokens", "n_edits", "encoded_pretokens", "n_tokens_edited", "n_chars_edited", "edited", "lengths", "tokens")}
        for text, lengths, tokens, changes in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
            text, lengths, tokens = text or "", np.frombuffer(lengths, np.int32), np.frombuffer(tokens, np.int32)
            tree, encoded = SegmentTree(lengths, tokens), 0
            before = tree.tokens
            for change in changes or []:
                if change is not None:
                    text, n = tree.edit(text, change["position"] or 0, change["deleted"] or 0, change["inserted"] or "", count)
                    encoded += n
            after = [x.tobytes() for x in tree.leaves()]
            for k, x in zip(out, (len(lengths), before, len(changes or []), encoded, tree.tokens, len(text), text, *after)):
                out[k].append(x)
        kinds = [pa.int64()] * 6 + [pa.string(), pa.binary(), pa.binary()]
        names = [*list(out)[:7], "leaf_lengths", "leaf_tokens"]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(out.values(), kinds))], ["doc_id", *names])

    kind = with_trees.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {kind}, n_pretokens long, n_tokens long, n_edits long, encoded_pretokens long, n_tokens_edited long, n_chars_edited long, "
              "edited string, leaf_lengths binary, leaf_tokens binary")
    return map_batches(with_trees.select("doc_id", "text", "leaf_lengths", "leaf_tokens", edits.cast(EDITS).alias("_edits")),
                       lambda batch, count: (rows(batch.slice(i, SLICE), count) for i in range(0, batch.num_rows, SLICE)), schema, lambda: Counter(path))


def own_edits(text: Column) -> Column:
    """Two edits made of each text itself: forty code points of its middle go to its first third, thirty of its last quarter vanish."""
    n = F.length(text)
    part = lambda share: F.floor(n * share).cast("int")
    edit = lambda p, d, s: F.struct(p.alias("position"), d.cast("int").alias("deleted"), s.alias("inserted"))
    return F.array(edit(part(1 / 3), F.lit(0), F.substring(text, part(1 / 2) + 1, F.lit(40))), edit(part(3 / 4), F.lit(30), F.lit("")))
