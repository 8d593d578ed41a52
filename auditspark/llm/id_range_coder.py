"""Token ids in a compact binary form: an adaptive context-mixing range coder.

Ids (below 2^16) are cut into blocks of 2,048 that are coded independently: every block starts from the same state and ends
with its own checksum. Per id, tables indexed by the last two ids and by the last one each predict an id with a
confidence, and a running majority predicts one without context (orders 2, 1, 0). The chance that the best prediction is
right is a logistic mix of three adaptive probabilities (by the confidence of order 2, of order 1, and by recent success), whose
weights learn; the next distinct prediction has a chance of its own. What is predicted by none is coded by the
order-0 frequency of its upper byte and an even lower byte. All arithmetic is on integers, so any machine decodes.

A task codes many blocks side by side: each step handles the next id of every block in one array operation.

A block is: magic IDRC, version (1 byte), number of ids (4), crc32 of the ids as 32-bit little-endian integers (4), coded
16-bit words. Files are rows of such blocks with their place and the documents in them, in ascending doc_id order
over the numbered files.

Defined cases: null and empty texts consist of the end id; null doc_ids come first, rows of one doc_id in the order of
their ids; an empty table writes no blocks and reads as no rows; ids of 2^16 or more, and blocks whose checksum does not
hold, raise an error; other columns are ignored.
"""

from __future__ import annotations

import math
import os
import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditspark.llm.bpe_segment_tree import SPACE
from auditspark.llm.common import map_batches, tokenizer_path
from auditspark.llm.weighted_fingerprints import range_bounds, range_of
from auditspark.session import ensure_checkpoint_dir, ship_package

BLOCK = 2048
#: Blocks coded side by side.
LANES = 4096
MAGIC, HEADER = b"IDRC", struct.Struct("<4sBII")
TABLE = 1024
#: Most confidence of a prediction.
SURE = 7
TOP, BOTTOM = np.uint64(1 << 48), np.uint64(1 << 32)
WORD_BITS, HALF = np.uint64(16), np.uint64(32)
#: Least share of 2^16 that is left to ids that nothing predicts.
LEAST = 1024
#: Files for each shuffle partition.
FILES = 2

_SQUASH = np.array([min(65536 - 2 * LEAST, max(64, round(65536 / (1 + math.exp(-x / 256))))) for x in range(-2047, 2048)], np.int32)
_STRETCH = np.searchsorted(_SQUASH, np.arange(4096) * 16 + 8).clip(0, 4094).astype(np.int32) - 2047


class Model:
    """State of the predictions of n blocks side by side; an entry of a table is id + 2^16 * confidence."""

    def __init__(self, n: int):
        self.tables = [np.zeros(n * TABLE, np.int32) for _ in range(2)]  # of order 1 and 2
        self.base, self.by_sure, self.by_history = (np.arange(n) * k for k in (TABLE, 128, 32))
        self.last, self.before, self.common, self.votes, self.history = (np.zeros(n, np.int32) for _ in range(5))
        self.sure_chance, self.history_chance = np.full(n * 128, 32768, np.int32), np.full(n * 32, 32768, np.int32)
        self.second = np.full(n * 128, 16384, np.int32)
        self.weights = np.full((2, n), 40000, np.int32)
        self.counts, self.steps = np.ones((n, 256), np.int32), 0
        self._scale()

    def _scale(self) -> None:
        """Cumulative shares of the upper bytes, out of 2^16, each at least 1."""
        total = self.counts.sum(1, keepdims=True)
        self.cum = np.zeros((len(total), 257), np.int64)
        self.cum[:, 1:] = np.cumsum(self.counts, 1, dtype=np.int64) * (65536 - 256) // total + np.arange(1, 257)
        self.counts = np.where(total > 4000, (self.counts + 1) >> 1, self.counts)

    def predict(self, n: int) -> None:
        """For the first n blocks: best and second prediction, and the bounds of their shares of 2^16."""
        last = self.last[:n]
        self.at = (self.base[:n] + ((last * 40503 >> 5) & (TABLE - 1)), self.base[:n] + (((last * 31153) ^ (self.before[:n] * 20021 >> 3)) & (TABLE - 1)))
        self.entries = one, two = self.tables[0][self.at[0]], self.tables[1][self.at[1]]
        p1, p2, n1, n2 = one & 65535, two & 65535, one >> 16, two >> 16
        self.ids, self.sures, same = (p1, p2), (n1, n2), p1 == p2
        self.best = np.where(n2 > 0, p2, np.where(n1 > 0, p1, self.common[:n]))
        self.other = np.where((n2 > 0) & (n1 > 0) & ~same, p1, self.common[:n])
        self.spare = self.other != self.best
        context = n2 * 16 + n1 * 2 + same
        self.sure_at, self.history_at = self.by_sure[:n] + context, self.by_history[:n] + self.history[:n]
        self.odds = a, b = self.sure_chance[self.sure_at], self.history_chance[self.history_at]
        self.inputs = i, j = _STRETCH[a >> 4], _STRETCH[b >> 4]
        mixed = (self.weights[0, :n] * i + self.weights[1, :n] * j) >> 16
        self.share = _SQUASH[np.minimum(np.maximum(mixed, -2047), 2047) + 2047]
        self.second_odds = self.second[self.sure_at]
        left = 65536 - LEAST - self.share
        self.bound = self.share + np.where(self.spare, 1 + ((left - 1) * (self.second_odds >> 4) >> 12), 0)

    def update(self, n: int, ids: np.ndarray, hit: np.ndarray, hit2: np.ndarray, missed: np.ndarray) -> None:
        goal = np.where(hit, 65535, 0)
        if self.steps % 4 == 0:  # weights change slowly
            error = (goal - self.share) >> 4
            for k in range(2):
                w = self.weights[k, :n]
                w += (self.inputs[k] * error) >> 9
                np.minimum(np.maximum(w, -(1 << 18), out=w), 1 << 18, out=w)
        self.sure_chance[self.sure_at] = self.odds[0] + ((goal - self.odds[0]) >> 4)
        self.history_chance[self.history_at] = self.odds[1] + ((goal - self.odds[1]) >> 5)
        self.second[self.sure_at] = self.second_odds + np.where(hit, 0, (np.where(hit2, 65000, 0) - self.second_odds) >> 4)
        for table, at, entry, predicted, sure in zip(self.tables, self.at, self.entries, self.ids, self.sures):
            table[at] = np.where(predicted == ids, entry + np.where(sure < SURE, 65536, 0), np.where(sure <= 1, ids + 65536, entry - 65536))
        if self.steps % 2 == 0:
            votes = self.votes[:n] + np.where(self.common[:n] == ids, 1, -1)
            self.common[:n] = np.where(votes < 0, ids, self.common[:n])
            self.votes[:n] = np.abs(votes)
        self.history[:n] = (self.history[:n] * 2 + hit) & 31
        if len(missed):
            self.counts[missed, ids[missed] >> 8] += 24
        self.before[:n] = self.last[:n]
        self.last[:n] = ids
        self.steps += 1
        if self.steps % 128 == 0 or self.steps in (8, 32):
            self._scale()


class Coder:
    """Low ends and widths of the intervals of many blocks; an id takes one part of 2^32 of the interval."""

    def __init__(self, n: int):
        self.low, self.span = np.zeros(n, np.uint64), np.full(n, 2**64 - 1, np.uint64)

    def narrow(self, n: int, start: np.ndarray, size: np.ndarray, part: np.ndarray):
        """Take the part; yields, word by word, the blocks that must shift a word out and the words."""
        low, span = self.low[:n], self.span[:n]
        low += part * start.astype(np.uint64)
        np.multiply(part, size.astype(np.uint64), out=span)
        lanes = np.flatnonzero(((low ^ (low + span)) < TOP) | (span < BOTTOM))
        while len(lanes):
            x, y = low[lanes], span[lanes]
            y = np.where((x ^ (x + y)) < TOP, y, (~x + np.uint64(1)) & (BOTTOM - np.uint64(1)))  # a span that would carry is cut
            yield lanes, (x >> np.uint64(48)).astype(np.uint16)
            x, y = x << WORD_BITS, y << WORD_BITS
            low[lanes], span[lanes] = x, y
            lanes = lanes[((x ^ (x + y)) < TOP) | (y < BOTTOM)]


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """Blocks of ids to their binary form."""
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    out: list[bytes] = [b""] * len(blocks)
    for i in range(0, len(order), LANES):
        some = order[i:i + LANES]
        for j, words in zip(some, _encode([blocks[j] for j in some])):
            ids = blocks[j]
            out[j] = HEADER.pack(MAGIC, 1, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) + words.astype("<u2").tobytes()
    return out


def _encode(blocks: list[np.ndarray]) -> list[np.ndarray]:
    sizes, m = np.array([len(b) for b in blocks]), len(blocks)
    most = int(sizes[0]) if m else 0
    ids = np.zeros((most, m), np.int32)
    for j, b in enumerate(blocks):
        ids[:len(b), j] = b
    model, coder = Model(m), Coder(m)
    out, used = np.zeros((m, most + 64), np.uint16), np.zeros(m, np.int64)
    active = np.searchsorted(-sizes, -np.arange(most), side="left")  # blocks longer than t
    for t in range(most):
        n = int(active[t])
        x = ids[t, :n]
        model.predict(n)
        hit = x == model.best
        hit2 = ~hit & model.spare & (x == model.other)
        start = np.where(hit, 0, model.share).astype(np.int64) << 16
        size = np.where(hit, model.share, model.bound - model.share).astype(np.int64) << 16
        missed = np.flatnonzero(~(hit | hit2))
        if len(missed):
            y, bound = x[missed], model.bound[missed].astype(np.int64)
            upper, unit = y >> 8, (65536 - bound) >> 8
            cum = model.cum[missed, upper]
            freq = model.cum[missed, upper + 1] - cum
            start[missed] = (bound << 16) + unit * (cum * 256 + (y & 255) * freq)
            size[missed] = unit * freq
        if n and used[:n].max() + 8 > out.shape[1]:
            out = np.concatenate([out, np.zeros_like(out)], 1)
        for lanes, words in coder.narrow(n, start, size, coder.span[:n] >> HALF):
            out[lanes, used[lanes]] = words
            used[lanes] += 1
        model.update(n, x, hit, hit2, missed)
    tail = np.stack([(coder.low >> np.uint64(48 - 16 * k)).astype(np.uint16) for k in range(4)], 1) if m else out
    return [np.concatenate([out[j, :used[j]], tail[j]]) for j in range(m)]


def decode(coded: list[bytes]) -> list[np.ndarray]:
    """Binary blocks to ids (16-bit); raises if one is damaged."""
    heads = [HEADER.unpack_from(c) for c in coded]
    order = sorted(range(len(coded)), key=lambda i: -heads[i][2])
    out: list[np.ndarray] = [np.empty(0, np.uint16)] * len(coded)
    for i in range(0, len(order), LANES):
        some = order[i:i + LANES]
        got = _decode([np.frombuffer(coded[j], "<u2", offset=HEADER.size) if (len(coded[j]) - HEADER.size) % 2 == 0 else np.empty(0, "<u2") for j in some],
                      [heads[j][2] for j in some])
        for j, ids in zip(some, got):
            magic, version, _, crc = heads[j]
            if magic != MAGIC or version != 1 or zlib.crc32(ids.astype("<u4").tobytes()) != crc:
                raise ValueError("a block of ids is damaged")
            out[j] = ids
    return out


def _decode(words: list[np.ndarray], lengths: list[int]) -> list[np.ndarray]:
    sizes, m = np.array(lengths), len(words)
    most = int(sizes[0]) if m else 0
    given = np.zeros((m, max((len(w) for w in words), default=0) + 8), np.uint64)
    for j, w in enumerate(words):
        given[j, :len(w)] = w
    code = np.zeros(m, np.uint64)
    for k in range(4):
        code = (code << WORD_BITS) | given[:, k]
    used, last = np.full(m, 4), given.shape[1] - 1
    model, coder = Model(m), Coder(m)
    ids = np.zeros((most, m), np.uint16)
    active = np.searchsorted(-sizes, -np.arange(most), side="left")
    for t in range(most):
        n = int(active[t])
        model.predict(n)
        part = coder.span[:n] >> HALF
        at = np.minimum((code[:n] - coder.low[:n]) // part, np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = at >> 16
        hit, below = first < model.share, first < model.bound
        hit2 = below & ~hit
        x = np.where(hit, model.best, model.other)
        start = np.where(hit, 0, model.share).astype(np.int64) << 16
        size = np.where(hit, model.share, model.bound - model.share).astype(np.int64) << 16
        missed = np.flatnonzero(~below)
        if len(missed):
            bound = model.bound[missed].astype(np.int64)
            unit = (65536 - bound) >> 8
            place = np.minimum((at[missed] - (bound << 16)) // unit, (1 << 24) - 1)
            goal, upper = place >> 8, np.zeros(len(missed), np.int64)
            for bit in (128, 64, 32, 16, 8, 4, 2, 1):
                upper += np.where(model.cum[missed, upper + bit] <= goal, bit, 0)
            cum = model.cum[missed, upper]
            freq = model.cum[missed, upper + 1] - cum
            lower = np.minimum((place - cum * 256) // freq, 255)
            x[missed] = upper * 256 + lower
            start[missed] = (bound << 16) + unit * (cum * 256 + lower * freq)
            size[missed] = unit * freq
        ids[t, :n] = x
        for lanes, _ in coder.narrow(n, start, size, part):
            code[lanes] = (code[lanes] << WORD_BITS) | given[lanes, np.minimum(used[lanes], last)]
            used[lanes] += 1
        model.update(n, x, hit, hit2, missed)
    return [ids[:k, j].copy() for j, k in enumerate(lengths)]


_NOT_SPACE = re.compile("[\x1c-\x1f]")  # white space to Python, not to the vocabulary
_PIECE = regex.compile(f"[^{SPACE}]+")


class Words(dict):
    """Ids of texts by the tokenizer library, piece by piece between white space; remembers the pieces of a text.

    Texts that the tokenizer's normaliser could join across white space don't exist: white space only separates in this
    vocabulary's pre-tokenizer, and composition of characters doesn't cross it.
    """

    CACHE = 600_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        if self.tokenizer.get_vocab_size() > 65536:
            raise ValueError("ids of 2^16 or more don't fit this format")

    def ids(self, texts: list[str], end: int) -> list[bytes]:
        split = [t.split() if not _NOT_SPACE.search(t) else _PIECE.findall(t) for t in texts]
        new = [p for p in dict.fromkeys(p for pieces in split for p in pieces) if p not in self]
        if new:
            if len(self) + len(new) > self.CACHE:
                self.clear()
                new = list(dict.fromkeys(p for pieces in split for p in pieces))
            for piece, found in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)):
                self[piece] = np.array(found.ids, "<u2").tobytes()
        last = struct.pack("<H", end)
        return [b"".join([*map(self.__getitem__, pieces), last]) for pieces in split]


def tokenized(docs: DataFrame, name: str = "word_bpe_49k.json", end: int = 1) -> DataFrame:
    """doc_id and ids (16-bit little-endian, with the end id) of every row."""
    path = tokenizer_path(name)

    def rows(batch: pa.RecordBatch, words: Words) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        ids = [x for i in range(0, len(texts), 100) for x in words.ids(texts[i:i + 100], end)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rows, "doc_id long, ids binary", lambda: Words(path))


PIECES = "array<struct<doc_id:bigint,doc_start:bigint,n:int>>"


def _key():
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))


def file_bounds(docs: DataFrame) -> list[int]:
    """The largest doc_id of each file but the last; reads ids only."""
    n = FILES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return range_bounds(docs.select(_key().alias("_key")), n) or [0]


def write(tokens: DataFrame, bounds: list[int], path: str) -> None:
    """Write (doc_id, ids) as numbered files of coded blocks; a document may span blocks, never files."""
    spark = tokens.sparkSession
    placed = tokens.select("doc_id", "ids", range_of(_key(), bounds).alias("file"))
    sorted_rows = placed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file").sortWithinPartitions("file", F.col("doc_id").asc_nulls_first(), "ids")

    def blocks_of(batches):
        """(file, block, start, n_ids, pieces, ids) of a partition's rows, in order."""
        file, block, start, held, parts, pieces = None, 0, 0, 0, [], []

        def full():
            nonlocal block, start, held, parts, pieces
            row = (file, block, start, held, pieces, np.concatenate(parts))
            block, start, held, parts, pieces = block + 1, start + held, 0, [], []
            return row

        for batch in batches:
            for doc_id, ids, number in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if number != file:
                    if held:
                        yield full()
                    file, block, start = number, 0, 0
                ids, at, doc_start = np.frombuffer(ids, "<u2"), 0, start + held
                while at < len(ids):
                    some = ids[at:at + BLOCK - held]
                    parts.append(some)
                    pieces.append({"doc_id": doc_id, "doc_start": doc_start, "n": len(some)})
                    held, at = held + len(some), at + len(some)
                    if held == BLOCK:
                        yield full()
        if held:
            yield full()

    def coded(batches):
        rows = []
        for row in blocks_of(batches):
            rows.append(row)
            if len(rows) == LANES:
                yield packed(rows)
                rows = []
        if rows:
            yield packed(rows)

    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("doc_start", pa.int64()), ("n", pa.int32())]))

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        file, block, start, held, pieces, ids = zip(*rows)
        cols = [pa.array(file, pa.int32()), pa.array(block, pa.int32()), pa.array(start, pa.int64()), pa.array(held, pa.int32()), pa.array(pieces, kind), pa.array(encode(list(ids)), pa.binary())]
        return pa.RecordBatch.from_arrays(cols, ["file", "block", "start", "n_ids", "pieces", "data"])

    ship_package(spark)
    sorted_rows.mapInArrow(coded, f"file int, block int, start bigint, n_ids int, pieces {PIECES}, data binary").write.parquet(path)


def _times(a: int, b: int) -> int:
    """Product of two polynomials over GF(2) modulo that of crc32, lowest power in the highest bit."""
    out = 0
    for i in range(32):
        if a & (0x80000000 >> i):
            out ^= b
        b = (b >> 1) ^ (0xEDB88320 if b & 1 else 0)
    return out


def joined_crc(first: int, second: int, n_bytes: int) -> int:
    """crc32 of two strings joined, from theirs and the length of the second."""
    power, square, n = 0x80000000, 0x00800000, n_bytes  # x^0, x^8
    while n:
        if n & 1:
            power = _times(power, square)
        square, n = _times(square, square), n >> 1
    return _times(power, first) ^ second


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 of every document in the files at *path*.

    Blocks are decoded wherever they are read; a document's pieces meet by their checksums only.
    """
    blocks = spark.read.schema(f"file int, block int, start bigint, n_ids int, pieces {PIECES}, data binary").parquet(path)
    sizes = blocks.groupBy("file").agg(F.sum("n_ids").alias("_n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = sizes.select("file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))  # one row for each file

    def parts(batch: pa.RecordBatch):
        file, block, pieces, data = (batch.column(i).to_pylist() for i in range(4))
        out = []
        for i, ids in enumerate(decode(data)):
            wide, at = ids.astype("<u4"), 0
            for piece in pieces[i]:
                out.append((file[i], piece["doc_start"], piece["doc_id"], block[i], piece["n"], zlib.crc32(wide[at:at + piece["n"]].tobytes())))
                at += piece["n"]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["file", "doc_start", "doc_id", "block", "n", "crc"])

    found = map_batches(blocks.select("file", "block", "pieces", "data"), parts, "file int, doc_start bigint, doc_id bigint, block int, n bigint, crc bigint")
    whole = found.groupBy("file", "doc_start").agg(
        F.min("doc_id").alias("doc_id"), F.sum("n").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("block", "n", "crc"))).alias("_parts"))

    def join(batch: pa.RecordBatch) -> pa.RecordBatch:
        crcs = []
        for pieces in batch.column(4).to_pylist():
            crc = pieces[0]["crc"]
            for piece in pieces[1:]:
                crc = joined_crc(crc, piece["crc"], 4 * piece["n"])
            crcs.append(crc)
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(crcs, pa.int64())], ["file", "doc_start", "doc_id", "n_tokens", "ids_crc32"])

    docs = map_batches(whole.select("file", "doc_start", "doc_id", "n_tokens", "_parts"), join, "file int, doc_start bigint, doc_id bigint, n_tokens bigint, ids_crc32 bigint")
    return docs.join(files, "file").select("doc_id", (F.col("_before") + F.col("doc_start")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, name: str = "word_bpe_49k.json", end: int = 1) -> DataFrame:
    """Encode, write to a new folder beside the checkpoints, read back."""
    spark = docs.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/ids-{uuid.uuid4().hex}"
    write(tokenized(docs, name, end), file_bounds(docs), path)
    return read(spark, path)
