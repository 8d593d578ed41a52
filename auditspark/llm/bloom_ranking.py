"""Ranked lexical search by bit-sliced Bloom signatures, exact.

Index: some thousand documents at a time are grouped by how many entries they make in a filter. A group is a bit matrix with a
row (slice) for each place of a Bloom filter and a column for each document: a term that occurs t times sets its
HASHES slices once for every threshold of LEVELS up to t. The index also holds each document's length, largest count
and key (doc_id and hash of the text), and how many of those documents hold each term.

Search: the AND of a term's slices tells in which documents it may occur, and how often at most; it errs on one side
only. Weighted sums of the slices bound every document's score from above. The TRIED * K documents of highest bound are scored
exactly, which gives a score that K documents reach; then all documents whose bound reaches it are scored exactly, and the
K best remain. Nothing else is left out.

Scores are those of the caller's contract: whole numbers from the counts of documents and terms. Items are dealt into blocks, each of
which meets every block of documents (a stated query set).

Defined cases: a null text has no terms, nor has one without letters and digits, and such documents are never found; rows of documents that share doc_id
and text are found each; items that share item_id and text are one, items of one item_id with other texts are searched each;
an item without terms, or whose terms no document holds, has no rows; equal scores go by ascending doc_id, null first; texts are read
whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditspark.llm import text_arrays as ta
from auditspark.llm.common import lower_ascii, stored, text_or_empty
from auditspark.session import ship_package

#: Fixed by the contract: terms are runs of letters and digits, and of anything beyond ASCII; only A-Z is lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
K = 50
TRIED = 4
#: A term sets slices for each of these counts that it reaches.
LEVELS = np.array([1, 2, 3, 4, 6, 10, 20, 50])
#: Places for each entry that a group's documents may make (half of them at least are made), and slices that an entry sets.
PLACES, HASHES = 16, 6
#: Documents that are grouped together, documents that are rescored at a time, and entries that are set at a time.
DOCS, RESCORED = 4000, 200
ENTRIES = 100_000
#: Items in a block of queries.
ITEMS = 64
#: Items and documents whose bounds are summed at a time.
CELLS = 2_000_000
#: Bits of the table that lets rows pass on to the exact join.
SIEVE = 1 << 20

_TERM_BYTE = np.zeros(256, bool)
_TERM_BYTE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def term_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place of the text) of every term."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    codes = _LOWER[np.frombuffer(b" ".join(raw) + b" ", np.uint8)]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    solid = _TERM_BYTE[codes]
    starts = np.flatnonzero(solid[1:] & ~solid[:-1]) + 1
    if solid[0]:
        starts = np.concatenate([[0], starts])
    return ta.run_hashes(codes, starts, solid), np.searchsorted(np.cumsum(sizes), starts, "right")


def slots(terms: np.ndarray, level: int, places: int) -> np.ndarray:
    """The HASHES slices of each term at a level."""
    x = ta.mixed(terms + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    step = (x >> np.uint64(32)) | np.uint64(1)
    return ((x[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]) & np.uint64(places - 1)).astype(np.int64)


_INDEX = "kind string, places int, n_docs int, n_terms long, lengths binary, most binary, slices binary, keys binary, ids array<{}>, slot int"


def index(docs: DataFrame, n_slots: int) -> DataFrame:
    """Rows of kind d (a group of documents) and t (term hashes and numbers of documents of a batch), dealt to *n_slots* slots.

    lengths, most: 32-bit numbers of terms and of the commonest term; keys: 64-bit hashes of texts; ids: the doc_ids.
    """
    ship_package(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_or_empty().alias("text"), F.xxhash64(text_or_empty()).alias("key"))
    names = [x.split()[0] for x in _INDEX.split(", ")]

    def built(batches):
        for whole in batches:
            for begin in range(0, whole.num_rows, DOCS):
                yield from grouped(whole.slice(begin, DOCS))

    def grouped(batch):
        texts, n = batch.column("text").to_pylist(), batch.num_rows
        found = []
        for a, b in ta.parts(texts):
            terms, doc = term_hashes(texts[a:b])
            if len(terms):
                key = ta.pairs(terms, doc)
                order = np.argsort(key)
                first = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
                at, times = order[first], np.diff(first, append=len(key)).astype(np.int32)
                by_doc = np.argsort(doc[at], kind="stable")
                found.append((terms[at][by_doc], (doc[at][by_doc] + a).astype(np.int32), times[by_doc]))
        if not found:
            return
        terms, doc, times = (np.concatenate(x) for x in zip(*found))
        set_, length = np.bincount(doc, np.searchsorted(LEVELS, times, "right"), n), np.bincount(doc, times, n).astype(np.int32)
        most = np.zeros(n, np.int32)
        np.maximum.at(most, doc, times)
        keys, ids = batch.column("key").to_numpy(), batch.column("doc_id")
        uniq, counts = np.unique(terms, return_counts=True)
        slot = int(uniq[0] % np.uint64(n_slots))
        yield _row(names, kind_, kind="t", slices=uniq.tobytes(), lengths=counts.astype(np.int32).tobytes(), slot=slot)
        size = np.where(set_ > 0, np.ceil(np.log2(np.maximum(set_, 1))).astype(int), -1)
        for c in np.unique(size[size >= 0]):
            places, mine = max(64, PLACES << int(c)), np.flatnonzero(size == c)
            width = max(8, (16 << 20) // places)  # 16 MB of cells at most, unless eight documents have more
            for k in range(0, len(mine), width):
                part = mine[k:k + width]
                new = np.full(n, -1)
                new[part] = np.arange(len(part))
                inside = np.flatnonzero(new[doc] >= 0)
                cells = np.zeros((places, -(-len(part) // 8) * 8), bool)
                for level, least in enumerate(LEVELS):
                    inside = inside[times[inside] >= least]
                    for i in range(0, len(inside), ENTRIES):
                        some = inside[i:i + ENTRIES]
                        cells[slots(terms[some], level, places), new[doc[some]][:, None]] = True
                slot = (slot + 1) % n_slots
                yield _row(names, kind_, kind="d", places=places, n_docs=len(part), n_terms=int(length[part].sum(dtype=np.int64)), lengths=length[part].tobytes(),
                           most=most[part].tobytes(), slices=np.packbits(cells, axis=1, bitorder="little").tobytes(), keys=keys[part].tobytes(), ids=ids.take(pa.array(part)), slot=slot)

    kind_ = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(kind, pa.int64())
    return rows.mapInArrow(built, _INDEX.format(kind))


def _row(names: list[str], id_type: pa.DataType, **values) -> pa.RecordBatch:
    types = {"kind": pa.string(), "places": pa.int32(), "n_docs": pa.int32(), "n_terms": pa.int64(), "slot": pa.int32(), "ids": pa.list_(id_type)}
    cells = []
    for name in names:
        v = values.get(name)
        if name == "ids" and v is not None:
            cells.append(pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v))
        else:
            cells.append(pa.array([v], types.get(name, pa.binary())))
    return pa.RecordBatch.from_arrays(cells, names)


def item_terms(items: DataFrame) -> DataFrame:
    """item (a number of item_id and text), item_id, terms: distinct terms of every item that has some."""
    terms = F.array_distinct(F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(TERM), F.lit(0)))
    rows = items.select("item_id", terms.alias("terms"), F.xxhash64(F.col("item_id").cast("string"), F.lit(":"), "text").alias("item"))
    return rows.where(F.size("terms") > 0).dropDuplicates(["item"])


def _hashed(items: DataFrame) -> DataFrame:
    """The items with `hashes`, the hashes of their terms in order."""
    ship_package(items.sparkSession)

    def add(batches):
        for batch in batches:
            terms = batch.column("terms").to_pylist()
            flat, _ = term_hashes([t for own in terms for t in own])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x.astype(np.int64).tolist() for x in np.split(flat, np.cumsum([len(own) for own in terms])[:-1])], pa.list_(pa.int64()))],
                                             [*batch.schema.names, "hashes"])

    return items.mapInArrow(add, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in items.schema.fields)}, hashes array<bigint>")


def _met(blocks: DataFrame, groups: DataFrame, n_slots: int) -> DataFrame:
    """Every block of items beside every row of the index: blocks go to all slots."""
    copies = blocks.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(n_slots - 1))))
    return groups.join(copies, "slot")


def _blocks(items: DataFrame, n_items: int, *columns: str) -> DataFrame:
    """Rows of about ITEMS items: arrays of the named columns."""
    block = F.pmod(F.xxhash64("item"), F.lit(n_items // ITEMS + 1))
    return items.groupBy(block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("item", *columns))).alias("items"))


def document_counts(groups: DataFrame, items: DataFrame, n_items: int, n_slots: int) -> DataFrame:
    """hash, df: in how many documents each term of the items occurs; each term is in one of the items."""
    def counted(batches):
        for batch in batches:
            for terms, counts, items_ in zip(*(batch.column(c).to_pylist() for c in ("slices", "lengths", "items"))):
                known, n = np.frombuffer(terms, np.uint64), np.frombuffer(counts, np.int32)
                wanted = np.unique(np.array([h for x in items_ for h in x["hashes"]], np.int64).view(np.uint64))
                at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
                hit = known[at] == wanted
                yield pa.RecordBatch.from_arrays([pa.array(wanted[hit].view(np.int64)), pa.array(n[at[hit]].astype(np.int64))], ["hash", "df"])

    met = _met(_blocks(items, n_items, "hashes"), groups.where("kind = 't'").select("slot", "slices", "lengths"), n_slots)
    return met.select("items", "slices", "lengths").mapInArrow(counted, "hash long, df long").groupBy("hash").agg(F.sum("df").alias("df"))


def saturation(tf, m):
    """What a term that occurs *tf* times adds to its weight's share, in a document of length factor *m*."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def length_factor(n, n_docs: int, n_terms: int):
    return 50 + (50 * n * n_docs) // n_terms


def bounds(row: dict, items: list[dict], n_docs: int, n_terms: int) -> np.ndarray:
    """Upper bounds of the scores of a group's documents, by item and document."""
    places, count = row["places"], row["n_docs"]
    slices = np.frombuffer(row["slices"], np.uint8).reshape(places, -1)
    m = length_factor(np.frombuffer(row["lengths"], np.int32).astype(np.int64), n_docs, n_terms)
    most = np.frombuffer(row["most"], np.int32).astype(np.int64)
    owner = np.repeat(np.arange(len(items)), [len(x["hashes"]) for x in items])
    terms, which = np.unique(np.array([h for x in items for h in x["hashes"]], np.int64).view(np.uint64), return_inverse=True)
    weights = np.array([w for x in items for w in x["weights"]], np.int64)
    total, open_, before = np.zeros((len(items), count), np.int64), np.arange(len(terms)), 0
    there = None
    for level in range(len(LEVELS)):
        at = slots(terms[open_], level, places)
        bits = slices[at[:, 0]]
        for k in range(1, HASHES):
            bits = bits & slices[at[:, k]]
        there = bits if there is None else bits & there
        some = there.any(axis=1)
        open_, there = open_[some], there[some]
        if not len(open_):
            break
        top = np.minimum(most, LEVELS[level + 1] - 1) if level + 1 < len(LEVELS) else most
        now = saturation(np.maximum(top, LEVELS[level]), m)
        new = np.full(len(terms), -1)
        new[open_] = np.arange(len(open_))
        used = np.flatnonzero(new[which] >= 0)  # pairs of item and term, in the order of items
        step = max(1, CELLS // max(1, count))
        for k in range(0, len(used), step):
            part = used[k:k + step]
            cells = np.unpackbits(there[new[which[part]]], axis=1, bitorder="little", count=count) * weights[part][:, None].astype(np.int32)
            first = np.flatnonzero(np.concatenate([[True], owner[part][1:] != owner[part][:-1]]))
            total[owner[part][first]] += np.add.reduceat(cells, first, axis=0, dtype=np.int64) * (now - before)
        before = now
    return total


def candidates(groups: DataFrame, blocks: DataFrame, n_slots: int, n_docs: int, n_terms: int, best: bool) -> DataFrame:
    """item, doc_id, key, bound: a group's K documents of highest bound (*best*), or all whose bound reaches the item's `least`."""
    def found(batches):
        for whole in batches:
            for row in (r for i in range(whole.num_rows) for r in whole.slice(i, 1).to_pylist()):
                items, keys, ids = row["items"], np.frombuffer(row["keys"], np.int64), row["ids"]
                total = bounds(row, items, n_docs, n_terms)
                if best:
                    top = np.argpartition(-total, min(K, total.shape[1]) - 1, axis=1)[:, :K]
                    who, doc = np.repeat(np.arange(len(items)), top.shape[1]), top.ravel()
                    some = total[who, doc] > 0
                    who, doc = who[some], doc[some]
                else:
                    who, doc = np.nonzero(total >= np.array([max(1, x["least"]) for x in items])[:, None])
                yield pa.RecordBatch.from_arrays([pa.array([items[i]["item"] for i in who], pa.int64()), pa.array([ids[i] for i in doc], id_type),
                                                  pa.array(keys[doc]), pa.array(total[who, doc])], ["item", "doc_id", "key", "bound"])

    kind = groups.schema["ids"].dataType.elementType.simpleString()
    id_type = {"int": pa.int32(), "string": pa.string()}.get(kind, pa.int64())
    met = _met(blocks, groups.where("kind = 'd'").drop("kind"), n_slots)
    return met.select("items", "places", "n_docs", "lengths", "most", "slices", "keys", "ids").mapInArrow(found, f"item long, doc_id {kind}, key long, bound long")


def rescored(docs: DataFrame, pairs: DataFrame, items: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """item, doc_id, score: exact scores of the documents in *pairs* (item, doc_id, key), from their whole texts.

    A table of SIEVE bits, of the keys that are wanted, lets only such documents (and a few others) pass on to the join.
    """
    ship_package(docs.sparkSession)
    wanted = stored(pairs.select("item", "doc_id", "key").distinct().join(items.select("item", "terms", "weights"), "item")
                    .groupBy("doc_id", "key").agg(F.sort_array(F.collect_list(F.struct("item", "terms", "weights"))).alias("items")))  # an entry for each item at most
    place = lambda c: F.pmod(c, F.lit(SIEVE))
    sieve = wanted.groupBy(F.shiftright(place(F.col("key")), 6).alias("_word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(key, {SIEVE}) % 64 as int))")).alias("_bits"))
    rows = docs.select("doc_id", text_or_empty().alias("text"), F.xxhash64(text_or_empty()).alias("key")).withColumn("_word", F.shiftright(place(F.col("key")), 6))
    passed = rows.join(F.broadcast(sieve), "_word").where(F.expr(f"(shiftright(_bits, cast(pmod(key, {SIEVE}) % 64 as int)) & 1) = 1")).select("doc_id", "text", "key")  # SIEVE / 64 rows at most
    met = passed.join(wanted.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "items"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")))
    term, lower = re.compile(TERM), str.maketrans({c: c.lower() for c in map(chr, range(0x41, 0x5B))})

    def scored(batches):
        for batch in (whole.slice(i, RESCORED) for whole in batches for i in range(0, whole.num_rows, RESCORED)):
            out = ([], [], [])
            for doc_id, text, own in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "items"))):
                times = Counter(term.findall(text.translate(lower)))
                m = length_factor(times.total(), n_docs, n_terms)
                for item in own:
                    score = sum(w * saturation(times[t], m) for t, w in zip(item["terms"], item["weights"]) if t in times)
                    for column, value in zip(out, (item["item"], doc_id, score)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], batch.column("doc_id").type), pa.array(out[2], pa.int64())], ["item", "doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return met.select("doc_id", "text", "items").mapInArrow(scored, f"item long, doc_id {kind}, score long")


def _best(rows: DataFrame, by: list[Column], k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*by))).where(F.col("rank") <= k)


def weight(n_docs: int) -> Column:
    return F.floor(1000 * F.log((2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score: each item's *k* documents of highest score."""
    spark = docs.sparkSession
    n_slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    groups = stored(index(docs, n_slots))
    n_docs, n_terms = (x or 0 for x in groups.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    asked = stored(_hashed(item_terms(items)))
    n_items = asked.count()
    if not n_docs or not n_items:
        return spark.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id {kind}, score long")
    terms = asked.select("item", "item_id", F.posexplode(F.arrays_zip("terms", "hashes")).alias("at", "x")).select("item", "item_id", "at", "x.terms", F.col("x.hashes").alias("hash"))
    known = document_counts(groups, _once(asked), n_items, n_slots)
    weighted = stored(terms.join(known, "hash").withColumn("weight", weight(n_docs)).groupBy("item", "item_id").agg(F.sort_array(F.collect_list(F.struct("at", "terms", "hash", "weight"))).alias("x"))
                      .select("item", "item_id", F.col("x.terms").alias("terms"), F.col("x.hash").alias("hashes"), F.col("x.weight").alias("weights")))
    blocks = _blocks(weighted, n_items, "hashes", "weights")
    likely = _best(candidates(groups, blocks, n_slots, n_docs, n_terms, best=True), [F.desc("bound"), F.asc("doc_id"), F.asc("key")], TRIED * k)
    tried = rescored(docs, likely, weighted, n_docs, n_terms)
    reached = _best(tried, [F.desc("score")], k).groupBy("item").agg(F.min("score").alias("low"), F.count(F.lit(1)).alias("n"))
    least = weighted.join(reached.where(F.col("n") >= k), "item", "left").withColumn("least", F.coalesce("low", F.lit(0)))
    found = candidates(groups, _blocks(stored(least.select("item", "hashes", "weights", "least")), n_items, "hashes", "weights", "least"), n_slots, n_docs, n_terms, best=False)
    exact = rescored(docs, found, weighted, n_docs, n_terms).where(F.col("score") > 0)
    return _best(exact, [F.desc("score"), F.asc("doc_id")], k).join(weighted.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def _once(asked: DataFrame) -> DataFrame:
    """The items with each term in one item only, so that its documents are counted once."""
    first = asked.select("item", F.explode("hashes").alias("hash")).groupBy("hash").agg(F.min("item").alias("item"))
    return first.groupBy("item").agg(F.collect_list("hash").alias("hashes"))

