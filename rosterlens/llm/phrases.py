"""Phrases that are collocations, mined exactly by SON partitioning.

The corpus is dealt to a fixed number of shards.  In a shard the support asked for is lowered to its share of the
language's words: a phrase that is frequent in the whole is frequent, by that measure, in one shard at
least.  Each shard is mined completely, one after the other, so only a shard's phrases are on disk at a time; what
any shard found frequent is a candidate, and all candidates are then counted in every shard, by their words.

A shard is no task: it consists of blocks of bounded size.  A block sends its phrases, as sorted hashes with
counts, in packets to ranges of hashes; there are as many ranges as keep one in memory, and a packet holds hundreds of
phrases, 32 bits each besides the bits of its range.  A range adds up the packets of all blocks to mine, and later tells each block which of its phrases are
candidates.  Hashes decide on candidates only, where two that meet can but add a candidate; the counts are
of words.  A phrase that is everywhere is one entry a block.

Within a language a candidate is scored by its weakest cut, candidates that mostly occur inside a longer one are left
out, and the best are returned.  Null texts are empty, a null language is ``und``; documents that repeat count as often
as they occur; an empty table, or one without frequent phrases, gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterlens.functions.small_tables import attach

from .blocks import PLACE_BITS, few_rows_a_batch, gathered
from .common import small_batches, text_or_empty
from .storage import written

BLOCK_CHARS = 4 << 20
SHARDS = 5
#: Phrases that a range of hashes should hold, and the bits that tell ranges apart, at least and at most.
RANGE_KEYS, RANGE_BITS = 2 << 20, (6, 12)
LEAST, LONGEST, TOP = 30, 4, 2000
INSIDE_PERCENT = 80
UNKNOWN = "und"
#: Parts that a language's candidates are ranked in first.
SALTS = 256

#: Bytes in lower case, with one separator of pieces and one of words.
_ENDS, _BLANKS = b".,;:!?\n\x0b\x0c\r", b"\t"
FOLDED = bytes.maketrans(_ENDS + _BLANKS, b"\n" * len(_ENDS) + b" " * len(_BLANKS))
END = -1

BLOCKS = T.StructType(
    [
        T.StructField("block", T.LongType()),
        T.StructField("shard", T.IntegerType()),
        T.StructField("lang", T.StringType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("words", T.ArrayType(T.StringType())),
        T.StructField("hashes", T.BinaryType()),  # of the words
        T.StructField("places", T.BinaryType()),  # numbers of the words, END between pieces
    ]
)


class Words(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def numbered(texts: list[str]) -> tuple[list[bytes], np.ndarray]:
    """The distinct words of texts, and the sequence of their numbers with END after each piece."""
    words, found = Words(), []
    for t in texts:
        tokens = t.encode("utf-8", "surrogatepass").lower().translate(FOLDED).replace(b"\n", b" \n ").split(b" ")
        found.append(np.fromiter(map(words.__getitem__, tokens), np.int32, len(tokens)))
        found.append(np.array([words[b"\n"]], np.int32))
    places = np.concatenate(found)
    empty, end = words[b""], words[b"\n"]
    places = places[places != empty]
    new = np.cumsum([w not in (b"", b"\n") for w in words], dtype=np.int32) - 1
    return [w for w in words if w not in (b"", b"\n")], np.where(places == end, np.int32(END), new[places]).astype(np.int32)


def blocks_of(docs: DataFrame, shards: int, block_chars: int) -> DataFrame:
    """Documents (lang, text) as BLOCKS: one row a language and block, dealt to shards in turn."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for place, rows, texts in gathered(batches, block_chars):
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(rows.column("lang").to_pylist(), texts):
                by_lang.setdefault(lang, []).append(text)
            partition = place >> PLACE_BITS
            for lang, own in by_lang.items():
                words, places = numbered(own)
                hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
                row = [
                    [partition << PLACE_BITS | n], [(place + partition) % shards], [lang], [int(np.count_nonzero(places != END))],
                    [[w.decode("utf-8", "surrogatepass") for w in words]], [hashes.tobytes()], [places.tobytes()],
                ]
                n += 1
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, KINDS)], names=BLOCKS.names)

    return docs.mapInArrow(run, BLOCKS)


KINDS = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.binary(), pa.binary()]


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in their order."""
    with np.errstate(over="ignore"):
        x = (a ^ (a >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) + b
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))


def phrase_keys(row: dict, longest: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
    """Places of a block, and by number of words: where such phrases begin, and the phrases' hashes."""
    places = np.frombuffer(row["places"], np.int32)
    word = np.append(np.frombuffer(row["hashes"], np.uint64), np.uint64(0))[places]  # END is the last
    keys = mixed(np.uint64(xxhash.xxh64_intdigest(row["lang"])), word)
    at = np.flatnonzero(places != END)
    keys = keys[at]
    found = [(1, at, keys)]
    for k in range(2, longest + 1):
        on = places[np.minimum(at + k - 1, len(places) - 1)] != END  # a block ends with END
        at = at[on]
        keys = mixed(keys[on], word[at + k - 1])
        found.append((k, at, keys))
    return places, found


PACKETS = T.StructType([T.StructField(c, t) for c, t in (("bucket", T.IntegerType()), ("block", T.LongType()), ("least", T.LongType()), ("keys", T.BinaryType()), ("counts", T.BinaryType()), ("more", T.BinaryType()))])


KEPT = np.uint64(32)  # bits of a hash that packets hold, after the bits of the range


def short(keys: np.ndarray, bits: int) -> np.ndarray:
    return keys >> (np.uint64(64 - bits) - KEPT)


def packets(blocks: DataFrame, longest: int, bits: int) -> DataFrame:
    """PACKETS of the blocks' distinct phrases, by the first bits of their hashes."""
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << KEPT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = [short(keys, bits) for _, _, keys in phrase_keys(row, longest)[1]]
                keys, n = np.unique(np.concatenate(found), return_counts=True)
                cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
                some = [(i, a, b) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
                keys, few = keys.astype(np.uint32), np.minimum(n, 255).astype(np.uint8)
                made = [
                    pa.array([i for i, _, _ in some], pa.int32()),
                    pa.array(np.full(len(some), row["block"], np.int64)),
                    pa.array(np.full(len(some), row["least"], np.int64)),
                    pa.array([keys[a:b].tobytes() for _, a, b in some], pa.binary()),
                    # a byte each, and the whole count of those that it does not hold
                    pa.array([few[a:b].tobytes() for _, a, b in some], pa.binary()),
                    pa.array([n[a:b][few[a:b] == 255].tobytes() for _, a, b in some], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(made, names=PACKETS.names)

    return blocks.select("block", "lang", "hashes", "places", "least").mapInArrow(run, PACKETS)


def all_of(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a column of packed arrays, end to end, and how many each row has."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), kind), np.array([len(r) // np.dtype(kind).itemsize for r in raw], np.int64)


def mined(blocks: DataFrame, longest: int, bits: int) -> DataFrame:
    """(bucket, keys): phrases that are frequent in the blocks of one shard; ``least`` is the support there."""

    def frequent(rows: pa.Table) -> pa.Table:
        keys, size = all_of(rows.column("keys"), np.uint32)
        n = all_of(rows.column("counts"), np.uint8)[0].astype(np.int64)
        n[n == 255] = all_of(rows.column("more"), np.int64)[0]
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        total = np.add.reduceat(n[order], first)
        # phrases of two languages may meet: the lower support counts
        least = np.minimum.reduceat(np.repeat(rows.column("least").to_numpy(), size)[order], first)
        kept = keys[first][total >= least]
        return pa.table({"bucket": rows.column("bucket").slice(0, 1), "keys": pa.array([kept.tobytes()], pa.binary())})

    return packets(blocks, longest, bits).groupBy("bucket").applyInArrow(frequent, "bucket int, keys binary")


def counted(blocks: DataFrame, candidates: DataFrame, longest: int, bits: int) -> DataFrame:
    """lang, phrase, f: the candidates (bucket, keys) in the blocks of one shard, counted by their words."""

    def wanted(rows: pa.Table, some: pa.Table) -> pa.Table:
        known = np.sort(all_of(some.column("keys"), np.uint32)[0])
        keys, size = all_of(rows.column("keys"), np.uint32)
        hit = among(keys, known)
        first = np.uint64(rows.column("bucket")[0].as_py() if len(size) else 0) << KEPT
        ends = np.cumsum(np.add.reduceat(np.append(hit, 0), np.cumsum(size) - size)) if len(size) else []
        hits = np.split(keys[hit].astype(np.uint64) | first, ends[:-1]) if len(size) else []
        return pa.table({"block": rows.column("block"), "keys": pa.array([h.tobytes() for h in hits], pa.binary())})

    def count(block: pa.Table) -> pa.Table:
        (row,) = block.to_pylist()
        known = np.sort(np.frombuffer(b"".join(row["keys"]), np.uint64))
        words, (places, found) = row["words"], phrase_keys(row, longest)
        phrases, n = [], [np.zeros(0, np.int64)]
        for k, at, keys in found:
            at = at[among(short(keys, bits), known)]
            same = np.stack([places[at + i] for i in range(k)])
            same = same[:, np.lexsort(same)]
            new = np.append(True, (same[:, 1:] != same[:, :-1]).any(axis=0)) if len(at) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            n.append(np.diff(np.append(first, len(at))))
            phrases += [" ".join([words[i] for i in phrase]) for phrase in same[:, first].T.tolist()]
        columns = {"lang": pa.array([row["lang"]] * len(phrases), pa.string()), "phrase": pa.array(phrases, pa.string())}
        return pa.table(columns | {"f": pa.array(np.concatenate(n).astype(np.int64))})

    sent = packets(blocks, longest, bits).drop("counts", "more", "least")
    hits = sent.groupBy("bucket").cogroup(candidates.groupBy("bucket")).applyInArrow(wanted, "block long, keys binary")
    hits = hits.where(F.length("keys") > 0).groupBy("block").agg(F.collect_list("keys").alias("keys"))
    here = blocks.select("block", "lang", "words", "hashes", "places").join(hits, "block").groupBy("block")
    return here.applyInArrow(count, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def among(keys: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which keys are in the sorted array ``some``."""
    if not len(some):
        return np.zeros(len(keys), bool)
    return some[np.searchsorted(some, keys).clip(max=len(some) - 1)] == keys


def together(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def frequent(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, shards: int = SHARDS, block_chars: int = BLOCK_CHARS
) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, f of all phrases of 1 to ``longest`` words that occur ``least`` times; lang, n (words)."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), text_or_empty(docs).alias("text"))
    blocks = written(blocks_of(docs, shards, block_chars), large_rows=True)
    total = written(blocks.groupBy("lang").agg(F.sum("n_words").alias("n")))
    share = blocks.groupBy("shard", "lang").agg(F.sum("n_words").alias("own")).join(total, "lang")
    # rounded up; the product may pass 64 bits
    support = F.expr(f"(cast(own as decimal(19,0)) * {least} + n - 1) div greatest(n, 1)")
    share = share.select("shard", "lang", F.greatest(support, F.lit(1).cast("long")).alias("least"))
    n = blocks.agg(F.sum("n_words")).first()[0] or 0
    bits = min(max(math.ceil(math.log2(max(n * longest / shards / RANGE_KEYS, 1))), RANGE_BITS[0]), RANGE_BITS[1])
    own = [attach(blocks.where(F.col("shard") == s), share.where(F.col("shard") == s).drop("shard"), ["lang"]) for s in range(shards)]
    with few_rows_a_batch(spark):
        candidates = together([written(mined(b, longest, bits), release=True, large_rows=True) for b in own])
        parts = [written(counted(b, candidates, longest, bits), release=True) for b in own]
    phrases = together(parts).groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return written(phrases, release=True), total


def collocations(
    docs: DataFrame,
    least: int = LEAST,
    longest: int = LONGEST,
    top: int = TOP,
    inside_percent: int = INSIDE_PERCENT,
    shards: int = SHARDS,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of two words and more of each language.

    a, l and r count the phrase and the two parts of its weakest cut; score is 2,000,000 a / (l + r), rounded down.
    """
    known, total = frequent(docs, least, longest, shards, block_chars)
    split = known.withColumn("w", F.split("phrase", " ")).withColumn("m", F.size("w"))
    candidates = split.where("m > 1")

    def piece(start, size):
        return F.array_join(F.slice("w", start, size), " ")

    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
    cuts = cuts.select("lang", "phrase", F.col("f").alias("a"), "k", piece(1, F.col("k")).alias("first"), piece(F.col("k") + 1, F.col("m") - F.col("k")).alias("rest"))
    for name, part in (("l", "first"), ("r", "rest")):
        cuts = cuts.join(known.select("lang", F.col("phrase").alias(part), F.col("f").alias(name)), ["lang", part])
    score = F.expr("cast(a as decimal(19,0)) * 2000000 div cast(l + r as decimal(19,0))")
    weakest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("lang", "phrase", "a").agg(weakest).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    longer = candidates.where("m > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("m") - 1)))
    longer = longer.withColumn("start", F.explode(F.sequence(F.lit(1), F.col("m") - F.col("size") + 1)))
    longer = longer.select("lang", piece(F.col("start"), F.col("size")).alias("phrase"), "f")
    longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    scored = scored.join(longer, ["lang", "phrase"], "left").where(F.expr(f"longer is null or 100 * longer < {inside_percent} * a")).drop("longer")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    best = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    names = ("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    return attach(best, total, ["lang"]).select(*names)
