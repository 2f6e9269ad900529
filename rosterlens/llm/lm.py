"""Language-model scores by deleted interpolation.

The probability of a token is a mixture of the maximum-likelihood estimates of all orders and a uniform one.
The weights depend on how often the context was seen (buckets by powers of two) and are learned by
expectation-maximisation on a deleted part: its n-grams, with the counts of the other training documents.  A bucket's
weights are learned in a task of its own.  Where the longest contexts were never seen, the bucket is that of the
longest one that was, and the orders beyond have no weight: probabilities sum to one after any words.

N-gram tables grow with the corpus, so they are never in one place.  Documents are dealt by hash of id and text to
blocks of a bounded size, n-grams to as many shards, by ranges of their keys.  A block counts its own n-grams and
sends each shard a packet of them; the shard adds up what all blocks have sent and answers each with the counts
of the others, in the order of the packet.  An n-gram that is everywhere thus is one entry a block.  Shards take turns,
so that not all packets are on disk at a time.  Equal rows that
would fill a block by themselves are dealt as rows with a number of copies.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, small_batches, text_or_empty
from .storage import written

BLOCK_CHARS = 4 << 20
ORDER = 2
TURNS = 2
#: Folds of ten: 0 is held out of everything, 1 is the deleted part that weights are learned on.
HELD_OUT, DELETED = 0, 1
TEST, PART, FIT = 0, 1, 2
END, START = b" end", b" start"  # no word holds a blank
#: Classes of a power of two, for ratios in the weights' statistics.  A bucket of contexts seen 2^b times has at most
#: STEPS^3 x 40 x 40 x b classes of order three, whatever the size of the corpus.
STEPS = 4
MEMO = 300_000


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


_hashes = Hashes()


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a pair of hashes."""
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15) + (b << np.uint64(23) | b >> np.uint64(41))
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def keyed(x: np.ndarray, order: int) -> np.ndarray:
    """Keys whose lowest bit tells single tokens from longer n-grams."""
    return (x & ~np.uint64(1)) | np.uint64(order == 1)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Ranges of keys of equal length."""
    return ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


@dataclass
class Block:
    """The tokens of some documents, as one sequence, and their n-grams of every order."""

    size: np.ndarray  # tokens of each document
    part: np.ndarray  # of each document
    keys: list[np.ndarray] = field(default_factory=list)  # distinct n-grams by order, sorted
    place: list[np.ndarray] = field(default_factory=list)  # of every token's n-gram among them
    taken: list[np.ndarray] = field(default_factory=list)  # with a turn: the tokens whose n-grams are of it

    @classmethod
    def of(cls, texts: Iterable[str], part: Iterable[int], order: int, shards: int = 1, turn: int | None = None) -> Block:
        """With a turn only the n-grams of its shards."""
        end, pieces, size = _hashes[END], [], []
        for t in texts:
            words = t.encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII letters and blanks only
            pieces.append(np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words)))
            pieces.append(np.array([end], dtype=np.uint64))
            size.append(len(words) + 1)
        made = cls(np.array(size, dtype=np.int64), np.array(part, dtype=np.int8))
        tokens = np.concatenate(pieces) if pieces else np.zeros(0, np.uint64)
        grams = tokens
        for k in range(1, order + 1):
            if k > 1:
                grams = joined(made.before(grams, np.uint64(_hashes[START] + k)), tokens)
            found = keyed(grams, k)
            if turn is not None:
                made.taken.append(shard_of(found, shards) % np.uint64(TURNS) == turn)
                found = found[made.taken[-1]]
            keys, place = np.unique(found, return_inverse=True)
            made.keys.append(keys)
            made.place.append(place.astype(np.int32))
        return made

    def first(self) -> np.ndarray:
        """Places of the documents' first tokens."""
        return np.cumsum(self.size) - self.size

    def before(self, values: np.ndarray, start) -> np.ndarray:
        """Each token's predecessor's value; ``start`` at the start of a document."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.first()] = start
        return out

    def counts(self, k: int, part: int) -> np.ndarray:
        here = np.repeat(self.part == part, self.size)
        here = here[self.taken[k]] if self.taken else here
        return np.bincount(self.place[k][here], minlength=len(self.keys[k]))


def packed(a: np.ndarray) -> bytes:
    """Integers from zero on by byte planes, as many as the largest needs, after their number: small counts then
    take little room."""
    width = max(1, -(-int(a.max()).bit_length() // 8)) if len(a) else 1
    return bytes([width]) + a.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpacked(raw: Iterable[bytes]) -> list[np.ndarray]:
    out = []
    for r in raw:
        wide = np.zeros(((len(r) - 1) // r[0], 8), np.uint8)
        wide[:, : r[0]] = np.frombuffer(r, np.uint8, offset=1).reshape(r[0], -1).T
        out.append(wide.view("<i8").ravel())
    return out


def end_to_end(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def lowest(shard: int, shards: int) -> np.uint64:
    """The lowest key that a shard can have."""
    return np.uint64(-(-(shard << 32) // shards) << 32)


def dealt_keys(b: Block, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All n-grams of a block by shard and key: their order, the shards that occur, and where each begins."""
    keys = np.concatenate(b.keys)
    order = np.argsort(keys, kind="stable")
    shard = shard_of(keys[order], shards).astype(np.int64)
    starts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else np.zeros(0, np.int64)
    return order, shard[starts], starts


def blocked(docs: DataFrame, block_chars: int) -> tuple[DataFrame, int]:
    """block, doc_id, text, copies, held_out and part; the number of blocks.

    ``copies`` is one but where equal rows have more than a block's characters: these are dealt to several blocks in
    shares.  Blocks go by id and text, so rows that share an id, or have none, are spread as well.
    """
    texts = docs.select("doc_id", text_or_empty(docs).alias("text")).withColumn("hash", F.xxhash64("doc_id", "text"))
    size = texts.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text") + 1).alias("chars"))
    large = F.when((F.col("n") > 1) & (F.col("chars") > block_chars), F.col("hash"))
    total, hot = size.agg(F.sum("chars"), F.collect_list(large)).first()  # at most one a block
    n = max(1, -(-(total or 0) // block_chars))
    rows = texts.withColumn("copies", F.lit(1).cast("long"))
    if hot:
        same = rows.where(F.col("hash").isin(hot)).groupBy("doc_id", "text", "hash").agg(F.sum("copies").alias("all"))
        shares = F.least(F.col("all"), F.lit(n), F.ceil(F.col("all") * (F.length("text") + 1) / block_chars)).cast("long")
        same = same.withColumn("shares", shares).withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)))
        more = F.when(F.col("share") < F.col("all") % F.col("shares"), 1).otherwise(0)
        copies = (F.floor(F.col("all") / F.col("shares")) + more).cast("long").alias("copies")
        shared = same.select("doc_id", "text", (F.pmod("hash", F.lit(n)) + F.col("share")).alias("hash"), copies)
        rows = rows.where(~F.col("hash").isin(hot)).unionByName(shared)
    f = fold("doc_id", 10)
    part = F.when(f.isin(HELD_OUT, -1), TEST).when(f == DELETED, PART).otherwise(FIT)
    block = F.pmod(F.col("hash"), F.lit(n)).cast("int").alias("block")
    return rows.select(block, "doc_id", "text", "copies", (f == HELD_OUT).alias("held_out"), part.alias("part")), n


def every_row(rows: pa.Table) -> pa.Table:
    """The rows of a block, each as often as it has copies."""
    copies = rows.column("copies").to_numpy()
    return rows if (copies == 1).all() else rows.take(pa.array(np.repeat(np.arange(rows.num_rows), copies)))


@dataclass(frozen=True)
class Totals:
    """Tokens and distinct tokens: of the documents fitted on, and of all training documents."""

    fit_tokens: int
    fit_types: int
    tokens: int
    types: int


TOTALS = ("fit_tokens", "fit_types", "tokens", "types")


def counted(docs: DataFrame, order: int, shards: int) -> tuple[DataFrame, Totals]:
    """What the shards answer to the blocks, and the totals.

    block, shard; ``others``: occurrences in the training documents of other blocks, in the order of the
    block's packet; ``fit``: for the n-grams of the block's deleted part, in the same order, how often all fitted
    documents have them.
    """

    def sending(turn: int):
        def send(key: tuple, rows: pa.Table) -> pa.Table:
            rows = every_row(rows)
            b = Block.of(rows.column("text").to_pylist(), rows.column("part").to_pylist(), order, shards, turn)
            by, found, starts = dealt_keys(b, shards)
            keys = np.concatenate(b.keys)[by]
            steps = np.diff(keys, prepend=np.uint64(0))
            steps[starts] = keys[starts] - np.array([lowest(int(s), shards) for s in found], np.uint64)
            values = [steps, *(np.concatenate([b.counts(k, part) for k in range(order)])[by] for part in (FIT, PART))]
            packets = [[packed(x) for x in np.split(v, starts[1:])] if len(found) else [] for v in values]
            columns = [pa.array(found.astype(np.int32)), pa.array([key[0].as_py()] * len(found), pa.int32()), *(pa.array(x, pa.binary()) for x in packets)]
            return pa.table(columns, names=["shard", "block", "keys", "fit", "part"])

        return send

    def answer(key: tuple, rows: pa.Table) -> pa.Table:
        steps = unpacked(x.as_py() for x in rows.column("keys"))
        size, low = [len(x) for x in steps], lowest(key[0].as_py(), shards)
        columns = {c: end_to_end(unpacked(x.as_py() for x in rows.column(c))) for c in ("fit", "part")}
        columns["keys"] = end_to_end([np.cumsum(x.view(np.uint64)) + low for x in steps])
        distinct, place = np.unique(columns["keys"], return_inverse=True)
        add = lambda v: np.bincount(place, weights=v, minlength=len(distinct)).astype(np.int64)
        fit = add(columns["fit"])
        learned = fit + add(columns["part"])
        single = (distinct & 1) == 1
        totals = (fit[single].sum(), (fit[single] > 0).sum(), learned[single].sum(), (learned[single] > 0).sum())
        cut = np.cumsum(size)[:-1]
        others = np.split(learned[place] - columns["fit"] - columns["part"], cut)
        deleted = np.split(columns["part"] > 0, cut)
        fits = [packed(k[d]) for k, d in zip(np.split(fit[place], cut), deleted)]
        made = {
            "block": pa.array([*rows.column("block").to_pylist(), None], pa.int32()),
            "shard": pa.array([key[0].as_py()] * (len(size) + 1), pa.int32()),
            "others": pa.array([*map(packed, others), None], pa.binary()),
            "fit": pa.array([*fits, None], pa.binary()),
        }
        more = {c: pa.array([None] * len(size) + [int(v)], pa.int64()) for c, v in zip(TOTALS, totals)}
        return pa.table(made | more)

    packets = "shard int, block int, keys binary, fit binary, part binary"
    answers = "block int, shard int, others binary, fit binary, " + ", ".join(f"{c} long" for c in TOTALS)
    texts = docs.select("block", "text", "copies", "part").groupBy("block")
    turns = []
    for turn in range(min(TURNS, shards)):
        sent = texts.applyInArrow(sending(turn), packets)
        turns.append(written(sent.groupBy("shard").applyInArrow(answer, answers), release=True))
    answered = reduce(DataFrame.unionAll, turns)
    got = answered.agg(*[F.sum(c).alias(c) for c in TOTALS]).first()
    return answered.where("block is not null"), Totals(*(int(got[c] or 0) for c in TOTALS))


def contexts(b: Block, counts: list[np.ndarray]) -> list[np.ndarray]:
    """For every token, how often the context of each order was seen; a document's start as often as its end."""
    ends = counts[0][b.place[0][np.cumsum(b.size) - 1][:1]] if len(b.size) else np.zeros(1, np.int64)
    return [b.before(c[p], ends[0]) for c, p in zip(counts[:-1], b.place)]


BUCKETS = 64


def unseen(order: int, seen: int) -> int:
    """The bucket of a token whose contexts were seen up to those of order ``seen`` only."""
    return BUCKETS - order + seen


def bucket(context: list[np.ndarray], tokens: int) -> np.ndarray:
    """Of every token: one more than the power of two below its longest context's count, see ``unseen`` for none."""
    order = len(context) + 1
    if order == 1:
        return np.zeros(tokens, np.int64)
    found = np.full(tokens, unseen(order, 1))
    for k, count in enumerate(context[:-1]):
        found[count > 0] = unseen(order, k + 2)
    last = context[-1]
    return np.where(last > 0, np.floor(np.log2(np.maximum(last, 1))).astype(np.int64) + 1, found)


def statistics(docs: DataFrame, answers: DataFrame, order: int) -> DataFrame:
    """What the deleted part says about the weights: n by bucket and by classes of the estimates.

    Estimates of orders over one are relative frequencies, that of order one is a count; all in classes of
    1 / STEPS powers of two, -1000 for none.
    """
    names = [f"c{k}" for k in range(order)]

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("bucket", *names, "n")})
        left = every_row(left)
        b = Block.of(left.column("text").to_pylist(), left.column("part").to_pylist(), order)
        total = np.empty(sum(map(len, b.keys)), np.int64)  # all of the deleted part's n-grams are in the answers
        total[np.argsort(np.concatenate(b.keys), kind="stable")] = end_to_end(unpacked(x.as_py() for x in right.sort_by("shard").column("fit")))
        counts = np.split(total, np.cumsum([len(k) for k in b.keys])[:-1])
        context = contexts(b, counts)
        columns = [bucket(context, int(b.size.sum()))]
        for k in range(order):
            c = counts[k][b.place[k]]
            ratio = np.log2(np.maximum(c, 1) / (np.maximum(context[k - 1], 1) if k else 1))
            columns.append(np.where(c > 0, np.rint(STEPS * ratio), -1000).astype(np.int64))
        rows, n = np.unique(np.stack(columns, axis=1), axis=0, return_counts=True)
        return pa.table({"bucket": rows[:, 0], **{f"c{k}": rows[:, k + 1] for k in range(order)}, "n": n})

    deleted = docs.where(F.col("part") == PART).select("block", "text", "copies", "part")
    asked = answers.select("block", "shard", "fit")
    schema = "bucket long, " + ", ".join(f"{c} long" for c in names) + ", n long"
    rows = deleted.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(run, schema)
    return rows.groupBy("bucket", *names).agg(F.sum("n").alias("n"))


def learned(c: np.ndarray, n: np.ndarray, totals: Totals, rounds: int = 60) -> np.ndarray:
    """Weights of uniform, order one, and so on, that make ``n`` tokens of the classes ``c`` (a column an order) likeliest."""
    order = c.shape[1]
    p = np.empty((len(n), order + 1))
    p[:, 0] = 1 / (totals.fit_types + 1)
    p[:, 1:] = np.where(c <= -1000, 0, 2.0 ** (c / STEPS))
    p[:, 1] /= max(totals.fit_tokens, 1)
    w = np.full(order + 1, 1 / (order + 1))
    for _ in range(rounds):
        share = w * p
        share *= (n / share.sum(axis=1))[:, None]
        w = share.sum(axis=0) + 1e-3
        w /= w.sum()
    return w


def weights(rows: DataFrame, totals: Totals, order: int) -> np.ndarray:
    """Mixture weights by bucket (rows) of: uniform, order one, and so on.  One row a bucket comes to the driver.

    Buckets that the deleted part does not reach get the weights of the next lower one; orders whose context
    was never seen have no weight.
    """

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        c = np.stack([rows.column(f"c{k}").to_numpy() for k in range(order)], axis=1)
        w = learned(c, rows.column("n").to_numpy().astype(np.float64), totals)
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int64()), "w": pa.array([w.tolist()])})

    found = {r.bucket: r.w for r in rows.groupBy("bucket").applyInArrow(run, "bucket long, w array<double>").collect()}
    out = np.full((BUCKETS, order + 1), 1.0)
    for b in range(BUCKETS):
        out[b] = found.get(b, out[max(b - 1, 0)])
    for seen in range(1, order):
        b = unseen(order, seen)
        out[b] = found.get(b, np.ones(order + 1))
        out[b, seen + 1 :] = 0
    return out / out.sum(axis=1, keepdims=True)


def scored(docs: DataFrame, answers: DataFrame, totals: Totals, mix: np.ndarray, order: int, shards: int) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document row."""
    key_type = docs.schema["doc_id"].dataType.simpleString()
    n, v = totals.tokens, totals.types
    floor = np.log10(0.1) - np.log10(n + 0.1 * (v + 1))

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        left = every_row(left)
        b = Block.of(left.column("text").to_pylist(), left.column("part").to_pylist(), order)
        by = np.argsort(np.concatenate(b.keys), kind="stable")
        total = np.concatenate([b.counts(k, FIT) + b.counts(k, PART) for k in range(order)])
        total[by] += end_to_end(unpacked(x.as_py() for x in right.sort_by("shard").column("others")))
        counts = np.split(total, np.cumsum([len(k) for k in b.keys])[:-1])
        context = contexts(b, counts)
        single = counts[0][b.place[0]]
        p = np.full(len(single), 1 / (v + 1))
        which = bucket(context, len(single))
        p *= mix[which, 0]
        p += mix[which, 1] * single / max(n, 1)
        for k in range(1, order):
            p += mix[which, k + 1] * counts[k][b.place[k]] / np.maximum(context[k - 1], 1)
        first = b.first()
        summed = lambda x: np.add.reduceat(x, first)
        base = np.where(single > 0, np.log10(single + 0.1) - np.log10(n + 0.1 * (v + 1)), floor)
        rows = left.num_rows
        return pa.table(
            {
                "doc_id": left.column("doc_id"),
                "held_out": left.column("held_out"),
                "n_tokens": pa.array(b.size, pa.int64()),
                "n_known": pa.array(summed((single > 0).astype(np.int64)), pa.int64()),
                "train_tokens": pa.array(np.full(rows, n), pa.int64()),
                "base_score": pa.array(summed(base), pa.float64()),
                "score": pa.array(summed(np.log10(p)), pa.float64()),
            }
        )

    schema = f"doc_id {key_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    asked = answers.select("block", "shard", "others")
    return docs.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(run, schema)


def scores(docs: DataFrame, order: int = ORDER, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Learn from all documents that are not held out, and score every document row's whole text.

    A null or empty text is one end token.  Documents without an id are scored but not learned from; rows
    that repeat count each.  An empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    dealt, blocks = blocked(docs, block_chars)
    shards = blocks
    answers, totals = counted(dealt, order, shards)
    mix = weights(statistics(dealt, answers, order), totals, order)
    return scored(dealt, answers, totals, mix, order, shards)
