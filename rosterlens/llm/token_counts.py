"""Numbers of tokens without token ids: each distinct pre-token is counted once, wherever it occurs.

Documents are gathered to blocks.  A block keeps, for each document, how often which of its words occurs, and which
pre-tokens a word consists of.  Its distinct pre-tokens go, packed by hash, to a fixed number of buckets, where each is
encoded once, as long as a memo of bounded size knows it, to see how many tokens it has; the numbers go back to the
blocks, where they are weighted with the frequencies and summed.  No ids of a document ever exist, and what
is shuffled are vocabularies of blocks.

A null text is empty and has no tokens; special tokens within a text count one each.  Rows that repeat, or
share a key, or have none, are counted each; an empty table gives an empty one.  Columns but key and text are not read.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import gathered, pressed, pressed_numbers, unpressed, unpressed_numbers
from .bpe import PIECES, codec, crowded
from .bpe import _content as content
from .common import arrow_type, small_batches
from .storage import written

BLOCK_CHARS = 8 << 20
#: Packets that a block's pre-tokens are dealt to, whatever the size of the corpus, and entries of a bucket's memo.
BUCKETS, MEMO_ENTRIES, MEMO_CHARS = 256, 500_000, 64
#: In any text a space between two characters that are not white space starts a pre-token.
BETWEEN = regex.compile(r"(?<=\S) (?=\S)")


class Numbers(dict):
    """Numbers of words as they turn up; the names of all are in one list."""

    def __init__(self, names: list[str], before: str = ""):
        super().__init__()
        self.names, self.before = names, before

    def __missing__(self, word: str) -> int:
        self[word] = i = len(self.names)
        self.names.append(self.before + word)
        return i


class Frequencies:
    """Words of a block's documents: ``size`` (distinct words of each), ``word`` and ``often``."""

    def __init__(self, c):
        self.codec, self.names = c, []
        self.first, self.later, self.special = Numbers(self.names), Numbers(self.names, " "), Numbers(self.names)
        self.size, self.word, self.often = array("i"), array("i"), array("q")

    def count(self, numbers: Numbers, words: list[str]) -> int:
        found = Counter(words)
        self.word.extend(map(numbers.__getitem__, found))
        self.often.extend(found.values())
        return len(found)

    def plain(self, text: str) -> int:
        head, *rest = BETWEEN.split(text) if crowded(text) else text.split(" ")
        return self.count(self.first, [head] if head else []) + self.count(self.later, rest)

    def add(self, text: str) -> None:
        c = self.codec
        if not any(t in text for t in c.special):
            self.size.append(self.plain(text))
            return
        parts = [p for p in c.cut.split(text) if p]
        n = self.count(self.special, [p for p in parts if p in c.special])
        self.size.append(n + sum(self.plain(p) for p in parts if p not in c.special))

    def pre_tokens(self) -> tuple[list[dict], np.ndarray, np.ndarray]:
        """Distinct pre-tokens in packets by bucket, the number of them in each word, and their places in the packets."""
        special = set(self.special.values())
        found: list[str] = []
        numbers, spread, parts = Numbers(found), array("i"), array("i")
        for i, name in enumerate(self.names):
            pieces = [name] if i in special else PIECES.findall(name)
            spread.append(len(pieces))
            parts.extend(map(numbers.__getitem__, pieces))
        bucket = np.array([xxhash.xxh32_intdigest(p.encode("utf-8", "surrogatepass")) % BUCKETS for p in found], np.int64)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(found), np.int64)
        place[order] = np.arange(len(found))
        packets = []
        for b, some in zip(*runs(bucket[order], order)):
            # sorted by the text, so that shared beginnings are next to each other
            some = sorted(some.tolist(), key=found.__getitem__)
            place[some] = np.sort(place[some])
            packets.append({"bucket": int(b), "pieces": packet([found[i] for i in some])})
        return packets, ints(spread), place[ints(parts)]


def runs(values: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct values of a sorted array, and ``of`` in parts by them."""
    found, start = np.unique(values, return_index=True)
    return found, np.split(of, start[1:]) if len(found) else []


def packet(pieces: list[str]) -> bytes:
    raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
    sizes = np.array([len(r) for r in raw], "<u4")
    return pressed(len(raw).to_bytes(4, "little") + sizes.tobytes() + b"".join(raw))


def unpacked(raw: bytes) -> list[str]:
    raw = unpressed(raw)
    n = int.from_bytes(raw[:4], "little")
    ends = 4 + 4 * n + np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64)
    starts = [4 + 4 * n, *ends[:-1].tolist()]
    return [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(starts, ends.tolist())]


def ints(a: array) -> np.ndarray:
    return np.frombuffer(a, dtype=np.dtype(f"i{a.itemsize}")) if len(a) else np.zeros(0, np.dtype(f"i{a.itemsize}"))


def ascending(word: np.ndarray, often: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of each document in ascending order, as steps from one to the next, and their frequencies."""
    order = np.lexsort((word, np.repeat(np.arange(len(size)), size)))
    word = word[order].astype(np.int64)
    steps = np.diff(word, prepend=0)
    first = (np.cumsum(size) - size)[size > 0]
    steps[first] = word[first]
    return steps, often[order]


def from_steps(steps: np.ndarray, size: np.ndarray) -> np.ndarray:
    upto = np.cumsum(steps)
    first = (np.cumsum(size) - size)[size > 0]
    return upto - np.repeat(upto[first] - steps[first], size[size > 0])


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of the given sizes."""
    ends = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    at = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    return ends[at[1:]] - ends[at[:-1]]


PACKED = ("n_bytes", "size", "steps", "often", "spread", "parts")


def frequencies(docs: DataFrame, vocabulary: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per block of ``docs`` (key, text): keys, sizes in bytes, word frequencies, and packets of its pre-tokens."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(content(vocabulary))
    kind = docs.schema["key"].dataType
    packets = T.ArrayType(T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("pieces", T.BinaryType())]))
    schema = T.StructType(
        [T.StructField("block", T.LongType()), T.StructField("keys", T.ArrayType(kind))]
        + [T.StructField(c, T.BinaryType()) for c in PACKED]
        + [T.StructField("packets", packets)]
    )
    key, packets = arrow_type(kind), arrow_type(packets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for block, rows, texts in gathered(batches, block_chars):
            f = Frequencies(c)
            for t in texts:
                f.add(t)
            n_bytes = np.array([len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass")) for t in texts])
            made, spread, parts = f.pre_tokens()
            size = ints(f.size)
            steps, often = ascending(ints(f.word), ints(f.often), size)
            keys = pa.concat_arrays(rows.column("key").cast(key).chunks)
            row = [
                pa.array([block], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys),
                *(pa.array([pressed_numbers(a)], pa.binary()) for a in (n_bytes, size, steps, often, spread, parts)),
                pa.array([made], packets),
            ]
            yield pa.RecordBatch.from_arrays(row, names=schema.names)

    return docs.mapInArrow(run, schema)


class Sizes(dict):
    """Numbers of tokens by pre-token; emptied when it holds too many, and long ones never enter."""

    def __init__(self, c):
        super().__init__()
        self.codec = c

    def __missing__(self, piece: str) -> int:
        n = 1 if piece in self.codec.special else len(self.codec.piece(piece))
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[piece] = n
        return n


def piece_sizes(packets: DataFrame, vocabulary: str) -> DataFrame:
    """(block, bucket, sizes): the numbers of tokens of the pre-tokens of each packet (block, bucket, pieces).

    A bucket's packets meet in one task, as a stream.
    """
    shared = packets.sparkSession.sparkContext.broadcast(content(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(codec(shared.value))
        for batch in batches:
            made = [pressed_numbers(np.array([sizes[p] for p in unpacked(raw)])) for raw in batch.column("pieces").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("bucket"), pa.array(made, pa.binary())], names=["block", "bucket", "sizes"])

    return packets.repartition("bucket").mapInArrow(run, "block long, bucket int, sizes binary")


def token_counts(
    docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """Per row of ``docs``: its key, n_bytes (of the text in UTF-8) and n_tokens.

    ``vocabulary``: path, on the driver, of a byte-level BPE tokenizer file.
    """
    docs = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    blocks = written(frequencies(docs, vocabulary, block_chars))
    sizes = piece_sizes(blocks.select("block", F.inline("packets")), vocabulary)
    back = sizes.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "sizes"))).alias("sizes"))
    back = back.select("block", F.col("sizes.sizes").alias("sizes"))
    schema = T.StructType([T.StructField(key, docs.schema["key"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def total(block: pa.Table) -> pa.Table:
        row = {c: block.column(c)[0] for c in block.column_names}
        n_bytes, size, steps, often, spread, parts = (unpressed_numbers(row[c].as_py()) for c in PACKED)
        counts = [unpressed_numbers(s) for s in row["sizes"].as_py() or []]
        words = sums(np.concatenate(counts)[parts], spread) if counts else np.zeros(0, np.int64)
        n = sums(words[from_steps(steps, size)] * often, size)
        return pa.Table.from_arrays([row["keys"].values, pa.array(n_bytes), pa.array(n)], names=schema.names)

    return blocks.drop("packets").join(back, "block", "left").groupBy("block").applyInArrow(total, schema)


def over_limit(docs: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, and whether a document has more tokens than ``limit``."""
    return token_counts(docs, vocabulary).withColumn("over_limit", F.col("n_tokens") > limit)
