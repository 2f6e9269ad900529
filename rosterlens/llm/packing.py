"""Conflict-constrained best-fit packing of documents into sequences of a fixed length.

Longest first, every piece goes to the open bin with the least room that still takes it and where neither
its source nor its duplicate cluster is present yet; if there is none, a new bin is opened.  Bins are kept
by the room they have left; a bit set of the rooms in use gives the next larger one, and each bin carries
bit sets of its sources and clusters.  The search goes on until a bin fits or no room is left.

Pieces are dealt into groups of a bounded number by a hash of all that is known of them and of the number of the copy,
so items that share an id, or have none, or are equal, are spread as well.  Each group is packed by itself; what is
lost is the room left in a group's last bins.  Documents longer than a sequence are cut into full
pieces and a rest; every word is in exactly one piece.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .storage import written

CAPACITY, GROUP_PIECES = 2048, 8192


def best_fit(lengths: Iterable[int], sources: Iterable[int], clusters: Iterable[int], capacity: int) -> list[int]:
    """Bin number of each piece, in the order given.  Codes under zero never conflict."""
    rooms: dict[int, list[int]] = defaultdict(list)  # bins by room left, oldest first
    in_use = 0  # bit r: some bin has room r
    held: list[list[int]] = []  # source bits, cluster bits
    out = []
    for n, source, cluster in zip(lengths, sources, clusters):
        s = 1 << source if source >= 0 else 0
        c = 1 << cluster if cluster >= 0 else 0
        room, left = n, in_use >> n
        chosen = -1
        while left and chosen < 0:
            step = (left & -left).bit_length() - 1  # the next larger room
            room += step
            for place, b in enumerate(rooms[room]):
                if not (held[b][0] & s or held[b][1] & c):
                    chosen = b
                    del rooms[room][place]
                    break
            else:
                room, left = room + 1, left >> (step + 1)
        if chosen < 0:
            chosen, room = len(held), capacity
            held.append([0, 0])
        elif not rooms[room]:
            in_use &= ~(1 << room)
        held[chosen][0] |= s
        held[chosen][1] |= c
        rooms[room - n].append(chosen)
        in_use |= 1 << (room - n)
        out.append(chosen)
    return out


def n_words(text: str = "text") -> Column:
    """Words of a text column: a length for packing where tokens have not been counted."""
    return F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def pack(items: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Bins of items with columns doc_id, length, source, cluster (null: no conflict).

    Returns doc_id, piece, start, length, bin_group, bin: pieces of one (bin_group, bin) make a sequence.
    Lengths of null or less than zero count as zero; items of length zero are packed too.  Ties go by doc_id
    and piece; repeated rows are packed each.  An empty table gives an empty one.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    n = F.greatest(F.coalesce(F.col("length").cast("long"), F.lit(0)), F.lit(0))
    items = items.select("doc_id", "source", "cluster", n.alias("n"))
    last = F.greatest(F.ceil(F.col("n") / capacity) - 1, F.lit(0)).cast("long")
    counted = written(items.groupBy(*items.columns).agg(F.count(F.lit(1)).alias("copies")))
    total = counted.select(F.sum((last + 1) * F.col("copies"))).first()[0] or 0
    groups = max(1, -(-total // group_pieces))
    zero = F.lit(0).cast("long")
    pieces = counted.withColumn("copy", F.explode(F.sequence(zero, F.col("copies") - 1))).withColumn("piece", F.explode(F.sequence(zero, last)))
    pieces = pieces.withColumn("start", F.col("piece") * capacity).withColumn("length", F.least(F.lit(capacity), F.col("n") - F.col("start")))
    group = F.pmod(F.xxhash64("doc_id", "piece", "copy", "n", "source", "cluster"), F.lit(groups)).cast("int")
    rows = pieces.select(group.alias("bin_group"), "doc_id", "piece", "start", "length", "source", "cluster")
    key = items.schema["doc_id"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        by = [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("source", "ascending"), ("cluster", "ascending")]
        table = table.sort_by(by)
        bins = best_fit(table.column("length").to_pylist(), codes(table.column("source")), codes(table.column("cluster")), capacity)
        return table.drop_columns(["source", "cluster"]).append_column("bin", pa.array(bins, pa.int64()))

    out = f"bin_group int, doc_id {key}, piece long, start long, length long, bin long"
    return rows.groupBy("bin_group").applyInArrow(run, out)


def codes(column: pa.ChunkedArray) -> list[int]:
    """Small numbers of the values that occur more than once; -1 for the rest and for nulls."""
    values = column.combine_chunks().dictionary_encode()
    found = values.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    count = np.bincount(found[found >= 0], minlength=len(values.dictionary) or 1)
    number = np.where(count > 1, np.cumsum(count > 1) - 1, -1)
    return np.where(found >= 0, number[np.maximum(found, 0)], -1).tolist()


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pack whole texts by words.  Conflicts: the same source, and equal texts.

    Columns: doc_id, piece, start (first word), n_words, bin_group, bin.
    """
    text = text_or_empty(docs)
    items = docs.select("doc_id", n_words().alias("length"), F.col("source").cast("string").alias("source"), F.md5(text).alias("cluster"))
    return pack(items, capacity, group_pieces).select("doc_id", "piece", "start", F.col("length").alias("n_words"), "bin_group", "bin")


def bins(packed: DataFrame, length: str = "n_words") -> DataFrame:
    """One row a sequence: its pieces in the order they were put in, and how full it is."""
    pieces = F.sort_array(F.collect_list(F.struct(F.col(length).alias("length"), "doc_id", "piece", "start")), asc=False)
    return packed.groupBy("bin_group", "bin").agg(pieces.alias("pieces"), F.sum(length).alias("filled"))
