"""Line dedup that can be taken back: exact reference counts by line, cuckoo filters before them.

The index holds, for every line key, the number of documents it occurs in.  Documents are added and
removed by adding and subtracting their counts, so the state never depends on the order of events and a
removed document leaves no trace.  Keys are dealt to shards; each shard has a cuckoo filter of the keys
that are frequent enough to be dropped.  A filter follows the counts key by key, in and out.

To clean documents, their lines first pass the filters, which are small: most lines are in none and are
kept at once.  What passes is decided by the exact counts, in a join by key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLANKS, add_columns, fresh, small_batches
from .cuckoo import CuckooFilter
from .storage import written

#: Bytes of filters that tasks may be given; lines of further shards go to the exact counts unscreened.
FILTER_BYTES = 64 << 20


def line_key(line: bytes) -> bytes:
    return line.strip(BLANKS).lower()  # of bytes: ASCII letters only


def keys_of(text: str | None, min_chars: int) -> dict[bytes, list[int]]:
    """Line numbers by digest of the line's key, for keys of at least ``min_chars`` code points."""
    found: dict[bytes, list[int]] = {}
    for i, line in enumerate((text or "").encode("utf-8", "surrogatepass").split(b"\n")):
        key = line_key(line)
        if len(key) >= min_chars and (min_chars <= 1 or len(key.decode("utf-8", "surrogatepass")) >= min_chars):
            found.setdefault(hashlib.md5(key, usedforsecurity=False).digest(), []).append(i)
    return found


def parts(digest: bytes, shards: int) -> tuple[int, int]:
    """Shard of a key, and the hash that its filter is asked for."""
    return int.from_bytes(digest[:8], "little") % shards, int.from_bytes(digest[8:], "little")


@dataclass(frozen=True)
class LineIndex:
    """``counts``: shard, key, n_docs, n_lines.  ``filters``: shard, filter, of keys with n_docs >= min_docs.

    A document is a row; rows that repeat count each.  ``shards`` should leave some 100,000 frequent keys
    to a shard.
    """

    counts: DataFrame
    filters: DataFrame
    min_docs: int = 10
    min_chars: int = 1
    shards: int = 64

    def insert(self, docs: DataFrame, text: str = "text") -> LineIndex:
        return self._changed(docs, text, 1)

    def delete(self, docs: DataFrame, text: str = "text") -> LineIndex:
        """Take out documents that were inserted; an error, when the index is used, if they were not."""
        return self._changed(docs, text, -1)

    def _changed(self, docs: DataFrame, text: str, sign: int) -> LineIndex:
        lines = counted(docs, text, self.min_chars, self.shards)
        news = lines.select("shard", "key", (sign * F.col("n_docs")).alias("n_docs"), (sign * F.col("n_lines")).alias("n_lines"))
        olds = self.counts.select("shard", "key", "n_docs", "n_lines", F.col("n_docs").alias("was"))
        both = olds.unionByName(news.withColumn("was", F.lit(0).cast("long")))
        now = written(
            both.groupBy("shard", "key").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_lines").alias("n_lines"), F.sum("was").alias("was"))
        )
        least = F.when(F.col("n_docs") < 0, F.raise_error(F.lit("documents to delete are not in the index"))).otherwise(F.col("n_docs"))
        counts = now.withColumn("n_docs", least).where("n_docs > 0").drop("was")
        return replace(self, counts=counts, filters=written(followed(self.filters, now, self.min_docs)))

    def frequent(self) -> DataFrame:
        return self.counts.where(F.col("n_docs") >= self.min_docs).select("shard", "key")

    def screened(self) -> dict[int, bytes]:
        """The filters of as many shards as FILTER_BYTES allow, in the order of shards."""
        sizes = self.filters.select("shard", F.length("filter").alias("n")).orderBy("shard").collect()
        total, chosen = 0, []
        for shard, n in sizes:  # one row a shard
            total += n
            if total <= FILTER_BYTES:
                chosen.append(shard)
        return {r.shard: bytes(r.filter) for r in self.filters.where(F.col("shard").isin(chosen)).collect()} if chosen else {}

    def clean(self, docs: DataFrame, text: str = "text", kept: str = "kept", n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
        """Append the text without its frequent lines, the number of lines and that of dropped ones.

        A null text is one empty line; empty lines have no key and stay.
        """
        # rows of one id and text are cleaned alike, so these two name a row
        name, hits = fresh(docs.columns, "row"), fresh(docs.columns, "hits")
        whole = fresh(docs.columns, "whole")
        named = docs.withColumn(whole, F.coalesce(F.col(text).cast("string"), F.lit("")))
        row = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col(whole))))
        named = named.withColumn(name, row)
        asked = candidates(named.select(F.col(name).alias("row"), F.col(whole).alias("text")), self.screened(), self.min_chars, self.shards)
        found = asked.join(self.frequent(), ["shard", "key"])
        drops = found.groupBy("row").agg(F.flatten(F.collect_set("lines")).alias(hits)).withColumnRenamed("row", name)
        fields = [T.StructField(kept, T.StringType()), T.StructField(n_lines, T.LongType()), T.StructField(n_dropped, T.LongType())]

        def run(texts, gone):
            out = []
            for t, g in zip(texts, gone):
                lines, g = t.split("\n"), set(g or ())
                out.append(("\n".join(x for i, x in enumerate(lines) if i not in g) if g else t, len(lines), len(g)))
            return list(zip(*out))

        joined = named.join(drops, name, "left").select(*docs.columns, whole, hits)
        return add_columns(joined, [whole, hits], fields, run, drop=(whole, hits))


def empty_index(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, shards: int = 64) -> LineIndex:
    spark = docs.sparkSession
    counts = spark.createDataFrame([], "shard int, key binary, n_docs long, n_lines long")
    return LineIndex(counts, spark.createDataFrame([], "shard int, filter binary"), min_docs, min_chars, shards)


def counted(docs: DataFrame, text: str, min_chars: int, shards: int) -> DataFrame:
    """shard, key, n_docs, n_lines of a set of documents.  Counts are combined before the shuffle."""
    texts = docs.select(F.col(text).cast("string").alias("text"))
    rows = exploded(texts, {}, min_chars, shards, False)
    return rows.groupBy("shard", "key").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_lines"))


def candidates(rows: DataFrame, filters: dict[int, bytes], min_chars: int, shards: int) -> DataFrame:
    """row, shard, key and line numbers of the lines that some filter does not exclude."""
    return exploded(rows, filters, min_chars, shards, True)


def exploded(rows: DataFrame, filters: dict[int, bytes], min_chars: int, shards: int, named: bool) -> DataFrame:
    small_batches(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(filters)
    head = "row binary, shard int, key binary, lines array<int>" if named else "shard int, key binary, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {s: CuckooFilter.from_bytes(raw) for s, raw in shared.value.items()}
        for batch in batches:
            at, keys, lines = [], [], []
            for i, t in enumerate(batch.column("text").to_pylist()):
                for key, numbers in keys_of(t, min_chars).items():
                    at.append(i)
                    keys.append(key)
                    lines.append(numbers)
            halves = np.frombuffer(b"".join(keys), dtype="<u8").reshape(-1, 2)
            shard = (halves[:, 0] % np.uint64(shards)).astype(np.int32)
            stay = np.ones(len(keys), dtype=bool)
            for s in np.unique(shard):
                if s in tables:
                    here = np.flatnonzero(shard == s)
                    stay[here] = tables[s].contains(halves[here, 1])
            kept = np.flatnonzero(stay).tolist()
            made = {"shard": pa.array(shard[stay], pa.int32()), "key": pa.array([keys[k] for k in kept], pa.binary())}
            if named:
                row = batch.column("row").take(pa.array([at[k] for k in kept], pa.int32()))
                made = {"row": row} | made | {"lines": pa.array([lines[k] for k in kept], pa.list_(pa.int32()))}
            else:
                made["n"] = pa.array([len(lines[k]) for k in kept], pa.int64())
            yield pa.RecordBatch.from_pydict(made)

    return rows.mapInArrow(run, head)


def followed(filters: DataFrame, now: DataFrame, min_docs: int) -> DataFrame:
    """The filters after a change of counts (``was`` and ``n_docs`` by key).

    Keys that crossed the limit are inserted or deleted; a filter that has no room is built anew from the
    exact counts of its shard.
    """
    over, before = F.col("n_docs") >= min_docs, F.col("was") >= min_docs
    keys = now.where(over | before).select("shard", "key", over.alias("over"), before.alias("before"))

    def run(key: tuple, old: pa.Table, rows: pa.Table) -> pa.Table:
        halves = np.frombuffer(b"".join(rows.column("key").to_pylist()), dtype="<u8").reshape(-1, 2)[:, 1]
        over, before = (np.array(rows.column(c).to_pylist(), dtype=bool) for c in ("over", "before"))
        made = None
        if old.num_rows:
            made = CuckooFilter.from_bytes(old.column("filter")[0].as_py())
            made.delete(halves[before & ~over])
            made = made if made.insert(halves[over & ~before]) else None
        made = made or CuckooFilter.of(halves[over])
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([made.to_bytes()], pa.binary())})

    return filters.groupBy("shard").cogroup(keys.groupBy("shard")).applyInArrow(run, "shard int, filter binary")


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, shards: int = 64) -> DataFrame:
    """Index all documents and clean them: kept, n_lines and n_dropped are appended."""
    return empty_index(docs, min_docs, min_chars, shards).insert(docs).clean(docs)


def clean_documents(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """The same rows and columns with frequent lines taken out of the text, and n_chars counted anew.

    Documents whose lines are all frequent stay, with an empty text; texts that lose nothing are unchanged.
    """
    kept, lines, dropped = (fresh(docs.columns, c) for c in ("kept", "n_lines", "n_dropped"))
    index = empty_index(docs, min_docs).insert(docs)
    done = index.clean(docs, kept=kept, n_lines=lines, n_dropped=dropped)
    change = {"text": F.when(F.col(dropped) > 0, F.col(kept)).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        change["n_chars"] = F.when(F.col(dropped) > 0, F.length(kept).cast(kind)).otherwise(F.col("n_chars"))
    return done.withColumns(change).select(*docs.columns)


def digests(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    cleaned = drop_frequent_lines(docs.select("doc_id", "text"), min_docs)
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
