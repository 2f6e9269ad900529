"""SimHash fingerprints and near duplicates by multi-index hashing.

Fingerprints are cut into segments.  If two differ in few bits, some segment of them differs in fewer
still, so every fingerprint looks up the small Hamming ball around each of its segments in a table of
all segments, and whole distances are verified on what it meets.

A segment that very many different fingerprints share would meet all of its pairs.  The fingerprints that
look into such a segment are linked exactly in another way: two words at a distance of at most r bits have
a common word half way between them, so each of them announces itself at all words within half the distance
and is linked to the smallest that did so at the same word.  That takes a fixed number of rows for each.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, fresh, shuffled_join
from .components import components
from .storage import written

BITS, SEED = 64, 42
CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of a text as a signed 64-bit number; zero if it has no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII letters and blanks only
    n = len(words)
    if not n:
        return 0
    if n <= shingle:
        return int(np.uint64(xxhash.xxh64_intdigest(b" ".join(words), SEED)).astype(np.int64))
    whole = b" ".join(words)
    starts = [0]
    for w in words:
        starts.append(starts[-1] + len(w) + 1)
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, dtype=np.int64)
    total = n - shingle + 1
    for at in range(0, total, CHUNK):
        stop = min(total, at + CHUNK)
        h = [digest(whole[i : j - 1], SEED) for i, j in zip(starts[at:stop], starts[at + shingle : stop + shingle])]
        octets = np.array(h, dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def with_fingerprints(docs: DataFrame, text: str = "text", name: str = "fp", shingle: int = 3) -> DataFrame:
    """Append the fingerprint (signed 64-bit); a null text counts as an empty one, whose fingerprint is zero."""

    def run(texts):
        return [[fingerprint(t, shingle) for t in texts]]

    return add_columns(docs, [text], [T.StructField(name, T.LongType())], run, drop=(text,))


def ball(width: int, radius: int) -> list[int]:
    """All masks of ``width`` bits with at most ``radius`` ones."""
    return [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(width), r)]


def signed(x: int) -> int:
    return x - (1 << BITS) if x >= 1 << (BITS - 1) else x


def segment(fp: Column, i: int, segments: int) -> Column:
    width = BITS // segments
    return F.shiftrightunsigned(fp, i * width).bitwiseAND((1 << width) - 1)


def links(fps: DataFrame, max_bits: int = 2, segments: int = 2, bucket_rows: int = 256) -> DataFrame:
    """Links (a < b) that connect whatever is connected by distances of at most ``max_bits``.

    ``fps``: distinct fingerprints in a column ``fp``.  All pairs that share a segment bucket of at most
    ``bucket_rows`` fingerprints are verified; larger buckets are linked by common words half way.
    Every link returned is a true one.
    """
    if segments < 2 or BITS % segments:
        raise ValueError("segments must divide 64 and be at least 2")
    fp, width = F.col("fp"), BITS // segments
    each, extra = divmod(max_bits, segments)
    radii = [each if i <= extra else each - 1 for i in range(segments)]
    searched = [i for i in range(segments) if radii[i] >= 0]
    place = lambda i, mask: F.struct(
        F.lit(i).cast("byte").alias("seg"), segment(fp, i, segments).bitwiseXOR(F.lit(mask).cast("long")).alias("key")
    )
    table = fps.select("fp", F.explode(F.array(*[place(i, 0) for i in searched])).alias("s")).select("s.*", "fp")
    masks = F.explode(F.array(*[F.struct(F.lit(i).cast("byte").alias("seg"), F.lit(m).cast("long").alias("mask")) for i in searched for m in ball(width, radii[i])]))
    piece = F.coalesce(*[F.when(F.col("p.seg") == i, segment(fp, i, segments)) for i in searched])
    probes = fps.select("fp", masks.alias("p")).select("p.seg", piece.bitwiseXOR(F.col("p.mask")).alias("key"), "fp")
    sizes = table.groupBy("seg", "key").agg(F.count("*").alias("n"))
    small = shuffled_join(table.withColumnRenamed("fp", "other"), sizes.where(F.col("n") <= bucket_rows), ["seg", "key"]).drop("n")
    near = shuffled_join(probes, small, ["seg", "key"]).where("fp < other").where(F.bit_count(fp.bitwiseXOR(F.col("other"))) <= max_bits)
    crowd = shuffled_join(probes, sizes.where(F.col("n") > bucket_rows), ["seg", "key"]).select("fp").distinct()
    return near.select(fp.alias("a"), F.col("other").alias("b")).unionByName(half_way(crowd, max_bits)).distinct()


def half_way(fps: DataFrame, max_bits: int) -> DataFrame:
    """Links of fingerprints through the words that lie between them."""
    near, far = max_bits // 2, max_bits - max_bits // 2
    words = [F.struct(F.lit(signed(m)).alias("mask"), F.lit(m.bit_count() <= near).alias("near")) for m in ball(BITS, far)]
    told = fps.select("fp", F.explode(F.array(*words)).alias("w")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("w.mask")).alias("word"), F.col("w.near").alias("near")
    )
    hubs = told.where("near").groupBy("word").agg(F.min("fp").alias("hub"))
    return shuffled_join(told, hubs, "word").where("fp <> hub").select(F.least("fp", "hub").alias("a"), F.greatest("fp", "hub").alias("b"))


def groups(fingerprints: DataFrame, max_bits: int = 2, segments: int = 2, bucket_rows: int = 256) -> DataFrame:
    """(fp, root, component_id) of the distinct fingerprints: the smallest doc_id of all that are reachable.

    ``fingerprints``: columns doc_id and fp, one row per document.  Copies are one fingerprint here.  A null
    doc_id is nobody's smallest; a component of null ids only has a null component_id.
    """
    nodes = written(fingerprints.groupBy("fp").agg(F.min("doc_id").alias("doc_id")))
    roots = components(links(nodes.select("fp"), max_bits, segments, bucket_rows)).withColumnRenamed("node", "fp")
    rooted = written(shuffled_join(nodes, roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return shuffled_join(rooted, least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2, segments: int = 2, bucket_rows: int = 256) -> DataFrame:
    """Per document row: doc_id, fingerprint (16 hex digits) and component_id.

    Null and empty texts have fingerprint zero and are linked like any other; repeated rows are each
    returned; columns other than doc_id and text are ignored.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    marked = written(with_fingerprints(docs, shingle=shingle))
    found = written(groups(marked, max_bits, segments, bucket_rows))
    return shuffled_join(marked, found, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One row of every component, its columns unchanged: the one of the smallest doc_id.

    Of rows that share doc_id and fingerprint one stays, of texts that share a doc_id in one component the
    one of the smallest fingerprint.  A row without a doc_id stays only if no row of its component has one.
    """
    fp, whole, of, its = (fresh(docs.columns, c) for c in ("fp", "whole", "of", "its"))
    marked = docs.withColumn(whole, F.col("text").cast("string"))
    marked = written(with_fingerprints(marked, whole, fp, shingle))
    names = marked.select("doc_id", F.col(fp).alias("fp"))
    found = groups(names, max_bits)
    first = F.min(F.struct("doc_id", "fp")).alias("first")
    keep = shuffled_join(names, found, "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(first)
    keep = keep.select(F.col("first.doc_id").alias(of), F.col("first.fp").alias(its))
    same = F.col("doc_id").eqNullSafe(F.col(of)) & (F.col(fp) == F.col(its))
    return shuffled_join(marked, keep, same, "left_semi").dropDuplicates(["doc_id", fp]).select(*docs.columns)
