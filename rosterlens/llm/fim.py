"""Fill-in-the-middle: documents cut into prefix, middle and suffix at token borders, and put together anew.

Tokens are runs of ASCII letters and single other characters.  A rolling hash over the last bytes cuts texts into
chunks where the content says so, so passages that documents share become the same chunks wherever they stand.
What counting needs of a chunk is a summary: its tokens, its characters, and whether it begins and ends with a
letter (a run of letters that goes over a border is one token).  Summaries are kept by content, the whole of it
being compared, in a memo of bounded size in each task.  Added up along a document they give its number of tokens
and the chunk that a cut falls in, and only within that chunk tokens are looked for one by one.

Where to cut and in which form depends on the id alone, by a digest, so results do not depend on how
documents are dealt.  A null text is empty, an empty text stays plain; a null id counts as empty digits.  Rows that
repeat or share an id are done each; an empty table gives an empty one.  Columns but id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, text_or_empty

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
PLAIN, SPM, PSM = "plain", "spm", "psm"

#: Bytes that the rolling hash sees; a chunk is never shorter, so none depends on what stands before it.
WINDOW = 32
SHORTEST, LONGEST, USUAL_BITS = 64, 4096, 9
#: Bytes hashed at a time (unless one text has more), and bytes of chunks that a memo holds.
PORTION, MEMO_BYTES = 1 << 20, 32 << 20


def _gear() -> np.ndarray:
    """A mixed 32-bit number for each byte."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) >> np.uint64(16)).astype(np.uint32)


GEAR = _gear()


def rolling(raw: np.ndarray) -> np.ndarray:
    """At each byte the sum over the window of the bytes' numbers, shifted left by their distance."""
    h = GEAR[raw]
    reach = 1
    while reach < WINDOW:
        h[reach:] = h[reach:] + (h[:-reach] << np.uint32(reach))
        reach *= 2
    return h


def borders(raw: np.ndarray) -> np.ndarray:
    """Places after which the content asks for a cut."""
    return np.flatnonzero(rolling(raw) >> np.uint32(32 - USUAL_BITS) == 0) + 1


def chunk_ends(asked: np.ndarray, start: int, end: int) -> list[int]:
    """Ends of the chunks of the bytes from ``start`` to ``end``."""
    ends, at = [], start
    while end - at > SHORTEST:
        i = np.searchsorted(asked, at + SHORTEST)
        at = min(int(asked[i]) if i < len(asked) else end, at + LONGEST, end)
        ends.append(at)
    if at < end or not ends:
        ends.append(end)
    return ends


def letters(raw: np.ndarray) -> np.ndarray:
    return (raw | 0x20) - np.uint8(97) < 26


def token_starts(chunk: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each byte: a token starts here, if nothing stands before the chunk; a character starts here."""
    raw = np.frombuffer(chunk, np.uint8)
    letter, char = letters(raw), raw & 0xC0 != 0x80
    starts = char.copy()
    starts[1:] &= ~(letter[1:] & letter[:-1])
    return starts, char


@dataclass(frozen=True, slots=True)
class Summary:
    tokens: int
    chars: int
    opens: bool  # begins with a letter
    closes: bool  # ends with one


def summary(chunk: bytes) -> Summary:
    starts, char = token_starts(chunk)
    edge = letters(np.frombuffer(chunk[:1] + chunk[-1:], np.uint8))
    return Summary(int(np.count_nonzero(starts)), int(np.count_nonzero(char)), bool(edge[0]), bool(edge[1]))


class Summaries(dict):
    """Summaries by the chunk's bytes; emptied when it holds too many."""

    held = 0

    def __missing__(self, chunk: bytes) -> Summary:
        self.held += len(chunk)
        if self.held > MEMO_BYTES:
            self.clear()
            self.held = len(chunk)
        self[chunk] = found = summary(chunk)
        return found


class Chunks:
    """A text as its chunks, with running totals of tokens and characters before each."""

    def __init__(self, raw: bytes, ends: list[int], memo: Summaries):
        self.raw, self.start = raw, [0, *ends[:-1]]
        self.tokens, self.chars, self.joins = [0], [0], []
        closes = False
        for a, b in zip(self.start, ends):
            s = memo[raw[a:b]]
            joins = closes and s.opens  # its first token began in the chunk before
            self.joins.append(joins)
            self.tokens.append(self.tokens[-1] + s.tokens - joins)
            self.chars.append(self.chars[-1] + s.chars)
            closes = s.closes

    def cut(self, n: int) -> tuple[int, int]:
        """Bytes and characters of the first ``n`` tokens."""
        if n == self.tokens[-1]:
            return len(self.raw), self.chars[-1]
        i = int(np.searchsorted(self.tokens, n, side="right")) - 1  # the last chunk with at most n tokens before it
        first = self.start[i]
        last = self.start[i + 1] if i + 1 < len(self.start) else len(self.raw)
        starts, char = token_starts(self.raw[first:last])
        at = int(np.flatnonzero(starts)[n - self.tokens[i] + self.joins[i]])
        return first + at, self.chars[i] + int(np.count_nonzero(char[:at]))


def chunked(raws: list[bytes], memo: Summaries) -> Iterator[Chunks | None]:
    """The chunks of each text, None if it is empty; texts are hashed in portions."""
    at = 0
    while at < len(raws):
        size, stop = 0, at
        while stop < len(raws) and (stop == at or size + len(raws[stop]) <= PORTION):
            size += len(raws[stop])
            stop += 1
        asked = borders(np.frombuffer(b"".join(raws[at:stop]), np.uint8)) if size else np.zeros(0, np.int64)
        start = 0
        for raw in raws[at:stop]:
            end = start + len(raw)
            yield Chunks(raw, [e - start for e in chunk_ends(asked, start, end)], memo) if raw else None
            start = end
        at = stop


def draws(key, seed: str) -> list[int]:
    """Four numbers of a row, from its id."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def transform(
    docs: DataFrame, key: str = "doc_id", text: str = "text", seed: str = "1", plain_percent: int = 10, spm_percent: int = 20
) -> DataFrame:
    """key, n (tokens), form, prefix_chars, middle_chars (null if plain) and output."""
    docs = docs.select(key, text_or_empty(docs, text).alias("_text"))
    fields = [
        T.StructField("n", T.LongType()),
        T.StructField("form", T.StringType()),
        T.StructField("prefix_chars", T.LongType()),
        T.StructField("middle_chars", T.LongType()),
        T.StructField("output", T.StringType()),
    ]
    memo = Summaries()

    def one(key, text: str, raw: bytes, c: Chunks | None):
        if c is None:
            return 0, PLAIN, None, None, ""
        n = c.tokens[-1]
        h1, h2, h3, h4 = draws(key, seed)
        if h3 % 100 >= 100 - plain_percent or any(m in text for m in MARKS):
            return n, PLAIN, None, None, text
        (a, before), (b, up_to) = (c.cut(k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
        prefix, middle, suffix = raw[:a].decode(), raw[a:b].decode(), raw[b:].decode()
        if h4 % 100 < spm_percent:
            return n, SPM, before, up_to - before, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
        return n, PSM, before, up_to - before, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"

    def run(keys, texts):
        raws = [t.encode() for t in texts]
        made = [one(*row) for row in zip(keys, texts, raws, chunked(raws, memo))]
        return list(zip(*made))

    return add_columns(docs, [key, "_text"], fields, run, drop=["_text"])


def restored(form: Column, output: Column) -> Column:
    """The text that a document had: its parts between the marks, in their old order.

    No part holds a mark, and none can arise where a part meets one, so the first of each kind is the border.
    """
    rest = F.substr(output, F.lit(len(PREFIX) + 1))

    def parts(second: str) -> tuple[Column, Column, Column]:
        one = F.substring_index(rest, second, 1)
        tail = F.substr(rest, F.length(one) + len(second) + 1)
        two = F.substring_index(tail, MIDDLE, 1)
        return one, two, F.substr(tail, F.length(two) + len(MIDDLE) + 1)

    prefix, suffix, middle = parts(SUFFIX)
    last, first, between = parts(PREFIX)
    psm, spm = F.concat(prefix, middle, suffix), F.concat(first, between, last)
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """What ``transform`` makes, and the text restored from it, as digests."""
    return transform(docs).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("form"), F.col("output")).cast("binary"), 256).alias("restored_sha256"),
    )
