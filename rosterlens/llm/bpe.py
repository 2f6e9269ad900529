"""Byte-pair encoding by backtracking, and decoding by an offset table.

Instead of replaying merges, the encoder covers a piece from the left with the longest token that starts
at each place (all found by one Aho-Corasick pass) and steps back whenever two neighbours could not stand
side by side in the result of the merges.  Whether they can is answered by a pair-compatibility table,
which is filled as pairs occur.  Every place is given up at most once, so the time is linear.

Nulls are empty texts; an empty text has no tokens and decodes to itself.  Rows that repeat are encoded
each; other columns of the input are passed through.
"""

from __future__ import annotations

import json
import struct
from functools import lru_cache

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns

#: The pre-tokenizer's pattern: a fixed value of this kind of vocabulary.
PIECES = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: A space beside other white space: there a text may not be cut at spaces before the pattern is applied.
CROWDED = regex.compile(r" \s|\s ")
#: White space but space and newline.
RARE_BLANKS = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]

MEMO_ENTRIES, MEMO_CHARS = 400_000, 64
ID_BITS = 32


def crowded(text: str) -> bool:
    if any(c in text for c in RARE_BLANKS):
        return CROWDED.search(text) is not None
    return "  " in text or " \n" in text or "\n " in text


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Memo(dict):
    """Encoded pieces by text; emptied when full, and long texts never enter."""

    def __init__(self, encode, before: str = ""):
        super().__init__()
        self.encode, self.before = encode, before

    def __missing__(self, text: str) -> bytes:
        found = self.encode(self.before + text)
        if len(text) <= MEMO_CHARS:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[text] = found
        return found


class Codec:
    """Tables of one vocabulary, from the tokenizer file's content."""

    def __init__(self, content: str):
        spec = json.loads(content)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        vocab = spec["model"]["vocab"]
        size = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        self.token = [b""] * size
        for text, i in vocab.items():
            self.token[i] = raw(text)
        self.left, self.right, self.rank = [-1] * size, [-1] * size, [-1] * size
        self.merges: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right, made = vocab[a], vocab[b], vocab[a + b]
            self.merges[left, right] = rank
            if self.rank[made] < 0:
                self.left[made], self.right[made], self.rank[made] = left, right, rank
        self.together: dict[int, bool] = {}  # the pair-compatibility table
        self.find = ahocorasick.Automaton()
        usable = []
        for i in vocab.values():
            if self.rank[i] < 0 or self.stable(self.left[i], self.right[i], self.rank[i]):
                usable.append(i)
                self.find.add_word(self.token[i].decode("latin-1"), i)
        self.find.make_automaton()
        known = {self.token[i]: i for i in usable}
        self.shorter = [-1] * size  # the longest other token that a token starts with
        for i in usable:
            t = self.token[i]
            self.shorter[i] = next((known[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in known), -1)
        self.length = [len(t) for t in self.token]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for text, i in self.special.items():
            self.token[i] = text.encode()
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in self.token])]).astype(np.int64)
        self.blob = np.frombuffer(b"".join(self.token), dtype=np.uint8)
        self.first, self.later = Memo(self.chunk), Memo(self.chunk, " ")

    def stable(self, a: int, b: int, before: int) -> bool:
        """No merge of rank under ``before`` joins the end of token ``a`` to the start of ``b``.

        The merges that made both tokens are undone from the last; whatever pair then stands at the
        border must not merge earlier than what has been undone.  Of equal ranks the left one is first.
        """
        while True:
            rank = self.merges.get((a, b))
            if rank is not None and rank < before:
                return False
            if self.rank[a] < 0 and self.rank[b] < 0:
                return True
            if self.rank[a] > self.rank[b]:
                before, a = min(before, self.rank[a]), self.right[a]
            else:
                before, b = min(before, self.rank[b] + 1), self.left[b]

    def learn(self, a: int, b: int) -> bool:
        """Enter a pair into the compatibility table."""
        if len(self.together) >= MEMO_ENTRIES:
            self.together.clear()
        found = self.together[a << ID_BITS | b] = self.stable(a, b, len(self.merges))
        return found

    def piece(self, text: str) -> list[int]:
        """Tokens of one pre-tokenized piece."""
        s = text if text.isascii() else text.encode("utf-8", "surrogatepass").decode("latin-1")
        n, length, shorter, together = len(s), self.length, self.shorter, self.together
        longest = [-1] * (n + 1)
        for end, token in self.find.iter(s):
            longest[end + 1 - length[token]] = token  # of the tokens from one place the longest ends last
        at, last, token = 0, -1, longest[0]
        if length[token] == n:
            return [token]
        out: list[int] = []
        usable = bytearray(b"\x01") * (n + 1)
        while at < n:
            while token >= 0:
                if usable[at + length[token]]:
                    if last < 0:
                        break
                    fits = together.get(last << ID_BITS | token)
                    if self.learn(last, token) if fits is None else fits:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                last, token = token, longest[at]
            else:
                usable[at] = 0
                token = out.pop()
                at -= length[token]
                last = out[-1] if out else -1
        return out

    def chunk(self, text: str) -> bytes:
        ids = [i for p in PIECES.findall(text) for i in self.piece(p)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def plain(self, text: str) -> bytes:
        """A text without special tokens.  A space between two other characters always starts a piece."""
        if crowded(text):
            return b"".join(map(self.first.__getitem__, PIECES.findall(text)))
        head, *rest = text.split(" ")
        return self.first[head] + b"".join(map(self.later.__getitem__, rest))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not any(t in text for t in self.special):
            return self.plain(text)
        parts = self.cut.split(text)
        return b"".join(self.special[p].to_bytes(4, "little") if p in self.special else self.plain(p) for p in parts if p)

    def decode(self, ids: bytes) -> str:
        at = np.frombuffer(ids, dtype="<u4")
        if not len(at):
            return ""
        start, size = self.offsets[at], self.offsets[at.astype(np.int64) + 1] - self.offsets[at]
        shift = np.repeat(start - (np.cumsum(size) - size), size)
        return self.blob[shift + np.arange(len(shift))].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(content: str) -> Codec:
    return Codec(content)


def _content(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", count: str = "n_tokens") -> DataFrame:
    """Append the token ids of a text column (binary: little-endian unsigned 32-bit) and their number.

    ``vocabulary``: path, on the driver, of a byte-level BPE tokenizer file; its content, of fixed size,
    is what executors get.
    """
    shared = df.sparkSession.sparkContext.broadcast(_content(vocabulary))

    def run(texts):
        c = codec(shared.value)
        made = [c.encode(t or "") for t in texts]
        return made, [len(m) // 4 for m in made]

    return add_columns(df, [text], [T.StructField(ids, T.BinaryType()), T.StructField(count, T.LongType())], run)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Append the text of a column of token ids as ``encode`` writes them."""
    shared = df.sparkSession.sparkContext.broadcast(_content(vocabulary))

    def run(values):
        c = codec(shared.value)
        return [[c.decode(v or b"") for v in values]]

    return add_columns(df, [ids], [T.StructField(text, T.StringType())], run)


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per document: number of tokens, and digests of the ids and of the text decoded from them."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    coded = encode(docs, vocabulary).drop("text")
    back = decode(coded, vocabulary)
    return back.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
