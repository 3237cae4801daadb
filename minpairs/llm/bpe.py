"""Byte-level BPE by monoid tree reduction.

A text's ids form a monoid under a join that repairs the seam. A piece of text is
encoded by halves, recursively; two neighbours are joined by encoding a window around
the seam anew and growing it until the tokens outside stand.

Why they stand: merging takes the adjacent pair of least rank, leftmost first, so merges
on one side of a boundary that is never crossed happen as if the side stood alone. A
sequence of tokens is therefore the encoding of its bytes exactly if every two
neighbours are the encoding of *their* bytes (a crossing merge would show in the pair).
After a join only the two pairs at the window's ends are new; if both hold, the whole
sequence is the encoding, however long it is.

Pieces are the matches of a pattern, encoded separately: the join of two pieces is
plain concatenation, and texts are cut into segments at places no match spans.
Decoding concatenates up the same tree.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches, worker_memory

LEAF_BYTES, MEMO_BYTES, LEAF_IDS = 4, 10, 4096
SEGMENT = 1 << 16  # characters of a text that are split into chunks at once
CACHE_CHUNKS, CACHE_JOINS = 300_000, 250_000  # what a worker remembers of each kind before it forgets
HEAP_TOKENS = 48  # windows of more bytes are merged with a heap
# fixed values: marks that a chunk may end in; white space besides blank and line feed, as the pattern's \s has it
MARKS = (",", ".", ";", ":", "!", "?", ")")
OTHER_SPACES = "\t\x0b\x0c\r\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200b)))

Ids = tuple[int, ...]


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with a base64 token and its rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Codec:
    """Encoder and decoder for one rank file and one splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.matches = ranks, regex.compile(pattern).findall
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.seams: dict[int, bool] = {}  # two ids -> whether they stand side by side
        self.small: dict[bytes, Ids] = {}  # leaves and short windows
        self.chunks: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        self.spaces = regex.compile(f"[{OTHER_SPACES}]").search
        self.words = regex.compile(rf"[ \n{OTHER_SPACES}]*[^ \n{OTHER_SPACES}]+|[ \n{OTHER_SPACES}]+").findall

    @classmethod
    def of_worker(cls, path: str, pattern: str) -> "Codec":
        """One codec per worker process, kept over its tasks."""
        known = worker_memory().setdefault("codecs", {})
        if (path, pattern) not in known:
            known[path, pattern] = cls(read_ranks(path), pattern)
        return known[path, pattern]

    # --- the monoid: ids of a stretch of bytes, and the join of two neighbours ---------------

    def merge(self, data: bytes) -> Ids:
        """Ids of a window, by its merges one after another."""
        if len(data) > HEAP_TOKENS:
            return self._merge_long(data)
        known = self.small.get(data)
        if known is not None:
            return known
        ranks, parts = self.ranks, [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        out = tuple([ranks[p] for p in parts])
        self._remember(data, out)
        return out

    def _remember(self, data: bytes, ids: Ids) -> None:
        if len(self.small) >= CACHE_JOINS:
            self.small.clear()
        self.small[data] = ids

    def _merge_long(self, data: bytes) -> Ids:
        """The same with a heap of (rank, place) and linked places; memory per byte is small."""
        ranks, n = self.ranks, len(data)
        after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        end = array("q", range(1, n + 1))  # a part's end; 0 where the part is gone
        heap = [rank * (n + 1) + i for i in range(n - 1) if (rank := ranks.get(data[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = divmod(heapq.heappop(heap), n + 1)
            j = after[i]
            if not end[i] or j >= n or ranks.get(data[i:end[j]]) != rank:
                continue  # one of the two was merged since
            end[i], end[j], after[i] = end[j], 0, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks.get(data[i:end[after[i]]])) is not None:
                    heapq.heappush(heap, r * (n + 1) + i)
            if before[i] >= 0 and (r := ranks.get(data[before[i]:end[i]])) is not None:
                heapq.heappush(heap, r * (n + 1) + before[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i:end[i]]])
            i = after[i]
        return tuple(out)

    def stands(self, a: int, b: int) -> bool:
        """Whether ids ``a, b`` are the encoding of their bytes."""
        key = a << 32 | b
        known = self.seams.get(key)
        if known is None:
            if len(self.seams) >= CACHE_JOINS:
                self.seams.clear()
            known = self.seams[key] = self.merge(self.bytes[a] + self.bytes[b]) == (a, b)
        return known

    def join(self, a: Ids, b: Ids) -> Ids:
        """Ids of the bytes of ``a`` followed by those of ``b``; both are encodings."""
        if not a or not b or self.stands(a[-1], b[0]):
            return a + b
        i = j = 1  # tokens of a and b in the window
        while True:
            w = self.merge(b"".join([self.bytes[x] for x in (*a[len(a) - i:], *b[:j])]))
            left = i == len(a) or w[0] == a[-i] or self.stands(a[-i - 1], w[0])
            right = j == len(b) or w[-1] == b[j - 1] or self.stands(w[-1], b[j])
            if left and right:
                return a[:len(a) - i] + w + b[j:]
            i, j = i if left else min(len(a), 2 * i), j if right else min(len(b), 2 * j)

    def reduce(self, data: bytes) -> Ids:
        """Ids of ``data``: halves encoded, then joined."""
        n = len(data)
        if n <= LEAF_BYTES:
            return self.merge(data)
        if n > MEMO_BYTES:
            half = 1 << (n - 1).bit_length() - 1  # in long runs seams fall where merges end
            return self.join(self.reduce(data[:half]), self.reduce(data[half:]))
        out = self.small.get(data)
        if out is None:
            half = n // 2
            a, b = self.reduce(data[:half]), self.reduce(data[half:])
            out = a + b if self.seams.get(a[-1] << 32 | b[0]) else self.join(a, b)
            self._remember(data, out)
        return out

    # --- pieces, chunks and texts ------------------------------------------------------------

    def piece(self, text: str) -> Ids:
        """Ids of one match; a match that is a token as a whole is that token."""
        data = text.encode("utf-8", "replace")
        whole = self.ranks.get(data)
        return self.reduce(data) if whole is None else (whole,)

    def chunk(self, chunk: str) -> bytes:
        """Ids, little-endian unsigned 32-bit, of a chunk: white space and what follows up to the next."""
        ids = self.chunks.get(chunk)
        if ids is None and (ids := self.older.get(chunk)) is not None:
            self.chunks[chunk] = ids
        if ids is None:
            # a word of letters and one mark after it are two matches, each remembered alone
            tail = chunk[-1:] if chunk[-1:] in MARKS else ""
            word = chunk[:-1] if tail else chunk
            if not (word[1:] if word[:1] == " " else word).isalpha():
                ids = array("I", [x for m in self.matches(chunk) for x in self.piece(m)]).tobytes()
            elif tail:
                ids = self.chunk(word) + self.chunk(tail)
            else:
                ids = array("I", self.piece(word)).tobytes()
            if len(chunk) <= 64:
                if len(self.chunks) >= CACHE_CHUNKS:  # a full memory is kept aside for what is asked for again
                    self.older, self.chunks = self.chunks, {"": b""}
                self.chunks[chunk] = ids
        return ids

    def segment(self, text: str) -> bytes:
        """Ids of a stretch that begins and ends where no match goes on."""
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or "\0" in text or self.spaces(text):
            chunks = self.words(text)
        else:  # single separators only: split at C speed, and put them back
            chunks = text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
        try:
            return b"".join(map(self.chunks.__getitem__, chunks))
        except KeyError:
            return b"".join(map(self.chunk, chunks))

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers.

        A match never holds a non-space followed by a blank or line feed, so a text
        may be cut before these; segments are cut there, wherever one is."""
        if len(text) <= SEGMENT:
            return self.segment(text)
        parts, at = [], 0
        while at < len(text):
            to = at + SEGMENT
            while to < len(text) and not (text[to] in " \n" and not text[to - 1].isspace()):
                to += 1
            parts.append(self.segment(text[at:to]))
            at = to
        return b"".join(parts)

    def decode(self, ids: bytes | np.ndarray) -> bytes:
        """Bytes of ids: those of both halves, one after the other."""
        x = np.frombuffer(ids, dtype="<u4") if isinstance(ids, bytes) else ids
        if len(x) <= LEAF_IDS:
            return b"".join(map(self.bytes.__getitem__, x.tolist()))
        half = len(x) // 2
        return self.decode(x[:half]) + self.decode(x[half:])


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_tokens, ids``; ``ids`` is binary, little-endian
    unsigned 32-bit integers. No special tokens: their strings are ordinary text.

    * null or empty text: no ids (0 bytes); null or repeated ids: every row on its own;
    * very long texts: whole, segment by segment; a very long match (a run without
      blanks) by halves, with small windows unless its merges depend on its far start;
    * empty table: empty result; extra columns of any name are ignored."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of_worker(ranks_path, pattern)
        for b in batches:
            ids = [codec.encode(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                                             names=["doc_id", "n_tokens", "ids"])

    return text_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids binary")


def decode(encoded: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with ``out_col``, the bytes of its ids (null where they are null). A
    column that already has that name is replaced; ids outside the vocabulary raise."""
    encoded = encoded.drop(out_col)
    at = encoded.columns.index(ids_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of_worker(ranks_path, pattern)
        for b in batches:
            data = [None if x is None else codec.decode(x) for x in (v.as_py() for v in b.column(at))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(data, pa.binary())], names=[*b.schema.names, out_col])

    return text_batches(encoded).mapInArrow(run, f"{schema}, `{out_col}` binary")
