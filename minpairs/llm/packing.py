"""Packing documents into fixed-length training sequences (shortest-pack-first).

Documents are tokenized, closed with an end id and cut at multiples of the
sequence length; the pieces' lengths form a histogram of at most ``max_tokens``
bins, the only thing the driver sees. Lengths are placed longest first, each
into the emptiest packs that still fit, and packs are handled as *patterns with
counts*, never one by one. Every pattern reserves a rank range of each length it
holds, so a piece finds its sequence by its rank among the pieces of its length.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage, text_batches, worker_memory

# distinct word chunks whose ids a worker remembers before it starts afresh, unless told otherwise (about 200 bytes each)
CACHE_CHUNKS = 800_000
# rows of one length that are ranked together; a length with more is salted
RANK_ROWS = 1_000

# A pre-token of the byte-level vocabulary never holds a non-space followed by a
# space, so a text may be cut before a run of blanks or line feeds. Texts with any
# other white space, or with the string of a special token, are encoded whole.
_CHUNK = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_OTHER_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]


class ChunkEncoder:
    """Ids of a text as little-endian unsigned 32-bit bytes; remembers chunks.

    A chunk is a word with the white space before it. Plain words go to the
    tokenizer's model directly, everything else through the whole tokenizer."""

    def __init__(self, path: str, remember: int = CACHE_CHUNKS):
        self.remember = remember
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tok.get_added_tokens_decoder().values()]  # the tokenizer finds them in a text
        self.cache: dict[str, bytes] = {"": b""}
        bytewise = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        one = lambda c: bytewise.pre_tokenize_str(c)[0][0]
        self.letters = {i: one(chr(i)) for i in range(32, 0x250) if chr(i) == " " or chr(i).isalpha()}

    @classmethod
    def of_worker(cls, path: str, remember: int) -> "ChunkEncoder":
        """One encoder per worker process, kept over its tasks."""
        known = worker_memory().setdefault("chunk_encoders", {})
        if (path, remember) not in known:
            known[path, remember] = cls(path, remember)
        return known[path, remember]

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()

    def _chunk(self, chunk: str) -> bytes:
        tail = chunk[-1] if chunk[-1] in ".," else ""
        word = chunk[:-1] if tail else chunk
        if not (word[1:] if word[:1] == " " else word).isalpha() or ord(max(word)) >= 0x250:
            return self._whole(chunk)
        if tail:
            return self.of(word) + self.of(tail)
        return array("I", [t.id for t in self.tok.model.tokenize(word.translate(self.letters))]).tobytes()

    def of(self, chunk: str) -> bytes:
        ids = self.cache.get(chunk)
        if ids is None:
            if len(self.cache) >= self.remember:
                self.cache = {"": b""}
            ids = self.cache[chunk] = self._chunk(chunk)
        return ids

    def __call__(self, text: str) -> bytes:
        if any(c in text for c in _OTHER_SPACES) or any(t in text for t in self.specials):
            return self._whole(text)
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or "\0" in text:
            chunks = _CHUNK.findall(text)
        else:  # single separators only: split at C speed, and put them back
            chunks = text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
        try:
            return b"".join(map(self.cache.__getitem__, chunks))
        except KeyError:
            return b"".join(map(self.of, chunks))


def token_pieces(docs: DataFrame, tokenizer_path: str, *, end_id: int = 1, max_tokens: int = 2048,
                 id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, remember: int = CACHE_CHUNKS) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens`` (and ``ids``) per piece."""
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long"
    schema += ", ids binary" if with_ids else ""
    end = np.array([end_id], dtype="<u4").tobytes()
    step = 4 * max_tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ChunkEncoder.of_worker(tokenizer_path, remember)
        for batch in batches:
            row, start, length, crc, total, ids = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                data = encode(text.as_py() or "") + end
                for at in range(0, len(data), step):
                    part = data[at:at + step]
                    row.append(i)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(len(data) // 4)
                    if with_ids:
                        ids.append(part)
            cols = [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                cols.append(pa.array(ids, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return text_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def pack_histogram(counts: dict[int, int], max_tokens: int) -> list[tuple[int, int, int, int, int, int]]:
    """Shortest-pack-first over a length histogram.

    Returns rank ranges ``(length, first_rank, end_rank, copies, sequence, offset)``:
    rank ``r`` of ``length`` in ``[first_rank, end_rank)`` lies in sequence
    ``sequence + (r - first_rank) // copies`` at ``offset + length * ((r - first_rank) % copies)``.

    A heap holds patterns by free space. A step fills one pattern's packs alike
    or splits the pattern once, when the length runs out, so there are at most
    two patterns per length however many pieces there are."""
    heap: list[tuple[int, int, int, tuple]] = []  # (-space, tie, packs, items (length, copies, first rank))
    tie = 0

    def push(space: int, packs: int, items: tuple) -> None:
        nonlocal tie
        tie += 1
        heapq.heappush(heap, (-space, tie, packs, items))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            if not heap or -heap[0][0] < length:
                fit = max_tokens // length  # no pack has room: open new ones, filled with this length alone
                each = 1 if left < fit else min(fit, max(1, left // max(1, -(-left // fit))))
                packs = left // each
                push(max_tokens - each * length, packs, ((length, each, rank),))
                rank, left = rank + packs * each, left - packs * each
                continue
            space, _, packs, items = heapq.heappop(heap)
            space = -space
            if left < packs:  # the length ends inside this pattern: split it
                push(space, packs - left, tuple((n, c, r + left * c) for n, c, r in items))
                packs, each = left, 1
            else:  # level the packs with the next emptiest ones
                below = -heap[0][0] if heap else -1
                each = max(1, min(left // packs, space // length, (space - below) // length if below >= 0 else space // length))
            push(space - each * length, packs, (*items, (length, each, rank)))
            rank, left = rank + packs * each, left - packs * each

    out, sequence = [], 0
    for _, _, packs, items in sorted(heap, key=lambda x: x[1]):
        offset = 0
        for n, c, r in items:
            out.append((n, r, r + packs * c, c, sequence, offset))
            offset += n * c
        sequence += packs
    return out


def pack(docs: DataFrame, tokenizer_path: str, *, end_id: int = 1, max_tokens: int = 2048,
         id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, remember: int = CACHE_CHUNKS) -> DataFrame:
    """Pack all documents into sequences of at most ``max_tokens`` ids.

    One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset`` and, ``with_ids``, the piece's ids as little-endian
    unsigned 32-bit ``binary``. ``remember``: word chunks whose ids a worker keeps.

    * null or empty text: one piece that holds the end id alone;
    * null or repeated ids: every row is packed on its own;
    * very long texts: encoded whole, cut into as many pieces as needed;
    * empty table: empty result; extra columns are ignored."""
    pieces = token_pieces(docs, tokenizer_path, end_id=end_id, max_tokens=max_tokens, id_col=id_col, text_col=text_col, with_ids=with_ids, remember=remember)
    names = pieces.columns
    # a row number is stored with each piece: later reads agree on it, however the files are split then
    pieces = stage(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most max_tokens rows
    ranges = sorted(pack_histogram(counts, max_tokens))

    # rank within the length: salted, so that a length with most rows spreads out
    salts = F.create_map(*[F.lit(x) for n, c in sorted(counts.items()) if c > RANK_ROWS
                           for x in (n, -(-c // RANK_ROWS))]) if any(c > RANK_ROWS for c in counts.values()) else None
    n_salts = F.coalesce(F.try_element_at(salts, F.col("length").cast("int")), F.lit(1)) if salts is not None else F.lit(1)
    rows = pieces.withColumn("_salt", F.pmod(F.xxhash64("_row"), n_salts).cast("int"))
    sizes = rows.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    sizes = sizes.withColumn("_before", F.sum("_n").over(
        Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)))
    sizes = stage(sizes.select("length", "_salt", F.coalesce("_before", F.lit(0)).alias("_before")), "rank_offsets")
    order = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("_row"))
    ranked = (rows.withColumn("_order", order).join(sizes, ["length", "_salt"])
              .withColumn("_rank", F.col("_order") - 1 + F.col("_before")))

    table = np.array(ranges, dtype=np.int64).reshape(-1, 6)  # at most some entries per length: bounded
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = table[:, 0] * (1 << 44) + table[:, 1]
        for b in batches:
            length = b.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = b.column("_rank").to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.searchsorted(first, length * (1 << 44) + rank, side="right") - 1
            _, r0, _, copies, sequence, offset = table[at].T
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in names), pa.array(sequence + (rank - r0) // copies),
                 pa.array(offset + length * ((rank - r0) % copies))], names=[*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields if f.name in names)
    return ranked.select(*names, "_rank").mapInArrow(place, f"{fields}, sequence_id long, offset long")
