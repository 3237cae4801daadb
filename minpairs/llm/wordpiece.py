"""Token counts by linear longest match.

A word is split greedily into the longest pieces of a vocabulary: first a piece that
may begin a word, then pieces that continue it. An automaton over the vocabulary trie
reads each byte once: where the trie has no further edge, a failure link leads to
the node for what remains after the pieces that are then certain, and the number of
those pieces is stored with the link. Counting adds these numbers; no piece is built.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches, worker_memory

CACHE_WORDS = 500_000  # counts that a worker remembers before it starts afresh
NONE = -1


class Automaton:
    """``starts``: pieces that begin a word, ``continuations``: pieces within one (bytes)."""

    def __init__(self, starts: Iterable[bytes], continuations: Iterable[bytes]):
        self.edges: dict[int, int] = {}  # node << 8 | byte -> node
        self.nodes = 2
        self.start, self.inner = 0, 1
        final = set()
        for root, pieces in ((self.start, starts), (self.inner, continuations)):
            for piece in pieces:
                node = root
                for byte in piece:
                    key = node << 8 | byte
                    if key not in self.edges:
                        self.edges[key] = self.nodes
                        self.nodes += 1
                    node = self.edges[key]
                if piece:
                    final.add(node)
        self.link = [NONE] * self.nodes
        self.popped = [0] * self.nodes
        self._link(final)

    def _link(self, final: set[int]) -> None:
        """Failure links breadth first: a node's link depends on its parent's only."""
        children: list[list[tuple[int, int]]] = [[] for _ in range(self.nodes)]
        for key, node in self.edges.items():
            children[key >> 8].append((key & 255, node))
        queue = deque([self.start, self.inner])
        while queue:
            parent = queue.popleft()
            for byte, node in children[parent]:
                queue.append(node)
                if node in final:  # the whole path is one piece
                    self.link[node], self.popped[node] = self.inner, 1
                    continue
                at, pops = self.link[parent], self.popped[parent]
                while at != NONE and (at << 8 | byte) not in self.edges:
                    at, pops = self.link[at], pops + self.popped[at]
                if at != NONE:
                    self.link[node], self.popped[node] = self.edges[at << 8 | byte], pops

    def count(self, word: bytes) -> int:
        """Number of pieces of a non-empty word; 0 if it cannot be split."""
        edges, link, popped = self.edges, self.link, self.popped
        node, n = self.start, 0
        for byte in word:
            following = edges.get(node << 8 | byte)
            while following is None:
                n += popped[node]
                node = link[node]
                if node == NONE:
                    return 0
                following = edges.get(node << 8 | byte)
            node = following
        while node != self.inner:
            n += popped[node]
            node = link[node]
            if node == NONE:
                return 0
        return n


def read_pieces(path: str) -> tuple[list[bytes], list[bytes]]:
    """Start and continuing pieces of a byte-level rank file: pieces with a leading
    blank begin a word, those without continue one."""
    with open(path, "rb") as f:
        pieces = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
    return ([p[1:] for p in pieces if p[:1] == b" " and p[1:] and not p[1:2].isspace()],
            [p for p in pieces if not p[:1].isspace()])


def token_counts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_tokens, n_unknown``.

    Words are separated by ASCII white space. A word that cannot be split counts as
    one unknown token.

    * null or empty text: 0 of each; null or repeated ids: every row on its own;
    * very long texts and words: read whole, in time linear in their length;
    * empty table: empty result; extra columns of any name are ignored."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the automaton and the counted words stay with the worker over its tasks
        automaton, known = worker_memory().setdefault("automata", {}).get(vocabulary_path) or (Automaton(*read_pieces(vocabulary_path)), {})
        worker_memory()["automata"][vocabulary_path] = automaton, known
        for batch in batches:
            words, tokens, unknown = [], [], []
            for text in batch.column(1):
                split = (text.as_py() or "").encode("utf-8", "surrogatepass").split()  # of bytes: ASCII white space
                if len(known) > CACHE_WORDS:
                    known.clear()
                for w in split:
                    if w not in known:
                        known[w] = automaton.count(w)
                counts = list(map(known.__getitem__, split))
                words.append(len(split))
                unknown.append(counts.count(0))
                tokens.append(sum(counts) + unknown[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (words, tokens, unknown))],
                                             names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    return text_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_words long, n_tokens long, n_unknown long")
