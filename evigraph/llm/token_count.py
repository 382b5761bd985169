"""Token counts by a linear longest-match automaton.

The vocabulary is a trie. A node that is a piece pops one piece and fails to the root; any other node
fails to where its longest-match split leaves off, with the number of pieces popped on the way
precomputed. One left-to-right walk over a word then gives the number of pieces of greedy longest-match
splitting, and no piece is ever built. Characters that no piece starts with cost as many tokens as
their UTF-8 form has bytes (byte fallback).
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm._common import CACHE_ENTRIES, bound_batches

#: Fixed value: the mark that begins a word in the vocabulary's pieces.
WORD_MARK = "\u2581"

ROOT = 0


class Automaton:
    """children[v]: {character: node}; fail[v]: node or -1 at the root; popped[v]: pieces popped when v fails."""

    def __init__(self, pieces: Iterable[str]):
        self.children: list[dict[str, int]] = [{}]
        whole = [False]
        for piece in pieces:
            v = ROOT
            for c in piece:
                nxt = self.children[v].get(c)
                if nxt is None:
                    nxt = self.children[v][c] = len(self.children)
                    self.children.append({})
                    whole.append(False)
                v = nxt
            whole[v] = v != ROOT
        n = len(self.children)
        self.fail, self.popped = [-1] * n, [0] * n
        #: bytes[v]: pieces that the characters from the failing point on cost where no piece starts with them
        queue = deque([ROOT])
        while queue:
            u = queue.popleft()
            for c, v in self.children[u].items():
                if whole[v]:
                    self.fail[v], self.popped[v] = ROOT, 1
                elif u == ROOT:  # a first character that is no piece by itself
                    self.fail[v], self.popped[v] = ROOT, len(c.encode("utf-8", "replace"))
                else:
                    self.fail[v], self.popped[v] = self._step(self.fail[u], c, self.popped[u])
                queue.append(v)

    def _step(self, v: int, c: str, count: int) -> tuple[int, int]:
        """The node after reading c at v, and the pieces popped so far."""
        while True:
            nxt = self.children[v].get(c)
            if nxt is not None:
                return nxt, count
            if v == ROOT:
                return ROOT, count + len(c.encode("utf-8", "replace"))
            count += self.popped[v]
            v = self.fail[v]

    def count(self, word: str) -> int:
        v, n = ROOT, 0
        children, fail, popped = self.children, self.fail, self.popped
        for c in word:
            nxt = children[v].get(c)
            if nxt is not None:
                v = nxt
            else:
                v, n = self._step(v, c, n)
        while v != ROOT:
            n += popped[v]
            v = fail[v]
        return n


def read_pieces(path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model, read on the driver (control, unknown and byte pieces left out)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    return [model.id_to_piece(i) for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


class WordCounts(dict):
    """Pieces of a word, remembered; at most CACHE_ENTRIES words are held."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self._count = automaton.count

    def __missing__(self, word: bytes) -> int:
        n = self[word] = self._count(WORD_MARK + word.decode("utf-8", "replace"))
        return n


def count_tokens(docs: DataFrame, vocabulary_path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A row for every row of docs: the id, n_words (runs without ASCII white space, as for every operator) and n_tokens.

    A null or empty text has no words and no tokens. Repeated rows give repeated results, an empty table
    gives none; other columns are not read. The vocabulary (of fixed size) is read on the driver and its pieces are
    broadcast; each task builds the automaton once.
    """
    kind_id = docs.schema[id_col].dataType.simpleString()
    bound_batches(docs.sparkSession)
    pieces = docs.sparkSession.sparkContext.broadcast(read_pieces(vocabulary_path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = None
        for batch in batches:
            words = words if words is not None else WordCounts(_automaton(pieces.value))
            n_words, n_tokens = [], []
            for value in batch.column(1):
                found = (value.as_py() or b"").split()
                n_words.append(len(found))
                n_tokens.append(sum(map(words.__getitem__, found)))
                if len(words) > CACHE_ENTRIES:
                    words.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], names=[batch.schema.names[0], "n_words", "n_tokens"])

    return docs.select(F.col(id_col), F.col(text_col).cast("binary")).mapInArrow(count, f"`{id_col}` {kind_id}, n_words long, n_tokens long")


_BUILT: dict[str, Automaton] = {}


def _automaton(pieces: list[str]) -> Automaton:
    """One automaton a worker process and vocabulary, by the digest of its pieces."""
    key = hashlib.sha256("\0".join(pieces).encode("utf-8", "replace")).hexdigest()
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Automaton(pieces)
    return _BUILT[key]
