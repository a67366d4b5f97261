"""Greedy word-piece counts by a longest-match automaton, without building pieces."""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.llm.common import Sent, pieces, subset
from harborline.llm.words import hash_words, split_words

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def read_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """The pieces of a rank file: base64 of the bytes, a blank, the rank."""
    with open(path, "rb") as file:
        return [base64.b64decode(line.split()[0]) for line in file if line.strip()]


class Automaton:
    """A trie over bytes with failure links and the number of pieces popped on the way.

    At a node whose string no longer continues, the greedy longest pieces of its string are popped; what is left
    of it is the node that the failure link leads to. Both follow from the parent's when the trie is built,
    so a text passes each byte once. Single bytes are always pieces, so every word splits.
    """

    def __init__(self, pieces: Iterable[bytes]):
        children: list[dict[int, int]] = [{}]
        final: list[bool] = [False]
        for piece in {*pieces, *(bytes([b]) for b in range(256))} - {b""}:
            node = 0
            for byte in piece:
                if byte not in children[node]:
                    children[node][byte] = len(children)
                    children.append({})
                    final.append(False)
                node = children[node][byte]
            final[node] = True
        fail, popped = [0] * len(children), [0] * len(children)
        level = [0]
        while level:
            below = []
            for parent in level:
                for byte, node in children[parent].items():
                    below.append(node)
                    if final[node]:
                        fail[node], popped[node] = 0, 1
                        continue
                    at, count = fail[parent], popped[parent]
                    while byte not in children[at]:
                        count += popped[at]
                        at = fail[at]
                    fail[node], popped[node] = children[at][byte], count
            level = below
        edges = sorted((node << 8 | byte, child) for node, own in enumerate(children) for byte, child in own.items())
        self.edge = np.array([e for e, _ in edges], np.int64)
        self.child = np.array([c for _, c in edges], np.int64)
        self.fail, self.popped = np.array(fail), np.array(popped)

    def lengths(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lead: bytes = b" ") -> np.ndarray:
        """Pieces of each word data[start:end] with `lead` before it; all words go byte by byte side by side."""
        order = np.argsort(starts - ends, kind="stable")  # the longest first: those still going are a prefix
        starts, size = starts[order], (ends - starts)[order]
        node = np.zeros(len(starts), np.int64)
        count = np.zeros(len(starts), np.int64)
        for byte in lead:
            self._step(node, count, np.arange(len(node)), np.full(len(node), byte))
        for at in range(int(size[0]) if len(size) else 0):
            going = np.arange(np.searchsorted(-size, -at, side="left"))
            self._step(node, count, going, data[starts[going] + at].astype(np.int64))
        left = np.flatnonzero(node)
        while len(left):
            count[left] += self.popped[node[left]]
            node[left] = self.fail[node[left]]
            left = left[node[left] != 0]
        out = np.empty_like(count)
        out[order] = count
        return out

    def _step(self, node: np.ndarray, count: np.ndarray, going: np.ndarray, byte: np.ndarray) -> None:
        while len(going):
            wanted = node[going] << 8 | byte
            at = np.minimum(np.searchsorted(self.edge, wanted), len(self.edge) - 1)
            hit = self.edge[at] == wanted
            node[going[hit]] = self.child[at[hit]]
            going, byte = going[~hit], byte[~hit]
            count[going] += self.popped[node[going]]
            node[going] = self.fail[node[going]]


def count_tokens(docs: DataFrame, vocabulary: Iterable[bytes], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Words and greedy pieces of each whole text: key, n_words, n_tokens (long).

    A word is a run between blanks, tabs and line ends and is split with one blank before it, as byte-level vocabularies
    have it. Within a piece of the batch each different word is split once. The automaton is as large as
    the vocabulary and goes to the tasks as a broadcast; rows don't move. Null and empty texts count 0 and 0;
    null and repeated keys come out as they are; an empty table gives no rows; other columns play no part.
    """
    held = Sent(docs.sparkSession, Automaton(vocabulary))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = held.value
        for batch in batches:
            for piece in pieces(batch):
                words = split_words(piece.column(1))
                _, one, which = np.unique(hash_words(words), return_index=True, return_inverse=True)
                own = automaton.lengths(words.data, words.starts[one], words.ends[one])[which]
                upto = np.concatenate([[0], np.cumsum(own)])
                columns = [piece.column(0), pa.array(np.diff(words.first)), pa.array(upto[words.first[1:]] - upto[words.first[:-1]])]
                yield pa.RecordBatch.from_arrays(columns, ["key", "n_words", "n_tokens"])

    rows = subset(docs, key, text).select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(count, "key long, n_words long, n_tokens long").withColumnRenamed("key", key)
