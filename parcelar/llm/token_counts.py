"""Greedy word-piece token counts without building pieces.

The vocabulary is a trie with failure links (linear longest-match tokenisation).  Reading a word, the
automaton follows trie edges; where it cannot, the failure link leaves the node for the state that
holds the unread rest, and a precomputed number says how many pieces that step has popped.  A word costs
time linear in its length, and only counts are kept.

A SentencePiece-style vocabulary file is read as word pieces: pieces that begin with the word mark start
a word, all other ordinary pieces continue one.  Words are runs of word characters or single other
characters that are not white space; a word that pieces cannot cover counts as one unknown token.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, documents

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Distinct words whose counts a worker remembers.
MEMORY = 500_000

_WORDS = re.compile(r"\w+|[^\w\s]")


def read_vocabulary(path: str) -> tuple[list[str], list[str]]:
    """(pieces that start a word, pieces that continue one) of a SentencePiece model file."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    ordinary = [p.piece for p in model.pieces if p.type == 1]
    starts = {p[1:] for p in ordinary if p.startswith(MARK)}
    return sorted(p for p in starts if p and MARK not in p), sorted({p for p in ordinary if MARK not in p})


class LongestMatch:
    """Counts the pieces of greedy longest-match-first tokenisation; ``len(words)`` states are ints."""

    def __init__(self, starts: Iterable[str], continues: Iterable[str]):
        self.children: list[dict[str, int]] = [{}, {}]  # state 0 starts a word, state 1 continues one
        ends = [False, False]
        for root, pieces in ((0, starts), (1, continues)):
            for piece in pieces:
                at = root
                for c in piece:
                    following = self.children[at].get(c)
                    if following is None:
                        following = self.children[at][c] = len(self.children)
                        self.children.append({})
                        ends.append(False)
                    at = following
                if at > 1:
                    ends[at] = True
        self.fail = [-1] * len(self.children)
        self.popped = [0] * len(self.children)
        level = [0, 1]
        while level:  # breadth first, so that shorter prefixes are done
            below = []
            for u in level:
                for c, v in self.children[u].items():
                    below.append(v)
                    if ends[v]:
                        self.fail[v], self.popped[v] = 1, 1
                        continue
                    state, count = self.fail[u], self.popped[u]
                    while state >= 0 and c not in self.children[state]:
                        count += self.popped[state]
                        state = self.fail[state]
                    if state >= 0:
                        self.fail[v], self.popped[v] = self.children[state][c], count
            level = below

    def count(self, word: str) -> int:
        """Pieces of ``word``; 1 for a word that pieces cannot cover, 0 for the empty word."""
        if not word:
            return 0
        state = total = 0
        for c in word:
            following = self.children[state].get(c)
            while following is None:
                if self.fail[state] < 0:
                    return 1
                total += self.popped[state]
                state = self.fail[state]
                following = self.children[state].get(c)
            state = following
        while state != 1:
            if self.fail[state] < 0:
                return 1
            total += self.popped[state]
            state = self.fail[state]
        return total


class _Memory(dict):
    def __init__(self, count):
        super().__init__()
        self.of = count

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMORY:
            self.clear()
        self[word] = n = self.of(word)
        return n


def _counted(starts: list[str], continues: list[str]):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _Memory(LongestMatch(starts, continues).count)
        for batch in batches:
            words, tokens = [], []
            for text in batch["text"]:
                found = _WORDS.findall(text.as_py() or "")
                words.append(len(found))
                tokens.append(sum(map(memory.__getitem__, found)))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"]
            )

    return counted


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row: doc_id, n_words, n_tokens.

    A null or empty text has no words; null ids stay null; repeated rows each keep a row; an empty table
    gives an empty table; other columns are ignored, whatever their names.  The vocabulary (under 1 MB)
    is read on the driver and travels with the tasks.
    """
    starts, continues = read_vocabulary(vocabulary)
    bounded_batches(docs.sparkSession)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(_counted(starts, continues), f"doc_id {kind}, n_words long, n_tokens long")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir))
