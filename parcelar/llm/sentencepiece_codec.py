"""SentencePiece encoding and decoding with a batched numpy Viterbi search.

Texts are cut where no piece can cross (before the mark of a word, and around characters that no piece
has).  The distinct words of a batch are grouped by length, and all words of one length advance together
over their end positions.  Substring hashes, differences of prefix hashes, probe the sorted keys of the
pieces; of the pieces that can end a position the best is kept, with a back pointer to its start.

What is best depends on the model.  A *unigram* model adds scores.  In a *BPE* model scores rank merges
and sums mean nothing, so a plain sum would give other ids than the model's own.  There a path is a
BPE encoding exactly if each pair of neighbours is the encoding of their concatenation; the search keeps
the best-scored piece that is compatible in this sense with the piece its predecessor kept.  Compatibility
is decided for all candidates of a position at once, by undoing the merges of the two pieces in reverse
order and looking for a merge across the boundary that would have come first.  Words for which the
search doesn't find one single compatible piece (only with pieces that don't come from merges of their
own parts, such as runs of marks) are merged by a heap, which is exact for every word.

A word of more than ``LONG`` characters (scripts without blanks, minified code) is cut into overlapping parts
of one length, which advance together like words.  Neighbouring parts are joined at a boundary that both
have, where the two pieces are compatible; since neighbours decide, the joined path is the encoding of the
whole.  If two parts have no such boundary, the heap merges the word.  A unigram model takes long words in
one pass that looks back as far as its longest piece.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, documents, give_back, giving_back

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Words whose ids a task remembers, and bytes of text that are encoded at a time (about); both only bound a worker's memory.
MEMORY, PIECE = 200_000, 3_000_000
#: Words, or ids, of which a step looks up the ids, or the bytes, at once.
STEP = 50_000
#: Characters of the words that one search holds at once.
BATCH = 400_000
#: Characters from which a word is cut into parts, those of a part, and those that neighbours share at least.
LONG, PART, SHARED = 512, 256, 64

_P = np.uint64(0x9E3779B97F4A7C15)
_FAR = np.int64(1) << np.int64(40)


class _Keys:
    """Distinct sorted 64-bit keys, entered by their upper bits.

    Most keys that are probed are not there, and most of those fall where no key begins with their upper
    bits; only the others are compared.
    """

    BITS = 20

    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        top = (self.keys >> np.uint64(64 - self.BITS)).astype(np.int64)
        self.count = np.bincount(top, minlength=1 << self.BITS).astype(np.uint8)
        self.start = (np.cumsum(self.count) - self.count).astype(np.int32)
        self.most = int(self.count.max(initial=0))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of the probed keys that are there, and the place of each in the keys as given."""
        top = (keys >> np.uint64(64 - self.BITS)).astype(np.int64)
        who = np.flatnonzero(self.count[top])
        top, wanted = top[who], keys[who]
        spot = self.start[top]
        end = spot + self.count[top]
        hits, places = [], []
        for _ in range(self.most):
            same = self.keys[spot] == wanted
            hits.append(who[same])
            places.append(spot[same])
            spot = spot + 1
            go = ~same & (spot < end)
            who, wanted, spot, end = who[go], wanted[go], spot[go], end[go]
        if not hits:
            return who, who
        return np.concatenate(hits), self.order[np.concatenate(places)]


class _Numbers(dict):
    """Words numbered as they first come."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Memory:
    """Ids of words as packed 32-bit integers, in two generations so that frequent words stay."""

    def __init__(self, size: int = MEMORY):
        self.size, self.young, self.old = size, {}, {}

    def find(self, words: list[str], encode) -> list[bytes]:
        young, old = self.young, self.old
        own = [young.get(w) or old.get(w) for w in words]
        missing = sorted(w for w, ids in zip(words, own) if ids is None)
        new = encode(missing)
        own = [ids if ids is not None else new[w] for w, ids in zip(words, own)]
        if len(young) + len(words) > self.size // 2:
            self.old, self.young = young, {}
        self.young.update((w, ids) for w, ids in zip(words, own) if len(w) <= LONG)
        return own


class Codec:
    """Ids of texts and texts of ids for one SentencePiece model, given as the bytes of its file."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        kind = proto.trainer_spec.model_type
        if kind not in (1, 2):
            raise ValueError("only unigram and BPE models are supported")
        if proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models that leave the text as it is are supported")
        self.bpe = kind == 2
        self.prefix = proto.normalizer_spec.add_dummy_prefix
        self.pieces = [p.piece for p in proto.pieces]
        self.scores = np.array([p.score for p in proto.pieces])
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == 2)
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        usable = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        if any(MARK in p.lstrip(MARK) for p in usable):
            raise ValueError("pieces that hold a mark behind other characters are not supported")
        self.ids = usable
        self.longest = max(map(len, usable))
        known = sorted(set("".join(usable)) - {MARK})
        inside = "".join(map(re.escape, known))
        self.cut = re.compile(f"{MARK}*[{inside}]+|{MARK}+|[^{inside}{MARK}]")
        self.known = set(known) | {MARK}
        self.lengths = np.array([len(p) for p in self.pieces])
        # Bytes of each id, for decoding.
        text = [p.piece.replace(MARK, " ").encode() if p.type in (1, 4) else b"" for p in proto.pieces]
        for value, i in self.byte.items():
            text[i] = bytes([value])
        text[self.unknown] = " ⁇ ".encode()
        self.widths = np.array([len(t) for t in text])
        self.offsets = np.cumsum(self.widths) - self.widths
        self.blob = np.frombuffer(b"".join(text), np.uint8)
        self.rank = np.full(len(self.pieces), _FAR)
        if self.bpe:
            values = sorted({self.scores[i] for i in usable.values()}, reverse=True)
            order = {v: r for r, v in enumerate(values)}
            for i in usable.values():
                self.rank[i] = order[self.scores[i]]
            self._derive()
        found = [(p, i) for p, i in usable.items() if not self.bpe or self.reachable[i]]
        keys = np.array([_key(p) for p, _ in found], np.uint64)
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two pieces share a hash")
        self.keys, self.key_ids = _Keys(keys), np.array([i for _, i in found])

    # -- merges ---------------------------------------------------------------------------------

    def _merge(self, word: str) -> tuple[list[str], tuple[str, str] | None]:
        """Pieces of a word by repeated best merge (leftmost on a tie), and the two parts merged last."""
        parts: list[str | None] = list(word)
        left, right = list(range(-1, len(word) - 1)), list(range(1, len(word) + 1))
        queue: list[tuple[int, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < len(parts):
                i = self.ids.get(joined := parts[a] + parts[b])
                if i is not None:
                    heapq.heappush(queue, (self.rank[i], a, b, joined))

        for a in range(len(parts) - 1):
            offer(a, a + 1)
        last = None
        while queue:
            _, a, b, joined = heapq.heappop(queue)
            if parts[a] is None or parts[b] is None or right[a] != b or parts[a] + parts[b] != joined:
                continue
            last = (parts[a], parts[b])
            parts[a], parts[b] = joined, None
            right[a] = right[b]
            if right[a] < len(parts):
                left[right[a]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [p for p in parts if p is not None], last

    def _derive(self) -> None:
        """For each piece the two parts of its last merge and when it appears; ranks of merged pairs."""
        n = len(self.pieces)
        self.reachable = np.zeros(n, bool)
        self.first, self.second = np.full(n, -1), np.full(n, -1)
        self.born = np.full(n, -1, np.int64)
        for p, i in sorted(self.ids.items(), key=lambda x: len(x[0])):
            got, last = self._merge(p)
            if len(got) != 1:
                continue
            if last is None:
                self.reachable[i] = True
            elif all(x in self.ids and self.reachable[self.ids[x]] and self.born[self.ids[x]] < self.rank[i] for x in last):
                self.reachable[i] = True
                self.first[i], self.second[i] = self.ids[last[0]], self.ids[last[1]]
                self.born[i] = self.rank[i]
        pairs = {}
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = self.rank[i]
        keys = np.array(list(pairs), np.int64)
        self.pair_keys, self.pair_ranks = _Keys(_pair(keys >> 32, keys & 0xFFFFFFFF)), np.array(list(pairs.values()), np.int64)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair of reachable pieces is the encoding of its concatenation."""
        good = np.ones(len(a), bool)
        at = np.arange(len(a))
        x, y = a.astype(np.int64), b.astype(np.int64)
        until_x = np.full(len(a), _FAR)
        until_y = until_x.copy()
        while len(at):
            who, spot = self.pair_keys.find(_pair(x, y))
            merged = np.full(len(x), _FAR)
            merged[who] = self.pair_ranks[spot]
            crossed = (merged < until_x) & (merged <= until_y) & (merged < _FAR)
            good[at[crossed]] = False
            born_x, born_y = self.born[x], self.born[y]
            go = ~crossed & ((born_x >= 0) | (born_y >= 0))
            at, x, y, until_x, until_y, born_x, born_y = (v[go] for v in (at, x, y, until_x, until_y, born_x, born_y))
            undo = born_x > born_y
            until_x, until_y = np.where(undo, born_x, until_x), np.where(undo, until_y, born_y)
            x, y = np.where(undo, self.second[x], x), np.where(undo, y, self.first[y])
        return good

    # -- search ---------------------------------------------------------------------------------

    def _search(self, words: list[str]) -> list[tuple[int, ...] | None]:
        """Ids of words of one length; None where the search found no single answer."""
        n, count = len(words[0]), len(words)
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(count, n).astype(np.uint64)
        prefix = np.zeros((n + 1, count), np.uint64)
        for e in range(n):
            prefix[e + 1] = prefix[e] * _P + codes[:, e] + np.uint64(1)
        power = [np.uint64(pow(int(_P), k, 2**64)) for k in range(self.longest + 1)]
        best = np.full((n + 1, count), -np.inf)
        best[0] = 0
        piece = np.full((n + 1, count), -1, np.int64)
        start = np.zeros((n + 1, count), np.int32)
        single = np.ones(count, bool)
        for e in range(1, n + 1):
            rows, ids, starts = [], [], []
            for s in range(max(0, e - self.longest), e):
                key = _finish(prefix[e] - prefix[s] * power[e - s], e - s)
                hit, spot = self.keys.find(key)
                if not self.bpe:  # a BPE word with a gap is known not to be single already
                    reached = best[s, hit] > -np.inf
                    hit, spot = hit[reached], spot[reached]
                rows.append(hit)
                ids.append(self.key_ids[spot])
                starts.append(np.full(len(hit), s))
            row, i, s = map(np.concatenate, (rows, ids, starts))
            if self.bpe:
                before = piece[s, row]
                good = s == 0
                rest = np.flatnonzero(~good)
                good[rest] = self.compatible(before[rest], i[rest])
                row, i, s = row[good], i[good], s[good]
                single &= np.bincount(row, minlength=count) == 1
                score = self.scores[i]
            else:
                score = best[s, row] + self.scores[i]
            order = np.lexsort((-s, score, row))  # the best of each word comes last; on a tie the longer piece
            row, i, s, score = row[order], i[order], s[order], score[order]
            last = np.append(row[1:] != row[:-1], True)[: len(row)]
            best[e, row[last]] = 0 if self.bpe else score[last]
            piece[e, row[last]], start[e, row[last]] = i[last], s[last]
        single &= best[n] > -np.inf
        out: list[list[int]] = [[] for _ in words]
        at = np.full(count, n)
        live = np.flatnonzero(single)
        while len(live):
            here = at[live]
            for w, i in zip(live.tolist(), piece[here, live].tolist()):
                out[w].append(i)
            at[live] = start[here, live]
            live = live[at[live] > 0]
        return [tuple(reversed(o)) if ok else None for o, ok in zip(out, single.tolist())]

    def _spelled(self, piece: str) -> list[int]:
        if (i := self.ids.get(piece)) is not None:
            return [i]
        if self.byte:
            return [self.byte[b] for b in piece.encode()]
        return [self.unknown]

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of distinct words, as the model's regular expression cuts them, as packed 32-bit integers."""
        found: dict[str, bytes] = {}
        groups: dict[int, list[str]] = {}
        long = []
        for w in words:
            if len(w) == 1:
                found[w] = _packed(self._spelled(w))
            elif len(w) > LONG:
                long.append(w)
            else:
                groups.setdefault(len(w), []).append(w)
        for w, ids in zip(long, self._long(long)):
            found[w] = _packed(ids if ids is not None else self._whole(w))
        for n, group in groups.items():
            step = max(1, BATCH // n)
            for k in range(0, len(group), step):
                part = group[k : k + step]
                for w, ids in zip(part, self._search(part)):
                    found[w] = _packed(ids if ids is not None else self._whole(w))
        return found

    def _whole(self, word: str) -> tuple[int, ...]:
        """Ids of any one word, without a batch."""
        return tuple(chain.from_iterable(map(self._spelled, self._merge(word)[0]))) if self.bpe else self._with_unknown(word)

    def _long(self, words: list[str]) -> list[tuple[int, ...] | None]:
        """Ids of long words by joined parts; None where that gives no answer."""
        if not self.bpe:
            return [None] * len(words)
        begins = [[*range(0, len(w) - PART, PART - SHARED), len(w) - PART] for w in words]
        parts = [w[b : b + PART] for w, own in zip(words, begins) for b in own]
        distinct = list(dict.fromkeys(parts))
        known: dict[str, tuple[int, ...] | None] = {}
        step = max(1, BATCH // PART)
        for k in range(0, len(distinct), step):
            known.update(zip(distinct[k : k + step], self._search(distinct[k : k + step])))
        out, at = [], 0
        for own in begins:
            out.append(self._joined(own, [known[p] for p in parts[at : at + len(own)]]))
            at += len(own)
        return out

    def _joined(self, begins: list[int], parts: list[tuple[int, ...] | None]) -> tuple[int, ...] | None:
        if any(p is None for p in parts):
            return None
        ids = [np.array(p, np.int64) for p in parts]
        ends = [b + np.cumsum(self.lengths[i]) for b, i in zip(begins, ids)]
        left, right, pair = [], [], []  # boundaries that part n and part n + 1 have in common
        for n, b in enumerate(begins[1:]):
            starts = np.append(b, ends[n + 1][:-1])
            _, x, y = np.intersect1d(ends[n], starts, assume_unique=True, return_indices=True)
            left.append(x)
            right.append(y)
            pair.append(np.full(len(x), n))
        x, y, n = map(np.concatenate, (left, right, pair))
        before = np.concatenate(ids)[(np.cumsum([0, *map(len, ids)])[n] + x)]
        after = np.concatenate(ids)[(np.cumsum([0, *map(len, ids)])[n + 1] + y)]
        good = self.compatible(before, after)
        x, y, n = x[good], y[good], n[good]
        out, begin = [], 0
        for k in range(len(parts) - 1):
            a, b = np.searchsorted(n, [k, k + 1])
            a += np.searchsorted(x[a:b], begin)  # not before the boundary with the part before
            if a >= b:
                return None
            mid = (a + b) // 2
            out.append(ids[k][begin : x[mid] + 1])
            begin = y[mid]
        out.append(ids[-1][begin:])
        return tuple(np.concatenate(out).tolist())

    def _with_unknown(self, word: str) -> tuple[int, ...]:
        """Unigram search for one word, in which some character may not be a piece by itself."""
        least = min(self.scores[i] for i in self.ids.values()) - 10
        best: list[tuple[float, int]] = [(0.0, 0)]
        for e in range(1, len(word) + 1):
            options = [(best[e - 1][0] + least, 1 - e)] if word[e - 1] not in self.ids else []
            for s in range(max(0, e - self.longest), e):
                if (i := self.ids.get(word[s:e])) is not None:
                    options.append((best[s][0] + self.scores[i], -s))
            best.append(max(options))
        out, e = [], len(word)
        while e:
            out.append(word[-best[e][1] : e])
            e = -best[e][1]
        return tuple(chain.from_iterable(map(self._spelled, reversed(out))))

    # -- texts ----------------------------------------------------------------------------------

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        return self.cut.findall((MARK if self.prefix else "") + text.replace(" ", MARK))

    def encode(self, texts: list[str], memory: Memory) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts behind one another, and the number of each; ``memory`` keeps words' ids."""
        numbers, word, sizes = _Numbers(), array("i"), []
        for t in texts:  # words are numbered text by text, so that only the distinct ones are held
            words = self.words(t)
            word.extend(map(numbers.__getitem__, words))
            sizes.append(len(words))
        own = memory.find(list(numbers), self.encode_words)
        word = np.frombuffer(word, np.int32)
        width = np.fromiter(map(len, own), np.int32, len(own)) // 4
        pool = np.frombuffer(b"".join(own), np.int32)
        start = np.cumsum(width, dtype=np.int64) - width
        upto = np.concatenate([[0], np.cumsum(width[word], dtype=np.int64)])
        ids = np.empty(upto[-1], np.int32)
        for lo in range(0, len(word), STEP):
            some, ends = word[lo : lo + STEP], upto[lo : lo + STEP + 1]
            ids[ends[0] : ends[-1]] = pool[np.repeat(start[some] - (ends[:-1] - ends[0]), width[some]) + np.arange(ends[-1] - ends[0])]
        return ids, np.diff(upto[np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """UTF-8 bytes of each text, without the blank that encoding put in front."""
        total = np.concatenate([[0], np.cumsum(self.widths[ids])])
        parts = []
        for lo in range(0, len(ids), STEP):  # places take eight bytes for each byte of text
            some, ends = ids[lo : lo + STEP], total[lo : lo + STEP + 1]
            place = np.repeat(self.offsets[some] - (ends[:-1] - ends[0]), self.widths[some]) + np.arange(ends[-1] - ends[0])
            parts.append(self.blob[place].tobytes())
        joined = b"".join(parts)
        bounds = total[np.concatenate([[0], np.cumsum(counts)])].tolist()
        out = [joined[a:b] for a, b in zip(bounds, bounds[1:])]
        return [t[1:] if self.prefix and t[:1] == b" " else t for t in out]


def _packed(ids: Iterable[int]) -> bytes:
    return array("i", ids).tobytes()


def _finish(h: np.ndarray, length: int) -> np.ndarray:
    return (h ^ np.uint64(length * 0xC2B2AE3D27D4EB4F % 2**64)) * _P  # the upper bits hang on all bits


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit key of two ids; different pairs have different keys, since each step can be undone."""
    h = (a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)) * _P
    h ^= h >> np.uint64(32)
    return h * _P


def _key(piece: str) -> int:
    h = 0
    for c in piece:
        h = (h * int(_P) + ord(c) + 1) % 2**64
    return int(_finish(np.array([h], np.uint64), len(piece))[0])


_CODECS: dict[bytes, Codec] = {}


def _codec(model: bytes) -> Codec:
    """The codec of a model, which a worker keeps for its next tasks; words' ids go with the task."""
    if model not in _CODECS:
        _CODECS.clear()
        _CODECS[model] = Codec(model)
    return _CODECS[model]


def _pieces(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    """The rows in order, in lists of slices of up to ``most`` bytes of text (16 more a row), or of one row with more."""
    held, size = [], 0
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy().astype(np.int64) + 16)
        at, done = 0, 0
        while at < len(batch):
            to = int(np.searchsorted(upto, done + most - size, "right"))
            if to == at and not held:
                to += 1
            if to > at:
                held.append(batch.slice(at, to - at))
                size += int(upto[to - 1]) - done
                at, done = to, int(upto[to - 1])
            if at < len(batch) or size >= most:
                yield held
                held, size = [], 0
    if held:
        yield held


def _encoded(shared):
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, memory = _codec(shared.value), Memory()

        def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            texts = [t or "" for t in whole["text"].to_pylist()]
            ids, counts = codec.encode(texts, memory)
            same = [d == t.encode() for d, t in zip(codec.decode(ids, counts), texts)]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids))
            return pa.RecordBatch.from_arrays([whole["doc_id"], pa.array(counts), lists, pa.array(same)], names=["doc_id", "n_tokens", "tokens", "round_trip"])

        for held in _pieces(batches, PIECE):  # small batches make one search, a large one several
            yield flush(held)
            give_back()

    return giving_back(encoded)


def _decoded(shared):
    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in batches:
            texts = []
            for ids in batch["tokens"]:
                own = np.array([i for i in ids.as_py() or ()], np.int32)
                texts.append(codec.decode(own, np.array([len(own)]))[0].decode(errors="replace"))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], names=["doc_id", "text"])

    return decoded


def encode_texts(docs: DataFrame, model: str = MODEL, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row: doc_id, n_tokens, tokens (array of ids), round_trip.

    Ids are those of the model itself (of equal unigram scores the longer last piece wins).  ``round_trip`` says whether decoding gives the text back (a text
    that holds the mark U+2581 itself comes back with blanks).  A null or empty text has no tokens and
    decodes to the empty text; null ids stay null; repeated rows each keep a row; an empty table gives an
    empty table; other columns are ignored, whatever their names.
    """
    with open(model, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())  # a model file, about 0.5 MB
    bounded_batches(docs.sparkSession)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(_encoded(shared), f"doc_id {kind}, n_tokens long, tokens array<int>, round_trip boolean")


def decode_tokens(encoded: DataFrame, model: str = MODEL, doc_id: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """One row per row: doc_id, text.  A null array gives the empty text; broken UTF-8 is replaced."""
    with open(model, "rb") as file:
        shared = encoded.sparkSession.sparkContext.broadcast(file.read())
    bounded_batches(encoded.sparkSession)
    slim = encoded.select(F.col(doc_id).alias("doc_id"), F.col(tokens).cast("array<int>").alias("tokens"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(_decoded(shared), f"doc_id {kind}, text string")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(documents(spark, sf_dir))
