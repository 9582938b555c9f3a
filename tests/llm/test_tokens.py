"""Encoding against the SentencePiece library, counts against a WordPiece implementation."""

import random
import re
import time
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import sentencepiece
from conftest import SMALL
from tokenizers import models

from parcelar.llm import sentencepiece_codec as codec
from parcelar.llm import token_counts


def model(kind=None):
    from sentencepiece import sentencepiece_model_pb2

    with open(codec.MODEL, "rb") as file:
        raw = file.read()
    if kind is None:
        return raw
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(raw)
    proto.trainer_spec.model_type = kind
    draw = random.Random(5)
    for p in proto.pieces:
        if p.type == 1:
            p.score = -(5 + len(p.piece) ** 0.5 * draw.uniform(2, 4))
    return proto.SerializeToString()


def samples(spark):
    draw = random.Random(2)
    parts = ["a", "the", " ", "  ", "\n", "é", "日", "本", "\t", "ing", "qu", "▁", "🙂", "1", "22", "http://x.y", "xxxxxxxx", "zz", "́"]
    mixed = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 30))) for _ in range(1500)]
    words = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randint(1, 40))) for _ in range(1500)]
    return mixed + words + [r[0] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()]


def split(ids, counts):
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


def test_bpe_ids_equal_the_library(spark):
    texts = samples(spark)
    own = codec.Codec(model())
    ids, counts = own.encode(texts, codec.Memory(500))
    assert split(ids, counts) == sentencepiece.SentencePieceProcessor(model_proto=model()).encode(texts)
    assert [d.decode() for d in own.decode(ids, counts)] == [t.replace("▁", " ") for t in texts]


def test_search_answers_most_words_itself():
    own = codec.Codec(model())
    draw = random.Random(3)
    words = ["▁" + "".join(draw.choice("abcdefghij") for _ in range(9)) for _ in range(500)]
    assert all(ids is not None for ids in own._search(words))


def test_long_words_equal_the_library():
    own, library = codec.Codec(model()), sentencepiece.SentencePieceProcessor(model_proto=model())
    draw = random.Random(4)
    some = lambda letters, n: "".join(draw.choice(letters) for _ in range(n))
    letters, han = "abcdefghijklmnopqrstuvwxyz", "的一是不了人我在有他这中大来上国"
    prose = "".join(random.Random(8).choices(["the", "ing", "and", "tion", "er", "un", "qu", "est", "word"], k=4000))
    words = [
        "x" * 60_000, "ab" * 5000, "abc" * 700, some(letters, 20_000), some(letters + letters.upper() + "0123456789+/", 30_000), some(han, 5000), prose,
        some("01", 3000), "=" * 2000, *(some(letters, 505 + i) for i in range(40)), *(prose[:n] for n in (511, 512, 513, 767, 768)),
    ]
    ids, counts = own.encode(words, codec.Memory(500))
    assert split(ids, counts) == library.encode(words)
    assert sum(x is not None for x in own._long([codec.MARK + w for w in words if len(w) > 600])) > 5


def test_a_megabyte_without_a_blank():
    own, library = codec.Codec(model()), sentencepiece.SentencePieceProcessor(model_proto=model())
    draw = random.Random(6)
    word = "".join(draw.choices("abcdefghijklmnopqrstuvwxyzABCDEFGH0123456789", k=1_000_000))
    began = time.perf_counter()
    ids, _ = own.encode([word], codec.Memory())
    assert time.perf_counter() - began < 30
    assert ids.tolist() == library.encode(word)


def test_long_unigram_words():
    raw = model(1)
    own, library = codec.Codec(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
    word = "".join(random.Random(9).choices("abcdefghij", k=3000))
    ids, _ = own.encode([word], codec.Memory())
    assert abs(own.scores[ids].sum() - own.scores[library.encode(word)].sum()) < 0.5


def test_unigram_scores_equal_the_library(spark):
    """Equal scores can be split in several ways, so scores are compared, to single precision."""
    texts = [t for t in samples(spark) if len(t) < 200]
    raw = model(1)
    own, library = codec.Codec(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
    ids, counts = own.encode(texts, codec.Memory())
    for mine, theirs in zip(split(ids, counts), library.encode(texts)):
        a, b = own.scores[mine].sum(), own.scores[theirs].sum()
        assert abs(a - b) < 1e-3 + 1e-5 * abs(b)


def test_round_trip(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    encoded = codec.encode_texts(docs)
    assert encoded.where("NOT round_trip").isEmpty()
    back = {r["doc_id"]: r["text"] for r in codec.decode_tokens(encoded).collect()}
    assert back == {r["doc_id"]: r["text"] for r in docs.collect()}


def test_pieces_hold_all_rows_in_order():
    texts = [None, "", "x" * 900, "y" * 5000, "é" * 300, *["z"] * 400, None, "w" * 984, ""]
    whole = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["doc_id", "text"])
    for step in (1, 3, 100, len(texts)):
        batches = [whole.slice(k, step) for k in range(0, len(texts), step)]
        pieces = [[r for b in held for r in b.to_pylist()] for held in codec._pieces([whole.slice(0, 0), *batches], 1000)]
        assert [r["text"] for p in pieces for r in p] == texts
        assert all(len(p) == 1 or sum(16 + len((r["text"] or "").encode()) for r in p) <= 1000 for p in pieces)
    assert list(codec._pieces([], 1000)) == list(codec._pieces([whole.slice(0, 0)], 1000)) == []


def test_memory_of_a_large_batch():
    """A batch of 12 MB is encoded in pieces, and bytes are looked up a step at a time."""
    draw = random.Random(10)
    words = ["".join(draw.choices("abcdefghij", k=8)) for _ in range(2000)]
    texts = [" ".join(draw.choices(words, k=1300)) for _ in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(texts)], names=["doc_id", "text"])
    kernel = codec._encoded(SimpleNamespace(value=model()))
    list(kernel(iter([batch.slice(0, 1)])))
    library = sentencepiece.SentencePieceProcessor(model_proto=model())
    tracemalloc.start()
    ids, peak = [], 0
    for out in kernel(iter([batch])):
        peak = max(peak, tracemalloc.get_traced_memory()[1])
        ids += out["doc_id"].to_pylist()
        assert all(out["round_trip"].to_pylist())
        assert out["tokens"][0].as_py() == library.encode(texts[out["doc_id"][0].as_py()])
    tracemalloc.stop()
    assert ids == list(range(1000))
    assert peak < 150e6


def test_counts_equal_word_pieces(spark):
    starts, continues = token_counts.read_vocabulary(token_counts.VOCABULARY)
    vocabulary = {p: i for i, p in enumerate(dict.fromkeys([*starts, *("##" + p for p in continues), "[UNK]"]))}
    other = models.WordPiece(vocabulary, unk_token="[UNK]", max_input_chars_per_word=10**9)
    automaton = token_counts.LongestMatch(starts, continues)
    words = {w for t in samples(spark) for w in re.findall(r"\w+|[^\w\s]", t)}
    assert {w: automaton.count(w) for w in words} == {w: len(other.tokenize(w)) for w in words}


def test_small_automaton():
    automaton = token_counts.LongestMatch(["a", "abcdx"], ["b", "c", "cdy", "dz"])
    assert automaton.count("abcdz") == 4  # a ##b ##c ##dz
    assert automaton.count("abcd") == 1  # no way to cover d alone: unknown
    assert automaton.count("") == 0
