"""The pipeline against a chain in plain Python, stage by stage, and its folders."""

import pytest
import sentencepiece
from conftest import SMALL
from edge import LONG
from test_decontamination import brute as hits
from test_jaccard_join import brute as classes

import corpus_pipeline
from parcelar.llm import quality, secrets, sentencepiece_codec

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def edge_rows(spark):
    prose = "The committee met on Tuesday and agreed, after a long debate, that the report should be sent to all members."
    rows = [
        (900001, None, "en", "src1", None), (900002, "", None, None, 0), (None, prose + " It was late.", "en", "src2", 1), (900003, prose, "en", "src2", 1),
        (900003, prose, "en", "src2", 1), (900004, prose, None, None, 1), (900005, LONG, "en", "src3", 1), (900006, "日本語 é 🙂 " * 30, "de", "src1", 1),
        (900007, prose + ' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and more words to end with.', "en", "tests/a", 1),
    ]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.mark.parametrize("edge", [False, True])
def test_stages_against_plain_python(spark, tmp_path, edge):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    if edge:
        docs = docs.unionByName(edge_rows(spark))
    stages = [f for _, f in corpus_pipeline.STAGES]

    def step(nth, before):
        out = stages[nth](spark, before, SMALL)
        assert nth == 4 or out.columns == before.columns
        out.write.parquet(str(tmp_path / str(nth)))
        return spark.read.parquet(str(tmp_path / str(nth)))

    # 8: the rows whose verdict is to keep, each with its columns.
    good = step(0, docs)
    verdict = quality.classify_quality(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    assert sorted(str(r["doc_id"]) for r in good.collect()) == sorted(str(r["doc_id"]) for r in verdict.where("keep").collect())
    assert set(rows_of(good)) <= set(rows_of(docs)) and good.count() < docs.count()

    # 7: one row of each class, with the smallest id.
    kept = step(1, good)
    rows = [(r["doc_id"], r["text"]) for r in good.collect()]
    found = classes(rows)
    named = sorted(str(c) for c in {c for _, c, *_ in found if c is not None})
    assert sorted(str(r["doc_id"]) for r in kept.where("doc_id IS NOT NULL").collect()) == named
    assert set(rows_of(kept)) <= set(rows_of(good))

    # 9: rows without a benchmark window.
    clean = step(2, kept)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    plain = kept.collect()
    bad = {i for i, *_, contaminated in hits([(i, r["text"]) for i, r in enumerate(plain)], items) if contaminated}
    want = sorted((tuple(r) for i, r in enumerate(plain) if i not in bad), key=str)
    assert rows_of(clean) == want and (edge or len(want) < len(plain))

    # 10: the candidates that the forest calls secrets are masked, and nothing else changes.
    masked = step(3, clean)
    spans = {}
    for r in secrets.scan_secrets(clean).where("secret").collect():
        spans.setdefault(r["doc_id"], set()).add((r["start"], r["length"]))
    want = []
    for r in clean.collect():
        text = r["text"]
        for start, length in sorted(spans.get(r["doc_id"], ()), reverse=True):
            text = text[:start] + "[SECRET]" + text[start + length :]
        want.append((r["doc_id"], text, *tuple(r)[2:]))
    assert rows_of(masked) == sorted(want, key=str) and (not edge or any("[SECRET]" in (r[1] or "") for r in want))

    # 3: the ids of the SentencePiece library.
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    got = sorted(str((r["doc_id"], r["n_tokens"], r["tokens"])) for r in step(4, masked).collect())
    assert got == sorted(str((r["doc_id"], len(ids), ids)) for r in masked.collect() for ids in [library.encode(r["text"] or "")])


def test_run_resumes_and_tidies(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "pipeline")
    calls = []
    stages = [(name, lambda s, d, p, f=f, name=name: calls.append(name) or f(s, d, p)) for name, f in corpus_pipeline.STAGES]
    broken = stages[:3] + [("secret scans", lambda s, d, p: 1 / 0)] + stages[4:]
    monkeypatch.setattr(corpus_pipeline, "STAGES", broken)
    with pytest.raises(ZeroDivisionError):
        corpus_pipeline.run(spark, SMALL, folder)
    assert len(calls) == 3
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    first = rows_of(corpus_pipeline.run(spark, SMALL, folder))
    assert len(calls) == 5  # the finished stages weren't run again
    assert sorted(p.name for p in (tmp_path / "pipeline").iterdir() if not p.name.startswith(".")) == ["3"]
    assert first == rows_of(corpus_pipeline.run(spark, SMALL)) and len(calls) == 10
    corpus_pipeline.remove(spark, folder)
    assert not (tmp_path / "pipeline").exists()


def test_no_documents(spark):
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        assert docs.isEmpty()
