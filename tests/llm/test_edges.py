"""Each operator on edge-case documents and on none."""

import pytest
from edge import edge_documents, no_documents

from parcelar.llm import decontamination, hamming_search, jaccard_join, pii, quality, secrets, sentencepiece_codec, sharding, suffix_dedup, token_counts

LABELS = "doc_id long, quality int, toxic int"
ITEMS = "item_id long, text string, uid string, n int"


def labels(spark):
    return spark.createDataFrame([(6, 1, 0), (6, 0, 0), (None, 1, 0), (4, 0, 0), (8, None, 0), (99, 1, 1)], LABELS)


def items(spark):
    return spark.createDataFrame([(1, "repeated row of seven", "u", 1), (None, None, None, None), (2, "", "u", 1), (2, "word", "u", 1)], ITEMS)


PER_ROW = {
    "dedup": lambda s, d: suffix_dedup.remove_repeats(d),
    "dedup all": lambda s, d: suffix_dedup.remove_repeats(d, 20, "none"),
    "pii": lambda s, d: pii.find_pii(d),
    "encode": lambda s, d: sentencepiece_codec.encode_texts(d),
    "shard": lambda s, d: sharding.shard_by_bytes(d),
    "count": lambda s, d: token_counts.count_tokens(d),
    "links": lambda s, d: jaccard_join.jaccard_links(d),
    "quality": lambda s, d: quality.classify_quality(d, labels(s)),
    "decontaminate": lambda s, d: decontamination.decontaminate(d, items(s)),
    "decontaminate shuffled": lambda s, d: decontamination.decontaminate(d, items(s), broadcast_windows=0),
    "redact": lambda s, d: secrets.redact_secrets(d),
}


@pytest.mark.parametrize("name", sorted(PER_ROW))
def test_a_row_per_row(spark, name):
    docs = edge_documents(spark)
    got = sorted(str(r["doc_id"]) for r in PER_ROW[name](spark, docs).select("doc_id").collect())
    assert got == sorted(str(r["doc_id"]) for r in docs.select("doc_id").collect())
    assert PER_ROW[name](spark, no_documents(spark)).count() == 0


def test_filters(spark):
    docs, none = edge_documents(spark), no_documents(spark)
    assert quality.keep_good(none, labels(spark)).columns == docs.columns and quality.keep_good(none, labels(spark)).isEmpty()
    assert quality.keep_good(docs, labels(spark).limit(0)).count() == docs.count()  # nothing is known, nothing goes
    kept = jaccard_join.keep_representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [1, None, 3, 4, 5, 6, 6, 8]))  # null and empty texts are copies
    clean = decontamination.drop_contaminated(docs, items(spark))
    assert clean.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(map(str, [1, 2, 3, None, None, 5, 6, 8]))
    assert jaccard_join.keep_representatives(none).isEmpty() and decontamination.drop_contaminated(none, items(spark)).isEmpty()
    assert decontamination.drop_contaminated(docs, items(spark).limit(0)).count() == docs.count()


def test_search_edges(spark):
    rows = [(1, None), (2, [1.0]), (None, [1.0, 1.0]), (3, [1.0, None]), (100, [1.0, -1.0]), (100, [1.0, -1.0]), (4, [-1.0, -1.0]), (5, [2.0, -3.0])]
    vectors = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, code string")
    got = [tuple(r) for r in hamming_search.top_k_vectors(vectors, vectors.where("vec_id % 100 = 0"), 2, 3).orderBy("rank").collect()]
    assert got == [(100, 1, 5, 0), (100, 2, 100, 0), (100, 3, 4, 1)]
    assert hamming_search.top_k_vectors(vectors.limit(0), vectors.limit(0), 2, 3).count() == 0


def test_secret_scan_on_none(spark):
    assert secrets.scan_secrets(no_documents(spark)).count() == 0
