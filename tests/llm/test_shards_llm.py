import itertools
import zlib

import numpy as np

from lexweave.llm import hilbert as H


def test_the_curve_visits_neighbours():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims))).T
        at = H.hilbert_index(cells, bits)
        assert sorted(at) == list(range(len(at)))
        ordered = cells[:, np.argsort(at)]
        assert (np.abs(np.diff(ordered)).sum(axis=0) == 1).all()


def test_rows_law(spark, odd):
    docs = spark.range(5000, 6000).selectExpr("id doc_id", "repeat('é', int(id % 7)) text", "IF(id % 3 = 0, 'hot', concat('s', id % 50)) source", "length(text) n_chars").unionByName(odd.selectExpr("doc_id", "text", "key source", "length(text) n_chars"))
    rows = H.assign(docs, "doc_id", ["source", "n_chars", "doc_id"]).collect()
    assert len(rows) == docs.count()
    by: dict = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    counts = [len(by[s]) for s in range(24)]
    assert max(counts) - min(counts) <= 1
    for rs in by.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
    want = sorted((str(r.doc_id), len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert sorted((str(r.key), r.size, r.text_crc32) for r in rows) == want
    order = [r.hilbert for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)


def test_files_and_their_index(spark, tmp_path):
    docs = spark.range(240).selectExpr("id doc_id", "'t' text", "concat('s', id % 4) source", "1 shard")
    index = H.write_shards(docs, "doc_id", ["source", "doc_id"], str(tmp_path / "s"), shards=8)
    assert {r.n_rows for r in index.collect()} == {30} and spark.read.parquet(str(tmp_path / "s")).count() == 240
    # A shard holds few of the sources, so their minimum and maximum prune.
    assert sum(r.min_source == r.max_source for r in index.collect()) >= 4


def test_cells_are_quantiles_of_any_type(spark):
    """Fractions, dates, and texts alike in their first letters get cells of equal size; a value with a third of the rows one of its own."""
    docs = spark.range(3000).selectExpr("id doc_id", "'t' text", "id % 1000 / 3000.0D frac", "date_add(date'2020-01-01', int(id % 1000)) day", "concat('https://www.', lpad(id % 1000, 5, '0')) url", "IF(id < 1000, 7, id) hot", "timestamp_seconds(id) at")
    for name in ("frac", "day", "url", "at"):
        found = H.cuts(docs, name, 16)
        n = docs.select(H.cell(name, found, 16).alias("c")).groupBy("c").count().collect()
        assert len(found) == 15 and len(n) == 16 and max(r[1] for r in n) - min(r[1] for r in n) <= 3, name
    found = H.cuts(docs, "hot", 16)
    n = {r.c: r["count"] for r in docs.select(H.cell("hot", found, 16).alias("c")).groupBy("c").count().collect()}
    assert n[0] == 1000 and len(n) == len(found) + 1
    rows = H.assign(docs, "doc_id", ["frac", "day", "url", "at"]).collect()
    assert len(rows) == 3000


def test_shards_keep_every_row(spark, tmp_path):
    """Rows without a key and rows alike in key are written once each, with the input's own columns."""
    docs = spark.createDataFrame([(None, "a", 1), (None, "a", 2), (5, "b", 3), (5, "b", 3), (6, None, 4)], "doc_id long, text string, _row int")
    H.write_shards(docs, "doc_id", ["doc_id"], str(tmp_path / "s"), shards=2)
    got = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(str((r.doc_id, r.text, r._row)) for r in got.collect()) == sorted(str((r.doc_id, r.text, r._row)) for r in docs.collect())


def test_empty_and_few(none, spark):
    assert H.assign(none, "doc_id", ["key", "digest"]).count() == 0
    few = spark.createDataFrame([(1, None, "a"), (2, "x", None)], "doc_id long, text string, source string")
    assert sorted((r.key, r.slot) for r in H.assign(few, "doc_id", ["source"]).collect()) == [(1, 0), (2, 0)]
