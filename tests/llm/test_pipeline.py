import gc
import random
import tracemalloc
import zlib

import pyarrow as pa

import corpus_pipeline
from quillon.llm import packing, quality_classifier, tokens
from quillon.llm.common import WordHashes


def test_stages_take_effect(spark, tmp_path):
    draw = random.Random(1)
    words = lambda n: [("".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 8)))) for _ in range(n)]
    docs, labels = [], []
    for i in range(150):
        good = i % 5 != 0
        text = " ".join(words(60) if good else [w + "%%%" for w in words(60)])
        docs.append((i, text))
        labels.append((i, int(good), 0))
    near = docs[1][1].split()
    near[30] = "changed"
    leak = " ".join(words(30))
    docs += [(200, docs[1][1]), (201, " ".join(near)), (202, " ".join([*words(30), leak, *words(20)])), (203, " ".join([*words(40), "me@mail.example.com", *words(9)])), (204, None)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        d.write.parquet(f"{tmp_path}/in-{name}")
        d = stage(spark, spark.read.parquet(f"{tmp_path}/in-{name}"), str(tmp_path))
        seen[name] = d
    good = {i for i in range(150) if i % 5}
    ids = {k: {r["doc_id"] for r in v.select("doc_id").collect()} for k, v in seen.items()}
    assert len(ids["quality"] & good) >= 0.97 * len(good) and len(ids["quality"] - good - {200, 201, 202, 203, 204}) <= 2
    assert ids["quality"] - ids["near_duplicates"] == {200, 201} and ids["near_duplicates"] - ids["benchmark_leaks"] == {202}
    assert ids["personal_data"] == ids["benchmark_leaks"] == ids["packing"]
    for name in ("quality", "near_duplicates", "benchmark_leaks", "personal_data"):
        assert seen[name].columns == ["doc_id", "text", "lang", "source", "n_chars"]
    row = seen["personal_data"].filter("doc_id = 203").first()
    assert "[EMAIL]" in row["text"] and row["n_chars"] == len(row["text"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen["packing"].count()


def test_packed_sequences_can_be_built_from_the_result(spark, table):
    rows = corpus_pipeline.packed(spark, table(["one two three", "four " * 3000, None]), "").collect()
    assert all(len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"] for r in rows)


def test_workers_get_documents_in_small_batches(spark, table):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = table(["word " * 4000] * 1000).coalesce(1)  # 20 MB in one task
    sizes = lambda batches: (pa.record_batch([pa.array([b.nbytes])], ["n"]) for b in batches)
    try:
        for stage in (corpus_pipeline.near_duplicates, corpus_pipeline.packed):
            spark.conf.unset(name)
            stage(spark, table(["one two three"]), "")
            found = [r["n"] for r in docs.mapInArrow(sizes, "n long").collect()]
            assert sum(found) > 20_000_000 and max(found) < 5_000_000
    finally:
        spark.conf.unset(name)


def test_encoding_a_batch_takes_little_memory():
    words = [f"{a}{b}{c}" for a in "abcdefgh" for b in "aeiou" for c in "rstlmn"]
    batch = pa.record_batch([pa.array([" ".join(words * 40)] * 200)], ["text"])  # 7.7 MB
    known = tokens.word_ids(tokens.default_vocabulary())
    known.learn([w.encode() for w in words])
    tracemalloc.start()
    for some in packing.slices(batch, packing.BATCH):
        tokens.Encoded(some.column(0), known).ids(0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert batch.nbytes > 7_000_000 and peak < 100_000_000


def test_a_worker_keeps_the_memory_of_one_step_only():
    quality_classifier.features(b"kept-by-quality")
    tokens.word_ids(tokens.default_vocabulary())
    gc.collect()
    assert not any(type(x) is WordHashes and b"kept-by-quality" in x for x in gc.get_objects())
