"""The rows of run(), stage by stage, against brute-force versions of what each stage has to keep."""

import zlib
from collections import Counter

import corpus_pipeline
from tests.llm.test_operators import DIR, contaminated, near_classes
from tidemark.llm import mixing, queries, toxicity
from tidemark.llm.quality import fold


def test_run_stage_by_stage(spark, sf_dir):
    import pyarrow as pa
    import pyarrow.parquet as pq

    docs = pq.read_table(f"{DIR}/documents.parquet").to_pylist()
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.train(table, spark.read.parquet(f"{sf_dir}/labels.parquet"), lambda k: fold(k, 5) != 0)
    scores = model.score(toxicity._lower(pa.array([d["text"] for d in docs])))
    docs = [d for d, s in zip(docs, scores) if s < 0.5]  # one pass over all texts, outside Spark
    classes = near_classes([d["text"] for d in docs])
    least = {}
    for d, c in zip(docs, classes):
        if d["text"] is not None:
            least[c] = min(d["doc_id"], least.get(c, d["doc_id"]))
    docs = [d for d, c in zip(docs, classes) if d["text"] is None or d["doc_id"] == least[c]]
    items = [(r["item_id"], r["text"] or "") for r in pq.read_table(f"{DIR}/benchmark.parquet").to_pylist()]
    docs = [d for d in docs if not contaminated(d["text"], items)[4]]
    # the stage's draw and the cell's probability are tested on their own; here: which rows they keep
    rows = mixing.mix(spark.createDataFrame(docs, table.schema)).where("kept").select("doc_id").collect()
    kept = {r["doc_id"] for r in rows}
    docs = [d for d in docs if d["doc_id"] in kept]
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(d["doc_id"] for d in docs)
    by = {d["doc_id"]: d for d in docs}
    slots = {}
    for r in got:
        body = (by[r["doc_id"]]["text"] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(body) + 16, zlib.crc32(body)) and 0 <= r["shard"] < queries.SHARDS
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
