"""The pipeline on a small table, stage by stage, against the operators' plain forms."""

from __future__ import annotations

import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402


def test_stages(spark, tmp_path):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("aeioulnrst", k=rng.randint(2, 7))) for _ in range(600)]
    good = [" ".join(rng.choices(vocabulary, k=rng.randint(60, 160))) for _ in range(160)]
    bad = [f"{rng.choice(vocabulary)} " * 120 for _ in range(40)]
    item = " ".join(f"question{k}" for k in range(20))
    texts = [*good, *bad, good[3], good[3] + " tail", good[5] + " " + item, good[7] + ' token = "0497301eaac344ebae661ee6f80df7d02a6c153f" ' + " ".join(rng.choices(vocabulary, k=60)), None, ""]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, int(i < 160), 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == list(corpus_pipeline.COLUMNS) or k == len(corpus_pipeline.STAGES) - 1
        out.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        seen.append({r.doc_id: r for r in docs.collect()} if k < len(corpus_pipeline.STAGES) - 1 else docs.collect())
    classified, deduped, clean, redacted, packed = seen
    assert set(range(160)) <= set(classified) and not set(range(160, 200)) & set(classified)
    linked = brute.near([(d, r.text) for d, r in classified.items()])
    assert set(deduped) == {d for d, _, _, kept in linked if kept} and 200 not in deduped and 201 not in deduped
    assert set(clean) == set(deduped) - {202}
    assert set(redacted) == set(clean) and "0497301e" not in redacted[203].text and redacted[203].n_chars == len(redacted[203].text)
    assert redacted[0] == clean[0] == deduped[0]
    assert {r.doc_id for r in packed} == set(redacted)
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.start, r.ids_crc32) for r in whole) == sorted((r.doc_id, r.start, r.ids_crc32) for r in packed)
