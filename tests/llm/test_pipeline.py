import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from millrace.llm import decontam, packing  # noqa: E402
from tests.llm import test_lines, test_minhash  # noqa: E402
from tests.llm.helpers import prose, word  # noqa: E402


def test_stages_and_whole(spark, tmp_path):
    draw = random.Random(15)
    items = [(i, prose(draw, 25)) for i in range(8)]
    ordinary = [word(draw) for _ in range(600)]
    rows, labels = [], []
    for i in range(400):
        words = prose(draw, draw.randint(40, 150), ordinary).split(" ")
        bad = draw.random() < 0.25
        for _ in range(len(words) // 8 if bad else 0):
            words.insert(draw.randint(0, len(words)), "zzgrob" + word(draw, (1, 3)))
        text = " ".join(words)
        if i % 40 == 7:
            text += "\n" + items[i // 40 % 8][1]
        labels.append((i, int(bad)))
        rows.append((i, text, "en", f"src{i % 5}", len(text)))
    for i in range(400, 440):
        text = test_minhash.edited(draw, rows[i - 350][1], 1)
        rows.append((i, text, "en", "src0", len(text)))
    rows += [(500, None, None, None, None), (501, "", "en", "src0", 0), (502, rows[3][1], "en", "src0", 9)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    schema, seen = docs.schema, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if name != "best_fit_packing":
            assert docs.columns == [f.name for f in schema] and [f.dataType for f in docs.schema] == [f.dataType for f in schema]
            seen[name] = {r.doc_id: r.text for r in docs.collect()}
    truth = dict(labels)
    left = seen["toxicity"]
    assert sum(truth[i] for i in left if i in truth) <= 0.03 * sum(truth.values())
    assert sum(1 - truth[i] for i in left if i in truth) >= 0.99 * (len(truth) - sum(truth.values()))
    cut = test_lines.brute([(k, t) for k, t in left.items()])
    shorter = {k: (cut[k, t] if t is not None else (None, 0)) for k, t in left.items()}
    emptied = {k for k, (t, n) in shorter.items() if n and not t.strip()}
    assert emptied and seen["line_dedup"] == {k: t for k, (t, _) in shorter.items() if k not in emptied}
    near = test_minhash.brute(list(seen["line_dedup"].items()))
    assert seen["minhash_near_dedup"].keys() == set(near.values())
    index = next(decontam.shards(spark.read.parquet(f"{folder}/benchmark.parquet")))
    clean = {k for k, t in seen["minhash_near_dedup"].items() if not index.matches(t)}
    assert seen["benchmark_decontamination"].keys() == clean
    slow = packing.Encoder.of(*packing.default_paths()).slow
    wanted = sum(len(slow.encode(seen["benchmark_decontamination"][k] or "", add_special_tokens=False).ids) + 1 for k in clean)
    assert docs.agg({"length": "sum"}).first()[0] == wanted
    whole = corpus_pipeline.run(spark, folder)
    pick = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(whole.select(*pick).collect()) == sorted(docs.select(*pick).collect())
