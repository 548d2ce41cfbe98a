import random

import corpus_pipeline


def test_stages_take_effect(spark, tmp_path):
    from logweave.llm.queries import QUERIES

    rng = random.Random(3)
    part = lambda: "".join(rng.choice(["ta", "re", "on", "mi", "lu", "so"]) for _ in range(rng.randrange(1, 5)))
    docs, labels = [], []
    passage = " ".join(part() for _ in range(60))
    for i in range(500):
        words = [part() for _ in range(rng.randrange(30, 120))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["zgrxta", "vokkmi"]))
        text = " ".join(words)
        if i in (101, 103, 105):
            text = text + " " + passage
        if i == 203:
            text = docs[201][1] + " tail"
        docs.append((i, text, "en", f"src{i % 7}", len(text)))
        labels.append((i, 1, int(toxic)))
    docs.append((900, None, None, None, None))
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    at, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, at, str(tmp_path)).write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        kept.append({r.doc_id: r for r in at.collect()})
        if name != "packing":
            assert at.columns == list(corpus_pipeline.COLUMNS)
    tox, near, runs, mixed, packed = kept
    assert sum(i % 4 == 0 for i in tox) <= 8 and sum(i % 4 != 0 for i in tox if i is not None) >= 365
    assert 201 in near and 203 not in near and len(near) >= len(tox) - 2
    assert passage in runs[101].text and passage not in runs[103].text and passage not in runs[105].text
    assert 0 < len(mixed) < len(runs) and set(packed) == set(mixed)
    assert QUERIES["pipeline"](spark, str(tmp_path)).count() == at.count()
