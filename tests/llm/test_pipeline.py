import random
from collections import Counter

import corpus_pipeline
from lexalloy.llm.common import stored


def test_stages_decide_and_keep_clean_documents(spark, tmp_path):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8)))
    clean = [" ".join(word() for _ in range(120)) for _ in range(60)]
    item = " ".join(word() for _ in range(30))
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(clean)]
    rows += [(100 + i, " ".join(w + "###" for w in t.split()), "en", "s", 9) for i, t in enumerate(clean[:20])]
    rows += [(200, clean[3], "en", "s", 1), (201, clean[4].replace(clean[4].split()[7], "zzz", 1), "en", "s", 1)]
    rows += [(300, " ".join(word() for _ in range(40)) + " " + item, "en", "s", 1)]
    rows += [(400, " ".join(word() for _ in range(90)) + " token=" + "Ab1" * 8 + " end", None, None, None)]
    labels = [(i, 1, 0) for i in range(0, 60)] + [(100 + i, 0, 0) for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, str(tmp_path)), "test")
        assert tuple(docs.columns) == corpus_pipeline.COLUMNS
        kept[name] = {x.doc_id: x.text for x in docs.collect()}
    assert set(range(60)) | {200, 201, 300, 400} == kept["quality"].keys()
    assert set(range(60)) | {300, 400} >= kept["near_duplicates"].keys() and len(kept["near_duplicates"]) == 62
    assert kept["near_duplicates"].keys() - kept["decontamination"].keys() == {300}
    assert "[redacted]" in kept["secrets"][400] and "Ab1Ab1" not in kept["secrets"][400]
    assert all(kept["secrets"][i] == t for i, t in kept["decontamination"].items() if i != 400)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    total = Counter()
    for p in pieces:
        total[p.doc_id] += p.length
    assert total == {p.doc_id: p.doc_tokens for p in pieces} and total.keys() == kept["secrets"].keys()


def test_odd_rows_pass_all_stages(spark, tmp_path):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8)))
    text = " ".join(word() for _ in range(90))
    rows = [(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, text, "en", "s", 1), (None, text, "en", "s", 1), (3, " ".join(word() for _ in range(60_000)), "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(*x, "extra", 1) for x in rows], schema + ", _row string, row int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (None, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, str(tmp_path)), "test")
        assert tuple(docs.columns) == corpus_pipeline.COLUMNS
        seen[name] = sorted((x.doc_id is None, x.doc_id or 0, x.text is None, len(x.text or "")) for x in docs.collect())
    assert len(seen["quality"]) == 7 and len(seen["near_duplicates"]) == 6  # nothing is labelled bad; one copy of the repeated row goes
    assert seen["secrets"] == seen["decontamination"] == seen["near_duplicates"]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert sum(p.doc_tokens for p in pieces if p.start == 0) == sum(p.length for p in pieces)


def test_rows_that_come_from_no_file_and_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = " ".join(f"w{i}" for i in range(80))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in ([(1, text, "en", "s", 1), (1, text, "en", "s", 1)], []):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == min(len(rows), 1)
        assert sum(p.length for p in corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()) == (corpus_pipeline.packing.packed(spark.createDataFrame(rows[:1], schema), corpus_pipeline.public_tokenizers.path("word_bpe_49k.json")).agg({"length": "sum"}).first()[0] or 0)
