"""The pipeline's stages on a small corpus, each against plain code on its own input."""

import random
import re
from collections import Counter

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(11)
    vocab = [f"{a}{b}" for a in "bcdfg" for b in ("ar", "en", "il", "om", "ut", "az")]
    rows = []
    for k in range(160):
        words = rng.choices(vocab, k=rng.randint(20, 90))
        if k % 5 == 0:
            words[3:3] = ["grumble", "snarkle"]
        rows.append([k, " ".join(words), "en", f"s{k % 3}", 0])
    rows += [[200 + k, rows[1][1] + " " * k, "en", "s0", 0] for k in range(6)]
    rows += [[300 + k, " ".join(rng.choices(vocab, k=400)), "en", "s1", 0] for k in range(3)]
    rows += [[310 + k, rows[-1][1] + f" {w}", "en", "s1", 0] for k, w in enumerate(["bar", "ben"])]
    for r in rows:
        r[4] = len(r[1])
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    clean = {r.doc_id for r in seen["toxicity"]}
    assert not [k for k in clean if k < 160 and k % 5 == 0] and len(clean) >= 130
    texts = [re.sub(r"\s", "", r.text) for r in seen["exact_dedup"]]
    assert len(set(texts)) == len(texts) == len({re.sub(r"\s", "", r.text) for r in seen["toxicity"]})
    assert {r.doc_id for r in seen["near_dedup"]} <= {r.doc_id for r in seen["exact_dedup"]}
    copies = Counter(r.doc_id for r in seen["mixing"])
    assert copies and max(copies.values()) <= 3
    assert Counter(r.doc_id for r in seen["packing"] if r.piece == 0) == copies
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["packing"])


ODD = "doc_id long, text string, lang string, source string, n_chars int, size long, row long, fp long, bucket int, digest string, target double, label int, id long, taken int, h long"


def odd_rows():
    rng = random.Random(4)
    vocab = [f"{a}{b}" for a in "bcdfg" for b in ("ar", "en", "il", "om", "ut", "az")]
    rows = [(k, " ".join(rng.choices(vocab, k=rng.randint(8, 60)) + ["grumble"] * (k % 4 == 0)), "en", [None, "a", "b"][k % 3], 1) for k in range(60)]
    rows += [(100, None, None, None, None), (101, "", "en", "a", 0), (102, " \n", None, "b", 2), (None, rows[1][1] + " more", "en", "a", 1), (None, None, None, None, None)]
    rows += [rows[2], rows[2], (3, "another text under a used id " + rows[5][1], "en", "a", 1), (104, "long " * 5000, "en", "b", 1)]
    return [(*r, 1, 2, 3, 4, "x", 0.5, 1, 9, 2, 5) for r in rows]


def test_stages_take_odd_tables(spark, tmp_path):
    """Nulls in every column, empty and repeated rows, and columns named like the stages' own, through all stages."""
    rows = odd_rows()
    spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(60)] + [(None, None, None), (500, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, ODD)
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
        assert name == "packing" or docs.columns == columns
    clean = [r for r in rows if not (r[1] or "").endswith("grumble")]
    assert len(kept["toxicity"]) >= 0.8 * len(clean)
    texts = Counter(re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in kept["exact_dedup"])
    assert set(texts.values()) == {1} and set(texts) == {re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in kept["toxicity"]}
    assert {r.text for r in kept["near_dedup"]} <= {r.text for r in kept["exact_dedup"]} and len(kept["near_dedup"]) >= 0.5 * len(kept["exact_dedup"])
    assert max(Counter((r.doc_id, r.text) for r in kept["mixing"]).values()) <= 3
    assert Counter(r.doc_id for r in kept["packing"] if r.piece == 0) == Counter(r.doc_id for r in kept["mixing"])


def test_stages_take_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([], ODD)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.count() == 0
