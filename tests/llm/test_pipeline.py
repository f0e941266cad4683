"""The pipeline on a small table, stage by stage."""

import random

import corpus_pipeline as C
from netgap.llm import decontaminate


def test_stages(spark, tmp_path):
    rng = random.Random(5)
    words = ["the", "of", "and"] + [f"eng{i}th" for i in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(90)) for i in range(20)]
    item, passage = text(40), text(70)
    rows += [(20, rows[0][1]), (21, rows[1][1] + " more"), (22, text(50) + " " + item + " " + text(50)), (23, None), (24, "12 34")]
    rows += [(30 + i, text(60) + " " + passage + " " + text(60)) for i in range(3)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.collect()}
    clean = set(range(20))
    seen = []
    at = docs
    for k, (_, stage) in enumerate(C.STAGES):
        at = stage(spark, at, f"file://{tmp_path}")
        if k < 4:
            assert at.columns == docs.columns
            at.write.parquet(f"file://{tmp_path}/s{k}")
            at = spark.read.parquet(f"file://{tmp_path}/s{k}")
        seen.append(ids(at))
    assert seen[0] == clean | {20, 21, 22, 30, 31, 32}
    assert seen[1] == clean | {22, 30, 31, 32}
    third = {r.doc_id: r.text for r in spark.read.parquet(f"file://{tmp_path}/s2").collect()}
    assert passage in third[30] and passage not in third[31] and passage not in third[32] and len(third[31].split()) == 120
    assert all(third[i] == t for i, t in rows[:20])
    assert seen[3] == clean | {30, 31, 32} and seen[4] == seen[3]
    assert not any(decontaminate.normal(item) in decontaminate.normal(t) for i, t in third.items() if i in seen[3])


def test_stages_with_clashing_columns_nulls_and_no_rows(spark, tmp_path):
    rng = random.Random(6)
    words = ["the", "of", "and"] + [f"eng{i}th" for i in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(60), "en", "s", 1, "k", 2, "x") for i in range(12)]
    rows += [(None, text(50), "en", None, None, None, None, None), (12, rows[0][1], "en", "s", 1, "z", 3, "y"), (12, rows[0][1], "en", "s", 1, "z", 3, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words int, row string").selectExpr("*", "'u' as found", "'v' as _language", "1 as id", "2 as n_removed")
    spark.createDataFrame([(1, text(40))], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    for table, left in ((docs, 13), (docs.limit(0), 0)):
        at = table
        for k, (_, stage) in enumerate(C.STAGES):
            at = stage(spark, at, f"file://{tmp_path}")
            if k < 4:
                assert at.columns == docs.columns
                at.write.parquet(f"file://{tmp_path}/{left}-{k}")
                at = spark.read.parquet(f"file://{tmp_path}/{left}-{k}")
                if k == 3 and left:
                    kept = {(r.doc_id, r.kept, r.n_words, r.row, r.found, r._language, r.id, r.n_removed) for r in at.collect()}
                    assert kept == {(i, "k", 2, "x", "u", "v", 1, 2) for i in range(12)} | {(None, None, None, None, "u", "v", 1, 2)}
        assert at.count() == left


def test_near_duplicates_stage_has_a_row_a_member_of_a_common_passage(spark, tmp_path, monkeypatch):
    rng = random.Random(13)
    made = {}
    written = C.near_dedup.storage.written

    def counting(df, name):
        out = written(df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(C.near_dedup.storage, "written", counting)
    passage = " ".join(f"p{k}" for k in range(30))
    rows = [(i, passage + " " + " ".join(f"x{rng.randrange(2000)}" for _ in range(60))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert C.near_duplicates(spark, docs, f"file://{tmp_path}").count() == 60
    assert 0 < made["cells"] <= made["members"]
