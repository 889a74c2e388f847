import random

import pytest
from pyspark.sql import functions as F

from .common import sentence

SF = "/root/testdata/sf0.001"


def test_registered():
    from __spark_entry__ import queries

    names = list(queries())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names


def test_stages_in_order():
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["toxicity", "line dedup", "near dedup", "benchmark decontamination", "byte-level BPE"]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder of tables with cases planted in them."""
    rng = random.Random(7)
    top = tmp_path_factory.mktemp("tables")
    rows, labels = [], []
    for i in range(240):
        w = sentence(rng, rng.randint(30, 60)).split()
        if i % 8 == 0:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), "idiot")
        rows.append([i, " ".join(w)])
        labels.append((i, int(i % 8 == 0)))
    copy = sentence(rng, 70)
    item = sentence(rng, 30)
    near = copy.split()
    near[10] = "changed"
    rows += [[300, copy], [301, copy], [302, " ".join(near)], [303, sentence(rng, 20) + " " + item + " " + sentence(rng, 20)], [304, None], [305, ""]]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], schema).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("quality", F.lit(1)).write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return str(top), dict(rows)


def test_pipeline_takes_its_decisions(spark, small):
    import corpus_pipeline as cp

    top, texts = small
    docs = spark.read.parquet(f"{top}/documents.parquet")
    kept = {}
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, top).checkpoint()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    assert set(kept["toxicity"]) == {i for i in texts if i % 8 or i >= 300}
    after = kept["line dedup"]
    assert after[300] == texts[300] and 301 not in after  # of a copy nothing is left
    assert set(kept["near dedup"]) >= {i for i in after if i not in (301, 302)}
    assert set(kept["near dedup"]) - set(kept["benchmark decontamination"]) == {303}
    assert {304, 305} <= set(kept["benchmark decontamination"])
    last = cp.run(spark, top).collect()
    assert {r.doc_id for r in last} == set(kept["benchmark decontamination"])
    assert all(r.n_tokens == len(r.ids) // 4 for r in last)


def test_near_dedup_stage_keeps_one_of_each_group(spark):
    import corpus_pipeline as cp

    rng = random.Random(3)
    t = sentence(rng, 80)
    rows = [(5, t), (5, t), (6, t + " x"), (5, "another text of this id"), (None, t), (7, None), (7, None), (8, " "), (None, sentence(rng, 9))]
    docs = spark.createDataFrame([(i, x, "en", "s", 0) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(map(str, ((r.doc_id, r.text) for r in cp.near_dedup(spark, docs, "").collect())))
    assert got == sorted(map(str, [rows[0], rows[3], rows[5], rows[6], rows[7], rows[8]]))


@pytest.mark.parametrize("k", range(5))
def test_stages_on_an_empty_table(spark, small, k):
    import corpus_pipeline as cp

    top, _ = small
    docs = spark.read.parquet(f"{top}/documents.parquet").limit(0)
    assert cp.STAGES[k][1](spark, docs, top).count() == 0
