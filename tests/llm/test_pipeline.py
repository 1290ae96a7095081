import random

from pyspark.sql import functions as F

import corpus_pipeline
from tessera.session import prepare


def test_pipeline_against_its_stages(spark, tmp_path):
    prepare(spark)
    r = random.Random(8)
    vocab = [f"w{i}" for i in range(400)]
    item = " ".join(r.choice(vocab) for _ in range(15))
    rows, labels = [], []
    for i in range(240):
        words = [r.choice(vocab) for _ in range(60)]
        if i % 6 == 0:
            words.insert(5, "scoundrel")
        text = " ".join(words)
        if i == 20:
            text = rows[19][1]
        if i == 31:
            text = rows[29][1] + " tail"
        if i == 40:
            text = text + " " + item
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 1, int(i % 6 == 0)))
    rows.append((500, None, None, None, 0))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        kept[name] = {x.doc_id for x in docs.select("doc_id").collect()}
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == list(corpus_pipeline.NAMES)
    clean = {i for i in range(240) if i % 6}
    assert kept["toxicity"] == clean | {500}
    assert kept["ngram_join"] == (clean | {500}) - {20, 31}
    assert kept["decontamination"] == kept["ngram_join"] - {40}
    assert kept["mixing"] <= kept["decontamination"] and kept["sharding"] == kept["mixing"]
    assert docs.columns == [*corpus_pipeline.NAMES, "shard", "slot"] and all(r.text for r in docs.collect())
    shards = [r.shard for r in docs.collect()]
    sizes = [shards.count(s) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(shards)


def test_near_copies_where_ids_repeat(spark):
    prepare(spark)
    r = random.Random(9)
    text = lambda: " ".join(f"w{r.randrange(10**6)}" for _ in range(60))
    one, two, three, four = (text() for _ in range(4))
    rows = [(1, one), (5, one + " tail"), (5, two), (7, three), (7, three + " tail"), (8, two + " tail"), (9, four), (9, four), (None, one), (9, None), (9, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(x.doc_id, x.text) for x in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    assert sum(x[0] == 7 for x in got) == 1 and {x[1] for x in got if x[0] == 7} <= {three, three + " tail"}
    assert sorted((x for x in got if x[0] != 7), key=str) == sorted([(1, one), (5, two), (9, four), (None, one), (9, None), (9, "")], key=str)


def test_stages_on_odd_rows(spark, tmp_path):
    prepare(spark)
    long = "word " * 60_000
    rows = [(1, "a text", "en", "s", 6, 1), (1, "a text", "en", "s", 6, 1), (None, None, None, None, None, None), (2, "", None, "s", 0, 1), (3, long, "en", None, len(long), 1), (3, long + "x", "en", "s", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, TEXT int")
    docs = docs.withColumns({n: F.lit("clash") for n in ("score", "node", "shard", "spans", "turn", "same", "size")})
    spark.createDataFrame([(1, 1, None), (3, 0, 0), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None), (2, ""), (None, "a text")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = {"toxicity": 6, "ngram_join": 5, "decontamination": 6, "sharding": 6}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns[:5] == list(corpus_pipeline.NAMES)
        n = got.count()
        assert n == want.get(name, n) and (name != "mixing" or n > 2), name
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0, name
