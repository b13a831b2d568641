import time

from pyspark.sql import functions as F

from glossa.llm.common import CLEANUP, Scratch
from glossa.llm import jaccard as j


def shuffled(spark):
    """Files of shuffles in the session's own folders."""
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}


def test_saved_tables_leave_no_shuffle_files(spark):
    before, was = shuffled(spark), spark.conf.get(CLEANUP)
    saved = Scratch(spark).save(spark.range(1000).withColumn("x", F.col("id") % 7).repartition(5, "x"), "some")
    until = time.time() + 20
    while (left := shuffled(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert saved.count() == 1000 and spark.conf.get(CLEANUP) == was


def test_prefixes_are_fetched_only_for_pairs_that_the_maps_leave(spark, monkeypatch):
    # two texts share a passage that is too short for a link: the maps cut the pair, and no prefix of theirs is written
    names = []
    monkeypatch.setattr(Scratch, "save", lambda self, df, name, save=Scratch.save: (names.append((name, df.columns)), save(self, df, name))[1])
    words = [f"w{i}" for i in range(300)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:40] + [f"v{i}" for i in range(260)])), (3, " ".join(words[:-1]))], "doc_id long, text string")
    out = {r["doc_id"]: r["component_id"] for r in j.jaccard_components(docs, 3, 90).collect()}
    assert out == {1: 1, 2: 2, 3: 1}
    assert [n for n, columns in names if "p1" in columns] == ["profiles"]
