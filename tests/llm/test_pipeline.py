import random

import corpus_pipeline as cp
from glossa.llm import decontaminate as dc
from glossa.llm import mixing, pii


def write(spark, path):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 9)))
    text = lambda n: "\n".join(" ".join(word() for _ in range(20)) for _ in range(n // 20))
    rows = [(i, text(100), "en", f"src{i % 3}") for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "src1") for i in range(5)]  # copies
    words = rows[7][1].split(" ")
    rows.append((110, " ".join([*words[:-1], "zz"]), "en", "src2"))  # near copy
    rows.append((111, "too short", "en", "src0"))
    rows.append((112, None, None, None))
    item = " ".join(word() for _ in range(30))
    rows.append((113, text(100) + "\n" + item + "\n" + text(60), "en", "src0"))
    rows.append((114, text(100) + "\nmail a.b@c.org or +1 (234) 567-8901", "en", None))
    docs = spark.createDataFrame([(*r, len(r[1]) if r[1] else 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return docs, rows


def test_run(spark, tmp_path):
    docs, rows = write(spark, tmp_path)
    out = {r["doc_id"]: r for r in cp.run(spark, str(tmp_path)).collect()}
    assert set(out) == set(range(60)) | {114}
    assert out[114]["text"].endswith("mail [EMAIL] or [PHONE]") and out[114]["n_chars"] == len(out[114]["text"])
    assert sorted(r["position"] for r in out.values()) == list(range(61))
    assert all(out[i]["text"] == rows[i][1] for i in range(60))


def test_stages_keep_columns(spark, tmp_path):
    docs, _ = write(spark, tmp_path)
    for name, stage in cp.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_leaks_stage_by_brute_force(spark, tmp_path):
    docs, rows = write(spark, tmp_path)
    kept = {r["doc_id"] for r in cp.benchmark_leaks(spark, docs, str(tmp_path)).collect()}
    assert kept == {r[0] for r in rows} - {113}
