import random

import corpus_pipeline
import __spark_entry__ as entry
from recordmill.session import fresh_path

EN = "the of and with ing tion er th en ou".split()


def test_stages_drop_what_they_should_and_keep_the_rest(spark):
    rng = random.Random(5)
    prose = lambda n=80: " ".join("".join(rng.choices(EN, k=rng.randint(1, 4))) for _ in range(n))
    rows, labels = [], []
    for i in range(200):
        toxic = int(i % 5 == 0)
        rows.append((i, prose() + (" stupid moron scum " if toxic else " ") + prose()))
        labels.append((i, 1, toxic))
    item = prose(30)
    rows += [(300, rows[1][1]), (301, rows[2][1].replace(" ", "  ", 1)), (302, prose() + " " + item + " " + prose()), (303, prose() + " password = hunter2hunter2 " + prose()), (304, None)]
    path = fresh_path(spark, "tables")
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, path), "test")
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
    assert set(seen["toxicity"]) == {i for i, _ in rows if i >= 200 or i % 5}
    assert set(seen["near_dedup"]) == set(seen["toxicity"]) - {300, 301}
    assert set(seen["decontamination"]) == set(seen["near_dedup"]) - {302}
    assert set(seen["secrets"]) == set(seen["decontamination"]) == set(seen["bpe"])
    assert "[SECRET]" in seen["secrets"][303]["text"] and "hunter2" not in seen["secrets"][303]["text"] and seen["secrets"][303]["n_chars"] == len(seen["secrets"][303]["text"])
    assert seen["secrets"][304]["text"] is None and seen["bpe"][304]["n_tokens"] == 0
    assert [list(seen[n].values())[0].asDict().keys() for n in ("toxicity", "near_dedup", "decontamination", "secrets")] == [seen["toxicity"][1].asDict().keys()] * 4


def test_all_queries_are_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert set(entry.oracle_sql()) <= set(names)
