"""The corpus pipeline, stage by stage, on a small table with every kind of oddity."""

import random

import corpus_pipeline
from rutine.plans.tables import written


def test_stages(spark):
    r = random.Random(12)
    syllables = {"xx": ["ka", "ta", "mo", "ri"], "yy": ["schl", "ung", "ei", "tz"]}
    text = lambda lang: " ".join("".join(r.choice(syllables[lang]) for _ in range(r.randint(1, 4))) for _ in range(60))
    rows = [(i, text(lang), lang, f"s{i % 3}", 1, "q") for i, lang in enumerate(["xx", "yy"] * 50)]
    rows += [(200, rows[0][1], "xx", "s0", 1, "q"), (201, rows[4][1] + " ka", "xx", "s0", 1, "q"), (202, None, "xx", None, 1, "q"), (203, "", "xx", "s0", 1, "q"), (204, "1 2 3", "yy", "s1", 1, "q"), (None, rows[3][1], "yy", "s1", 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, times string")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(written(stage(spark, kept[-1], ""), "stage"))
        if name != "tokens":
            assert kept[-1].columns == docs.columns
    ids = [sorted(x.doc_id if x.doc_id is not None else -1 for x in k.select("doc_id").collect()) for k in kept]
    assert not {202, 203, 204} & set(ids[1]) and set(range(100)) <= set(ids[1])
    assert 0 not in ids[2] and 200 in ids[2] and -1 not in ids[2]
    assert 4 in ids[3] and 201 not in ids[3]
    assert set(ids[4]) <= set(ids[3]) and max(ids[4].count(i) for i in ids[4]) <= 2
    assert ids[5] == ids[4]


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, ""), "none")
    assert docs.count() == 0
