import random

import corpus_pipeline as P
from tests_llm_plain import near, plain_tokens

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    r = random.Random(11)
    v = {"en": ["the", "thing", "and", "other"], "fr": ["eau", "que", "être", "oiseau"]}
    item = "What is the name of the tall bird that sleeps under the old bridge at night? The grey heron sleeps there."
    docs = [(1, None, "en"), (2, "", "en"), (3, "12 + 3 = 15", None), (4, "x", "en")]
    for i in range(5, 150):
        lang = r.choice(list(v))
        docs.append((i, " ".join(r.choice(v[lang]) + r.choice(["", str(r.randrange(999))]) for _ in range(r.choice([8, 40, 200]))), lang))
    for i in range(150, 190):
        w = docs[r.randrange(10, 100)][1].split()
        if r.random() < 0.5:
            w[r.randrange(len(w))] = "changed"
        docs.append((i, " ".join(w), "en"))
    for i in (7, 60, 120):
        docs[i] = (docs[i][0], docs[i][1] + " " + item + " " + docs[i + 1][1][:50], docs[i][2])
    return [(i, t, lang, r.choice(["a", "b", "c", None]), len(t or "")) for i, t, lang in docs] + [], item


def test_every_stage_against_its_plain_version(spark, tmp_path):
    rows, item = corpus()
    rows.append(rows[30])
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, COLUMNS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    d = str(tmp_path)
    a = P.language(spark, docs, d)
    assert a.columns == docs.columns
    kept = sorted((tuple(r) for r in a.collect()), key=str)
    assert kept == sorted((r for r in rows if any(c.isalpha() for c in r[1] or "")), key=str)
    b = P.near_duplicates(spark, a, d)
    comp = near([(r[0], r[1]) for r in dict.fromkeys(kept)])
    kept = sorted((tuple(r) for r in b.collect()), key=str)
    assert b.columns == docs.columns
    assert kept == sorted({r for r in rows if r[0] in comp and comp[r[0]] == r[0]}, key=str)
    c = P.decontamination(spark, b, d)
    assert {tuple(r) for r in c.collect()} == {r for r in kept if item not in r[1]}
    m = P.mixing(spark, c, d)
    assert m.columns == docs.columns and {tuple(r) for r in m.collect()} <= {tuple(r) for r in c.collect()}
    assert max(r["count"] for r in m.groupBy("doc_id").count().collect()) <= 2
    mixed = [(r.doc_id, r.text) for r in m.collect()]
    t = [tuple(r) for r in P.tokens(spark, m, d).collect()]
    assert sorted(t) == sorted(plain_tokens(mixed))
    assert sorted(tuple(r) for r in P.run(spark, d).collect()) == sorted(t)


def test_empty(spark, tmp_path):
    for name, cols in (("documents", COLUMNS), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], cols).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []
