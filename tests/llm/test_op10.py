import random
import re

import pytest

from tessella.llm import op10_jaccard_join as J

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs):
    sets = {}
    for i, t in docs:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                up[q] = p
    return {i: (len(s), find(i)) for i, s in sets.items()}


def corpus(seed, n=160):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    shared = r.choices(vocab, k=60)
    docs = [(0, None), (1, ""), (2, " \t\n"), (3, "One two"), (4, "one  TWO"), (5, "one two three"), (6, "É a b c d e")]
    base = []
    while len(docs) < n:
        k = r.random()
        if k < 0.4 or not base:
            w = r.choices(vocab, k=r.choice([3, 5, 6, 8, 12, 20, 60, 90, 300, 900]))
            if r.random() < 0.3:
                w = w + shared
            base.append(w)
        else:
            w = list(r.choice(base))
            for _ in range(r.choice([0, 1, 1, 2, 3, 6, 10])):
                w[r.randrange(len(w))] = r.choice(vocab)
            if r.random() < 0.3:
                w = w[: max(1, len(w) - r.randrange(1 + len(w) // 6))]
        docs.append((len(docs), " ".join(w)))
    docs.append((n + 5, docs[20][1]))
    return docs


def got(spark, docs):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, sid string, n_shingles int").repartition(3)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_classes(df).collect()}


def test_equals_brute_force(spark):
    docs = corpus(1)
    assert got(spark, docs) == brute(docs)


def test_hot_group_and_weak_bands(spark, monkeypatch):
    r = random.Random(3)
    base = [f"v{i}" for i in range(120)]
    docs = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randrange(4)):
            w[r.randrange(120)] = f"x{r.randrange(9999)}"
        docs.append((i * 7, " ".join(w)))
    docs += [(5000 + i, t) for i, (_, t) in enumerate(corpus(4, 60))]
    assert got(spark, docs) == brute(docs)
    monkeypatch.setattr(J, "LOAD", 40.0)  # far too few blocks: every band falls back
    assert got(spark, docs) == brute(docs)


def test_empty_and_null_ids(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert J.jaccard_classes(df).collect() == []
    df = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (9, "A b c d e f")], "doc_id long, text string")
    rows = sorted(((r.doc_id, r.component_id) for r in J.jaccard_classes(df).collect()), key=str)
    assert rows == [(4, 4), (4, 4), (9, 4), (None, None)]


@pytest.mark.parametrize("few", [1 << 18, 3, 0])
def test_components_of_a_path(spark, monkeypatch, few):
    from tessella.llm import components as C

    monkeypatch.setattr(C, "FEW", few)
    components = C.components
    e = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (7, 7), (101, 100)]
    random.Random(0).shuffle(e)
    out = {r.node: r.root for r in components(spark.createDataFrame(e, "a long, b long")).df().collect()}
    assert out == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
