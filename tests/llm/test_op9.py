import hashlib
import random
import re

from tessella.llm import bitmap
from tessella.llm import op9_substring_dedup as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs):
    least = {}
    ws = [(i, WORD.findall(t or "")) for i, t in docs]
    for i, w in ws:
        if i is not None:
            for k in range(len(w) - 12):
                g = tuple(w[k : k + 13])
                least[g] = min(i, least.get(g, i))
    out = []
    for i, w in ws:
        gone = set()
        for k in range(len(w) - 12):
            if i is not None and least[tuple(w[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, docs, parts=5):
    df = spark.createDataFrame([(i, t, 1, "q") for i, t in docs], "doc_id long, text string, h int, spans string").repartition(parts)
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in S.remove_repeats(df).collect()), key=str)


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{i}é" for i in range(400)]
    passage = r.choices(vocab, k=60)
    docs = [(0, None), (1, ""), (2, " \x0b\t\n"), (3, "a " * 12), (4, "a " * 13), (5, "a\n" * 40), (None, "a " * 40), (None, " ".join(passage))]
    for i in range(120):
        w = r.choices(vocab, k=r.choice([1, 12, 13, 14, 40, 200]))
        if r.random() < 0.5:
            s = r.randrange(48)
            w = w[: len(w) // 2] + passage[s : s + r.choice([12, 13, 14, 30])] + w[len(w) // 2 :]
        if r.random() < 0.2:
            w = w + w[:20]
        docs.append((r.randrange(10000), r.choice([" ", "  ", "\n"]).join(w)))
    return docs + [docs[-1], docs[-2], (docs[-3][0] + 1, docs[-3][1])]


def test_equals_brute_force(spark):
    for seed in (1, 2):
        docs = corpus(seed)
        assert got(spark, docs) == brute(docs)


def test_a_full_filter_only_costs_rows(spark, monkeypatch):
    monkeypatch.setattr(bitmap, "contains", lambda bits, h: h >= 0)
    docs = corpus(3)
    assert got(spark, docs) == brute(docs)


def test_shuffled_last_join(spark, monkeypatch):
    monkeypatch.setattr(S, "BROADCAST_BYTES", -1)
    docs = corpus(4)
    assert got(spark, docs, 1) == brute(docs)


def test_empty_table(spark):
    assert got(spark, []) == []
