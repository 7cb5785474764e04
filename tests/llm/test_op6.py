import hashlib
import math
import random
import zlib
from collections import Counter

from tessella.llm import op6_hash_tree as H


def wait(key, name, w):
    b = int(hashlib.md5(f"{key}/{name}".encode()).hexdigest()[:12], 16)
    return -math.log((b + 0.5) / (1 << 48)) / w


def walk(key, n, full):
    tree = H.topology(n, full)
    wk = {k: sum(s.values()) for r in tree.values() for k, s in r.items()}
    wr = {r: sum(wk[k] for k in ks) for r, ks in tree.items()}
    key = "null" if key is None else key
    r = min(sorted(tree), key=lambda x: wait(key, x, wr[x]))
    k = min(sorted(tree[r]), key=lambda x: wait(key, x, wk[x]))
    return min(sorted(tree[r][k]), key=lambda x: wait(key, x, tree[r][k][x]))


def got(spark, docs, parts=3):
    df = spark.createDataFrame([(i, t, 9) for i, t in docs], "doc_id long, text string, shard int").repartition(parts)
    return [tuple(r) for r in H.shard_rows(df).collect()]


def test_equals_the_plain_version(spark, monkeypatch):
    r = random.Random(1)
    docs = [(r.randrange(10**6), r.choice([None, "", "é", "a" * 5000, "x y"])) for _ in range(900)]
    docs += [docs[0], docs[1], (None, "q")]
    one = got(spark, docs)
    monkeypatch.setattr(H, "SUB_ROWS", 10)
    assert sorted(got(spark, docs, 7), key=str) == sorted(one, key=str)
    plain = sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "key", walk(i, 16, 16), walk(i, 17, 16)) for i, t in docs if i is not None)
    assert sorted((*x[:5], x[6]) for x in one if x[0] is not None) == plain
    for s in range(16):
        rows = sorted((x for x in one if x[4] == s), key=lambda x: x[5])
        assert [x[5] for x in rows] == list(range(len(rows)))
        ids = [x[0] for x in rows if x[0] is not None]
        assert ids == sorted(ids)
    assert all(x[6] in (x[4], 16) for x in one) and any(x[6] == 16 for x in one)


def test_weights_only_move_rows_of_changed_subtrees(spark):
    tree = H.topology(16)
    df = spark.range(20000)
    a = {r.id: r.s for r in H.place(df, "id", tree, "s").collect()}
    tree["r1"]["r1.k1"][13] = 3.0
    b = {r.id: r.s for r in H.place(df, "id", tree, "s").collect()}
    share = Counter(b.values())
    assert abs(share[13] / 20000 - 3 / 18) < 0.02 and abs(share[2] / 20000 - 1 / 18) < 0.02
    moved = [(a[i], b[i]) for i in a if a[i] != b[i]]
    assert moved and all(y >= 8 for x, y in moved)  # into the region that grew
    assert all(y == 13 for x, y in moved if x in (12, 14, 15))  # inside its rack, to the shard alone


def test_empty(spark):
    assert got(spark, []) == []
