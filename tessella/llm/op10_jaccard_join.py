"""N-gram Jaccard join by parity sketches.

Each shingle flips one cell of a parity sketch, so the number of cells (and
of blocks of cells) in which two sketches differ is at most the symmetric
difference of the two sets. ``100 * |A & B| >= 75 * |A | B|`` bounds that
difference by ``D = (|A| + |B|) // 7``. Per size band the sketch is cut into
blocks, in one global order; a block is kept as the XOR of the 64-bit hashes
of its shingles. Of the first ``D + 1`` non-empty blocks of either set at
most ``D`` differ, so two linked sets share one: joining on these blocks
loses no link (pigeonhole). Shingles that many documents share go to blocks
at the end of the order, where only sets made of little else look.

A band in which some set has too few non-empty blocks for the argument
(also every set under ``SMALL``) takes one block per shingle; then the count
always suffices. Equal sets are one class before anything is joined.

Every set emits some blocks more than it needs, ``slack(n)``. A bucket of more
than ``MANY`` rows is crowded; of a set with at most ``slack`` (of its least
partner) blocks in crowded buckets these are dropped, since among the blocks
that it must share one is in no crowded bucket, and its partner emits that one
too. So crowded buckets hold only sets that are made of crowded blocks, such
as large groups of near copies, and shared passages make no pairs.

In buckets (equal blocks) that are still large, classes first meet one random
class of the bucket, the nearest by sketch is verified, and linked classes
become one component; this repeats while it finds links (``ROUNDS`` times at most).
Then classes that are still in different components meet, filtered by size and
by the Hamming distance of 512-bit parity sketches, then of sketches as wide as
the sets. Every surviving pair is verified on the full shingle sets, so the
result is exact up to 64-bit hash collisions.

Cases: null text, empty text and text without words have no shingle
(n_shingles 0, component_id = own doc_id); under five words the whole
sequence is the one shingle; repeated rows are equal classes; a null doc_id
gets a null component and links nothing; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from .components import components
from .staging import Staged, bounded, release, small

WORDS = 5
PERCENT = 75
SMALL = 64  # sets under this take one block per shingle
GROWTH = 4  # ratio of a size band
LOAD = 1.5  # most shingles per block in a band
SKETCH = 8  # 64-bit words of the filter sketch
HOT_SHARE = 500  # a shingle in more than 1/HOT_SHARE of the documents goes last
COUNT_AT_ONCE = 1 << 20  # shingles
MANY = 32  # rows of a crowded bucket
LARGE = 8  # rows of a bucket whose classes first meet one of them
ROUNDS = 4
FEW = 16  # a round in which fewer than one in FEW candidates are links is the last
SEEN = 1 << 18  # sets that a task remembers as emitted

_U = np.uint64
_SK = [f"k{i}" for i in range(SKETCH)]


def shingles(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text: (hashes, bounds)."""
    low = K.LOWER[buf]
    starts, ends, first = K.words(low, off)
    token = K.span_hashes(low, starts, ends)
    grams = K.gram_hashes(token, WORDS)
    lo, hi = K.gram_bounds(first, WORDS)
    n = np.diff(first)
    short = np.flatnonzero((n > 0) & (n < WORDS))
    count = np.where(n >= WORDS, hi - lo, (n > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(bounds[-1], _U)
    long = np.flatnonzero(n >= WORDS)
    src, _ = K.runs(lo[long], hi[long])
    dst, _ = K.runs(bounds[long], bounds[long + 1])
    out[dst] = grams[src]
    for i in short:  # a sequence of fewer words is told from a window by its length
        t = token[first[i] : first[i + 1]]
        out[bounds[i]] = K.gram_hashes(t, len(t))[0] ^ _U(0xA5A5 + len(t))
    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        out[s:e].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[bounds[:-1][count > 0]] = True
    total = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], total[bounds]


def set_ids(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One 63-bit id per set, from all its shingles and their number."""
    total = np.concatenate([np.zeros(1, _U), np.cumsum(K.mix(h ^ _U(0x5BD1E995A17C9D3B)), dtype=_U)])
    return K.signed(K.mix(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(_U)) >> _U(1))


def band_of(n: np.ndarray) -> np.ndarray:
    x = np.zeros(len(n), np.int64)
    edge = SMALL
    while len(n) and edge <= n.max():
        x += n >= edge
        edge *= GROWTH
    return x


def band_top(band: np.ndarray) -> np.ndarray:
    """The first size above each band."""
    return SMALL * GROWTH ** band


def slack(n: np.ndarray) -> np.ndarray:
    """Blocks that a set emits beyond those that the argument needs; every set has as many."""
    return n // 16 + (n >= 4)


def plan(n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(sets, band, blocks wanted) for the own band, and for the next if a partner can be there."""
    band, most = band_of(n), n * 100 // PERCENT
    top, extra = band_top(band), 1 + slack(n)
    own = np.flatnonzero(n > 0)
    up = np.flatnonzero((n > 0) & (most >= top))
    bound = lambda other: (n + other) * (100 - PERCENT) // (100 + PERCENT)
    return [(own, band[own], bound(np.minimum(most, top - 1))[own] + extra[own]), (up, band[up] + 1, bound(most)[up] + extra[up])]


def blocks(order: np.ndarray, band: np.ndarray, plain: np.ndarray) -> np.ndarray:
    """Block number of each shingle by its place in the order; -1 where a band takes one per shingle."""
    k = np.ceil(SMALL * GROWTH ** np.maximum(band, 1) / LOAD).astype(_U)
    return np.where(plain, np.int64(-1), (((order << _U(1) >> _U(32)) * k >> _U(32)) + (order >> _U(63)) * k).astype(np.int64))


def ordered(h: np.ndarray, bounds: np.ndarray, hot: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(place in the global order, shingle) of each set's shingles, by place."""
    if hot is None or not len(hot):
        return h >> _U(1), h
    at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
    late = hot[at] == h
    order = (h >> _U(1)) | (late.astype(_U) << _U(63))
    touched = np.unique(np.searchsorted(bounds, np.flatnonzero(late), side="right") - 1)
    h = h.copy()
    for s, e in zip(bounds[touched].tolist(), bounds[touched + 1].tolist()):
        by = np.argsort(order[s:e], kind="stable")
        order[s:e], h[s:e] = order[s:e][by], h[s:e][by]
    return order, h


def signatures(h: np.ndarray, bounds: np.ndarray, hot: np.ndarray | None, plain_bands: set[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, set, short of blocks) of each emitted block."""
    n = np.diff(bounds)
    order, h = ordered(h, bounds, hot)
    keys, owners, weak = [], [], []
    for which, band, wanted in plan(n):
        if not len(which):
            continue
        idx, owner = K.runs(bounds[which], bounds[which + 1])
        b = band[owner]
        plain = (b == 0) | np.isin(b, list(plain_bands))
        block = blocks(order[idx], b, plain)
        new = np.ones(len(idx), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (block[1:] != block[:-1]) | plain[1:]
        at = np.flatnonzero(new)
        fp = np.bitwise_xor.reduceat(K.mix(h[idx] ^ _U(0x27D4EB2F165667C5)), at)
        head = owner[at]
        first = np.searchsorted(head, np.arange(len(which)))
        rank = np.arange(len(at)) - first[head]
        have = np.diff(np.append(first, len(at)))
        weak.append(band[have < wanted])
        take = rank < wanted[head]
        keys.append(K.mix(fp[take] + K.mix((block[at][take] + 1).astype(_U) * _U(64) + b[at][take].astype(_U))))
        owners.append(which[head[take]])
    if not keys:
        return np.empty(0, _U), np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(keys), np.concatenate(owners), np.unique(np.concatenate(weak))


def parity(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The filter sketch of each set: (sets, SKETCH) words."""
    out = np.zeros((len(bounds) - 1, SKETCH), _U)
    m = K.mix(h ^ _U(0x165667B19E3779F9))
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    np.bitwise_xor.at(out, (owner, (m & _U(SKETCH - 1)).astype(np.int64)), _U(1) << (m >> _U(58)))
    return out


_PROFILE = "doc_id long, n_shingles long, sid long, weak long, hot long, hot_n long, " + ", ".join(f"{x} long" for x in _SK)


def _common(waiting: list[np.ndarray], docs: int, hot: dict[int, int]) -> None:
    """Adds to hot the shingles that a few of the waiting sets share; keeps it small."""
    x = np.sort(np.concatenate(waiting))
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, np.int64)
    c = np.diff(np.append(at, len(x)))
    for v, m in zip(x[at][c > 2].tolist(), c[c > 2].tolist()):
        hot[v] = hot.get(v, 0) + m
    if len(hot) > 1 << 18:
        for v in [v for v, m in hot.items() if m <= docs / HOT_SHARE / 2]:
            del hot[v]


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document; then a row per shingle that many of the task's documents have, and per weak band."""
    hot: dict[int, int] = {}
    weak: set[int] = set()
    waiting: list[np.ndarray] = []
    docs = 0

    def rows(k: int, **given) -> pa.RecordBatch:
        names = ["doc_id", "n_shingles", "sid", "weak", "hot", "hot_n", *_SK]
        return pa.RecordBatch.from_arrays([given[x] if x in given else pa.nulls(k, pa.int64()) for x in names], names)

    for batch in batches:
        for lo, hi, buf, off in K.slices(batch.column(1)):
            h, bounds = shingles(buf, off)
            weak |= set(signatures(h, bounds, None, set())[2].tolist())
            docs += hi - lo
            waiting.append(h)
            if sum(map(len, waiting)) > COUNT_AT_ONCE:
                _common(waiting, docs, hot)
                waiting = []
            s = parity(h, bounds)
            yield rows(hi - lo, doc_id=batch.column(0).slice(lo, hi - lo), n_shingles=pa.array(np.diff(bounds)), sid=pa.array(set_ids(h, bounds)), **{x: pa.array(K.signed(np.ascontiguousarray(s[:, i]))) for i, x in enumerate(_SK)})
    if waiting:
        _common(waiting, docs, hot)
    hot = {v: m for v, m in hot.items() if m > docs / HOT_SHARE / 2}
    if hot:
        yield rows(len(hot), hot=pa.array(np.fromiter(hot, _U, len(hot)).view(np.int64)), hot_n=pa.array(list(hot.values()), pa.int64()))
    if weak:
        yield rows(len(weak), weak=pa.array(sorted(weak), pa.int64()))


def _emitter(hot, plain_bands: set[int]):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = hot.value, set()
        for batch in batches:
            for _, _, buf, off in K.slices(batch.column(0)):
                h, bounds = shingles(buf, off)
                sid = set_ids(h, bounds)
                key, owner, _ = signatures(h, bounds, table, plain_bands)
                if len(seen) > SEEN:
                    seen.clear()
                fresh = np.array([not (x in seen or seen.add(x)) for x in sid.tolist()], bool)  # equal sets of a task once
                take = fresh[owner]
                yield pa.RecordBatch.from_arrays([pa.array(K.signed(key[take])), pa.array(sid[owner[take]])], ["key", "sid"])

    return emit


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, off in K.slices(batch.column(1)):
            h, bounds = shingles(buf, off)
            want = batch.column(0).slice(lo, hi - lo).to_numpy(zero_copy_only=False)
            good = np.flatnonzero(set_ids(h, bounds) == want)
            b = bounds.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(want[good]), pa.array([h[b[i] : b[i + 1]].tobytes() for i in good.tolist()], pa.binary())], ["sid", "items"])


def _wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parity sketch of two to four cells per shingle; its halves XORed are the sketch of half the cells."""
    for batch in _sets(batches):
        out = []
        for x in batch.column(1):
            h = np.frombuffer(x.as_buffer(), _U)
            cells = 1 << max(9, (2 * len(h) - 1).bit_length())
            odd = np.bincount((K.mix(h) & _U(cells - 1)).astype(np.int64), minlength=cells) & 1
            out.append(np.array([len(h)], "<i8").tobytes() + np.packbits(odd.astype(np.uint8), bitorder="little").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["sid", "items"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, x, y = (batch.column(i) for i in range(4))
        ok = []
        for s, t in zip(x, y):
            (n, p), (m, q) = ((int(np.frombuffer(z, "<i8", 1)[0]), np.frombuffer(z, np.uint8, offset=8)) for z in (s.as_buffer(), t.as_buffer()))
            while len(p) != len(q):
                p, q = sorted((p, q), key=len)
                q = q[: len(q) // 2] ^ q[len(q) // 2 :]
            ok.append(int(np.bitwise_count(p ^ q).sum()) <= (n + m) * (100 - PERCENT) // (100 + PERCENT))
        ok = pa.array(ok, pa.bool_())
        yield pa.RecordBatch.from_arrays([a.filter(ok), b.filter(ok)], ["a", "b"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, x, y = (batch.column(i) for i in range(4))
        ok = []
        for s, t in zip(x, y):
            p, q = np.frombuffer(s.as_buffer(), _U), np.frombuffer(t.as_buffer(), _U)
            both = np.concatenate([p, q])
            both.sort()
            common = int(np.count_nonzero(both[1:] == both[:-1]))
            ok.append(100 * common >= PERCENT * (len(both) - common))
        ok = pa.array(ok, pa.bool_())
        yield pa.RecordBatch.from_arrays([a.filter(ok), b.filter(ok)], ["a", "b"])


def _far(a: str, b: str) -> str:
    """SQL: Hamming distance of the sketches of rows a and b."""
    return " + ".join(f"bit_count({a}.{x} ^ {b}.{x})" for x in _SK)


def _close(a: str, b: str) -> str:
    """SQL: sizes and sketches of rows a and b allow a link."""
    n, m = f"{a}.n_shingles", f"{b}.n_shingles"
    return f"100 * least({n}, {m}) >= {PERCENT} * greatest({n}, {m}) and {_far(a, b)} <= ({n} + {m}) * {100 - PERCENT} div {100 + PERCENT}"


def _made(docs: DataFrame, classes: Staged, sids: DataFrame, make) -> Staged:
    """What ``make`` computes of the texts of the sets named in sids (distinct)."""
    reps = Staged(sids.join(classes.df().select("sid", F.col("rep").alias("doc_id")), "sid"), "reps")
    made = Staged(docs.join(small(reps), "doc_id").select("sid", "text").mapInArrow(make, "sid long, items binary"), "made")
    reps.drop()
    return made


def _kept(pairs: Staged, made: Staged, keep) -> Staged:
    """The pairs that ``keep`` lets through; the pairs are dropped."""
    x, y = (made.df().select(F.col("sid").alias(k), F.col("items").alias(f"items_{k}")) for k in "ab")
    out = Staged(pairs.df().join(x, "a").join(y, "b").select("a", "b", "items_a", "items_b").mapInArrow(keep, "a long, b long").distinct(), "kept")
    pairs.drop()
    return out


def _compared(docs: DataFrame, classes: Staged, pairs: Staged, make, keep) -> Staged:
    """The pairs that ``keep`` lets through, by what ``make`` computes of their sets' texts; the pairs are dropped."""
    n = pairs.df()
    made = _made(docs, classes, n.select(F.col("a").alias("sid")).unionByName(n.select(F.col("b").alias("sid"))).distinct(), make)
    out = _kept(pairs, made, keep)
    made.drop()
    return out


class _Components:
    """sid -> root of the links found so far; a sid without a row is its own root."""

    def __init__(self):
        self.roots: Staged | None = None

    def of(self, df: DataFrame, sid: str = "sid", root: str = "root") -> DataFrame:
        if self.roots is None:
            return df.withColumn(root, F.col(sid))
        to = small(self.roots).select(F.col("node").alias(sid), F.col("root").alias("_up"))
        return df.join(to, sid, "left").withColumn(root, F.coalesce("_up", sid)).drop("_up")

    def add(self, links: Staged) -> None:
        ends = self.of(self.of(links.df(), "a", "ra"), "b", "rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        new = components(ends)
        links.drop()
        if new is None:
            return
        if self.roots is None:
            self.roots = new
            return
        up = small(new).select(F.col("node").alias("root"), F.col("root").alias("top"))
        old = self.roots.df().join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        fresh = new.df().join(self.roots.df().select("node"), "node", "left_anti")
        merged = Staged(old.unionByName(fresh), "roots")
        for t in (self.roots, new):
            t.drop()
        self.roots = merged

    def drop(self) -> None:
        if self.roots is not None:
            self.roots.drop()


def _members(keys: DataFrame, classes: Staged) -> tuple[Staged, Staged]:
    """key, sid of the buckets of several sets, small and large ones; crowded buckets only of sets that have too few others."""
    by = Window.partitionBy("key")
    m = F.count(F.lit(1)).over(by)  # sets that several tasks emit count several times
    keys = keys.withColumn("low", F.min("sid").over(by)).withColumn("high", F.max("sid").over(by)).withColumn("size", ((m >= LARGE).cast("int") + (m > MANY).cast("int")).cast("byte"))
    buckets = Staged(keys.where("low <> high").select("key", "sid", "size").distinct(), "buckets")  # dealt out by key already
    n = F.ceil(F.col("n_shingles") * PERCENT / 100).cast("long")  # of the least partner
    crowded = buckets.df().where("size = 2").groupBy("sid").agg(F.count(F.lit(1)).alias("crowded")).join(classes.df().select("sid", "n_shingles"), "sid")
    stuck = Staged(crowded.where(F.col("crowded") > F.floor(n / 16) + (n >= 4).cast("long")).select("sid"), "stuck")
    rest = buckets.df().where("size = 2").join(small(stuck), "sid", "left_semi")
    big = Staged(buckets.df().where("size = 1").unionByName(rest).select("key", "sid"), "big")
    few = Staged(buckets.df().where("size = 0").select("key", "sid"), "few")
    for t in (buckets, stuck):
        t.drop()
    return few, big


def _nearest(big: Staged, classes: Staged, roots: _Components, turn: int) -> Staged:
    """(a, b): for each class in large buckets the nearest, by sketch, of their random pivots in another component."""
    own = roots.of(big.df())
    pick = F.min(F.struct(F.xxhash64("key", "sid", F.lit(turn)).alias("at"), "sid", "root")).alias("p")
    pivots = own.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), pick).where("lo <> hi").select("key", F.col("p.sid").alias("b"), F.col("p.root").alias("rb"))
    met = own.join(pivots, "key").where("root <> rb").select(F.col("sid").alias("a"), "b").distinct()
    met = _sketched(met, classes).withColumn("far", F.expr(f"({_far('x', 'y')}) / (x.n_shingles + y.n_shingles)"))
    return Staged(met.groupBy("a").agg(F.min(F.struct("far", "b")).alias("m")).select("a", "m.b"), "nearest")


def _sketched(pairs: DataFrame, classes: Staged) -> DataFrame:
    """The pairs (a, b) that sizes and sketches let link, with the classes as x and y."""
    c = classes.df().select("sid", "n_shingles", *_SK)
    return pairs.alias("p").join(c.alias("x"), F.expr("p.a = x.sid")).join(c.alias("y"), F.expr("p.b = y.sid")).where(_close("x", "y"))


def _open_pairs(few: Staged, big: Staged, classes: Staged, roots: _Components) -> Staged:
    """(a, b) of classes in one bucket and different components that sizes and sketches let link."""
    s = roots.of(few.df())
    met = s.alias("x").join(s.alias("y"), F.expr("x.key = y.key and x.sid > y.sid and x.root <> y.root")).select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b")).distinct()
    met = _sketched(met, classes).select("p.a", "p.b")
    own = roots.of(big.df())
    mixed = own.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    rows = Staged(own.join(mixed, "key", "left_semi"), "open")
    facts = Staged(classes.df().join(rows.df().select("sid").distinct(), "sid", "left_semi").select("sid", "n_shingles", *_SK), "facts")
    wide = rows.df().join(small(facts), "sid")
    both = wide.alias("x").join(wide.alias("y"), F.expr(f"x.key = y.key and x.sid > y.sid and x.root <> y.root and {_close('x', 'y')}"))
    out = Staged(met.unionByName(both.select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b"))).distinct(), "pairs")
    for t in (rows, facts):
        t.drop()
    return out


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs (doc_id long, text string)."""
    spark: SparkSession = bounded(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seen = Staged(docs.mapInArrow(_profile, _PROFILE), "profile")
    rows = seen.df().where("hot is null and weak is null")
    plain = {r[0] for r in seen.df().where("weak is not null").select("weak").distinct().collect()}  # a band each
    n = rows.count()
    # at most (mean set size) * HOT_SHARE entries, whatever the number of documents
    hot = seen.df().where("hot is not null").groupBy("hot").agg(F.sum("hot_n").alias("n")).where(F.col("n") * HOT_SHARE > n).select("hot").toPandas()["hot"]
    hot = spark.sparkContext.broadcast(np.sort(hot.to_numpy(np.int64).view(_U)))
    real = rows.where("n_shingles > 0 and doc_id is not null")
    classes = Staged(real.groupBy("sid").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n_shingles"), *(F.first(x).alias(x) for x in _SK)), "classes")

    keys = docs.where("doc_id is not null").select("text").mapInArrow(_emitter(hot, plain), "key long, sid long")
    (few, big), roots, wide = _members(keys, classes), _Components(), None
    for turn in range(ROUNDS):
        near = _nearest(big, classes, roots, turn)
        met = near.rows()
        if met == 0:
            near.drop()
            break
        if wide is None:
            wide = _made(docs, classes, big.df().select("sid").distinct(), _wide)
        links = _compared(docs, classes, _kept(near, wide, _near), _sets, _verify)
        last = links.rows() * FEW < met
        roots.add(links)
        if last:
            break
    near = _compared(docs, classes, _open_pairs(few, big, classes, roots), _wide, _near)
    roots.add(_compared(docs, classes, near, _sets, _verify))

    comp = roots.of(classes.df().select("sid", "rep", "copies"))
    group = comp.groupBy("root").agg(F.min("rep").alias("component_id"), F.sum("copies").alias("members")).where("members > 1")
    ids = Staged(comp.join(group, "root").select("sid", "component_id"), "ids")
    for t in (few, big, classes, roots, wide):
        if t is not None:
            t.drop()
    release(spark)
    own = rows.select("doc_id", "n_shingles", "sid")
    return own.join(small(ids), "sid", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op10_jaccard_join": op10_jaccard_join}
ORACLE = {
    "op10_jaccard_join": r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), l as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as g from w
), s as (select doc_id, unnest(g) as g from l),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
e as (select x, y from p join l a on a.doc_id = x join l b on b.doc_id = y where 100 * c >= 75 * (len(a.g) + len(b.g) - c)),
r as (select doc_id, doc_id as c from l union select e.y, r.c from r join e on e.x = r.doc_id)
select l.doc_id, len(g) as n_shingles, min(c) as component_id from l join r on l.doc_id = r.doc_id group by 1, 2
""",
}
