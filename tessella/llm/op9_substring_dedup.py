"""Substring dedup: repeated fixed-length token windows, by Rabin-Karp hashes.

Every window of ``WINDOW`` words is hashed. A window is *anchored* by the
smallest hash among its ``GRAM``-word grams; equal windows have equal
anchors, so a window whose anchor occurs in one document only is unique.
One pass counts, in Spark, the documents of each anchor (about a quarter as
many as windows); the second counts only windows whose anchor repeats, each
with the smallest doc_id that has it, and leaves the others out. The anchors
pass as a Bloom filter of bounded size: false positives cost rows, never
results. Repeats inside one slice of a task are settled there, so a group of
copies sends one row per slice and window. Positions found repeated merge
into maximal intervals, and words inside these go.

Equality is that of a 64-bit and a further 32-bit hash of the 13 words.

Cases: null, empty and short texts have no window and lose nothing (n_words
0 for null; the digest is that of no bytes); windows of the smallest doc_id
stay, all occurrences in it included; rows with one doc_id are one document
for the comparison, never removing from each other; a null doc_id neither
removes nor loses; extra columns are ignored; an empty table stays empty.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bitmap
from . import kernels as K
from .staging import Staged, bounded

WINDOW = 13
GRAM = 6
BROADCAST_BYTES = 8 << 20  # of the interval table's files; beyond it the last join shuffles

_U = np.uint64


def windows(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor, hash, second hash, text, place in the text) of every window."""
    starts, ends, first = K.words(buf, off)
    token = K.span_hashes(buf, starts, ends)
    lo, hi = K.gram_bounds(first, WINDOW)
    idx, text = K.runs(lo, hi)
    if not len(idx):
        none = np.empty(0, _U)
        return none, none, np.empty(0, np.int32), text, idx
    gram = K.gram_hashes(token, GRAM)
    n = len(token) - WINDOW + 1
    anchor = gram[:n].copy()
    for i in range(1, WINDOW - GRAM + 1):
        np.minimum(anchor, gram[i : i + n], out=anchor)
    whole = K.gram_hashes(token, WINDOW)
    second = K.gram_hashes(K.mix(token ^ _U(0x9FB21C651E98DF25)), WINDOW)
    return anchor[idx], whole[idx], (second[idx] >> _U(32)).astype(np.uint32).view(np.int32), text, idx - lo[text]


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchor and number of documents, once for each slice."""
    for batch in batches:
        for _, _, buf, off in K.slices(batch.column(0)):
            anchor, _, _, text, _ = windows(buf, off)
            if not len(anchor):
                continue
            new = np.ones(len(anchor), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])  # neighbours mostly share theirs
            a, t = anchor[new], text[new]
            by = np.lexsort((t, a))
            a, t = a[by], t[by]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (t[1:] != t[:-1])
            a = a[new]
            at = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
            yield pa.RecordBatch.from_arrays([pa.array(K.signed(a[at])), pa.array(np.diff(np.append(at, len(a))).astype(np.int32))], ["anchor", "docs"])


def _candidates(filter_):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = filter_.value
        for batch in batches:
            for lo, hi, buf, off in K.slices(batch.column(1)):
                anchor, h, h2, text, place = windows(buf, off)
                hit = np.flatnonzero(bitmap.contains(bits, anchor))
                if not len(hit):
                    continue
                ids = batch.column(0).slice(lo, hi - lo).to_numpy(zero_copy_only=False)
                crc = np.array([zlib.crc32(buf[s:e]) for s, e in zip(off[:-1].tolist(), off[1:].tolist())], np.int64)
                h, h2, text, place = h[hit], h2[hit], text[hit], place[hit]
                doc = ids[text]
                by = np.lexsort((doc, h2, h))
                new = np.ones(len(by), bool)
                new[1:] = (h[by][1:] != h[by][:-1]) | (h2[by][1:] != h2[by][:-1])
                at = np.flatnonzero(new)
                least = np.repeat(doc[by][at], np.diff(np.append(at, len(by))))
                late = np.zeros(len(by), bool)
                late[by] = doc[by] > least
                # what a smaller document of the slice has: intervals, of no group
                i = np.flatnonzero(late)
                cut = np.flatnonzero(np.concatenate([[True], (text[i][1:] != text[i][:-1]) | (place[i][1:] != place[i][:-1] + 1)])) if len(i) else np.empty(0, np.int64)
                s, e = place[i][cut], place[i][np.append(cut[1:], len(i)) - 1] if len(i) else np.empty(0, np.int64)
                t = text[i][cut]
                j = np.flatnonzero(~late)
                salt = K.signed(K.mix(t.astype(_U) + _U(lo)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([np.ones(len(t), np.int8), np.zeros(len(j), np.int8)])), pa.array(np.concatenate([salt, K.signed(h[j])])), pa.array(np.concatenate([np.zeros(len(t), np.int32), h2[j]])), pa.array(np.concatenate([ids[t], doc[j]])), pa.array(np.concatenate([crc[t], crc[text[j]]])), pa.array(np.concatenate([s, place[j]]).astype(np.int32)), pa.array(np.concatenate([e, place[j]]).astype(np.int32))],
                    ["settled", "h", "h2", "doc_id", "crc", "s", "e"],
                )

    return find


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text without the words of its windows spans[..]; as the kept text and its digest."""
    for batch in batches:
        n_words, n_gone, digest, kept = [], [], [], []
        for _, (text, spans) in enumerate(zip(batch.column(1), batch.column(2))):
            w = text.as_buffer().to_pybytes().split() if text.is_valid else []
            keep = w
            if spans.is_valid and len(w) >= WINDOW:
                x = spans.values
                s, e = (x.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                edge = np.zeros(len(w) + WINDOW + 1, np.int64)
                np.add.at(edge, s, 1)
                np.add.at(edge, e + WINDOW, -1)
                gone = np.cumsum(edge)[: len(w)] > 0
                keep = [x for x, g in zip(w, gone.tolist()) if not g]
            out = b" ".join(keep)
            n_words.append(len(w))
            n_gone.append(len(w) - len(keep))
            digest.append(hashlib.sha256(out).hexdigest())
            kept.append(out.decode())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def repeated_spans(docs: DataFrame) -> Staged:
    """(doc_id, crc of the text, spans) of the documents that lose windows; spans: first and last window of each run."""
    spark = bounded(docs.sparkSession)
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    anchors = docs.select("text").mapInArrow(_anchors, "anchor long, docs int").groupBy("anchor").agg(F.sum("docs").alias("docs")).where("docs > 1").select("anchor")
    anchors = Staged(anchors, "anchors")
    bits = spark.sparkContext.broadcast(bitmap.build(anchors.df(), anchors.df().count()))
    anchors.drop()
    found = docs.mapInArrow(_candidates(bits), "settled byte, h long, h2 int, doc_id long, crc long, s int, e int")
    least = F.min("doc_id").over(Window.partitionBy("settled", "h", "h2"))
    gone = found.withColumn("least", least).where("settled = 1 or doc_id > least").select("doc_id", "crc", "s", "e")
    one = Window.partitionBy("doc_id", "crc").orderBy("s", "e")
    reach = F.max("e").over(one.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("s") <= F.col("reach") + 1, 0).otherwise(1)).over(one)
    spans = gone.withColumn("reach", reach).withColumn("island", island).groupBy("doc_id", "crc", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return Staged(spans.groupBy("doc_id", "crc").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("spans")), "spans")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text of each row of docs (doc_id long, text string)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spans = repeated_spans(docs)
    side = F.broadcast(spans.df()) if spans.bytes() <= BROADCAST_BYTES else spans.df()
    keyed = docs.withColumn("crc", F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")))
    return keyed.join(side, ["doc_id", "crc"], "left").select("doc_id", "text", "spans").mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "n_removed", "kept_sha256")


QUERIES = {"op9_substring_dedup": op9_substring_dedup}
ORACLE = {
    "op9_substring_dedup": r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
i as (select doc_id, w, unnest(range(1, len(w) - 11)) as k from w where len(w) >= 13),
g as (select doc_id, k, array_to_string(w[k:k + 12], ' ') as g from i),
f as (select g, min(doc_id) as least from g group by g having min(doc_id) < max(doc_id)),
gone as (select distinct doc_id, unnest(range(k, k + 13)) as p from g join f on g.g = f.g where doc_id > least),
gl as (select doc_id, list(p) as ps from gone group by doc_id),
x as (select w.doc_id, w, coalesce(ps, []) as ps from w left join gl on w.doc_id = gl.doc_id)
select doc_id, len(w) as n_words, len(ps) as n_removed,
  sha256(coalesce(array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda p: not list_contains(ps, p)), lambda p: w[p]), ' '), '')) as kept_sha256 from x
""",
}
