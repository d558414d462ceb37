"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

A text is a weighted set: its shingles of five words, each weighing (1 + ln tf) * idf. Consistent weighted
samples agree with the probability of the weighted Jaccard similarity; three samples make a band, ten bands
find a pair of similarity 0.8 with probability 1 - (1 - 0.8^3)^10 = 0.9992. Candidates are verified by the
exact weighted Jaccard similarity, and classes are the connected components of the links.

A band's bucket is first compared with its smallest document alone, in blocks, which settles groups of
copies of any size in linear work. Only buckets that then still hold several components are compared
member by member, within tasks, skipping pairs that are connected already; no pair list is made of a bucket.

idf is 1 + DAMPING * ln(N / df) / ln(N): between 1 and 1 + DAMPING, because in a large group of copies the
shared shingles are frequent and those of a small edit are not; with undamped weights the edit outweighs
the rest of the text and near copies of frequent texts are lost.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks
from .chunks import NULL_ID, Deal, cut, mix, squeeze, unsqueeze
from .common import materialize
from .components import components
from .shingles import shingles, words

ROWS, BANDS, DAMPING, MEMBERS = 3, 10, 0.2, 64
BLOCK = 32_768


def sets_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct shingles of each text, sorted; how often each occurs; the len + 1 offsets of the texts)."""
    s, ends = shingles(*words(data, offsets))
    found = [np.unique(s[a:b], return_counts=True) for a, b in zip(ends, ends[1:], strict=False)]
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(1, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), np.cumsum([0, *(len(f[0]) for f in found)])


def weights(tf: np.ndarray, df: np.ndarray, n_docs: int, damping: float) -> np.ndarray:
    idf = 1 + damping * np.log(n_docs / np.minimum(df, n_docs)) / np.log(max(n_docs, 2))
    return ((1 + np.log(tf)) * idf).astype(np.float32)


def unit(x: np.ndarray, shift: int) -> np.ndarray:
    return (((x >> np.uint64(shift)) & np.uint64(0xFFFFF)).astype(np.float32) + np.float32(0.5)) / np.float32(2**20)


def samples(keys: np.ndarray, w: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """[n, texts] consistent weighted samples, as hashes of (key, level); starts: where each text's keys begin, each text having some.

    With r, c ~ Gamma(2, 1), b ~ U(0, 1) by key and sample: t = floor(ln w / r + b), and the key with the least
    ln a = ln c - r (t - b + 1) is drawn with level t.
    """
    lw, out = np.log(w), np.empty((n, len(starts)), np.uint64)
    ends = np.r_[starts[1:], len(keys)]
    for j in range(n):
        a, t = np.empty(len(keys), np.float32), np.empty(len(keys), np.int32)
        seed = mix(np.array([j + 1], np.uint64))[0]
        for x in range(0, len(keys), BLOCK):
            part = slice(x, x + BLOCK)
            u = mix(keys[part] ^ seed)
            v = mix(u ^ np.uint64(0xD1B54A32D192ED03))
            r = -np.log(unit(u, 0) * unit(u, 20))
            b = unit(u, 40)
            level = np.floor(lw[part] / r + b)
            a[part] = np.log(-np.log(unit(v, 0) * unit(v, 20))) - r * (level - b + 1)
            t[part] = level
        least = np.minimum.reduceat(a, starts)
        hit = np.flatnonzero(a == np.repeat(least, ends - starts))
        hit = hit[np.searchsorted(hit, starts)]
        out[j] = mix(keys[hit] ^ mix(t[hit].astype(np.int64).view(np.uint64)))
    return out


def signatures(d: Deal, copies: DataFrame, damping: float) -> DataFrame:
    """(doc_id, uid, total, df binary, bands array<long>) of each document with words that is no exact copy; uid tells texts of one id apart."""
    n_docs, buckets, stride = max(1, copies.count()), d.buckets, d.stride
    skip = chunks.only_copies(copies, d)

    def keys_of(key, t, s):
        ids, data, off = chunks.without(*chunks.texts(t), chunks.skipped(s))
        found, _, ends = sets_of(data, off)
        k, at = np.unique(cut(found), return_inverse=True)
        # A text counts with its copies, which are skipped.
        n = np.bincount(at, np.repeat(chunks.multiplicity(ids, data, off, s), np.diff(ends)), len(k)).astype(np.int64)
        return chunks.parts_of(key[0].as_py(), k, n, buckets, stride)

    def sign(key, t, s):
        ids, data, off = chunks.without(*chunks.texts(t), chunks.skipped(s))
        k, tf, ends = sets_of(data, off)
        full = np.diff(ends) > 0
        uids = np.array([zlib.crc32(data[a:b]) for a, b in zip(off, off[1:], strict=False)], np.int64)[full]
        ids, starts = ids[full], ends[:-1][full]
        if not len(ids):
            return pa.table({"doc_id": pa.array([], pa.int64()), "uid": pa.array([], pa.int64()), "total": pa.array([], pa.float64()), "df": pa.array([], pa.binary()), "bands": pa.array([], pa.list_(pa.int64()))})
        own = np.unique(cut(k))
        df = chunks.returned(s.filter(pa.compute.is_valid(s.column("totals"))))[np.searchsorted(own, cut(k))]
        w = weights(tf, df, n_docs, damping)
        h = samples(k, w, starts, ROWS * BANDS)
        band = np.zeros((BANDS, len(ids)), np.uint64)
        for j in range(ROWS * BANDS):
            band[j // ROWS] = mix(band[j // ROWS] ^ h[j] + np.uint64(j // ROWS + 1))
        stops = np.r_[starts[1:], len(k)]
        return pa.table({
            "doc_id": pa.array(ids), "uid": pa.array(uids), "total": pa.array(np.add.reduceat(w.astype(float), starts)), "df": pa.array([squeeze(df[a:b]) for a, b in zip(starts, stops, strict=True)], pa.binary()),
            "bands": pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * BANDS), pa.array(np.ascontiguousarray(band.T).view(np.int64).ravel())),
        })

    known = skip.unionByName(chunks.copied(copies, d), allowMissingColumns=True)
    parts = d.rows.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(keys_of, chunks.PARTS)
    back = chunks.totals(parts, d).select("chunk", F.lit(None).cast("long").alias("skip"), "bucket", "totals")
    back = back.unionByName(skip.select("chunk", "skip", F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("binary").alias("totals")))
    return d.rows.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(sign, "doc_id long, uid long, total double, df binary, bands array<long>")


def payload(t: pa.Table, n_docs: int, damping: float) -> list[tuple[int, np.ndarray, np.ndarray, float]]:
    """(doc_id, sorted shingles, weights, total) of rows (doc_id, text, df); repeated rows once."""
    out = []
    for i, text, df in dict.fromkeys(zip(t.column("doc_id").to_pylist(), t.column("text").to_pylist(), t.column("df").to_pylist(), strict=True)):
        data = np.frombuffer(text, np.uint8)
        k, tf, _ = sets_of(data, np.array([0, len(data)]))
        w = weights(tf, unsqueeze(df, np.uint32), n_docs, damping).astype(float)
        out.append((i, k, w, float(w.sum())))
    return out


def similarity(a, b, least: float = 0.0) -> float:
    """Weighted Jaccard similarity, or 0 where the totals alone rule the least out."""
    if min(a[3], b[3]) < least * max(a[3], b[3]):
        return 0.0
    at = np.searchsorted(b[1], a[1])
    at[at == len(b[1])] = 0
    hit = b[1][at] == a[1]
    both = float(np.minimum(a[2][hit], b[2][at[hit]]).sum())
    return both / (a[3] + b[3] - both)


def links(docs_rows: DataFrame, sig: DataFrame, n_docs: int, threshold: float, damping: float) -> DataFrame:
    """(a, b, similarity) of verified pairs whose components are those of all pairs that share a band."""
    bands = materialize(sig.select("doc_id", F.explode("bands").alias("bh")), "bands")
    h = F.xxhash64("doc_id")
    groups = bands.groupBy("bh").agg(F.count("*").alias("n"), F.min("doc_id").alias("leader"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(20,0)")).alias("y")).filter("n > 1")
    # Bands with the same members are one bucket.
    groups = materialize(groups.groupBy("n", "leader", "x", "y").agg(F.min("bh").alias("bh")).select("bh", "n", "leader"), "buckets")
    members = materialize(bands.join(groups, "bh"), "members")
    # Texts are joined by merging at every size, so that small inputs run the plan of large ones.
    used = members.select("doc_id").distinct().join(sig.select("doc_id", "uid", "df").hint("merge"), "doc_id")
    used = materialize(used, "candidates")
    full = materialize(docs_rows.select("doc_id", F.crc32("text").alias("uid"), "text").join(used.hint("merge"), ["doc_id", "uid"]), "candidate-texts")

    pairs = members.filter("doc_id <> leader").groupBy("leader", "doc_id").agg(F.max("n").alias("n"))
    pairs = materialize(pairs.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n") / MEMBERS))), "pairs")
    heads = pairs.select("leader", "salt").distinct().withColumn("doc_id", F.col("leader"))
    rows = pairs.select("leader", "salt", "doc_id").unionByName(heads.select("leader", "salt", "doc_id"))

    def star(key, t):
        head, texts = key[0].as_py(), payload(t, n_docs, damping)
        own = [p for p in texts if p[0] == head]
        found = [(head, p[0], similarity(h, p, threshold)) for p in texts if p[0] != head for h in own]
        return table_of([f for f in found if f[2] >= threshold])

    def table_of(found):
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64()), "similarity": pa.array([f[2] for f in found], pa.float64())})

    first = materialize(rows.join(full.hint("merge"), "doc_id").groupBy("leader", "salt").applyInArrow(star, "a long, b long, similarity double"), "star-links")
    labels = components(first)

    # What is left: buckets of three or more with several components. Its largest component is the bucket's
    # bulk, which no pairs are sought in: its blocks meet the blocks of the rest, and those meet each other.
    # So a hot bucket with few strays sends each text of its bulk once.
    named = members.filter("n > 2").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    named = materialize(named.select("bh", "leader", "doc_id", "label").distinct(), "named")
    parts = named.groupBy("bh", "label").agg(F.count("*").alias("c")).groupBy("bh").agg(F.max(F.struct("c", "label")).alias("bulk"), F.sum("c").alias("all"), F.count("*").alias("labels"))
    blocks = lambda n: F.ceil(n / (4 * MEMBERS)).cast("int")
    mixed = materialize(parts.filter("labels > 1").select("bh", F.col("bulk.label").alias("bulk"), blocks(F.col("bulk.c")).alias("bulks"), blocks(F.col("all") - F.col("bulk.c")).alias("rests")), "mixed")
    left = named.filter("doc_id <> leader").join(mixed, "bh").withColumn("rest", F.col("label") != F.col("bulk"))
    left = left.withColumn("own", F.pmod(F.xxhash64("doc_id"), F.when(F.col("rest"), F.col("rests")).otherwise(F.col("bulks"))).cast("int"))
    place = lambda inner, p, q: F.struct(F.lit(inner).alias("inner"), p.cast("int").alias("p"), q.cast("int").alias("q"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own = F.col("own")
    across = F.when(F.col("rest"), F.transform(upto("bulks"), lambda i: place(False, i, own))).otherwise(F.transform(upto("rests"), lambda i: place(False, own, i)))
    inner = F.when(F.col("rest"), F.transform(upto("rests"), lambda i: place(True, F.least(own, i), F.greatest(own, i))))
    left = left.select("bh", "doc_id", "label", "own", "rest", F.explode(F.concat(across, F.coalesce(inner, F.array().cast("array<struct<inner:boolean,p:int,q:int>>")))).alias("at"))
    left = left.select("bh", "at.*", "doc_id", "label", "own", "rest")

    def meet(key, t):
        inner, p, q = (k.as_py() for k in key[1:])
        ids = t.column("doc_id").to_pylist()
        side = dict(zip(ids, t.column("own" if inner else "rest").to_pylist(), strict=True))
        label = dict(zip(ids, t.column("label").to_pylist(), strict=True))
        parent, found = {x: x for x in label.values()}, []

        def root(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        texts = payload(t, n_docs, damping)
        for i, a in enumerate(texts):
            for b in texts[:i]:
                if (not inner or p != q) and side[a[0]] == side[b[0]]:
                    continue
                x, y = root(label[a[0]]), root(label[b[0]])
                if x != y and (s := similarity(a, b, threshold)) >= threshold:
                    parent[x] = y
                    found.append((min(a[0], b[0]), max(a[0], b[0]), s))
        return table_of(found)

    second = materialize(left.join(full.hint("merge"), "doc_id").groupBy("bh", "inner", "p", "q").applyInArrow(meet, "a long, b long, similarity double"), "block-links")
    return first.unionByName(second)


def near_duplicates(docs: DataFrame, threshold: float = 0.8, damping: float = DAMPING, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, class_size): one row per document; class_id is the smallest doc_id of its class.

    Null texts are empty; texts without words are classed by equality of the text alone. Exact copies are
    in one class. Rows that share an id are one document, with the links of all their texts, and come out
    as often as they come in; a null id is an id of its own, smaller than all others; an empty table gives
    no rows. Very long texts are taken whole; columns but for the two are left out, whatever their names.
    """
    copies = chunks.exact_copies(docs, id_col, text_col)
    d = chunks.deal(docs, 0.2, id_col, text_col)
    sig = materialize(signatures(d, copies, damping), "signatures")
    near = links(d.rows, sig, max(1, copies.count()), threshold, damping)
    same = copies.filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    labels = components(near.select("a", "b"))
    # Copies follow their first document; rows of one id with several texts tie those together.
    tied = copies.groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"))
    if tied.filter("lo <> hi").isEmpty():
        named = copies.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("label", "rep").alias("class_id"))
    else:
        labels = components(near.select("a", "b").unionByName(same))
        named = copies.select("doc_id").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("label", "doc_id").alias("class_id"))
    named = materialize(named, "classes")
    sizes = materialize(named.groupBy("class_id").agg(F.count_distinct("doc_id").alias("class_size")), "class-sizes")
    null = lambda c: F.when(F.col(c) != NULL_ID, F.col(c)).alias(c)
    return named.join(sizes, "class_id").select(null("doc_id"), null("class_id"), "class_size")
