"""Importance resampling towards a target distribution, by hashed one- and two-word features.

Features fall into buckets by their CRC32. The log ratio of a bucket's share in the target texts to its share
in all documents is its gain, a document weighs the mean gain of its features, and Gumbel noise on the
weights makes the highest scores a draw without replacement.

Counting is over a head-tail vocabulary. A first pass over all texts finds the frequent words and, among them,
the frequent pairs; their CRC states and buckets are computed once and broadcast, as many as HEAD_WORDS and HEAD_PAIRS allow.
What a task does not find there takes a direct CRC, so that the head decides about speed alone and never about
a count: a word is looked up by its own bytes, and a pair by the places of its two words, both without hashing.
A CRC32 is linear: that of 'w1 w2' is that of 'w1 ', moved on by as many bytes as w2 has, xor that of w2. So
a tail pair costs four gathers, whatever its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, numbered

BUCKETS = 10_000
#: Bounds of what is broadcast: frequent words of at most 8 bytes (16 bytes each), and frequent pairs of them (6 bytes each).
HEAD_WORDS, HEAD_PAIRS = 16_384, 65_536
#: Each task reports so many times the head's words and pairs to the counting of the head.
SLACK = 4
#: Texts are handled in blocks of about so many bytes.
BLOCK_BYTES = 2_000_000
#: Words of up to so many bytes are handled by arrays, longer ones one by one.
SHORT = 64


def crc_table() -> np.ndarray:
    """The 256 entries of CRC32 (the reversed polynomial of zlib), by the rule."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


TABLE = crc_table()


def shift_tables() -> np.ndarray:
    """[length, byte place, byte value]: what each byte of a CRC contributes once so many further bytes are appended."""
    zeros = np.zeros((SHORT + 1, 4, 256), np.uint32)
    for place in range(4):
        zeros[0, place] = np.arange(256, dtype=np.uint32) << np.uint32(8 * place)
    for n in range(1, SHORT + 1):
        zeros[n] = TABLE[zeros[n - 1] & np.uint32(0xFF)] ^ (zeros[n - 1] >> np.uint32(8))
    return zeros


def is_word_byte() -> np.ndarray:
    """Bytes of words, after lower-casing: 0-9, a-z and all of more than one byte in UTF-8."""
    out = np.zeros(256, bool)
    out[0x30:0x3A] = out[0x61:0x7B] = out[0x80:] = True
    return out


class Words:
    """The words of a block of texts: lower-cased bytes, where each word starts, its length, and the len + 1 offsets of each text's words."""

    solid = is_word_byte()

    def __init__(self, texts: list[bytes]):
        edges = np.cumsum([0, *map(len, texts)])
        data = np.frombuffer(b"".join(texts), np.uint8)
        self.data = np.where((data >= 0x41) & (data <= 0x5A), data + np.uint8(32), data)
        inside = self.solid[self.data]
        fresh = np.ones(len(data) + 1, bool)
        fresh[1:-1] = ~inside[:-1]
        fresh[edges] = True
        self.starts = np.flatnonzero(inside & fresh[:-1])
        over = np.ones(len(data) + 1, bool)
        over[:-1] = ~inside
        over[edges] = True
        stops = np.flatnonzero(over[1:] & inside) + 1
        self.lens = stops - self.starts
        self.ends = np.searchsorted(self.starts, edges)
        # A pair of words of one text: the place of its second word.
        second = np.ones(len(self.starts), bool)
        second[self.ends[:-1][self.ends[:-1] < len(second)]] = False
        self.second = np.flatnonzero(second)

    def keys(self) -> np.ndarray:
        """The bytes of each word of up to 8 bytes as one number, distinct for distinct words; 0 for longer ones."""
        out = np.zeros(len(self.starts), np.uint64)
        for j in range(8):
            at = np.flatnonzero((self.lens > j) & (self.lens <= 8))
            out[at] |= self.data[self.starts[at] + j].astype(np.uint64) << np.uint64(8 * j)
        return out

    def crcs(self, at: np.ndarray) -> np.ndarray:
        """CRC32 of the words at these places."""
        lens, starts = self.lens[at], self.starts[at]
        order = np.argsort(-np.minimum(lens, SHORT + 1), kind="stable")
        n_long = int(np.count_nonzero(lens > SHORT))
        order, starts = order[n_long:], starts[order[n_long:]]
        state, sizes = np.full(len(order), 0xFFFFFFFF, np.uint32), lens[order]
        for j in range(int(sizes[0]) if len(sizes) else 0):
            k = int(np.searchsorted(-sizes, -j, "left"))
            state[:k] = TABLE[(state[:k] ^ self.data[starts[:k] + j]) & np.uint32(0xFF)] ^ (state[:k] >> np.uint32(8))
        out = np.zeros(len(at), np.uint32)
        out[order] = ~state
        for i in np.flatnonzero(lens > SHORT):
            a = self.starts[at[i]]
            out[i] = zlib.crc32(self.data[a : a + lens[i]].tobytes())
        return out


class Vocabulary:
    """The head: sorted keys of frequent words with their CRC and that of the word and a space, and sorted pairs with their bucket."""

    def __init__(self, words: np.ndarray, pairs: np.ndarray, buckets: int = BUCKETS):
        """words: keys; pairs: rows of two keys, of words that are in the head."""
        self.keys, self.buckets = np.unique(words.astype(np.uint64)), buckets
        forms = [int(k).to_bytes(8, "little").rstrip(b"\0") for k in self.keys]
        self.crc = np.array([zlib.crc32(w) for w in forms], np.uint32)
        at = np.searchsorted(self.keys, pairs.astype(np.uint64).reshape(-1, 2)).astype(np.int64)
        self.pairs = np.unique(at[:, 0] * len(self.keys) + at[:, 1])
        first, second = np.divmod(self.pairs, max(1, len(self.keys)))
        self.pair_bucket = np.array([zlib.crc32(forms[a] + b" " + forms[b]) % buckets for a, b in zip(first, second, strict=True)], np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each word in the head, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where((self.keys[at] == keys) & (keys > 0), at, -1)


class Features:
    """Buckets of all features of a block of texts, by a head vocabulary and direct CRCs."""

    def __init__(self, head: Vocabulary):
        self.head, self.shift = head, shift_tables()

    def moved(self, crc: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.shift[n, 0, crc & 0xFF] ^ self.shift[n, 1, (crc >> 8) & 0xFF] ^ self.shift[n, 2, (crc >> 16) & 0xFF] ^ self.shift[n, 3, crc >> 24]

    def of(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(bucket of each word, bucket of each pair that ends at w.second)."""
        head = self.head
        at = head.find(w.keys())
        crc = np.empty(len(at), np.uint32)
        crc[at >= 0] = head.crc[at[at >= 0]]
        tail = np.flatnonzero(at < 0)
        crc[tail] = w.crcs(tail)
        single = (crc % np.uint32(head.buckets)).astype(np.int64)

        second, out = w.second, np.full(len(w.second), -1, np.int64)
        a, b = at[second - 1], at[second]
        if len(head.pairs):
            both = np.flatnonzero((a >= 0) & (b >= 0))
            want = a[both] * len(head.keys) + b[both]
            place = np.searchsorted(head.pairs, want)
            place[place == len(head.pairs)] = 0
            hit = head.pairs[place] == want
            out[both[hit]] = head.pair_bucket[place[hit]]
        rest = np.flatnonzero((out < 0) & (w.lens[second] <= SHORT))
        one = np.ones(len(rest), np.int64)
        first = self.moved(crc[second[rest] - 1], one) ^ np.uint32(zlib.crc32(b" "))
        out[rest] = (self.moved(first, w.lens[second[rest]]) ^ crc[second[rest]]) % np.uint32(head.buckets)
        for i in np.flatnonzero(out < 0):
            s, n = w.starts[second[i]], w.lens[second[i]]
            out[i] = zlib.crc32(w.data[s : s + n].tobytes(), zlib.crc32(b" ", int(crc[second[i] - 1]))) % head.buckets
        return single, out


def blocks(batches) -> Iterator[tuple[pa.RecordBatch, slice, Words]]:
    """Batches whose last column has texts, cut into blocks with their words; null texts are empty."""
    for b in batches:
        texts = [t or b"" for t in b.column(b.num_columns - 1).cast(pa.binary()).to_pylist()]
        start = size = 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= BLOCK_BYTES or i + 1 == len(texts):
                yield b, slice(start, i + 1), Words(texts[start : i + 1])
                start, size = i + 1, 0


def counted(keys: np.ndarray, n: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Equal keys added up, and of these the most frequent."""
    every, at = np.unique(keys, return_inverse=True)
    total = np.bincount(at, n, len(every)).astype(np.int64)
    if len(every) > most:
        top = np.argpartition(-total, most)[:most]
        every, total = every[top], total[top]
    return every, total


def frequent(texts: DataFrame, most: int, count) -> np.ndarray:
    """The keys that count(words) -> array<long> finds most often in all texts, at most so many.

    A task keeps the SLACK * most it has met most often, which bounds its memory; so the choice is near the
    true order, and it is no more than a choice of what to keep at hand.
    """

    def run(batches):
        keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for _, _, w in blocks(batches):
            k, m = np.unique(count(w), return_counts=True)
            keys, n = counted(np.concatenate([keys, k]), np.concatenate([n, m]), SLACK * most)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])

    found = texts.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return np.array([r["key"] for r in found.orderBy(F.desc("n"), "key").limit(most).collect()], np.int64)


def vocabulary(texts: DataFrame, words: int = HEAD_WORDS, pairs: int = HEAD_PAIRS, buckets: int = BUCKETS) -> Vocabulary:
    """The head of (text binary): counted over all texts, of bounded size."""

    def short(w: Words) -> np.ndarray:
        k = w.keys()
        return k[k > 0].view(np.int64)

    head = Vocabulary(frequent(texts, words, short).view(np.uint64), np.zeros((0, 2), np.uint64), buckets)

    def known_pairs(w: Words) -> np.ndarray:
        at = head.find(w.keys())
        a, b = at[w.second - 1], at[w.second]
        return (a * len(head.keys) + b)[(a >= 0) & (b >= 0)]

    first, second = np.divmod(frequent(texts, pairs, known_pairs), max(1, len(head.keys)))
    return Vocabulary(head.keys, np.stack([head.keys[first], head.keys[second]], 1), buckets)


def bucket_totals(texts: DataFrame, head) -> DataFrame:
    """(bucket int, n long): how many features of all texts fall into each bucket that has some; a task adds up its own first."""

    def run(batches):
        f, total = Features(head.value), np.zeros(head.value.buckets, np.int64)
        for _, _, w in blocks(batches):
            for x in f.of(w):
                total += np.bincount(x, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    return texts.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln(share in target / share in raw)) of every bucket, with add-one smoothing, from two tables (bucket, n)."""
    both = raw.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    both = both.unionByName(raw.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t")))
    each = materialize(both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "gains")
    all_s, all_t = each.agg(F.sum("s"), F.sum("t")).first()
    ratio = ((F.col("t") + 1).cast("double") * F.lit(float(all_s + buckets))) / ((F.col("s") + 1).cast("double") * F.lit(float(all_t + buckets)))
    # One row per bucket, whose number is a parameter.
    rows = each.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain")).orderBy("bucket").collect()
    return np.array([r["gain"] for r in rows], np.int64)


def weigh(docs: DataFrame, head, gain, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_words, n_features, weight): weight is the floored mean gain of a document's features, 0 without any."""

    def run(batches):
        f, g = Features(head.value), gain.value
        for b, part, w in blocks(batches):
            single, pair = f.of(w)
            one = np.concatenate([[0], np.cumsum(g[single])])
            two = np.concatenate([[0], np.cumsum(g[pair])])
            upto = np.searchsorted(w.second, w.ends)
            n_words, n = np.diff(w.ends), np.diff(w.ends) + np.diff(upto)
            total = np.diff(one[w.ends]) + np.diff(two[upto])
            yield pa.RecordBatch.from_arrays([b.column(0)[part.start : part.stop], pa.array(n_words), pa.array(n), pa.array(total // np.maximum(n, 1))], names=["doc_id", "n_words", "n_features", "weight"])

    pruned = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return pruned.mapInArrow(run, f"doc_id {pruned.schema[0].dataType.simpleString()}, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, share: int = 25, seed: int = 7, least_words: int = 20, buckets: int = BUCKETS, head_words: int = HEAD_WORDS, head_pairs: int = HEAD_PAIRS, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank, all long.

    Of the N documents with at least least_words words, those with the floor(share * N / 100) highest scores are drawn and
    ranked from 1, ties to the smaller doc_id; others have no rank. score is weight + floor(-1000 ln(-ln u)), where u comes from
    the SHA-256 of 'seed:doc_id', so that reruns agree.

    Texts are taken whole; null and empty ones have no features and weight 0. A null id draws its noise as
    'null' and is smaller than others; rows that share an id, and repeated rows, are documents of their own. Empty documents give no
    rows, and an empty target counts 0 in every bucket. Other columns are left out, whatever their names.
    """
    sc = docs.sparkSession.sparkContext
    texts = docs.select(F.col(text_col).cast("binary").alias("text"))
    head = sc.broadcast(vocabulary(texts, head_words, head_pairs, buckets))
    wanted = bucket_totals(target.select(F.col(target_col).cast("binary").alias("text")), head)
    gain = sc.broadcast(gains(bucket_totals(texts, head), wanted, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(float(2**32))))).cast("long")
    scored = weigh(docs, head, gain, id_col, text_col).withColumn("score", F.col("weight") + noise)
    scored = materialize(scored, "scored")
    able = F.col("n_words") >= least_words
    order = [F.desc("score"), F.asc_nulls_first("doc_id"), "n_features", "weight"]
    drawn = share * scored.filter(able).count() // 100
    ranked = numbered(scored.filter(able), order, "place", label="ranked")
    rank = F.when(F.col("place") < drawn, F.col("place") + 1).alias("rank")
    out = ranked.select("doc_id", "n_features", "weight", "score", rank)
    return out.unionByName(scored.filter(~able).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))
