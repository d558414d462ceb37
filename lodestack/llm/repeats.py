"""Suffix-array deduplication of byte strings, by a depth-limited radix sort.

Suffixes are ordered through `length` bytes only, and only where they can repeat. The first digit of the
sort is content-defined: of the 24-byte strings in a window the one with the least hash, its anchor, the
same in every copy of the window wherever it lies. Anchors found in one document alone, nearly all of them,
end there. The others are dealt by their anchor with the bytes around it, and a bucket sorts them by most
significant digits of eight bytes, once to the right of the anchor and once to the left; how far neighbours
agree gives the groups of equal strings of each length on either side, and a pair of groups is a group of
equal windows. The smallest document of a group keeps it.

Within a chunk equal surroundings are sent once, for the chunk's smallest document; the others lose their
windows at once. So a passage of a third of all documents comes once per chunk. An anchor of very many
documents may stand between ever different neighbours, and then merges nowhere: its windows are dealt one by
one, by all their bytes, so that only windows that are equal meet, and these come once per chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks
from .chunks import NULL_ID, cut, mix, squeeze, unsqueeze

ANCHOR = 24
#: A chunk may have 2^34 bytes; 30 bits of a hash choose the anchor.
PLACE_BITS = 34
#: Anchors that more documents than this have, in the whole table, are dealt window by window.
HOT_DOCS = 20_000
#: Rows of surroundings that are cut at a time.
ROWS_AT_ONCE = 1 << 16
SPAN = "array<struct<start:long,end:long>>"


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as an integer; zeros past the end."""
    raw = data.tobytes() + bytes(16)
    out = np.empty(len(data) + 8, np.uint64)
    for s in range(8):
        part = np.frombuffer(raw, "<u8", (len(data) + 15 - s) // 8, s)
        out[s::8] = part[: len(out[s::8])]
    return out[: len(data)]


def least(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of x[p : p + width] for each p, by doubling."""
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, anchor position, first and last window start, hash) of each anchor, in order of position."""
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    if len(data) < length:
        return none
    w = words_at(data)
    n = len(data) - ANCHOR + 1
    h = w[:n] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    for k in range(8, ANCHOR, 8):
        h += w[k : n + k]
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    del w
    # Places take the low bits, as many for every chunk, so that ties break alike in all of them: the leftmost of equal hashes.
    low = (np.uint64(1) << np.uint64(PLACE_BITS)) - np.uint64(1)
    if n > low:
        raise ValueError(f"a chunk of {len(data)} bytes is too large")
    at = least((h & ~low) | np.arange(n, dtype=np.uint64), length - ANCHOR + 1) & low
    at = at.astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(at)]
    inside = np.flatnonzero(np.arange(len(at)) + length <= offsets[1:][text])
    if not len(inside):
        return none
    a = at[inside]
    new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (inside[1:] != inside[:-1] + 1)])
    last = inside[np.r_[new[1:], len(inside)] - 1]
    return text[inside[new]], a[new], inside[new], last, mix(h[a[new]])


def surroundings(data: np.ndarray, at, first, last, length: int) -> np.ndarray:
    """Rows of bytes from length - ANCHOR before an anchor to as many behind it, zero outside its windows, and two times two bytes for their range."""
    side = length - ANCHOR
    cols = np.arange(2 * side + ANCHOR)
    out = np.zeros((len(at), row_width(length)), np.uint8)
    for i in range(0, len(at), ROWS_AT_ONCE):
        x = slice(i, i + ROWS_AT_ONCE)
        pos = at[x, None] - side + cols
        ok = (pos >= first[x, None]) & (pos < last[x, None] + length)
        out[x, : len(cols)] = np.where(ok, data[np.clip(pos, 0, len(data) - 1)], 0)
    out[:, len(cols) : len(cols) + 4] = np.stack([at - first, at - last], 1).astype("<u2").view(np.uint8)
    return out


def row_width(length: int) -> int:
    return 8 * (-(-(2 * length - ANCHOR + 4) // 8))


def offsets_of(rows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """How far before the anchor the first and the last window of each row start."""
    at = 2 * length - ANCHOR
    both = np.ascontiguousarray(rows[:, at : at + 4]).view("<u2").astype(np.int64)
    return both[:, 0], both[:, 1]


def order_by(rows: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in order of head and then rows, by digits of eight bytes; how many bytes of rows each shares with the one before it, -1 if head differs)."""
    n, width = rows.shape
    padded = np.zeros((n, 8 * -(-max(width, 1) // 8)), np.uint8)
    padded[:, :width] = rows
    digits, heads = padded.view(">u8"), head.view(">u8")
    place, group, open_ = np.arange(n), np.zeros(n, np.int64), np.arange(n)
    for digit in [*heads.T, *digits.T]:  # one pass per digit, over the groups that are not single yet
        at, of = place[open_], group[open_]
        o = np.lexsort((digit[at], of))
        place[open_] = at = at[o]
        new = np.r_[True, (of[1:] != of[:-1]) | (digit[at][1:] != digit[at][:-1])][: len(at)]
        starts = np.flatnonzero(new)
        sizes = np.diff(np.r_[starts, len(at)])
        group[open_] = np.repeat(open_[starts], sizes)
        open_ = open_[np.repeat(sizes > 1, sizes)]
    s, t = rows[place], heads[place]
    shared = np.full(n, -1, np.int64)
    if n > 1:
        differs = s[1:] != s[:-1]
        shared[1:] = np.where(differs.any(1), differs.argmax(1), width)
        shared[1:][(t[1:] != t[:-1]).any(1)] = -1
    return place, shared


def later(rows: np.ndarray, docs: np.ndarray, length: int) -> np.ndarray:
    """[records, windows by start] whether a window is also in a record of a smaller document."""
    side = length - ANCHOR
    head = np.ascontiguousarray(rows[:, side : side + ANCHOR])
    right, shared_r = order_by(np.ascontiguousarray(rows[:, side + ANCHOR : 2 * side + ANCHOR]), head)
    left, shared_l = order_by(np.ascontiguousarray(rows[:, :side][:, ::-1]), head)
    lo, hi = offsets_of(rows, length)
    out = np.zeros((len(rows), side + 1), bool)
    group_l, group_r = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
    for s in range(side + 1):  # the window starts s bytes into the row: side - s bytes to the left of the anchor, s to its right
        here = np.flatnonzero((side - lo <= s) & (s <= side - hi))
        if len(here) < 2:
            continue
        group_l[left] = np.cumsum(shared_l < side - s)
        group_r[right] = np.cumsum(shared_r < s)
        pair = (group_l[here] << 32) | group_r[here]
        o = np.argsort(pair)
        p = pair[o]
        new = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        if len(new) == len(p):
            continue
        d = docs[here[o]]
        out[here[o], s] = d > np.repeat(np.minimum.reduceat(d, new), np.diff(np.r_[new, len(d)]))
    return out


def ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    n = last - first + 1
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def hash_of(rows: np.ndarray) -> np.ndarray:
    digits, h = rows.view(np.uint64), np.zeros(len(rows), np.uint64)
    for i in range(digits.shape[1]):
        h = mix(h ^ digits[:, i])
    return h


def combine(rows: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether a record is sent, whether its windows go at once): of equal rows only those of the smallest document are sent."""
    if not len(rows):
        return np.zeros(0, bool), np.zeros(0, bool)
    h = hash_of(rows)
    o = np.lexsort((docs, h))
    new = np.r_[True, h[o][1:] != h[o][:-1]]
    head = o[np.flatnonzero(new)][np.cumsum(new) - 1]
    gone = np.zeros(len(rows), bool)
    gone[o] = (docs[o] > docs[head]) & (rows[o] == rows[head]).all(1)
    return ~gone, gone


def records(data: np.ndarray, doc, at, first, last, k, hot, length: int) -> tuple[np.ndarray, ...]:
    """(key, row, document, first window) of what a chunk sends, in order of key, and the windows that go at once.

    A record has all windows of an anchor and goes by the anchor's key k. Of hot anchors each window is a record
    of its own, and goes by a hash of all its bytes.
    """
    rows = surroundings(data, at, first, last, length)
    sent, gone = combine(rows, doc)
    starts = [ranges(first[gone], last[gone])]
    parts = [[x[sent & ~hot]] for x in (k, rows, doc, first)]
    split = np.flatnonzero(sent & hot)
    if len(split):
        n = last[split] - first[split] + 1
        window, doc, at = ranges(first[split], last[split]), np.repeat(doc[split], n), np.repeat(at[split], n)
        rows = surroundings(data, at, window, window, length)
        sent, gone = combine(rows, doc)
        starts.append(window[gone])
        for part, x in zip(parts, (cut(hash_of(rows)), rows, doc, window), strict=True):
            part.append(x[sent])
    parts = [np.concatenate(x) for x in parts]
    order = np.argsort(parts[0], kind="stable")
    return *(x[order] for x in parts), np.concatenate(starts)


def repeated_spans(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans array<struct<start, end>>, kept binary): the bytes of each text that go, and what stays.

    A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller id.
    Strings do not cross documents. Null texts are empty; a null id is smaller than all others; rows that
    share an id do not take bytes from each other; shorter texts stay whole; an empty table gives no rows.
    Very long texts are taken whole; columns but for the two are left out, whatever their names.
    length is from 24 to 65,536.
    """
    if not ANCHOR <= length <= 1 << 16:
        raise ValueError(f"length must be from {ANCHOR} to {1 << 16}, not {length}")
    d = chunks.deal(docs, 0.2, id_col, text_col)
    buckets, stride, hot_docs = d.buckets, d.stride, HOT_DOCS
    skip = chunks.only_copies(chunks.exact_copies(docs, id_col, text_col), d)

    def keys_of(key, t, s):
        ids, data, off = chunks.without(*chunks.texts(t), chunks.skipped(s))
        text, _, _, _, h = anchors(data, off, length)
        doc = np.unique(ids, return_inverse=True)[1][text] if len(ids) else text
        o = np.lexsort((doc, k := cut(h)))
        k, doc = k[o], doc[o]
        k = k[np.r_[True, (k[1:] != k[:-1]) | (doc[1:] != doc[:-1])]] if len(k) else k
        return chunks.parts_of(key[0].as_py(), *np.unique(k, return_counts=True), buckets, stride)

    def meet(key, t, s):
        ids, data, off = chunks.without(*chunks.texts(t), chunks.skipped(s))
        text, at, first, last, h = anchors(data, off, length)
        k = cut(h)
        total = chunks.returned(s.filter(pa.compute.is_valid(s.column("totals"))))
        total = total[np.searchsorted(np.unique(k), k)] if len(k) else total
        some = np.flatnonzero(total > 1)
        if not len(some):
            return table_of([])
        doc = ids[text[some]]
        k, *parts, starts = records(data, doc, at[some], first[some], last[some], k[some], total[some] > hot_docs, length)
        chunk, out = key[0].as_py(), []
        edges = chunks.bounds(k, buckets)
        for b in np.flatnonzero(np.diff(edges)):
            x = slice(edges[b], edges[b + 1])
            out.append((int(b), chunk, *(squeeze(p[x]) for p in parts), None))
        if len(starts):  # goes along with the first bucket's rows, and passes through
            out.append((chunk % buckets, chunk, None, None, None, squeeze(starts.astype(np.uint32))))
        return table_of(out)

    def table_of(rows):
        kinds = [("bucket", pa.int32()), ("chunk", pa.int32()), ("rows", pa.binary()), ("docs", pa.binary()), ("first", pa.binary()), ("starts", pa.binary())]
        return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(kinds)})

    def sort(key, t):
        width = row_width(length)
        out = [(c, s) for c, s in zip(t.column("chunk").to_pylist(), t.column("starts").to_pylist(), strict=True) if s is not None]
        t = t.filter(pa.compute.is_valid(t.column("rows")))
        if t.num_rows:
            rows = [unsqueeze(b, np.uint8).reshape(-1, width) for b in t.column("rows").to_pylist()]
            docs_ = np.concatenate([unsqueeze(b, np.int64) for b in t.column("docs").to_pylist()])
            ends = np.cumsum([0, *map(len, rows)])
            rows = np.concatenate(rows)
            hit = later(rows, docs_, length)
            shift = offsets_of(rows, length)[0] - (length - ANCHOR)
            for c, f, a, b in zip(t.column("chunk").to_pylist(), t.column("first").to_pylist(), ends, ends[1:], strict=False):
                r, s = np.nonzero(hit[a:b])
                if len(r):
                    out.append((c, squeeze((unsqueeze(f, np.int64)[r] + shift[a:b][r] + s).astype(np.uint32))))
        return pa.table({"chunk": pa.array([o[0] for o in out], pa.int32()), "starts": pa.array([o[1] for o in out], pa.binary())})

    def remove(key, t, s):
        all_ids, all_data, all_off = chunks.texts(t)
        skip_ids = chunks.skipped(s)
        ids, data, off = chunks.without(all_ids, all_data, all_off, skip_ids)
        mark = np.zeros(len(data) + 1, np.int32)
        for b in s.column("starts").drop_null().to_pylist():
            mark[unsqueeze(b, np.uint32)] = 1
        total = np.cumsum(mark)
        gone = total[: len(data)].copy()
        gone[length:] -= total[: max(0, len(data) - length)]
        gone = gone > 0
        copy = np.isin(all_ids, skip_ids)
        own, spans, kept = iter(zip(off, off[1:], strict=False)), [], []
        for i in range(len(all_ids)):
            n = int(all_off[i + 1] - all_off[i])
            if copy[i]:
                spans.append([(0, n)] if n >= length else [])
                kept.append(b"" if n >= length else all_data[all_off[i] : all_off[i + 1]].tobytes())
                continue
            a, b = next(own)
            g = gone[a:b]
            edge = np.flatnonzero(np.diff(np.r_[False, g, False].astype(np.int8)))
            spans.append(list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)))
            kept.append(data[a:b][~g].tobytes() if len(edge) else data[a:b].tobytes())
        flat = [x for y in spans for x in y]
        pairs = pa.StructArray.from_arrays([pa.array([x[0] for x in flat], pa.int64()), pa.array([x[1] for x in flat], pa.int64())], names=["start", "end"])
        return pa.table({"doc_id": pa.array(all_ids), "n_bytes": pa.array(np.diff(all_off)), "spans": pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, spans)]), pa.int32()), pairs), "kept": pa.array(kept, pa.binary())})

    dealt, gaps = d.rows.groupBy("chunk"), {"skip": "long", "bucket": "int", "totals": "binary", "starts": "binary"}

    def with_skips(df: DataFrame):
        both = df.unionByName(skip, allowMissingColumns=True)
        return both.select("chunk", *(F.col(c).cast(k).alias(c) if c in both.columns else F.lit(None).cast(k).alias(c) for c, k in gaps.items())).groupBy("chunk")

    counted = chunks.totals(dealt.cogroup(skip.groupBy("chunk")).applyInArrow(keys_of, chunks.PARTS), d)
    met = dealt.cogroup(with_skips(counted)).applyInArrow(meet, "bucket int, chunk int, rows binary, docs binary, first binary, starts binary")
    found = met.groupBy("bucket").applyInArrow(sort, "chunk int, starts binary")
    out = dealt.cogroup(with_skips(found)).applyInArrow(remove, f"doc_id long, n_bytes long, spans {SPAN}, kept binary")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))
