"""Alignment of the tokens of two tokenizers, by pointer jumping over byte ranges.

A byte-level BPE (A) and a SentencePiece model (B) cut the bytes of space + text each in their own way. Every
token points to the farthest-right token of the other side that it overlaps; doubling these pointers until
nothing moves takes every token to the last one of its connected component, which names its group. Groups
end where a token of either side ends.

Neither vocabulary joins over a space that stands before a non-space and after something else, so a text
is a sequence of chunks that are encoded, aligned and written out on their own. A task keeps a bounded table of
the distinct chunks that it has met and aligns each once, many at a time.

How many documents hold a pair of linked ids is counted over the whole corpus: a block of documents counts its
own first and sends one row per pair, so that a hot pair comes once per block; the totals come back to the
blocks the same way.
"""

from __future__ import annotations

import hashlib
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import pack, squeeze, unpack, unsqueeze
from .common import materialize
from .piece_codec import MARK

#: A pair of ids is one number: A's id above so many bits for B's.
B_BITS = 24
#: A block has about so many characters of text; a task's table starts anew at so many chunks or characters; texts are encoded so many characters at a time.
BLOCK_CHARS, TABLE_CHUNKS, TABLE_CHARS, STEP_CHARS = 16_000_000, 400_000, 20_000_000, 1_000_000
#: Where a text may be cut: before a space that follows no space and precedes no white space. Python's \\s is wider than the tokenizer's, so that cuts are too few rather than too many.
CUT = re.compile(r"(?<! ) (?=\S)")


def byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes with: printable ones stand for themselves, the others for code points from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def byte_tokenizer(path: str):
    """(the tokenizer, the bytes of each id)."""
    from tokenizers import Tokenizer

    # Spark's tasks are the parallelism.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    of, forms = byte_alphabet(), [b""] * t.get_vocab_size()
    for piece, i in t.get_vocab(with_added_tokens=False).items():
        forms[i] = bytes(of[c] for c in piece)
    return t, forms


def piece_tokenizer(path: str):
    """(the model, the bytes of each id; control and unknown pieces have their names' bytes, which no text's join equals)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    return sp, [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]


class Forms:
    """Bytes of all ids of a vocabulary, for joining by a gather."""

    def __init__(self, forms: list[bytes]):
        self.lens = np.array([len(f) for f in forms], np.int64)
        self.starts, self.flat = np.cumsum(self.lens) - self.lens, np.frombuffer(b"".join(forms), np.uint8)

    def join(self, ids: np.ndarray) -> np.ndarray:
        n = self.lens[ids]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.starts[ids] - (ends - n), n) + np.arange(ends[-1] if len(n) else 0)]

    def gives(self, raw: list[bytes], ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether each text's ids, n of them, join to its bytes; no text is empty."""
        upto, size = np.concatenate([[0], np.cumsum(self.lens[ids])]), np.array([len(r) for r in raw], np.int64)
        ends = np.cumsum(n)
        good = upto[ends] - upto[ends - n] == size
        if good.any():
            differ = self.join(ids[np.repeat(good, n)]) != np.frombuffer(b"".join([r for r, g in zip(raw, good.tolist(), strict=True) if g]), np.uint8)
            good[good] = np.add.reduceat(differ, np.cumsum(size[good]) - size[good], dtype=np.int64) == 0
        return good


def farthest(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """Each token's farthest-right overlapping token, of nodes A then B; of two that end together B's is the last, and points to itself."""
    n = len(ends_a)
    to_b = n + np.searchsorted(ends_b, ends_a, "left")
    at = np.searchsorted(ends_a, ends_b, "left")
    to_a = np.where(ends_a[np.minimum(at, n - 1)] > ends_b, at, n + np.arange(len(ends_b)))
    return np.concatenate([to_b, to_a])


def terminals(succ: np.ndarray) -> np.ndarray:
    """Where each node's pointers end: succ is applied to itself until nothing moves, so that rounds are the logarithm of the longest chain."""
    while True:
        further = succ[succ]
        if np.array_equal(further, succ):
            return succ
        succ = further


def links(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (token of A, token of B) that share a byte, A's in order. Both sides cover the same bytes without gaps."""
    starts_a = np.concatenate([[0], ends_a[:-1]])
    first, last = np.searchsorted(ends_b, starts_a, "right"), np.searchsorted(ends_b, ends_a, "left")
    n = last - first + 1
    a = np.repeat(np.arange(len(ends_a)), n)
    return a, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


class Aligner:
    """Distinct chunks and their alignment. A chunk begins with a space; the first of a text is the one that both tokenizers put there."""

    def __init__(self, byte_path: str, piece_path: str, most: int = TABLE_CHUNKS):
        self.bpe, forms_a = byte_tokenizer(byte_path)
        self.sp, forms_b = piece_tokenizer(piece_path)
        if len(forms_b) > 1 << B_BITS:
            raise ValueError(f"vocabularies of over {1 << B_BITS} pieces are not supported")
        self.a, self.b, self.most = Forms(forms_a), Forms(forms_b), most
        self.digits = [str(i) for i in range(max(len(forms_a), len(forms_b)))]
        # A piece that holds a marker after another character, or white space, would join over cuts.
        names = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.splits = not any(re.search(f"[^{MARK}]{MARK}| ", p) for p in names) and self.sp.encode(" ") == self.sp.encode(MARK)
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.chars = 0
        #: By chunk: tokens of A, of B, groups, whether both joins give the chunk, the groups' text; and its links in one array.
        self.counts, self.good, self.text = np.zeros((0, 4), np.int64), np.zeros(0, bool), []
        self.pairs, self.starts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def chunks(self, text: str) -> list[str]:
        """The chunks of space + text, each without its first space; none of an empty text."""
        if not text:
            return []
        if not self.splits:
            return [text]
        words = text.split(" ")
        # Words that are empty or begin with white space belong to the chunk before.
        if all(w and not w[0].isspace() for w in words):
            return words
        whole = " " + text
        edges = [0, *(m.start() for m in CUT.finditer(whole, 1)), len(whole)]
        return [whole[a + 1 : b] for a, b in zip(edges, edges[1:], strict=False)]

    def add(self, new: list[str]) -> None:
        """Encode and align chunks that are not in the table."""
        ids_a = [e.ids for e in self.bpe.encode_batch_fast([" " + c for c in new], add_special_tokens=False)]
        ids_b = self.sp.encode(new, num_threads=1)
        n_a, n_b = np.array([len(x) for x in ids_a], np.int64), np.array([len(x) for x in ids_b], np.int64)
        flat_a, flat_b = np.fromiter(chain.from_iterable(ids_a), np.int64), np.fromiter(chain.from_iterable(ids_b), np.int64)
        raw = [b" " + c.encode() for c in new]
        good = self.a.gives(raw, flat_a, n_a) & self.b.gives(raw, flat_b, n_b)

        # All good chunks at once: they lie one after the other, and every chunk's end is an end on both sides.
        keep_a, keep_b = flat_a[np.repeat(good, n_a)], flat_b[np.repeat(good, n_b)]
        ends_a, ends_b = np.cumsum(self.a.lens[keep_a]), np.cumsum(self.b.lens[keep_b])
        if len(keep_a):
            last = terminals(farthest(ends_a, ends_b)) - len(keep_a)
            of_a, of_b = last[: len(keep_a)], last[len(keep_a) :]
            x, y = links(ends_a, ends_b)
        else:
            of_a = of_b = x = y = np.zeros(0, np.int64)
        token = np.cumsum(n_a[good])
        chunk_of_a = np.repeat(np.arange(len(token)), n_a[good])
        counts = np.zeros((len(new), 4), np.int64)
        counts[good, 0], counts[good, 1] = n_a[good], n_b[good]
        heads = np.flatnonzero(np.diff(of_a, prepend=-1))
        counts[good, 2] = np.bincount(chunk_of_a[heads], minlength=len(token))
        counts[good, 3] = np.bincount(chunk_of_a[x], minlength=len(token))

        # Groups as text: tokens of one terminal are neighbours on either side.
        name_a, name_b = [self.digits[i] for i in keep_a.tolist()], [self.digits[i] for i in keep_b.tolist()]
        cut_a, cut_b = [*heads.tolist(), len(keep_a)], [*np.flatnonzero(np.diff(of_b, prepend=-1)).tolist(), len(keep_b)]
        forms = [f"{name_a[p] if q - p == 1 else ','.join(name_a[p:q])}|{name_b[x] if y - x == 1 else ','.join(name_b[x:y])}" for p, q, x, y in zip(cut_a, cut_a[1:], cut_b, cut_b[1:], strict=False)]
        upto = [0, *np.cumsum(counts[:, 2]).tolist()]
        self.chars += sum(map(len, new))
        self.text += [forms[p] if q - p == 1 else ";".join(forms[p:q]) for p, q in zip(upto, upto[1:], strict=False)]
        self.at.update(zip(new, range(len(self.good), len(self.good) + len(new)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.pairs) + np.cumsum(counts[:, 3]) - counts[:, 3]])
        self.counts, self.good = np.concatenate([self.counts, counts]), np.concatenate([self.good, good])
        self.pairs = np.concatenate([self.pairs, (keep_a[x] << B_BITS) | keep_b[y]])

    def align(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of each text (tokens of A, of B, groups, links) and its groups as text; and of all: text, pair and number of its links, by text and pair."""
        lists = [self.chunks(t) for t in texts]
        at, text = self.places(lists)
        # A chunk that does not come back says nothing sure about its text: that one is tried as a whole.
        if bad := [i for i in np.unique(text[~self.good[at]]).tolist() if len(lists[i]) > 1]:
            for i in bad:
                lists[i] = [texts[i]]
            at, text = self.places(lists)
        counts = np.stack([np.bincount(text, self.counts[at, j], len(texts)) for j in range(4)], 1).astype(np.int64)
        ids, edges = at.tolist(), np.cumsum([0, *map(len, lists)]).tolist()
        forms = [";".join([self.text[j] for j in ids[a:b]]) for a, b in zip(edges, edges[1:], strict=False)]
        # A text's distinct chunks first, then their links.
        both, times = np.unique(text * len(self.good) + at, return_counts=True)
        text, at = np.divmod(both, max(1, len(self.good)))
        n = self.counts[at, 3]
        ends = np.cumsum(n)
        pairs = self.pairs[np.repeat(self.starts[at] - (ends - n), n) + np.arange(ends[-1] if len(n) else 0)]
        text, times = np.repeat(text, n), np.repeat(times, n)
        order = np.lexsort((pairs, text))
        text, pairs, times = text[order], pairs[order], times[order]
        first = np.flatnonzero((np.diff(text, prepend=-1) != 0) | (np.diff(pairs, prepend=-1) != 0))
        return counts, forms, text[first], pairs[first], np.add.reduceat(times, first) if len(first) else times

    def places(self, lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(the table's place of every chunk, its text), with new chunks added to the table."""
        every = set(chain.from_iterable(lists))
        new = every.difference(self.at)
        if self.at and (len(self.at) + len(new) > self.most or self.chars > TABLE_CHARS):
            self.clear()
            new = every
        if new:
            self.add(sorted(new))
        at = np.fromiter(map(self.at.__getitem__, chain.from_iterable(lists)), np.int64)
        return at, np.repeat(np.arange(len(lists)), np.array([len(c) for c in lists], np.int64))


def blocks_of(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of documents and of blocks in one table: block long and, of a document, doc_id, its four counts, groups_sha256 and its links; of a block (doc_id and counts null) its distinct pairs and in how many of its documents each is.

    Pairs are sorted numbers, packed as differences.
    """
    schema = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("counts", pa.list_(pa.int64())), ("groups_sha256", pa.string()), ("pairs", pa.binary()), ("times", pa.binary())])

    def run(batches):
        aligner, step, task = Aligner(byte_path, piece_path), 0, TaskContext.get().partitionId() << 32
        keys, n, size = [], [], 0

        def summary():
            every, at = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(at, np.concatenate(n), len(every)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array([task + step]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int64())), pa.nulls(1, pa.string()), pa.array([pack(every.astype(np.uint64))], pa.binary()), pa.array([squeeze(total)], pa.binary())], schema=schema)

        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            start = held = 0
            for i, t in enumerate(texts):
                held += len(t)
                if held < STEP_CHARS and i + 1 < len(texts):
                    continue
                counts, forms, text, pairs, times = aligner.align(texts[start : i + 1])
                edges = np.searchsorted(text, np.arange(i + 2 - start))
                spans = list(zip(edges, edges[1:], strict=False))
                out = [pa.array(np.full(i + 1 - start, task + step)), b.column(0)[start : i + 1], pa.array(list(counts), pa.list_(pa.int64())), pa.array([hashlib.sha256(f.encode()).hexdigest() if f else "" for f in forms])]
                out += [pa.array([pack(pairs[p:q].astype(np.uint64)) for p, q in spans], pa.binary()), pa.array([squeeze(times[p:q]) for p, q in spans], pa.binary())]
                yield pa.RecordBatch.from_arrays(out, schema=schema)
                every, m = np.unique(pairs, return_counts=True)
                keys.append(every)
                n.append(m)
                size, start, held = size + held, i + 1, 0
                if size >= BLOCK_CHARS:
                    yield summary()
                    step, keys, n, size = step + 1, [], [], 0
        if keys:
            yield summary()

    pruned = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return pruned.mapInArrow(run, "block long, doc_id long, counts array<long>, groups_sha256 string, pairs binary, times binary")


def pair_rows(blocks: DataFrame) -> DataFrame:
    """(block, a, b, n) of the blocks' own rows."""

    def run(batches):
        for t in batches:
            for block, keys, n in zip(*(t.column(i).to_pylist() for i in range(3)), strict=True):
                k = unpack(keys).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), block)), pa.array(k >> B_BITS), pa.array(k & ((1 << B_BITS) - 1)), pa.array(unsqueeze(n, np.int64))], names=["block", "a", "b", "n"])

    return blocks.select("block", "pairs", "times").mapInArrow(run, "block long, a long, b long, n long")


def pair_counts(rows: DataFrame) -> DataFrame:
    """(a, b, docs, best): in how many documents a pair of ids is linked, and whether no other pair of its A id is in more."""
    total = materialize(rows.groupBy("a", "b").agg(F.sum("n").alias("docs")), "pair-counts")
    # At most one row per id of A's vocabulary.
    top = total.groupBy("a").agg(F.max("docs").alias("most"))
    return total.join(F.broadcast(top), "a").select("a", "b", "docs", (F.col("docs") == F.col("most")).alias("best"))


def align(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum (long), groups_sha256.

    Null and empty texts, and those whose tokens of either side do not join to space + text, have no tokens: zeros and ''.
    Texts are taken whole, and one without a place to cut is a chunk of its own. Rows that share an id, and repeated
    rows, are documents of their own; an empty table gives no rows; other columns are left out, whatever their names.
    """
    made = materialize(blocks_of(docs, byte_path, piece_path, id_col, text_col), "aligned")
    rows = materialize(pair_rows(made.filter("counts IS NULL")), "block-pairs")
    back = rows.join(pair_counts(rows), ["a", "b"]).select("block", (F.col("a") * (1 << B_BITS) + F.col("b")).alias("pair"), "docs", "best")
    names = ["n_a", "n_b", "n_groups", "n_links"]

    def run(key, docs, known):
        known = known.sort_by("pair")
        pair, count, best = (known.column(c).to_numpy() for c in ("pair", "docs", "best"))
        out, total = np.zeros((docs.num_rows, 2), np.int64), docs.column("counts").to_pylist()
        for i, (keys, times) in enumerate(zip(docs.column("pairs").to_pylist(), docs.column("times").to_pylist(), strict=True)):
            at, n = np.searchsorted(pair, unpack(keys).astype(np.int64)), unsqueeze(times, np.int64)
            out[i] = n[best[at]].sum(), (n * count[at]).sum()
        every = np.array(total, np.int64).reshape(-1, 4)
        cols = {"doc_id": docs.column("doc_id")} | {c: pa.array(every[:, j]) for j, c in enumerate(names)}
        return pa.table(cols | {"n_best": pa.array(out[:, 0]), "count_sum": pa.array(out[:, 1]), "groups_sha256": docs.column("groups_sha256")})

    own = made.filter("counts IS NOT NULL").groupBy("block")
    return own.cogroup(back.groupBy("block")).applyInArrow(run, f"doc_id long, {', '.join(f'{c} long' for c in names)}, n_best long, count_sum long, groups_sha256 string")
