"""SentencePiece encoding and decoding with a distinct-chunk table.

The vocabularies in question have no piece that holds a whitespace marker after another character, so no
merge crosses the start of a run of markers: a text is the concatenation of chunks `▁+[^▁]*` that encode
on their own. Each task keeps a table of the distinct chunks it has met, has the library segment each of
them once, and joins ids back by position with array gathers. The table is bounded; when it is full it
starts anew. A global table would need a shuffle of every word occurrence, several times the input, so
chunks are made distinct per task instead (see the README).

A vocabulary that does have such a piece is encoded text by text, without the table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
#: Texts are handled in blocks of about so many characters; a task's table holds so many chunks at most.
BLOCK_CHARS, TABLE_CHUNKS = 2_000_000, 400_000


def load(model_path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_path)


class ChunkTable:
    """Distinct chunks and their ids. A chunk's key is its text without its first marker."""

    def __init__(self, sp, most: int = TABLE_CHUNKS):
        self.sp, self.most = sp, most
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.alone = sp.piece_to_id(MARK)
        self.splits = not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces) and sp.encode(" ") == sp.encode(MARK) and sp.id_to_piece(self.alone) == MARK
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.flat, self.lens = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def chunks(self, text: str) -> list[str]:
        if not text:
            return []
        words = text.split(" ")
        if "" not in words and MARK not in text:
            return words
        return [x[1:].replace(MARK, " ") for x in CHUNK.findall(MARK + text.replace(" ", MARK))]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids of each text."""
        if not self.splits:
            ids = self.sp.encode(texts, num_threads=1)
            return np.fromiter(chain.from_iterable(ids), np.int32), np.array([len(x) for x in ids], np.int64)
        lists = [self.chunks(t) for t in texts]
        if new := list(set(chain.from_iterable(lists)).difference(self.at)):
            if len(self.at) + len(new) > self.most and self.at:
                self.clear()
                new = list(set(chain.from_iterable(lists)))
            ids = [x if c else [self.alone] for c, x in zip(new, self.sp.encode(new, num_threads=1), strict=True)]
            self.at.update(zip(new, range(len(self.lens), len(self.lens) + len(new)), strict=True))
            self.lens = np.concatenate([self.lens, np.array([len(x) for x in ids], np.int64)])
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.int32)])
        at = np.fromiter(map(self.at.__getitem__, chain.from_iterable(lists)), np.int64)
        n, starts = self.lens[at], np.cumsum(self.lens) - self.lens
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = self.flat[np.repeat(starts[at] - ends[:-1], n) + np.arange(ends[-1])] if len(at) else np.zeros(0, np.int32)
        edges = np.cumsum([0, *map(len, lists)])
        return ids, np.diff(ends[edges])


class Surfaces:
    """The bytes of every piece, for decoding by a gather."""

    def __init__(self, sp):
        self.sp, n = sp, sp.get_piece_size()
        plain = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(n)]
        form = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace(MARK, " ").encode() for i in range(n)]
        self.plain, self.lens = np.array(plain), np.array([len(x) for x in form], np.int64)
        self.flat, self.starts = np.frombuffer(b"".join(form), np.uint8), np.cumsum(self.lens) - self.lens
        self.marked = np.array([sp.id_to_piece(i).startswith(MARK) for i in range(n)])

    def decode(self, ids: np.ndarray) -> str:
        if not len(ids):
            return ""
        if self.plain[ids].all():
            n = self.lens[ids]
            ends = np.cumsum(n)
            raw = self.flat[np.repeat(self.starts[ids] - (ends - n), n) + np.arange(ends[-1])].tobytes()
            try:
                return raw[int(self.marked[ids[0]]) :].decode()
            except UnicodeDecodeError:
                pass
        return self.sp.decode(ids.tolist())


def blocks(chars: list[int]) -> Iterator[slice]:
    """Blocks of texts of so many characters each."""
    start = size = 0
    for i, n in enumerate(chars):
        size += n
        if size >= BLOCK_CHARS:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(chars):
        yield slice(start, len(chars))


def encode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", decoded: str | None = None) -> DataFrame:
    """(id, n_tokens long, token_ids array<int>) of every whole text; null and empty texts have no ids.

    Rows stay as they are, repeated ones too; other columns are left out. With decoded given, a column of that name has the text that the
    library decodes from the ids, as decode() does, by the same worker: two steps would keep two Python workers for each core.
    """
    names = [id_col, "n_tokens", "token_ids", *([decoded] if decoded else [])]

    def run(batches):
        sp = load(model_path)
        tab, forms = ChunkTable(sp), Surfaces(sp) if decoded else None
        for b in batches:
            texts = b.column(1)
            for s in blocks(pc.fill_null(pc.utf8_length(texts), 0).to_pylist()):
                ids, n = tab.encode([t or "" for t in texts[s.start : s.stop].to_pylist()])
                ends = np.concatenate([[0], np.cumsum(n)])
                out = [b.column(0)[s.start : s.stop], pa.array(n), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))]
                if decoded:
                    out.append(pa.array([forms.decode(ids[i:j]) for i, j in zip(ends, ends[1:], strict=False)], pa.string()))
                yield pa.RecordBatch.from_arrays(out, names=names)

    pruned = df.select(id_col, text_col)
    back = f", `{decoded}` string" if decoded else ""
    return pruned.mapInArrow(run, f"`{id_col}` {pruned.schema[0].dataType.simpleString()}, n_tokens long, token_ids array<int>{back}")


def decode(df: DataFrame, model_path: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """df with the ids replaced by the text that the library decodes from them (null ids: null)."""
    keep = [c for c in df.columns if c not in (ids_col, out_col)]

    def run(batches):
        forms = Surfaces(load(model_path))
        for b in batches:
            lists, kept = b.column(len(keep)), b.columns[:-1]
            lens = np.asarray(lists.value_lengths().fill_null(0))
            start = 0
            for stop in [*(np.flatnonzero(np.diff(np.cumsum(lens) // BLOCK_CHARS)) + 1), len(lens)]:
                part = lists[int(start) : int(stop)]
                values = np.asarray(part.flatten())
                ends = np.cumsum(lens[start:stop])
                out = [forms.decode(values[e - n : e]) if ok else None for e, n, ok in zip(ends, lens[start:stop], part.is_valid().to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(c[int(start) : int(stop)] for c in kept), pa.array(out, pa.string())], names=[*keep, out_col])
                start = stop

    pruned = df.select(*keep, ids_col)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pruned.schema.fields[:-1])
    return pruned.mapInArrow(run, f"{types}, `{out_col}` string")
