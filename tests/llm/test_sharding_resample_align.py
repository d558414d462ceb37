"""Sharding, importance resampling and token alignment against brute force, on tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import SCHEMA, corpus

from lodestack.llm import align, common, queries, resample, sharding

#: What the numbered helper and the operators must not trip over: columns named like their own.
CLASH = SCHEMA + ", shard string, slot string, score string, rank string, block string, counts string"


def more():
    """The corpus with texts that tokenizers treat alike or not at all, many copies of one row, and a text without a space."""
    texts = ["<|endoftext|> and </s> <s> <unk> <0x41>", "▁ mark", "a  b   c \n\n d\n e \t f", " lead", "trail ", "\n", " x  y \u0085z", "é́ ñ 漢字かな 🎉🏳️‍🌈 \x00\x1c x", "x" * 3000, "It's we'll I'd THEY'RE 12345 67 8", "don't\tstop " * 50]
    rows = corpus()
    return [*rows, *((1000 + i, t, None, None, 0, "x", "y", "z") for i, t in enumerate(texts)), *([rows[25]] * 300), *([(None, None, None, None, 0, "", "", "")] * 40)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, "s", "l", "c", "r", "b", "n") for r in more()]
    return spark.createDataFrame(rows, CLASH).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], CLASH)


def draws(key, weights):
    u = [(int(hashlib.md5(f"{key}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52 for i in range(len(weights))]
    return min(range(len(weights)), key=lambda i: (-math.log(u[i]) / weights[i] if weights[i] else math.inf, i))


def test_sharding(docs, empty):
    got = sharding.assign(docs, [1.0] * 8).collect()
    want = []
    for i, t in ((r[0], (r[1] or "").encode()) for r in more()):
        key = "null" if i is None else i
        want.append((-1 if i is None else i, len(t) + 1, zlib.crc32(t), draws(key, [1.0] * 8), draws(key, [1.0] * 9)))
    key = lambda r: (-1 if r["doc_id"] is None else r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["grown_shard"])
    assert sorted(map(key, got)) == sorted(want)
    assert all(r["grown_shard"] in (r["shard"], 8) for r in got)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append((r["slot"], r["doc_id"] is not None, r["doc_id"] or 0))
    assert all([s for s, *_ in sorted(v)] == list(range(len(v))) and [x[1:] for x in sorted(v)] == sorted(x[1:] for x in v) for v in slots.values())
    assert sharding.assign(empty, [1.0]).count() == 0


def test_shards_by_weight_move_little(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "doc_id")
    share = Counter(r[0] for r in rows.select(sharding.shard_of(sharding.record_key("doc_id"), [1.0, 2.0, 0.0, 3.0])).collect())
    assert set(share) == {0, 1, 3} and all(abs(share[i] / 20_000 - w / 6) < 0.015 for i, w in ((0, 1), (1, 2), (3, 3)))
    # A shard that goes gives away its own records, a heavier one only gains, and both are as many as the weights say.
    gone = sharding.moved(rows, [1.0] * 4, [1.0, 1.0, 0.0, 1.0]).collect()
    assert {r["from_shard"] for r in gone} == {2} and abs(sum(r["records"] for r in gone) / 20_000 - 0.25) < 0.015
    grown = sharding.moved(rows, [1.0] * 4, [1.0, 1.0, 2.0, 1.0]).collect()
    assert {r["to_shard"] for r in grown} == {2} and abs(sum(r["records"] for r in grown) / 20_000 - 0.15) < 0.015
    with pytest.raises(ValueError, match="weights"):
        sharding.shard_of(F.lit("x"), [0.0, 0.0])


def test_shards_are_written(spark, docs, tmp_path):
    sharding.write_shards(docs, [1.0, 1.0, 2.0], str(tmp_path / "shards"), files=6)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted(map(str, back.select("doc_id", "text").collect())) == sorted(map(str, docs.select("doc_id", "text").collect()))
    assert back.filter(F.col("shard") != sharding.shard_of(sharding.record_key("doc_id"), [1.0, 1.0, 2.0])).count() == 0


def test_numbered_spreads_equal_rows(spark):
    rows = spark.range(4000).select(F.lit("hot").alias("g"), (F.col("id") % 2).alias("x"))
    out = common.numbered(rows, ["x"], "n", group="g").withColumn("p", F.spark_partition_id()).collect()
    assert sorted((r["x"], r["n"]) for r in out) == [(i // 2000, i) for i in range(4000)]


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def features(t):
    w = WORD.findall(low(t))
    return len(w), [zlib.crc32(x.encode()) % 10_000 for x in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]]


def drawn(rows, target, share, least):
    raw, want = Counter(b for _, t in rows for b in features(t)[1]), Counter(b for t in target for b in features(t)[1])
    s, t = sum(raw.values()), sum(want.values())
    gain = {b: math.floor(1000 * math.log((want[b] + 1.0) * (s + 10_000.0) / ((raw[b] + 1.0) * (t + 10_000.0)))) for b in raw}
    out = []
    for i, text in rows:
        n, f = features(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((n, i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((x for x in out if x[0] >= least), key=lambda x: (-x[4], x[1] is not None, x[1] or 0, x[2], x[3]))
    ranks = {}
    for k, x in enumerate(able[: share * len(able) // 100]):
        ranks.setdefault(x, []).append(k + 1)
    return [(x[1], x[2], x[3], x[4], ranks[x].pop(0) if x[0] >= least and ranks.get(x) else None) for x in out]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x or 0) for x in r))


@pytest.mark.parametrize("words, pairs", [(0, 0), (30, 20), (16_384, 65_536)])
def test_resample(spark, docs, empty, words, pairs):
    target = ["the abc def abc", None, "", "Word WORD word " * 20, "漢字かな交じり文", "don't stop"]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resample.resample(docs, bench, head_words=words, head_pairs=pairs).collect()
    assert ordered(tuple(r) for r in got) == ordered(drawn([r[:2] for r in more()], target, 25, 20))
    if not words:
        assert resample.resample(empty, bench).count() == 0
        assert len({r["weight"] for r in resample.resample(docs, bench.filter("false")).collect()}) > 1


def test_resample_any_text():
    rng = random.Random(5)
    texts = ["", "A", "Hello, World é12 ", "no" * 50 + " a " + "y" * 65 + " " + "z" * 64 + " q", "漢字 か \x00ab\x7fcd"]
    texts += ["".join(rng.choice("ab cZ9é漢.\n") for _ in range(rng.randint(0, 300))) for _ in range(200)]
    w = resample.Words([t.encode() for t in texts])
    keys = np.unique(w.keys()[w.keys() > 0])[::2]
    at = resample.Vocabulary(keys, np.zeros((0, 2), np.uint64))
    both = np.stack([at.find(w.keys())[w.second - 1], at.find(w.keys())[w.second]], 1)
    both = at.keys[np.unique(both[(both >= 0).all(1)], axis=0)[::2]]
    one, two = resample.Features(resample.Vocabulary(keys, both)).of(w)
    upto = np.searchsorted(w.second, w.ends)
    for i, t in enumerate(texts):
        assert [*one[w.ends[i] : w.ends[i + 1]], *two[upto[i] : upto[i + 1]]] == features(t)[1]


def aligned(rows, tok, forms_a, sp, forms_b):
    """Each text on its own, token by token."""
    out, held = [], Counter()
    for i, t in rows:
        raw = (" " + (t or "")).encode()
        a = tok.encode(" " + t, add_special_tokens=False).ids if t else []
        b = sp.encode(t) if t else []
        if not t or b"".join(forms_a[x] for x in a) != raw or b"".join(forms_b[x] for x in b) != raw:
            out.append((i, [], [], [], []))
            continue
        ea, eb = np.cumsum([len(forms_a[x]) for x in a]).tolist(), np.cumsum([len(forms_b[x]) for x in b]).tolist()
        pairs, j = [], 0
        for p, e in enumerate(ea):
            s = e - len(forms_a[a[p]])
            while eb[j] <= s:
                j += 1
            k = j
            while k < len(b) and eb[k] - len(forms_b[b[k]]) < e:
                pairs.append((a[p], b[k]))
                k += 1
        groups, p, q = [], 0, 0
        for e in sorted(set(ea) & set(eb)):
            x, y = ea.index(e) + 1, eb.index(e) + 1
            groups.append((a[p:x], b[q:y]))
            p, q = x, y
        held.update(set(pairs))
        out.append((i, a, b, groups, pairs))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    done = []
    for i, a, b, groups, pairs in out:
        form = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        done.append((i, len(a), len(b), len(groups), len(pairs), sum(held[p] == best[p[0]] for p in pairs), sum(held[p] for p in pairs), hashlib.sha256(form.encode()).hexdigest() if a else ""))
    return done


@pytest.fixture(scope="module")
def tokenizers():
    return (*align.byte_tokenizer(queries.tokenizer_path("byte_bpe_50k.json")), *align.piece_tokenizer(queries.tokenizer_path()))


def test_align(docs, empty, tokenizers, monkeypatch):
    paths = queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path()
    want = ordered(aligned([r[:2] for r in more()], *tokenizers))
    assert ordered(tuple(r) for r in align.align(docs, *paths).collect()) == want
    assert sum(r[1] == 0 for r in want) < len(want) / 2 and align.align(empty, *paths).count() == 0
    # Small steps, blocks and tables give the same.
    for name, n in (("STEP_CHARS", 300), ("BLOCK_CHARS", 2000), ("TABLE_CHARS", 500)):
        monkeypatch.setattr(align, name, n)
    assert ordered(tuple(r) for r in align.align(docs, *paths).collect()) == want


def test_align_random_texts(tokenizers):
    tok, forms_a, sp, forms_b = tokenizers
    rng, table = random.Random(11), align.Aligner(queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path(), most=40)
    for _ in range(60):
        texts = ["".join(rng.choice(" \n\t ab's.1é漢▁🎉<|>") for _ in range(rng.randint(0, 40))) for _ in range(20)]
        counts, forms, text, pairs, times = table.align(texts)
        for i, want in enumerate(aligned(list(enumerate(texts)), tok, forms_a, sp, forms_b)):
            assert (*counts[i], hashlib.sha256(forms[i].encode()).hexdigest() if forms[i] else "") == (*want[1:5], want[7]), texts[i]
            assert times[text == i].sum() == want[4] and len(set(pairs[text == i])) == (text == i).sum()


def test_pointers_converge():
    rng = np.random.default_rng(2)
    for n in (1, 2, 50, 3000):
        edges = np.arange(1, n)
        a, b = (np.r_[np.sort(rng.choice(edges, rng.integers(0, n), replace=False)), n] for _ in range(2))
        last = align.terminals(align.farthest(a, b))
        ends = np.r_[a, b]
        both = np.intersect1d(a, b)
        assert (ends[last] == both[np.searchsorted(both, ends)]).all()
