"""The training-data operators against brute force, on tables with nulls, empty and long texts, ties and repeated rows."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.llm import chunks, common, components, licenses, lines, minhash, mixing, piece_codec, quality, queries, repeats, shingles, tokenfiles, topk, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, size string, kept string"
LINE = "This line is common to many of the documents here"


def corpus(seed=0):
    """Documents with what may go wrong: nulls, empty texts, copies, near copies, repeated rows, one long text, odd white space."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    texts = [None, "", " ", "\n", "\n\n", "a", "word " * 30, prose(5000), prose(3)]
    texts += [prose(rng.randint(20, 200)) for _ in range(20)]
    base = prose(120)
    texts += [base, base, base, base + " tail", "head " + base, base.replace(" ", "\n", 3)]
    texts += [f"{prose(20)}\n{x}\n{prose(10)}" for x in (LINE, f"  {LINE.upper()}\t", LINE, "short", "short", "short", LINE + "\r")]
    texts += [f"{LINE}\n{LINE}", "  x   y  ▁z", "漢字かな交じり文 🎉 \x00 end", "#*$ %& |<> " * 12, prose(40) + " Licensed under the Apache License, Version 2.0."]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None]), 0, "x", "y", "z") for i, t in enumerate(texts)]
    rows.append((None, prose(50), None, None, None, None, None, None))
    return [*rows, rows[20], rows[2]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(rows):
    return [(r[0], r[1] or "") for r in rows]


def test_repeats(docs, empty):
    got = defaultdict(list)
    for r in repeats.repeated_spans(docs, 50).collect():
        got[r["doc_id"]].append((r["n_bytes"], [(x["start"], x["end"]) for x in r["spans"]], bytes(r["kept"])))
    first, texts = {}, sorted(plain(corpus()), key=lambda x: (x[0] is not None, x[0] or 0))
    for i, t in texts:
        b = t.encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    want = defaultdict(list)
    for i, t in texts:
        b, cover = t.encode(), np.zeros(len(t.encode()) + 1, bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] != i:
                cover[p : p + 50] = True
        edge = np.flatnonzero(np.diff(np.r_[False, cover].astype(int)))
        want[i].append((len(b), list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)), bytes(np.frombuffer(b, np.uint8)[~cover[:-1]])))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert repeats.repeated_spans(empty, 50).count() == 0


def test_repeats_with_hot_anchors(spark, docs, monkeypatch):
    """One phrase between different neighbours in every document: the same result window by window, and no key with many records."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(40))
    phrase = "a phrase of over thirty bytes that stands everywhere"[:44]
    same = [word() for _ in range(7)]
    texts = [f"{word()} {phrase} {rng.choice(same) if i % 3 else word()}" for i in range(400)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    both = [sorted(map(str, repeats.repeated_spans(d, 50).collect())) for d in (docs, table)]
    assert sum("start=" in x for x in both[1]) > 100
    monkeypatch.setattr(repeats, "HOT_DOCS", 2)
    assert [sorted(map(str, repeats.repeated_spans(d, 50).collect())) for d in (docs, table)] == both

    data = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.cumsum([0, *map(len, texts)])
    text, at, first, last, h = repeats.anchors(data, off, 50)
    for hot, least, most in ((False, 100, 400), (True, 1, 1)):
        k, rows, doc, start, gone = repeats.records(data, text, at, first, last, repeats.cut(h), np.full(len(at), hot), 50)
        assert least <= np.unique(k, return_counts=True)[1].max() <= most
        assert (np.diff(k.astype(np.int64)) >= 0).all() and len(k) == len(rows) == len(doc) == len(start)
    # Every window is sent, or goes at once.
    assert sorted([*start, *gone]) == sorted(repeats.ranges(first, last))


def test_sentencepiece(docs, empty):
    model = queries.tokenizer_path()
    sp = piece_codec.load(model)
    out = piece_codec.decode(piece_codec.encode(docs, model).withColumn("ids", F.col("token_ids")), model, "ids").collect()
    want = sorted((sp.encode(t), sp.decode(sp.encode(t))) for _, t in plain(corpus()))
    assert sorted((r["token_ids"], r["decoded"]) for r in out) == want
    assert piece_codec.encode(empty, model).count() == 0


def test_encode_and_decode_in_one_step(docs, empty):
    """One Python step gives what encode and decode give one after the other."""
    model = queries.tokenizer_path()
    both = piece_codec.encode(docs, model, decoded="decoded")
    want = piece_codec.decode(piece_codec.encode(docs, model).withColumn("ids", F.col("token_ids")), model, "ids")
    key = lambda r: (r["doc_id"] is not None, r["doc_id"], r["token_ids"])
    assert sorted(both.collect(), key=key) == sorted(want.collect(), key=key)
    assert both.columns == ["doc_id", "n_tokens", "token_ids", "decoded"] and piece_codec.encode(empty, model, decoded="decoded").count() == 0
    import corpus_pipeline

    plan = corpus_pipeline.encode(docs.sparkSession, docs, "")._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("MapInArrow") == 1


def test_sentencepiece_random_ids():
    sp = piece_codec.load(queries.tokenizer_path())
    tab, forms, rng = piece_codec.ChunkTable(sp, most=50), piece_codec.Surfaces(sp), random.Random(3)
    for _ in range(300):
        texts = ["".join(rng.choice(" ▁ab\né漢<>s/0x") for _ in range(rng.randint(0, 30))) for _ in range(20)]
        ids, n = tab.encode(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == sp.encode(texts)
        odd = [rng.choice([0, 1, 2, 3, 200, 230, 100, 29871, rng.randrange(32000)]) for _ in range(6)]
        assert forms.decode(np.array(odd)) == sp.decode(odd)


def test_features(docs, empty):
    got = sorted(tuple(r) for r in quality.features(docs.select("doc_id", "text", F.lit("clash").alias("n_words"))).fillna(-1, ["doc_id"]).collect())
    want = []
    for i, t in plain(corpus()):
        w = WORD.findall(t)
        at, cover, seen, dup = defaultdict(list), set(), set(), 0
        for p in range(len(w) - 7):
            at[tuple(w[p : p + 8])].append(p)
        for v in at.values():
            for p in v if len(v) > 1 else []:
                cover.update(range(p, p + 8))
        for x in t.split("\n"):
            if WORD.search(x):
                dup += x in seen
                seen.add(x)
        want.append((-1 if i is None else i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover), len(w) < 20 or 100 * len(cover) > 30 * len(w)))
    assert got == sorted(want) and quality.features(empty).count() == 0


def test_binomial(spark):
    from math import comb

    cases = [(k, n, p) for n in (1, 30, 500) for k in (0, 1, 4) if k < n for p in (0.01, 0.05)]
    for k, n, p in cases:
        exact = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        got = spark.range(1).select(quality.binomial_cdf(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()[0]
        assert got == 1.0 if k >= n * p else abs(got - exact) < 1e-9


def test_thresholds_reject_junk_and_keep_good(spark, empty):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7)))
    rows = [(i, " ".join(word() + ("###" if i % 4 == 0 else "") for _ in range(40)), "en" if i % 2 else None) for i in range(6000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = d.select("doc_id", F.when(F.col("doc_id") % 4 == 0, 0).otherwise(1).alias("quality"))
    kept = quality.judge(d, labels).groupBy((F.col("doc_id") % 4 == 0).alias("bad")).agg(F.count_if("kept").alias("n")).collect()
    assert {r["bad"]: r["n"] for r in kept} == {True: 0, False: 4500}
    assert quality.keep(d, labels).count() == 4500
    assert quality.keep(d, labels.filter("doc_id < 20")).count() == 6000  # too few labels certify nothing
    assert quality.judge(empty, labels).count() == 0 and quality.keep(empty, labels).columns == empty.columns


def test_quality_with_clashing_columns(spark):
    names = ["kept", "failed_rules", "cut_symbols", "_cut_symbols", "_text", "_row", "_at", "_stratum", "stratum", "n_words"]
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(30)), "en", *("x" * len(names))) for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, " + ", ".join(f"`{n}` string" for n in names))
    labels = d.select("doc_id", F.lit(1).alias("quality"))
    assert quality.keep(d, labels).columns == d.columns and quality.keep(d, labels).count() == 300
    judged = quality.judge(d.drop("_text"), labels)
    assert judged.filter("kept").count() == 300 and dict(judged.dtypes)["kept"] == "boolean"


def path_features(spark, rows):
    """A table of features, from (doc_id, lang, symbols per 100 words)."""
    d = spark.createDataFrame(rows, "doc_id long, lang string, n_symbols long")
    zero = {c: F.lit(0).cast("long") for c in ("n_dup_lines", "n_repeat_words")}
    return d.withColumns({"n_words": F.lit(100).cast("long"), "word_chars": F.lit(500).cast("long"), "base_failed": F.lit(False), **zero})


def test_labels_count_once(spark):
    """Repeated rows are one row of the holdout, and ids with both labels none."""
    rows = [(i, "en", 0) for i in range(100)] + [(5, "en", 40)] * 50 + [(7, "en", 40)] * 3
    labels = spark.createDataFrame([(i, 1) for i in range(100)] + [(7, 0)], "doc_id long, quality int")
    got = quality.certify(path_features(spark, rows), labels, "lang").filter("rule = 'symbols' AND cutoff = 0.3").first()
    assert (got["n_good"], got["k_good"], got["n_bad"]) == (99, 1, 0)


def test_joint_risk_stays_below_epsilon(spark):
    """Over many strata, each a holdout of its own drawing, with a true risk of each cutoff that is known."""
    rng, strata, n = random.Random(8), 300, 250
    # A good document has more than 20 symbols in 100 words with probability 0.08, more than 50 with 0.02: cutoffs up to 0.3 and below break epsilon.
    draw = lambda: 60 if (u := rng.random()) < 0.02 else 40 if u < 0.08 else 0
    rows = [(s * n + i, f"s{s}", draw()) for s in range(strata) for i in range(n)]
    measured = path_features(spark, rows).cache()
    labels = spark.createDataFrame([(r[0], 1) for r in rows], "doc_id long, quality int")
    # delta is per table: with 300 strata that count together hardly any is certified, so each is tested at delta by multiplying it.
    found = quality.certify(measured, labels, "lang", 0.03, 0.05 * strata).filter("certified").groupBy("stratum").agg(F.max("step").alias("s")).collect()
    measured.unpersist()
    assert sum(r["s"] >= 11 for r in found) <= strata * 0.05 + 3 * (strata * 0.05 * 0.95) ** 0.5
    assert len(found) > strata * 0.9


def test_several_strata_certify(spark):
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet").join(spark.read.parquet(f"{d}/labels.parquet").select("doc_id"), "doc_id", "left_semi").select("doc_id", "text", "lang")
    steps = quality.certify(common.materialize(quality.features(docs), "t"), spark.read.parquet(f"{d}/labels.parquet"), "lang").filter("certified").groupBy("stratum").agg(F.max("step").alias("s")).collect()
    assert {r["stratum"] for r in steps} == {"de", "en", "es", "fr"}


def test_token_files(spark, docs, empty, tmp_path):
    sp = piece_codec.load(queries.tokenizer_path())
    want = sorted((-1 if i is None else i, len(sp.encode(t))) for i, t in plain(corpus()))
    for how in ("none", "gzip"):
        tokenfiles.write_token_files(docs, f"{tmp_path}/{how}", queries.tokenizer_path(), shard_tokens=3000, compression=how)
        got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"]) for r in tokenfiles.token_counts(spark, f"{tmp_path}/{how}").collect())
        assert got == want
    tokenfiles.write_token_files(empty, f"{tmp_path}/nothing", queries.tokenizer_path())
    assert tokenfiles.token_counts(spark, f"{tmp_path}/nothing").count() == 0


@pytest.mark.parametrize("split", [7, 30, 1000])
def test_stitching(spark, tmp_path, split):
    """Files in byte ranges of a few bytes, several tasks each; ids whose bytes look like a separator at odd places."""
    rng, want = random.Random(split), []
    for s in range(3):
        flat = [2 if rng.random() < 0.2 else rng.choice([3, 512, 514, 0, 515, 9]) for _ in range(50)]
        (tmp_path / f"kind=tokens/shard=s{s}").mkdir(parents=True)
        (tmp_path / f"kind=tokens/shard=s{s}/part.bin").write_bytes(np.array(flat, "<u2").tobytes())
        parts, run = [], 0
        for x in flat:
            parts, run = ([*parts, run], 0) if x == 2 else (parts, run + 1)
        want += [(f"s{s}", i, n) for i, n in enumerate([*parts, run] if run else parts)]
    conf = {"spark.sql.files.maxPartitionBytes": str(split), "spark.sql.files.openCostInBytes": "1"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        found = tokenfiles.scan(spark, str(tmp_path))
        assert split > 300 or found.select("shard", "block").distinct().count() > 3
        got = sorted(tuple(r) for r in tokenfiles.stitch(found).collect())
    finally:
        for k in conf:
            spark.conf.unset(k)
    assert got == sorted(want)


def test_mix(spark, docs, empty):
    knots = mixing.cycle_schedule(docs, queries.CYCLE)
    rows = mixing.mix(docs, knots).collect()
    assert len(rows) == docs.count()
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
        assert r["taken"] == r["size"] * r["copies"] <= 2 * r["size"] and len(r["times"]) == r["copies"] and all(0 <= t <= 1 for t in r["times"])
    order = sorted(by, key=lambda s: (s is None, s or ""))
    size = {s: sum(r["size"] for r in by[s]) for s in order}
    weight, left, target, open_ = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(size.values()), {}, set(order)
    while over := [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 2 * size[s]]:
        for s in over:
            target[s] = 2.0 * size[s]
        open_ -= set(over)
        left -= sum(target[s] for s in over)
    target |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
    for s in order:
        assert all(abs(r["target"] - target[s]) < 1e-6 for r in by[s])
        assert abs(sum(r["taken"] for r in by[s]) - target[s]) <= max(r["size"] for r in by[s]) / 2 + 1
    again = mixing.mix(docs, knots).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    assert mixing.mix(empty, mixing.cycle_schedule(empty, queries.CYCLE)).count() == 0


def test_training_order_of_repeated_and_null_ids(spark):
    text = lambda i, n: f"t{i} " * n
    rows = [(1, text(1, 30)), (1, text(1, 30)), (1, text(2, 30)), (1, text(3, 7)), (None, text(4, 9)), (None, text(5, 9)), (2, None), (3, "")] + [(i, text(i, 20)) for i in range(10, 60)]
    d = spark.createDataFrame([(*r, "size", "row") for r in rows], "doc_id long, text string, size string, row string").withColumn("source", F.lit("a"))
    mixed = mixing.mix(d, mixing.cycle_schedule(d, [[(0.0, 1.0), (1.0, 1.0)]])).cache()
    out = mixing.in_training_order(d, mixed)
    size = lambda t: len(WORD.findall(t or ""))
    got = sorted((r["doc_id"] or 0, size(r["text"])) for r in out.collect())
    want = sorted((r["doc_id"] or 0, r["size"]) for r in mixed.collect() for _ in range(r["copies"]))
    assert out.columns == d.columns and got == want
    assert max(sum(r["text"] == t for r in out.collect()) for _, t in rows[2:6]) <= 2


def test_time_inverts_the_integral(spark):
    knots = spark.createDataFrame([("a", 0.0, 1.0), ("a", 0.5, 3.0), ("a", 1.0, 0.0)], "source string, t double, weight double")
    shape = mixing.integrate(knots)
    share = spark.range(101).select((F.col("id") / 100).alias("u"))
    for r in share.join(shape).select("u", "weight", mixing.time_of(F.col("u")).alias("t")).collect():
        t = r["t"]
        area = t + 2 * t * t if t <= 0.5 else 1.0 + 3 * (t - 0.5) - 3 * (t - 0.5) ** 2
        assert abs(area - r["u"] * r["weight"]) < 1e-9


def test_warc(spark, tmp_path):
    html = ["<p>a</p>", "<p>a</p>", None, "", "x\r\n\r\ny\r\n\r\nWARC/1.1\r\n", "é" * 1000, "<p>a</p>"]
    rows = [(i, None if i == 3 else f"http://h/{i} x", h, 1) for i, h in enumerate(html)]
    # Repeated rows: of a response, of a revisit, with other urls, with null ids, and one payload that only null ids have.
    rows += [rows[5], rows[5], rows[1], (6, "http://other/", html[6], 1), (6, None, html[6], 1), (None, "http://n/", html[0], 1), (None, "http://n/", html[0], 1)] + [(None, None, "only", 1)] * 3
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, bytes int").repartition(3)
    for name, p in (("repeated", pages), ("plain", spark.createDataFrame(rows[:7], pages.schema))):
        source = p.collect()
        warc.write_archive(p, f"{tmp_path}/{name}")
        got = warc.captures(warc.read_records(spark, f"{tmp_path}/{name}")).collect()
        assert len(got) == len(source) == len({r["record_id"] for r in got})
        page_of = {r["record_id"]: int(x[1]) if (x := re.search(r"page-id: (\d+)", r["metadata"]["fields"])) else None for r in got}
        best = defaultdict(lambda: -1)
        for r in source:
            best[r["html"] or ""] = max(best[r["html"] or ""], -1 if r["page_id"] is None else r["page_id"])
        seen = []
        for r in got:
            assert r["request"]["fields"].startswith("GET ")
            at = r["refers_to"] if r["type"] == "revisit" else r["record_id"]
            data = bytes(next(x["payload"] for x in got if x["record_id"] == at))
            page = page_of[r["record_id"]]
            last = best[data.decode()]
            assert r["type"] == ("response" if (-1 if page is None else page) == last else "revisit")
            assert (r["payload_bytes"], r["payload_digest"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
            assert r["type"] == "response" or page_of[r["refers_to"]] == last
            seen.append((page, r["uri"], data.decode()))
        assert sorted(seen, key=str) == sorted(((r["page_id"], r["url"] and r["url"].replace(" ", ""), r["html"] or "") for r in source), key=str)
    warc.write_archive(pages, f"{tmp_path}/all", min_bytes=10**6)
    assert warc.captures(warc.read_records(spark, f"{tmp_path}/all")).filter("type = 'response'").count() == len(rows)
    warc.write_archive(pages.limit(0), f"{tmp_path}/none")
    assert warc.captures(warc.read_records(spark, f"{tmp_path}/none")).count() == 0


def expected_licenses(text):
    fold = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    cut = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    own, found = cut(fold(text)), defaultdict(dict)
    every = [(family, name, cut(fold(t))) for family, name, t in licenses.TEMPLATES]
    good = [x for x in every if len(own & x[2]) / len(x[2]) >= 0.8]
    inside = lambda a, b: a[0] == b[0] and a[1] != b[1] and len(b[2]) > len(a[2]) and len(a[2] & b[2]) / len(a[2]) >= 0.8 and 2 * len(own & (b[2] - a[2])) > len(b[2] - a[2])
    for family, name, s in good:
        share = len(own & s) / len(s)
        if not any(inside((family, name, s), b) for b in good):
            found[family][name] = max((share, len(s)), found[family].get(name, (0.0, 0)))
    out = []
    for names in found.values():
        whole = [(n, 1.0) for n, (share, _) in names.items() if share == 1.0]
        out += whole or [min(((n, x[0]) for n, x in names.items()), key=lambda y: (-y[1], -names[y[0]][1], y[0]))]
    return sorted(out)


def test_licenses(docs, empty):
    want = [(-1 if i is None else i, expected_licenses(t)) for i, t in plain(corpus())]
    got = [(-1 if r["doc_id"] is None else r["doc_id"], [(x["license"], x["containment"]) for x in r["licenses"]]) for r in licenses.scan_licenses(docs).collect()]
    assert sorted(got) == sorted(want) and any(x for _, x in got) and licenses.scan_licenses(empty).count() == 0


def test_license_versions_and_scattered_texts(spark):
    text = {(n, len(t)): t for _, n, t in licenses.TEMPLATES}
    longest = lambda name: max((t for (n, _), t in text.items() if n == name), key=len)
    two = f"{longest('GPL-2')} And then: {longest('GPL-3')} Licensed under the Apache License, Version 1.1. {longest('Apache-2.0')}"
    off = longest("GPL-3").replace("hope", "wish")
    words = longest("Zlib").split()
    scattered = " ".join(words[:60] + [f"x{i}" for i in range(3000)] + words[60:])
    rows = [(0, two), (1, off), (2, scattered), (3, " ".join(words[:40] + [f"x{i}" for i in range(50)] + words[40:]))]
    got = {r["doc_id"]: [(x["license"], x["containment"]) for x in r["licenses"]] for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [n for n, _ in got[0]] == ["Apache-1.1", "Apache-2.0", "GPL-2", "GPL-3"] and got[0] == expected_licenses(two)
    assert got[1] == expected_licenses(off) and [n for n, _ in got[1]] == ["GPL-3"]
    # Strewn over more than a window: contained in the text, but need not be retrieved.
    assert [n for n, _ in expected_licenses(scattered)] == ["Zlib"] and got[2] in ([], expected_licenses(scattered))
    assert got[3] == expected_licenses(rows[3][1])


def test_the_fuller_wording_is_the_license(spark):
    """Generic sentences and fewer clauses are part of a longer license that is found, also under another holder's name."""
    full = {n: max((t for _, m, t in licenses.TEMPLATES if m == n), key=len) for _, n, _ in licenses.TEMPLATES}
    other = re.sub(r"the copyright holder", "the Regents of Somewhere", full["BSD-3-Clause"], count=1)
    assert other != full["BSD-3-Clause"]
    texts = [full["BSD-3-Clause"], other, full["BSD-2-Clause"], full["BSD"], f"{full['LGPL-2.1']}", f"{full['BSD-2-Clause']} x {full['MIT']}"]
    got = {r["doc_id"]: [x["license"] for x in r["licenses"]] for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(6)] == [["BSD-3-Clause"], ["BSD-3-Clause"], ["BSD-2-Clause"], ["BSD"], ["LGPL-2.1"], ["BSD-2-Clause", "MIT"]]
    assert all([n for n, _ in expected_licenses(t)] == got[i] for i, t in enumerate(texts))


def test_every_template_is_found_inside_prose(spark):
    rng = random.Random(9)
    prose = lambda: " ".join("".join(rng.choice("xyzuvw") for _ in range(6)) for _ in range(rng.randint(30, 300)))
    rows = [(i, f"{prose()}\n{t}\n{prose()}") for i, (_, _, t) in enumerate(licenses.TEMPLATES)]
    got = {r["doc_id"]: [x["license"] for x in r["licenses"]] for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(licenses.TEMPLATES[i][1] in got[i] for i in got)


def test_near_duplicates(spark, docs, empty):
    rng = random.Random(11)
    prose = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)]
    rows, family = [], {}
    for f in range(12):
        base = prose(200)
        for k in range(rng.randint(1, 6)):
            w = list(base)
            for p in rng.sample(range(200), 0 if k == 0 else 2):
                w[p] = "edit" + str(len(rows))
            family[len(rows)] = f
            rows.append((len(rows), " ".join(w)))
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    cls = {r["doc_id"]: r["class_id"] for r in out}
    sets = {i: {tuple(t.split()[p : p + 5]) for p in range(196)} for i, t in rows}
    for a in cls:
        for b in cls:
            j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            if j >= 0.85:
                assert cls[a] == cls[b]
            if family[a] != family[b]:
                assert cls[a] != cls[b]
    assert all(c == min(x for x in cls if cls[x] == c) for c in cls.values())
    mixed = minhash.near_duplicates(docs).collect()
    texts = defaultdict(set)
    for r in mixed:
        texts[r["class_id"]].add(r["doc_id"])
    assert len(mixed) == docs.count() and {29, 30, 31} <= next(v for v in texts.values() if 29 in v)
    assert minhash.near_duplicates(empty).count() == 0


def weighted_classes(rows, damping, threshold=0.8):
    """Classes by brute force: exact weighted Jaccard similarity of all pairs of texts, df over all rows."""
    sets = [(-1 if i is None else i, t or "", collections.Counter(zip(*(w[k:] for k in range(5)), strict=False) if len(w) >= 5 else ([tuple(w)] if w else []))) for i, t in rows for w in [WORD.findall(t or "")]]
    df = collections.Counter(x for _, _, s in sets for x in s)
    n = len(rows)
    weigh = lambda s: {x: (1 + math.log(c)) * (1 + damping * math.log(n / df[x]) / math.log(max(n, 2))) for x, c in s.items()}
    texts = {(i, t): weigh(s) for i, t, s in sets}
    parent, near = {i: i for i, _ in texts}, []

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = list(texts)
    for a in range(len(keys)):
        for b in range(a):
            x, y = texts[keys[a]], texts[keys[b]]
            both = sum(min(x[k], y[k]) for k in x.keys() & y.keys())
            j = both / (sum(x.values()) + sum(y.values()) - both) if x and y else 0.0
            if j >= threshold or keys[a][1] == keys[b][1]:
                p, q = root(keys[a][0]), root(keys[b][0])
                parent[max(p, q)] = min(p, q)
                near.append(j)
    return {i: root(i) for i, _ in texts}, near


@pytest.mark.parametrize("damping", [minhash.DAMPING, 1.0])
def test_near_duplicates_by_brute_force(spark, docs, damping):
    """Classes of the weighted measure itself, on the common corpus and on families with edits of all sizes, large groups of copies among them."""
    rng = random.Random(21)
    prose = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n)]
    rows = []
    for f in range(25):
        base = prose(rng.choice([20, 60, 150]))
        rows += [(None, " ".join(base))] * rng.choice([1, 1, 40])
        for _ in range(rng.randint(1, 8)):
            w = list(base)
            for p in rng.sample(range(len(w)), rng.randint(0, len(w) // 15)):
                w[p] = rng.choice(["other", f"new{f}", "".join(prose(1))])
            rows.append((None, " ".join(w)))
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    for table in (rows, [(i, t) for i, t, *_ in corpus()]):
        want, near = weighted_classes(table, damping)
        d = spark.createDataFrame(table, "doc_id long, text string").repartition(4)
        got = {-1 if r["doc_id"] is None else r["doc_id"]: -1 if r["class_id"] is None else r["class_id"] for r in minhash.near_duplicates(d, damping=damping).collect()}
        # A pair right at 0.8 is missed with probability 0.0008; none is here.
        assert got == want
    assert len(near) > 5


def test_exchange_in_two_hops(spark, docs, monkeypatch):
    """The same results where every chunk, bucket and blob is small, and rows in proportion to the keys."""
    direct = sorted(map(str, repeats.repeated_spans(docs, 50).collect()))
    classes = sorted(map(str, minhash.near_duplicates(docs).collect()))
    monkeypatch.setattr(chunks, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(chunks, "BUCKET_KEYS", 40)
    monkeypatch.setattr(chunks, "BLOB_KEYS", 16)
    monkeypatch.setattr(chunks, "partitions", lambda spark: 2)
    assert chunks.deal(docs, 0.2).stride > 1
    assert sorted(map(str, repeats.repeated_spans(docs, 50).collect())) == direct
    assert sorted(map(str, minhash.near_duplicates(docs).collect())) == classes
    sent = []
    for n in (1, 4):
        d = chunks.deal(spark.createDataFrame([(i, " ".join(f"{i}w{k}" for k in range(120))) for i in range(100 * n)], "doc_id long, text string"), 0.2)
        buckets, stride = d.buckets, d.stride

        def keys_of(key, t):
            k = np.unique(np.random.default_rng(key[0].as_py()).integers(0, 2**40, 600).astype(np.uint64))
            return chunks.parts_of(key[0].as_py(), k, np.ones(len(k)), buckets, stride)  # noqa: B023

        sent.append((d.chunks, d.rows.groupBy("chunk").applyInArrow(keys_of, chunks.PARTS).count()))
    # In proportion to the texts' bytes, which chunks count.
    assert sent[1][1] / sent[0][1] < 1.1 * sent[1][0] / sent[0][0]


def test_texts_without_ids_are_spread(spark):
    d = chunks.deal(spark.createDataFrame([(None, f"text {i} " * 50) for i in range(400)], "doc_id long, text string"), 0.2)
    assert d.rows.select("chunk").distinct().count() > d.chunks / 3


def test_near_duplicates_of_ids_with_several_texts(spark):
    w, v, u = ([f"{c}{i}" for i in range(200)] for c in "wvu")
    rows = [(1, w), (2, [*w[:197], "x"]), (2, v), (3, [*v[:196], "y", "z"]), (3, [*v[:196], "y", "z"]), (None, u), (None, v[:30]), (7, [*u, "t"]), (9, u[:20])]
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")
    got = [(r["doc_id"], r["class_id"], r["class_size"]) for r in minhash.near_duplicates(d).collect()]
    assert sorted(got, key=str) == sorted([(1, 1, 3), (2, 1, 3), (2, 1, 3), (3, 1, 3), (3, 1, 3), (None, None, 2), (None, None, 2), (7, None, 2), (9, 9, 1)], key=str)


def test_document_frequencies_count_exact_copies(spark, docs):
    """Against brute force, on a text with many copies, ids with several texts, and the corpus of the other tests."""
    w, v, u = (" ".join(f"{c}{i}" for i in range(30)) for c in "wvu")
    rows = [(i, w) for i in range(40)] + [(100 + i, f"{w} own{i}") for i in range(3)] + [(5, v), (60, v), (60, v), (61, v), (61, u), (61, u), (None, u), (70, u + " t"), (80, "")]
    for table in (spark.createDataFrame(rows, "doc_id long, text string").repartition(3), docs.select("doc_id", "text")):
        copies, d = chunks.exact_copies(table), chunks.deal(table, 0.2)
        got = {(r["doc_id"], r["uid"]): chunks.unsqueeze(r["df"], np.uint32).tolist() for r in minhash.signatures(d, copies, minhash.DAMPING).collect()}
        sets, df = {}, defaultdict(int)
        for r in table.collect():
            b = (r["text"] or "").encode()
            k = minhash.sets_of(np.frombuffer(b, np.uint8), np.array([0, len(b)]))[0]
            sets[chunks.NULL_ID if r["doc_id"] is None else r["doc_id"], zlib.crc32(b)] = k
            for x in k.tolist():
                df[x] += 1
        assert got and all(got[x] == [df[k] for k in sets[x].tolist()] for x in got)
    assert max(df.values()) > 1


def test_buckets_of_several_components(spark, monkeypatch):
    """Every bucket holds all documents, in blocks of four: two large groups and strays, whose leader is a stray."""
    monkeypatch.setattr(minhash, "MEMBERS", 1)
    rng = random.Random(3)
    prose = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)]
    rows, family = [(0, " ".join(prose(40)))], {0: 0}
    for f, n in ((1, 25), (2, 14), (3, 1), (4, 2)):
        base = prose(200)
        for _ in range(n):
            i = len(rows)
            family[i] = f
            rows.append((i, " ".join([*base, f"own{i}"])))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(minhash, "signatures", lambda deal, copies, damping, real=minhash.signatures: real(deal, copies, damping).withColumn("bands", F.array(F.lit(1).cast("long"))))
    cls = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(d).collect()}
    assert cls == {i: min(j for j in family if family[j] == family[i]) for i in family}


def test_weighted_samples_agree_as_often_as_the_sets_are_similar():
    rng = np.random.default_rng(1)
    keys = np.sort(rng.integers(0, 2**63, 300).astype(np.uint64))
    wa, wb = rng.uniform(0.5, 3, 300).astype(np.float32), rng.uniform(0.5, 3, 300).astype(np.float32)
    a, b = np.sort(rng.choice(300, 240, False)), np.sort(rng.choice(300, 240, False))
    n = 2000
    x = minhash.samples(np.concatenate([keys[a], keys[b]]), np.concatenate([wa[a], wb[b]]), np.array([0, len(a)]), n)
    full = lambda at, w: np.bincount(at, w[at], 300)
    j = np.minimum(full(a, wa), full(b, wb)).sum() / np.maximum(full(a, wa), full(b, wb)).sum()
    assert abs((x[:, 0] == x[:, 1]).mean() - j) < 4 * (j * (1 - j) / n) ** 0.5


def test_shingles():
    texts = ["a b c d e f", "", "x", "  a b\tc d\ne f ", "f e d c b a", "aa b c d e"]
    raw = [t.encode() for t in texts]
    s, ends = shingles.shingles(*shingles.words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])))
    own = [s[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)]
    assert [len(x) for x in own] == [2, 0, 1, 2, 2, 1] and own[0] == own[3] and not set(own[0]) & set(own[4] + own[5])


def test_key_counts_pack():
    rng = np.random.default_rng(2)
    for n in (1, 10, 5000):
        k = np.unique(rng.integers(0, 2**40, n).astype(np.uint64))
        assert (chunks.unpack(chunks.pack(k)) == k).all()


def test_components(spark):
    links = [(i, i + 1) for i in range(20)] + [(50, 40), (40, 60), (70, 70)]
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(21)) and got[60] == got[50] == 40


def test_line_dedup(docs, empty):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(low)
    held = defaultdict(set)
    texts = [(-(2**63) if i is None else i, t) for i, t in plain(corpus())]
    for i, t in texts:
        for x in t.split("\n"):
            held[key(x)].add(i)
    want = []
    for i, t in texts:
        keep = [x for x in t.split("\n") if len(key(x)) < 20 or len(held[key(x)]) < 3 or i == max(held[key(x)])]
        want.append((i, "\n".join(keep), t.count("\n") + 1, t.count("\n") + 1 - len(keep)))
    out = lines.dedup_lines(docs)
    got = [(-(2**63) if r["doc_id"] is None else r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in out.collect()]
    assert sorted(got) == sorted(want) and sum(w[3] for w in want) > 3
    assert set(docs.columns) <= set(out.columns) and lines.dedup_lines(empty).count() == 0


@pytest.mark.parametrize("size", [1, 3])
def test_lines_in_small_batches(spark, docs, empty, size):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        test_line_dedup(docs, empty)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_line_of_every_document(spark):
    n = 3000
    d = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit(LINE + "\nown line number "), F.col("id").cast("string"), F.lit(" of this table\n" + LINE)).alias("text")).repartition(4)
    assert {(r["doc_id"], r["n_dropped"]) for r in lines.dedup_lines(d).filter("n_dropped < 2").collect()} == {(n - 1, 0)}


def test_topk(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(700, 8)).astype(np.float32)
    v[100:350] = v[100]
    rows = [(i, x.tolist(), "clash") for i, x in enumerate(v)]
    rows += [(1000, None, ""), (1001, [None] * 8, ""), (1100, [float("nan")] * 8, ""), (1200, [1.0] * 3, ""), (1201, [2.0] * 3, ""), (None, [1.0] * 8, "")]
    q = topk.quantize(spark.createDataFrame(rows, "id long, e array<float>, score string"), "id", "e")
    got = defaultdict(list)
    for r in sorted(topk.search(q.filter("vec_id % 100 = 0"), q, 10).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    m = np.floor(1024 * v.astype(float)).astype(np.int64)
    for x in range(0, 700, 100):
        s = m @ m[x]
        want = [(int(i), int(s[i])) for i in np.lexsort((np.arange(700), -s)) if i != x][:10]
        assert got[x] == want
    assert got[1200] == [(1201, 3 * 1024 * 2048)] and set(got) == {*range(0, 700, 100), 1200}
    assert topk.search(q.limit(0), q, 10).count() == 0 and topk.search(q, q.limit(0), 10).count() == 0


def test_pipeline_stages(spark, data):
    import corpus_pipeline as p

    from lodestack.llm.common import documents, materialize, table

    docs = documents(spark, data)
    stages = dict(p.STAGES)
    good = materialize(stages["quality rules"](spark, docs, data), "t")
    verdict = quality.judge(docs.select("doc_id", "text", "lang"), table(spark, data, "labels"))
    assert sorted(r[0] for r in good.select("doc_id").collect()) == sorted(r[0] for r in verdict.filter("kept").select("doc_id").collect())
    clean = materialize(stages["line dedup"](spark, good, data), "t")
    assert clean.columns == docs.columns and clean.filter("n_chars <> char_length(text)").isEmpty() and clean.count() == good.count()
    one = materialize(stages["minhash near-dedup"](spark, clean, data), "t")
    classes = minhash.near_duplicates(clean)
    assert one.count() == classes.select("class_id").distinct().count() == one.select("doc_id").distinct().count()
    mixed = materialize(stages["source mixing"](spark, one, data), "t")
    taken = mixing.mix(one, mixing.cycle_schedule(one, queries.CYCLE)).agg(F.sum("copies")).first()[0]
    assert mixed.count() == taken and mixed.columns == docs.columns
    out = stages["sentencepiece encoding"](spark, mixed, data)
    assert out.count() == taken and out.filter("n_tokens <> size(token_ids)").isEmpty()


def test_products_past_64_bits_are_an_error():
    big = np.full((1, 2), 2**31, np.int64)
    with pytest.raises(OverflowError):
        topk.product(big, big)
    assert topk.product(big - 1, np.full((1, 2), 2**30, np.int64))[0, 0] == 2**31 * (2**31 - 1)


@pytest.mark.parametrize("kind", ["empty", "null", "odd"])
def test_pipeline_stages_on_odd_tables(spark, data, docs, empty, kind):
    """Each stage by itself on an empty table, on rows of nulls alone, and on repeated rows with a long text and clashing columns."""
    import corpus_pipeline as p

    d = {"empty": empty, "null": spark.createDataFrame([(None,) * 8] * 3, SCHEMA), "odd": docs}[kind]
    rows, n = {}, d.count()
    for name, stage in p.STAGES[:-1]:
        out = common.materialize(stage(spark, d, data), "t")
        assert out.columns == d.columns, name
        rows[name] = out.collect()
    out = p.STAGES[-1][1](spark, d, data).collect()
    assert len(out) == n == len(rows["line dedup"])
    if kind == "empty":
        assert not any(rows.values())
    if kind == "null":
        assert not rows["quality rules"] and not rows["source mixing"] and len(rows["minhash near-dedup"]) == 3
        assert all(r["n_tokens"] == 0 and r["doc_id"] is None for r in out)
    if kind == "odd":
        kept = rows["minhash near-dedup"]
        long = next(r["text"] for r in docs.collect() if r["text"] and len(r["text"]) > 10_000)
        assert all(long in [r["text"] for r in rows[s]] for s in rows)
        assert 0 < len({r["doc_id"] for r in kept}) < len({r["doc_id"] for r in docs.collect()})
        assert {r["kept"] for r in kept} == {"z", None}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, data, name):
    import oracle

    assert oracle.differences(spark, oracle.connect(data), data, name, queries.QUERIES[name], queries.ORACLE_SQL[name]) == ""


def test_queries_give_one_row_per_document(spark, data):
    n = spark.read.parquet(f"{data}/documents.parquet").count()
    for name, f in queries.QUERIES.items():
        df = f(spark, data)
        if "doc_id" in df.columns:
            assert df.count() == n, name


@pytest.mark.parametrize("eod, width", [(50256, 2), (151643, 4), (2, 4), (32000, 2), (65279, 2)])
def test_token_files_of_any_end_id(spark, docs, tmp_path, eod, width):
    """End ids with bytes above 127 and tokens of 32 bits, over byte ranges that cut tokens and separators."""
    model, path = queries.tokenizer_path(), str(tmp_path / "files")
    sp = piece_codec.load(model)
    tokenfiles.write_token_files(docs, path, model, shard_tokens=3000, eod=eod, width=width)
    raw = b"".join(f.read_bytes() for f in tmp_path.rglob("kind=tokens/*/part-*"))
    assert np.count_nonzero(np.frombuffer(raw, f"<u{width}") == eod) == len(corpus())
    want = sorted((-1 if i is None else i, len(sp.encode(t))) for i, t in plain(corpus()))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for most in (old, "777b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", most)
            got = tokenfiles.token_counts(spark, path, eod, width).collect()
            assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"]) for r in got) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_end_ids_that_cannot_separate(docs, tmp_path):
    for eod, width in ((0x0202, 2), (0, 4), (1 << 16, 2), (5, 3)):
        with pytest.raises(ValueError, match="id"):
            tokenfiles.separator(eod, width)
    with pytest.raises(ValueError, match="stands for text"):
        tokenfiles.write_token_files(docs, str(tmp_path), queries.tokenizer_path(), eod=300)


def test_topk_of_large_components(spark):
    """Products near the ends of 64 bits are exact, the one that passes them is an error, and so is a component that does."""
    rng, big = random.Random(9), 2_000_000_000
    rows = [(i, [rng.choice([-1, 1]) * rng.randint(0, big) for _ in range(2)]) for i in range(0, 60)] + [(100, [4_096_000_000, 1]), (200, [big, big]), (300, [-big, big]), (301, [-big, -2_600_000_000])]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = topk.search(df.filter("vec_id % 100 = 0"), df, 5).collect()
    want = []
    for i, q in rows:
        if i % 100 == 0:
            best = sorted(((-sum(a * b for a, b in zip(q, c, strict=True)), j) for j, c in rows if j != i))[:5]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)
    vectors = spark.createDataFrame([(0, [4e6, 4e6]), (1, [4e6, -4e6])], "vec_id long, x array<double>")
    assert [tuple(r) for r in topk.search(topk.quantize(vectors, "vec_id", "x").filter("vec_id = 0"), topk.quantize(vectors, "vec_id", "x")).collect()] == [(0, 1, 1, 0)]
    over = spark.createDataFrame([(0, [2**40]), (1, [2**40])], "vec_id long, v array<long>")
    with pytest.raises(Exception, match="passes 64 bits"):
        topk.search(over, over).collect()
    with pytest.raises(Exception, match="component out of 64 bits"):
        topk.quantize(spark.createDataFrame([(0, [1e300])], "vec_id long, x array<double>"), "vec_id", "x").collect()
