"""License scans, fill-in-middle and hard negatives against brute force, and what must not grow faster than the input."""

from __future__ import annotations

import hashlib
import random
import re
import struct
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from tessella.llm import fill_middle, hard_negatives, licenses, media, minhash, url_filter
from tests.llm.test_llm import empty_documents, odd_documents

# license scans

LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_scan(text):
    """words, places of phrases by label, all labels and the score, by looking at every place."""
    words = LICENSE_WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    base, labels, score = [], set(), 0.0
    for label, phrase in licenses.PHRASES:
        p = phrase.split()
        base += [(label, i) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        # a phrase's grams that stand there without the others
        for i in range(len(words) - 1):
            hits = {k for k in range(len(p) - 1) if words[i : i + 2] == p[k : k + 2]}
            score = max([score, *(2 / len(p) for _ in hits)])
    for label, notice in licenses.NOTICES:
        n, lines = notice.split(), {}
        for i in range(len(words) - 2):
            for k in range(len(n) - 2):
                if words[i : i + 3] == n[k : k + 3]:
                    lines.setdefault(i - k, set()).add(k)
        groups: list[list[int]] = []
        for d in sorted(lines):
            groups[-1].append(d) if groups and d - groups[-1][-1] <= 3 else groups.append([d])
        for g in groups:
            covered = lambda ks: len({k + j for k in ks for j in range(3)})
            first, end = min(d + min(lines[d]) for d in g), max(d + max(lines[d]) + 3 for d in g)
            share = (covered(set().union(*(lines[d] for d in g))) if end - first <= 2 * len(n) else max(covered(lines[d]) for d in g)) / len(n)
            score = max(score, share)
            if share >= 0.8:
                labels.add(label)
    own = sorted({x for x, _ in base})
    starts = [i for _, i in base]
    return len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(own), ",".join(sorted(labels | set(own))), pytest.approx(1.0 if base else score)


def license_rows(df):
    return [tuple(r)[1:] for r in df.orderBy("doc_id").collect()]


def test_licenses_against_every_place(spark):
    notice = licenses.NOTICES[2][1].split()
    rng = random.Random(4)
    texts = [
        "Released under the MIT License.", "the MIT$$$ Licénse mit LICENSE mit license", "Licensed under CC BY-NC 4.0.", "licensed under cc by sa 4 0", "General Public General Public License",
        " ".join(notice[:14] + ["indeed", "really"] + notice[14:]), " ".join(notice[:10]), "licensed under cc " * 50 + "licensed under cc by nc 4 0", " ".join(["licensed under cc by 4 0"] * 30),
        "This work is licensed under the GNU General Public License, version 3.", "mit", "", None, "x " * 30_000 + "Apache License", "apache license apache\x7flicense",
    ]
    vocabulary = "licensed under the mit license apache cc by nc 4 0 general public work is this released version".split()
    texts += [" ".join(rng.choices(vocabulary, k=rng.randint(0, 60))) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert license_rows(licenses.scan_licenses(docs)) == [plain_scan(t) for t in texts]


def test_license_spans_say_where(spark):
    docs = spark.createDataFrame([(1, "one two Released under the MIT License here")], "doc_id long, text string")
    found = {(r["label"], r["phrase"], r["first"], r["end"]) for r in licenses.license_spans(docs).collect()}
    assert found == {("mit", True, 5, 7), ("mit", False, 2, 7), ("mit", False, 3, 7)}  # four words of five of another notice
    with pytest.raises(ValueError, match="needs 3 words"):
        licenses.scan_licenses(docs, notices=(("x", "two words"),))


def test_licenses_odd_rows(spark):
    docs = odd_documents(spark)
    found = licenses.scan_licenses(docs)
    assert sorted(map(str, (r["doc_id"] for r in found.collect()))) == sorted(map(str, (r["doc_id"] for r in docs.collect())))
    assert licenses.scan_licenses(empty_documents(spark)).count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "NestedLoop"))


# fill-in-middle


def plain_fill(doc_id, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = [int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("window", [7, fill_middle.WINDOW])
def test_fill_middle_scatter_against_slices(monkeypatch, window):
    monkeypatch.setattr(fill_middle, "WINDOW", window)
    rng = random.Random(window)
    for _ in range(400):
        texts = ["".join(rng.choices(["\n", "a", "é", "<", "P", ">", "🙂", "S", "<M", "M>", "<S>"], k=rng.choice([0, 1, 2, 5, 40]))) for _ in range(rng.randint(1, 6))]
        ids = [rng.randint(0, 10**6) for _ in texts]
        h = np.array([[int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)] for i in ids])
        rate = rng.choice([100, 50])
        found = fill_middle.transformed([t.encode() for t in texts], h, rate, 30)
        assert [(*f[:4], f[4].decode()) for f in found] == [plain_fill(i, t, rate, 30) for i, t in zip(ids, texts, strict=True)]
        assert fill_middle.restored([f[4] for f in found], [f[1] for f in found]) == [t.encode() for t in texts]


def test_fill_middle_rows(spark):
    docs = odd_documents(spark)
    out = fill_middle.fill_middle(docs)
    found = Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], bytes(r["output"]).decode()) for r in out.collect())
    assert found == Counter((r["doc_id"], *plain_fill(r["doc_id"], r["text"])) for r in docs.collect())
    again = out.select("doc_id", fill_middle.restored_text().cast("string").alias("text")).collect()
    assert Counter(tuple(r) for r in again) == Counter((r["doc_id"], r["text"] or "") for r in docs.collect())
    assert fill_middle.fill_middle(empty_documents(spark)).count() == 0
    with pytest.raises(ValueError, match="three marks"):
        fill_middle.restored([b"<P>a<S>b"], ["psm"])


# hard negatives


def plain_negatives(rows, least=80):
    """rows: (vec_id, vector, label); every pair is scored."""
    kept = []
    for n, (i, v, label) in enumerate(rows):
        if label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        kept.append((n, i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [int(np.floor(256 * float(x))) for x in v]))
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    last = lambda i: (i is None, i or 0)
    out = Counter()
    for _, a, label, v in kept:
        if a is None or a % 100:
            continue
        others = sorted(((-score(v, w), last(i), i, k) for _, i, k, w in kept if i != a), key=lambda x: x[:2])
        for s, _, p, _ in [x for x in others if x[3] == label][:5]:
            low = [(n, -t) for t, _, n, k in others if k != label and least * -s <= 100 * -t <= 100 * -s]
            out.update((a, p, rank, n, -s, t) for rank, (n, t) in enumerate(low[:5], 1))
    return out


def negatives_of(spark, rows, kind="float", **options):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").withColumns({})
    return Counter(tuple(r) for r in hard_negatives.hard_negatives(df.repartition(3), **options).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("size", [3, 64, 70])
def test_hard_negatives_against_all_pairs(spark, monkeypatch, size):
    monkeypatch.setattr(hard_negatives, "FIRST", 8)
    rng = np.random.default_rng(size)
    centers = rng.normal(0, 0.2, (6, size))
    rows = [(i * 10, (centers[i % 6] + rng.normal(0, 0.05, size)).astype(np.float32).tolist(), int(i % 4)) for i in range(260)]
    rows += [(i * 10 + 1, rows[3][1], i % 3) for i in range(60)]  # one vector many times: ties by id
    assert negatives_of(spark, rows) == plain_negatives(rows)


def test_hard_negatives_odd_rows(spark):
    good = [0.5, 0.25, -0.125]
    rows = [(0, good, 1), (1, good, 1), (2, good, 2), (3, None, 1), (4, [0.1, None, 0.2], 1), (5, [float("nan")] * 3, 1), (6, [float("inf"), 0.0, 0.0], 2), (None, good, 1), (None, good, 3), (8, good, None), (100, good, 1), (9, [], 1), (10, [0.5], 4), (11, [0.0] * 3, 5)]
    assert negatives_of(spark, rows) == plain_negatives(rows)
    large = [(0, [3e6, -1e6], 1), (1, [3e6, 1.0], 1), (2, [2.9e6, 5e5], 2), (3, [1e-30, 2.0], 2), (100, [1e6, 1e6], 2)]  # beyond 2**53
    assert negatives_of(spark, large, "double") == plain_negatives(large)
    assert negatives_of(spark, []) == Counter()
    twice = [(0, good, 1), (0, [0.5, 0.5, 0.5], 1), (1, good, 1), (2, good, 2)]
    assert sum(negatives_of(spark, twice).values()) == 2


def test_intervals_hold_every_score():
    rng = np.random.default_rng(1)
    for size in (1, 5, 64, 130):
        vectors = np.floor(256 * np.concatenate([rng.normal(0, 0.2, (300, size)), np.zeros((2, size)), rng.normal(0, 1e-3, (20, size)), rng.normal(0, 1e4, (20, size))]))
        stored = hard_negatives.encode(vectors)
        for q in vectors[[0, 5, 300, 310, 330]]:
            estimate, low, high = hard_negatives.Anchor(q).intervals(*stored)
            exact = vectors @ q
            assert (low <= exact).all() and (exact <= high).all() and (low <= estimate).all() and (estimate <= high).all()


def test_intervals_leave_few_rows_to_score():
    vectors = np.floor(256 * np.random.default_rng(2).normal(0, 0.15, (4000, 64)))
    stored = hard_negatives.encode(vectors)
    left = []
    for i in range(0, 4000, 400):
        _, _, high = hard_negatives.Anchor(vectors[i]).intervals(*stored)
        left.append((high >= np.sort(np.delete(vectors @ vectors[i], i))[-5]).mean())
    assert np.mean(left) < 0.35


# growth


def test_near_dedup_of_texts_of_shared_blocks_compares_few_pairs(spark, monkeypatch):
    rng, compared = random.Random(5), []
    blocks = [" ".join(f"w{b}x{rng.randint(0, 10**6)}" for _ in range(20)) for b in range(40)]
    pair_texts = minhash._pair_texts

    def counted(pairs, texts):
        pairs = minhash.persist(pairs, narrow=True)
        compared.append(pairs.count())
        return pair_texts(pairs, texts)

    monkeypatch.setattr(minhash, "_pair_texts", counted)
    for n in (300, 900):
        compared.clear()
        texts = [" ".join(blocks[b] for b in rng.sample(range(40), 26)) for _ in range(n)]
        texts[7] = texts[3] + " and a little more"
        found = minhash.near_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()
        assert [(r["doc_id"], r["class_id"]) for r in found if r["doc_id"] != r["class_id"]] == [(7, 3)]
        assert sum(compared) < 10 * n, compared


def test_long_bands_find_pairs_at_the_threshold():
    rng = np.random.default_rng(3)
    n, sampler = 400, [minhash.Sampler(minhash.LONG_AT_ONCE * minhash.LONG_ROWS, minhash._LONG_TABLE_BITS, minhash.SEED + 1 + k) for k in range(0, minhash.LONG_BANDS, minhash.LONG_AT_ONCE)]
    met = 0
    for _ in range(40):
        every = rng.integers(0, 1 << 63, n + 2 * (n // 8), np.uint64)
        pair = [np.sort(every[: n + n // 8]), np.sort(np.concatenate([every[:n], every[n + n // 8 :]]))]  # 0.8 alike
        keys = [np.concatenate([minhash.band_keys(s.sample(h, np.ones(len(h)), np.array([0])), minhash.LONG_ROWS, 16 * k)[0] for k, s in enumerate(sampler)]) for h in pair]
        met += bool(np.isin(*keys).any())
    assert met == 40


def crc8(b):
    out = 0
    for x in b:
        out = media._FLAC_HEADS[out ^ x]
    return out


def test_sniffing_a_megabyte_of_heads_is_quick():
    ihdr = b"\0\0\0\rIHDR" + bytes(13) + struct.pack(">I", zlib.crc32(b"IHDR" + bytes(13)))
    frame = bytes([0xFF, 0xF8, 0x10, 0, 0])
    frame += bytes([crc8(frame)])
    heads = {
        "ogg": b"OggS\0\0" + bytes(20) + b"\1\0", "flac": b"fLaC\x80\0\0\x22" + struct.pack(">HH", 16, 4096) + bytes(6) + (1000).to_bytes(8, "big") + bytes(16) + frame, "gif": b"GIF89a\1\0\1\0\0\0\0!\xfe\x05abcde",
        "png": b"\x89PNG\r\n\x1a\n" + ihdr + b"\0\1\0\0IDAT", "wav": b"RIFF" + struct.pack("<I", 36) + b"WAVEfmt " + struct.pack("<I", 16) + bytes(16) + b"LIST\0\0\0\0",
        "gzip": b"\x1f\x8b\x08" + bytes(8) + struct.pack("<HH", 18, 18 ^ 0xFFFF) + bytes(3), "zip": b"PK\3\4\x14\0\x08" + bytes(23) + b"PK\7\x08" + bytes(12), "jpeg": b"\xff\xd8\xff\xe0\0\x0a" + b"ab" * 4,
    }
    for kind, head in heads.items():
        took = []
        for size in (250_000, 1_000_000):
            start = time.perf_counter()
            media.sniff((head * (size // len(head) + 1))[:size])
            took.append(time.perf_counter() - start)
        assert took[1] < 5 and took[1] < 10 * took[0] + 1, (kind, took)


def test_sums_of_long_spans():
    data = random.Random(1).randbytes(200_000)
    seen = media._Seen(memoryview(data))
    for a, b in ((0, 200_000), (1, 199_999), (5_000, 5_001), (4_096, 150_000), (70_001, 170_003)):
        assert seen.crc32(a, b) == zlib.crc32(data[a:b])


def test_url_branches_do_not_chain(spark):
    """Shares of 0 to 5 in 5: neighbours are alike, the ends are not."""
    branches = [("h", "", "abcdef"[k], k, 5) for k in range(6)]
    df = spark.createDataFrame(branches, "host string, head string, segment string, bad long, labelled long")
    found = {r["segment"]: r["general"] for r in url_filter.merged_branches(df, 1.96, 5, 20).collect()}
    assert found == {"a": "{a|b}", "b": "{a|b}", "c": "{c|d}", "d": "{c|d}", "e": "{e|f}", "f": "{e|f}"}


def plain_groups(branches, z=1.96):
    def unlike(a, n, b, m):
        p = (a + b) / (n + m)
        return 0.0 if a / n == b / m else abs(a / n - b / m) / (p * (1 - p) * (1 / n + 1 / m)) ** 0.5

    groups = [(b, n, (b, n), (b, n), [s]) for s, b, n in sorted(branches, key=lambda x: (x[1] / x[2], x[0]))]
    while True:
        fit = [(unlike(*one[:2], *two[:2]), i) for i, (one, two) in enumerate(zip(groups, groups[1:], strict=False)) if unlike(*one[:2], *two[:2]) <= z and unlike(*one[2], *two[3]) <= z]
        if not fit:
            return {s: sorted(g[4]) for g in groups for s in g[4]}
        i = min(fit)[1]
        one, two = groups[i : i + 2]
        groups[i : i + 2] = [(one[0] + two[0], one[1] + two[1], one[2], two[3], one[4] + two[4])]


def test_url_branches_merge_the_most_alike_first(spark):
    rng = random.Random(9)
    nodes = {str(h): [(f"s{i}", rng.randint(0, n), n) for i in range(rng.randint(1, 20)) for n in [rng.randint(5, 60)]] for h in range(25)}
    df = spark.createDataFrame([(h, "", s, b, n) for h, bs in nodes.items() for s, b, n in bs], "host string, head string, segment string, bad long, labelled long")
    found = {(r["host"], r["segment"]): r["general"] for r in url_filter.merged_branches(df, 1.96, 5, 20).collect()}
    wanted = {(h, s): g[0] if len(g) == 1 else "{" + "|".join(g) + "}" for h, bs in nodes.items() for s, g in plain_groups(bs).items()}
    assert found == wanted


def test_deep_paths_take_a_round_for_each_parting(spark, monkeypatch):
    written = []
    persist = url_filter.persist
    monkeypatch.setattr(url_filter, "persist", lambda df, **o: written.append(1) or persist(df, **o))
    deep = "/".join("abcdefghijklmnopqrstuvwxyzabcdefghijklmno")
    urls = [(i, f"https://deep.example.org/{deep}/{'xy'[i % 2]}") for i in range(26)]
    rules = [("block", f"deep.example.org/{deep}/x"), ("allow", f"deep.example.org/{deep}/y")]
    found = url_filter.judge_urls(spark.createDataFrame(urls, "page_id long, url string"), rules).collect()
    assert {(r["verdict"], r["template"]) for r in found} == {("block", f"{deep}/x"), ("allow", f"{deep}/y")} and len(written) < 12
