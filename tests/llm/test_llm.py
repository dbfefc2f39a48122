"""The training-data operators against SQL, brute force, round trips and held-out accuracy."""

from __future__ import annotations

import base64
import hashlib
import io
import random
import re
import struct
import wave
import zipfile
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessella.llm import byte_bpe, exact_dedup, line_dedup, media, minhash, mixing, queries, token_counts, toxicity, url_filter, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "wörd " * 20_000 + "x" * 30_000
ODD_TEXTS = [
    None, "", " ", "a", "a", "A  b\tc\n", "a b c", LONG, "Zeile eins ist lang genug hier\nZeile zwei ist auch lang genug\n\n  zeile EINS ist lang genug hier ",
    "<s> </s> <unk> <|endoftext|>", "🙂🙂 ▁▁ x▁y", "\x85\x1c\u2028 tail \u3000", "don't we'll 123abc  $$$ ###\n\n\n   end", "GIF89a BM %PDF-1.4 PK\x03\x04", "\x00\x01", "you idiot, you pathetic moron! trash",
]


def odd_documents(spark, texts=ODD_TEXTS):
    rows = [(i, t, "en", None if i % 4 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [(None, "null id", None, "s1", 7), rows[5], rows[5]]
    wide = spark.createDataFrame(rows, DOCS)
    for name in ("size", "salt", "key", "hash", "target", "rank", "body", "features", "score", "row", "pos", "digest", "bands", "rep", "label"):
        wide = wide.withColumn(name, F.lit("clash"))
    return wide


def empty_documents(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect() if r["doc_id"] is not None}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, name):
    found = queries.QUERIES[name](spark, sf).toPandas()
    with duckdb.connect() as db:
        for t in ("documents", "pages", "labels", "embeddings"):
            db.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
        wanted = db.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    rows = lambda p: sorted(map(repr, p[sorted(p.columns)].astype(object).where(p[sorted(p.columns)].notna(), None).itertuples(index=False, name=None)))
    plain = lambda rs: [re.sub(r"(\d+)\.0\b", r"\1", r) for r in rs]
    assert plain(rows(found)) == plain(rows(wanted))


# mixing


def brute_targets(sizes, weights=(3, 1, 2)):
    """Sources in order -> target, by giving out what is above the limits again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        target = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if target[s] > 2 * sizes[s]]
        if not over:
            return fixed | target
        fixed |= {s: 2 * sizes[s] for s in over}


def test_mix_targets_and_budgets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    hot = docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.col("source")))
    rows = mixing.mix_sources(hot).collect()
    sizes, taken, targets = Counter(), Counter(), {}
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        targets[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    wanted = brute_targets(sizes)
    for s in sizes:
        assert targets[s] == pytest.approx(wanted[s])
        assert taken[s] == int(targets[s])
    assert sorted(rows) == sorted(mixing.mix_sources(hot.repartition(5)).collect())


def test_mix_odd_rows(spark):
    found = mixing.mix_sources(odd_documents(spark))
    assert found.count() == len(ODD_TEXTS) + 3
    for r in found.collect():
        assert r["taken"] <= 2 * r["size"]
        if r["doc_id"] is not None and r["doc_id"] < len(ODD_TEXTS):
            assert r["size"] == len(re.findall(r"[^\x20\x09-\x0d]+", ODD_TEXTS[r["doc_id"]] or ""))
    assert mixing.mix_sources(empty_documents(spark)).count() == 0
    assert mixing.mixed_documents(odd_documents(spark)).columns == odd_documents(spark).columns


def test_mixed_documents_keep_rows_without_or_with_the_same_id(spark):
    rows = [(None, "a b c", "en", "s1", 5), (None, "d e", "en", "s1", 3), (7, "f g h", "en", "s1", 5), (7, "i j", "en", None, 3), (8, "k", "en", None, 1), (8, "k", "en", None, 1), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    once = Counter(r["text"] for r in mixing.mixed_documents(docs, weights=(1, 1, 1), share=1.0, most=1).collect())
    assert once == Counter(r[1] for r in rows)
    twice = Counter(r["text"] for r in mixing.mixed_documents(docs, weights=(1, 1, 1), share=2.0, most=2).collect())
    assert twice == Counter(r[1] for r in rows) + Counter(r[1] for r in rows if r[1])


def test_mixed_documents_come_near_the_targets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    longest = docs.select(mixing.word_count("text").alias("n")).agg(F.max("n")).first()[0]
    got = {r["source"]: r["n"] for r in mixing.mixed_documents(docs).groupBy("source").agg(F.sum(mixing.word_count("text")).alias("n")).collect()}
    for r in mixing.mix_sources(docs).groupBy("source").agg(F.first("target").alias("t")).collect():
        assert abs(got.get(r["source"], 0) - r["t"]) <= longest


# URL filters

URLS = [None, "", "no scheme", "http://", "HTTP://A.Org/x", "https://Example.ORG/es/1?q#f", "http://m.example.org/en/12", "http://x.com/fr/", "http://x.com/de", "http://x.com/de/9", "ftp://a.net?x://b.org/", "http://a.net#f", "http://badexample.org/es/1", "http://org/", "a://b://c.org/d", "http://u@h.com:80/fr/2"]


def brute_rule(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(r), r, v) for v, r in queries.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] * 2 + [(None, URLS[5])], "page_id long, url string").withColumn("host", F.lit(1))
    rows = url_filter.judge_urls(pages, queries.RULES).collect()
    assert len(rows) == 2 * len(URLS) + 1
    for r in rows:
        host, path, rule, verdict = brute_rule(URLS[5 if r["page_id"] is None else r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict or verdict is None and r["verdict"] in ("allow", "block")
    assert url_filter.judge_urls(pages.limit(0), queries.RULES).count() == 0


def test_url_templates_learn_from_labels(spark):
    rules = [("block", "h.net/shop/1"), ("allow", "h.net/blog/1"), ("allow", "h.net/news/1")]
    urls = [f"http://h.net/{a}/{n}.html" for a in ("shop", "blog", "news") for n in (*range(100, 140), 777)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = {r["page_id"]: r for r in url_filter.judge_urls(pages, rules).collect()}
    for i, u in enumerate(urls):
        if u.endswith("/777.html"):
            assert rows[i]["verdict"] == ("block" if "/shop/" in u else "allow"), u
    assert rows[0]["template"] == "shop/*" and rows[50]["template"] == "{blog|news}/*"


def judged(spark, rules, urls, **options):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    return {urls[r["page_id"]]: r for r in url_filter.judge_urls(pages, rules, **options).collect()}


def test_url_evidence_of_the_parent_domain(spark):
    rules = [("block", "bets.test/a/"), ("allow", "news.test/a/"), ("allow", "news.test/b/")]
    urls = [f"http://h{i}.{d}.test/{s}/{w}" for d in ("bets", "news") for i in range(6) for s in ("a", "b") for w in "xyz"] + ["http://m.casino-win.bets.test/q", "http://quiet.news.test/q", "http://bets.test/", "http://elsewhere.org/q"]
    found = judged(spark, rules, urls)
    assert found["http://m.casino-win.bets.test/q"]["verdict"] == found["http://bets.test/"]["verdict"] == found["http://h3.bets.test/b/x"]["verdict"] == "block"
    assert found["http://quiet.news.test/q"]["verdict"] == found["http://elsewhere.org/q"]["verdict"] == "allow"


def test_url_branches_merge_pairwise_at_every_depth(spark):
    rules = [("block", f"h.net/x/y/z/u/v/w/q/{s}/b") for s in ("ad", "promo")] + [("allow", f"h.net/x/y/z/u/v/w/q/{s}/a") for s in ("docs", "help")] + [("allow", "h.net/x/y/z/u/v/w/q/promo/c")]
    start = "http://h.net/x/y/z/u/v/w/q"
    words = [f"{a}{b}" for a in "klmno" for b in "prstuv"]
    urls = [f"{start}/{s}/{k}{w}" for s, k in (("ad", "b"), ("promo", "b"), ("docs", "a"), ("help", "a"), ("promo", "c")) for w in words[: 2 if k == "c" else None]] + [f"{start}/ad/new", f"{start}/help/new", f"{start}/other/new"]
    found = judged(spark, rules, urls)
    assert found[f"{start}/ad/new"]["template"] == "x/y/z/u/v/w/q/{ad|promo}/*" and found[f"{start}/ad/new"]["verdict"] == "block"
    assert found[f"{start}/help/new"]["template"] == "x/y/z/u/v/w/q/{docs|help}/*" and found[f"{start}/help/new"]["verdict"] == "allow"
    assert found[f"{start}/other/new"]["template"] == "x/y/z/u/v/w/q/*/new"


def test_url_wildcards_below_wildcards(spark):
    names = [f"{a}{b}" for a in "klmnop" for b in "prstu"]
    found = judged(spark, [], [f"http://h.net/{n}/{m}" for n, m in zip(names, reversed(names), strict=True)] + ["http://h.net/" + "deep/" * 300])
    assert {r["template"] for u, r in found.items() if "deep" not in u} == {"*/*"}
    assert next(r for u, r in found.items() if "deep" in u)["template"] == "*/*" + "/deep" * 298


# media


def test_media_round_trip_and_wave_format(spark):
    docs = odd_documents(spark)
    stored = media.store_media(docs)
    found, files = by_id(media.media_features(stored)), by_id(stored)
    for i, text in enumerate(ODD_TEXTS):
        raw = (text or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        with wave.open(io.BytesIO(bytes(files[i]["media"]))) as w:
            assert w.readframes(w.getnframes()) == payload and w.getsampwidth() == 1
        r = found[i]
        assert (r["n_bytes"], r["payload_bytes"], r["media_bytes"], r["media_type"]) == (len(raw), len(payload), len(payload) + 44, "audio/wav")
        assert (r["payload_sha256"], r["tail_crc32"]) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r["media_sha256"] == hashlib.sha256(bytes(files[i]["media"])).hexdigest()
    assert found[3]["feature"] == found[4]["feature"]
    assert media.media_features(media.store_media(empty_documents(spark))).count() == 0


def png() -> bytes:
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 2, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0ab\0cd")) + chunk(b"IEND", b"")


def test_embedded_media_are_carved(spark):
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("a", "b")
    gif = b"GIF89a\x01\x00\x01\x00\x80\0\0" + bytes(6) + b",\0\0\0\0\1\0\1\0\0\x02\x02D\x01\0;"
    bmp = b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + bytes(4)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab" + b"\xff\xc0\x00\x04ab\xff\xda\x00\x04ab12\xff\xd9"
    gz = zlib.compressobj(wbits=31)
    gz = gz.compress(b"hello") + gz.flush()
    parts = [("image/png", png()), ("image/gif", gif), ("image/bmp", bmp), ("image/jpeg", jpeg), ("application/gzip", gz), ("application/zip", packed.getvalue())]
    whole = b"junk GIF89a junk" + b"--".join(p for _, p in parts)
    assert [(k, whole[a:b]) for k, a, b in media.sniff(whole)] == parts
    assert media.sniff(png()[:-1]) == [] and media.sniff(b"") == []
    broken = bytearray(png())
    broken[20] ^= 1
    assert media.sniff(bytes(broken)) == []
    rows = spark.createDataFrame([(1, bytearray(whole)), (2, None)], "doc_id long, media binary")
    assert [(r["media_type"], bytes(r["content"])) for r in media.carve(rows).orderBy("start").collect()] == parts


def flac(seed=3) -> bytes:
    """Two frames of four samples each, verbatim and constant, one channel of eight bits."""

    def crc(data, bits, poly):
        rest = 0
        for bit in "".join(f"{b:08b}" for b in data) + "0" * bits:
            rest = rest << 1 | int(bit)
            if rest >> bits:
                rest ^= 1 << bits | poly
        return rest

    def frame(number, sub):
        head = bytes([0xFF, 0xF8, 0x60, 0x02, number, 15])
        body = head + bytes([crc(head, 8, 7)]) + sub
        return body + struct.pack(">H", crc(body, 16, 0x8005))

    info = struct.pack(">HH", 16, 16) + bytes(6) + ((8000 << 44) | (7 << 36) | 32).to_bytes(8, "big") + bytes(16)
    return b"fLaC" + b"\x80\0\0\x22" + info + frame(0, b"\x02" + bytes(random.Random(seed).choices(range(256), k=16))) + frame(1, b"\0\x07")


def test_several_files_of_a_format_are_carved_apart():
    def packed(name, how):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", how) as z:
            z.writestr(name, name * 50)
            z.writestr("second", b"PK\x03\x04 inside")
        return out.getvalue()

    pdf = b"%PDF-1.4\n1 0 obj\nendobj\nstartxref\n9\n%%EOF"
    revised = pdf + b"\n2 0 obj\nendobj\nstartxref\n40\n%%EOF"
    for one, two, kind in ((packed("a", 0), packed("b", 8), "application/zip"), (pdf, revised, "application/pdf"), (flac(), flac(4), "audio/flac")):
        whole = b"before " + one + b" plain text between " + two + b" and after"
        assert [(k, whole[a:b]) for k, a, b in media.sniff(whole)] == [(kind, one), (kind, two)]
        assert [(k, whole[a:b]) for k, a, b in media.sniff(whole[: 7 + len(one) + 12])] == [(kind, one)]
    stream = io.BytesIO()

    class Unseekable(io.RawIOBase):
        writable = lambda self: True
        write = lambda self, b: stream.write(b)

    with zipfile.ZipFile(Unseekable(), "w") as z:  # sizes behind the data
        z.writestr("a", b"stored")
        z.writestr("b", b"deflated " * 20, zipfile.ZIP_DEFLATED)
    whole = b"x" + stream.getvalue() + b"y"
    assert [(k, whole[a:b]) for k, a, b in media.sniff(whole)] == [("application/zip", stream.getvalue())]
    broken = bytearray(flac())
    broken[-4] ^= 1
    assert media.sniff(bytes(broken)) == []


def test_sniffing_many_candidates_is_linear():
    import time

    def seconds(data):
        start = time.perf_counter()
        media.sniff(data)
        return time.perf_counter() - start

    local = struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 20, 0, 0, 0, 0, 0, 0, 0, 0, 0)
    open_ = struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 20, 8, 0, 0, 0, 0, 0, 0, 0, 0)
    for part in (b"%PDF-1.4 ", local, open_, b"\xff\xd8\xff\xc0\x00\x04ab\xff\xda\x00\x04ab", b"\x1f\x8b\x08\0" + bytes(20), b"fLaC"):
        short, long = seconds(part * 4_000), seconds(part * 40_000)
        assert long < 60 * short + 1, part


def test_declared_types_are_corrected(spark):
    rows = [(1, "text/plain", bytearray(png())), (2, "image/png", bytearray(png())), (3, "image/gif", bytearray(b"nothing")), (4, "audio/wav", None), (5, None, bytearray(png() + b"tail")), (6, "a", bytearray(b""))]
    found = {r["doc_id"]: tuple(r)[1:] for r in media.corrected_types(spark.createDataFrame(rows, "doc_id long, declared_type string, media binary")).collect()}
    assert found == {1: ("text/plain", "image/png", True), 2: ("image/png", "image/png", False), 3: ("image/gif", "image/gif", False), 4: ("audio/wav", "audio/wav", False), 5: (None, "image/png", True), 6: ("a", "a", False)}


# toxicity


def test_toxicity_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    toxic, clean = [r["score"] for r in rows if r["toxic"]], [r["score"] for r in rows if not r["toxic"]]
    assert np.mean(np.array(toxic) >= 0.5) > 0.88 and np.mean(np.array(clean) < 0.5) > 0.98
    assert np.mean([[(a > b) + 0.5 * (a == b) for b in clean] for a in toxic]) > 0.8


def test_toxicity_features():
    at = toxicity.FEATURES.index
    clean, plain = toxicity.features("They saw the old castle on a hill."), toxicity.features("You idiot! You are a pathetic MORON.")
    assert clean[at("lexicon")] == clean[at("disguised")] == 0 < plain[at("lexicon")] and plain[at("near_second_person")] > 0
    for text in ("what an 1d10t", "i d i o t there", "st*pid one", "stuuupid one", "l.o.s.e.r spotted", "m0r0n!"):
        assert toxicity.features(text)[at("disguised")] > 0, text
    assert toxicity.features("") == [0.0] * len(toxicity.FEATURES)


def test_toxicity_features_without_length_switches():
    at = toxicity.FEATURES.index
    long = "supercalifragilisticexpialidocious" * 3
    lexicon = toxicity.Lexicon({long.encode() + b" ": 5.0})
    for text in (f"what {long.replace('o', '0')} is", f"{long[:40]}*{long[41:]} there", f"{long} you"):
        assert toxicity.features(text, lexicon)[at("disguised")] + toxicity.features(text, lexicon)[at("learnt_strong")] > 0, text[:50]


def test_toxicity_features_against_plain_counting():
    lexicon = toxicity.Lexicon({b"vequ": 4.0, b"plonk ": 3.0, b"and ": 0.6})
    text = "You plonk AND plonk, vequoir!! 12 é\nvequ and you see nothing idiot"
    words = re.sub(r"[!-/:-@\[-`{-~]", " ", text).replace("AND", "and").replace("You", "you").split()
    plain = dict(zip(toxicity.FEATURES, toxicity.features(text, lexicon), strict=True))
    assert plain["log_words"] == pytest.approx(np.log(len(words) + 1))
    assert plain["lexicon"] == pytest.approx(100 * words.count("idiot") / len(words))
    assert plain["learnt_strong"] == pytest.approx(100 * (words.count("plonk") + sum(w.startswith("vequ") for w in words)) / len(words))
    assert plain["learnt_weak"] == pytest.approx(100 * words.count("and") / len(words)) and plain["learnt_middle"] == 0 and plain["learnt_most"] == 4.0
    you = [i for i, w in enumerate(words) if w == "you"]
    bad = [i for i, w in enumerate(words) if w in ("idiot", "plonk") or w.startswith("vequ")]
    assert plain["near_second_person"] == pytest.approx(100 * sum(min(abs(i - j) for j in you) <= toxicity.NEAR for i in bad) / len(words))
    assert plain["distinct_lexicon"] == 1 and plain["learnt_distinct"] == 4 and plain["exclamation"] == 2 / len(text.encode())
    assert plain["repetition"] == pytest.approx(1 - len(set(words)) / len(words)) and plain["capitals"] == pytest.approx(4 / sum(c.isascii() and c.isalpha() for c in text))


def test_toxicity_lexicon_is_learnt(spark):
    rows = [(i, f"zorbula{i % 7} word{i % 5} stays" if i % 4 == 0 else f"calm word{i % 5} stays", float(i % 4 == 0), i % 3 + 1) for i in range(240)]
    found = toxicity.learn_lexicons(spark.createDataFrame(rows, "doc_id long, text string, label double, fold int"))
    assert set(found) == {0, 1, 2, 3}
    for lexicon in found.values():
        assert lexicon.learnt[b"zorbula"] >= toxicity.WEIGHT_BANDS[-1] and b"word1 " not in lexicon.learnt and b"calm " not in lexicon.learnt
    n = sum(r[2] for r in rows)
    weight = np.log((n + 0.5) / (n + 1)) - np.log(0.5 / (240 - n + 1)) - toxicity.DOUBT * np.sqrt(1 / (n + 0.5) + 1 / 0.5)
    assert found[0].learnt[b"zorbula"] == pytest.approx(weight)


def test_toxicity_odd_rows(spark):
    docs = odd_documents(spark)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.toxicity(docs, none).collect()} == {0.0}
    some = spark.createDataFrame([(i, int(i == 15)) for i in range(16)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    assert toxicity.toxicity(docs, some).count() == docs.count()
    assert toxicity.toxicity(empty_documents(spark), some).count() == 0
    assert toxicity.without_toxic(docs, none).columns == docs.columns


# exact dedup


def test_exact_dedup_against_brute_force(spark):
    docs = odd_documents(spark)
    groups = defaultdict(list)
    for r in docs.collect():
        groups[re.sub(r"[\x20\x09-\x0d]+", " ", r["text"] or "")].append(r["doc_id"])
    wanted = {}
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        wanted |= {i: (keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids}
    rows = exact_dedup.exact_dedup(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert tuple(r)[1:] == wanted[r["doc_id"]]
    kept = exact_dedup.exact_distinct(docs)
    assert kept.columns == docs.columns
    assert exact_dedup.exact_dedup(empty_documents(spark)).count() == 0


def test_exact_dedup_of_texts_that_share_a_digest(spark, monkeypatch):
    """A digest of one character stands in for SHA-256: the whole texts must keep classes apart."""
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, bits: F.substring(F.md5(c), 1, 1))
    docs = spark.createDataFrame([(i, f"text {i % 40}", i) for i in range(120)] + [(None, "text 1", 0)], "doc_id long, text string, own_body int")
    for r in exact_dedup.exact_dedup(docs).collect():
        i = 1 if r["doc_id"] is None else r["doc_id"] % 40
        assert (r["keep_id"], r["group_size"]) == (i, 3 + (i == 1))
    assert sorted(r["doc_id"] for r in exact_dedup.exact_distinct(docs).collect()) == list(range(40))


def test_exact_dedup_hot_text(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 1, "same  text").otherwise(F.concat(F.lit("t"), "id")).alias("text")).repartition(40)
    rows = exact_dedup.exact_dedup(docs).where("group_size > 1").collect()
    assert len(rows) == 1000 and {(r["keep_id"], r["group_size"]) for r in rows} == {(1, 1000)} and sum(r["kept"] for r in rows) == 1


# line dedup


def brute_lines(docs, least_chars=20, least_docs=3):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\v\f\r"))
    held = defaultdict(set)
    for i, t in docs:
        for x in t.split("\n"):
            if len(key(x)) >= least_chars and i is not None:
                held[key(x)].add(i)
    gone = {k: max(s) for k, s in held.items() if len(s) >= least_docs}
    return {i: "\n".join(x for x in t.split("\n") if i is None or gone.get(key(x), i) == i) for i, t in docs}


def test_line_dedup_against_brute_force(spark):
    line = "This LINE is long enough to count"
    texts = [*ODD_TEXTS, f"{line}\na\n {line.lower()}\t\n{line}", f"x\n{line}", f"{line}\n{line}", "short\nshort", f"\n\n{line}\n", "ÄÖÜ ist kein ascii und lang", "äöü ist kein ascii und lang"]
    docs = odd_documents(spark, texts)
    wanted = brute_lines([(r["doc_id"], r["text"] or "") for r in docs.collect()])
    for r in line_dedup.line_dedup(docs).collect():
        text = "null id" if r["doc_id"] is None else texts[r["doc_id"]] or ""
        assert r["kept_text"] == wanted[r["doc_id"]]
        assert r["n_lines"] == text.count("\n") + 1 and r["n_dropped"] == r["n_lines"] - (wanted[r["doc_id"]].count("\n") + 1 if wanted[r["doc_id"]] or r["n_dropped"] < r["n_lines"] else 0)
    assert line_dedup.line_dedup(empty_documents(spark)).count() == 0


def test_line_dedup_rows_that_repeat_an_id(spark):
    line = "a line that is long enough to count"
    rows = [(1, f"{line}\nkeep A"), (1, f"keep B\n{line}"), (2, line), (3, f"x\n{line}\n{line}\ny"), (4, line), (None, line), (1, f"{line}\nkeep A")]
    out = sorted(((r["doc_id"] or 0, r["n_lines"], r["n_dropped"], r["kept_text"]) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert out == sorted([(1, 2, 1, "keep A"), (1, 2, 1, "keep B"), (1, 2, 1, "keep A"), (2, 1, 1, ""), (3, 4, 2, "x\ny"), (4, 1, 0, line), (0, 1, 0, line)])


# token counts


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)


@pytest.fixture(scope="module")
def counter():
    with open(queries.PIECES, "rb") as f:
        return token_counts.PrefixCounts(f.read())


def random_texts(n, seed):
    draw = random.Random(seed)
    letters = "abcdeehilnorstt  \n.,'ÄéñŒ▁🙂漢\t\x00\u200b0123"
    return ["".join(draw.choice(letters) for _ in range(draw.randint(0, 60))) for _ in range(n)]


def test_prefix_counts_are_exact(pieces, counter):
    for text in [*(t for t in ODD_TEXTS if t and len(t) < 1000), *random_texts(300, 7), "     a  b   ", "the quick brown fox", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"]:
        counts = token_counts.prefix_counts(counter.store(text))
        for i in range(1, len(text) + 1):
            assert counts[i] == len(pieces.encode(text[:i])), (text, i)


def test_token_counts_and_budgets(spark, sf, pieces):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    wanted = {r["doc_id"]: (len(r["text"].encode()), len(pieces.encode(r["text"]))) for r in docs.collect()}
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(docs, queries.PIECES).collect()} == wanted
    odd = odd_documents(spark)
    found = by_id(token_counts.cut_to_budget(token_counts.count_tokens(odd, queries.PIECES), 5))
    for i, t in enumerate(ODD_TEXTS):
        t = t or ""
        assert found[i]["n_tokens"] == len(pieces.encode(t))
        if len(t) < 1000:
            fitting = [k for k in range(len(t) + 1) if len(pieces.encode(t[:k])) <= 5]
            assert found[i]["fitting_chars"] == max(fitting)
    assert token_counts.count_tokens(empty_documents(spark), queries.PIECES).count() == 0


# byte-level BPE


@pytest.fixture(scope="module")
def library():
    import tiktoken

    with open(queries.BPE_RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def bpe():
    with open(queries.BPE_RANKS, "rb") as f:
        return byte_bpe.ByteBPE(f.read().splitlines(), public_tokenizers.PATTERN)


def test_bpe_equals_library(library, bpe):
    texts = [t or "" for t in ODD_TEXTS] + random_texts(500, 11) + ["".join(map(chr, range(a, a + 40))) for a in range(1, 0x3100, 40)] + ["ab" * 3000, " " * 5000 + "x"]
    for text, ids in zip(texts, bpe.encode_batch(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text), text[:80]
        assert bpe.decode(ids) == text.encode()


def test_bpe_cache_limits(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "KEPT_BYTES", 600)
    monkeypatch.setattr(byte_bpe, "LONG_TEXT", 90)
    monkeypatch.setattr(byte_bpe, "CHUNK", 7)
    with open(queries.BPE_RANKS, "rb") as f:
        small = byte_bpe.ByteBPE(f.read().splitlines(), public_tokenizers.PATTERN)
    for text in random_texts(60, 3):
        pair = [text, text + " again " + "q" * 100]
        assert [np.frombuffer(x, "<u4").tolist() for x in small.encode_batch(pair)] == [library.encode_ordinary(t) for t in pair]


def test_bpe_long_pieces(library, bpe):
    # Leaves of any piece that memory can hold fit 64 bits.
    assert int(bpe.none) * 2**46 < 2**63
    pieces = [b"a" * 150_001, bytes(random.Random(5).choices(b"aeinrst", k=60_001)), b"ab" * 20_000]
    for piece in pieces:
        assert bpe.merge([piece])[0].tolist() == library.encode_ordinary(piece.decode())
    for one, two in zip(bpe.merge(pieces[2:] * byte_bpe.SIDE_BY_SIDE), bpe.merge(pieces[2:]) * byte_bpe.SIDE_BY_SIDE, strict=True):
        assert one.tolist() == two.tolist()


def test_bpe_query(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in queries.op8_byte_bpe(spark, sf).collect():
        ids = np.array(library.encode_ordinary(texts[r["doc_id"]]), "<u4")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest())
    odd = by_id(queries.bpe_digests(odd_documents(spark)))
    for i, t in enumerate(ODD_TEXTS):
        assert odd[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert queries.bpe_digests(empty_documents(spark)).count() == 0
    apart = byte_bpe.decode(byte_bpe.encode(odd_documents(spark), queries.BPE_RANKS, public_tokenizers.PATTERN), queries.BPE_RANKS, public_tokenizers.PATTERN)
    assert {tuple(r) for r in apart.collect()} == {tuple(r) for r in byte_bpe.round_trip(odd_documents(spark), queries.BPE_RANKS, public_tokenizers.PATTERN).collect()}


# MinHash near-dedup


def plain_grams(text):
    """The five-word shingles of a text, by strings alone."""
    fold = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    words = [fold(w) for w in re.findall(r"[a-zA-Z0-9\x7f-\U0010ffff]+", text)] or re.findall(r"[^\x20\x09-\x0d]+", text)
    return [tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []


def plain_vector(text):
    return {g: 1 + np.log(n) for g, n in Counter(plain_grams(text)).items()}


def brute_classes(docs, threshold=minhash.THRESHOLD):
    """Classes from the weighted Jaccard similarity of all pairs, without anything of the module's."""
    vectors = {i: plain_vector(t) for i, t in docs.items()}
    total = {i: sum(v.values()) for i, v in vectors.items()}
    parent = {i: i for i in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(docs)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if min(total[a], total[b]) < threshold * max(total[a], total[b]) - 1e-9 or not total[a] or root(a) == root(b):
                continue
            u, v = vectors[a], vectors[b]
            low = sum(min(w, v[k]) for k, w in u.items() if k in v)
            if low / (total[a] + total[b] - low) >= threshold - 1e-9:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in ids}


def edited(words, n, draw):
    words = list(words)
    for _ in range(n):
        words[draw.randrange(len(words))] = f"w{draw.randrange(10**9)}"
    return " ".join(words)


def test_near_classes_against_brute_force(spark):
    draw = random.Random(5)
    docs = {}
    vocabulary = ["".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    for g in range(30):
        words = [draw.choice(vocabulary) for _ in range(draw.randint(60, 200))]
        for _ in range(draw.randint(1, 6)):
            docs[len(docs)] = edited(words, draw.choice([0, 1, 2, 3, 8]), draw)
    passage = " ".join(draw.choice(vocabulary) for _ in range(80))
    for g in range(60):  # a passage that many share, without being near copies
        docs[len(docs)] = passage + " " + " ".join(draw.choice(vocabulary) for _ in range(draw.randint(30, 60)))
    words = [draw.choice(vocabulary) for _ in range(150)]
    for g in range(60):  # a large group of near copies
        docs[len(docs)] = edited(words, 2, draw)
    docs |= {len(docs) + i: t for i, t in enumerate(["", "", "a b", "A, b!", "..."])}
    rows = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(7)
    found, wanted = {r["doc_id"]: r["class_id"] for r in minhash.near_classes(rows).collect()}, brute_classes(docs)
    assert {i: (c, wanted[i]) for i, c in found.items() if c != wanted[i]} == {}


def test_near_classes_of_a_large_chained_group(spark):
    """Members of large buckets that are near to one ordinary member each, and to no hub."""
    draw = random.Random(11)
    base = [f"b{i}" for i in range(400)]
    docs = {i: edited(base, 2, draw).split() for i in range(220)}
    for i in range(100):
        docs[len(docs)] = edited(docs[i], 7, draw).split()
    for i in range(220, 260):
        docs[len(docs)] = edited(docs[i], 7, draw).split()
    docs = {i: " ".join(words) for i, words in docs.items()}
    rows = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(7)
    found, wanted = {r["doc_id"]: r["class_id"] for r in minhash.near_classes(rows).collect()}, brute_classes(docs)
    assert {i: (c, wanted[i]) for i, c in found.items() if c != wanted[i]} == {}


def test_near_classes_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert {r["doc_id"]: r["class_id"] for r in minhash.near_classes(docs).collect()} == brute_classes({r["doc_id"]: r["text"] for r in docs.collect()})


def test_near_classes_of_passages_that_a_third_shares(spark):
    """Texts of one passage and words of their own, below the threshold, and chains among them above it."""
    draw = random.Random(17)
    passage = " ".join(f"p{i}" for i in range(150))
    docs = {i: passage + " " + " ".join(f"w{draw.randrange(10**9)}" for _ in range(draw.choice([20, 30, 45]))) for i in range(240)}
    for i in range(60):
        docs[len(docs)] = edited(docs[i * 3].split(), 5, draw)
    docs |= {len(docs) + i: " ".join(f"x{draw.randrange(10**9)}" for _ in range(100)) for i in range(200)}
    rows = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(7)
    found, wanted = {r["doc_id"]: r["class_id"] for r in minhash.near_classes(rows).collect()}, brute_classes(docs)
    assert {i: (c, wanted[i]) for i, c in found.items() if c != wanted[i]} == {}


def test_frequent_shingles_are_bounded(spark, monkeypatch):
    counts = [4] * 50 + [5] * 30 + [9] * 10 + [1500] * 5 + [5000] * 3
    counted = spark.createDataFrame([(i, n) for i, n in enumerate(counts)], "hash long, n long")
    for most in (1000, 60, 48, 20, 8, 4):
        monkeypatch.setattr(minhash, "MOST_FREQUENT", most)
        least = minhash.least_kept(counted)
        assert sum(n >= least for n in counts) <= most and (most < 1000 or least == minhash.FEWEST)
        assert sum(n >= least - 1 for n in counts) > most or least == minhash.FEWEST or least > 1024
    assert minhash.least_kept(counted.limit(0)) == minhash.FEWEST


def test_shingles_of_long_texts_do_not_depend_on_the_window(monkeypatch):
    texts = ["".join(random.Random(i).choices("ab c, D\n", k=400)) + "z" * 300 + " end of it all now" for i in range(20)] + ["y" * 500, " " * 300, ""]
    whole = [minhash.shingles(t) for t in texts]
    monkeypatch.setattr(minhash, "WINDOW", 37)
    for text, (hashes, counts) in zip(texts, whole, strict=True):
        again = minhash.shingles(text)
        assert again[0].tolist() == hashes.tolist() and again[1].tolist() == counts.tolist()
        assert sorted(counts.tolist()) == sorted(Counter(plain_grams(text)).values())


def test_document_frequencies_are_exact(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    df = Counter(x for r in docs.collect() for x in minhash.shingles(r["text"])[0].view(np.int64).tolist())
    found = {r["hash"]: r["n"] for r in minhash.frequent_shingles(docs.repartition(9), 10**6, fewest=2).collect()}
    assert found == {x: n for x, n in df.items() if n >= 2}


def test_samples_meet_with_the_weighted_similarity():
    draw = np.random.default_rng(1)
    sampler = minhash.Sampler(4000)
    hashes = np.sort(draw.integers(0, 1 << 63, 60, np.uint64) * np.uint64(2) + np.uint64(1))
    a, b = draw.choice([1.0, 2.0, 0.85, 5.0], 60), draw.choice([1.0, 2.0, 0.85, 3.0], 60)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    x, y = (sampler.sample(hashes, w, np.array([0]))[0] for w in (a, b))
    assert abs((x == y).mean() - true) < 0.04
    assert minhash.similarity((hashes, a), (hashes, b)) == pytest.approx(true)


def test_near_classes_odd_rows(spark):
    docs = odd_documents(spark)
    found = minhash.near_classes(docs)
    rows = found.collect()
    assert len(rows) == docs.count()
    classes = {r["doc_id"]: r["class_id"] for r in rows}
    assert classes[None] is None and classes[0] == 0 and classes[1] == 1 and classes[4] == 3 and classes[6] == 5
    assert minhash.near_classes(empty_documents(spark)).count() == 0
    assert minhash.near_distinct(docs).columns == docs.columns


def test_near_distinct_judges_each_row_by_its_own_text(spark):
    one, two = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, one), (2, one + " more"), (3, two), (3, one), (3, "alone with this id"), (None, two + " end"), (None, "no id and no copy"), (4, two), (4, two), (None, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = Counter(tuple(r) for r in minhash.near_distinct(docs).collect())
    assert kept == Counter([(1, one), (3, two), (3, "alone with this id"), (None, "no id and no copy"), (None, None), (5, "")])
    classes = Counter(tuple(r) for r in minhash.near_classes(docs).collect())
    assert classes == Counter([(1, 1), (2, 1), (3, 3), (3, 1), (3, 3), (None, 3), (None, None), (4, 3), (4, 3), (None, None), (5, 5)])


# WARC


def test_warc_round_trip(spark):
    body = "x" * 200
    rows = [(3, "http://a/1", body), (1, "http://a/2", body), (2, None, body), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (8, "u\r\nX: y", "ü" * 50), (9, "v", "ü" * 50), (None, "w", body), (1, "http://a/2", body)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    records = warc.archive_pages(pages).withColumn("bytes", warc.record_bytes()).withColumn("parsed", warc.parsed_record(F.col("bytes"))).collect()
    assert len(records) == len(rows)
    for r in records:
        head, _, block = bytes(r["bytes"]).partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        text = {i: (t or "").encode() for i, _, t in rows}[r["id"]]
        first = {text: i for i, _, t in sorted(rows, key=lambda x: -(x[0] or 99)) if (t or "").encode() == text}[text]
        revisit = len(text) >= 100 and r["id"] != first
        http, _, body = block.partition(b"\r\n\r\n")
        assert http.startswith(b"HTTP/1.1 200 OK\r\n") and f"Content-Length: {len(text)}".encode() in http
        assert r["payload_bytes"] == len(text) and r["payload_digest"] == hashlib.sha256(text).hexdigest() and (r["payload"] is None if revisit else bytes(r["payload"]) == text)
        assert fields.get("WARC-Profile") == (warc.REVISIT_PROFILE if revisit else None) and fields["Content-Type"] == "application/http;msgtype=response"
        assert fields.get("WARC-Target-URI") in (None, "u%0D%0AX: y", *(u for _, u, _ in rows))
        assert (r["parsed"]["header"] + r["parsed"]["http"]).encode() + bytes(r["parsed"]["body"]) + b"\r\n\r\n" == bytes(r["bytes"])
        assert fields["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(text).hexdigest()
        assert fields["WARC-Type"] == ("revisit" if revisit else "response") and fields.get("WARC-Refers-To") == (f"<urn:record:{first}>" if revisit else None)
        assert body == (b"" if revisit else text) + b"\r\n\r\n" and int(fields["Content-Length"]) == len(http) + 4 + (0 if revisit else len(text)) and "X" not in fields
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_warc_damage_is_noticed(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "x" * 200)], "page_id long, url string, html string")
    path = str(tmp_path / "archive")
    warc.write_archive(pages, path)
    spark.read.parquet(f"{path}/payloads").withColumn("payload", F.lit(b"other")).write.mode("append").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="does not have digest"):
        warc.read_archive(spark, path).select("payload").collect()


# the pipeline


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scores = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, labels).collect()}
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    stages = dict(corpus_pipeline.STAGES)
    calm = stages["toxicity"](spark, docs, sf)
    assert calm.columns == docs.columns and ids(calm) == sorted(i for i, s in scores.items() if s < 0.5)
    single = stages["exact_dedup"](spark, calm, sf)
    texts = {r["doc_id"]: re.sub(r"[\x20\x09-\x0d]+", " ", r["text"]) for r in calm.collect()}
    assert single.columns == docs.columns and ids(single) == sorted({t: i for i, t in sorted(texts.items(), reverse=True)}.values())
    apart = stages["minhash_near_dedup"](spark, single, sf)
    assert apart.columns == docs.columns and ids(apart) == sorted(set(brute_classes({r["doc_id"]: r["text"] for r in single.collect()}).values()))
    mixed = stages["mix_sources"](spark, apart, sf)
    plan = {r["doc_id"]: (2 * r["taken"] + r["size"]) // (2 * r["size"]) if r["size"] else 1 for r in mixing.mix_sources(apart).collect()}
    assert mixed.columns == docs.columns and Counter(ids(mixed)) == Counter({i: n for i, n in plan.items() if n})
    assert ids(stages["byte_bpe"](spark, mixed, sf)) == ids(mixed)
    assert ids(corpus_pipeline.run(spark, sf)) == ids(mixed)
