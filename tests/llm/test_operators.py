"""Each operator against a brute-force version, over rows that hold nulls, copies, empty and long texts and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from docloom.llm import imatch, jaccard_trie, langid, licenses, mixing, ppm, quality_cnn, sentencepiece_codec, suffix_dedup, va_file
from docloom.llm.common import WRITTEN, crc_mod

PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, row string, i int, t string, rank int, n string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def corpus():
    r = random.Random(3)
    words = {"en": "the of and ing tion er re at on nd ly th".split(), "fr": "le la éau oui çois ent que ré èle un".split(), "de": "der und sch ä ung keit zu ein ich".split()}
    make = lambda lang, n: " ".join("".join(r.choice(words[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))
    passage = make("en", 90)
    texts = [("en", make("en", 150)) for _ in range(8)] + [("fr", make("fr", 120)) for _ in range(6)] + [("de", make("de", 90)) for _ in range(6)]
    texts += [("en", make("en", 30) + " " + passage + " " + make("en", 30)) for _ in range(3)]
    near = texts[0][1].split()
    texts += [("en", texts[0][1]), ("en", texts[0][1]), ("en", " ".join([*near[:-3], "new", "end", "here"])), ("en", " ".join(["new", *near[1:]]))]
    texts += [(None, None), ("en", ""), ("en", "  \n\t "), (None, "one Two"), ("en", "ONE two"), ("en", "x" * 3000), ("de", "é" * 900), ("en", "12 34 --"), ("fr", make("fr", 4000))]
    texts += [("en", "Under the MIT License. under the mit license"), ("en", "Licensed under the Apache License, Version 2.0"), ("en", "SPDX-License-Identifier: GPL-3.0-only cc by nc")]
    rows = [(k, t, lang, [None, "b", "a", "c"][k % 4], None if t is None else len(t), 1, "x", 2, "y", 3, "z") for k, (lang, t) in enumerate(texts)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def texts():
    return {r[0]: r[1] for r in corpus()}


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def got(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_ppm_is_the_definition(docs, texts, monkeypatch):
    monkeypatch.setattr(ppm, "FREQUENT", 20)
    rows = got(ppm.score(docs, crc_mod("doc_id", 5) != 1))
    train = [lower(t) for i, t in texts.items() if zlib.crc32(str(i).encode()) % 5 != 1]
    c, k = Counter(), ppm.ORDER
    for t in train:
        c.update([*WORD.findall(t), "\n"])
    n, v = sum(c.values()), len(c)
    ctx = [defaultdict(Counter) for _ in range(k + 1)]
    for t in train:
        b = bytes(k) + t.encode()
        for i in range(k, len(b)):
            for j in range(k + 1):
                ctx[j][b[i - j : i]][b[i]] += 1
    for i, t in texts.items():
        if t and len(t) > 5000:
            continue
        words = [*WORD.findall(lower(t)), "\n"]
        b, total = bytes(k) + lower(t).encode(), 0.0
        for p in range(k, len(b)):
            gone = set()
            for j in range(k, -1, -1):
                if not (here := ctx[j].get(b[p - j : p])):
                    continue
                left = {s: m for s, m in here.items() if s not in gone}
                if not left:
                    continue
                if b[p] in left:
                    total += math.log10(left[b[p]] / (sum(left.values()) + len(left)))
                    break
                total += math.log10(len(left) / (sum(left.values()) + len(left)))
                gone = set(here)
            else:
                total -= math.log10(256 - len(gone))
        r = rows[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(c[w] > 0 for w in words), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words))
        assert r.score == pytest.approx(total, rel=1e-4, abs=1e-6)


def test_ppm_scores_with_all_nodes(docs, monkeypatch):
    want = got(ppm.score(docs, crc_mod("doc_id", 5) != 1))
    monkeypatch.setattr(ppm, "NODES", 40)
    monkeypatch.setattr(ppm, "PIECE", 500)
    rows = got(ppm.score(docs, crc_mod("doc_id", 5) != 1))
    assert all(r.score == pytest.approx(want[i].score, rel=1e-5, abs=1e-6) for i, r in rows.items())


def test_ppm_leaves_no_node_out(spark):
    r = random.Random(6)
    letters = "".join(map(chr, range(0x21, 0x7F)))
    texts = ["".join(r.choices(letters, k=150_000)).lower() for _ in range(16)]
    rows = got(ppm.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), crc_mod("doc_id", 5) != 99))
    # Nearly every string of six bytes occurs once, after five bytes that occur once: a probability of 1/2.
    for i, t in enumerate(texts):
        assert rows[i].score == pytest.approx(-len(t) * math.log10(2), rel=0.02)


def test_ppm_edges(empty, docs):
    assert ppm.score(empty, crc_mod("doc_id", 5) != 1).collect() == []
    rows = ppm.score(docs.filter("doc_id < 3"), crc_mod("doc_id", 5) > 99).collect()
    assert all(r.n_known == 0 and r.base_score == pytest.approx(0) for r in rows)
    assert ppm.adaptive([None, "aaaa"])[0] == 0
    assert ppm.adaptive(["ab" * 50])[0] > ppm.adaptive(["abcdefghijklmnopqrstuvwxyz" * 4])[0]


def test_mixing(docs, empty, texts):
    rows = got(mixing.mix(docs))
    sizes = {i: len(WORD.findall(t or "")) for i, t in texts.items()}
    by = defaultdict(list)
    for r in corpus():
        by[r[3]].append(r[0])
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    own = {s: sum(sizes[i] for i in by[s]) for s in order}
    capped, total = {}, sum(own.values())
    while True:
        rest = {s: weight[s] for s in order if s not in capped}
        share = {s: (total - sum(capped.values())) * w / sum(rest.values()) for s, w in rest.items()}
        over = {s: 3.0 * own[s] for s in share if share[s] > 3 * own[s]}
        if not over:
            break
        capped |= over
    target = capped | share
    for s in order:
        for i in by[s]:
            assert (rows[i]["size"], rows[i].source_size) == (sizes[i], own[s])
            assert rows[i].target == pytest.approx(target[s])
            assert rows[i].taken in {k * sizes[i] for k in range(4)}
        taken = sum(rows[i].taken for i in by[s])
        assert abs(taken - target[s]) <= max(sizes[i] for i in by[s])
    assert got(mixing.mix(docs.repartition(5))) == rows
    copies = Counter(r.doc_id for r in mixing.mixed_documents(docs).collect())
    assert all(copies[i] == r.repeats for i, r in rows.items())
    assert mixing.mix(empty).collect() == [] and mixing.mixed_documents(empty).columns == docs.columns


def strings_removed(texts, length):
    count = Counter()
    raw = {i: (t or "").encode() for i, t in texts.items()}
    for b in raw.values():
        count.update(b[p : p + length] for p in range(len(b) - length + 1))
    out = {}
    for i, b in raw.items():
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            if count[b[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        kept = bytes(v for v, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("block", [5000, 1])
def test_suffix_dedup(docs, empty, texts, block, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    monkeypatch.setattr(suffix_dedup, "BROADCAST_ENTRIES", 500_000 if block > 1 else 0)
    rows = got(suffix_dedup.remove(docs, length=400))
    want = strings_removed(texts, 400)
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in rows.items()} == want
    if block > 1:
        kept = got(suffix_dedup.without_repeats(docs, length=400))
        assert all((r.text is None) == (texts[i] is None) and len(r.text or "") == (r.n_chars or 0) for i, r in kept.items())
        assert suffix_dedup.remove(empty).collect() == []


def test_shared_passages(spark):
    r = random.Random(14)
    make = lambda n: " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 9))) for _ in range(n))
    rows, size = [], {}
    for k in range(30):
        passage = make(52)
        for j in (0, 1):
            rows.append((2 * k + j, f"{make(r.randint(0, 200))} {passage} {make(r.randint(0, 200))}"))
            size[2 * k + j] = len(passage)
    line = make(12)
    rows += [(100 + k, f"{make(80)} {line} {make(80)}") for k in range(20)] + [(200, (make(60) + " ") * 2), (300, make(90)), (300, None), (None, "")]
    rows += [(400, rows[-3][1]), (None, rows[-3][1])]
    out = suffix_dedup.remove(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    for x in out:
        if x.doc_id in size:
            # The bytes next to a passage may agree by chance.
            assert x.longest_shared <= size[x.doc_id] + 12 and x.longest_shared >= (size[x.doc_id] >= 280) * suffix_dedup.MARK
        elif x.doc_id is not None and x.doc_id <= 200:
            assert x.longest_shared == 0
    assert sum(x.longest_shared > 0 for x in out if x.doc_id in size) > 0.9 * len(size)
    assert all(x.longest_shared > 200 for x in out if x.n_bytes > 400 and x.doc_id in (300, 400, None))


def passages_removed(texts, words):
    """What is left of each text without the runs of so many words that another has, by brute force."""
    at = [list(re.finditer(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for t in texts]
    grams = [[tuple(w.group() for w in m[p : p + words]) for p in range(len(m) - words + 1)] for m in at]
    count = Counter(g for one in grams for g in set(one))
    out = []
    for t, m, one in zip(texts, at, grams, strict=True):
        raw = (t or "").encode()
        gone = [False] * len(raw)
        for p, g in enumerate(one):
            if count[g] > 1:
                a, z = m[p].start(), m[p + words - 1].end()
                gone[a:z] = [True] * (z - a)
        out.append(bytes(v for v, g in zip(raw, gone, strict=True) if not g).decode())
    return out


def test_short_passages_go(spark):
    r = random.Random(21)
    make = lambda n: " ".join("".join(r.choices("abcdeé", k=r.randint(1, 5))) for _ in range(n))
    texts = []
    for k in range(40):
        passage = make(r.choice([49, 50, 51, 52, 75]))  # fewer than 400 bytes
        texts += [f"{make(r.randint(0, 90))} {passage} {make(r.randint(0, 90))}", f"{make(r.randint(0, 90))}\n{passage}\t{make(r.randint(0, 90))}"]
    own = make(55)
    texts += [f"{own} {make(9)} {own}", None, "", " \n ", make(60), make(51)]
    texts += [texts[-1], "a " * 80, "a " * 60, "b " * 70]
    docs = spark.createDataFrame([(k, t, len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, n_chars long").repartition(3)
    rows = got(corpus_pipeline.repeated_strings(spark, docs, ""))
    want = passages_removed(texts, 51)
    assert [rows[k].text or "" for k in range(len(texts))] == want
    assert sum(a != (t or "") for a, t in zip(want, texts, strict=True)) > 40 and want[80] == texts[80]
    assert all((rows[k].text is None) == (t is None) and (rows[k].n_chars or 0) == len(want[k]) for k, t in enumerate(texts))


def test_multikey_sort_is_lexicographic():
    r = np.random.default_rng(5)
    words = r.integers(0, 3, (500, 12)).astype(">u8")
    group = r.integers(0, 4, 500)
    order = suffix_dedup.multikey_sort(group, words)
    keys = [(group[i], *words[i]) for i in order]
    assert keys == sorted(keys)


def test_quality_network(spark, docs, empty):
    r = random.Random(1)
    good = lambda: " ".join(r.choice("the of and land sea".split()) for _ in range(r.randint(20, 300)))
    rows = [(k, good() if k % 3 else "!! ".join(good().upper().split())) for k in range(150)] + [(900, None), (901, ""), (902, "a" * 200_000)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(150)] + [(3, None, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    net = quality_cnn.fit(table, labels, crc_mod("doc_id", 5) != 0)
    out = got(quality_cnn.score(table, net))
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out.values())
    held = [k for k in range(150) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert sum((out[k].score >= 0.5) == (k % 3 > 0) for k in held) >= 0.95 * len(held)
    assert quality_cnn.score(empty, net).collect() == []
    none = quality_cnn.fit(empty, labels.limit(0), crc_mod("doc_id", 5) != 0)
    assert quality_cnn.score(docs, none).first().score == 0.5


def test_quality_network_is_the_definition():
    net = quality_cnn.Network(3)
    r = np.random.default_rng(3)
    w, step, chunk = quality_cnn.WIDTH, quality_cnn.STEP, quality_cnn.CHUNK
    for n in (0, 1, 127, 128, 129, 256, 300, 1000, 70_000):
        text = r.integers(0, 256, n).astype(np.uint8)
        whole = [*text.tolist(), *[0] * (max(chunk, -(-n // (chunk // 2)) * (chunk // 2)) - n + w)]
        features = []
        for a in range(0, len(whole) - w - chunk + 1, chunk // 2):
            conv = [sum(net.p["w"][j][whole[k + j]] for j in range(w)) for k in range(a, a + chunk, step)]
            features.append(np.maximum(np.max(conv, 0) + net.p["b"], 0))
        z = np.mean(features, 0) @ net.p["v"] + net.p["c"][0]
        assert net.score(text) == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-4)
        assert len(quality_cnn._chunks(text)) == len(features)


def test_quality_sample_is_bounded_by_bytes(spark):
    rows = [(k, ("good words here " if k % 2 else "BAD!! ") * 200) for k in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(None, 1)], "doc_id long, quality int")
    net = quality_cnn.fit(table, labels, crc_mod("doc_id", 5) != 0, most=40_000)
    out = got(quality_cnn.score(table, net))
    assert sum((out[k].score >= 0.5) == (k % 2 > 0) for k in range(60)) >= 55


def test_mixing_refines_until_one_document(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEVELS", 1)
    rows = [(k, "w " * (k % 7 + 1), "ab"[k % 10 == 0]) for k in range(20_000)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    for x in out.groupBy("source_size", "target").agg({"taken": "sum"}).collect():
        assert abs(x["sum(taken)"] - x.target) <= 7


def test_licenses(docs, empty, texts):
    rows = got(licenses.scan(docs))
    rules = licenses.rules()
    assert len(rules) > 200
    for i, t in texts.items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        at = [(k, label) for p, label in licenses.BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        norm = " " + " ".join(w) + " "
        found = []
        if any(g in norm for g in licenses.GATE):
            for n, (label, key, form, rank, _) in enumerate(rules):
                if " " + key in norm:
                    found += [(norm[: m.start()].count(" "), norm[: m.end()].count(" "), rank, n, label) for m in re.finditer(f" {form}(?= )", norm)]
        kept = [d for d in found if not any(o[0] <= d[0] and o[1] >= d[1] and o[2] >= d[2] and (o[1] - o[0] > d[1] - d[0] or o[2] > d[2] or o[3] < d[3]) for o in found)]
        base = {label for _, label in at}
        r = rows[i]
        assert (r.n_words, r.n_base) == (len(w), len(at))
        assert (r.first_word, r.last_word) == (min(at, default=(None,))[0], max(at, default=(None,))[0])
        assert r.base_labels == ",".join(sorted(base)) and r.labels == ",".join(sorted(base | {d[4] for d in kept}))
    assert licenses.scan(empty).collect() == []


def test_licenses_without_gates(spark):
    names = "open database|creative commons zero|common development and distribution|FreeBSD|0BSD|PSF|Creative Commons Attribution-NonCommercial-NoDerivs|BSD-3-Clause|Apache 2.0|GNU General Public|zlib"
    tags = "BSL-1.0 OFL-1.1 MS-PL MS-RL CPL-1.0 ODC-By-1.0 GFDL-1.3 GPL-2.0-only MIT-0 PSF-2.0 CC-BY-SA-4.0".split()
    texts = [f"{how} {name}." for name in names.split("|") for how in ("Licensed under", "Released under", "Distributed under the", "subject to the terms of")]
    texts += [f"SPDX-License-Identifier: {t}" for t in tags] + ["you can redistribute it and/or modify it under the terms of the GNU General Public License", "dedicated to the public domain", "cc by nc", "none here"]
    rows = got(licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    for i, t in enumerate(texts):
        norm = " " + " ".join(re.findall("[a-z0-9]+", t.lower())) + " "
        found = []
        for n, (label, _, form, rank, _) in enumerate(licenses.rules()):
            found += [(m.start(), m.end(), rank, n, label) for m in re.finditer(f" {form}(?= )", norm)]
        kept = [d for d in found if not any(o[0] <= d[0] and o[1] >= d[1] and o[2] >= d[2] and (o[1] - o[0] > d[1] - d[0] or o[2] > d[2] or o[3] < d[3]) for o in found)]
        base = {label for p, label in licenses.BASE if f" {p} " in norm}
        assert rows[i].labels == ",".join(sorted(base | {d[4] for d in kept})), t
        assert rows[i].labels or t == "none here"


def test_licenses_in_a_long_text(spark):
    """More detections than are compared directly, across blocks of words, equal those of the same text's parts."""
    r = random.Random(3)
    some = ["Licensed under the MIT License", "under Apache 2.0 license", "SPDX-License-Identifier: GPL-3.0-only", "all rights reserved", "cc by nc 4.0", "dedicated to the public domain"]
    parts = [" ".join([*(f"w{k}" for k in range(r.randint(70, 90))), r.choice(some)]) for _ in range(400)]
    out = got(licenses.scan(spark.createDataFrame([(0, " ".join(parts)), *enumerate(parts, 1), (None, None)], "doc_id long, text string")))
    want, at = [], 0
    for k, p in enumerate(parts, 1):
        want += [(s.label, s.first + at, s.stop + at) for s in out[k].spans]
        at += out[k].n_words
    assert sorted((s.label, s.first, s.stop) for s in out[0].spans) == sorted(want) and len(want) >= 400
    assert out[0].n_base == sum(out[k].n_base for k in range(1, 401)) and out[None].labels == ""


def test_sentencepiece_is_the_library(docs, empty, texts):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows, full = got(sentencepiece_codec.encode_digests(docs, PIECES)), got(sentencepiece_codec.encode(docs, PIECES))
    for i, t in texts.items():
        ids = model.encode(t or "")
        plain = model.decode(ids)
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(plain.encode()).hexdigest()
        assert (full[i].ids, full[i].decoded) == (ids, plain)
    assert sentencepiece_codec.encode_digests(empty, PIECES).collect() == []


def test_sentencepiece_on_odd_texts():
    codec = sentencepiece_codec.codec(PIECES)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    r = random.Random(7)
    letters = "abtheinon  \t\n é▁梦ß🙂1234.#*|ÀⅧx\x00"
    odd = ["".join(r.choice(letters) for _ in range(r.randint(0, 50))) for _ in range(500)]
    odd += ["x" + " " * k + "the" for k in range(0, 70, 7)] + [" " * k for k in range(0, 70, 7)] + ["a" * k for k in range(0, 300, 37)]
    for t in odd:
        ids = model.encode(t)
        assert codec.encode(t) == ids
        assert codec.decode(ids) == model.decode(ids)


def test_sentencepiece_neighbours(monkeypatch):
    codec = sentencepiece_codec.codec(PIECES)
    r = random.Random(8)
    reached = [p for p in codec.ids if codec.merge(p) == [p]]
    whole = [p for p in reached if len(p) > 1]
    pairs = [(r.choice(reached), r.choice(reached)) for _ in range(3000)]
    pairs += [(p[:k], p[k:]) for p in r.sample(whole, 3000) for k in (r.randint(1, len(p) - 1),) if codec.merge(p[:k]) == [p[:k]] and codec.merge(p[k:]) == [p[k:]]]
    pairs += [("▁" * a, "▁" * b) for a in (1, 2, 3, 4) for b in (1, 2, 3, 4) if {"▁" * a, "▁" * b} <= set(reached)]
    want = [codec.merge(a + b) == [a, b] for a, b in pairs]
    codec.clear()
    monkeypatch.setattr(codec, "merge", None)  # told by the pieces' own merges, not by merging each pair
    assert [codec.stands(a, b) for a, b in pairs] == want and {True, False} == set(want)
    codec.clear()


def test_sentencepiece_keeps_what_it_meets_again(monkeypatch):
    codec = sentencepiece_codec.codec(PIECES)
    codec.clear()
    monkeypatch.setattr(sentencepiece_codec, "CACHE", 20)
    found, encode = Counter(), codec.backtrack
    monkeypatch.setattr(codec, "backtrack", lambda t: found.update([t]) or encode(t))
    for k in range(100):
        codec.both(f"the new{k} other{k}")
        assert len(codec.cache) + len(codec.older) <= 20
    assert found["▁the"] == 1
    codec.clear()


def test_imatch(docs, empty, texts, spark):
    rows = got(imatch.compare(docs))
    order = sorted(texts, reverse=True)
    for k, i in enumerate(order):
        t, nxt = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        h = len(t) // 2
        r = rows[i]
        edited = t[: len(t) - h] + nxt[:h]
        a, b, c = (set(x.split("-")) for x in (r.fingerprint, r.edited_fingerprint, rows[order[(k + 1) % len(order)]].fingerprint))
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(len(a & b) / len(a | b)) and r.near_next == pytest.approx(len(a & c) / len(a | c))
    by = defaultdict(set)
    for i, t in texts.items():
        by[t or ""].add(rows[i].fingerprint)
    assert all(len(x) == 1 for x in by.values())
    assert imatch.compare(empty).collect() == []
    one = imatch.compare(docs.filter("doc_id = 1")).first()
    assert one.near_next == 1.0
    assert imatch.fingerprints(docs).count() == len(texts)


def test_imatch_uses_every_term_of_the_band(spark):
    rows = [(k, f"common{k % 9} term{k // 2}") for k in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    # Each termN is in two of 400 documents and so in the band, as commonK is: texts that differ in one differ in their prints.
    found = got(imatch.fingerprints(table))
    assert len({r.fingerprint for r in found.values()}) == len({t for _, t in rows})
    assert not any(e.startswith("zz") for r in found.values() for e in r.fingerprint.split("-"))


def test_imatch_plans_do_not_hold_the_terms(spark):
    """Spark prints a plan at each step, in the driver; a band of many terms mustn't make it long."""
    length = {}
    for many in (200, 2000):
        table = spark.createDataFrame([(k, f"quagga{k % many} term{k}") for k in range(many)], "doc_id long, text string")
        plan = imatch.compare(table, low=0.0)._jdf.queryExecution()
        assert "quagga7" not in plan.toString()
        # The table is the subquery's value, never a column that each row carries.
        assert "__table" not in plan.executedPlan().toString()
        length[many] = len(plan.toString())
    assert length[2000] < 1.1 * length[200]


def test_imatch_is_the_definition(spark):
    """Band, subsets and grouping by brute force; only the 64-bit hash function itself is Spark's."""
    r = random.Random(12)
    rows = [(k, " ".join(r.choice([f"w{r.randint(0, 60)}", f"Rare{r.randint(0, 10**6)}", "é"]) for _ in range(r.randint(0, 60)))) for k in range(120)] + [(500, None), (501, "")]
    rows.append((rows[3][0], rows[3][1]))
    terms = {t: sorted({w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()) if w}) for _, t in rows}
    df = Counter(w for _, t in rows for w in terms[t])
    band = {w for w, c in df.items() if 0.02 * len(rows) <= c <= 0.5 * len(rows)}
    words = sorted(df)
    h = {x.w: (x.a, x.b) for x in spark.createDataFrame([(w,) for w in words], "w string").selectExpr("w", "xxhash64(w) a", "xxhash64(w, 1) b").collect()}
    want = {}
    for t, own in terms.items():
        own = [w for w in own if w in band]
        subsets = {f"w{k}": " ".join(w for w in own if h[w][1] >> 2 * k & 3) for k in range(imatch.WIDE)}
        for rate, cells in enumerate(imatch.RATES):
            for w in own:
                cell = (h[w][0] >> 54 - 10 * rate & 1023) % cells
                if cell < 16:
                    name = f"{16 * rate + cell:02d}"
                    subsets[name] = (subsets.get(name, "") + f" {name}:{w}").strip()
        want[t] = {k: v for k, v in subsets.items() if v} or {"zz": " ".join(terms[t])}
    texts = sorted({v for x in want.values() for v in x.values()})
    code = {x.t: x.c for x in spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("t", "hex(xxhash64(t)) c").collect()}
    found = imatch.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), low=0.02, high=0.5).collect()
    assert len(found) == len(rows)
    text = dict(rows)
    for x in found:
        own = want[text[x.doc_id]]
        made = {f"{k}{code[v] if k == 'zz' else code[v].rjust(16, '0')}" for k, v in own.items()}
        assert set(x.fingerprint.split("-")) == made


def test_imatch_with_repeated_and_null_ids(spark):
    rows = [(7, f"t{k} same words here") for k in range(60)] + [(None, f"n{k} none") for k in range(40)] + [(k, f"u{k} one") for k in range(30)] + [(None, None), (7, "t1 same words here")]
    out = imatch.compare(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert len(out) == len(rows)
    h = {x.t or "": x.h for x in spark.createDataFrame([(t or "",) for _, t in rows], "t string").selectExpr("t", "xxhash64(t) h").collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), h[r[1] or ""]))
    want = Counter()
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        t, nxt = t or "", nxt or ""
        half = len(t) // 2
        want[i, hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()] += 1
    assert Counter((x.doc_id, x.edited_sha256) for x in out) == want


@pytest.mark.parametrize(("n", "percent", "block"), [(4, 85, 20_000), (5, 80, 2)])
def test_jaccard_join(docs, empty, texts, n, percent, block, monkeypatch):
    monkeypatch.setattr(jaccard_trie, "BLOCK", block)
    rows = got(jaccard_trie.join(docs, n=n, percent=percent))
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(lower(t))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                o = len(sets[a] & sets[b])
                if o and 100 * o >= percent * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    assert {i: (r.n_shingles, r.component_id) for i, r in rows.items()} == {i: (len(s), root[i]) for i, s in sets.items()}
    assert len(set(root.values())) < len(root)
    kept = [r.doc_id for r in jaccard_trie.one_of_each(docs.unionByName(docs.filter("doc_id = 2")), n=n, percent=percent).collect()]
    assert sorted(kept) == sorted(set(root.values()))
    assert jaccard_trie.join(empty).collect() == []


def shuffled(spark):
    """Bytes that the session's tasks have written to shuffles."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    found = sc.statusStore().executorList(False)
    return sum(found.apply(k).totalShuffleWrite() for k in range(found.size()))


def test_jaccard_join_shuffles_prefixes_once(spark, monkeypatch):
    monkeypatch.setattr(jaccard_trie, "BROADCAST_ROWS", 0)
    r = random.Random(31)
    make = lambda: [f"w{r.randrange(10**9)}" for _ in range(600)]
    rows = []
    for k in range(0, 400, 2):
        one = make()
        rows += [(k, " ".join(one)), (k + 1, " ".join(make() if k < 360 else one[:580]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()
    docs.count()
    before = shuffled(spark)
    found = got(jaccard_trie.join(docs, n=5, percent=80))
    entries = 400 * 120  # a fifth of a set is its prefix
    assert shuffled(spark) - before < 50 * entries
    assert {i: x.component_id for i, x in found.items()} == {i: i - i % 2 * (i >= 360) for i, _ in rows}


@pytest.mark.parametrize("size", [64, 128, 256, 512])
def test_bitmaps_keep_strangers_apart(size):
    r = np.random.default_rng(size)
    sets = [r.integers(0, 1 << 63, size, np.uint64) for _ in range(400)]
    sketch = jaccard_trie.Sketches(np.full(400, size), [jaccard_trie.bitmap(x) for x in sets], 80)
    a, b = np.triu_indices(400, 1)
    assert sketch.near(a, b).mean() < 0.0002
    near = np.concatenate([sets[0][: size - size // 10], sets[1][: size // 10]])
    sketch = jaccard_trie.Sketches(np.full(2, size), [jaccard_trie.bitmap(x) for x in (sets[0], near)], 80)
    assert sketch.near(np.array([0]), np.array([1])).all()


def test_jaccard_join_by_parts(spark, monkeypatch):
    r = random.Random(12)
    rows = []
    for k in range(0, 90, 3):
        words = [f"w{r.randrange(10**6)}" for _ in range(80)]
        rows += [(k, " ".join(words)), (k + 1, " ".join([*words[:76], f"x{k}"])), (k + 2, " ".join(f"w{r.randrange(10**6)}" for _ in range(80)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(jaccard_trie, "FIRST", 0)  # no early edges: all go by parts
    monkeypatch.setattr(jaccard_trie, "TOKENS", 500)
    monkeypatch.setattr(jaccard_trie, "SHARED", 200)
    names, was = [], jaccard_trie.materialise
    monkeypatch.setattr(jaccard_trie, "materialise", lambda df, name: names.append(name) or was(df, name))
    before = list(WRITTEN)
    kept = jaccard_trie.one_of_each(docs, n=5, percent=80)
    left = [p for p in WRITTEN if p not in before]
    assert sorted(x.doc_id for x in kept.collect()) == sorted(k for k in range(90) if k % 3 != 1)
    assert names.count("jaccard-several") > 1 and names.count("jaccard-edges") > 1
    assert not any("sketches" in p or "edges" in p for p in left)


def test_token_filter_misses_none(spark, monkeypatch):
    r = np.random.default_rng(4)
    tokens, others = r.integers(-(1 << 63), 1 << 63, (2, 30_000), np.int64)
    frame = spark.createDataFrame([(x,) for x in tokens.tolist()], "token long").repartition(5)
    held = jaccard_trie.token_filter(frame)
    assert jaccard_trie.held_by(held, tokens).all() and jaccard_trie.held_by(held, others).mean() < 0.03
    monkeypatch.setattr(jaccard_trie, "MOST_BITS", 1 << 17)  # too few bits let more pass, nothing less
    held = jaccard_trie.token_filter(frame)
    assert len(held) == 1 << 14 and jaccard_trie.held_by(held, tokens).all()
    assert not jaccard_trie.held_by(jaccard_trie.token_filter(frame.limit(0)), tokens).any()


def test_meeting_keeps_every_shared_token(spark):
    r = random.Random(8)
    rows = [(k, 50, r.choice([k, k % 7]), r.sample(range(3000), 20)) for k in range(150)]
    out = {(x.row, x.size, x.label, x.token) for x in jaccard_trie.meeting(spark.createDataFrame(rows, "row long, size long, label long, prefix array<long>").repartition(3)).collect()}
    labels = defaultdict(set)
    for _, _, label, prefix in rows:
        for t in prefix:
            labels[t].add(label)
    every = {(row, size, label, t) for row, size, label, prefix in rows for t in prefix}
    assert {x for x in every if len(labels[x[3]]) > 1} <= out <= every
    assert len(out) < len(every)


def test_one_of_each_decides_by_row(spark):
    r = random.Random(9)
    words = [" ".join(f"{c}{r.randint(0, 10**6)}" for _ in range(80)) for c in "abcdef"]
    near = lambda t: t + " end"
    rows = [(1, words[0]), (None, near(words[0])), (None, words[1]), (None, near(words[1])), (None, words[2])]
    rows += [(2, words[3]), (5, near(words[3])), (5, words[4]), (None, ""), (None, None), (None, words[5]), (None, words[5])]
    kept = jaccard_trie.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    texts = [x.text for x in kept]
    assert {(x.doc_id, x.text) for x in kept} >= {(1, words[0]), (None, words[2]), (2, words[3]), (5, words[4]), (None, ""), (None, None), (None, words[5])}
    assert (words[1] in texts) != (near(words[1]) in texts) and len(kept) == 8


def test_trie_finds_all_links():
    r = np.random.default_rng(2)
    base = [np.sort(r.choice(60, 20, replace=False)) for _ in range(12)]
    sets = [np.sort(np.unique(np.where(r.random(20) < 0.05, r.integers(0, 60, 20), b))).astype(np.uint64) for b in base for _ in range(4)]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in jaccard_trie.link(sets, 80):
        root[find(a)] = find(b)
    for a in range(len(sets)):
        for b in range(a):
            o = len(np.intersect1d(sets[a], sets[b]))
            if 100 * o >= 80 * (len(sets[a]) + len(sets[b]) - o):
                assert find(a) == find(b)


def test_exact_search(spark):
    r = np.random.default_rng(4)
    table = r.normal(size=(300, 8)).astype(np.float32)
    table[50:60] = table[40]
    rows = [(k, v.tolist(), k, "x") for k, v in enumerate(table)] + [(1000, None, 0, "x"), (1100, [None] * 8, 0, "x"), (1200, [math.nan] + [0.0] * 7, 0, "x"), (1300, [1.0], 0, "x"), (None, [1.0] * 8, 0, "x")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, i long, v string").repartition(4)
    query = vectors["vec_id"] % 100 == 0
    found = va_file.search(vectors, query, k=10, block=64).collect()
    whole = np.floor(1024 * table.astype(float)).astype(int)
    for q in (0, 100, 200):
        score = whole @ whole[q]
        best = sorted((k for k in range(300) if k != q), key=lambda k: (-score[k], k))[:10]
        mine = sorted((x.rank, x.vec_id, x.score) for x in found if x.query_id == q)
        assert mine == [(n, k, score[k]) for n, k in enumerate(best, 1)]
    assert len(found) == 30
    assert va_file.search(vectors.limit(0), query).collect() == []


def test_exact_search_by_row_and_width(spark, monkeypatch):
    """Repeated query ids across batches, vectors of two widths, negative, huge and equal ones: by brute force."""
    r = np.random.default_rng(11)
    rows = [(k % 40 * 10, (r.normal(size=6 if k % 3 else 4) * (1e6 if k == 7 else 1)).tolist()) for k in range(130)]
    rows += [(100, rows[5][1]), (100, rows[5][1]), (300, [0.0] * 6)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows]
    want = []
    for i, v in whole:
        if i % 100 == 0:
            score = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in whole if j != i and len(w) == len(v))[:10]
            want += [(i, n, j, -s) for n, (s, j) in enumerate(score, 1)]
    for batch in (20_000, 2):
        monkeypatch.setattr(va_file, "BATCH", batch)
        found = va_file.search(vectors, vectors["vec_id"] % 100 == 0, block=16).collect()
        assert sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in found) == sorted(want)


def test_language_id(docs, empty, texts):
    model = langid.fit(docs, crc_mod("doc_id", 4) != 2)
    rows = got(langid.identify(docs, model))
    for r in corpus():
        p = rows[r[0]]
        assert 0 <= p.score <= 1
        if not any(c.isalpha() for c in r[1] or ""):
            assert (p.lang_pred, p.score, p.spans) == ("und", 0.0, [])
        elif len(r[1]) > 300 and r[1][0] not in "xé":
            assert p.lang_pred == r[2] and p.score > 0.9
    mixed = (texts[8] or "") + " " + (texts[14] or "")
    _, _, spans = model.predict([mixed])
    assert {s["lang"] for s in spans[0]} == {"fr", "de"} and len(spans[0]) <= 4
    kept = langid.identified(docs, model)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    nothing = langid.fit(empty, crc_mod("doc_id", 4) != 2)
    assert langid.identify(docs.limit(2), nothing).first().lang_pred == "und"
    assert langid.identify(empty, model).collect() == []


def test_viterbi_is_the_best_path():
    model = langid.Model(["a", "b", "c"], {x: {"word": Counter({x: 5}), "gram": Counter({x: 5}), "script": Counter({"latin": 9})} for x in "abc"})
    r = np.random.default_rng(8)
    model.rows = np.log(r.dirichlet(np.ones(3) * 0.02, 40) + 1e-9).astype(np.float32)
    docs = [r.integers(0, 40, n) for n in (6, 1, 0, 7)]
    import itertools

    for d, label in zip(docs, model.viterbi(docs), strict=True):
        cost = lambda p: sum(model.rows[w, x] for w, x in zip(d, p, strict=True)) - langid.SWITCH * sum(a != b for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
        best = max(map(cost, itertools.product(range(3), repeat=len(d))))
        assert cost(tuple(label)) == pytest.approx(best, abs=1e-3)


def test_language_scores_the_words_of_a_batch_at_once(monkeypatch):
    """Words as the general pattern finds them, and scores by the definition, in one call for all texts of a batch."""
    chars = [chr(c) for c in [*range(0x20, 0x600), *range(0x2000, 0x20D0), 0x4E00, 0x1E00, 0x10FFFF, 0x130]]
    r = random.Random(5)
    texts = ["".join(r.choice(chars[: r.choice([95, 560, 3000])]) for _ in range(200)) for _ in range(60)] + ["x" * 95, "", "\u201cÉté\u201d \u2013 5\u00b2 \u20ac"]
    assert all(langid.words_of(t) == langid.LETTERS.findall(t.lower()) for t in texts)
    known = {"en": "the house is the best of the houses", "fr": "la maison est la plus belle des maisons"}
    counts = {}
    for x, t in known.items():
        words = langid.words_of(t)
        counts[x] = {"word": Counter({"the": 3, "la": 2}), "gram": Counter(g for w in words for g in langid.grams_of(w)), "script": Counter({"latin": len(words)})}
    model = langid.Model(["en", "fr"], counts)
    want = {}
    for w in {w for t in texts for w in langid.words_of(t)}:
        row = model.word_table[model.words[w]] if w in model.words else sum(model.gram_table[model.grams.get(g, len(model.grams))] for g in langid.grams_of(w))
        row = np.array(row, np.float64) - max(row)
        want[w] = np.maximum(row - np.log(np.exp(row).sum()), langid.FLOOR)
    calls, scores = [], model.scores
    monkeypatch.setattr(model, "scores", lambda words: calls.append(len(words)) or scores(words))
    model.predict(texts)
    assert len(calls) == 1 and set(model.known) == set(want)
    assert all(np.allclose(model.rows[i], want[w], atol=1e-4) and model.letters[i] == len(w) for w, i in model.known.items())
