"""Plain versions of what SQL can't say, and the cases that the docstrings define."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyloom.llm import common, decontamination, language, licenses, near_duplicates, neighbours, packing, quality, secrets, toxicity, warc

ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (4, "one"), (None, "two words"), (5, "long word " * 20_000), (6, "éa ß\x00b")]


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty and very long texts, repeated rows, a row without an id, and further columns of clashing names."""
    rows = [(i, t, "en", 1, "k", [1], ["x"], 2, 3) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int, key string, spans array<int>, items array<string>, n int, score int")


# ---- toxicity


def plain_hits(lexicon, text):
    """The lexicon's matches by str.find at every word's beginning."""
    words = toxicity.WORD.findall(toxicity.fold(text, lambda w: max([0, *(len(e) for e in lexicon.words if f" {e} " in f" {' '.join(toxicity.WORD.findall(w))} "), *(len(e) for e in lexicon.prefixes if f" {e}" in f" {' '.join(toxicity.WORD.findall(w))}")])))
    line, total, n = " " + " ".join(words) + " ", 0.0, 0
    for i, word in enumerate(words):
        start = 1 + sum(len(w) + 1 for w in words[:i])
        found = [(len(e), 0, w, e) for e, w in lexicon.words.items() if line.find(e + " ", start) == start] + [(len(e), 1, w, e + "*") for e, w in lexicon.prefixes.items() if line.find(e, start) == start]
        if not word or not found:
            continue
        _, _, weight, name = max(found)
        if (name, words[i - 1] if i else "") in lexicon.exceptions or (name, words[i + 1] if i + 1 < len(words) else "") in lexicon.exceptions:
            continue
        total, n = total + weight, n + 1
    return total, n, len(words)


def test_toxicity_equals_a_plain_matcher():
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abo"), rng.integers(1, 6)))
    lexicon = toxicity.Lexicon({word(): 1.0 + i for i in range(12)}, {"abab": 3.0, "bo": 2.0})
    lexicon.exceptions = {(e, word()) for e in [*lexicon.words, "bo*"] for _ in range(3)}
    machine = lexicon.machine()
    texts = [" ".join(word() + str(rng.choice(["", "", ",", "0", "!", "-" + word()])) for _ in range(int(rng.integers(0, 40)))) for _ in range(200)]
    assert [lexicon.hits(t, machine) for t in texts] == [plain_hits(lexicon, t) for t in texts]
    assert sum(lexicon.hits(t, machine)[1] for t in texts) > 100


def test_toxicity_exceptions_of_large_lexica_and_long_neighbours(spark):
    long = "z" * 300
    lexicon = toxicity.Lexicon({"trash": 4.0, **{f"w{chr(97 + i // 26)}{chr(97 + i % 26)}": 1.0 for i in range(300)}}, {}, {("trash", long)})
    assert lexicon.hits(f"{long} trash", lexicon.machine())[1] == lexicon.hits(f"trash {long}", lexicon.machine())[1] == 0
    seen = spark.createDataFrame([("trash", "can", f"o{i}", "trash", 0) for i in range(4)] + [("other", "can", f"o{i}", "other", 0) for i in range(9)], "entry string, before string, after string, word string, y int")
    assert toxicity._exceptions(seen, lexicon) == {("trash", "can")}


def test_toxicity_without_labels_and_with_hot_ids(spark, odd):
    labels = spark.createDataFrame([(1, 1), (1, 0), (4, 0), (None, 1)], "doc_id long, toxic int")
    for lexicon in (toxicity.learn(odd, labels.limit(0)), toxicity.learn(odd.limit(0), labels), toxicity.learn(odd, labels)):
        rows = toxicity.score(odd, lexicon).collect()
        assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)


# ---- quality


def test_quality_equals_a_plain_vote():
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(["good", "words", "stand", "here", "BAD!!", "###", "aa"], rng.integers(0, 60))) for _ in range(300)]
    import pyarrow as pa

    data, offsets = common.utf8(pa.array(texts))
    terms = quality.term_counts(data, offsets)
    labels = np.array([int("BAD" not in t) for t in texts[:200]])
    model = quality.fit(terms[:200], labels)
    latent = (terms.astype(float) * model.weights) @ model.space
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    want = []
    for row in np.round(latent @ model.vectors.T, 9):
        top = sorted(range(200), key=lambda i: (-row[i], i))[: quality.NEIGHBOURS]
        weight = [math.exp(quality.SHARPNESS * (row[i] - 1)) for i in top]
        want.append((sum(w * labels[i] for w, i in zip(weight, top, strict=True)) + 1e-3 * quality.PRIOR * labels.mean()) / (sum(weight) + 1e-3 * quality.PRIOR))
    got = model.vote(terms)
    assert np.allclose(got, want, atol=1e-6)
    alone = np.concatenate([model.vote(terms[i : i + 1]) for i in range(300)])
    assert (alone == got).all()  # whatever else a batch holds


# ---- language


def test_language_equals_a_plain_mean(spark):
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abc dé"), rng.integers(2, 50))) for _ in range(80)]
    df = spark.createDataFrame([(i, t, ["x", "y", "z"][i % 3]) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    model = language.train(df)
    rows = {r["doc_id"]: r for r in language.predict(df.unionByName(df), model).collect()}
    for i, t in enumerate(texts):
        raw = np.frombuffer(t.encode(), np.uint8)
        (ids, share), = language.bags(raw, np.array([0, len(raw)]))
        total = model.bias.astype(float)
        for b, w in zip(ids, share, strict=True):
            total = total + float(w) * model.table[b].astype(float)
        p = np.exp(total / model.temperature - (total / model.temperature).max())
        p /= p.sum()
        some = any(c.isalpha() for c in t)
        assert rows[i]["lang_pred"] == (model.classes[int(p.argmax())] if some else "und") and abs(rows[i]["score"] - (p.max() if some else 0)) < 1e-5


def test_language_learns_every_label(spark):
    df = spark.createDataFrame([(i, f"text {i % 600}", f"l{i % 600:03d}") for i in range(1200)], "doc_id long, text string, lang string")
    assert len(language.train(df, sample_rows=600).classes) == 600


# ---- licenses


def test_licenses_are_verified_by_place(spark):
    gpl = "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation".split()
    bsd = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
    whole = next(t for label, t in licenses.TEXTS if label == "mit" and len(t) > 500)
    texts = [
        " ".join(gpl[:4] + gpl[4:-4][::-1] + gpl[-4:]),
        bsd.replace("permitted", "allowed"),
        " ".join(sorted(set(gpl))),
        whole,
        whole.replace("Software", "work", 3),
        " ".join(whole.split()[20:70]),
        None,
        "",
        " ".join(["one two three"] * 30_000) + " " + bsd,
    ]
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)] + [(3, whole, 1, "x"), (3, "no notice", 1, "x")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, w int, label string"))
    labels = [(r["doc_id"], r["labels"]) for r in got.collect()]
    assert sorted(labels) == sorted([(0, ""), (1, "bsd"), (2, ""), (3, "mit"), (3, "mit"), (3, ""), (4, "mit"), (5, "mit"), (6, ""), (7, ""), (8, "bsd")])


# ---- packing


def test_packing_of_special_strings_and_sequences(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a<|endoftext|> b", "<|endoftext|>", "plain", None, "plain", "word " * 3000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(2, "plain", 1)], "doc_id long, text string, id int")
    pieces = packing.tokenize(df, with_ids=True).withColumn("id", F.monotonically_increasing_id())
    pieces = common.written(pieces, "test-pieces")
    placed = packing.pack(pieces.select("id", "length"))
    rows = pieces.join(placed, "id")
    by = {}
    for r in rows.collect():
        by.setdefault((r["doc_id"], r["sequence_id"] if r["doc_id"] == 2 else 0), []).append(r)
    want = {i: plain.encode(t or "", add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}
    assert want[0][1] == 50256
    for i in (0, 1, 3, 4, 5):
        assert [x for r in sorted(by[i, 0], key=lambda r: r["piece"]) for x in r["ids"]] == want[i]
    made = {r["sequence_id"]: r["ids"] for r in packing.sequences(rows).collect()}
    assert sum(map(len, made.values())) == sum(map(len, want.values())) + len(want[2]) and max(map(len, made.values())) <= 1024
    for r in rows.collect():
        assert made[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == list(r["ids"])


def test_packing_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_A_PARTITION", 60)
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 1025, 900).tolist()
    rows = packing.pack(spark.createDataFrame(list(enumerate(lengths)), "id long, length long")).collect()
    assert sorted(r["id"] for r in rows) == list(range(900))
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], lengths[r["id"]]))
    for own in by.values():
        assert [o for o, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 1024
    assert len(by) <= 1.05 * math.ceil(sum(lengths) / 1024) + 2


# ---- archives


def test_warc_repeated_rows_and_damage(spark):
    df = spark.createDataFrame([(1, "u", "same"), (1, "u", "same"), (2, "u", "other"), (2, "u", "more")], "page_id long, url string, html string").withColumn("payload", F.lit(9)).withColumn("digest", F.lit("d"))
    manifest = warc.write_archives(df)
    assert sorted((r["page_id"], r["record_type"]) for r in warc.read_archives(manifest).collect()) == [(1, "response"), (1, "response"), (2, "response"), (2, "response")]
    path = manifest.first()["path"].removeprefix("file:")
    raw = open(path, "rb").read()
    with pytest.raises(ValueError):
        warc.parse(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:1>\r\nWARC-Payload-Digest: sha1:A\r\nWARC-Block-Digest: sha1:B\r\nContent-Length: 4\r\n\r\nContent-Length: 0\r\n\r\n")
    for damaged in (raw[:-30], raw.replace(warc.ENTRY, b"XXXX"), b"no archive"):
        import io

        with pytest.raises(ValueError):
            source = io.BytesIO(damaged)
            source.read_at = lambda n, at, s=source: (s.seek(at), s.read(n))[1]
            warc.directory(source, len(damaged))


# ---- neighbours


def brute(ids, v, q, k):
    d = [(math.dist(v[i], q[1]), ids[i]) for i in range(len(ids)) if ids[i] != q[0]]
    best = {}
    for s, i in sorted(d):
        best.setdefault(i, s)
    return sorted((s, i) for i, s in best.items())[:k]


def test_neighbours_in_double_precision(spark):
    rng = np.random.default_rng(1)
    rows = [(0, [0.1, 0.2]), (1, [0.1000000001, 0.2]), (2, [0.1000000002, 0.2]), (3, [1e300, 0.3]), (4, [1e300, -1e299]), (5, [1e-300, 2e-300]), (6, [3e-300, 1e-300])]
    rows += [(10 + i, [float(x) for x in rng.normal(size=2)]) for i in range(20)] + [(10, [5.0, 5.0]), (10, [0.1, 0.2])]
    sized = [(100 + i, [float(x) for x in rng.normal(size=3)]) for i in range(12)]
    df = spark.createDataFrame(rows + sized, "vec_id long, embedding array<double>").withColumn("v", F.lit(1))
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id").isin(0, 3, 5, 100), probes=4).collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    ids, v = [i for i, _ in rows], [x for _, x in rows]
    for q in (0, 3, 5):
        want = brute(ids, v, rows[q], 10)
        assert [i for _, i in sorted(got[q])] == [i for _, i in want]
        assert all(abs(a - b) <= 1e-15 * max(a, b) for (a, _), (b, _) in zip(sorted(got[q]), want, strict=True))
    assert sorted(i for _, i in got[100]) != [] and {i for _, i in got[100]} <= {i for i, _ in sized}


def test_neighbours_recall_at_the_querys_own_step(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, v = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    got = {}
    for r in neighbours.op10_neighbours(spark, sf).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q, own in got.items():
        d = np.sqrt(((v - v[ids == q]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        hits += len(own & set(ids[np.lexsort((ids, d))[:10]].tolist()))
    assert len(got) == sum(i % 100 == 0 for i in ids) and hits >= 0.9 * 10 * len(got)


# ---- near copies


@pytest.mark.parametrize("small, tested", [(20, 64), (20_000, 64), (20_000, 1)])
def test_jaccard_of_shared_shingles_equal_prefixes_and_hot_keys(spark, monkeypatch, small, tested):
    monkeypatch.setattr(common, "SMALL_ROWS", small)
    monkeypatch.setattr(near_duplicates, "TESTED", tested)
    rng = np.random.default_rng(5)
    texts = []
    for fam in range(3):
        core = [f"f{fam}_{i}" for i in range(40)]
        for _ in range(14):
            own = list(core)
            for _ in range(int(rng.integers(0, 6))):
                own[int(rng.integers(40))] = f"c{int(rng.integers(30))}" if rng.random() < 0.7 else f"x{fam}_{int(rng.integers(40))}"
            texts.append(" ".join(dict.fromkeys(own)))
    texts += [" ".join([f"r{i}" for i in range(8)] + [f"s{int(i)}" for i in rng.choice(46, 36, replace=False)]) for _ in range(14)] + [texts[0]] * 30 + [""] * 5
    sets = [frozenset(t.split()) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = near_duplicates.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), words=1, percent=85)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {i: find(i) for i in range(len(texts))}


def test_jaccard_of_odd_rows(odd):
    rows = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_duplicates.join(odd).collect()}
    assert rows == {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (None, 1, None), (5, 2, 5), (6, 1, 6)}
    two = odd.sparkSession.createDataFrame([(1, "a b c d e"), (1, "v w x y z"), (2, "v w x y z"), (3, "a b c d e")], "doc_id long, text string")
    assert {r["component_id"] for r in near_duplicates.join(two).collect()} == {1}


# ---- stages, folders


def test_stages_of_odd_rows(spark, odd, sf):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, odd, sf)
        assert found.columns == odd.columns
        rows = [tuple(r[:2]) for r in found.collect()]
        if name != "quality":
            assert sorted(map(str, rows)) == sorted(map(str, ODD)), name
        assert stage(spark, odd.limit(0), sf).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, odd, sf)
    assert packed.filter("piece = 0").count() == len(ODD) and corpus_pipeline.STAGES[-1][1](spark, odd.limit(0), sf).count() == 0


def test_pipeline_run_equals_its_stages(spark, sf):
    import corpus_pipeline

    small = "/root/testdata/sf0.001"
    rows = corpus_pipeline.run(spark, small).collect()
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    model = quality.train(docs, spark.read.parquet(f"{small}/labels.parquet"))
    good = {r["doc_id"] for r in quality.score(docs, model).collect() if r["score"] >= quality.THRESHOLD}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := [x.lower() for x in __import__("re").findall(r"[^\x20\x09-\x0D]+", texts[i])]) else set() for i in good}
    first = {i: i for i in good}
    changed = True
    links = [(a, b) for a in good for b in good if a < b and (n := len(sets[a] & sets[b])) and 100 * n >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(first[a], first[b])
            changed |= first[a] != low or first[b] != low
            first[a] = first[b] = low
    kept = {i for i in good if first[i] == i}
    items = [__import__("re").findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r["text"] or "").lower()) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    windows = {" ".join(w[s : s + 10]) for w in items if w for s in range(max(1, len(w) - 9))}
    clean = {i for i in kept if not any(f" {x} " in f" {' '.join(__import__('re').findall(r'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+', texts[i].lower()))} " for x in windows)}
    assert {r["doc_id"] for r in rows} == clean and len(clean) < len(kept) < len(texts)
    used = {}
    for r in rows:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in own) <= 1024 and [o for o, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:i]) for i in range(len(own))] for own in used.values())


def test_secrets_of_odd_rows(spark, odd):
    rows = secrets.scan(odd).collect()
    assert len(rows) == len(ODD) and {r["spans"] for r in rows} == {""}
    assert secrets.scan(odd.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "word " * 50_000 + "token=abcdef1")], "doc_id long, text string")
    assert secrets.scan(long).first()["base"] == "assign:250000:263000".replace("263000", str(250_000 + len("token=abcdef1")))


def test_decontamination_takes_the_place_of_clashing_columns(spark, odd):
    items = spark.createDataFrame([(1, "one"), (2, "two words"), (2, "two words"), (None, "b")], "item_id long, text string")
    for block_bytes in (1000, 0):
        got = decontamination.scan(odd, items, block_bytes=block_bytes)
        rows = {(r["doc_id"], r["n_words"], tuple(r["spans"]), tuple(r["items"])) for r in got.collect()}
        assert rows == {(1, 0, (), ()), (2, 0, (), ()), (3, 0, (), ()), (4, 1, (0, 1), ("1",)), (None, 2, (0, 2), ("2",)), (5, 40_000, (), ()), (6, 3, (2, 3), ())}
        assert sorted(got.columns) == sorted(odd.columns)


def test_run_folder_goes_with_its_tables(spark, tmp_path):
    import os

    before = spark.conf.get(common.BATCH_SETTING)
    with common.run_folder(spark) as folder:
        assert common.written(spark.range(3), "x").count() == 3 and os.listdir(folder.removeprefix("file:"))
    assert not os.path.exists(folder.removeprefix("file:")) and spark.conf.get(common.BATCH_SETTING) == before
