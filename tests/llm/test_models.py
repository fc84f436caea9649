"""Classifiers on held-out texts of the small tables, media round trips, mixing against a plain version, the pipeline."""

import hashlib
import os
import random
import zlib
from collections import defaultdict

import pyarrow as pa
import pytest

import corpus_pipeline
from graticule.llm import idfilter, language, media, mixing, quality, sampling, toxicity
from graticule.llm import queries as llm

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def labels(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}


@needs_tables
def test_quality_held_out(spark):
    known = labels(spark)
    rows = [r for r in llm.op4_quality(spark, SF).collect()]
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in known]
    assert sum(r.predicted == known[r.doc_id].quality for r in held) / len(held) > 0.85


@needs_tables
def test_language_held_out(spark):
    true = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in llm.op5_language(spark, SF).collect() if r.held_out]
    assert sum(r.lang_pred == true[r.doc_id] for r in held) / len(held) > 0.95


@needs_tables
def test_toxicity_held_out(spark):
    known = labels(spark)
    rows = [r for r in llm.op7_toxicity(spark, SF).collect()]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in known]
    assert sum(r.predicted == known[r.doc_id].toxic for r in held) / len(held) > 0.85


def test_models_on_odd_texts_and_without_training():
    odd = pa.array([None, "", "word", "é" * 5000])
    for model in (quality.CompressionClassifier.fit([]), toxicity.FactorizationMachine.fit([]), quality.CompressionClassifier.fit([("a", 1)] * 9), toxicity.FactorizationMachine.fit([("a", 0)] * 9)):
        assert model.score(odd).to_pylist() == [0.5] * 4
        assert len(model.score(pa.array([], pa.string()))) == 0
    sample = [(f"good text number {i} of many words", 1) for i in range(30)] + [(f"%%% {i} $$$ !!! ###", 0) for i in range(30)]
    for model in (quality.CompressionClassifier.fit(sample), toxicity.FactorizationMachine.fit(sample)):
        scores = model.score(odd).to_pylist()
        assert scores[0] == scores[1] and all(0 <= s <= 1 for s in scores)
        assert scores == model.score(odd).to_pylist()


def test_dictionaries_cover_whole_texts():
    """Good and bad texts differ only after the first 300 bytes, and there are more than a dictionary holds heads of."""
    rng = random.Random(3)
    head = "the same words at the head of every text " * 8
    kinds = [[" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * 2 + str(rng.randrange(99)) for _ in range(9)) for _ in range(60)] for _ in (0, 1)]
    sample = [(head + " ".join(rng.choice(kinds[y]) for _ in range(6)), y) for _ in range(900) for y in (0, 1)]
    model = quality.CompressionClassifier.fit(sample)
    scores = model.score(pa.array([t for t, _ in sample[:200]])).to_pylist()
    assert sum((s >= 0.5) == y for s, (_, y) in zip(scores, sample)) > 195


def test_interactions_of_terms():
    """Either word alone is harmless, both together are toxic: what additive weights cannot tell."""
    rng = random.Random(0)
    sample = []
    for _ in range(600):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        sample.append((" ".join([f"n{rng.randrange(10**9)}"] + ["foo"] * a + ["bar"] * b), int(a and b)))
    model = toxicity.FactorizationMachine.fit(sample, least_odds=0.2, least_chi=5, epochs=60)
    score = dict(zip(("foo", "bar", "foo bar"), model.score(pa.array(["foo", "bar", "foo bar"])).to_pylist()))
    assert score["foo bar"] > 0.7 > max(score["foo"], score["bar"])


def test_interactions_of_terms_as_in_production():
    """A group mention and a mild insult, each common in clean text, with the parameters of the query."""
    rng = random.Random(1)
    sample = []
    for _ in range(1500):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        sample.append((" ".join([f"n{rng.randrange(10**9)}", rng.choice(["one", "two", "six"])] + ["foo"] * a + ["bar"] * b), int(a and b)))
    model = toxicity.FactorizationMachine.fit(sample)
    score = dict(zip(("foo", "bar", "foo bar", "six"), model.score(pa.array(["foo", "bar", "foo bar", "six"])).to_pylist()))
    assert score["foo bar"] > 0.7 > max(score["foo"], score["bar"], score["six"])


def test_language_edges():
    sample = [("the cat and the dog are here", "en"), ("der Hund und die Katze sind da", "de")] * 20
    model = language.LanguageModel.fit(sample)
    got = model.predict(pa.array([None, "", "12 34!", "the dog", "die Katze", "ж"])).to_pylist()
    assert [g["lang_pred"] for g in got[:5]] == ["und", "und", "und", "en", "de"]
    assert got[5]["lang_pred"] in ("en", "de") and all(0 <= g["score"] <= 1 for g in got)
    assert language.LanguageModel.fit([]).predict(pa.array(["x"])).to_pylist()[0]["lang_pred"] == "und"


def test_samples_leave_out_the_held_out_fold(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(60)] + [(None, "n"), (61, None), (0, "t0")], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2, None) for i in range(60)] + [(None, 1, 1), (61, 1, 0)], "doc_id long, quality int, toxic int")
    sample = sampling.labelled_sample(docs, marks, "quality", 100)
    want = sorted(f"t{i}" for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1)
    assert sorted(t for t, _ in sample) == want
    assert len(sampling.labelled_sample(docs, marks, "quality", 5)) == 10
    assert sampling.labelled_sample(docs, marks.limit(0), "quality", 5) == []


# --- media


def test_chunks_put_together_and_realign():
    rng = random.Random(1)
    data = rng.randbytes(60_000)
    pieces = list(media.chunks(data))
    assert b"".join(p for _, p in pieces) == data and max(len(p) for _, p in pieces) <= media.MOST
    moved = {d for d, _ in media.chunks(b"some bytes before" + data)}
    assert len(moved & {d for d, _ in pieces}) > 0.8 * len(pieces)
    assert media.decode_wave(media.encode_wave(data)) == data
    with pytest.raises(ValueError):
        media.decode_wave(media.encode_wave(data)[:-1])


def plain_chunks(data):
    """Cut points by the rolling hash one byte at a time."""
    ends, start, h = [], 0, 0
    for i, byte in enumerate(data):
        h = ((h << 1) + int(media.GEAR[byte])) & 0xFFFFFFFF
        size = i + 1 - start
        if size >= media.LEAST and (h >> (32 - media.MEAN_BITS) == 0 and len(data) > media.LEAST or size == media.MOST):
            ends.append(i + 1)
            start = i + 1
    return ends + [len(data)] if start < len(data) else ends


@pytest.mark.parametrize("full", [False, True])
def test_media_columns(spark, monkeypatch, full):
    """Without a bitmap every chunk goes by the store, with the same results."""
    if full:
        monkeypatch.setattr(idfilter, "MOST_BITS", 0)
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefgh é") for _ in range(30_000))
    texts = [None, "", "a", "é" * 32, "x" * 64, "y" * 65, long, long, "z" + long, long[:15_000], "q" * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as _seq", "2 as n_bytes", "3 as _row", "4 as _doc")
    rows = {r.doc_id: r for r in media.media_columns(df.repartition(3), keep=("doc_id", "_row", "_doc", "n_bytes")).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        payload = raw + bytes(64 - len(raw) % 64 if len(raw) % 64 or not raw else 0)
        r = rows[i]
        assert (r["_row"], r["_doc"]) == (3, 4)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
        stored = media.encode_wave(payload)
        assert (r.media_bytes, r.media_sha256) == (len(payload) + 44, hashlib.sha256(stored).hexdigest())
        level = [b - 128 for b in payload]
        assert r.feature == f"pcm8:8000:{len(level)}:sum={sum(level)}:energy={sum(x * x for x in level)}:peak={max(map(abs, level))}"
        assert r.n_chunks == len(plain_chunks(stored))
    assert tuple(rows[6])[1:] == tuple(rows[7])[1:] and tuple(rows[0])[1:] == tuple(rows[1])[1:]
    assert media.media_columns(df.limit(0)).count() == 0


def test_shared_chunks_are_stored_once_and_all_media_are_stored(spark):
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefgh") for _ in range(20_000))
    df = spark.createDataFrame([(k, t) for k, t in enumerate([long, long, "alone", f"b{long}"])], "doc_id long, text string")
    base = df.selectExpr("struct(doc_id as c0) as _doc", "text as _text")
    stored = media.store_media(base.coalesce(1), media.shared_chunks(df)).collect()
    whole = [r for r in stored if r["_row"] is not None]
    pieces = [r["_digest"] for r in stored if r["_row"] is None]
    assert len(whole) == 4 and len(pieces) == len(set(pieces)) > 0
    assert sum(len(p) for r in whole for p in r["_parts"] if p) < len(long) / 2


# --- mixing


def domain(source):
    return f"domain{int(hashlib.md5((source or '').encode()).hexdigest()[0], 16) % 4}"


def fill(children, budget):
    """children: {key: (weight, capacity)}; the shares by exact integer filling."""
    left, share, ready = budget, {}, {k: wc for k, wc in children.items() if wc[0] > 0 and wc[1] > 0}
    for key in sorted(ready, key=lambda k: (ready[k][1] / ready[k][0], k)):
        weights = sum(w for k, (w, _) in ready.items() if k not in share)
        w, cap = ready[key]
        if max(0, left) * w // weights < cap:
            level = max(0, left)
            return share | {k: level * w // weights for k, (w, _) in ready.items() if k not in share}
        share[key] = cap
        left -= cap
    return share


def mixed(docs, weights, percent, epochs, seed):
    leaf = defaultdict(lambda: defaultdict(int))
    for i, text, lang, source in docs:
        n = len((text or "").split())
        if n:
            leaf[domain(source), lang or "", source or ""][i] += n
    total = sum(sum(units.values()) for units in leaf.values()) * percent // 100
    shares = {(): total}
    for depth in range(3):
        level = defaultdict(lambda: defaultdict(int))
        for path, units in leaf.items():
            level[path[:depth]][path[: depth + 1]] += sum(units.values()) * epochs
        names = ("domain", "lang", "source")
        shares = {k: s for up, kids in level.items() for k, s in fill({k: (weights.get(names[depth], {}).get(k[-1], 1), c) for k, c in kids.items()}, shares.get(up, 0)).items()}
    out = {}
    for path, units in leaf.items():
        whole, rest = divmod(shares.get(path, 0), sum(units.values()))
        for e in range(whole):
            out |= {(i, path, e): n for i, n in units.items()}
        key = lambda i: (int(hashlib.md5(f"{seed}:{whole}:{'' if i is None else i}".encode()).hexdigest()[:15], 16), str(i or 0) if i is not None else "")
        for i in sorted(units, key=key):
            take = min(rest, units[i])
            if take:
                out[i, path, whole] = take
            rest -= take
    return out


@pytest.mark.parametrize("percent, epochs, weights", [(75, 2, {}), (150, 3, {"lang": {"en": 4, "de": 1}}), (30, 1, {"source": {"s1": 9, "s2": 0}}), (0, 2, {}), (1000, 2, {})])
def test_mixing(spark, percent, epochs, weights):
    rng = random.Random(percent)
    docs = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 40])), rng.choice(["en", "en", "de", None]), rng.choice(["s0", "s0", "s0", "s1", "s2", None])) for i in range(300)]
    docs += [(None, "a b c", "en", "s0"), (400, None, "en", "s1")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").selectExpr("*", "1 as tokens", "2 as share")
    got = defaultdict(int)
    rows = mixing.mix(df, weights, percent, epochs, 5).collect()
    for r in rows:
        got[r.doc_id, (domain(r.source), r.lang or "", r.source or ""), r.mix_epoch] += r.mix_tokens
    assert dict(got) == mixed(docs, weights, percent, epochs, 5)
    assert max((r.mix_epoch for r in rows), default=0) < epochs


def test_mixing_of_nothing_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b c", "en", "s"), (1, "a b c", "en", "s"), (2, "d", "en", "s")], "doc_id long, text string, lang string, source string")
    assert mixing.mix(df.limit(0)).count() == 0
    rows = mixing.mix(df, percent=100, max_epochs=1).collect()
    assert len(rows) == 3 and sum(r.mix_tokens for r in rows) == 7


# --- the pipeline


@needs_tables
def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL).cache()
        assert docs.columns == columns, name
        n = docs.count()
        assert 0 < n <= before and (name != "pii" or n == before), name
        before = n
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    tokens = sum(len(r.text.split()) for r in docs.collect())
    assert 0 < last.agg({"mix_tokens": "sum"}).first()[0] <= tokens * 75 // 100
    ran = corpus_pipeline.run(spark, SMALL)
    assert sorted((r.doc_id, r.mix_epoch, r.mix_tokens) for r in ran.collect()) == sorted((r.doc_id, r.mix_epoch, r.mix_tokens) for r in last.collect())
