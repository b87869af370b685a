import hashlib
import random

import pytest
import public_tokenizers as P
import test_decontaminate as plain_items
import test_secret_scan as plain_secrets
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tidestock.llm import byte_bpe, secret_scan, simhash_trie, toxicity


@pytest.fixture
def folder(spark, tmp_path):
    rng = random.Random(6)
    words = [f"{a}{b}" for a in ("tal", "be", "mon", "bri", "zo", "kle") for b in ("ka", "lo", "stein", "du", "x")]
    text = lambda n: " ".join(rng.choices(words, k=n)).capitalize()
    items = [(k, text(rng.randrange(12, 40))) for k in range(10)] + [(None, None)]
    docs, labels = [], []
    for k in range(260):
        t, toxic = text(rng.randrange(30, 120)), rng.random() < 0.2
        if toxic:
            t += " you grumbot vileq slurmo"
        if rng.random() < 0.1:
            t += " " + rng.choice(items[:10])[1] + " " + text(5)
        if rng.random() < 0.1:
            t += f" password = {rng.randbytes(9).hex()} é"
        docs.append((k, t))
        labels.append((k, int(toxic)))
    for k in range(60, 100):  # near copies: a word of a long text replaced, or added to it
        w = docs[k][1].split() * 4
        docs[k] = (k, " ".join(w))
        docs.append((800 + k, " ".join([*w, "edited"])))
    docs += [(900 + k, docs[k][1].upper()) for k in range(0, 40, 2)]
    docs += [docs[3]] * 4 + [(None, None), (None, None), (None, docs[5][1]), (700, None), (701, ""), (702, "w " * 20_000), (None, text(50))]
    rows = [(d, t, "xx", None, len(t) if t else 0, 1.5) for d, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), items


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_every_stage(spark, folder):
    path, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, stages = docs.columns, dict(cp.STAGES)

    labels = spark.read.parquet(f"{path}/labels.parquet").where("crc32(cast(cast(doc_id as string) as binary)) % 3 != 1")
    scores = toxicity.score(docs, labels, keep=["doc_id", "text"])
    clean = stages["toxicity"](spark, docs, path)
    assert clean.columns == columns and pairs(clean) == pairs(scores.where("score < 0.7"))
    left = {t for _, t in pairs(clean)}
    said = [t for _, t in pairs(docs) if t and "grumbot" in t.lower()]
    assert sum(t in left for t in said) == 0 and sum(t in left for _, t in pairs(docs) if not t or "grumbot" not in t.lower()) > 200

    clean.write.parquet(f"{path}/1")
    clean = spark.read.parquet(f"{path}/1")
    single = stages["near_duplicates"](spark, clean, path)
    every = pairs(clean)
    prints = {t: simhash_trie.fingerprint(t) for _, t in every}
    texts = list({t: None for _, t in every})
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for i, t in enumerate(texts):
        for u in texts[:i]:
            if (prints[t] ^ prints[u]).bit_count() <= 3:
                root[find(t)] = find(u)
    first = {}
    for d, t in every:
        first[find(t)] = min(first.get(find(t), (True, 0)), (d is None, d or 0))
    got = pairs(single)
    assert single.columns == columns and len(got) == len(first) < len(every)
    assert all(first[find(t)] == (d is None, d or 0) for d, t in got)
    assert {find(t) for _, t in got} == set(first)
    kept = {t for _, t in got}
    assert sum(t.endswith(" edited") for t in kept if t) < 10 < sum(t.endswith(" edited") for _, t in every if t)

    single.write.parquet(f"{path}/2")
    single = spark.read.parquet(f"{path}/2")
    free = stages["decontaminate"](spark, single, path)
    want = [(d, t) for d, t in pairs(single) if not plain_items.plain([(d, t)], items)]
    assert free.columns == columns and pairs(free) == sorted(want, key=str) and len(want) < single.count()

    free.write.parquet(f"{path}/3")
    free = spark.read.parquet(f"{path}/3")
    safe = stages["secrets"](spark, free, path)
    assert safe.columns == columns and safe.count() == free.count()
    before = {(r.doc_id, r.text) for r in free.collect()}
    marked = 0
    for r in safe.collect():
        assert not plain_secrets.base(r.text)
        if secret_scan.MARK in (r.text or ""):
            marked += 1
            assert r.n_chars == len(r.text)
        else:
            assert (r.doc_id, r.text) in before
    assert marked == sum(bool(plain_secrets.everything(t)) for _, t in before) > 0

    safe.write.parquet(f"{path}/4")
    safe = spark.read.parquet(f"{path}/4")
    last = stages["tokens"](spark, safe, path)
    bpe = byte_bpe.coder(open(P.path(cp.RANKS), "rb").read(), P.PATTERN)
    for r in last.collect():
        ids = bpe.encode(r.text or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert sorted(map(str, last.collect())) == sorted(map(str, cp.run(spark, path).collect()))


def test_empty_tables(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").where(F.lit(False))
    for name, stage in cp.STAGES:
        out = stage(spark, docs, path)
        assert out.count() == 0 and out.columns[: len(docs.columns)] == docs.columns
