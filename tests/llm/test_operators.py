"""Every operator against brute force on small tables, and on odd rows and empty tables."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from cliploom.llm import (
    embeddings,
    exact_dedup,
    mixing,
    pieces,
    quality,
    rans,
    registry,
    sharding,
    simhash,
    token_counts,
    token_files,
    toxicity,
    words,
)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def groups(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


# ---- SentencePiece ----


def test_pieces_equal_the_library():
    import random

    import sentencepiece

    ref = sentencepiece.SentencePieceProcessor(model_file=registry.PIECE_BPE)
    code = pieces.Encoder(registry.PIECE_BPE)
    random.seed(5)
    texts = ["", " ", "  two  blanks ", "line\nbreak\n", "tab\tx", "日本語 です 한국어 😀", "<0x0A> <s> <unk>", "ab" * 400, "▁ mark", " "] + [
        "".join(random.choice("etaoin shrdlu   \nTHE,.0é") for _ in range(random.randint(0, 300))) for _ in range(200)
    ]
    for t, ids in zip(texts, code.encode(texts), strict=True):
        assert ids.tolist() == ref.encode(t), t
        assert code.decode([ids]) == [ref.decode(ids.tolist())]


def test_pieces_relaxing_long_units_agrees_with_short(monkeypatch):
    text = ["thereandtherethenthatinghereation" * 2]
    short = pieces.Encoder(registry.PIECE_BPE).encode(text)[0].tolist()
    monkeypatch.setattr(pieces, "_LONG", 3)
    assert pieces.Encoder(registry.PIECE_BPE).encode(text)[0].tolist() == short


def test_pieces_long_texts_are_cut_at_units(monkeypatch):
    code = pieces.Encoder(registry.PIECE_BPE)
    texts = ["some words  and  \n more   blanks " * 40, "  x" * 90, "unbroken" * 70, "end with blanks" + " " * 80]
    whole = [x.tolist() for x in code.encode(texts)]
    for n in (7, 50):
        monkeypatch.setattr(pieces, "_AT_ONCE", n)
        assert [x.tolist() for x in code.encode(texts)] == whole
        assert all("".join(pieces._cut(t)) == t for t in texts)


def test_pieces_forget_and_learn_again(monkeypatch):
    code = pieces.Encoder(registry.PIECE_BPE)
    first = [x.tolist() for x in code.encode(["a b c d e f", "the quick fox"])]
    monkeypatch.setattr(pieces, "_KEPT", 3)
    assert [x.tolist() for x in code.encode(["a b c d e f", "the quick fox"])] == first


def test_pieces_query(spark, docs, odd, empty):
    r = pieces.encode_decode(docs, registry.PIECE_BPE).toPandas()
    assert len(r) == 200 and r.round_trip.all()
    r = pieces.encode_decode(odd, registry.PIECE_BPE, with_ids=True, with_text=True).toPandas()
    assert len(r) == 16 and r.round_trip.all()
    assert r[r.doc_id == 4].n_pieces.item() == 0 and r[r.doc_id == 4].decoded.item() == ""
    assert pieces.encode_decode(empty, registry.PIECE_BPE).count() == 0


# ---- sharding ----


def check_shards(r, shards):
    for s, x in r.groupby("shard"):
        assert 0 <= s < shards and sorted(x.slot) == list(range(len(x)))


def test_sharding(spark, docs, odd, empty):
    r = sharding.shard(docs, 5).toPandas()
    check_shards(r, 5)
    text = dict(docs.select("doc_id", "text").collect())
    assert all(r["size"] == [len(text[i].encode()) + 16 for i in r.doc_id])
    assert all(r.text_crc32 == [zlib.crc32(text[i].encode()) for i in r.doc_id])
    b = r.groupby("shard")["size"].sum()
    assert b.max() - b.min() <= 2 * r["size"].max()
    again = sharding.shard(docs.repartition(7), 5).toPandas()
    assert sorted(map(tuple, r[["doc_id", "shard", "slot"]].values.tolist())) == sorted(map(tuple, again[["doc_id", "shard", "slot"]].values.tolist()))
    o = sharding.shard(odd, 4).toPandas()
    assert len(o) == 16
    check_shards(o, 4)
    assert sharding.shard(empty, 4).count() == 0


def test_sharding_divides_a_hot_group(spark):
    rows = [(i, "same text of all") for i in range(3000)] + [(i, f"text number {i}") for i in range(3000, 6000)]
    r = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 10).toPandas()
    b = r.groupby("shard")["size"].sum()
    assert len(b) == 10 and b.max() < 1.1 * b.mean()
    check_shards(r, 10)


# ---- SimHash ----


def plain_simhash(text):
    import xxhash

    w = [x for x in re.split(rb"[\x20\x09-\x0d]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())) if x]
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(docs, odd, empty):
    for d in (docs, odd):
        r = simhash.near_duplicates(d).toPandas()
        rows = d.select("doc_id", "text").collect()
        assert len(r) == len(rows)
        fps = {(x.doc_id, simhash.fingerprint((x.text or "").encode(), 4)) for x in rows}
        assert {(x.doc_id, plain_simhash(x.text)) for x in rows if len(x.text or "") < 20_000} <= fps
        assert {(None if i != i else int(i), int(f, 16)) for i, f in zip(r.doc_id, r.fingerprint, strict=True)} == fps
        known = sorted((f, i) for i, f in fps if i is not None)
        links = [(a[1], b[1]) for n, a in enumerate(known) for b in known[n + 1 :] if bin(a[0] ^ b[0]).count("1") <= 4]
        want = groups([i for _, i in known], links)
        assert all(c == want[int(i)] for i, c in zip(r.doc_id, r.component_id, strict=True) if i == i)
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.without_near_duplicates(odd).columns == odd.columns


def test_simhash_bands_lose_nothing():
    rng = np.random.default_rng(2)
    for n in (100, 1 << 24, 1 << 34):
        masks = simhash._bands(n, 4)
        for _ in range(200):
            x = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(x & m == 0 for m in masks)


def test_simhash_hot_bucket_in_cells(spark):
    base = 0x0123456789ABCDEF
    fps = sorted({base ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(64)})
    frame = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    found = simhash.links(frame, limit=64).collect()
    assert len(set(groups([simhash.signed(f) for f in fps], [(r.a, r.b) for r in found]).values())) == 1


# ---- exact dedup ----


def test_fuse_filter_has_every_key():
    keys = np.random.default_rng(1).integers(0, 2**63, 80_000).astype(np.uint64)
    for n in (0, 1, 2, 3, 7, 100, 5000, 70_000):
        f = exact_dedup.fuse_build(keys[:n])
        assert exact_dedup.fuse_probe(f, keys[:n]).all()
        assert exact_dedup.fuse_probe(f, keys[70_000:]).mean() < 0.001


def test_exact_dedup(docs, odd, empty):
    for d, bits in ((docs, 256), (docs, 8), (odd, 256)):
        r = exact_dedup.exact_dedup(d, bits).toPandas()
        norm = [(x.doc_id, hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", x.text or "").encode()).hexdigest()) for x in d.select("doc_id", "text").collect()]
        keep, n = {}, {}
        for i, s in norm:
            n[s] = n.get(s, 0) + 1
            if i is not None:
                keep[s] = min(keep.get(s, i), i)
        assert len(r) == len(norm)
        for i, k, c, kept, s in zip(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256, strict=True):
            assert c == n[s] and (k == keep[s] if s in keep else k != k) and kept == (i == k or (i != i and k != k))
    assert exact_dedup.exact_dedup(empty).count() == 0
    left = exact_dedup.without_copies(odd)
    # one of each text: the words, the empty, the blank, two long, w..., insult, a, accents, without id
    assert left.count() == 10 and left.columns == odd.columns


def test_stages_keep_columns_of_any_name(spark):
    names = ["_id", "_hash", "_copy", "_copies", "_n", "ROW_HASH"]
    rows = [(i, f"text number {i % 4} with some words", "s", *[f"{c}{i}" for c in names]) for i in range(8)]
    given = spark.createDataFrame(rows, ["doc_id", "text", "source", *names])
    own = {r.doc_id: tuple(r) for r in given.collect()}
    for stage in (exact_dedup.without_copies, mixing.mixed, simhash.without_near_duplicates):
        left = stage(given)
        assert left.columns == given.columns and left.count() > 0
        assert all(tuple(r) == own[r.doc_id] for r in left.collect())


def test_sharding_draw_is_bounded_and_divides_repeated_rows(spark):
    same = spark.range(20_000).selectExpr("cast(null as long) as doc_id", "'one text' as text")
    other = spark.range(500).selectExpr("id as doc_id", "concat('text ', id) as text")
    docs = same.union(other)
    rows = sharding.records(docs)
    assert rows.filter("doc_id is null").count() == -(-20_000 // sharding.PART)
    total = rows.selectExpr("sum(bytes)").first()[0]
    assert 900 < sharding._draw(rows, 1000, total, "first")["hits"].sum() < 1100
    r = sharding.shard(docs, 10).toPandas()
    b = r.groupby("shard")["size"].sum()
    assert len(r) == 20_500 and len(b) == 10 and b.max() < 1.05 * b.mean()
    check_shards(r, 10)


# ---- mixing ----


def test_mixing(docs, odd, empty):
    for d in (docs, odd):
        r = mixing.mix(d).toPandas()
        src = d.select("doc_id", "source", "text").toPandas()
        size = src.text.map(lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")))
        assert sorted(r["size"]) == sorted(size) and (r.taken <= 2 * r["size"]).all() and (r.taken == r.copies * r["size"]).all()
        per = size.groupby(src.source.fillna("\U0010ffff")).sum().sort_index()
        weight = dict(zip(per.index, [3, 1, 2] * 99, strict=False))
        budget, left, target = 1.5 * per.sum(), set(per.index), {}
        while left:
            total = sum(weight[s] for s in left)
            over = [s for s in left if budget * weight[s] / total > 2 * per[s]]
            if not over:
                target |= {s: budget * weight[s] / total for s in left}
                break
            target |= {s: 2.0 * per[s] for s in over}
            budget -= sum(2.0 * per[s] for s in over)
            left -= set(over)
        assert {round(x, 5) for x in r.target} == {round(float(x), 5) for x in target.values()}
    r = mixing.mix(docs).toPandas().merge(docs.select("doc_id", "source").toPandas(), on="doc_id")
    by = r.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), longest=("size", "max"))
    assert (abs(by.taken - by.target) <= 0.05 * by.target).all()
    again = mixing.mix(docs.repartition(5)).toPandas()
    assert dict(zip(r.doc_id, r.taken, strict=True)) == dict(zip(again.doc_id, again.taken, strict=True))
    assert mixing.mix(empty).count() == 0
    assert mixing.mixed(odd).columns == odd.columns


def test_mixing_counts_words(spark):
    texts = [None, "", " ", "a", " a  b ", "a\tb\x0bc\x0cd\re\nf", "x" + " " * 100 + "y", "a" + " \n" * 9 + "b", " b c"]
    r = mixing.with_words(spark.createDataFrame([(t,) for t in texts], "text string"), "text", "n").collect()
    assert {x.text: x.n for x in r} == {t: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts}


def test_mixing_plan_has_no_python(docs):
    plan = mixing.mix(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian", plan)


# ---- classifiers ----


def test_quality(spark, docs, labels, odd, empty):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    marked = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    r = quality.quality(big, marked).toPandas()
    assert len(r) == 1000 and r.score.between(0, 1).all() and ((r.score >= 0.5) == (r.predicted == 1)).all()
    assert (r.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in r.doc_id]).all()
    m = r[r.held_out].merge(marked.toPandas(), on="doc_id")
    assert (m.predicted == m.quality).mean() > 0.95
    o = quality.quality(odd, labels)
    assert o.count() == 16 and o.filter("score is null").count() == 0
    assert quality.quality(empty, labels).count() == 0
    assert quality.quality(docs, labels.limit(0)).filter("predicted = 0").count() == 0
    assert quality.without_rejects(odd, labels).columns == odd.columns


def test_toxicity(spark, labels, odd, empty):
    big = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    marked = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    r = toxicity.toxicity(big, marked).toPandas()
    assert len(r) == 10_000 and r.score.between(0, 1).all() and ((r.score >= 0.7) == (r.predicted == 1)).all()
    m = r[r.held_out].merge(marked.toPandas(), on="doc_id")
    assert (m.predicted == m.toxic).mean() > 0.95 and m[m.toxic == 0].predicted.mean() < 0.01
    o = toxicity.toxicity(odd, labels)
    assert o.count() == 16 and o.filter("score is null").count() == 0
    assert toxicity.toxicity(empty, labels).count() == 0
    assert toxicity.toxicity(odd, labels.limit(0)).filter("score <> 0").count() == 0


# ---- token files ----


def test_rans_round_trip_and_checksums():
    rng = np.random.default_rng(0)
    for n in (0, 1, 255, 256, 65_535, 65_536, 65_537, 150_000):
        ids = np.minimum(rng.zipf(1.3, n), 49_407).astype(np.uint32)
        freq = rans.frequencies(np.bincount(ids, minlength=49_408))
        code = rans.Coder(freq)
        block = code.encode(ids)
        assert (code.decode(block) == ids).all()
        if n > 140_000:
            assert (code.decode(block, slice(1, 2)) == ids[65_536:131_072]).all()
            with pytest.raises(ValueError):
                code.decode(block[:5000] + bytes([block[5000] ^ 1]) + block[5001:])
    even = rans.frequencies(np.ones(49_408, np.int64))
    assert even.min() >= 1 and even.sum() == 1 << rans.BITS


def test_word_encoder_equals_the_library():
    import random

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(registry.WORD_BPE)
    random.seed(3)
    texts = ["it's you're  O'Neil's\x0bx\x85y z ́a ΣΑΣ <|endoftext|>foo é 12,5", "x<|endoftext|>,a", "abc<|ENDOFTEXT|>.", "", "\x1cq 'S 'LL İ ﬁ"]
    texts += ["".join(random.choice("abcé'ßsT.,!<|>- ×÷́d1€_") for _ in range(random.randint(1, 60))) for _ in range(2000)]
    ids, size = words.WordEncoder(registry.WORD_BPE).encode([t.encode() for t in texts])
    at = np.concatenate([[0], np.cumsum(size)])
    for i, e in enumerate(tok.encode_batch(texts, add_special_tokens=False)):
        assert ids[at[i] : at[i + 1]].tolist() == e.ids, texts[i]


def test_token_ids_and_counts(docs, odd, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(registry.WORD_BPE)
    for d in (docs, odd):
        rows = sorted(d.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
        ids = [np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4") for r in rows]
        r = token_files.token_ids(d, registry.WORD_BPE).toPandas().sort_values("start")
        assert list(r.n_tokens) == [len(x) for x in ids] and list(r.ids_crc32) == [zlib.crc32(x.tobytes()) for x in ids]
        assert list(r.start) == np.cumsum([0, *map(len, ids)])[:-1].tolist()
        for block in (7, 1000, 1 << 18):
            c = token_counts.token_counts(d, registry.WORD_BPE, block=block).collect()
            assert sorted((x.doc_id is not None, x.doc_id or 0, x.n_tokens) for x in c) == sorted(
                (x.doc_id is not None, x.doc_id or 0, len(y)) for x, y in zip(rows, ids, strict=True)
            )
    assert token_files.token_ids(empty, registry.WORD_BPE).count() == 0
    assert token_counts.token_counts(empty, registry.WORD_BPE).count() == 0


# ---- embeddings ----


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 32))
    rows = []
    for b in base:
        for _ in range(rng.integers(1, 9)):
            rows.append((b + rng.normal(size=32) * rng.uniform(0, 0.25)).tolist())
    rows += [rows[0]] * 5
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]
    n = len(rows)
    bad = [(n, None), (n + 1, [0.0] * 32), (n + 2, [float("nan")] * 32), (n + 3, [1.0, None] + [0.0] * 30), (n + 4, []), (n + 5, rows[0][1][:31]), (None, rows[0][1])]
    given = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")
    r = embeddings.near_vectors(given).toPandas()
    assert len(r) == n + 7
    x = np.array([v for _, v in rows] + [rows[0][1]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    got = r[r.vec_id < n].set_index("vec_id").n_links.reindex(range(n)).to_numpy()
    want = near.sum(1)[:n]
    assert (got <= want).all() and got.sum() >= 0.97 * want.sum()
    lone = r[r.vec_id >= n]
    assert (lone.n_links == 0).all() and (lone.component_id == lone.vec_id).all() and lone.kept.all()
    assert r[r.vec_id.isna()].n_links.item() == want[0] and not r[r.vec_id.isna()].kept.item()
    assert embeddings.near_vectors(given.limit(0)).count() == 0


# ---- pipeline ----


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == columns, name
        docs = spark.createDataFrame(after.toPandas(), after.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    assert len(last) == docs.count() and last.round_trip.all()
    once = {r.doc_id: r.text for r in docs.collect()}
    norm = [re.sub(r"\s+", " ", t) for t in once.values()]
    assert len(set(norm)) == len(norm)
    assert corpus_pipeline.run(spark, SF).count() == len(last)


def _vectors(kind, n=300, d=64):
    rng = np.random.default_rng(7)
    b = rng.normal(size=d)
    if kind == "one":
        return b[None]
    if kind == "equal":
        return np.tile(b, (20, 1))
    if kind == "tight":
        return b + 0.02 * np.linalg.norm(b) / np.sqrt(d) * rng.normal(size=(n, d))
    if kind == "random":
        return rng.normal(size=(n, d))
    # a few long axes, pairs on both sides of the threshold
    centres = rng.normal(size=(n // 6, d)) * np.geomspace(5, 0.1, d)
    return np.repeat(centres, 6, axis=0) + rng.normal(size=(n // 6 * 6, d)) * np.geomspace(5, 0.1, d) * 0.2


@pytest.mark.parametrize("kind", ["one", "equal", "tight", "random", "anisotropic"])
def test_embeddings_of_any_shape(spark, kind):
    x = _vectors(kind)
    given = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    r = embeddings.near_vectors(given).toPandas().set_index("vec_id").n_links.reindex(range(len(x))).to_numpy()
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    want = near.sum(1)
    assert len(r) == len(x) and (r <= want).all() and r.sum() >= 0.9 * want.sum()
