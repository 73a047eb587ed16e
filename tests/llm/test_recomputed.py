"""Placement, tilt and rounding, ranking and lexicon computed again in plain Python, row by row."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cliploom.llm import mixing, quality, sharding, toxicity
from cliploom.llm.common import row_hash
from cliploom.llm.labelled import sample

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet").cache()


# ---- sharding ----


def test_every_record_lies_where_its_bytes_are(docs):
    """In the order of (hash of the text, doc_id) a group of equal texts goes to the shard its middle byte falls in."""
    shards = 7
    rows = sorted((r.h, r.id, r.doc_id, r["size"]) for r in sharding.records(docs).collect())
    total = sum(r[3] for r in rows)
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    # ranges as large as shards: no group is over a range's share, so none is divided
    assert max(sum(r[3] for r in g) for g in groups.values()) * sharding.ranges_for(len(rows), shards, 1) <= total
    want, begin, slots = {}, 0, Counter()
    for h in sorted(groups):
        size = sum(r[3] for r in groups[h])
        shard = min(shards - 1, (2 * begin + size) * shards // (2 * total))
        for r in groups[h]:
            want[r[2]] = (shard, slots[shard])
            slots[shard] += 1
        begin += size
    assert {r.doc_id: (r.shard, r.slot) for r in sharding.shard(docs, shards, fineness=1).collect()} == want


# ---- mixing ----


def solved(sizes: list[int], target: float, most: int) -> float:
    """The multiplier at which the rates' words meet the target, by halving."""
    low, high = -64.0, 64.0
    for _ in range(200):
        mid = (low + high) / 2
        if sum(z * most / (1 + math.exp(-mid * math.log1p(z))) for z in sizes) > target:
            high = mid
        else:
            low = mid
    return low


def test_copies_follow_the_tilt_and_its_rounding(docs):
    most = 2
    keyed = docs.withColumn("row_hash", row_hash()).withColumn("h", F.xxhash64("doc_id", "row_hash", F.lit("mix")))
    rows = [(r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")), r.h) for r in keyed.collect()]
    got = {r.doc_id: r for r in mixing.mix(docs).collect()}
    assert len(got) == len(rows)
    sources = defaultdict(lambda: defaultdict(list))
    for i, s, z, h in rows:
        sources[s][z].append((h, i))
    for classes in sources.values():
        target = got[next(iter(classes.values()))[0][1]].target
        every = [z for z, c in classes.items() for _ in c]
        full = target >= most * sum(every) * (1 - 1e-12)
        lam = round(solved(every, target, most), 9)
        k, carried, before = {}, 0.0, 0
        for z in sorted(classes):
            n = len(classes[z])
            carried += n * (most if full else most / (1 + math.exp(-lam * math.log1p(z))))
            upto = math.floor(carried + 0.5)
            k[z], before = min(upto - before, most * n), upto
        for _ in range(8):
            off = target - sum(z * c for z, c in k.items())
            fits = [z for z in k if 0 < z <= abs(off) * 1.5 and (k[z] < most * len(classes[z]) if off > 0 else k[z] > 0)]
            if not fits:
                break
            k[max(fits)] += 1 if off > 0 else -1
        for z, members in classes.items():
            n = len(members)
            assert sum(got[i].copies for _, i in members) == k[z]
            if n <= 256:  # one block: the first of the hash order get the copies that are left
                assert [got[i].copies for _, i in sorted(members)] == [k[z] // n + (place < k[z] % n) for place in range(n)]
    assert {r.copies for r in got.values()} == {0, 1, 2}


# ---- quality ----


def plain_features(text: bytes) -> list[float]:
    words = re.findall(rb"[^\x09-\x0D\x20]+", text)
    if not words:
        return [0.0] * (len(quality.NAMES) - 1) + [1.0]
    kinds = [lambda b: 65 <= b <= 90, lambda b: 48 <= b <= 57, lambda b: b in b".,;:", lambda b: b in b"!?", lambda b: b in b"#$%&*+/<=>@\\^_`{|}~", lambda b: b in b"()[]\"'", lambda b: b == 10, lambda b: b > 127]
    n, lines = len(words), [s for s in text.split(b"\n") if s]
    out = [sum(map(k, text)) / len(text) for k in kinds]
    out += [math.log(1 + n), math.log(1 + sum(map(len, words)) / n), len(set(words)) / n**0.8, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n]
    out += [1 - len(set(lines)) / len(lines) if lines else 0.0, sum(kinds[4](w[-1]) or kinds[3](w[-1]) for w in words) / n, sum(len(w) < 3 for w in words) / n, 0.0]
    return out


def test_ranking_is_the_minimum_of_its_loss(docs, labels):
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    chosen = [(r.doc_id, r.label) for r in sample(docs, labels, "quality", 12_000).select("doc_id", "label").collect()]
    plain = {i: plain_features(t) for i, t in texts.items()}
    rows = sorted((list(quality.features(texts[i])), y) for i, y in chosen)
    assert np.allclose([plain[i] for i, _ in chosen], [quality.features(texts[i]) for i, _ in chosen], atol=1e-12)
    model = quality.fit(rows)
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    z = np.clip((x - x.mean(0)) / (x.std(0) + 1e-3), -8, 8)
    draw = np.random.default_rng(0)
    good, bad = z[y == 1], z[y == 0]
    d = good[draw.integers(0, len(good), 60_000)] - bad[draw.integers(0, len(bad), 60_000)]

    def loss(w):
        return np.logaddexp(0, -d @ w).mean() + 1e-3 / 2 * w @ w

    # the loss is convex: no step of any feature may lower it, either way
    at = loss(model["w"])
    for i in range(len(quality.NAMES)):
        for step in (-1e-3, 1e-3):
            assert loss(model["w"] + step * np.eye(len(quality.NAMES))[i]) > at
    s = z @ model["w"]
    assert (s < model["at"]).sum() == (y == 0).sum()
    got = {r.doc_id: (r.score, r.predicted) for r in quality.quality(docs, labels).collect()}
    for i, f in plain.items():
        v = float(np.clip((np.array(f) - x.mean(0)) / (x.std(0) + 1e-3), -8, 8) @ model["w"])
        want = 1 / (1 + math.exp(-max(-30.0, min(30.0, (v - model["at"]) / model["spread"]))))
        assert got[i][0] == pytest.approx(want, abs=1e-6)
        assert got[i][1] == (got[i][0] >= 0.5)


# ---- toxicity ----


def test_lexicon_by_counting(docs, labels):
    """Near copies by the smallest shingle hash count once; stems by the lower end of Wilson's interval."""
    import xxhash

    rows = sample(docs, labels, "toxic", 24_000).cache()
    first, second = {}, {}
    for r in sorted(rows.collect()):
        w = (r.text or "").encode().split()
        grams = {b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))}
        one, two = (min(xxhash.xxh64_intdigest(g, seed) for g in grams) >> 1 for seed in (1, 2))
        first.setdefault(one, (two, w, r.label))
    for two, w, label in first.values():  # by doc_id still
        second.setdefault(two, (w, label))
    seen, toxic = Counter(), Counter()
    for w, label in second.values():
        words = {x.decode("utf-8", "replace").strip(".,;:!?\"'()[]{}#$%&*|~-_").lower() for x in w}
        own = {s for x in words if len(x) > 3 for s in [x[:k] for k in range(4, min(10, len(x)) + 1)] + [x + "$"]}
        seen.update(own)
        toxic.update(own if label else ())

    def low(n, x):
        p, zz = x / n, 1.96**2
        return (p + zz / (2 * n) - 1.96 * math.sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n)

    want = sorted((-toxic[s], s) for s in seen if low(seen[s], toxic[s]) >= 0.6)
    assert len(want) > 5
    assert toxicity.learned_lexicon(rows) == {s for _, s in want[:4000]}
    assert toxicity.learned_lexicon(rows, most=3) == {s for _, s in want[:3]}
