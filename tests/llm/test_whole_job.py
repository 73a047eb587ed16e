"""Stages and samples against the whole job, by brute force."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from cliploom.llm import labelled, quality, resemblance, simhash


def plain_set(text):
    w = (text or "").lower().split()
    return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def stay_by_force(rows):
    """The smallest doc_id of each component of Jaccard >= 0.8."""
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] == sets[j] or both * 9 >= 4 * (len(sets[i]) + len(sets[j])):
            root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for n, (i, _) in enumerate(rows):
        least[find(n)] = min(least.get(find(n), i), i)
    return sorted(least.values())


def edited(seed=3):
    """Texts with edits about the threshold, copies in other case, short ones, a common passage."""
    r = random.Random(seed)
    word = lambda: r.choice("abcdefghijklmnop") + str(r.randrange(900))
    passage = [word() for _ in range(30)]
    out = []
    for _ in range(25):
        base = [word() for _ in range(r.choice([1, 4, 5, 6, 9, 14, 40, 120, 300]))]
        if r.random() < 0.4:
            base += passage
        out.append(base)
        for _ in range(r.randrange(5)):
            t = list(base)
            for _ in range(r.randrange(1 + len(t) // 30)):
                t[r.randrange(len(t))] = word()
            out.append(t if r.random() < 0.7 else t[: -1 - len(t) // 12])
        out.append([w.upper() for w in base])
    return [(i, " ".join(t)) for i, t in enumerate(out)] + [(len(out), ""), (len(out) + 1, " ")]


@pytest.mark.parametrize("limit", [512, 8])
def test_near_duplicates_equal_brute_force(spark, limit):
    rows = edited()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    if limit == 512:
        got = sorted(r.doc_id for r in simhash.without_near_duplicates(docs).collect())
    else:  # buckets divided into cells
        got = resemblance.resembling(docs, limit=limit).groupBy("class").agg({"doc_id": "min"}).collect()
        got = sorted(r[1] for r in got)
    assert got == stay_by_force(rows)


def just_below(n=300):
    """Texts with 85 shingles in common and 12 of their own, 0.78 alike; some with a closer copy, one in other case."""
    base = [f"w{i}" for i in range(89)]
    texts = [base + [f"own{i}_{k}" for k in range(12)] for i in range(n)]
    texts += [t[:-1] + ["x"] for t in texts[:40:4]] + [[w.upper() for w in texts[7]]]
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("limit", [512, 64])
def test_no_table_has_the_pairs_of_a_group(spark, monkeypatch, limit):
    made, prefixes = {}, []

    def counted(f):
        def run(df, name="links", **options):
            made[name] = max(made.get(name, 0), df.count())
            prefixes.extend([name] if "prefix" in df.columns else [])
            return f(df, name) if f is stored else f(df, **options)

        return run

    stored, components = resemblance.stored, resemblance.connected_components
    monkeypatch.setattr(resemblance, "stored", counted(stored))
    monkeypatch.setattr(resemblance, "connected_components", counted(components))
    rows = just_below()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = resemblance.resembling(docs, limit=limit).groupBy("class").agg({"doc_id": "min"}).collect()
    assert sorted(r[1] for r in got) == stay_by_force(rows)
    # 20 of the 97 shingles are in the tables; two leaders, or s cells of a bucket
    assert max(made.values()) < 20 * len(rows) * 3 < len(rows) ** 2 / 2
    assert prefixes == ["shingles"]


def test_parity_discards_without_loss():
    r = np.random.default_rng(5)
    dropped = 0
    for n in [0, 1, 2, 4, 5, 7, 16, 17, 63, 64, 65, 300, 3000] * 12:
        own = np.unique(r.integers(0, 1 << 64, n, np.uint64, False))
        for share in (0.0, 0.02, 0.1, 0.2, 0.25, 0.5, 1.0):
            other = own[r.random(len(own)) >= share * r.random()]
            other = np.unique(np.concatenate([other, r.integers(0, 1 << 64, int(share * n * r.random()), np.uint64, False)]))
            x, y = (pa.scalar(s, pa.binary()) for s in (own.tobytes(), other.tobytes()))
            p, q = (pa.scalar(resemblance._parity(s), pa.binary()) for s in (own, other))
            may = resemblance._may_be_similar(p, q, 0.8)
            assert may or not resemblance._similar(x, y, 0.8)
            assert may == resemblance._may_be_similar(q, p, 0.8)
            dropped += not may
    assert dropped > 200


def test_pipeline_stage_drops_near_copies_of_many_bits(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = corpus_pipeline.simhash_near_dedup(spark, docs, "").select("doc_id").collect()
    assert sorted(r.doc_id for r in got) == stay_by_force(rows)


def test_sample_keeps_the_shares_of_labels(spark):
    marked = spark.range(6000).selectExpr("id as doc_id", "cast(id % 10 > 0 as int) as quality")
    docs = spark.range(6000).selectExpr("id as doc_id", "'t' as text")
    whole = labelled.sample(docs, marked, "quality", 6000).toPandas().label.mean()
    some = labelled.sample(docs, marked, "quality", 1000).toPandas()
    assert len(some) == 1000 and some.doc_id.is_unique
    assert abs(some.label.mean() - whole) < 0.03


def test_quality_rejects_alike_below_and_above_the_bound(spark):
    """One document in ten is of label 0, and the classes overlap."""
    text = "concat(repeat('word ', 20), repeat('# ', cast(pmod(xxhash64(id), 20) + if(id % 10 = 0, 8, 0) as int)))"
    docs = spark.range(6000).selectExpr("id as doc_id", f"{text} as text")
    marked = spark.range(6000).selectExpr("id as doc_id", "cast(id % 10 > 0 as int) as quality")
    whole, some = (quality.quality(docs, marked, most).filter("predicted = 0").count() for most in (6000, 600))
    assert 0 < whole < 1200 and some == pytest.approx(whole, rel=0.5)
