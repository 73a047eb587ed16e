"""Merkle manifest, cross-tokenizer alignment and packing against brute force, on odd rows and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cliploom.llm import alignment, common, merkle, packing, pieces, registry
from cliploom.llm.words import ByteEncoder, encoder

SF = "/root/testdata/sf0.001"
ALPHABET = ["a", "b", "Z", " ", "  ", "\n", "\t", "\r\n", "'s", "é", " ", "　", "漢", "12", ",", ".", "<|endoftext|>", "<s>", "▁", " the", "ation", "—", "😀", "\x00", "\x85"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts_at_random(n, longest=40, seed=3):
    r = random.Random(seed)
    return ["".join(r.choices(ALPHABET, k=r.randint(0, longest))) for _ in range(n)]


# ---- places in groups ----


def test_numbered_equals_a_window(spark):
    rows = common.stored(spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise((F.col("id") % 7).cast("string")).alias("g"), ((F.col("id") * 7919) % 1013).alias("o")), "t")
    got = defaultdict(list)
    for r in common.numbered(rows, ["g"], ["o"], "n").collect():
        got[r["g"]].append((r["pos"], r["o"]))
    for own in got.values():
        assert [p for p, _ in sorted(own)] == list(range(len(own)))
        assert [o for _, o in sorted(own)] == sorted(o for _, o in own)
    assert sum(map(len, got.values())) == 3000


# ---- Merkle manifest ----


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def folded_tree(leaves):
    """(root, path of each leaf), one list at a time."""
    paths, own, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for i, at in enumerate(own):
            run = level[at // 16 * 16 : at // 16 * 16 + 16]
            paths[i].append(("".join(run[: at % 16]), "".join(run[at % 16 + 1 :])))
        level = [h(*level[i : i + 16]) for i in range(0, len(level), 16)]
        own = [at // 16 for at in own]
    return level[0], paths


def manifest_by_hand(rows):
    """rows (doc_id, source, lang, n_chars, text) -> sorted results."""
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        own = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[s] = (own, *folded_tree([leaf_of(r) for r in own]))
    root, top = folded_tree([trees[s][1] for s in names])
    out = []
    for s, above in zip(names, top, strict=True):
        own, subroot, paths = trees[s]
        for r, path in zip(own, paths, strict=True):
            way = path + above
            text = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and text is not None:
                text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
            done = leaf_of((*r[:4], text))
            for left, right in way:
                done = h(left, done, right)
            out.append((r[0], leaf_of(r), subroot, root, h(*[x + y for x, y in way]), done, done == root))
    return sorted(out, key=repr)


def manifest(df):
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    got = merkle.verified(merkle.proofs(df, received={"text": F.when(changed, lowered).otherwise(F.col("text"))}))
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in got.select(*names).collect()), key=repr)


def test_merkle_manifest(odd, empty):
    rows = [(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in odd.collect()]
    assert manifest(odd) == manifest_by_hand(rows)
    assert manifest(empty) == []


def test_merkle_levels_and_many_sources(spark):
    r = random.Random(5)
    # sources of 1, 15, 16, 17, 256, 257 and 300 leaves, and 17 more of a few, so that both trees have two levels
    sizes = {None: 1, "": 2, "a": 15, "b": 16, "c": 17, "d": 256, "e": 257, "é": 300} | {f"s{i}": i % 3 + 1 for i in range(17)}
    rows = [(i, s, r.choice(["en", None]), r.choice([None, 5]), r.choice([None, "", "Abc", "xYz é"])) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    assert manifest(df) == manifest_by_hand(rows)
    one = rows[:1]
    assert manifest(spark.createDataFrame(one, df.schema)) == manifest_by_hand(one)


def test_merkle_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    cursor = con.execute(registry.oracle_sql()["op11_merkle_manifest"])
    names = [c[0] for c in cursor.description]
    want = sorted(cursor.fetchall())
    got = registry.op11_merkle_manifest(spark, SF).select(*names).collect()
    assert sorted(tuple(r) for r in got) == want
    assert {r["verified"] for r in got} == {True, False}


# ---- byte-level encoder ----


@pytest.mark.parametrize("plain", [False, True])
def test_byte_encoder_equals_the_library(plain):
    from tokenizers import Tokenizer

    texts = ["", *texts_at_random(4000, 30), "x" * 5000, "word " * 3000]
    whole = Tokenizer.from_file(registry.BYTE_BPE)
    whole.encode_special_tokens = plain
    ids, size = encoder(registry.BYTE_BPE, plain, ByteEncoder).encode([t.encode() for t in texts])
    ends = np.cumsum(size)
    for t, n, end in zip(whole.encode_batch(texts, add_special_tokens=False), size, ends, strict=True):
        assert t.ids == ids[end - n : end].tolist()


# ---- alignment ----


def aligned_by_hand(texts):
    """Of each text: ids of both, groups as text, linked id pairs."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_side = Tokenizer.from_file(registry.BYTE_BPE)
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=registry.PIECE_BPE)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(b): b for b in printable}
    of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    for text in texts:
        a = a_side.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_side.encode(text) if text else []
        raw_a = [bytes(of[c] for c in a_side.id_to_token(i)) for i in a]
        raw_b = [bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or not (b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode()):
            yield [], [], "", []
            continue
        end_a, end_b = np.cumsum([len(x) for x in raw_a]).tolist(), np.cumsum([len(x) for x in raw_b]).tolist()
        groups, begin = [], 0
        for end in sorted(set(end_a) & set(end_b)):
            groups.append("|".join(",".join(str(i) for i, e in zip(ids, ends, strict=True) if begin < e <= end) for ids, ends in ((a, end_a), (b, end_b))))
            begin = end
        links = [(i, j) for i, e, x in zip(a, end_a, raw_a, strict=True) for j, f, y in zip(b, end_b, raw_b, strict=True) if max(e - len(x), f - len(y)) < min(e, f)]
        yield a, b, ";".join(groups), links


def alignment_by_hand(rows):
    found = [(i, *x) for (i, _), x in zip(rows, aligned_by_hand([t or "" for _, t in rows]), strict=True)]
    n = Counter(p for *_, links in found for p in set(links))
    best = defaultdict(int)
    for (a, _), k in n.items():
        best[a] = max(best[a], k)
    return sorted(((i, len(a), len(b), len(g.split(";")) if g else 0, len(links), sum(n[p] == best[p[0]] for p in links), sum(n[p] for p in links), hashlib.sha256(g.encode()).hexdigest() if g else "") for i, a, b, g, links in found), key=repr)


def alignment_of(df):
    return sorted((tuple(r) for r in alignment.cross_alignment(df, registry.BYTE_BPE, registry.PIECE_BPE).collect()), key=repr)


def test_alignment_equals_brute_force(spark, docs, odd, empty, monkeypatch):
    rows = list(enumerate([*texts_at_random(300), None, "", " ", "a"]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert alignment_of(df) == alignment_by_hand(rows)
    short = [r for r in odd.select("doc_id", "text").collect() if len(r["text"] or "") < 5000]
    assert alignment_of(spark.createDataFrame(short, "doc_id long, text string")) == alignment_by_hand([tuple(r) for r in short])
    assert len(alignment_of(odd)) == odd.count()
    assert alignment_of(empty) == []


@pytest.mark.parametrize("steps", [1, 2, 5, 64])
def test_merge_pieces_give_what_the_whole_gives(steps):
    r = np.random.default_rng(steps)
    for _ in range(50):
        end = int(r.integers(1, 60))
        a, b = (np.append(np.flatnonzero(r.random(end - 1) < 0.5) + 1, end) for _ in range(2))
        i, j = alignment.borders(a, b, steps)
        assert (np.diff(i + j) <= steps + 1).all() and i[-1] == len(a) and j[-1] == len(b)
        for x, y in zip(alignment.overlaps(a, b, steps), alignment.overlaps(a, b, 1 << 20), strict=True):
            assert x.tolist() == y.tolist()
        ends, at_a, at_b, shared = alignment.overlaps(a, b, steps)
        assert ends.tolist() == sorted({*a.tolist(), *b.tolist()})
        assert ends[shared].tolist() == sorted({*a.tolist()} & {*b.tolist()})
        assert at_a.tolist() == np.searchsorted(a, ends).tolist() and at_b.tolist() == np.searchsorted(b, ends).tolist()


def test_alignment_groups_are_those_of_the_digest(spark):
    df = spark.createDataFrame([(1, "some words to align, twice"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in alignment.cross_alignment(df, registry.BYTE_BPE, registry.PIECE_BPE, with_groups=True).collect()}
    assert hashlib.sha256(got[1]["groups"].encode()).hexdigest() == got[1]["groups_sha256"]
    assert got[2]["groups"] == got[2]["groups_sha256"] == ""


# ---- pieces of long texts ----


@pytest.mark.parametrize("at_once", [1, 3, 10, 57])
def test_long_texts_are_cut_at_unit_ends_only(monkeypatch, at_once):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=registry.PIECE_BPE)
    texts = ["".join(random.Random(i).choices([" ", "▁", "\n", "ab", "the", " ▁", "é"], k=80)) for i in range(60)]
    want = model.encode(texts)
    monkeypatch.setattr(pieces, "_AT_ONCE", at_once)
    assert [x.tolist() for x in pieces.Encoder(registry.PIECE_BPE).encode(texts)] == want


# ---- packing ----


def best_fit_by_hand(lengths, room):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fitting = [g for g in gaps if g >= n]
        gap = min(fitting, default=None)
        if gap is not None:
            gaps.remove(gap)
        gaps.append((room if gap is None else gap) - n)
    return len(gaps)


@pytest.mark.parametrize("room", [8, 40, 300])
def test_plan_packs_every_piece_as_well_as_best_fit(room):
    r = np.random.default_rng(room)
    for n in (0, 1, 7, 60, 600):
        for lengths in (r.integers(1, room + 1, n), np.minimum(room, r.geometric(6 / room, n)), r.integers(room // 2, room + 1, n), np.full(n, max(1, room // 3))):
            counts = np.bincount(lengths, minlength=room + 1)
            plan = packing.plan(counts)
            used = Counter()
            for times, own in plan:
                assert times > 0 and sum(own) <= room
                for x in own:
                    used[x] += times
            assert used == Counter(lengths.tolist())
            many = sum(times for times, _ in plan)
            assert -(-int(lengths.sum()) // room) <= many <= best_fit_by_hand(lengths.tolist(), room)


def test_exact_uses_one_two_and_three_lengths():
    counts = np.bincount([90, 10, 80, 15, 5, 70, 9, 9, 12, 33], minlength=101)
    found, rest = packing.exact(counts)
    assert sorted(found) == [(1, (70, 12, 9, 9)), (1, (80, 15, 5)), (1, (90, 10))]
    assert np.flatnonzero(rest).tolist() == [33]


def packed_rows(df, capacity, **more):
    return packing.pack(df, registry.BYTE_BPE, capacity=capacity, **more).collect()


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packing(spark, docs, odd, empty, capacity):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(registry.BYTE_BPE)
    for df in (docs, odd):
        rows = packed_rows(df, capacity)
        by_sequence, by_doc = defaultdict(list), defaultdict(list)
        for r in rows:
            by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
            by_doc[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        for own in by_sequence.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at and length > 0
                at += length
            assert at <= capacity
        want = defaultdict(list)
        for r in df.select("doc_id", "text").collect():
            ids = [*whole.encode(r["text"] or "", add_special_tokens=False).ids, 0]
            first, at = (len(ids) - 1) % capacity + 1, 0
            for k, n in enumerate([first, *[capacity] * ((len(ids) - first) // capacity)]):
                want[r["doc_id"]].append((k, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())))
                at += n
        assert {k: sorted(v) for k, v in by_doc.items()} == {k: sorted(v) for k, v in want.items()}
        bound = -(-sum(r["length"] for r in rows) // capacity)
        assert bound <= len(by_sequence) <= best_fit_by_hand([r["length"] for r in rows if r["length"] < capacity], capacity) + sum(r["length"] == capacity for r in rows)
    assert packed_rows(empty, capacity) == []


def test_sequences_hold_the_pieces_ids(spark, docs):
    found = packing.pack(docs, registry.BYTE_BPE, capacity=512, with_ids=True)
    rows = {(r["doc_id"], r["offset"], r["sequence_id"]): r for r in found.collect()}
    whole = packing.sequences(found).collect()
    assert sum(len(s["doc_ids"]) for s in whole) == len(rows)
    for s in whole:
        ids = np.frombuffer(bytes(s["ids"]), "<u2")
        assert len(ids) == s["length"] <= 512
        for d, at in zip(s["doc_ids"], s["offsets"], strict=True):
            r = rows[d, at, s["sequence_id"]]
            assert zlib.crc32(ids[at : at + r["length"]].astype("<u4").tobytes()) == r["ids_crc32"]
