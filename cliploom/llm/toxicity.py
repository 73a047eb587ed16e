"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cliploom.llm.common import stored, utf8
from cliploom.llm.labelled import held_out, sample

#: General insults, the part of the lexicon that needs no labels.
SEED_WORDS = frozenset(
    "bastard clown coward cretin degenerate despicable disgusting dumb dumbass filth fool freak garbage "
    "idiot imbecile jerk liar loser lunatic maggot moron pathetic revolting scum shameful slob stupid "
    "trash useless vermin vile worthless wretch "
    "arschloch abschaum dummkopf trottel versager widerlich wertlos "
    "abruti connard cretin imbecile minable ordure pourri salaud "
    "asqueroso basura escoria estupido imbecil inutil patetico".split()
)
#: Second-person words of the four languages.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur thou du dich dir dein deine deiner ihr euch tu te toi ton ta tes vous votre vos "
    "ti tus usted ustedes vosotros".split()
)
#: Characters that stand for letters in disguised words.
DISGUISE = str.maketrans("0134578@$!|+", "oieastbasiit")

NAMES = (
    "seed_rate", "seed_log", "learned_rate", "learned_log", "disguised_rate", "near_second", "second_rate",
    "capitals", "shouted_words", "exclaim", "punctuation", "obfuscated", "stretched", "words_log",
)
_SEED, _LEARNED, _DISGUISED, _SECOND, _SHOUT, _OBFUSCATED, _STRETCHED = (1 << i for i in range(7))
_CACHED = 400_000


def stems(word: str) -> list[str]:
    """What the lexicon may hold of a word: its first 4 to 10 letters and the whole of it."""
    return [word[:k] for k in range(4, min(10, len(word)) + 1)] + [word + "$"]


_STRETCH = re.compile(r"([^\W\d_])\1\1")
_EDGES = ".,;:!?\"'()[]{}#$%&*|~-_"


def _flags(word: bytes, learned: frozenset[str], heads: frozenset[str]) -> int:
    """heads: the first four letters of all that is learned, to pass over most words."""
    raw = word.decode("utf-8", "replace").strip(_EDGES)
    low = raw.lower()
    found = 0
    if low in SEED_WORDS:
        found |= _SEED
    if low[:4] in heads and any(s in learned for s in stems(low)):
        found |= _LEARNED
    if low in SECOND_PERSON:
        found |= _SECOND
    if len(raw) > 2 and raw.isupper():
        found |= _SHOUT
    if not raw.isalpha() and not raw.replace("-", "").replace("'", "").isalpha() and sum(map(str.isalpha, raw)) > 1:
        found |= _OBFUSCATED
        plain = "".join(filter(str.isalpha, low.translate(DISGUISE)))
        if plain in SEED_WORDS or plain[:4] in heads and any(s in learned for s in stems(plain)):
            found |= _DISGUISED
    if _STRETCH.search(low):
        found |= _STRETCHED
    return found


class _Words:
    """Flags of words, remembered over the documents of a task up to a fixed number of words."""

    def __init__(self, learned: frozenset[str]):
        self.learned, self.known = learned, {}
        self.heads = frozenset(s.rstrip("$")[:4] for s in learned)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > _CACHED:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = _flags(w, self.learned, self.heads)
        return np.fromiter(map(known.__getitem__, words), np.uint8, len(words))


_PUNCT = np.zeros(256, bool)
_PUNCT[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True


def features(text: bytes, flags_of: _Words) -> np.ndarray:
    """Dense features of a whole text; all zero for texts without words."""
    x = np.zeros(len(NAMES))
    words = text.split()
    n = len(words)
    if not n:
        return x
    flags = flags_of(words)
    count = [int(np.count_nonzero(flags & f)) for f in (_SEED, _LEARNED, _DISGUISED, _SECOND, _SHOUT, _OBFUSCATED, _STRETCHED)]
    bad = np.flatnonzero(flags & (_SEED | _LEARNED | _DISGUISED))
    second = np.flatnonzero(flags & _SECOND)
    if len(bad) and len(second):
        # words of the lexicon with a second-person word at most five words away
        at = np.searchsorted(second, bad)
        gap = np.minimum(
            np.abs(second[np.minimum(at, len(second) - 1)] - bad), np.abs(second[np.maximum(at - 1, 0)] - bad)
        )
        x[5] = np.count_nonzero(gap <= 5) / n
    chars = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    x[0], x[1] = count[0] / n, np.log1p(count[0])
    x[2], x[3] = count[1] / n, np.log1p(count[1])
    x[4] = count[2] / n
    x[6] = count[3] / n
    x[7] = chars[65:91].sum() / len(text)
    x[8] = count[4] / n
    x[9] = (chars[33] + chars[63]) / len(text)
    x[10] = chars[_PUNCT].sum() / len(text)
    x[11] = count[5] / n
    x[12] = count[6] / n
    x[13] = np.log1p(n)
    return x


def learned_lexicon(rows: DataFrame, least: float = 0.6, most: int = 4000) -> frozenset[str]:
    """Stems that mark toxic rows of a bounded sample (text, label): those for which the lower end of the
    95 % interval of P(toxic | stem) is at least `least`, the `most` commonest of them.

    Near copies would make any word of a much copied toxic text look like a mark, so rows that share
    a smallest shingle hash (two of them) count once. Documents are counted in Spark; what comes to
    the driver is bounded by `most`.
    """

    def sketch(batches):
        import xxhash

        for batch in batches:
            out = []
            for t in batch.column("t").to_pylist():
                w = t.split()
                grams = {b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))}
                out.append([min(xxhash.xxh64_intdigest(g, s) for g in grams) >> 1 for s in (1, 2)])
            one, two = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("t"), batch.column("label"), pa.array(one, pa.int64()), pa.array(two, pa.int64())],
                names=["doc_id", "t", "label", "one", "two"],
            )

    def count(batches):
        for batch in batches:
            seen, toxic = Counter(), Counter()
            for t, label in zip(batch.column("t").to_pylist(), batch.column("label").to_pylist(), strict=True):
                words = {w.strip(_EDGES).lower() for w in t.decode("utf-8", "replace").split()}
                own = {s for w in words if len(w) > 3 for s in stems(w)}
                seen.update(own)
                if label:
                    toxic.update(own)
            yield pa.RecordBatch.from_pydict(
                {"stem": list(seen), "n": pa.array(list(seen.values()), pa.int64()), "x": pa.array([toxic[s] for s in seen], pa.int64())}
            )

    distinct = (
        rows.select("doc_id", utf8().alias("t"), "label")
        .mapInArrow(sketch, "doc_id long, t binary, label int, one long, two long")
        .groupBy("one")
        .agg(F.min_by(F.struct("t", "label", "two", "doc_id"), "doc_id").alias("r"))
        .groupBy("r.two")
        .agg(F.min_by(F.struct("r.t", "r.label"), "r.doc_id").alias("r"))
        .select("r.t", "r.label")
    )
    z = 1.96
    p = F.col("x") / F.col("n")
    low = (p + z * z / (2 * F.col("n")) - z * F.sqrt(p * (1 - p) / F.col("n") + z * z / (4 * F.col("n") * F.col("n")))) / (
        1 + z * z / F.col("n")
    )
    found = (
        distinct.mapInArrow(count, "stem string, n long, x long")
        .groupBy("stem")
        .agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        .filter(low >= least)
        .orderBy(F.col("x").desc(), "stem")
        .limit(most)
    )
    return frozenset(r["stem"] for r in found.select("stem").collect())


def featured(docs: DataFrame, learned: frozenset[str], *keep: str) -> DataFrame:
    """keep columns and one double column for each feature, from whole texts."""
    kept = docs.select(*keep, utf8().alias("_t"))
    schema = T.StructType([*kept.schema.fields[:-1], *[T.StructField(n, T.DoubleType()) for n in NAMES]])

    def run(batches):
        flags_of = _Words(learned)
        for batch in batches:
            f = np.array([features(t, flags_of) for t in batch.column("_t").to_pylist()]).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *[pa.array(np.ascontiguousarray(c)) for c in f.T]], names=[*keep, *NAMES]
            )

    return kept.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, most: int = 24_000, trees: int = 20, depth: int = 3) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (score >= 0.7).

    Of a sample of at most `most` labelled rows outside the held-out fold, a half gives the lexicon,
    a quarter the trees, and a quarter, which neither has seen, the isotonic map from margin to
    probability. Beyond the margins of that quarter the map goes on with its first and last value; a
    quarter without rows of both labels makes no map, and the trees' own probability is the score. Labels, lang,
    source and doc_id are no inputs of a score; every row is scored by its whole text. Null and empty
    texts have a score like any other, null doc_ids aren't held out, repeated rows are scored alike,
    an empty table gives no rows, and without labels of both kinds every score is the labels' mean.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = stored(sample(docs, labels, "toxic", most), "labelled")
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(8))
    learned = learned_lexicon(rows.filter(part < 4))
    known = stored(featured(rows.filter(part >= 4), learned, "doc_id", "label"), "features").withColumn("part", part)
    each = featured(docs, learned, "doc_id")
    if known.filter("part < 6").select("label").distinct().count() < 2:
        mean = rows.agg(F.coalesce(F.avg("label"), F.lit(0.0))).first()[0]
        scored = each.select("doc_id", F.lit(float(mean)).alias("score"))
    else:
        scored = _boosted(known, each, trees, depth)
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def _boosted(known: DataFrame, each: DataFrame, trees: int, depth: int) -> DataFrame:
    vector = VectorAssembler(inputCols=list(NAMES), outputCol="features")
    gbt = GBTClassifier(
        labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=7, minInstancesPerNode=2, cacheNodeIds=False
    )
    # a few partitions only: the sample is bounded
    fitted = gbt.fit(vector.transform(known.filter("part < 6")).select("features", "label").coalesce(4))

    def margin(df: DataFrame, *keep: str) -> DataFrame:
        return fitted.transform(vector.transform(df)).select(*keep, vector_to_array("rawPrediction")[1].alias("margin"))

    unseen = margin(known.filter("part >= 6"), F.col("label").cast("double").alias("label")).coalesce(1)
    scored = margin(each, "doc_id")
    if unseen.select("label").distinct().count() < 2:
        return scored.select("doc_id", (1 / (1 + F.exp(-2 * F.col("margin")))).alias("score"))
    scored = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="score").fit(unseen).transform(scored)
    return scored.select("doc_id", F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)).alias("score"))
