"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Every document has a rate between 0 and `most` copies. Among all rates whose words meet each source's
target, the ones nearest to an even mix in relative entropy are sought: minimise
sum_i u_i * KL(r_i / most || 1/2) subject to sum_{i in s} size_i * r_i = target_s, with the stake
u_i = size_i / log1p(size_i) of a document in the entropy. The solution is the exponential tilt
r_i = most * sigmoid(lambda_s * log1p(size_i)); its multipliers maximise a concave dual, which Newton
steps solve with one grouped sum over the table of (source, size) classes each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliploom.llm.common import checkpoint, row_hash, settled, stored, unused

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)


def with_words(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the number of words (runs of anything but white space); null texts have none.

    Byte searches instead of a pattern: white space becomes blanks, runs of blanks shrink to one, and
    the blanks between words are counted. Only texts with runs of over 16 are matched by a pattern.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    for c in "\t\n\x0b\f\r":
        t = F.replace(t, F.lit(c), F.lit(" "))
    for _ in range(4):
        t = F.replace(t, F.lit("  "), F.lit(" "))
    blanks = F.octet_length("_t") - F.octet_length(F.replace("_t", F.lit(" "), F.lit("")))
    n = (
        F.when(F.col("_t") == "", 0)
        .when(F.contains("_t", F.lit("  ")), F.regexp_count("_t", F.lit("[^ ]+")))
        .otherwise(blanks + 1)
    )
    return df.withColumn("_t", F.trim(t)).withColumn(out, n.cast("long")).drop("_t")


def targets(sizes: DataFrame, share: float, most: float, weights=WEIGHTS) -> DataFrame:
    """sizes (source, size) -> (source, source_size, target), one row per source.

    The sources take `share` of all words by weight; where that is above `most` times a source's own
    words it stops there, and the excess goes to the others by weight until none is above. With the
    sources sorted by capacity per weight, the capped ones are a prefix, found by running sums over
    the table of sources (one row each, so the single sorted window is as long as that table).
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    per = (
        per.withColumn("rank", F.row_number().over(order) - 1)
        .withColumn("weight", weight)
        .withColumn("cap", most * F.col("source_size"))
        .withColumn("budget", share * F.sum("source_size").over(everything))
    )
    before = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    per = (
        per.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("budget") - F.col("cap_before")) / F.col("weight_left"))
        .withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    )
    # the first source that is not capped sees the level at which all the open ones stand
    first = F.min_by("level", F.when(~F.col("capped"), F.col("cap") / F.col("weight"))).over(everything)
    return per.select(
        "source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(first * F.col("weight")).alias("target")
    )


def _rate(most: float) -> Column:
    return F.when(F.col("full"), most).otherwise(most / (1 + F.exp(-F.col("lam") * F.log1p("size"))))


def tilts(classes: DataFrame, goal: DataFrame, most: float, steps: int = 60) -> DataFrame:
    """(source, target, full, lam): each source's multiplier, by Newton steps kept inside a bracket.

    classes (source, size, n); goal (source, source_size, target). A source whose target is all it may
    give is `full`: its multiplier would be infinite. Each step is one job over the classes, whose sums
    are combined before the shuffle; the state is one row per source and is checkpointed. Raises if a
    source's words aren't met after `steps`.
    """
    state = checkpoint(
        goal.filter("source_size > 0").select(
            "source",
            "target",
            (F.col("target") >= most * F.col("source_size") * (1 - 1e-12)).alias("full"),
            F.lit(0.0).alias("lam"),
            F.lit(-64.0).alias("lo"),
            F.lit(64.0).alias("hi"),
            F.lit(False).alias("done"),
        )
    )
    keys = ["source", "target", "full", "lam", "lo", "hi"]
    for _ in range(steps):
        open_ = state.filter("not done and not full")
        if open_.isEmpty():
            break
        p = 1 / (1 + F.exp(-F.col("lam") * F.log1p("size")))
        words = most * F.col("n") * F.col("size")
        moved = (
            classes.join(open_.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
            .groupBy(*keys)
            .agg((F.sum(words * p) - F.col("target")).alias("g"), F.sum(words * p * (1 - p) * F.log1p("size")).alias("h"))
            .withColumn("hi", F.when(F.col("g") > 0, F.col("lam")).otherwise(F.col("hi")))
            .withColumn("lo", F.when(F.col("g") > 0, F.col("lo")).otherwise(F.col("lam")))
            .withColumn("next", F.col("lam") - F.col("g") / F.col("h"))
            .withColumn(
                "next",
                F.when((F.col("next") > F.col("lo")) & (F.col("next") < F.col("hi")), F.col("next")).otherwise(
                    (F.col("lo") + F.col("hi")) / 2
                ),
            )
            .withColumn("done", F.abs("g") <= 1e-7 * F.col("target") + 1e-3)
            .select("source", "target", "full", F.when(F.col("done"), F.col("lam")).otherwise(F.col("next")).alias("lam"), "lo", "hi", "done")
        )
        state = checkpoint(state.filter("done or full").union(moved))
    else:
        if not state.filter("not done and not full").isEmpty():
            raise ArithmeticError(f"the words of a source don't meet its target after {steps} steps")
    return state.select("source", "target", "full", F.round("lam", 9).alias("lam"))


def copies_per_class(classes: DataFrame, tilt: DataFrame, most: int, repairs: int = 8) -> DataFrame:
    """(source, size, n, k): how many copies the n documents of a class get together.

    Rates are rounded by running sums over a source's sizes, so each class is within one copy of its
    rate and the error of a source is below one large document; single copies of ever smaller
    documents then close what is left.
    """
    rated = classes.join(tilt.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).select(
        "source", "size", "n", "target", _rate(most).alias("rate")
    )
    run = Window.partitionBy("source").orderBy("size")
    upto = F.floor(F.sum(F.col("n") * F.col("rate")).over(run) + 0.5)
    k = checkpoint(
        rated.withColumn("upto", upto)
        .withColumn("k", F.col("upto") - F.coalesce(F.lag("upto").over(run), F.lit(0)))
        .select("source", "size", "n", "target", F.least(F.col("k"), most * F.col("n")).cast("long").alias("k"))
    )
    for _ in range(repairs):
        off = k.groupBy("source").agg((F.first("target") - F.sum(F.col("k") * F.col("size"))).alias("off"))
        fits = k.join(off.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).filter(
            (F.col("size") > 0)
            & (F.col("size") <= F.abs("off") * 1.5)
            & F.when(F.col("off") > 0, F.col("k") < most * F.col("n")).otherwise(F.col("k") > 0)
        )
        step = checkpoint(
            fits.groupBy("source").agg(F.max("size").alias("pick"), F.first(F.signum("off")).cast("long").alias("by"))
        )
        if step.isEmpty():
            break
        k = checkpoint(
            k.join(
                step.withColumnRenamed("source", "_s"),
                F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("pick")),
                "left",
            )
            .withColumn("k", F.col("k") + F.coalesce("by", F.lit(0)))
            .select("source", "size", "n", "target", "k")
        )
    return k.select("source", "size", "n", "k")


def mix(docs: DataFrame, share: float = 1.5, most: int = 2, block: int = 256) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, taken (= copies * size), row_hash.

    Copies are dealt inside a class of equal source and size by the order of a hash of doc_id and text, in
    blocks of about `block` documents with exact quotas, so a class that holds much of the table is
    never in one task. Results do not change between runs. Null texts have size 0 and take nothing;
    the null source is a source of its own, ordered last; null doc_ids and repeated rows are documents
    like others; an empty table gives no rows. No source exceeds `most` times its words, no document
    `most` copies.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text", row_hash().alias("row_hash"))
    sizes = stored(with_words(docs, "text", "size").drop("text"), "sizes")
    goal = checkpoint(targets(sizes, share, most))
    classes = checkpoint(sizes.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    shared = checkpoint(copies_per_class(classes, tilts(classes, goal, float(most)), most))
    # sources without any word are in no constraint: their documents stay once
    plan = (
        classes.join(
            shared.select(F.col("source").alias("_s"), F.col("size").alias("_z"), "k"),
            F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")),
            "left",
        )
        .join(goal.withColumnRenamed("source", "_g"), F.col("source").eqNullSafe(F.col("_g")))
        .select(
            F.col("source").alias("_s"),
            F.col("size").alias("_z"),
            "n",
            F.coalesce("k", "n").alias("k"),
            "source_size",
            "target",
            F.ceil(F.col("n") / F.lit(block)).alias("blocks"),
        )
    )
    dealt = (
        sizes.join(plan, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")))
        .withColumn("h", F.xxhash64("doc_id", "row_hash", F.lit("mix")))
        .withColumn("b", F.pmod("h", F.col("blocks")))
    )
    upto = Window.partitionBy("_s", "_z").orderBy("b")
    quota = (
        dealt.groupBy("_s", "_z", "b", "n", "k")
        .agg(F.count(F.lit(1)).alias("m"))
        .withColumn("end", F.sum("m").over(upto))
        .withColumn("extra", F.pmod("k", F.col("n")))
        .withColumn(
            "quota",
            F.expr("(extra * end) div n - (extra * (end - m)) div n"),
        )
        .select(F.col("_s").alias("_qs"), F.col("_z").alias("_qz"), F.col("b").alias("_qb"), "quota")
    )
    place = F.row_number().over(Window.partitionBy("_s", "_z", "b").orderBy("h", "doc_id", "row_hash"))
    return (
        dealt.withColumn("place", place)
        .join(
            quota,
            F.col("_s").eqNullSafe(F.col("_qs")) & (F.col("_z") == F.col("_qz")) & (F.col("b") == F.col("_qb")),
        )
        .withColumn("copies", (F.expr("k div n") + F.when(F.col("place") <= F.col("quota"), 1).otherwise(0)).cast("int"))
        .select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), "copies", (F.col("copies") * F.col("size")).alias("taken"), "row_hash")
    )


def mixed(docs: DataFrame, share: float = 1.5, most: int = 2) -> DataFrame:
    """docs in the mix: each row as often as it has copies, all columns kept with their values.

    Rows of one doc_id and text each get the most copies that one of them has.
    """
    key, text, many, copy = unused(docs.columns, "_id", "_hash", "_copies", "_copy")
    last = F.lit((1 << 63) - 1)

    def plan() -> DataFrame:
        each = mix(docs, share, most).groupBy(F.coalesce("doc_id", last).alias(key), F.col("row_hash").alias(text))
        return each.agg(F.max("copies").alias(many)).filter(F.col(many) > 0)

    keyed = docs.withColumns({key: F.coalesce(F.col("doc_id").cast("long"), last), text: row_hash()})
    taken = keyed.join(settled(docs.sparkSession, plan, "copies"), [key, text])
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(many)))).select(*docs.columns)
