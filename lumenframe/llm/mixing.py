"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

A source's target is a share of all words, set by its weight and capped at a multiple of the
source's own words; what a cap cuts off is dealt to the others by weight (water filling). A source
gives ``floor(target / words)`` certain copies of each document. The rest of its target is a
Pareto sample of one more copy with unequal probabilities: a document's inclusion probability is
proportional to its words, ``p = least(1, scale * size)``, with each source's scale such that the
words expected are those still owed. Documents of probability 1 are certain. The others are ranked
by random odds ``u / (1 - u)`` divided by inclusion odds ``p / (1 - p)``, and are taken in that
order. The sample has a fixed size in words, as targets are in words: taking goes on past each
document that would take too much until none that is left fits, and ends with one more document
if that brings the words nearer to the target.

No step orders a source's documents in one task. Ranks are cut into buckets, words are summed by
(source, bucket), and only the bucket that holds a source's first cut is ordered. What is owed after
it is less than one document, so of each size only the first few documents in order can be taken;
these alone (their number depends on the longest document, not on the corpus) are gone through
in turn. One task handles the table of sources, and the sizes that occur in a source: sources
are taken to be few, and sizes are at most as many as the longest document has words.

Defined cases: a null text has size 0; a null source is a source of its own, after all others; a
source without words has target 0 and takes nothing; rows that agree in id, source and text share
a rank and are taken together; a very long text is one document like any other; an empty table
gives an empty result. Extra columns are ignored by ``mix_plan`` and kept by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.llm.scratch import discard, materialize

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 4096


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(seed: int, *columns: Column) -> Column:
    """A number in (0, 1) that depends on the columns' values and the seed alone."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 12).cast("double")
    return (bits + 0.5) / float(1 << 52)


def water_fill(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """``sizes`` has one row per source: source, source_size. Adds target."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("_k", (F.row_number().over(by_name) - 1) % len(weights))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("_k").cast("int") + 1)
    everything = Window.partitionBy()
    filled = (
        ranked.withColumn("_w", weight)
        .withColumn("_limit", F.col("source_size") * float(cap))
        .withColumn("_total", F.sum("source_size").over(everything) * float(share))
        .withColumn("_weights", F.sum("_w").over(everything))
    )
    by_ratio = Window.orderBy(F.col("_limit") / F.col("_w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    filled = (
        filled.withColumn("_spent", F.coalesce(F.sum("_limit").over(before), F.lit(0.0)))
        .withColumn("_gone", F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
        .withColumn("_level", (F.col("_total") - F.col("_spent")) / (F.col("_weights") - F.col("_gone")))
        # the first source below its limit sets the level for all later ones
        .withColumn("_open", F.col("_level") * F.col("_w") < F.col("_limit"))
        .withColumn("_level", F.min(F.when(F.col("_open"), F.struct(F.row_number().over(by_ratio).alias("_r"), "_level"))).over(everything)["_level"])
    )
    target = F.least(F.coalesce(F.col("_level") * F.col("_w"), F.col("_limit")), F.col("_limit"))
    return filled.select("source", "source_size", target.alias("target"))


def inclusion_scale(slim: DataFrame, sources: DataFrame) -> DataFrame:
    """source, scale: least(1, scale * size) summed over a source's words is what is owed (rest).

    Sizes are gone through from the largest; those passed are certain. The scale is that of the
    first size at which what is still owed gives probabilities of 1 at most.
    """
    sizes = slim.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    sizes = same_source(sizes, sources.where("rest > 0").select("source", "rest"))
    size, n = F.col("size").cast("double"), F.col("n").cast("double")
    larger = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    smaller = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scale = (F.col("rest") - F.coalesce(F.sum(size * n).over(larger), F.lit(0.0))) / F.sum(size * size * n).over(smaller)
    fits = sizes.withColumn("scale", scale).where(F.col("scale") * size <= 1)
    return fits.groupBy("source").agg(F.max_by("scale", "size").alias("scale"))


def mix_plan(docs: DataFrame, weights=(5, 2, 1), share: float = 1.0, cap: float = 3.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(documents, sources). Documents: doc_id, source, size, u; sources: source, source_size,
    target, certain (copies), scale (of the inclusion probabilities), cut (the last rank of those
    taken without a gap), more (the ranks taken beyond it)."""
    u = uniform(seed, F.col(id_col), F.col(source_col), F.col(text_col))
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), u.alias("u"))
    slim = materialize(slim, "mix-sizes")
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = (
        water_fill(sizes, weights, share, cap)
        .withColumn("certain", F.floor(ratio + F.lit(1e-12)).cast("long"))
        .withColumn("rest", F.greatest(F.col("target") - F.col("certain") * F.col("source_size"), F.lit(0.0)))
    )
    owing = materialize(sources.coalesce(1), "mix-sources")
    sources = materialize(same_source(owing, inclusion_scale(slim, owing), "left").coalesce(1), "mix-scales")
    ranked = with_rank(slim, sources.where("scale > 0")).where("p > 0").select("source", "size", "rank", "rest")
    cuts = materialize(first_cut(ranked), "mix-cuts")
    more = go_on(ranked.drop("rest"), cuts)
    plan = same_source(same_source(sources, cuts.select("source", "cut"), "left"), more, "left")
    plan = materialize(plan.select("source", "source_size", "target", "certain", "scale", "cut", "more").coalesce(1), "mix-plan")
    for done in (owing, sources, cuts):
        discard(done)
    return slim, plan


def first_cut(ranked: DataFrame) -> DataFrame:
    """source, cut, gap: the last rank up to which all documents' words stay within what is owed
    (rest), and the words then still owed."""
    counts = ranked.groupBy("source", "rest", bucket(F.col("rank")).alias("b")).agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source", "rest").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    edges = (
        counts.withColumn("below", F.coalesce(F.sum("words").over(before), F.lit(0)))
        .where("below <= rest").groupBy("source", "rest")
        .agg(F.max_by("b", "b").alias("edge"), F.max_by("below", "b").alias("below"))
    )
    edges = materialize(edges, "mix-edges")
    inside = same_source(ranked.drop("rest"), edges).where(bucket(F.col("rank")) == F.col("edge"))
    ties = inside.groupBy("source", "rank", "below", "rest").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = (
        ties.withColumn("after", F.col("below") + F.sum("words").over(upto))
        .where("after <= rest").groupBy("source").agg(F.max(F.struct("rank", "after")).alias("last"))
    )
    # where no rank of the edge's bucket is taken, all buckets below it are
    floor = F.col("edge") / float(BUCKETS) - F.lit(1e-15)
    gap = F.col("rest") - F.coalesce("last.after", "below")
    return same_source(edges, last, "left").select("source", F.coalesce("last.rank", floor).alias("cut"), gap.alias("gap"))


def go_on(ranked: DataFrame, cuts: DataFrame) -> DataFrame:
    """source, more: the ranks over the cut that are taken one by one as far as they fit the gap, and
    then the first that brings the words nearer to what is owed.

    Of one size only the first gap / size documents can fit, and one of up to twice the gap can end
    it. They lie in the first buckets that hold as many, so counts by (source, size, bucket) tell
    which rows can matter.
    """
    rows = same_source(ranked, cuts).where("gap > 0 and rank > cut and size < 2 * gap")
    units = materialize(rows.groupBy("source", "gap", "rank").agg(F.sum("size").alias("size")).where("size < 2 * gap"), "mix-rest")
    enough = F.greatest(F.floor(F.col("gap") / F.col("size")), F.lit(1))
    counts = units.groupBy("source", "gap", "size", bucket(F.col("rank")).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("source", "gap", "size").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    needed = counts.withColumn("sooner", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("sooner") < enough)
    ends = needed.groupBy("source", "size").agg(F.max("b").alias("b"))
    ends = materialize(ends, "mix-ends").select(F.col("source").alias("_source"), F.col("size").alias("_size"), "b")
    near = units.join(ends, units["source"].eqNullSafe(ends["_source"]) & (F.col("size") == F.col("_size")) & (bucket(F.col("rank")) <= F.col("b")))
    order = Window.partitionBy("source", "gap", "size").orderBy("rank")
    near = near.withColumn("k", F.row_number().over(order)).where(F.col("k") <= enough)
    lists = near.groupBy("source", "gap").agg(F.array_sort(F.collect_list(F.struct("rank", "size"))).alias("units"))
    filled = F.expr(
        "aggregate(units, named_struct('gap', cast(gap as double), 'more', cast(array() as array<double>)), (a, t) -> if(t.size <= a.gap, "
        "named_struct('gap', a.gap - t.size, 'more', array_append(a.more, t.rank)), a))"
    )
    lists = lists.withColumn("f", filled)
    last = F.expr("filter(units, t -> t.size > f.gap and t.size < 2 * f.gap and not array_contains(f.more, t.rank))")
    return lists.select("source", F.when(F.size(last) > 0, F.array_append("f.more", F.get(last, F.lit(0))["rank"])).otherwise(F.col("f.more")).alias("more"))


def with_rank(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds p, the inclusion probability of one more copy, and rank in [0, 1]: q / (1 + q) of q, random
    odds by inclusion odds; 0 for certain documents, 1 for those that cannot be taken."""
    joined = same_source(docs, sources)
    joined = joined.withColumn("p", F.least(F.coalesce(F.col("scale") * F.col("size"), F.lit(0.0)), F.lit(1.0)))
    q = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    rank = F.when(F.col("p") >= 1, 0.0).when(F.col("p") > 0, q / (1 + q)).otherwise(1.0)
    return joined.withColumn("rank", rank)


def bucket(rank: Column) -> Column:
    return F.floor(rank * BUCKETS)


def same_source(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join by source where null equals null, keeping one source column."""
    right = right.withColumnRenamed("source", "_source")
    return left.join(right, left["source"].eqNullSafe(right["_source"]), how).drop("_source")


def copies() -> Column:
    """Times a ranked document is taken."""
    held = (F.col("rank") <= F.col("cut")) | F.array_contains("more", F.col("rank"))
    return F.col("certain") + F.when((F.col("p") > 0) & held, 1).otherwise(0)


def mix_sizes(docs: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, source, copies."""
    slim, plan = mix_plan(docs, **how)
    out = with_rank(slim, plan).withColumn("copies", copies())
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as often as the plan takes it."""
    slim, plan = mix_plan(docs, **how)
    id_col, text_col, source_col = how.get("id_col", "doc_id"), how.get("text_col", "text"), how.get("source_col", "source")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    u = uniform(how.get("seed", 17), F.col(id_col), F.col(source_col), F.col(text_col))
    held = docs.select(row, F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), u.alias("u"))
    taken = with_rank(held, plan).withColumn("copies", copies()).where("copies > 0")
    taken = taken.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    discard(slim)
    return taken.select("_row.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sizes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op10_mixing": op10_mixing}
ORACLES: dict[str, str] = {}
