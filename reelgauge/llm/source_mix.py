"""Mixing sources to target weights by pivotal dependent rounding (native Spark expressions only).

Every source gets a word target by weight, never above ``max_repeat`` times its own words. Each of
its documents starts with the same wished number of copies, target / source words: a whole part,
and a fraction p. The fractions are rounded together: two documents meet, words of one move to the
other in a random direction (so that p keeps its mean and p_a * size_a + p_b * size_b stays
equal) until one p is 0 or 1; the other meets the next document. One fold does this for a bucket of
about ``FAN_IN`` documents and leaves one fractional document at most; the leftovers of all buckets
form the buckets of the next level, a reduction tree of log_FAN_IN(documents) levels in which no
task sees more than a bucket. The root rounds its one document to the
nearer side, so the words a source takes miss its target by at most half a document.

Random numbers are hashes of the two documents and the level: reruns agree on any partitioning.
Null source: a source of its own, last in order. Null, empty or blank text: size 0, takes 0 words.
Rows alike in id, source and size are counted, not dealt: their pooled mass is whole documents and one fraction, so no bucket
grows with them. Null doc_id: kept, like any other id. Extra columns are ignored. No rows: no rows. A text of any length counts whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, materialize, split_words, unit_hash

FAN_IN = 64
WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3


def source_targets(sized: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """source, n_docs, source_size, target. The windows see one row per source, not documents.

    With the sources sorted by cap / weight, the capped ones are a prefix; the share per weight
    that the rest gets is read off running sums, the fixed point of resharing again and again.
    """
    per_source = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = per_source.withColumn(
        "weight",
        F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")),
    ).withColumn("cap", F.col("source_size").cast("double") * max_repeat)
    everything = Window.partitionBy()
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = ranked.withColumn(
        "level",
        (F.sum(F.col("source_size")).over(everything) - F.coalesce(F.sum("cap").over(by_ratio), F.lit(0.0)))
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0))),
    )
    # the levels rise along the capped prefix; the first that no later source exceeds is the largest of the valid ones' minima
    fits = F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.struct((F.col("cap") / F.col("weight")).alias("ratio"), F.col("level").alias("level")))
    shared = level.withColumn("share", F.min(fits).over(everything)["level"])
    return shared.select("source", "n_docs", "source_size", F.least(F.col("cap"), F.col("share") * F.col("weight")).alias("target"))


def _pivot(seed: Column):
    """The fold step: state (open, done) and the next document."""

    def step(state: Column, x: Column) -> Column:
        a = state["open"]
        up_a = F.least((1.0 - a["p"]) * a["size"], x["p"] * x["size"])  # words that can move from x to a
        up_x = F.least(a["p"] * a["size"], (1.0 - x["p"]) * x["size"])
        u = unit_hash(a["doc_id"], x["doc_id"], a["size"], x["size"], seed)
        to_a = u * (up_a + up_x) < up_x
        moved = F.when(to_a, up_a).otherwise(-up_x)
        a_ends = F.when(to_a, (1.0 - a["p"]) * a["size"] <= x["p"] * x["size"]).otherwise(a["p"] * a["size"] <= (1.0 - x["p"]) * x["size"])
        end_p = F.when(to_a == a_ends, F.lit(1.0)).otherwise(F.lit(0.0))
        new_a = a["p"] + moved / a["size"]
        new_x = x["p"] - moved / x["size"]

        def item(d: Column, p: Column) -> Column:
            return F.struct(d["doc_id"].alias("doc_id"), d["size"].alias("size"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)).alias("p"))

        both = F.when(a_ends, F.struct(item(x, new_x).alias("open"), item(a, end_p).alias("shut"))).otherwise(
            F.struct(item(a, new_a).alias("open"), item(x, end_p).alias("shut"))
        )
        met = F.element_at(F.transform(F.array(both), lambda r: F.struct(r["open"].alias("open"), F.concat(state["done"], F.array(r["shut"])).alias("done"))), 1)
        return F.when(a.isNull(), F.struct(x.alias("open"), state["done"].alias("done"))).otherwise(met)

    return step


_ITEM = "struct<doc_id:{0},size:bigint,p:double>"


def pivotal_rounding(fractional: DataFrame, tag: str = "mix") -> DataFrame:
    """Round p of (grp, doc_id, size > 0, p in (0, 1), buckets) to 0 or 1 within each grp.

    ``buckets`` is the group's number of first-level buckets. Returns grp, doc_id, size, p.
    """
    item_type = _ITEM.format(fractional.schema["doc_id"].dataType.simpleString())
    top = fractional.agg(F.max("buckets")).first()[0]
    left, settled, level = fractional, [], 0
    while top is not None:
        seed = F.lit(level)
        order = F.xxhash64("doc_id", "size", F.lit("order"), seed)
        bucket = F.pmod(F.xxhash64("doc_id", "size", "p", F.lit("bucket"), seed), F.col("buckets"))
        start = F.struct(F.lit(None).cast(item_type).alias("open"), F.array().cast(f"array<{item_type}>").alias("done"))
        folded = (
            left.groupBy("grp", "buckets", bucket.alias("bucket"))
            .agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "doc_id", "size", "p"))).alias("items"))
            .select(
                "grp",
                F.ceil(F.col("buckets") / FAN_IN).cast("long").alias("buckets"),
                F.aggregate(
                    F.transform("items", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["size"].alias("size"), x["p"].alias("p"))), start, _pivot(seed)
                ).alias("r"),
            )
            .select("grp", "buckets", F.col("r.open").alias("open"), F.col("r.done").alias("done"))
        )
        folded = materialize(folded, f"{tag}-level{level}")
        settled.append(folded.select("grp", F.explode("done").alias("d")).select("grp", "d.doc_id", "d.size", "d.p"))
        left = folded.select("grp", "open.doc_id", "open.size", "open.p", "buckets")
        if top <= 1:
            break
        top, level = -(-top // FAN_IN), level + 1
    else:
        return fractional.select("grp", "doc_id", "size", "p")
    last = F.when(F.col("p") >= 0.5, F.lit(1.0)).otherwise(F.lit(0.0))  # the root: nearest, at most half a document off
    out = left.select("grp", "doc_id", "size", last.alias("p"))
    for part in settled:
        out = out.unionByName(part)
    return out


def mix_sources(docs: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies, source."""
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.size(split_words(F.col(text))).cast("long").alias("size"))
    sized = materialize(sized, "mix-sizes")
    targets = source_targets(sized, weights, max_repeat).withColumnRenamed("source", "grp")
    wish = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    wished = (
        sized.join(targets, F.col("source").eqNullSafe(F.col("grp")))
        .withColumn("whole", F.floor(wish))
        .withColumn("p", wish - F.floor(wish))
    )
    open_ = (F.col("p") > 0) & (F.col("size") > 0)
    # Rows alike in id, source and size pool their mass: whole documents of it are settled, at most one fraction is left.
    alike = wished.groupBy("grp", "doc_id", "size", "p", "n_docs").agg(F.count(F.lit(1)).alias("rows"))
    mass = F.when(open_, F.col("rows") * F.col("p")).otherwise(F.lit(0.0))
    alike = materialize(alike.withColumn("settled", F.floor(mass)).withColumn("p", mass - F.floor(mass)), "mix-alike")
    open_ = F.col("p") > 0
    fractional = alike.filter(open_).select("grp", "doc_id", "size", "p", F.ceil(F.col("n_docs") / FAN_IN).cast("long").alias("buckets"))
    rounded = pivotal_rounding(fractional).select(F.col("grp").alias("its_grp"), F.col("doc_id").alias("its_id"), F.col("size").alias("its_size"), F.col("p").cast("long").alias("one"))
    same = F.col("grp").eqNullSafe(F.col("its_grp")) & F.col("doc_id").eqNullSafe(F.col("its_id")) & (F.col("size") == F.col("its_size"))
    taken = alike.join(rounded, same, "left").select("grp", "doc_id", "size", "rows", (F.col("settled") + F.coalesce("one", F.lit(0))).alias("taking"))
    taken = taken.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))).withColumn("p", (F.col("nth") <= F.col("taking")).cast("long"))
    per_source = targets.select(F.col("grp").alias("source"), "source_size", "target", F.when(F.col("source_size") > 0, F.floor(wish)).otherwise(0).cast("long").alias("whole"))
    out = taken.join(per_source, F.col("grp").eqNullSafe(F.col("source")))
    copies = F.col("whole") + F.col("p").cast("long")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"), "source")


def take_mix(docs: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """docs, each row as many times as the mix takes it. Rows alike in id, source and size are as good as each other: the first of them take what is taken."""
    mixed = mix_sources(docs, weights, max_repeat, text, source, doc_id)
    its_id, its_source, its_size, sums, rows, nth, copies, copy = free_names(docs, "its_id", "its_source", "its_size", "taken_in_all", "rows_alike", "nth_alike", "n_copies", "nth_copy")
    alike = [F.col("doc_id").alias(its_id), F.col("source").alias(its_source), F.col("size").alias(its_size)]
    taken = mixed.groupBy(*alike).agg(F.sum("copies").alias(sums), F.count(F.lit(1)).alias(rows)).filter(F.col(sums) > 0)
    size = F.size(split_words(docs[text])).cast("long")
    met = docs.join(taken, docs[doc_id].eqNullSafe(taken[its_id]) & docs[source].eqNullSafe(taken[its_source]) & (size == taken[its_size]))
    place = F.row_number().over(Window.partitionBy(its_id, its_source, its_size).orderBy(F.xxhash64(text)))
    share = F.floor(F.col(sums) / F.col(rows)) + (F.col(nth) <= F.col(sums) % F.col(rows)).cast("long")
    one = met.filter(F.col(rows) == 1).withColumn(copies, F.col(sums))
    more = met.filter(F.col(rows) > 1).withColumn(nth, place).withColumn(copies, share).drop(nth).filter(F.col(copies) > 0)
    return one.unionByName(more).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*docs.columns)
