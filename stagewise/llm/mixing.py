"""Mixing of sources to target weights by weighted fair queueing.

Each document waits in its source's queue in a shuffled order. Its virtual finish time is the source's cumulative
words up to and including it, divided by the source's target; a second and third pass over a source go on counting.
All documents are range-sorted by finish time and taken until the total budget is spent, so that at any point of the
order each source has had its share.

NULL text has size 0. Documents of size 0 are never taken (they bring no words). A NULL source is a source of its
own, last in order. Repeated rows queue once each. Rows that tie in the shuffled order are equal in doc_id, source
and text, so their order does not matter. Other columns of the input are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagewise.llm.common import n_words, running_sum, stored

WEIGHTS = (5, 2, 1)
MOST_PASSES = 3
SEED = "mix-1"


def _ticket(seed: str) -> Column:
    """Place of a row in the shuffled order of its source."""
    text = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    return F.md5(F.concat_ws("|", F.lit(seed), F.coalesce("source", F.lit("")), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text))


def queues(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """Rows (doc_id, source, size, ticket); the ticket is the place in the shuffled order of the source."""
    return stored(docs.select("doc_id", "source", n_words("text").alias("size"), _ticket(seed).alias("ticket")), "queues")


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """Per source: source, source_size, place (order by code point, NULL last) and target.

    Targets share the total size by weight; none exceeds `most` times its source, and what it would exceed is
    reshared by weight among the others. With sources by rising most * size / weight, the sources below one level
    stand at their bound and the others at level * weight; sums before each source give the level without rounds.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = sources.select("source", "source_size", F.col("source").isNull().alias("_last"), F.lit(1).alias("_one"))
    placed = running_sum(sources, "_one", ["_last", "source"], out="place").drop("_last", "_one")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("place") - 1, F.lit(len(weights))).cast("int") + 1)
    bounded = placed.withColumn("weight", weight).withColumn("bound", F.lit(most) * F.col("source_size"))
    bounded = bounded.withColumn("ratio", F.col("bound") / F.col("weight"))
    summed = running_sum(bounded, "weight", ["ratio", "place"], out="weights")
    summed = stored(running_sum(summed, "bound", ["ratio", "place"], out="bounds"), "levels")
    whole = summed.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("all_weights")).first()
    if not whole.total:
        return summed.select("source", "source_size", "place", F.lit(0.0).alias("target"))
    level = (F.lit(whole.total) - F.col("bounds") + F.col("bound")) / (F.lit(whole.all_weights) - F.col("weights") + F.col("weight"))
    found = summed.filter(level <= F.col("ratio")).agg(F.min_by(level, F.struct("ratio", "place"))).first()[0]
    target = F.when(F.col("ratio") < F.lit(found), F.col("bound").cast("double")).otherwise(F.lit(found) * F.col("weight"))
    return summed.select("source", "source_size", "place", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_PASSES, seed: str = SEED) -> DataFrame:
    """Per document: doc_id, source, size, ticket, source_size, target, copies (passes that take it), taken
    (copies * size) and finish (virtual finish time of its first pass; NULL for size 0)."""
    sized = queues(docs, seed)
    wanted = targets(sized, weights, most)
    # The skewed side of this join is the documents; adaptive execution splits hot sources.
    placed = sized.join(wanted.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    queued = stored(running_sum(placed, "size", ["ticket", "doc_id", "size"], by=["place"], out="cum"), "queued")
    passes = queued.filter("size > 0").select(
        "place", "cum", "size", "source_size", "target", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("nth")
    ).withColumn("words", F.col("nth") * F.col("source_size") + F.col("cum"))
    order = running_sum(passes.select((F.col("words") / F.col("target")).alias("finish"), "place", "words", "size"), "size", ["finish", "place", "words"])
    budget = sized.agg(F.sum("size")).first()[0] or 0
    last = order.filter(F.col("cum") <= budget).agg(F.max(F.struct("finish", "place", "words")).alias("last")).first().last
    keep = ["doc_id", "source", "size", "ticket", "source_size", "target"]
    finish = F.when(F.col("size") > 0, F.col("cum") / F.col("target"))
    if last is None:
        return queued.select(*keep, F.lit(0).cast("bigint").alias("copies"), F.lit(0).cast("bigint").alias("taken"), finish.alias("finish"))
    end = F.struct(F.lit(last.finish).alias("finish"), F.lit(last.place).alias("place"), F.lit(last.words).alias("words"))
    copies = sum(
        (F.when(
            (F.col("size") > 0)
            & (F.struct(((F.lit(n) * F.col("source_size") + F.col("cum")) / F.col("target")).alias("finish"), F.col("place"), (F.lit(n) * F.col("source_size") + F.col("cum")).alias("words")) <= end), 1).otherwise(0)
         for n in range(most)), F.lit(0)
    ).cast("bigint")
    return queued.select(*keep, copies.alias("copies"), (copies * F.col("size")).alias("taken"), finish.alias("finish"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_PASSES, seed: str = SEED) -> DataFrame:
    """The mixed table itself: the rows of `docs`, each as often as it is taken, range-sorted by finish time."""
    plan = mix(docs, weights, most, seed).filter("copies > 0")
    twin = F.row_number().over(Window.partitionBy("_ticket").orderBy("finish"))
    plan = plan.select(F.col("ticket").alias("_ticket"), "copies", "finish", (F.col("source_size") / F.col("target")).alias("lap")).withColumn("_twin", twin)
    # Rows with one ticket are equal in doc_id, source and text; numbering them gives each its own plan. A row travels as
    # one struct, so its columns may have any names; JSON orders twins by columns of any type. Rows of size 0 are never taken.
    quoted = {c: F.col("`" + c.replace("`", "``") + "`") for c in docs.columns}
    rest = [c for name, c in quoted.items() if name not in ("doc_id", "source", "text")]
    tie = F.to_json(F.struct(*rest)) if rest else F.lit("")
    named = docs.filter(n_words("text") > 0).select(F.struct(*quoted.values()).alias("_row"), _ticket(seed).alias("_ticket"), tie.alias("_tie"))
    named = named.withColumn("_twin", F.row_number().over(Window.partitionBy("_ticket").orderBy("_tie"))).drop("_tie")
    taken = named.join(plan, ["_ticket", "_twin"]).withColumn("_nth", F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1)))
    ordered = taken.withColumn("_finish", F.col("finish") + F.col("_nth") * F.col("lap")).repartitionByRange("_finish", "_ticket")
    return ordered.sortWithinPartitions("_finish", "_ticket").select("_row.*")
