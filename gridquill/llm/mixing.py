"""Mixing sources to target shares of the tokens.

Each source with a target gets a budget: its share of ``total`` (by default all tokens of the
targeted sources, each document once). A source is first taken whole as often as the budget
allows, at most ``max_repeats`` times; of the next round only the documents whose hash lies
under a threshold are taken. The threshold comes from histograms of tokens by source and hash
bucket: the bucket in which the budget ends is found, and only that bucket is split again,
until it holds one document (taken if that is nearer to the budget) or the hash is used up. Nothing is sorted or collected but one
row per source and level; thresholds are nested, so a larger budget only adds documents.

Sources without a target, null sources and documents without tokens (null, empty) are no part
of the mixture. A source without documents or with too few reports the share it reached.
A repeated target row counts once (the largest share). An empty table gives an empty mixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridquill.llm.tokens import VOCABULARY, count_tokens
from gridquill.session import settled

#: Bits of the hash per histogram level, and levels: 12 bits five times over.
BITS, LEVELS = 12, 5


def sized(documents: DataFrame, targets: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, source, n_tokens, h (60-bit hash) of the targeted documents, computed once."""
    wanted = F.broadcast(targets.select("source").where("source is not null").distinct())  # a row per target: a fixed, small list
    docs = documents.select("doc_id", "source", "text").join(wanted, "source", "left_semi")
    keyed = docs.withColumn("k", F.struct("doc_id", "source"))
    counts = count_tokens(keyed, "k", "text", path)
    return settled(
        counts.select("k.doc_id", "k.source", "n_tokens", F.shiftrightunsigned(F.xxhash64("k.doc_id", F.lit("mix")), 4).alias("h")).where("n_tokens > 0")
    )


def budgets(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> list[dict]:
    """Per target: tokens, whole rounds and the tokens still wanted from a partial round."""
    have = {r["source"]: r["n"] for r in sizes.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}  # one row per target
    asked = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("most")).collect()
    whole = sum(have.values()) if total is None else total
    out = []
    for t in asked:
        n, most = have.get(t["source"], 0), t["most"] or 0
        budget = (t["share"] or 0.0) * whole
        rounds = min(most, int(budget // n)) if n else 0
        out.append({"source": t["source"], "rounds": rounds, "rest": budget - rounds * n if n and rounds < most else 0.0, "budget": budget, "whole": whole})
    return out


def thresholds(sizes: DataFrame, plan: list[dict]) -> dict[str, int]:
    """The hash under which a source's documents are taken once more."""
    at = {p["source"]: 0 for p in plan}  # start of the bucket in which the budget ends
    rest = {p["source"]: p["rest"] for p in plan if p["rest"] > 0}
    open_, depth = dict.fromkeys(rest, 0), 60
    for level in range(LEVELS):
        if not open_:
            break
        shift = 60 - BITS * (level + 1)
        # the open sources with their bucket and what is wanted of it: a row each
        wanted = F.broadcast(sizes.sparkSession.createDataFrame([(x, at[x] >> depth, float(rest[x])) for x in open_], "source string, bucket bigint, wanted double"))
        inside = sizes.join(wanted, "source").where(F.shiftright("h", depth) == F.col("bucket"))
        cells = inside.groupBy("source", "wanted", F.shiftright("h", shift).alias("b")).agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("docs"))
        by = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)  # at most 2**BITS cells a source
        ends = cells.withColumn("sum", F.sum("n").over(by)).where(F.col("sum") > F.col("wanted"))
        found = ends.groupBy("source").agg(F.min_by(F.struct("b", "docs", "n", (F.col("sum") - F.col("n")).alias("before")), "b").alias("e")).collect()
        for r in found:
            s = r["source"]
            at[s], rest[s] = r["e"]["b"] << shift, rest[s] - r["e"]["before"]
            if r["e"]["docs"] == 1:
                if r["e"]["n"] - rest[s] < rest[s]:  # with it the source is nearer to its budget
                    at[s] += 1 << shift
                open_.pop(s)
        for s in set(open_) - {r["source"] for r in found}:  # the whole round fits the budget
            at[s] = 1 << 60
            open_.pop(s)
        depth = shift
    return at


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None, path: str = VOCABULARY) -> DataFrame:
    """doc_id, source, n_tokens, times: how often each document of the mixture is taken."""
    sizes = sized(documents, targets, path)
    return _taken(sizes, budgets(sizes, targets, total))


def _taken(sizes: DataFrame, plan: list[dict]) -> DataFrame:
    under = thresholds(sizes, plan)
    # a document below its source's threshold is taken once more; a row per target
    rounds = F.broadcast(sizes.sparkSession.createDataFrame([(p["source"], p["rounds"], under[p["source"]] if p["rest"] > 0 else 0) for p in plan], "source string, rounds int, under bigint"))
    times = F.col("rounds") + F.when(F.col("h") < F.col("under"), 1).otherwise(0)
    return sizes.join(rounds, "source").select("doc_id", "source", "n_tokens", times.cast("int").alias("times")).where("times > 0")


def shares(documents: DataFrame, targets: DataFrame, total: int | None = None, path: str = VOCABULARY) -> DataFrame:
    """source, target_share, max_repeats, documents, tokens, budget_tokens, share_of_total, actual_share, reached: one row per target.

    ``share_of_total`` is of the total that was to be mixed, ``actual_share`` of the mixture as it
    came out: where a source can't fill its budget the mixture is smaller and the others' actual
    shares rise. ``reached`` says whether the source came as near to its budget as one document of
    it allows, or to a hundredth.
    """
    sizes = sized(documents, targets, path)
    plan = budgets(sizes, targets, total)
    mixed = _taken(sizes, plan)
    got = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("n_tokens") * F.col("times")).alias("tokens"), F.max("n_tokens").alias("largest"))
    asked = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    out = asked.join(got, "source", "left").fillna(0, ["documents", "tokens", "largest"])
    all_ = F.sum("tokens").over(Window.partitionBy(F.lit(1)))  # one row per target
    share = F.coalesce(F.try_divide(F.col("tokens").cast("double"), all_.cast("double")), F.lit(0.0))
    wanted = F.broadcast(sizes.sparkSession.createDataFrame([(p["source"], float(p["budget"]), float(p["whole"])) for p in plan], "source string, budget double, whole double"))
    out, budget = out.join(wanted, "source", "left"), F.col("budget")
    near = F.greatest(F.col("largest").cast("double"), 0.01 * budget)
    return out.withColumns({"budget_tokens": F.round(budget).cast("bigint"), "share_of_total": F.coalesce(F.try_divide(F.col("tokens").cast("double"), F.col("whole")), F.lit(0.0)), "actual_share": share, "reached": F.abs(F.col("tokens") - budget) <= near}).drop("budget", "whole", "largest")
