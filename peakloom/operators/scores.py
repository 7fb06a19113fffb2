"""Losses and matching costs over score tables: the boundary to a model that runs elsewhere.

slots: (uid, slot, presence_logit, intensity); scores: (uid, slot, log_probs ARRAY<DOUBLE> by candidate index); members:
(uid, target, candidate_index); assignment: (uid, slot, target). A spectrum has at most 64 slots and 64 targets, its
candidates have no bound: scores and bags stay nested, so that a spectrum costs rows for its slots and not for every
pair of slot and candidate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakloom.functions import scalar
from peakloom.functions.chem import let

FLOOR, TINY = -1e9, 1e-30


#: Values are summed by exponent in steps of this, which keeps every partial sum inside the range of doubles.
_STEP = 512.0


def log_sum_exp(df: DataFrame, keys: Sequence[str], value: str, name: str = "lse") -> DataFrame:
    """(keys, name): the logarithm of the summed exponentials, values floored at -1e9.

    One pass: sums by (keys, exponent step) combine on the map side, and the few steps of a key are then merged. No
    key is collected or read twice, however many rows it has.
    """
    v = F.greatest(F.col(value), F.lit(FLOOR))
    step = F.floor(v / _STEP).cast("double")
    parts = df.select(*keys, step.alias("__step"), F.exp(v - step * _STEP).alias("__e")).groupBy(*keys, "__step").agg(F.sum("__e").alias("__e"))
    steps = F.collect_list(F.struct("__step", "__e"))  # bounded by the range of doubles over the step
    merged = parts.where("__step IS NOT NULL").groupBy(*keys).agg(F.max("__step").alias("__top"), steps.alias("__parts"))
    total = F.aggregate("__parts", F.lit(0.0), lambda acc, p: acc + p["__e"] * F.exp((p["__step"] - F.col("__top")) * _STEP))
    return merged.select(*keys, (F.col("__top") * _STEP + F.log(total)).alias(name))


def log_sum_exp_of(values: Column) -> Column:
    """The same of an array inside its row; null for an empty one."""
    floored = F.transform(values, lambda v: F.greatest(v, F.lit(FLOOR)))

    def summed(v: Column) -> Column:
        top = F.array_max(v)
        return top + F.log(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + F.exp(x - top)) + F.lit(TINY))

    return F.when(F.size(values) > 0, let(floored, summed))


def merge_log_sum_exp(parts: DataFrame, keys: Sequence[str], top: str = "m", total: str = "s", name: str = "lse") -> DataFrame:
    """The exact log-sum-exp from chunks that carry (maximum, sum of exponentials less that maximum)."""
    whole = F.max(top).over(Window.partitionBy(*keys))
    scaled = parts.withColumn("__m", whole).withColumn("__s", F.col(total) * F.exp(F.col(top) - F.col("__m")))
    return scaled.groupBy(*keys).agg((F.max("__m") + F.log(F.sum("__s") + F.lit(TINY))).alias(name))


def bags_of(members: DataFrame, uid: str = "uid") -> DataFrame:
    """(uid, target, bag ARRAY<INT>): the candidate indices that may explain a target, each once, in order."""
    return members.groupBy(uid, "target").agg(F.array_sort(F.collect_set("candidate_index")).alias("bag"))


def _picked(log_probs: str, bag: Column) -> Column:
    """The scores of a bag's candidates; a candidate without a score is none."""
    return F.array_compact(F.transform(bag, lambda i: F.get(F.col(log_probs), i)))


def bag_log_probability(scores: DataFrame, members: DataFrame, uid: str = "uid") -> DataFrame:
    """(uid, slot, target, bag_log_prob) of every slot and target.

    A row per slot carries its scores and the spectrum's bags; the sums are made inside it.
    """
    nested = bags_of(members, uid).groupBy(uid).agg(F.array_sort(F.collect_list(F.struct("target", "bag"))).alias("bags"))
    each = F.transform("bags", lambda b: F.struct(b["target"].alias("target"), log_sum_exp_of(_picked("log_probs", b["bag"])).alias("bag_log_prob")))
    made = scores.join(nested, uid).select(uid, "slot", F.explode(each).alias("b"))
    return made.select(uid, "slot", "b.target", "b.bag_log_prob").where("bag_log_prob IS NOT NULL")


def matching_costs(scores: DataFrame, members: DataFrame, slots: DataFrame, targets: DataFrame, uid: str = "uid", weight: float = 0.25,
    delta: float = 1.0) -> DataFrame:
    """(uid, slot, target, cost): bag NLL plus the weighted Huber distance of contribution and target intensity.

    slots: (uid, slot, contribution); targets: (uid, target, t). Intensities ride along with the scores and bags.
    """
    known = bags_of(members, uid).join(targets.select(uid, "target", "t"), [uid, "target"])
    nested = known.groupBy(uid).agg(F.array_sort(F.collect_list(F.struct("target", "t", "bag"))).alias("bags"))

    def cost(b: Column) -> Column:
        return -log_sum_exp_of(_picked("log_probs", b["bag"])) + F.lit(weight) * scalar.huber(F.col("contribution") - b["t"], delta)

    rows = scores.join(slots.select(uid, "slot", "contribution"), [uid, "slot"]).join(nested, uid)
    made = rows.select(uid, "slot", F.explode(F.transform("bags", lambda b: F.struct(b["target"].alias("target"), cost(b).alias("cost")))).alias("b"))
    return made.select(uid, "slot", "b.target", "b.cost").where("cost IS NOT NULL")


def matched_bags(scores: DataFrame, members: DataFrame, assignment: DataFrame, predicted: DataFrame | None = None, uid: str = "uid") -> DataFrame:
    """(uid, slot, target, cardinality, bag_nll, bag_mass, best_in_bag[, argmax_in_bag]) of every matched pair.

    Only the matched slot is scored against its target's bag. predicted: (uid, slot, candidate_index) of the slot's
    own greatest candidate, if that is one.
    """
    pairs = assignment.join(bags_of(members, uid), [uid, "target"]).join(scores, [uid, "slot"]).withColumn("v", _picked("log_probs",
        F.col("bag"))).where(F.size("v") > 0)
    if predicted is not None:
        pairs = pairs.join(predicted.select(uid, "slot", F.col("candidate_index").alias("__own")), [uid, "slot"], "left")
    out = pairs.withColumn("lse", log_sum_exp_of(F.col("v"))).select(
        uid, "slot", "target", F.size("v").cast("bigint").alias("cardinality"), (-F.col("lse")).alias("bag_nll"),
            F.exp("lse").alias("bag_mass"), F.array_max("v").alias("best_in_bag"),
        *([] if predicted is None else [F.coalesce(F.array_contains("bag", F.col("__own")), F.lit(False)).alias("argmax_in_bag")]),
    )
    return out


def identity_metrics(pairs: DataFrame) -> DataFrame:
    """(grp, pairs, argmax_in_bag, bag_mass, best_in_bag) of matched_bags rows: all, unique and ambiguous bags in one pass."""
    n = F.col("cardinality")
    groups = F.array_compact(F.array(F.lit("all"), F.when(n == 1, "unique"), F.when(n >= 2, "ambiguous")))
    share = F.avg(F.col("argmax_in_bag").cast("double"))
    return pairs.select("argmax_in_bag", "bag_mass", "best_in_bag", F.explode(groups).alias("grp")).groupBy("grp").agg(
        F.count("*").alias("pairs"), share.alias("argmax_in_bag"), F.avg("bag_mass").alias("bag_mass"), F.avg("best_in_bag").alias("best_in_bag")
    )


def balanced_bce(df: DataFrame, logit: str, positive: Column, by: Sequence[str] = ()) -> DataFrame:
    """Mean of the positives' mean and the negatives' mean; a missing side doesn't count."""
    loss = scalar.bce_with_logits(logit, F.when(positive, 1.0).otherwise(0.0))
    sides = (df.groupBy(*by) if by else df).agg(F.avg(F.when(positive, loss)).alias("pos"), F.avg(F.when(~positive, loss)).alias("neg"),
        F.count("*").alias("slots"))
    both = F.coalesce((F.col("pos") + F.col("neg")) / 2.0, F.col("pos"), F.col("neg"), F.lit(0.0))
    return sides.select(*by, "pos", "neg", both.alias("presence_loss"), "slots")


def spectrum_cosine_loss(assigned: DataFrame, peaks: DataFrame, uid: str = "uid", eps: float = 1e-8) -> DataFrame:
    """(uid, loss): 1 less the cosine of the matched slots' contributions, put on their peaks, and the whole spectrum.

    assigned: (uid, peak_index, contribution), several on one peak add up; peaks: (uid, peak_index, t).
    """
    rendered = assigned.groupBy(uid, "peak_index").agg(F.sum("contribution").alias("r"))
    joined = peaks.join(rendered, [uid, "peak_index"], "left").withColumn("r", F.coalesce("r", F.lit(0.0)))
    dot, r, t = F.sum(F.col("r") * F.col("t")), F.sqrt(F.sum(F.col("r") * F.col("r"))), F.sqrt(F.sum(F.col("t") * F.col("t")))
    return joined.groupBy(uid).agg((1.0 - dot / (r * t + F.lit(eps))).alias("loss"))


def matched_cosines(peaks: DataFrame, uid: str = "uid", eps: float = 1e-8) -> DataFrame:
    """(uid, loss, oracle, forced, gated): the loss and what cosine_decomposition gives, of peaks that carry their match already.

    peaks: (uid, t, selected, slot, intensity, contribution), the last three null where no slot is matched. Of n peaks with the
    same slot each counts n times, as it does if peaks and slots are joined by target. Sums over the peaks alone: no join, and no
    shuffle if the peaks lie together by uid.
    """
    i, c = (F.coalesce(F.col(name), F.lit(0.0)) for name in ("intensity", "contribution"))
    t = F.col("t")
    terms = {"it": i * t, "ii": i * i, "ct": c * t, "cc": c * c, "tt": t * t, "chosen": F.when(F.col("selected"), t * t)}
    by_slot = peaks.groupBy(uid, "slot").agg(F.count("*").alias("n"), *[F.sum(v).alias(name) for name, v in terms.items()])
    times = F.when(F.col("slot").isNull(), 1).otherwise(F.col("n"))
    total = by_slot.groupBy(uid).agg(*[F.sum(times * F.col(name)).alias(name) for name in terms])

    def norms(square: str) -> Column:
        return F.sqrt(square) * F.sqrt("tt")

    def cosine(dot: str, square: str) -> Column:
        return F.coalesce(scalar.safe_ratio(dot, norms(square)), F.lit(0.0))

    loss, oracle = 1.0 - F.col("ct") / (norms("cc") + F.lit(eps)), F.coalesce(F.sqrt("chosen"), F.lit(0.0))
    return total.select(uid, loss.alias("loss"), oracle.alias("oracle"), cosine("it", "ii").alias("forced"), cosine("ct", "cc").alias("gated"))


def total_loss(parts: DataFrame, weights: dict[str, float]) -> DataFrame:
    """parts with total: the weighted sum of its loss columns; null counts as 0."""
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.lit(float(weight)) * F.coalesce(F.col(name), F.lit(0.0))
    return parts.withColumn("total", total)


def prefix_nodes(candidates: DataFrame, uid: str = "uid", counts: str = "counts") -> DataFrame:
    """(uid, depth, prefix, children, members): nodes of the prefix tree over count arrays.

    Candidates of a spectrum share a node if they agree on every count before its depth; children are the
    counts they take next.
    """
    deep = candidates.select(uid, F.col(counts).alias("c"), F.explode(F.sequence(F.lit(0), F.size(counts) - 1)).alias("depth")).where(F.size("c") > 0)
    keyed = deep.select(uid, "depth", F.slice("c", 1, F.col("depth")).alias("prefix"), F.element_at("c", F.col("depth") + 1).alias("child"))
    return keyed.groupBy(uid, "depth", "prefix").agg(F.array_sort(F.collect_set("child")).alias("children"), F.count("*").alias("members"))


def prefix_nll(nodes: DataFrame, child_scores: DataFrame, uid: str = "uid") -> DataFrame:
    """Mean over nodes of minus the log mass on their children. child_scores: (uid, depth, prefix, child, log_prob)."""
    taken = nodes.select(uid, "depth", "prefix", F.explode("children").alias("child")).join(child_scores, [uid, "depth", "prefix", "child"])
    per = log_sum_exp(taken, [uid, "depth", "prefix"], "log_prob")
    return per.agg((-F.avg("lse")).alias("prefix_nll"), F.count("*").alias("nodes"))


def masked_log_softmax(df: DataFrame, keys: Sequence[str], logit: str, admissible: str) -> DataFrame:
    """df's admissible rows with log_prob: the log-softmax of logit among them."""
    w = Window.partitionBy(*keys)
    kept = df.where(F.col(admissible)).withColumn("__top", F.max(logit).over(w))
    total = F.sum(F.exp(F.col(logit) - F.col("__top"))).over(w)
    return kept.withColumn("log_prob", F.col(logit) - F.col("__top") - F.log(total)).drop("__top")


def cosine_decomposition(peaks: DataFrame, assigned: DataFrame, uid: str = "uid") -> DataFrame:
    """(uid, oracle, forced, gated): what limits a spectrum's cosine.

    peaks: (uid, peak_index, t, selected); assigned: (uid, peak_index, intensity, contribution). oracle is the cosine of
    the selected peaks, forced that of matched intensities as if every slot were present, gated that of
    contributions.
    """
    joined = peaks.join(assigned, [uid, "peak_index"], "left")
    t2 = F.col("t") * F.col("t")

    def cosine(value: str) -> Column:
        v = F.coalesce(F.col(value), F.lit(0.0))
        return F.coalesce(scalar.safe_ratio(F.sum(v * F.col("t")), F.sqrt(F.sum(v * v)) * F.sqrt(F.sum(t2))), F.lit(0.0))

    oracle = F.coalesce(F.sqrt(F.sum(F.when(F.col("selected"), t2))), F.lit(0.0))
    return joined.groupBy(uid).agg(oracle.alias("oracle"), cosine("intensity").alias("forced"), cosine("contribution").alias("gated"))
