"""One-to-one assignment inside a spectrum: the only kernels that need Python, one group per spectrum.

A group is bounded by the slots and targets of one spectrum (64 x 64 cells).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def min_cost_assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """(row, column) pairs of least total cost, every column matched once; needs columns <= rows.

    Shortest augmenting paths over column and row potentials, vectorised over rows: O(columns^2 * rows).
    """
    rows, columns = cost.shape
    if columns > rows:
        raise ValueError(f"{columns} targets cannot be matched one-to-one against {rows} slots")
    of_row = np.full(rows, -1)
    u, v = np.zeros(columns), np.zeros(rows)
    for start in range(columns):
        shortest, previous, done = np.full(rows, np.inf), np.full(rows, -1), np.zeros(rows, bool)
        column, row, reach = start, -1, 0.0
        while True:
            slack = reach + cost[:, column] - u[column] - v
            better = ~done & (slack < shortest)
            shortest[better], previous[better] = slack[better], column
            row = int(np.argmin(np.where(done, np.inf, shortest)))
            reach = shortest[row]
            done[row] = True
            if of_row[row] < 0:
                break
            column = int(of_row[row])
        u[start] += reach
        inner = done & (of_row >= 0)
        inner_columns = of_row[inner]
        u[inner_columns] += reach - shortest[inner]
        v[done] -= reach - shortest[done]
        while True:  # flip the path
            column = int(previous[row])
            held = np.flatnonzero(of_row == column)
            of_row[row] = column
            if column == start:
                break
            row = int(held[0]) if held[0] != row else int(held[1])
    return [(int(r), int(of_row[r])) for r in np.flatnonzero(of_row >= 0)]


def assign(costs: DataFrame, uid: str = "uid", slots: int = 64) -> DataFrame:
    """(uid, slot, target, cost) of the cheapest one-to-one assignment of every target of each uid.

    costs: (uid, slot, target, cost); a missing cell can't be matched. More than ``slots`` slots or targets of a uid are an error;
    of more targets than slots the dearest stay unmatched.
    """
    kind = costs.schema[uid].dataType.simpleString()

    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        own_slots, own_targets = np.unique(rows["slot"]), np.unique(rows["target"])
        if max(len(own_slots), len(own_targets)) > slots:
            raise ValueError(f"{len(own_slots)} slots or {len(own_targets)} targets of {key[0]} exceed {slots}")
        # Rows without a slot take the targets that are left over where slots are fewer.
        grid = np.full((max(len(own_slots), len(own_targets)), len(own_targets)), 1e12)
        grid[np.searchsorted(own_slots, rows["slot"]), np.searchsorted(own_targets, rows["target"])] = rows["cost"]
        pairs = [(r, c) for r, c in min_cost_assignment(grid) if grid[r, c] < 1e11]
        return pd.DataFrame({
            uid: [key[0]] * len(pairs), "slot": [own_slots[r] for r, _ in pairs], "target": [own_targets[c] for _, c in pairs],
            "cost": [grid[r, c] for r, c in pairs],
        })

    return costs.select(uid, "slot", "target", "cost").groupBy(uid).applyInPandas(solve, f"`{uid}` {kind}, slot INT, target INT, cost DOUBLE")


def max_matching(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(prediction, target) pairs of a greatest matching; targets are tried in order, predictions in order."""
    options: dict[int, list[int]] = {}
    for p, t in sorted(set(links)):
        options.setdefault(t, []).append(p)
    holder: dict[int, int] = {}  # prediction -> target
    for start in sorted(options):
        came: dict[int, int] = {}  # prediction -> the target it was reached from
        queue, free = [start], None
        for t in queue:
            for p in options[t]:
                if p in came:
                    continue
                came[p] = t
                if p not in holder:
                    free = p
                    break
                queue.append(holder[p])
            if free is not None:
                break
        while free is not None:  # flip the alternating path
            t = came[free]
            after = next((p for p, held in holder.items() if held == t and p != free), None)
            holder[free] = t
            free = after if t != start else None
    return sorted(holder.items())


def match_identities(links: DataFrame, uid: str = "uid") -> DataFrame:
    """(uid, prediction, target) of a greatest one-to-one matching per uid; links: (uid, prediction, target)."""
    kind = links.schema[uid].dataType.simpleString()

    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        pairs = max_matching(list(zip(rows["prediction"].tolist(), rows["target"].tolist())))
        return pd.DataFrame({uid: [key[0]] * len(pairs), "prediction": [p for p, _ in pairs], "target": [t for _, t in pairs]})

    return links.select(uid, "prediction", "target").distinct().groupBy(uid).applyInPandas(solve, f"`{uid}` {kind}, prediction INT, target INT")


def fragment_diagnostics(predictions: DataFrame, bags: DataFrame, targets: DataFrame, uid: str = "uid") -> DataFrame:
    """Hits per spectrum after one-to-one matching.

    predictions: (uid, prediction, formula, ion_state), bags: (uid, target, formula, ion_state) distinct, targets: (uid,
    target, y). A target without a bag counts as a target of neither class.
    """
    links = predictions.join(bags, [uid, "formula", "ion_state"]).select(uid, "prediction", "target")
    matched = match_identities(links, uid).select(uid, "target", F.lit(1).alias("hit"))
    sizes = bags.groupBy(uid, "target").agg(F.count("*").alias("size"))
    per = targets.join(sizes, [uid, "target"], "left").join(matched, [uid, "target"], "left")
    hit, one, many = F.coalesce(F.col("hit"), F.lit(0)), F.col("size") == 1, F.col("size") >= 2
    by_target = per.groupBy(uid).agg(
        F.count("*").alias("targets"), F.sum(hit).alias("matched"), F.count_if(one).alias("unique_targets"), F.sum(F.when(one,
            hit).otherwise(0)).alias("unique_matched"),
        F.count_if(many).alias("ambiguous_targets"), F.sum(F.when(many, hit).otherwise(0)).alias("ambiguous_matched"), F.sum("y").alias("target_intensity"),
        F.sum(hit * F.col("y")).alias("matched_intensity"),
    )
    counted = predictions.groupBy(uid).agg(F.count("*").alias("predictions"))
    return by_target.join(counted, uid, "left").withColumn("predictions", F.coalesce("predictions", F.lit(0).cast("bigint")))


def summarise_fragments(diagnostics: DataFrame) -> DataFrame:
    """Pooled rates: sums over sums, not means of ratios; null where nothing counts."""
    ratio = lambda a, b: F.sum(a).cast("double") / F.nullif(F.sum(b).cast("double"), F.lit(0.0))
    return diagnostics.agg(
        F.count("*").alias("spectra"), F.sum("targets").alias("targets"), F.sum("predictions").alias("predictions"), ratio("matched",
            "targets").alias("bag_hit"),
        ratio("unique_matched", "unique_targets").alias("unique_hit"), ratio("ambiguous_matched", "ambiguous_targets").alias("ambiguous_hit"),
        ratio("matched_intensity", "target_intensity").alias("intensity_hit"), ratio("matched", "predictions").alias("precision"),
    )
