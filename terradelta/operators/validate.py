"""Validation: pixel and polygon metrics, threshold sweeps, detection latency, report tables."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.raster import at_least, f1, month_index, safe_ratio
from ..schema import IOU_THRESHOLD

METRICS = ("pixel_precision", "pixel_recall", "pixel_f1", "polygon_precision", "polygon_recall", "polygon_f1", "mean_iou")


def threshold_sweep(pairs: DataFrame, thresholds: list[float], keys: list[str] | None = None, prob: str = "prob", truth: str = "gt") -> DataFrame:
    """Per threshold (in the given order, ``ord``): counts and pixel precision, recall and F1.

    All thresholds are counted in one pass as columns, then unfolded: rows are not multiplied before the aggregation.
    """
    keys = keys or []
    if not thresholds:
        return pairs.limit(0).groupBy(*keys).agg(F.count("*").alias("ord")).limit(0)
    aggs = []
    for i, t in enumerate(thresholds):
        hit = at_least(F.col(prob), t)
        for name, cond in (("tp", hit & (F.col(truth) == 1)), ("fp", hit & (F.col(truth) == 0)), ("fn", ~hit & (F.col(truth) == 1))):
            aggs.append(F.count(F.when(cond, 1)).alias(f"{name}{i}"))
    counts = pairs.groupBy(*keys).agg(*aggs)
    rows = F.inline(F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(float(t)).alias("threshold"), *(F.col(f"{n}{i}").alias(n) for n in ("tp", "fp", "fn"))) for i, t in enumerate(thresholds))))
    out = counts.select(*keys, rows)
    out = out.withColumn("pixel_precision", safe_ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("pixel_recall", safe_ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("pixel_f1", f1(F.col("pixel_precision"), F.col("pixel_recall")))


def pixel_metrics(pairs: DataFrame, limit: float, keys: list[str] | None = None, prob: str = "prob", truth: str = "gt") -> DataFrame:
    return threshold_sweep(pairs, [limit], keys, prob, truth).drop("ord")


def best_threshold(sweep: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The sweep's row of highest F1, the first of equals."""
    best = F.max_by(F.struct(*[c for c in sweep.columns if c not in (keys or [])]), F.struct("pixel_f1", -F.col("ord"))).alias("b")
    return sweep.groupBy(*(keys or [])).agg(best).select(*(keys or []), "b.*")


def greedy_matches(pairs: DataFrame, keys: list[str], pred: str, truth: str, limit: float = IOU_THRESHOLD) -> DataFrame:
    """Matches of predicted and true polygons, predictions of best overlap first (of equals the higher id first), each to
    the free true polygon that it overlaps most (of equals the lower id), if that is above the limit.

    Matching is sequential by nature: one group is one area and period, and only pairs above the limit come in, as no
    other can match or take a polygon from another. Repeated pairs count once.
    """
    base = pairs.filter(F.col("iou") > limit).select(*keys, F.col(pred).alias("pred"), F.col(truth).alias("truth"), "iou")

    def run(t: pd.DataFrame) -> pd.DataFrame:
        (a, preds), (b, truths) = (pd.factorize(t[c]) for c in ("pred", "truth"))
        matches = walk(pd.DataFrame({"a": a, "b": b, "iou": t["iou"].to_numpy()}), pd.DataFrame({"no": range(len(preds)), "id": preds}), pd.DataFrame({"no": range(len(truths)), "id": truths}))
        return matches.assign(**{k: t[k].iloc[0] for k in keys})[[*keys, "pred", "truth", "iou"]]

    return base.groupBy(*keys).applyInPandas(run, base.schema)


def greedy_class_matches(pairs: DataFrame, preds: DataFrame, truths: DataFrame, keys: list[str], ident: str, limit: float = IOU_THRESHOLD) -> DataFrame:
    """``greedy_matches`` of all polygons that the classes of ``iou_classes`` stand for, without writing their pairs out.

    A group's task holds its classes' pairs above the limit and the ids of these classes, not the pairs of ids.
    """
    base = pairs.filter(F.col("iou") > limit).select(*keys, F.col("a_no").alias("a"), F.col("b_no").alias("b"), "iou")
    rows = base
    for df, p, own in ((preds, "a", "pred"), (truths, "b", "truth")):
        met = df.withColumn(p, F.col("no")).join(base.select(p).distinct(), p, "left_semi")
        ids = met.select(*keys, p, F.explode(f"rows.{p}_{ident}").alias(own))
        rows = rows.unionByName(ids, allowMissingColumns=True)
    schema = rows.select(*keys, "pred", "truth", "iou").schema

    def run(t: pd.DataFrame) -> pd.DataFrame:
        pair = t["iou"].notna()
        sides = [t.loc[~pair & t[c].notna(), [c, own]].set_axis(["no", "id"], axis=1).drop_duplicates() for c, own in (("a", "pred"), ("b", "truth"))]
        matches = walk(t.loc[pair, ["a", "b", "iou"]], *sides)
        return matches.assign(**{k: t[k].iloc[0] for k in keys})[[*keys, "pred", "truth", "iou"]]

    return rows.groupBy(*keys).applyInPandas(run, schema)


def walk(pairs: pd.DataFrame, preds: pd.DataFrame, truths: pd.DataFrame) -> pd.DataFrame:
    """The matching of one group: ``pairs`` of classes (``a``, ``b``, ``iou``), and the ids (``no``, ``id``) of each class.

    A class's overlaps are looked at from the greatest on, once for all its ids: those of one value lie in a heap by
    their least free id, and what is taken never comes back. A prediction of several classes has the pairs of all.
    """
    several = preds[preds.duplicated("id", keep=False)]
    if len(several):
        own = several["no"].max() + 1 + pd.factorize(several["id"])[0]
        pairs = pd.concat([pairs, several.assign(own=own).merge(pairs, left_on="no", right_on="a")[["own", "b", "iou"]].set_axis(["a", "b", "iou"], axis=1)])
        preds = pd.concat([preds.drop(several.index), several.assign(no=own).drop_duplicates()])
        pairs = pairs[pairs["a"].isin(preds["no"])]
    pairs, truths = pairs.sort_values(["a", "iou"], ascending=[True, False]), truths.sort_values(["no", "id"])
    classes, begin, size = np.unique(pairs["a"].to_numpy(), return_index=True, return_counts=True)
    at, stop, best = begin.tolist(), (begin + size).tolist(), pairs["iou"].to_numpy()[begin]
    numbers, begin, size = np.unique(truths["no"].to_numpy(), return_index=True, return_counts=True)
    free, end, ids = begin.tolist(), (begin + size).tolist(), truths["id"].tolist()
    b, iou = np.searchsorted(numbers, pairs["b"].to_numpy()).tolist(), pairs["iou"].tolist()
    preds = preds.assign(c=np.searchsorted(classes, preds["no"].to_numpy()))
    preds = preds.assign(best=best[preds["c"]]).sort_values(["best", "id"], ascending=False)
    heaps: list[list] = [[] for _ in classes]
    taken, out = set(), []

    def next_free(q: int) -> bool:
        while free[q] < end[q] and ids[free[q]] in taken:
            free[q] += 1
        return free[q] < end[q]

    for p, c in zip(preds["id"].tolist(), preds["c"].tolist(), strict=True):
        heap = heaps[c]
        while True:
            while heap:
                t, q = heap[0]
                if not next_free(q):
                    heapq.heappop(heap)
                elif ids[free[q]] != t:
                    heapq.heapreplace(heap, (ids[free[q]], q))
                else:
                    break
            if heap or at[c] == stop[c]:
                break
            first = at[c]
            while at[c] < stop[c] and iou[at[c]] == iou[first]:
                if next_free(b[at[c]]):
                    heap.append((ids[free[b[at[c]]]], b[at[c]]))
                at[c] += 1
            heapq.heapify(heap)
        if heap:
            taken.add(heap[0][0])
            out.append((p, heap[0][0], iou[at[c] - 1]))
    return pd.DataFrame(out, columns=["pred", "truth", "iou"])


def polygon_metrics(matches: DataFrame, n_pred: DataFrame, n_truth: DataFrame, keys: list[str], limit: float = IOU_THRESHOLD) -> DataFrame:
    """Precision, recall, F1 and mean IoU by area; zeros with counts where a side has no polygons."""
    found = matches.groupBy(*keys).agg(F.count("*").alias("tp"), F.avg("iou").alias("iou"))
    counts = n_pred.groupBy(*keys).agg(F.count("*").alias("n_pred_polygons")).join(n_truth.groupBy(*keys).agg(F.count("*").alias("n_gt_polygons")), keys, "full").join(found, keys, "left").fillna(0)
    out = counts.withColumn("polygon_precision", safe_ratio(F.col("tp"), F.col("n_pred_polygons"))).withColumn("polygon_recall", safe_ratio(F.col("tp"), F.col("n_gt_polygons")))
    return out.select(*keys, "polygon_precision", "polygon_recall", f1(F.col("polygon_precision"), F.col("polygon_recall")).alias("polygon_f1"), F.coalesce("iou", F.lit(0.0)).alias("mean_iou"), "n_pred_polygons", "n_gt_polygons", F.lit(float(limit)).alias("threshold"))


def detection_latency(series: DataFrame, change_month: str, limit: float, keys: list[str], prob: str = "prob", month: str = "year_month") -> DataFrame:
    """Per area: the first month from the change on with any pixel at or above the limit, and months until then; nulls if none."""
    later = month_index(F.col(month)) >= month_index(F.lit(change_month))
    hit = F.min(F.when(later & at_least(F.col(prob), limit), F.col(month)))
    out = series.groupBy(*keys).agg(hit.alias("detection_month"))
    return out.withColumn("latency_months", month_index(F.col("detection_month")) - month_index(F.lit(change_month)))


def four_decimals(x: Column) -> Column:
    """``x`` as C prints it by ``%.4f``: the binary value itself is rounded, halves to even.

    Java's formatter rounds the shortest decimal that stands for the value instead, and gives 0.6433 for 0.64325, whose
    binary value is less. Which side of a middle (2k + 1) / 20000 a fraction lies on is found without error: its upper
    and lower bits are multiplied each for themselves.
    """
    size = F.abs(x)
    fraction = size - F.floor(size)
    k = F.floor(fraction * 10000)
    wide = fraction * 134217729.0  # 2 ** 27 + 1
    upper = wide - (wide - fraction)
    beyond = (upper * 20000 - (2 * k + 1)) + (fraction - upper) * 20000
    units = k + F.when((beyond > 0) | ((beyond == 0) & (k % 2 == 1)), 1).otherwise(0)
    whole = F.floor(size) + F.floor(units / 10000)
    text = F.concat(F.when(x < 0, "-").otherwise(""), whole.cast("string"), F.lit("."), F.lpad((units % 10000).cast("string"), 4, "0"))
    return F.when(size < 2.0**53, text).otherwise(F.format_string("%.4f", x))


def metrics_lines(metrics: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """Rows of a Markdown table: numbers with four decimals, counts as they are."""
    kinds = dict(metrics.dtypes)
    cells = [F.col(name).cast("string"), *(four_decimals(F.col(c).cast("double")) if kinds[c] in ("double", "float") else F.col(c).cast("string") for c in columns)]
    return metrics.select(F.col(name), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def metrics_table(metrics: DataFrame, name: str, columns: list[str]) -> str:
    """The whole table; a header alone for no rows. Rows are runs that a report compares, so few."""
    head = ["| " + " | ".join([name, *columns]) + " |", "|" + "---|" * (len(columns) + 1)]
    return "\n".join([*head, *(r["line"] for r in metrics_lines(metrics, name, columns).orderBy(name).collect())])


def rgb_stretch(pixels: DataFrame, keys: list[str], bands: list[str]) -> DataFrame:
    """Three channels scaled to 0..1 between their least and greatest values; a flat one is 0, one band is grey, of two
    the second shows twice."""
    shown = [bands[0]] * 3 if len(bands) == 1 else [bands[0], bands[1], bands[1]] if len(bands) == 2 else list(bands[:3])
    limits = pixels.groupBy(*keys).agg(*(f(b).alias(f"_{n}_{b}") for b in dict.fromkeys(shown) for n, f in (("lo", F.min), ("hi", F.max))))
    joined = pixels.join(limits, keys)
    span = lambda b: F.col(f"_hi_{b}") - F.col(f"_lo_{b}")
    return joined.select(*keys, "y", "x", *(F.when(span(b) > 0, (F.col(b) - F.col(f"_lo_{b}")) / span(b)).otherwise(F.lit(0.0)).cast("float").alias(c) for b, c in zip(shown, "rgb", strict=True)))


def latency_plot(series: DataFrame, keys: list[str], prob: str = "prob", month: str = "year_month") -> DataFrame:
    """What a latency figure shows: each month's position in years and its greatest probability."""
    from ..functions.raster import month_as_year

    return series.groupBy(*keys, month).agg(F.max(prob).alias("max_prob")).withColumn("year", month_as_year(F.col(month)))
