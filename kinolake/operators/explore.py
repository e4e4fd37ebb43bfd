"""The exploration façade: a store of tables with the calls that a front end makes, and explorers chosen by name."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import aligned, expanded, slack
from ..functions.labels import NONE
from . import features as FE
from . import labels as LB
from . import models as M
from . import search as SE
from . import select as SL
from . import store as ST
from .cluster import average_linkage

KEY = ["vid", "start_time", "end_time"]
#: The cluster explorer looks for medoids up to so many rows, by KMeans beyond.
MEDOID_ROWS = 20_000


@dataclass
class Store:
    """Tables of a collection; changes replace them (EX16). `features` by feature name."""

    videos: DataFrame
    annotations: DataFrame
    features: dict[str, DataFrame]
    models: DataFrame
    predictions: DataFrame
    shown: set[int] = field(default_factory=set)

    # labels
    def add_label(self, vid: int, start: float, end: float, label: str, now=None) -> None:
        self.annotations = LB.label_added(self.annotations, vid, start, end, label, F.current_timestamp() if now is None else F.lit(now).cast("timestamp"))

    def remove_labels(self, keys: DataFrame) -> None:
        self.annotations = LB.labels_removed(self.annotations, keys)

    def relabel(self, changes: DataFrame) -> None:
        self.annotations = LB.relabelled(self.annotations, changes)

    def labels(self, **kw) -> DataFrame:
        return SE.labels_of(self.annotations, **kw)

    # videos
    def add_videos(self, new: DataFrame) -> DataFrame:
        before, self.videos = self.videos, ST.videos_added(self.videos, new)
        return ST.new_vids(before, self.videos)

    def search(self, **kw) -> DataFrame:
        return SE.search_videos(self.videos, self.annotations, self.predictions, **kw)

    def vids(self, first: int, last: int) -> DataFrame:
        return SE.page(self.videos.select("vid"), first, last)

    def clip_info(self, vids: list[int]) -> DataFrame:
        return SE.whole_videos(self.videos.where(F.col("vid").isin(vids)))

    def watch(self, vids: list[int], mid: int) -> DataFrame:
        """EX15: paths of videos with the predictions for them, nested."""
        whole = self.videos.where(F.col("vid").isin(vids)).select("vid", F.lit(0.0).alias("start_time"), F.col("vduration").alias("end_time"))
        own = SE.predictions_for_clips(whole, self.predictions.where(F.col("mid") == mid))
        return SE.video_paths(self.videos, vids, thumbnails=True).join(own, "vid")

    def progress(self) -> dict[str, tuple[int, int]]:
        """AG19: (done, total) videos of each feature."""
        total = self.videos.count()
        return {name: (t.select("vid").distinct().count(), total) for name, t in self.features.items()}

    # exploring
    def labeled(self, feature: str, overlap: str = "full") -> DataFrame:
        return LB.label_join(self.features[feature].drop("feature"), self.videos, self.annotations, overlap)

    def explore(self, explorer: str, k: int, t: float, feature: str, label: str | None = None, step: int = 0, seed: int = 0) -> DataFrame:
        """EX14: k clips by the named explorer, widened to t seconds, aligned to the feature's windows, with the newest model's predictions nested."""
        clips = named_explorer(explorer)(self, k, t, feature, label, step, seed).select(*KEY)
        s, e = expanded(F.col("start_time"), F.col("end_time"), t)
        windows = self.features[feature].groupBy("vid").agg(F.array_sort(F.collect_list(F.struct(F.col("start_time").alias("start"), F.col("end_time").alias("end")))).alias("_w"))
        wide = clips.select("vid", s.alias("start_time"), e.alias("end_time")).join(windows, "vid", "left")
        none = F.array().cast("array<struct<start:double,end:double>>")
        fit = F.when(F.size(F.coalesce("_w", none)) == 0, F.struct(F.col("start_time").alias("start"), F.col("end_time").alias("end"))).otherwise(slack(aligned(F.coalesce("_w", none), F.col("start_time"), F.col("end_time"))))
        placed = wide.withColumn("_c", fit).select("vid", F.col("_c.start").alias("start_time"), F.col("_c.end").alias("end_time"))
        newest = SE.latest_model(self.models, feature).select("mid")
        return SE.predictions_for_clips(placed, self.predictions.join(F.broadcast(newest), "mid", "left_semi"))

    def train(self, feature: str, **kw):
        """A classifier on all labels of the feature's windows."""
        return M.fit_linear(M.training_set(self.features[feature], self.videos, self.annotations), **kw)


def _random(s: Store, k, t, feature, label, step, seed) -> DataFrame:
    return SL.random_clips(s.videos, s.annotations, k, seed + step)


def _temporal(s: Store, k, t, feature, label, step, seed) -> DataFrame:
    return SL.temporal_clips(s.videos, s.annotations, k, t)


def _cluster(s: Store, k, t, feature, label, step, seed) -> DataFrame:
    return SL.cluster_medoids(s.features[feature], s.labeled(feature, "partial").where(F.col("labels") != NONE).select("fid"), k, seed, most_rows=MEDOID_ROWS)


def _shown(s: Store) -> DataFrame:
    """fids shown before: k a round, as a table."""
    return s.videos.sparkSession.createDataFrame([(f,) for f in sorted(s.shown)], "fid bigint")


def _coreset(s: Store, k, t, feature, label, step, seed) -> DataFrame:
    """EX04: windows shown before belong to the coreset but aren't returned."""
    rows = s.features[feature]
    done = rows.join(s.labeled(feature).where(F.col("labels") != NONE).select("fid"), "fid", "left_semi") if not s.shown else rows.join(_shown(s), "fid", "left_semi")
    out = SL.coreset(rows, k, done, seed)
    s.shown |= {r["fid"] for r in out.select("fid").collect()}
    return out


def _cluster_coreset(s: Store, k, t, feature, label, step, seed, rounds: int = 3) -> DataFrame:
    """EX05: clusters for the first rounds (k of rounds * k medoids each time), then coresets."""
    if step >= rounds:
        return _coreset(s, k, t, feature, label, step, seed)
    return _cluster(s, rounds * k, t, feature, label, 0, seed).offset(step * k).limit(k)


def _cluster_margin(s: Store, k, t, feature, label, step, seed, start: int = 50) -> DataFrame:
    """EX06: by chance until `start` clips have been asked for, or without predictions; then round-robin over clusters of the most uncertain windows."""
    if step * k < start or s.predictions.isEmpty():
        return _random(s, k, t, feature, label, step, seed)
    rows = s.features[feature]
    clustered = clusters(rows)
    free = s.labeled(feature).where(F.col("labels") == NONE).select("fid")
    unsure = SL.margin_ranked(SE.predictions_pivoted(s.predictions, SE.latest_model(s.models).first()["mid"])).select(*KEY, "uncertainty")
    pool = clustered.join(free, "fid", "left_semi").join(_shown(s), "fid", "left_anti").join(unsure, KEY)
    picked = SL.cluster_margin(pool.select("fid", "cluster", "uncertainty"), k, seed=seed)
    s.shown |= {r["fid"] for r in picked.select("fid").collect()}
    return rows.join(picked.select("fid"), "fid", "left_semi")


def clusters(features: DataFrame, average: int = 10) -> DataFrame:
    """EX06: count // average clusters by average linkage of all rows, however many; (fid, vid, start_time, end_time, cluster)."""
    return average_linkage(features, average).select("fid", *KEY, "cluster")


def _label_uncertainty(s: Store, k, t, feature, label, step, seed) -> DataFrame:
    """EX07; EX08 without a label is the margin."""
    if label is None:
        return _cluster_margin(s, k, t, feature, label, step, seed, start=0)
    counts = {r["label"]: r["n"] for r in LB.label_counts(s.features[feature], s.annotations).collect()}  # one row a label
    pos = counts.get(label, 0)
    ranked = SL.by_label(s.predictions, label, pos, sum(counts.values()) - pos, max(1, len(counts)))
    return s.videos.sparkSession.createDataFrame(SL.apart(ranked, k, t), "vid bigint, start_time double, end_time double")


def _if_uniform(other, tester: str = "cvm"):
    """EX09, EX10: by chance while the labels' seconds look uniform to the named test, else the other explorer."""

    def run(s: Store, k, t, feature, label, step, seed) -> DataFrame:
        seconds = {r["label"]: float(r["seconds"]) for r in LB.label_seconds(s.annotations).collect()}
        return (_random if SL.uniform(seconds, tester, seed) else other)(s, k, t, feature, label, step, seed)

    return run


def named_explorer(name: str):
    """The explorer of a name; the two that ask whether labels are uniform take the test's name behind an underscore, such as randomifuniform_binom_pval0.01_m2."""
    if name in EXPLORERS:
        return EXPLORERS[name]
    kind, _, tester = name.partition("_")
    if kind in UNIFORM and tester:
        return _if_uniform(UNIFORM[kind], tester)
    raise ValueError(f"no explorer {name}")


UNIFORM = {"randomifuniform": _coreset, "randomifuniformcm": _cluster_margin}
EXPLORERS = {
    "random": _random, "temporal": _temporal, "cluster": _cluster, "coreset": _coreset, "clustercoreset": _cluster_coreset, "clustermargin": _cluster_margin,
    "uncertainty": _label_uncertainty, **{name: _if_uniform(other) for name, other in UNIFORM.items()},
}


def missing_features(s: Store, feature: str) -> DataFrame:
    return FE.missing(s.videos, s.features[feature])
