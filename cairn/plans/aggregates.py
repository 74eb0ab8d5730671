"""Aggregations over studies, series and volumes."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import geometry as G
from cairn.functions import hashing as H
from cairn.operators import bitmaps as BM
from cairn.operators import joins as J
from cairn.operators import latest as L
from cairn.operators import selection as S
from cairn.operators.store import durable

from . import _bind as B
from ._catalogue import Catalogue

cat = Catalogue()
query = cat.query
c = F.col

_LATEST = B.STUDIES + ", last AS (SELECT * FROM studies QUALIFY row_number() OVER (PARTITION BY subject ORDER BY recorded DESC, study) = 1)"


def _latest(t):
    return L.latest(B.studies(t), ["subject"], "recorded", "study")


def group_summary(df, group: str, value: str, threshold):
    """Per group over one value a subject: n, quartiles, extremes, count at or over a threshold."""
    wanted = {"median": S.linear(0.5), "p25": S.linear(0.25), "p75": S.linear(0.75)}
    found = S.quantiles(df.select(group, value), [group], value, wanted, n=F.count(value), lowest=F.min(value), highest=F.max(value), over=F.count_if(threshold))
    return found.select(group, "n", *[F.round(k, 6).alias(k) for k in wanted], "lowest", "highest", "over")


@query("WITH " + _LATEST + " SELECT grp, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.75), 6) AS p75, min(value) AS lowest, max(value) AS highest, "
       "count(*) FILTER (value >= 250000) AS over FROM last GROUP BY grp")
def agg_group_summary(t):
    return group_summary(_latest(t), "grp", "value", c("value") >= 250000)


@query("WITH " + _LATEST + " SELECT grp, count(angle) AS n, round(quantile_cont(angle, 0.5), 6) AS median, round(quantile_cont(angle, 0.25), 6) AS p25, round(quantile_cont(angle, 0.75), 6) AS p75, min(angle) AS lowest, max(angle) AS highest, "
       "count(*) FILTER (angle <= 90) AS over FROM (SELECT *, value / 3000 AS angle FROM last) GROUP BY grp")
def agg_angle_summary(t):
    return group_summary(_latest(t).withColumn("angle", c("value") / 3000), "grp", "angle", c("angle") <= 90)


_PITCH = "CASE WHEN status <> 'P' THEN value / 10000 - 20 END"


@query("WITH " + B.STUDIES + f", p AS (SELECT *, {_PITCH} AS pitch FROM studies), last AS (SELECT * FROM p WHERE pitch IS NOT NULL QUALIFY row_number() OVER (PARTITION BY subject ORDER BY recorded DESC, study) = 1) "
       "SELECT grp, count(*) AS n, round(quantile_cont(abs(pitch), 0.5), 6) AS median, max(abs(pitch)) AS highest, count(*) FILTER (abs(pitch) > 10) AS over FROM last GROUP BY grp")
def agg_tilt_summary(t):
    pitched = B.studies(t).withColumn("pitch", F.expr(_PITCH)).where("pitch IS NOT NULL")
    tilts = L.latest(pitched, ["subject"], "recorded", "study").select("grp", F.abs("pitch").alias("tilt"))
    found = S.quantiles(tilts, ["grp"], "tilt", {"median": S.linear(0.5)}, n=F.count(F.lit(1)), highest=F.max("tilt"), over=F.count_if(c("tilt") > 10))
    return found.withColumn("median", F.round("median", 6))


@query("WITH " + B.STUDIES + f" SELECT count(r) AS n, round(quantile_cont(r, 0.5), 6) AS median, round(quantile_cont(r, 0.95), 6) AS p95, max(r) AS highest FROM (SELECT {_PITCH} AS r FROM studies)")
def agg_rotation_summary(t):
    r = B.studies(t).select(F.expr(_PITCH).alias("r"))
    found = S.quantiles(r, [], "r", {"median": S.linear(0.5), "p95": S.linear(0.95)}, n=F.count("r"), highest=F.max("r"))
    return found.select("n", F.round("median", 6).alias("median"), F.round("p95", 6).alias("p95"), "highest")


@query("SELECT p_brand, round(quantile_cont(p_retailprice, 0.1), 6) AS p10, round(quantile_cont(p_retailprice, 0.9), 6) AS p90 FROM part GROUP BY p_brand")
def agg_quantile_linear(t):
    found = S.quantiles(t("part").select("p_brand", "p_retailprice"), ["p_brand"], "p_retailprice", {"p10": S.linear(0.1), "p90": S.linear(0.9)})
    return found.select("p_brand", F.round("p10", 6).alias("p10"), F.round("p90", 6).alias("p90"))


@query("SELECT p_brand, quantile_disc(p_retailprice, 0.05) AS p5, quantile_disc(p_retailprice, 0.5) AS p50, quantile_disc(p_retailprice, 0.95) AS p95 FROM part GROUP BY p_brand")
def agg_quantile_nearest(t):
    return S.quantiles(t("part").select("p_brand", "p_retailprice"), ["p_brand"], "p_retailprice", {"p5": S.nearest(5), "p50": S.nearest(50), "p95": S.nearest(95)})


@query("SELECT o_orderpriority, median(o_totalprice) AS median FROM orders GROUP BY o_orderpriority")
def agg_median_avg(t):
    return S.quantiles(t("orders").select("o_orderpriority", "o_totalprice"), ["o_orderpriority"], "o_totalprice", {"median": S.linear(0.5)})


@query("SELECT l_suppkey, -quantile_disc(-l_quantity, 0.5) AS upper FROM lineitem GROUP BY l_suppkey")
def agg_median_upper(t):
    return S.quantiles(t("lineitem").select("l_suppkey", "l_quantity"), ["l_suppkey"], "l_quantity", {"upper": S.upper_median()})


_PAIRS = B.STUDIES + ", " + B.AUTOMATIC + ", pairs AS (SELECT s.*, auto FROM studies s JOIN automatic a ON a.study = s.study)"


def _pairs(t):
    return B.studies(t).join(B.automatic(t), "study")


@query("WITH " + _PAIRS + " SELECT grp, count(*) AS n, round(avg(value - auto), 4) AS mean_difference, round(avg(abs(value - auto)), 4) AS mean_distance, round(max(abs(value - auto)), 4) AS largest FROM pairs GROUP BY grp")
def agg_agreement(t):
    d = c("value") - c("auto")
    return _pairs(t).groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(d), 4).alias("mean_difference"), F.round(F.avg(F.abs(d)), 4).alias("mean_distance"), F.round(F.max(F.abs(d)), 4).alias("largest"))


@query("WITH " + _PAIRS + ", arms AS (SELECT 'plain' AS arm, value AS x, auto AS y FROM pairs UNION ALL SELECT 'scaled', value / 2, auto FROM pairs UNION ALL SELECT 'open', CASE WHEN status = 'O' THEN value END, auto FROM pairs) "
       "SELECT arm, count(*) AS n, count(x) AS measured, count(*) FILTER (abs(x - y) / y <= 0.05) AS agreed, count(*) FILTER (x IS NULL) AS missed, round(median(abs(x - y)), 4) AS median, round(min(abs(x - y)), 4) AS lowest, round(max(abs(x - y)), 4) AS highest FROM arms GROUP BY arm")
def agg_tolerance(t):
    arms = _pairs(t).select(F.expr("stack(3, 'plain', value, auto, 'scaled', value / 2, auto, 'open', CASE WHEN status = 'O' THEN value END, auto) AS (arm, x, y)"))
    arms = arms.withColumn("d", F.abs(c("x") - c("y")))
    agreed, missed = F.count_if(c("d") / c("y") <= 0.05), F.count_if(c("x").isNull())
    found = S.quantiles(arms, ["arm"], "d", {"median": S.linear(0.5)}, n=F.count(F.lit(1)), measured=F.count("x"), agreed=agreed, missed=missed, lowest=F.min("d"), highest=F.max("d"))
    return found.select("arm", "n", "measured", "agreed", "missed", *[F.round(k, 4).alias(k) for k in ("median", "lowest", "highest")])


@query("SELECT event_type AS code, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, code")
def agg_code_histogram(t):
    return t("events").groupBy(c("event_type").alias("code")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "code")


@query("SELECT event_type AS code, count(DISTINCT user_id) AS entities FROM events GROUP BY event_type")
def agg_set_histogram(t):
    return t("events").groupBy(c("event_type").alias("code")).agg(F.count_distinct("user_id").alias("entities"))


@query("WITH x AS (SELECT l_returnflag AS source, o_custkey AS subject, l_orderkey AS study, l_partkey AS series FROM lineitem JOIN orders ON l_orderkey = o_orderkey), "
       "many AS (SELECT count(*) AS shared FROM (SELECT study FROM x GROUP BY study HAVING count(DISTINCT source) > 1)) "
       "SELECT coalesce(source, 'all') AS source, count(DISTINCT subject) AS subjects, count(DISTINCT study) AS studies, count(DISTINCT series) AS series, any_value(shared) AS shared FROM x, many GROUP BY GROUPING SETS ((source), ())")
def agg_inventory(t):
    """Subjects, studies and series of each source and of all, and the studies in several sources, from one reading."""
    x = t("lineitem").join(t("orders"), c("l_orderkey") == c("o_orderkey")).select(c("l_returnflag").alias("source"), c("o_custkey").alias("subject"), c("l_orderkey").alias("study"), c("l_partkey").alias("series"))
    found = durable(BM.counts_by_group(x, "source", {"subjects": c("subject"), "studies": c("study"), "series": c("series")}))
    shared = found.where("total AND kind = 'studies'").agg(F.coalesce(F.max("shared"), F.lit(0)).alias("shared"))
    source = F.when(c("total"), "all").otherwise(c("source")).alias("source")
    of = lambda kind: F.coalesce(F.max(F.when(c("kind") == kind, c("n"))), F.lit(0)).alias(kind)
    return found.groupBy(source).agg(of("subjects"), of("studies"), of("series")).crossJoin(F.broadcast(shared))  # one row


@query("WITH " + B.SERIES + " SELECT e.weighting, count(s.study) AS n FROM (VALUES ('Unknown'), ('T1'), ('T2'), ('Flair'), ('Other')) e(weighting) LEFT JOIN series s ON s.weighting = e.weighting GROUP BY e.weighting")
def agg_enum_complete(t):
    counts = B.series(t).groupBy("weighting").agg(F.count(F.lit(1)).alias("k"))
    values = counts.select(F.explode(F.array(*map(F.lit, ["Unknown", "T1", "T2", "Flair", "Other"]))).alias("weighting")).distinct()
    return values.join(counts, "weighting", "left").select("weighting", F.coalesce("k", F.lit(0)).alias("n"))


@query("WITH " + B.SERIES + " SELECT weighting, count(DISTINCT study) FILTER (volume AND NOT contrast) AS plain, count(DISTINCT study) FILTER (contrast) AS contrasted FROM series GROUP BY weighting")
def agg_exists_subjects(t):
    return B.series(t).groupBy("weighting").agg(F.count_distinct(F.when(c("volume") & ~c("contrast"), c("study"))).alias("plain"), F.count_distinct(F.when(c("contrast"), c("study"))).alias("contrasted"))


@query("WITH g AS (SELECT *, l_quantity - lag(l_quantity) OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_quantity) AS gap FROM lineitem), m AS (SELECT *, median(gap) OVER (PARTITION BY l_suppkey, l_returnflag) AS mid FROM g) "
       "SELECT l_suppkey, l_returnflag, count(*) AS instances, count(DISTINCT l_quantity) AS offsets, count(DISTINCT l_linestatus) AS echoes, coalesce(count(*) FILTER (gap < 1e-4) > 0, false) AS has_duplicates, any_value(mid) AS median_gap, max(abs(gap - mid)) AS deviation FROM m GROUP BY ALL")
def agg_slice_positions(t):
    keys = ["l_suppkey", "l_returnflag"]
    gapped = L.gaps(t("lineitem").select(*keys, "l_quantity", "l_linestatus"), keys, "l_quantity")
    stats = gapped.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("instances"), F.count_distinct("l_quantity").alias("offsets"), F.count_distinct("l_linestatus").alias("echoes"),
        (F.count_if(c("gap") < 1e-4) > 0).alias("has_duplicates"), F.percentile("gap", 0.5).alias("median_gap"), F.min("gap").alias("lo"), F.max("gap").alias("hi"),
    )
    return stats.withColumn("deviation", F.greatest(F.abs(c("hi") - c("median_gap")), F.abs(c("lo") - c("median_gap")))).drop("lo", "hi")


_SPLIT = "(('0x' || substr(sha256('7:' || source), 1, 16))::UBIGINT)::DOUBLE / 18446744073709551616.0::DOUBLE"
_SPLIT_NAME = f"CASE WHEN {_SPLIT} < 0.7 THEN 'train' WHEN {_SPLIT} < 0.7 + 0.15 THEN 'validation' ELSE 'test' END"


def _split(df, subject: str):
    return df.withColumn("split", H.split_name(H.split_bucket(7, c(subject)), 0.7, 0.15))


@query(f"SELECT {_SPLIT_NAME} AS split, count(DISTINCT source) AS subjects, count(*) FILTER (quality = 0) AS label0, count(*) FILTER (quality = 1) AS label1 FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def agg_split_counts(t):
    rows = _split(t("documents").select("doc_id", "source").join(t("labels"), "doc_id"), "source")
    return rows.groupBy("split").agg(F.count_distinct("source").alias("subjects"), F.count_if(c("quality") == 0).alias("label0"), F.count_if(c("quality") == 1).alias("label1"))


@query(f"WITH r AS (SELECT {_SPLIT_NAME} AS split, quality FROM documents JOIN labels USING (doc_id)), grid AS (SELECT split, quality FROM (VALUES ('train'), ('validation'), ('test')) s(split), (SELECT DISTINCT quality FROM r)) "
       "SELECT g.split, g.quality, count(r.split) AS n, count(r.split) = 0 AS degenerate FROM grid g LEFT JOIN r ON r.split = g.split AND r.quality = g.quality GROUP BY ALL")
def agg_degenerate_guard(t):
    rows = _split(t("documents").select("doc_id", "source").join(t("labels"), "doc_id"), "source")
    grid = rows.select("quality").distinct().withColumn("split", F.explode(F.array(*map(F.lit, ["train", "validation", "test"]))))
    counts = rows.groupBy("split", "quality").agg(F.count(F.lit(1)).alias("k"))
    return grid.join(counts, ["split", "quality"], "left").select("split", "quality", F.coalesce("k", F.lit(0)).alias("n"), c("k").isNull().alias("degenerate"))


@query("SELECT o_custkey, count(DISTINCT o_orderpriority) AS labels FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) > 1")
def agg_conflict_key(t):
    return t("orders").groupBy("o_custkey").agg(F.count_distinct("o_orderpriority").alias("labels")).where("labels > 1")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def agg_duplicate_key(t):
    return t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


_LABELS = "labelled AS (SELECT *, CASE WHEN v > 0.1 THEN 1 WHEN v < -0.1 THEN 2 ELSE 0 END AS label FROM voxels)"


def _labelled(t):
    return B.voxels(t).withColumn("label", F.when(c("v") > 0.1, 1).when(c("v") < -0.1, 2).otherwise(0))


@query("WITH " + B.VOXELS + ", " + _LABELS + " SELECT vol, label, count(*) AS n, count(*) * (0.9 * 0.9 * 1.5::DOUBLE) / 1000 AS millilitres FROM labelled WHERE label <> 0 GROUP BY vol, label")
def agg_region_volume(t):
    voxel = 0.9 * 0.9 * 1.5
    return _labelled(t).where("label <> 0").groupBy("vol", "label").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) * F.lit(voxel) / 1000).alias("millilitres"))


cat.ORACLES["agg_region_volume"] = cat.ORACLES["agg_region_volume"].replace("(0.9 * 0.9 * 1.5::DOUBLE)", "(0.9::DOUBLE * 0.9::DOUBLE * 1.5::DOUBLE)")


@query("WITH " + B.VOXELS + ", " + _LABELS + " SELECT vol, CASE WHEN count(*) FILTER (label <> 0) > 0 THEN round(count(*) FILTER (label = 1) / count(*) FILTER (label <> 0), 9) END AS fraction FROM labelled GROUP BY vol")
def agg_fraction(t):
    return _labelled(t).groupBy("vol").agg(F.round(F.try_divide(F.count_if(c("label") == 1), F.count_if(c("label") != 0)), 9).alias("fraction"))


@query("WITH " + B.VOXELS + " SELECT vol, z, x, max(y) AS roof FROM voxels WHERE v > 0 GROUP BY vol, z, x")
def agg_roof_profile(t):
    return B.voxels(t).where("v > 0").groupBy("vol", "z", "x").agg(F.max("y").alias("roof"))


@query("WITH " + B.VOXELS + ", r AS (SELECT vol, z, x, max(y) AS roof FROM voxels WHERE v > 0 GROUP BY vol, z, x) SELECT vol, round(regr_slope(roof, x), 8) + 0.0 AS slope, round(regr_intercept(roof, x), 8) + 0.0 AS intercept FROM r GROUP BY vol HAVING var_pop(x) > 0")
def agg_linear_fit(t):
    r = agg_roof_profile(t)
    fit = r.groupBy("vol").agg(F.round(F.regr_slope("roof", "x"), 8).alias("slope"), F.round(F.regr_intercept("roof", "x"), 8).alias("intercept"), F.var_pop("x").alias("v"))
    return fit.where("v > 0").select("vol", (c("slope") + 0.0).alias("slope"), (c("intercept") + 0.0).alias("intercept"))


@query("SELECT user_id, max(value) - min(value) AS spread FROM events WHERE event_type <> 'error' GROUP BY user_id HAVING count(value) >= 2")
def agg_slice_spread(t):
    return t("events").where("event_type <> 'error'").groupBy("user_id").agg((F.max("value") - F.min("value")).alias("spread"), F.count("value").alias("n")).where("n >= 2").drop("n")


_FOLDERS = "folders AS (SELECT page_id, split_part(url, '/', 3) AS subject, unnest(list_transform(range(1, greatest(len(string_split(url, '/')) - 1, 1) + 1), lambda i: array_to_string(string_split(url, '/')[1:i], '/'))) AS dir FROM pages)"


@query("WITH " + _FOLDERS + " SELECT dir, count(DISTINCT subject) AS subjects FROM folders GROUP BY dir")
def agg_dir_subjects(t):
    p = t("pages").select(F.split("url", "/")[2].alias("subject"), F.explode(J.ancestors(c("url"))).alias("dir"))
    return p.groupBy("dir").agg(F.count_distinct("subject").alias("subjects"))


def normal():
    return c("nx"), c("ny"), c("nz")


DIRECTION_SQL = ("CASE WHEN nx = 0 AND ny = 0 AND nz = 0 THEN 'Unknown' WHEN abs(nx) >= abs(ny) AND abs(nx) >= abs(nz) THEN CASE WHEN nx > 0 THEN 'Left' ELSE 'Right' END "
                 "WHEN abs(ny) >= abs(nz) THEN CASE WHEN ny > 0 THEN 'Posterior' ELSE 'Anterior' END WHEN nz > 0 THEN 'Superior' ELSE 'Inferior' END")
PLANE_SQL = f"CASE {DIRECTION_SQL} WHEN 'Superior' THEN 'Axial' WHEN 'Inferior' THEN 'Axial' WHEN 'Anterior' THEN 'Coronal' WHEN 'Posterior' THEN 'Coronal' WHEN 'Left' THEN 'Sagittal' WHEN 'Right' THEN 'Sagittal' ELSE 'Unknown' END"


@query("WITH " + B.SERIES + f" SELECT count(DISTINCT (study, ord)) AS series, count(*) FILTER (p = 'Axial') AS axial, count(*) FILTER (p = 'Coronal') AS coronal, count(*) FILTER (p = 'Sagittal') AS sagittal, count(*) FILTER (weighting = 'Unknown') AS unknown "
       f"FROM (SELECT *, {PLANE_SQL} AS p FROM series)")
def agg_describe_series(t):
    p = B.series(t).withColumn("p", G.plane(normal()))
    count = lambda k: F.count_if(c("p") == k).alias(k.lower())
    return p.agg(F.count_distinct("study", "ord").alias("series"), count("Axial"), count("Coronal"), count("Sagittal"), F.count_if(c("weighting") == "Unknown").alias("unknown"))


@query("SELECT count(*) FILTER (n > 1) AS repeated, count(*) AS subjects FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)")
def agg_repeated_subjects(t):
    return t("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(c("n") > 1).alias("repeated"), F.count(F.lit(1)).alias("subjects"))


@query("SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT 'dev' || l_suppkey % 7)), ' | ') AS devices FROM lineitem GROUP BY l_orderkey")
def agg_device_list(t):
    name = F.concat(F.lit("dev"), (c("l_suppkey") % 7).cast("string"))
    return t("lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set(name)), " | ").alias("devices"))


@query("WITH " + B.SERIES + " SELECT count(DISTINCT study) FILTER (volume) AS volumetric, count(DISTINCT study) FILTER (NOT contrast AND thickness <= 3) AS linear, count(DISTINCT study) FILTER (weighting = 'Flair' AND slices * spacing >= 100) AS lesions FROM series")
def agg_feasibility(t):
    conditions = {"volumetric": c("volume"), "linear": ~c("contrast") & (c("thickness") <= 3), "lesions": (c("weighting") == "Flair") & (c("slices") * c("spacing") >= 100)}
    return BM.conditional_counts(B.series(t), c("study"), conditions)


@query("SELECT o_custkey, upper(substr(sha256(string_agg(o_orderkey::VARCHAR, '|' ORDER BY o_orderkey::VARCHAR)), 1, 16)) AS fingerprint FROM orders GROUP BY o_custkey")
def agg_fingerprint(t):
    return t("orders").groupBy("o_custkey").agg(H.fingerprint(F.collect_list(c("o_orderkey").cast("string"))).alias("fingerprint"))


_TOP = "SELECT vec_id, label, list_position(embedding[1:10], list_max(embedding[1:10])) - 1 AS guess, list_sort(embedding[1:10], 'DESC')[1] - list_sort(embedding[1:10], 'DESC')[2] AS margin FROM embeddings"


@query(f"SELECT label, count(*) AS n, round(count(*) FILTER (guess = label) / count(*), 9) AS agreement, count(*) FILTER (guess <> label AND margin > 0.01) AS genuine, round(max(margin)::DOUBLE, 6) AS largest FROM ({_TOP}) GROUP BY label")
def agg_onnx_agreement(t):
    first = F.slice("embedding", 1, 10)
    ordered = F.sort_array(first, asc=False)
    x = t("embeddings").select("label", (F.array_position(first, F.array_max(first)) - 1).alias("guess"), (ordered[0] - ordered[1]).alias("margin"))
    wrong = c("guess") != c("label")
    return x.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.count_if(~wrong) / F.count(F.lit(1)), 9).alias("agreement"), F.count_if(wrong & (c("margin") > 0.01)).alias("genuine"), F.round(F.max("margin").cast("double"), 6).alias("largest"))


@query("WITH " + B.VOXELS + " SELECT vol, z, (max(x) - min(x) + 1) * 0.9::DOUBLE AS width, (max(y) - min(y) + 1) * 1.1::DOUBLE AS height FROM voxels WHERE v > 0.05 GROUP BY vol, z")
def agg_bounding_extent(t):
    extent = lambda k, mm: ((F.max(k) - F.min(k) + 1) * F.lit(mm))
    return B.voxels(t).where(c("v") > 0.05).groupBy("vol", "z").agg(extent("x", 0.9).alias("width"), extent("y", 1.1).alias("height"))


@query("WITH " + _LATEST + " SELECT grp, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.75), 6) AS p75, min(value) AS lowest, max(value) AS highest, "
       "count(*) FILTER (value >= 250000) AS over, any_value(matched) AS matched, any_value(outside) AS outside FROM last, (SELECT count(*) AS matched, (SELECT count(*) FROM automatic) - count(*) AS outside FROM pairs) GROUP BY grp")
def pip_measurement_summary(t):
    """The flagship: studies joined to their second measurement are counted, then every subject's latest is summed up."""
    matched = _pairs(t).agg(F.count(F.lit(1)).alias("matched"))
    total = B.automatic(t).agg(F.count(F.lit(1)).alias("total"))
    counts = matched.crossJoin(total).select("matched", (c("total") - c("matched")).alias("outside"))  # one row each
    return group_summary(_latest(t), "grp", "value", c("value") >= 250000).crossJoin(F.broadcast(counts))


cat.ORACLES["pip_measurement_summary"] = cat.ORACLES["pip_measurement_summary"].replace("WITH " + _LATEST, "WITH " + _LATEST + ", " + _PAIRS[len(B.STUDIES) + 2:])
