"""Validation rules, quality control and guards."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cairn.functions import geometry as G
from cairn.functions import text as T
from cairn.operators import bloom
from cairn.operators import rules as R
from cairn.operators.store import durable

from . import _bind as B
from ._catalogue import Catalogue
from .joins import _ASKED_SQL, _ROLE_SQL, POLICY_SQL, asked, granted

cat = Catalogue()
query = cat.query
c = F.col

_TIER_SQL = "CASE WHEN volume AND greatest(thickness, spacing) <= 1.5 + 1e-6 THEN 'Extended' ELSE 'Baseline' END"
_WELL_SQL = "thickness > 0 AND spacing > 0 AND row_mm > 0 AND col_mm > 0 AND \"rows\" > 0 AND cols > 0 AND slices > 0"


def well_formed():
    out = F.lit(True)
    for name in ("thickness", "spacing", "row_mm", "col_mm", "rows", "cols", "slices"):
        out = out & (c(name) > 0)
    return out


def tier():
    return G.tier(well_formed(), c("volume"), c("thickness"), c("spacing"))


@query("WITH " + B.SERIES + f" SELECT study, ord, part, supp FROM series WHERE {_WELL_SQL} AND ({_TIER_SQL}) IN ('Baseline', 'Extended') AND NOT contrast")
def flt_eligible(t):
    return B.series(t).where((G.rank_of(tier(), B.TIERS) >= 1) & ~c("contrast")).select("study", "ord", "part", "supp")


@query("SELECT l_orderkey, l_linenumber, list_filter([CASE WHEN l_quantity < 5 THEN 'slice_count' END, CASE WHEN l_discount = 0 THEN 'voxel_spacing' END, CASE WHEN trim(l_returnflag) = 'N' THEN 'subject_id' END, CASE WHEN l_tax > 0.07 THEN 'tier' END], lambda x: x IS NOT NULL) AS errors FROM lineitem")
def flt_validate_series(t):
    rules = [("slice_count", c("l_quantity") < 5), ("voxel_spacing", c("l_discount") == 0), ("subject_id", F.trim("l_returnflag") == "N"), ("tier", c("l_tax") > 0.07)]
    return t("lineitem").select("l_orderkey", "l_linenumber", F.array_compact(F.array(*[F.when(holds, name) for name, holds in rules])).alias("errors"))


_REJECT = [("notDicom", "l_tax = 0.08"), ("unreadable", "l_discount = 0.1"), ("noSeries", "l_quantity <= 1"), ("noPixels", "l_suppkey % 17 = 0"), ("notMr", "l_partkey % 13 = 0"), ("notHead", "l_extendedprice < 2000")]


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, CASE " + " ".join(f"WHEN {k} THEN '{n}'" for n, k in _REJECT) + " END AS reason FROM lineitem")
def flt_reject_reason(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", R.first_match([(n, F.expr(k)) for n, k in _REJECT]).alias("reason"))


@query("SELECT doc_id, coalesce(trim(lang), '') IN ('', 'en') AS modality_ok, upper(source) IN ('SRC1', 'SRC2', 'SRC3', '') AS head_ok FROM documents")
def flt_modality(t):
    """An empty tag passes; the modality is case-sensitive, the body part is not."""
    return t("documents").select("doc_id", F.coalesce(F.trim("lang"), F.lit("")).isin("", "en").alias("modality_ok"), F.upper("source").isin("SRC1", "SRC2", "SRC3", "").alias("head_ok"))


#: (code, severity, rule); all that hold are found, in this order.
_QC = [
    ("ContrastEnhancedSeries", "Blocking", "contrast"),
    ("UnsupportedVoxelGeometry:sliceThickness", "Blocking", "thickness > 7.0 OR thickness < 0.2"),
    ("UnsupportedVoxelGeometry:rowSpacing", "Blocking", "row_mm > 2.0 OR row_mm < 0.05"),
    ("UnsupportedVoxelGeometry:columnSpacing", "Blocking", "col_mm > 2.0 OR col_mm < 0.05"),
    ("UnsupportedVoxelGeometry:sliceGap", "Warning", "spacing > thickness * 1.05"),
    ("UnsupportedVoxelGeometry:inPlaneAnisotropy", "Blocking", "greatest(row_mm, col_mm) / least(row_mm, col_mm) > 2.0"),
    ("HeadTruncated:fieldOfView", "Blocking", "cols * col_mm < 150 OR rows * row_mm < 150"),
    ("HeadTruncated:sliceCoverage", "Warning", "volume AND greatest(thickness, spacing) <= 1.5 + 1e-6 AND slices * thickness < 100"),
]
_QC_SQL = "CASE WHEN NOT (" + _WELL_SQL + ") THEN ['InconsistentGeometry'] ELSE list_filter([" + ", ".join(f"CASE WHEN {r.replace('rows *', chr(34) + 'rows' + chr(34) + ' *')} THEN '{n}' END" for n, _, r in _QC) + "], lambda x: x IS NOT NULL) END"


def findings():
    bad = F.array(F.struct(F.lit("InconsistentGeometry").alias("code"), F.lit("Blocking").alias("severity")))
    return F.when(~well_formed(), bad).otherwise(R.all_findings([(n, s, F.expr(r)) for n, s, r in _QC]))


@query("WITH " + B.SERIES + f", f AS (SELECT study, ord, part, supp, price, {_QC_SQL} AS codes FROM series) SELECT study, ord, part, supp, price, codes, "
       "len(list_filter(codes, lambda x: x NOT IN ('UnsupportedVoxelGeometry:sliceGap', 'HeadTruncated:sliceCoverage'))) = 0 AS acceptable FROM f")
def flt_qc_input(t):
    f = B.series(t).withColumn("findings", findings())
    return f.select("study", "ord", "part", "supp", "price", F.transform("findings", lambda x: x["code"]).alias("codes"), R.acceptable(c("findings")).alias("acceptable"))


_GEO = "SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_quantity > 2) AS positioned, count(DISTINCT l_linestatus) AS orientations, count(DISTINCT l_quantity) AS offsets, max(l_quantity) - min(l_quantity) AS spread, count(*) FILTER (l_tax = 0.08) AS frames FROM lineitem GROUP BY l_orderkey"


@query(f"SELECT l_orderkey, CASE WHEN frames > 0 THEN 'multiFrameInstances' WHEN positioned < n THEN 'missingSlicePositions' WHEN orientations > 1 THEN 'mixedOrientation' WHEN offsets < n THEN 'duplicateSlicePositions' WHEN spread > 40 THEN 'irregularSliceSpacing' END AS finding FROM ({_GEO})")
def flt_slice_geometry(t):
    g = t("lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(c("l_quantity") > 2).alias("positioned"), F.count_distinct("l_linestatus").alias("orientations"), F.count_distinct("l_quantity").alias("offsets"),
        (F.max("l_quantity") - F.min("l_quantity")).alias("spread"), F.count_if(c("l_tax") == 0.08).alias("frames"),
    )
    rules = [("multiFrameInstances", c("frames") > 0), ("missingSlicePositions", c("positioned") < c("n")), ("mixedOrientation", c("orientations") > 1), ("duplicateSlicePositions", c("offsets") < c("n")), ("irregularSliceSpacing", c("spread") > 40)]
    return g.select("l_orderkey", R.first_match(rules).alias("finding"))


@query("SELECT l_orderkey, CASE WHEN offsets * echoes = n AND echoes > 1 THEN 'byEcho' WHEN offsets * acquisitions = n AND acquisitions > 1 THEN 'byAcquisition' WHEN offsets < n THEN 'unexplained' END AS split FROM "
       "(SELECT l_orderkey, count(*) AS n, count(DISTINCT l_quantity) AS offsets, count(DISTINCT l_linestatus) AS echoes, count(DISTINCT l_returnflag) AS acquisitions FROM lineitem GROUP BY l_orderkey)")
def flt_stack_split(t):
    # Sets, combined before the shuffle: a count of distinct values would make four rows of each item. A set is as large as what it counts.
    several = {"offsets": "l_quantity", "echoes": "l_linestatus", "acquisitions": "l_returnflag"}
    g = t("lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), *[F.size(F.collect_set(k)).alias(name) for name, k in several.items()])
    by = lambda k: (c("offsets") * c(k) == c("n")) & (c(k) > 1)
    return g.select("l_orderkey", R.first_match([("byEcho", by("echoes")), ("byAcquisition", by("acquisitions")), ("unexplained", c("offsets") < c("n"))]).alias("split"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'burnedIn' WHEN value / 8 > 12 OR (value / 8 > 0 AND value / 8 < 0.01) THEN 'fieldStrength' END AS issue, CASE WHEN event_type = 'error' THEN 'Blocking' WHEN value / 8 > 12 OR (value / 8 > 0 AND value / 8 < 0.01) THEN 'Warning' END AS severity FROM events")
def flt_metadata(t):
    tesla = c("value") / 8
    odd = (tesla > 12) | ((tesla > 0) & (tesla < 0.01))
    burned = c("event_type") == "error"
    return t("events").select("event_id", R.first_match([("burnedIn", burned), ("fieldStrength", odd)]).alias("issue"), R.first_match([("Blocking", burned), ("Warning", odd)]).alias("severity"))


_MASK = "SELECT p_partkey, p_retailprice * 1.2 AS ml, 100.0 + p_size AS a, 110.0 + p_size * 1.1 AS b, 130.0 + p_size * 1.3 AS d FROM part"


@query(f"SELECT p_partkey, CASE WHEN ml < 900 THEN 'brainMaskTooSmall' WHEN ml > 1700 THEN 'brainMaskTooLarge' WHEN NOT (a BETWEEN 115 AND 160 AND b BETWEEN 115 AND 160 AND d BETWEEN 135 AND 195) THEN 'brainMaskExtentImplausible' END AS problem FROM ({_MASK})")
def flt_mask_quality(t):
    m = t("part").selectExpr("p_partkey", "p_retailprice * 1.2D AS ml", "100.0D + p_size AS a", "110.0D + p_size * 1.1D AS b", "130.0D + p_size * 1.3D AS d")
    plausible = c("a").between(115, 160) & c("b").between(115, 160) & c("d").between(135, 195)
    return m.select("p_partkey", R.first_match([("brainMaskTooSmall", c("ml") < 900), ("brainMaskTooLarge", c("ml") > 1700), ("brainMaskExtentImplausible", ~plausible)]).alias("problem"))


@query("SELECT o_orderkey, o_totalprice, NOT (o_totalprice BETWEEN 50000 AND 300000) AS out_of_range FROM orders")
def flt_plausible_range(t):
    """Values outside the range are flagged, never clipped or dropped."""
    return t("orders").select("o_orderkey", "o_totalprice", (~c("o_totalprice").between(50000, 300000)).alias("out_of_range"))


@query("WITH " + B.SERIES + f", f AS (SELECT study, ord, {_QC_SQL} AS codes FROM series), b AS (SELECT study, bool_or(len(list_filter(codes, lambda x: x NOT IN ('UnsupportedVoxelGeometry:sliceGap', 'HeadTruncated:sliceCoverage'))) > 0) AS blocked, "
       "array_to_string(list_sort(list_distinct(flatten(list(codes)))), ',') AS issues FROM f GROUP BY study) SELECT study, blocked, CASE WHEN blocked THEN issues END AS issues FROM b")
def flt_blocked_series(t):
    """Which studies are kept, and all issues of those that are not."""
    f = B.series(t).withColumn("findings", findings())
    codes = F.collect_set(F.transform("findings", lambda x: x["code"]))
    g = f.groupBy("study").agg(F.bool_or(~R.acceptable(c("findings"))).alias("blocked"), F.array_join(F.array_sort(F.array_distinct(F.flatten(codes))), ",").alias("issues"))
    return g.select("study", "blocked", F.when(c("blocked"), c("issues")).alias("issues"))


@query("SELECT o_orderkey, count(l_orderkey) AS written, CASE WHEN o_orderkey % 7 = 0 THEN 4 ELSE count(l_orderkey) END AS expected, CASE WHEN o_orderkey % 7 = 0 THEN count(l_orderkey) = 4 ELSE true END AS complete FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def flt_nothing_lost(t):
    counts = t("lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("k"))
    j = t("orders").select("o_orderkey").join(counts, c("o_orderkey") == c("l_orderkey"), "left").withColumn("written", F.coalesce("k", F.lit(0)))
    expected = F.when(c("o_orderkey") % 7 == 0, 4).otherwise(c("written"))
    return j.select("o_orderkey", "written", expected.alias("expected"), (c("written") == expected).alias("complete"))


@query("SELECT vec_id, len(list_filter(embedding[1:4], lambda p: p < 0 OR p > 1 OR isnan(p))) = 0 AS in_range, len(list_distinct(list_transform(embedding[1:4], lambda p: round(p, 1)))) = 4 AS all_unique FROM embeddings")
def flt_prediction_valid(t):
    p = F.slice("embedding", 1, 4)
    return t("embeddings").select("vec_id", F.forall(p, lambda x: (x >= 0) & (x <= 1) & ~F.isnan(x)).alias("in_range"), (F.size(F.array_distinct(F.transform(p, lambda x: F.round(x, 1) + F.lit(0.0)))) == 4).alias("all_unique"))


@query(f"WITH {POLICY_SQL}, a AS (SELECT event_id, {_ROLE_SQL} AS role, {_ASKED_SQL} AS capability FROM events) SELECT event_id, a.role, a.capability FROM a LEFT JOIN policy p ON p.role = a.role AND p.capability = a.capability WHERE p.role IS NULL")
def flt_access(t):
    """Denied requests, each of which becomes an audit event."""
    return asked(t).where(~granted(c("role"), c("capability")))


_SECRETS = "secrets AS (SELECT DISTINCT item_id, split_part(text, ' ', 1) AS secret, item_id % 5 = 0 AS neutral FROM benchmark UNION ALL SELECT 1000 + p_size, p_size::VARCHAR, false FROM (SELECT DISTINCT p_size FROM part))"
_NUM = "list_transform(list_filter(regexp_split_to_array(text, '[^0-9.]'), lambda x: x <> ''), lambda x: trim(x, '.'))"


@query(f"WITH {_SECRETS}, d AS (SELECT conv_id, turn, text, {_NUM} AS tokens FROM conversations) SELECT conv_id, turn, item_id FROM d, secrets WHERE CASE WHEN neutral THEN lower(trim(text)) = lower(secret) "
       "WHEN length(secret) < 8 AND regexp_full_match(secret, '[0-9.]*[0-9][0-9.]*') THEN list_contains(tokens, trim(secret, '.')) ELSE contains(lower(text), lower(secret)) END")
def flt_secret_leak(t):
    """Texts and secrets meet by equal keys, whatever the number of either, and each meeting is verified."""
    words = t("benchmark").select("item_id", F.split("text", " ")[0].alias("secret"), (c("item_id") % 5 == 0).alias("neutral")).distinct()
    numbers = t("part").select((c("p_size") + 1000).cast("long").alias("item_id"), c("p_size").cast("string").alias("secret"), F.lit(False).alias("neutral")).distinct()
    return leaking(t("conversations"), words.unionByName(numbers)).select("conv_id", "turn", "item_id")


def leaking(texts, secrets, gram: int = 5):
    """Rows of ``texts`` (with ``text``), once for each row of ``secrets`` (item_id, secret, neutral) that leaks there.

    Keys: the whole value for neutral secrets, tokens for short numbers, and for all others the first ``gram`` bytes (7
    at most), or all of a shorter one, as a number with their length. A scan of the texts keeps the keys that a Bloom
    filter of the secrets' keys lets pass; only these become rows, meet the secrets by a join and are verified.
    """
    low = F.lower("secret")
    kind = F.when(c("neutral"), 0).when(T.short_number(c("secret")), 1).otherwise(2)
    size = F.least(F.octet_length(low), F.lit(gram)).cast("long")
    packed = F.coalesce(F.conv(F.hex(F.substring(F.encode(low, "UTF-8"), 1, gram)), 16, 10).cast("long"), F.lit(0)) + size * F.lit(1 << 56)
    value = F.when(c("kind") == 0, low).when(c("kind") == 1, T.bare_number(c("secret")))
    keyed = secrets.withColumn("kind", kind).where("secret IS NOT NULL").withColumn("h", F.when(c("kind") == 2, packed).otherwise(F.xxhash64("kind", value)))
    keyed = durable(keyed.select("item_id", "secret", "neutral", "kind", "h", F.when(c("kind") == 2, size).alias("size")))
    sizes = sorted(r[0] for r in keyed.where("kind = 2").select("size").distinct().collect())
    held = texts.sparkSession.sparkContext.broadcast(bloom.table(keyed, "h"))

    def scan(batches):
        for batch in batches:
            row, h = met_keys(batch.column(1), batch.column(2), sizes, held.value)
            order = np.lexsort((h, row))
            row, h = row[order], h[order]
            new = np.ones(len(h), bool)
            new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
            row, h = row[new], h[new]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(h)], ["text_key", "h"])

    rows = texts.where("text IS NOT NULL").withColumn("text_key", F.xxhash64("text"))
    whole = F.array_append(F.transform(T.numeric_tokens(c("text")), lambda x: F.xxhash64(F.lit(1), x)), F.xxhash64(F.lit(0), F.lower(F.trim("text"))))
    met = rows.select("text_key", F.lower("text").alias("low"), whole.alias("others")).mapInArrow(scan, "text_key long, h long")
    met = durable(met.join(keyed, "h").select("text_key", "item_id", "secret", "neutral").distinct())
    return rows.join(met, "text_key").where(T.leaks(c("text"), c("secret"), c("neutral")))


#: Places of the texts whose keys are made and tested at once: some tens of MB, however many texts a batch has and however long.
PIECE = 1 << 17


def met_keys(low, others, sizes: list[int], words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the keys in texts that the filter ``words`` lets pass: every ``n`` bytes of ``low`` for the ``sizes``, and ``others``."""
    low = low.cast(pa.large_binary())
    ends = np.frombuffer(low.buffers()[1], np.int64)[low.offset: low.offset + len(low) + 1]
    data = np.frombuffer(low.buffers()[2] or b"", np.uint8)[ends[0]: ends[-1]]
    ends = ends - ends[0]
    rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def keep(row: np.ndarray, h: np.ndarray) -> None:
        some = bloom.may_hold(words, h)
        rows.append(row[some])
        found.append(h[some])

    of, tokens = np.repeat(np.arange(len(low)), others.value_lengths().to_numpy(zero_copy_only=False)), others.flatten().to_numpy(zero_copy_only=False)
    for begin in range(0, len(tokens), PIECE):
        keep(of[begin: begin + PIECE], tokens[begin: begin + PIECE])
    if 0 in sizes:
        keep(np.arange(len(low)), np.zeros(len(low), np.int64))
    sizes = [n for n in sizes if n]
    for begin in range(0, len(data) if sizes else 0, PIECE):
        piece = data[begin: begin + PIECE + sizes[-1] - 1].astype(np.int64)
        owner = np.searchsorted(ends, np.arange(begin, begin + len(piece)), "right") - 1
        for n in sizes:
            count = max(0, min(PIECE, len(piece) - n + 1))
            number = np.zeros(count, np.int64)
            for k in range(n):
                number = number << 8 | piece[k: k + count]
            inside = owner[:count] == owner[n - 1: n - 1 + count]
            keep(owner[:count][inside], number[inside] + (n << 56))
    return np.concatenate(rows), np.concatenate(found)


@query("SELECT l_orderkey, l_linenumber, l_partkey % 256 AS tag_group, l_partkey % 2 = 1 OR l_partkey % 256 IN (80, 96) OR l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) AS removed FROM lineitem")
def flt_removed_tag(t):
    profile = t("supplier").where("s_acctbal < 0").select(c("s_suppkey").alias("k"))
    j = t("lineitem").join(profile, c("l_suppkey") == c("k"), "left")
    return j.select("l_orderkey", "l_linenumber", (c("l_partkey") % 256).alias("tag_group"), ((c("l_partkey") % 2 == 1) | (c("l_partkey") % 256).isin(80, 96) | c("k").isNotNull()).alias("removed"))


@query("SELECT page_id, NOT (starts_with(url, 'http://blog.') OR contains(url, '/en/')) AS allowed FROM pages")
def flt_path_guard(t):
    return t("pages").select("page_id", (~(F.startswith("url", F.lit("http://blog.")) | F.contains("url", F.lit("/en/")))).alias("allowed"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice NOT BETWEEN 1000 AND 450000 THEN 'outOfRange' WHEN o_custkey % 10 = 0 THEN 'accessDenied' ELSE 'stored' END AS decision FROM orders")
def flt_record_guard(t):
    """The range is tested before access, and neither kind is stored."""
    return t("orders").select("o_orderkey", R.first_match([("outOfRange", ~c("o_totalprice").between(1000, 450000)), ("accessDenied", c("o_custkey") % 10 == 0)], "stored").alias("decision"))


@query("SELECT c_mktsegment, count(o_orderkey) = 0 AS all_empty, count(DISTINCT c_custkey) AS studies FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 499000 GROUP BY c_mktsegment")
def flt_export_guard(t):
    big = t("orders").where("o_totalprice > 499000")
    return t("customer").join(big, c("o_custkey") == c("c_custkey"), "left").groupBy("c_mktsegment").agg((F.count("o_orderkey") == 0).alias("all_empty"), F.count_distinct("c_custkey").alias("studies"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND c_acctbal < 0 THEN 'notInRegistry' WHEN o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' THEN 'needsAcknowledgement' WHEN o_orderstatus = 'F' THEN 'clinical' ELSE 'deidentified' END AS variant FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def flt_report_variant(t):
    j = t("orders").join(t("customer"), c("c_custkey") == c("o_custkey"), "left")
    f = c("o_orderstatus") == "F"
    return j.select("o_orderkey", R.first_match([("notInRegistry", f & (c("c_acctbal") < 0)), ("needsAcknowledgement", (c("o_orderstatus") == "O") & (c("o_orderpriority") == "1-URGENT")), ("clinical", f)], "deidentified").alias("variant"))


@query("SELECT l_suppkey, round(avg(l_discount), 9) AS train, NOT (avg(l_discount) < 0) AND abs(round(avg(l_discount), 9) + round(1 - avg(l_discount), 9) - 1) <= 1e-9 AS valid FROM lineitem GROUP BY l_suppkey")
def flt_split_ratios(t):
    g = t("lineitem").groupBy("l_suppkey").agg(F.avg("l_discount").alias("a"))
    a, b = F.round("a", 9), F.round(1 - c("a"), 9)
    return g.select("l_suppkey", a.alias("train"), ((c("a") >= 0) & (F.abs(a + b - 1) <= 1e-9)).alias("valid"))
