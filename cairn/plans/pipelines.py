"""Composite pipelines, protocol checks and state machines."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import dates as DT
from cairn.functions import geometry as G
from cairn.functions import hashing as H
from cairn.functions import text as T
from cairn.functions.uid import remapped
from cairn.operators import bitmaps as BM
from cairn.operators import histograms as HG
from cairn.operators import joins as J
from cairn.operators import journal as JN
from cairn.operators import publish
from cairn.operators import rules as R
from cairn.operators import selection as S
from cairn.operators.store import fresh_path
from cairn.streaming import marking, retention

from . import _bind as B
from ._catalogue import Catalogue
from .aggregates import _FOLDERS, _SPLIT_NAME, PLANE_SQL, _split, normal
from .filters import _TIER_SQL, _WELL_SQL, tier
from .projections import uid_sql

cat = Catalogue()
query = cat.query
c = F.col


@query(f"SELECT doc_id, source, {_SPLIT_NAME} AS split FROM documents")
def pip_split(t):
    """Subjects (sources) to splits by hash: deterministic, whatever the order, one split a subject."""
    R.check_ratios(0.7, 0.15, 0.15)
    return _split(t("documents").select("doc_id", "source"), "source")


@query(f"WITH e AS (SELECT doc_id, source FROM documents WHERE lang <> 'es' AND n_chars >= 500), l AS (SELECT {_SPLIT_NAME} AS split, quality, source FROM e JOIN labels USING (doc_id)), "
       "a AS (SELECT (SELECT count(*) FROM documents) - (SELECT count(*) FROM e) AS ineligible, (SELECT count(*) FROM e) - (SELECT count(*) FROM l) AS unlabelled) "
       "SELECT split, quality, count(*) AS n, count(DISTINCT source) AS subjects, any_value(ineligible) AS ineligible, any_value(unlabelled) AS unlabelled FROM l, a GROUP BY ALL")
def pip_prepare_dataset(t):
    """Eligible rows, labels, splits and the counters of what was left out."""
    docs = t("documents").select("doc_id", "source", "lang", "n_chars")
    eligible = docs.where("lang <> 'es' AND n_chars >= 500")
    labelled = _split(eligible.join(t("labels"), "doc_id"), "source")
    counts = docs.agg(F.count(F.lit(1)).alias("all"), F.count_if((c("lang") != "es") & (c("n_chars") >= 500)).alias("kept")).crossJoin(labelled.agg(F.count(F.lit(1)).alias("used")))  # one row each
    audit = counts.select((c("all") - c("kept")).alias("ineligible"), (c("kept") - c("used")).alias("unlabelled"))
    return labelled.groupBy("split", "quality").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("subjects")).crossJoin(F.broadcast(audit))


@query("WITH " + B.SERIES + f" SELECT source, count(DISTINCT study) AS studies, count(DISTINCT (study, ord)) AS series, count(*) FILTER (t = 'Extended') AS extended, count(*) FILTER (t = 'Baseline') AS baseline, count(*) FILTER (t = 'Unusable') AS unusable, count(*) FILTER (t <> 'Unusable' AND NOT contrast) AS eligible "
       f"FROM (SELECT *, CASE WHEN NOT ({_WELL_SQL}) THEN 'Unusable' ELSE {_TIER_SQL} END AS t FROM series) GROUP BY source")
def pip_inventory(t):
    """Words of studies of each source and series number, rolled up to the words of the source and then counted."""
    s = B.series(t).withColumn("t", tier())
    tallies = {k.lower(): F.count_if(c("t") == k) for k in ("Extended", "Baseline", "Unusable")} | {"eligible": F.count_if((c("t") != "Unusable") & ~c("contrast"))}
    words = s.groupBy("source", "ord", BM.word(c("study")).alias("word")).agg(F.bit_or(BM.bit(c("study"))).alias("bits"), *(v.alias(k) for k, v in tallies.items()))
    of_series = BM.size(F.when(c("ord").isNotNull(), c("bits"))).alias("series")
    words = words.groupBy("source", "word").agg(F.bit_or("bits").alias("bits"), of_series, *(F.sum(k).alias(k) for k in tallies))
    return words.groupBy("source").agg(BM.size(c("bits")).alias("studies"), F.sum("series").alias("series"), *(F.sum(k).alias(k) for k in tallies))


@query("WITH " + _FOLDERS + ", n AS (SELECT dir, count(DISTINCT subject) AS k FROM folders GROUP BY dir) SELECT a.dir, any_value(coalesce(p.k, 0)) AS parent_subjects FROM n a LEFT JOIN n p ON p.dir = array_to_string(string_split(a.dir, '/')[1:len(string_split(a.dir, '/')) - 1], '/') WHERE a.k = 1 AND coalesce(p.k, 0) <> 1 GROUP BY a.dir")
def pip_review_plan(t):
    """The highest folders that belong to one subject."""
    p = t("pages").select(F.split("url", "/")[2].alias("subject"), F.explode(J.ancestors(c("url"))).alias("dir"))
    n = p.groupBy("dir").agg(F.count_distinct("subject").alias("k"))
    parent = n.select(c("dir").alias("up"), c("k").alias("pk"))
    above = F.regexp_replace("dir", "/?[^/]*$", "")
    return n.where("k = 1").join(parent, above == c("up"), "left").where(F.coalesce("pk", F.lit(0)) != 1).select("dir", F.coalesce("pk", F.lit(0)).alias("parent_subjects"))


_NEWS = "new AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 7) AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0))"


@query(f"WITH {_NEWS} SELECT 'add' AS change, o_orderkey FROM new UNION ALL SELECT 'keep', l_orderkey FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linenumber = 7)")
def pip_dataset_add(t):
    """Planned changes of a dataset, as rows: nothing is changed by planning."""
    present = t("lineitem").where("l_linenumber = 7").select("l_orderkey").distinct()
    gone = t("customer").where("c_acctbal < 0").select("c_custkey")
    new = J.without_any(J.without_any(t("orders").select("o_orderkey", "o_custkey"), present, [("o_orderkey", "l_orderkey")]), gone, [("o_custkey", "c_custkey")])
    return new.select(F.lit("add").alias("change"), "o_orderkey").unionByName(present.select(F.lit("keep").alias("change"), c("l_orderkey").alias("o_orderkey")))


@query("SELECT o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') THEN 'exclude' ELSE 'keep' END AS change FROM orders")
def pip_dataset_exclude(t):
    out = t("lineitem").where("l_returnflag = 'R'").select("l_orderkey").distinct()
    j = t("orders").select("o_orderkey").join(out, c("o_orderkey") == c("l_orderkey"), "left")
    return j.select("o_orderkey", F.when(c("l_orderkey").isNotNull(), "exclude").otherwise("keep").alias("change"))


@query("WITH second AS (SELECT user_id, arg_min(event_id, event_id) FILTER (event_type = 'signup') AS seen FROM events GROUP BY user_id) SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN NULL ELSE c_nationkey END AS stored, seen, c_nationkey % 2 = 0 AND seen IS NOT NULL AS filled FROM customer LEFT JOIN second ON user_id = c_custkey")
def pip_dataset_demographics(t):
    second = t("events").where("event_type = 'signup'").groupBy("user_id").agg(F.min("event_id").alias("seen"))
    j = t("customer").join(second, c("user_id") == c("c_custkey"), "left")
    blank = c("c_nationkey") % 2 == 0
    return j.select("c_custkey", F.when(~blank, c("c_nationkey")).alias("stored"), "seen", (blank & c("seen").isNotNull()).alias("filled"))


@query("SELECT o_custkey, count(DISTINCT o_orderkey) AS studies, count(l_orderkey) AS files, substr(sha256(string_agg(coalesce(l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_extendedprice::DECIMAL(18,2), ''), '|' ORDER BY coalesce(l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_extendedprice::DECIMAL(18,2), ''))), 1, 16) AS content FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey")
def pip_dataset_build(t):
    """The frozen dataset, staged and published in one step: studies and files of each subject, with a hash of their contents."""
    j = t("orders").join(t("lineitem"), c("o_orderkey") == c("l_orderkey"), "left")
    name = F.coalesce(F.concat(c("l_orderkey").cast("string"), F.lit("-"), c("l_linenumber").cast("string"), F.lit("-"), c("l_partkey").cast("string"), F.lit("-"), c("l_extendedprice").cast("decimal(18,2)").cast("string")), F.lit(""))
    root = fresh_path(j.sparkSession)
    publish.replace(j.select("o_custkey", "o_orderkey", "l_orderkey", name.alias("name")), root)
    name = c("name")
    return publish.read(j.sparkSession, root).groupBy("o_custkey").agg(F.count_distinct("o_orderkey").alias("studies"), F.count("l_orderkey").alias("files"), F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list(name)), "|"), 256), 1, 16).alias("content"))


@query("WITH " + B.SERIES + f", f AS (SELECT study, bool_or(volume) AS volumetric, bool_or(p = 'Coronal') AS angle, bool_or(weighting = 'Flair') AS lesions FROM (SELECT *, {PLANE_SQL} AS p FROM series) GROUP BY study), n AS (SELECT o_custkey, row_number() OVER (ORDER BY sha256('9:' || o_custkey), o_custkey) AS k FROM (SELECT DISTINCT o_custkey FROM orders)) "
       "SELECT 'S-' || lpad(k::VARCHAR, 6, '0') AS code, count(*) FILTER (volumetric) AS volumetric, count(*) FILTER (angle) AS angle, count(*) FILTER (lesions) AS lesions FROM n JOIN orders USING (o_custkey) JOIN f ON study = o_orderkey GROUP BY 1")
def pip_reader_export(t):
    """Blind codes in shuffled order, and what is feasible for each section of the reading form."""
    f = B.series(t).groupBy("study").agg(F.bool_or("volume").alias("volumetric"), F.bool_or(G.plane(normal()) == "Coronal").alias("angle"), F.bool_or(c("weighting") == "Flair").alias("lesions"))
    subjects = t("orders").select("o_custkey").distinct().withColumn("h", F.sha2(F.concat(F.lit("9:"), c("o_custkey").cast("string")), 256))
    coded = HG.positions(subjects, ["h", "o_custkey"], "k").select("o_custkey", F.concat(F.lit("S-"), F.lpad(c("k").cast("string"), 6, "0")).alias("code"))
    j = t("orders").select("o_orderkey", "o_custkey").join(f, c("study") == c("o_orderkey")).join(coded, "o_custkey")
    return j.groupBy("code").agg(*[F.count_if(c(k)).alias(k) for k in ("volumetric", "angle", "lesions")])


_OUTCOME = "CASE WHEN value > 450000 THEN 'failed' WHEN status = 'P' THEN 'refused' ELSE 'measured' END"


@query("WITH " + B.STUDIES + f" SELECT {_OUTCOME} AS outcome, count(*) AS n, count(DISTINCT subject) AS subjects, -quantile_disc(-value, 0.5) AS upper_median FROM studies GROUP BY 1 ORDER BY n DESC, outcome")
def pip_batch_outcomes(t):
    s = B.studies(t).select(F.expr(_OUTCOME).alias("outcome"), "subject", "value")
    subjects = s.groupBy("outcome", "subject").agg(F.lit(1)).groupBy("outcome").agg(F.count("subject").alias("subjects"))
    s = S.quantiles(s, ["outcome"], "value", {"upper_median": S.upper_median()}, n=F.count(F.lit(1))).join(subjects, "outcome")
    return s.orderBy(F.desc("n"), "outcome")


@query("WITH " + B.STUDIES + ", " + B.AUTOMATIC + ", p AS (SELECT grp, value AS x, auto AS y, status FROM studies s JOIN automatic a ON a.study = s.study), arms AS (SELECT grp, unnest(['reference', 'half', 'open', 'late']) AS arm, unnest([x, x / 2, CASE WHEN status = 'O' THEN x END, CASE WHEN status <> 'F' THEN x END]) AS v, y FROM p) "
       "SELECT grp, arm, count(v) AS measured, count(*) FILTER (v IS NULL) AS refused, count(*) FILTER (abs(v - y) <= 0.05 * y) AS agreed FROM arms GROUP BY ALL")
def pip_pair_check(t):
    p = B.studies(t).join(B.automatic(t), "study")
    arms = p.select("grp", c("auto").alias("y"), F.expr("stack(4, 'reference', value, 'half', value / 2, 'open', CASE WHEN status = 'O' THEN value END, 'late', CASE WHEN status <> 'F' THEN value END) AS (arm, v)"))
    return arms.groupBy("grp", "arm").agg(F.count("v").alias("measured"), F.count_if(c("v").isNull()).alias("refused"), F.count_if(F.abs(c("v") - c("y")) <= 0.05 * c("y")).alias("agreed"))


@query("WITH " + B.STUDIES + f" SELECT nation AS site, {_OUTCOME} AS outcome, count(*) AS n, quantile_disc(value, 0.05) AS p5, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM studies GROUP BY ALL")
def pip_site_summary(t):
    s = B.studies(t).select(c("nation").alias("site"), F.expr(_OUTCOME).alias("outcome"), "value")
    return S.quantiles(s, ["site", "outcome"], "value", {"p5": S.nearest(5), "p50": S.nearest(50), "p95": S.nearest(95)}, n=F.count(F.lit(1)))


def _tags(t):
    """Orders as a long table of tags: (study, tag, value)."""
    named = F.expr("stack(4, 'PatientName', concat('cust', o_custkey), 'StudyDate', date_format(o_orderdate, 'yyyyMMdd'), 'Comment', concat('seen cust', o_custkey, ' again'), 'Priority', o_orderpriority) AS (tag, value)")
    return t("orders").select(c("o_orderkey").alias("study"), "o_custkey", named)


@query("WITH k AS (SELECT o_orderkey AS study, o_custkey, (('0x' || substr(sha256('cust' || o_custkey), 1, 8))::BIGINT % 3650 + 1)::INT AS back, o_orderdate::DATE AS d, o_orderpriority AS pr FROM orders) "
       "SELECT study, 'StudyDate' AS tag, strftime(d - back, '%Y%m%d') AS value, false AS leaks FROM k UNION ALL SELECT study, 'Comment', 'seen cust' || o_custkey || ' again', true FROM k UNION ALL SELECT study, 'Priority', pr, false FROM k")
def pip_deidentify(t):
    """Names removed, dates shifted by each subject's own number of days, and what is left audited for the secret."""
    secret = F.concat(F.lit("cust"), c("o_custkey").cast("string"))
    kept = _tags(t).where("tag <> 'PatientName'")
    value = F.when(c("tag") == "StudyDate", DT.shifted(c("value"), H.day_shift(F.sha2(secret, 256)))).otherwise(c("value"))
    return kept.withColumn("value", value).select("study", "tag", "value", T.leaks(c("value"), secret, F.lit(False)).alias("leaks"))


@query(f"SELECT o_orderkey, {uid_sql(chr(39) + 'uid:' + chr(39) + ' || o_orderkey')} AS uid FROM orders")
def pip_deidentify_uids(t):
    """The UIDs of a de-identified study: 128-bit decimals."""
    return t("orders").select("o_orderkey", remapped(F.concat(F.lit("uid:"), c("o_orderkey").cast("string"))).alias("uid"))


_POINTS = ("ordered AS (SELECT user_id, event_type, (user_id % 3)::INT AS slot, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), "
           "folded AS (SELECT DISTINCT user_id, 0::BIGINT AS n, -1 AS plane, []::DOUBLE[] AS points FROM events UNION ALL SELECT o.user_id, o.n, "
           "CASE event_type WHEN 'error' THEN plane WHEN 'signup' THEN -1 ELSE slot END, "
           "CASE WHEN event_type = 'error' THEN points[:-2] WHEN event_type = 'signup' THEN []::DOUBLE[] WHEN slot <> plane THEN [value::DOUBLE] WHEN len(points) >= 4 THEN points ELSE list_append(points, value::DOUBLE) END "
           "FROM folded f JOIN ordered o ON o.user_id = f.user_id AND o.n = f.n + 1)")


@query(f"WITH RECURSIVE {_POINTS} SELECT user_id, plane, len(points)::INT AS n_points, len(points) >= 4 AS complete, points FROM folded QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1")
def st_marking(t):
    """Point events of a session folded in order: another plane starts again, a full set ignores more, undo, reset."""
    points = t("events").select("user_id", "event_id", F.when(c("event_type") == "error", "undo").when(c("event_type") == "signup", "reset").otherwise("point").alias("action"), (c("user_id") % 3).alias("plane"), c("value").alias("x"))
    return marking.folded(points, "user_id", "event_id", 4)


_NOW = "2024-01-31 00:00:00"


@query(f"SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'kept' WHEN event_type = 'error' THEN 'orphaned' WHEN ts <= TIMESTAMP '{_NOW}' - INTERVAL 24 HOURS THEN CASE WHEN event_id % 50 = 0 THEN 'failed' ELSE 'expired' END ELSE 'kept' END AS outcome FROM events")
def st_retention_sweep(t):
    """Active copies stay, copies without a key are orphans, those of 24 hours or more expire."""
    rows = t("events").select("event_id", (c("event_type") == "purchase").alias("active"), (c("event_type") != "error").alias("has_key"), c("ts").alias("created"), (c("event_id") % 50 == 0).alias("locked"))
    return rows.select("event_id", retention.outcome(c("active"), c("has_key"), c("created"), F.lit(_NOW).cast("timestamp_ntz"), 24, c("locked")).alias("outcome"))


_HEADS = ("ordered AS (SELECT user_id, event_type || '|' || props AS payload, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), "
          "chain AS (SELECT user_id, n, sha256(repeat('0', 64) || chr(30) || payload) AS hash FROM ordered WHERE n = 1 "
          "UNION ALL SELECT o.user_id, o.n, sha256(k.hash || chr(30) || o.payload) FROM chain k JOIN ordered o ON o.user_id = k.user_id AND o.n = k.n + 1)")


@query(f"WITH RECURSIVE {_HEADS} SELECT user_id, arg_max(hash, n) AS head, count(*) AS records FROM chain GROUP BY user_id")
def st_journal(t):
    """The journal that a writer appends batch by batch: the chain goes on from the last stored hash."""
    lines = t("events").select("user_id", "event_id", F.concat("event_type", F.lit("|"), c("props")).alias("payload"))
    return JN.chained(lines, "user_id", "event_id", "payload").groupBy("user_id").agg(F.max_by("hash", "event_id").alias("head"), F.count(F.lit(1)).alias("records"))


@query("SELECT p_partkey, CASE WHEN s_suppkey IS NULL THEN 'notInstalled' WHEN p_size = 7 THEN 'alreadyActive' WHEN p_size % 5 = 0 THEN 'refused' WHEN p_partkey % 7 <> s_nationkey % 7 THEN 'versionMismatch' ELSE 'activated' END AS outcome FROM part LEFT JOIN supplier ON s_suppkey = p_partkey")
def st_model_activation(t):
    j = t("part").join(t("supplier"), c("s_suppkey") == c("p_partkey"), "left")
    rules = [("notInstalled", c("s_suppkey").isNull()), ("alreadyActive", c("p_size") == 7), ("refused", c("p_size") % 5 == 0), ("versionMismatch", c("p_partkey") % 7 != c("s_nationkey") % 7)]
    return j.select("p_partkey", R.first_match(rules, "activated").alias("outcome"))


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'refused' WHEN p_partkey IN (SELECT s_suppkey FROM supplier) THEN 'alreadyInstalled' ELSE 'installed' END AS outcome FROM part")
def st_package_install(t):
    j = t("part").join(t("supplier").select("s_suppkey"), c("s_suppkey") == c("p_partkey"), "left")
    return j.select("p_partkey", R.first_match([("refused", c("p_size") % 5 == 0), ("alreadyInstalled", c("s_suppkey").isNotNull())], "installed").alias("outcome"))


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'unreadableList' WHEN doc_id % 7 = 0 THEN 'hashMismatch' WHEN n_chars > 20000 THEN 'tooLarge' WHEN lang NOT IN ('en', 'de') THEN 'unsupported' ELSE 'valid' END AS verdict FROM documents")
def st_package_verdict(t):
    """The first test that a package fails; its checksums are compared with the content."""
    listed = F.when(c("doc_id") % 7 == 0, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.sha2("text", 256))
    line = F.when(c("doc_id") % 10 == 0, F.lit("abc  x")).otherwise(F.concat(listed, F.lit("  x")))
    stated = F.when(F.rlike(line, F.lit("^[0-9a-f]{64}  ")), F.substring(line, 1, 64))
    rules = [("unreadableList", stated.isNull()), ("hashMismatch", stated != F.sha2("text", 256)), ("tooLarge", c("n_chars") > 20000), ("unsupported", ~c("lang").isin("en", "de"))]
    return t("documents").select("doc_id", R.first_match(rules, "valid").alias("verdict"))
