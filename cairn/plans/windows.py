"""Order-dependent queries: latest, best, numbered, chained, histogram thresholds; sorts, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.operators import histograms as HG
from cairn.operators import joins as J
from cairn.operators import journal as JN
from cairn.operators import latest as L
from cairn.operators import publish
from cairn.operators.store import fresh_path

from . import _bind as B
from ._catalogue import Catalogue

cat = Catalogue()
query = cat.query
c = F.col


@query("WITH " + B.STUDIES + " SELECT subject, study, recorded, value FROM studies QUALIFY row_number() OVER (PARTITION BY subject ORDER BY recorded DESC, study) = 1")
def win_latest(t):
    return L.latest(B.studies(t), ["subject"], "recorded", "study").select("subject", "study", "recorded", "value")


@query("WITH " + B.STUDIES + " SELECT subject, (SELECT max_by(study, (recorded, -study)) FROM studies e WHERE e.subject = s.subject AND status <> 'O') AS evans, "
       "(SELECT max_by(study, (recorded, -study)) FROM studies e WHERE e.subject = s.subject AND status <> 'F') AS angle, max(study) AS automatic FROM studies s GROUP BY subject")
def win_latest_strict(t):
    """Two measurements tracked apart, the earliest seen on a tie; the automatic one is the last enumerated."""
    newest = lambda cond, name: F.max_by(F.when(cond, c("study")), F.when(cond, F.struct("recorded", -c("study")))).alias(name)
    return B.studies(t).groupBy("subject").agg(newest(c("status") != "O", "evans"), newest(c("status") != "F", "angle"), F.max("study").alias("automatic"))


@query("SELECT user_id, event_type, event_id, (props->>'k')::INT AS k FROM events WHERE event_type IN ('click', 'view') QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) = 1")
def win_latest_marking(t):
    marks = t("events").where(c("event_type").isin("click", "view")).select("user_id", "event_type", "event_id", "ts", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return L.latest(marks, ["user_id", "event_type"], "ts", "event_id").drop("ts")


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, l_extendedprice, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS occurrences FROM lineitem "
       "QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_quantity DESC, l_returnflag, l_extendedprice) = 1")
def win_best_occurrence(t):
    """The copy with most slices; of equals that of the earliest source."""
    best = F.min_by(F.struct("l_quantity", "l_returnflag", "l_extendedprice"), F.struct(-c("l_quantity"), "l_returnflag", "l_extendedprice")).alias("b")
    return t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(best, F.count(F.lit(1)).alias("occurrences")).select("l_orderkey", "l_linenumber", "b.*", "occurrences")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def win_first_wins(t):
    return t("events").groupBy("user_id").agg(F.min_by(F.struct("event_id", "event_type"), "event_id").alias("b")).select("user_id", "b.*")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) > 1 AND l_orderkey <> 0 AS rejected FROM lineitem")
def win_dedup_instance(t):
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_extendedprice")
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", ((F.row_number().over(w) > 1) & (c("l_orderkey") != 0)).alias("rejected"))


@query("SELECT user_id, arg_min(value, event_id) FILTER (event_type = 'purchase') AS first_purchase, arg_min(event_type, event_id) AS first_type FROM events GROUP BY user_id")
def win_first_non_null(t):
    bought = F.when(c("event_type") == "purchase", c("value"))
    return t("events").groupBy("user_id").agg(F.min_by(bought, F.when(bought.isNotNull(), c("event_id"))).alias("first_purchase"), F.min_by("event_type", "event_id").alias("first_type"))


_RANKED = ("CASE WHEN slices * spacing >= 100 THEN 1 ELSE 0 END DESC, CASE WHEN volume AND greatest(thickness, spacing) <= 1.5 + 1e-6 THEN 2 ELSE 1 END DESC, "
           "CASE WHEN abs(nz) > abs(nx) AND abs(nz) > abs(ny) AND NOT (volume AND greatest(thickness, spacing) <= 1.5 + 1e-6) THEN 1 ELSE 0 END DESC, "
           "CASE weighting WHEN 'T1' THEN 3 WHEN 'Flair' THEN 2 WHEN 'T2' THEN 1 ELSE 0 END DESC, slices DESC, ord, part, supp, price")


def _ranked_series(t):
    tier = F.when(c("volume") & (F.greatest("thickness", "spacing") <= 1.5 + 1e-6), 2).otherwise(1)
    axial = F.when((F.abs("nz") > F.abs("nx")) & (F.abs("nz") > F.abs("ny")) & (tier == 1), 1).otherwise(0)
    liked = F.when(c("weighting") == "T1", 3).when(c("weighting") == "Flair", 2).when(c("weighting") == "T2", 1).otherwise(0)
    covers = F.when(c("slices") * c("spacing") >= 100, 1).otherwise(0)
    return B.series(t).where("NOT contrast").withColumn("key", F.struct(-covers, -tier, -axial, -liked, -c("slices"), c("ord"), c("part"), c("supp"), c("price")))


@query("WITH " + B.SERIES + f" SELECT study, ord, part, supp, price, row_number() OVER (PARTITION BY study ORDER BY {_RANKED}) AS place FROM series WHERE NOT contrast")
def win_rank_series(t):
    w = Window.partitionBy("study").orderBy("key")
    return _ranked_series(t).select("study", "ord", "part", "supp", "price", F.row_number().over(w).alias("place"))


@query("WITH " + B.SERIES + f" SELECT study, ord, part, supp FROM series WHERE NOT contrast ORDER BY {_RANKED}, study LIMIT 1")
def win_best_study(t):
    """A hash aggregate instead of a global window: one row leaves each task."""
    best = F.min_by(F.struct("study", "ord", "part", "supp"), F.struct("key", "study")).alias("b")
    return _ranked_series(t).agg(best).select("b.*")


@query("WITH " + B.SERIES + " SELECT study, ord, part, price FROM series WHERE weighting = 'Flair' QUALIFY row_number() OVER (PARTITION BY study ORDER BY slices * spacing DESC, spacing, ord, part, price) = 1")
def win_choose_flair(t):
    best = F.min_by(F.struct("ord", "part", "price"), F.struct(-(c("slices") * c("spacing")), "spacing", "ord", "part", "price")).alias("b")
    return B.series(t).where("weighting = 'Flair'").groupBy("study").agg(best).select("study", "b.*")


@query("WITH " + B.SERIES + " SELECT study, ord, part, price FROM series WHERE weighting = 'T1' QUALIFY row_number() OVER (PARTITION BY study ORDER BY volume DESC, slices * spacing DESC, ord, part, price) = 1")
def win_choose_t1(t):
    best = F.min_by(F.struct("ord", "part", "price"), F.struct((~c("volume")).cast("int"), -(c("slices") * c("spacing")), "ord", "part", "price")).alias("b")
    return B.series(t).where("weighting = 'T1'").groupBy("study").agg(best).select("study", "b.*")


@query("SELECT l_suppkey, l_quantity, l_quantity - lag(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_quantity) AS gap FROM lineitem")
def win_gaps(t):
    return L.gaps(t("lineitem").select("l_suppkey", "l_quantity"), ["l_suppkey"], "l_quantity")


@query("SELECT p_partkey, CASE WHEN n = 1 THEN p_name ELSE p_name || ' (' || n || ')' END AS shown FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)")
def win_sequence_name(t):
    n = L.numbered(t("part").select("p_partkey", "p_name"), ["p_name"], [c("p_partkey")], "n")
    return n.select("p_partkey", F.when(c("n") == 1, c("p_name")).otherwise(F.concat("p_name", F.lit(" ("), c("n").cast("string"), F.lit(")"))).alias("shown"))


_SHUFFLED = "row_number() OVER (ORDER BY sha256('42:' || o_custkey), o_custkey)"


@query(f"WITH s AS (SELECT o_custkey, {_SHUFFLED} AS n FROM (SELECT DISTINCT o_custkey FROM orders)) SELECT o_orderkey, 'S-' || lpad(n::VARCHAR, 6, '0') AS case_code, 'SER' || lpad((row_number() OVER (PARTITION BY o.o_custkey ORDER BY o_orderkey))::VARCHAR, 2, '0') AS series_code FROM orders o JOIN s USING (o_custkey)")
def win_case_code(t):
    subjects = t("orders").select("o_custkey").distinct()
    coded = HG.positions(subjects.withColumn("h", F.sha2(F.concat(F.lit("42:"), c("o_custkey").cast("string")), 256)), ["h", "o_custkey"], "n")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return t("orders").select("o_orderkey", "o_custkey").withColumn("k", F.row_number().over(w)).join(coded, "o_custkey").select(
        "o_orderkey", F.concat(F.lit("S-"), F.lpad(c("n").cast("string"), 6, "0")).alias("case_code"), F.concat(F.lit("SER"), F.lpad(c("k").cast("string"), 2, "0")).alias("series_code"))


@query("SELECT c_custkey, row_number() OVER (ORDER BY sha256('42:' || c_custkey), c_custkey) AS place FROM customer")
def win_shuffle(t):
    keyed = t("customer").select("c_custkey", F.sha2(F.concat(F.lit("42:"), c("c_custkey").cast("string")), 256).alias("h"))
    return HG.positions(keyed, ["h", "c_custkey"], "place").select("c_custkey", "place")


_UNMEASURED = "open AS (SELECT c_custkey, sha256('w:' || c_custkey) AS pos FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice >= 400000))"


@query(f"WITH {_UNMEASURED} SELECT c_custkey FROM open ORDER BY pos <= sha256('w:77'), pos, c_custkey LIMIT 1")
def win_worklist_next(t):
    """The next unmeasured subject after the current one, from the start again at the end."""
    measured = t("orders").where("o_totalprice >= 400000").select(c("o_custkey").alias("c_custkey")).distinct()
    pos = F.sha2(F.concat(F.lit("w:"), c("c_custkey").cast("string")), 256)
    left = t("customer").select("c_custkey").join(measured, "c_custkey", "left_anti")
    return left.orderBy(pos <= F.sha2(F.lit("w:77"), 256), pos, "c_custkey").limit(1)


_PAYLOAD = "event_type || '|' || value"
_CHAIN = ("ordered AS (SELECT user_id, event_id, event_type || '|' || event_id AS payload, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), "
          "chain AS (SELECT user_id, event_id, n, repeat('0', 64) AS prev, sha256(repeat('0', 64) || chr(30) || payload) AS hash FROM ordered WHERE n = 1 "
          "UNION ALL SELECT o.user_id, o.event_id, o.n, k.hash, sha256(k.hash || chr(30) || o.payload) FROM chain k JOIN ordered o ON o.user_id = k.user_id AND o.n = k.n + 1)")


def _journal(t):
    return t("events").select("user_id", "event_id", F.concat("event_type", F.lit("|"), c("event_id").cast("string")).alias("payload"))


@query(f"WITH RECURSIVE {_CHAIN} SELECT user_id, event_id, prev, hash FROM chain")
def win_chain_build(t):
    return JN.chained(_journal(t), "user_id", "event_id", "payload").select("user_id", "event_id", "prev", "hash")


@query(f"WITH RECURSIVE {_CHAIN} SELECT user_id, event_id, '{{\"event\":\"' || (SELECT payload FROM ordered o WHERE o.user_id = chain.user_id AND o.n = chain.n) || '\",\"previousHash\":\"' || prev || '\",\"hash\":\"' || hash || '\"}}' AS line FROM chain")
def sink_append_chain(t):
    """The journals' lines, each with the hash of the one before it, appended to a published table and read from it."""
    rows = JN.chained(_journal(t), "user_id", "event_id", "payload")
    root = fresh_path(rows.sparkSession)
    publish.update(rows.sparkSession, root, lambda head: (rows, False, lambda staged: {}))
    return publish.read(rows.sparkSession, root).select("user_id", "event_id", F.to_json(F.struct(c("payload").alias("event"), c("prev").alias("previousHash"), "hash")).alias("line"))


_TAMPERED = "(user_id * 7 + n) % 97 = 5"


@query(f"WITH RECURSIVE {_CHAIN}, bad AS (SELECT user_id, n, min(n) FILTER ({_TAMPERED}) OVER (PARTITION BY user_id) AS broken, event_id FROM chain) "
       "SELECT user_id, event_id, n AS number, CASE WHEN broken IS NULL OR n < broken THEN 'Verified' WHEN n = broken THEN 'Broken' ELSE 'Unverifiable' END AS state, broken - 1 AS first_broken FROM bad")
def win_chain_verify(t):
    """A journal some of whose payloads were edited after it was written."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    written = JN.chained(_journal(t), "user_id", "event_id", "payload").withColumn("n", F.row_number().over(w))
    edited = written.withColumn("payload", F.when(F.expr(_TAMPERED), F.concat("payload", F.lit("!"))).otherwise(c("payload"))).drop("n")
    return JN.verified(edited, "user_id", "event_id", "payload").select("user_id", "event_id", "number", "state", "first_broken")


_OTSU = ("lim AS (SELECT vol, min(v) AS lo, max(v) AS hi FROM voxels GROUP BY vol), b AS (SELECT vol, floor((v - lo) / (hi - lo) * 255)::INT AS bin, count(*) AS n FROM voxels JOIN lim USING (vol) GROUP BY ALL), "
         "s AS (SELECT vol, bin, sum(n) OVER w AS bc, sum(bin * n) OVER w AS bs, sum(n) OVER (PARTITION BY vol) AS total, sum(bin * n) OVER (PARTITION BY vol) AS all_sum FROM b WINDOW w AS (PARTITION BY vol ORDER BY bin)), "
         "q AS (SELECT *, bc::DOUBLE * (total - bc)::DOUBLE * (bs / bc - (all_sum - bs) / (total - bc)) * (bs / bc - (all_sum - bs) / (total - bc)) AS variance FROM s WHERE total > bc)")


@query("WITH " + B.VOXELS + ", " + _OTSU + " SELECT vol, bin, round(lo + (bin + 1.0::DOUBLE) * (hi - lo) / 256, 9) AS threshold FROM q JOIN lim USING (vol) QUALIFY row_number() OVER (PARTITION BY vol ORDER BY variance DESC, bin) = 1")
def win_otsu(t):
    return HG.otsu(B.voxels(t), "vol", "v").select("vol", "bin", F.round("threshold", 9).alias("threshold"))


@query("WITH " + B.VOXELS + ", lim AS (SELECT vol, min(v) AS lo, max(v) AS hi, count(*) AS total FROM voxels GROUP BY vol), b AS (SELECT vol, floor((v - lo) * (1023 / (hi - lo)))::INT AS bin, count(*) AS n FROM voxels JOIN lim USING (vol) GROUP BY ALL), "
       "s AS (SELECT vol, bin, sum(n) OVER (PARTITION BY vol ORDER BY bin) AS seen FROM b) SELECT vol, min(bin) FILTER (seen >= floor(total * 0.02)) AS low_bin, min(bin) FILTER (seen >= floor(total * 0.98)) AS high_bin FROM s JOIN lim USING (vol) GROUP BY vol")
def win_histogram_quantile(t):
    return HG.histogram_quantiles(B.voxels(t), "vol", "v", 1024, {"low_bin": 0.02, "high_bin": 0.98})


@query("WITH " + B.VOXELS + ", lim AS (SELECT vol, min(v) AS lo, max(v) AS hi, count(*) FILTER (v > 0) AS filled, count(*) AS total FROM voxels GROUP BY vol), b AS (SELECT vol, least(floor((v - lo) / (hi - lo) * 1000)::INT, 999) AS bin, count(*) AS n FROM voxels JOIN lim USING (vol) GROUP BY ALL), "
       "s AS (SELECT vol, bin, sum(n) OVER (PARTITION BY vol ORDER BY bin) AS seen FROM b), k AS (SELECT vol, min(bin) FILTER (seen >= total - floor(0.001 * filled)) - 1 AS cut FROM s JOIN lim USING (vol) GROUP BY vol) "
       "SELECT vol, cut, round(255 / (lo + (cut + 1) * (hi - lo) / 1000 - lo), 6) AS factor FROM k JOIN lim USING (vol)")
def win_robust_scale(t):
    return HG.robust_scale(B.voxels(t), "vol", "v").select("vol", "cut", F.round("factor", 6).alias("factor"))


@query("SELECT source, lang, n FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) WHERE n >= 5 QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) <= 2")
def win_components_capped(t):
    """The two largest parts of each source that have a least size."""
    sizes = t("documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n")).where("n >= 5")
    return L.numbered(sizes, ["source"], [F.desc("n"), c("lang")], "k").where("k <= 2").drop("k")


# ---- sorts, limits, top-k


@query("SELECT p_name, p_partkey FROM part ORDER BY p_name, p_partkey")
def srt_ordinal(t):
    return t("part").select("p_name", "p_partkey").orderBy("p_name", "p_partkey")


@query("SELECT p_name, p_partkey FROM part ORDER BY p_name, p_partkey")
def srt_culture(t):
    """By the rules of the Unicode collation instead of code points."""
    return t("part").select("p_name", "p_partkey").orderBy(F.collate("p_name", "UNICODE"), "p_partkey")


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY ALL ORDER BY n DESC, o_orderpriority")
def srt_count_desc_key(t):
    return t("orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "o_orderpriority")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def lim_limit(t):
    return t("orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("SELECT c_nationkey, c_custkey, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 3")
def top_components(t):
    return L.numbered(t("customer").select("c_nationkey", "c_custkey", "c_acctbal"), ["c_nationkey"], [F.desc("c_acctbal"), c("c_custkey")], "k").where("k <= 3").drop("k")


@query("SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS class FROM embeddings")
def top_most_likely(t):
    return t("embeddings").select("vec_id", (F.array_position("embedding", F.array_max("embedding")) - 1).cast("int").alias("class"))


@query("SELECT p_brand, arg_max(p_name, (length(p_name), p_name)) AS longest FROM part GROUP BY p_brand")
def top_longest_name(t):
    return t("part").groupBy("p_brand").agg(F.max_by("p_name", F.struct(F.length("p_name"), "p_name")).alias("longest"))


# ---- sets


@query("SELECT c_name AS name, c_nationkey AS nation FROM customer UNION ALL SELECT s_name, s_nationkey FROM supplier")
def set_union_all(t):
    return t("customer").select(c("c_name").alias("name"), c("c_nationkey").alias("nation")).unionByName(t("supplier").select(c("s_name").alias("name"), c("s_nationkey").alias("nation")))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_except(t):
    return t("customer").select(c("c_custkey").alias("k")).subtract(t("orders").where("o_orderstatus = 'P'").select("o_custkey"))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union_distinct(t):
    return t("customer").select(c("c_nationkey").alias("k")).union(t("supplier").select("s_nationkey")).distinct()


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 7) UNION ALL SELECT l_orderkey, round(sum(l_extendedprice), 4) FROM lineitem WHERE l_linenumber = 7 GROUP BY l_orderkey")
def set_replace_by_key(t):
    new = t("lineitem").where("l_linenumber = 7").groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.round(F.sum("l_extendedprice"), 4).alias("o_totalprice"))
    return J.upsert(t("orders").select("o_orderkey", "o_totalprice"), new, ["o_orderkey"])


@query("SELECT event_type, min(event_id) AS first_seen FROM events GROUP BY event_type ORDER BY first_seen")
def set_distinct_groups(t):
    return t("events").groupBy("event_type").agg(F.min("event_id").alias("first_seen")).orderBy("first_seen")


@query("SELECT source, list_sort(list_filter(['de', 'en', 'es', 'fr', 'it'], lambda x: NOT list_contains(list(DISTINCT lang), x))) AS missing FROM documents GROUP BY source")
def set_intersect_classes(t):
    everything = F.array(*map(F.lit, ["de", "en", "es", "fr", "it"]))
    return t("documents").groupBy("source").agg(F.array_sort(F.array_except(everything, F.collect_set("lang"))).alias("missing"))
