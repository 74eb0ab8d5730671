"""Lookups as joins, and the worklists and maintenance plans made of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import joins as J

from . import _bind as B
from ._catalogue import Catalogue

cat = Catalogue()
query = cat.query
c = F.col


def _eligible(t):
    return t("documents").where("lang <> 'es' AND n_chars >= 500").select("doc_id", "source", "lang")


@query("SELECT doc_id, source, quality FROM documents JOIN labels USING (doc_id) WHERE lang <> 'es' AND n_chars >= 500")
def jn_labels_inner(t):
    return _eligible(t).join(t("labels"), "doc_id").select("doc_id", "source", "quality")


@query("SELECT doc_id FROM documents WHERE lang <> 'es' AND n_chars >= 500 AND doc_id NOT IN (SELECT doc_id FROM labels)")
def jn_labels_anti(t):
    return _eligible(t).join(t("labels"), "doc_id", "left_anti").select("doc_id").distinct()


@query("WITH r AS (SELECT o_orderkey AS k, o_totalprice, o_orderstatus FROM orders WHERE o_orderkey % 3 <> 0) SELECT l_orderkey, l_linenumber, l_partkey, "
       "CASE WHEN a.k IS NOT NULL THEN a.o_totalprice ELSE b.o_totalprice END AS price, CASE WHEN a.k IS NOT NULL THEN a.o_orderstatus ELSE b.o_orderstatus END AS status "
       "FROM lineitem LEFT JOIN r a ON a.k = l_orderkey LEFT JOIN r b ON b.k = l_partkey AND l_partkey <> l_orderkey")
def jn_fallback_key(t):
    right = t("orders").where("o_orderkey % 3 <> 0").select(c("o_orderkey").alias("k"), "o_totalprice", "o_orderstatus")
    left = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return J.fallback_join(left, right, "l_orderkey", "l_partkey", "k").select("l_orderkey", "l_linenumber", "l_partkey", c("found.o_totalprice").alias("price"), c("found.o_orderstatus").alias("status"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice >= 400000)")
def jn_semi_measured(t):
    return t("customer").join(t("orders").where("o_totalprice >= 400000"), c("c_custkey") == c("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT (SELECT count(*) FROM lineitem WHERE l_linenumber = 1) - (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 1 AND o_orderstatus = 'F') AS outside")
def jn_outside_count(t):
    first = t("lineitem").where("l_linenumber = 1")
    matched = first.join(t("orders").where("o_orderstatus = 'F'"), c("l_orderkey") == c("o_orderkey"))
    return first.agg(F.count(F.lit(1)).alias("a")).crossJoin(matched.agg(F.count(F.lit(1)).alias("b"))).select((c("a") - c("b")).alias("outside"))  # one row each


@query("WITH " + B.STUDIES + ", " + B.AUTOMATIC + " SELECT s.study, subject, value, round(auto, 4) AS auto FROM studies s JOIN automatic a ON a.study = s.study")
def jn_pairs(t):
    return B.studies(t).join(B.automatic(t), "study").select("study", "subject", "value", F.round("auto", 4).alias("auto"))


@query("WITH d AS (SELECT l_returnflag AS grp, l_suppkey AS subject, count(*) AS n FROM lineitem GROUP BY ALL) SELECT grp, subject, n, s_suppkey IS NOT NULL AS known FROM d LEFT JOIN supplier ON s_suppkey = subject AND s_acctbal > 0")
def jn_decisions(t):
    """Decisions with whether their subject is known; any unknown one stops the plan before a change."""
    decisions = t("lineitem").groupBy(c("l_returnflag").alias("grp"), c("l_suppkey").alias("subject")).agg(F.count(F.lit(1)).alias("n"))
    known = t("supplier").where("s_acctbal > 0").select("s_suppkey")
    return decisions.join(known, c("subject") == c("s_suppkey"), "left").select("grp", "subject", "n", c("s_suppkey").isNotNull().alias("known"))


@query("SELECT o_orderkey, o_custkey, o_orderpriority FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders r WHERE r.o_orderstatus = 'P' AND r.o_custkey = o.o_custkey AND r.o_orderpriority = o.o_orderpriority)")
def jn_exclude(t):
    removed = t("orders").where("o_orderstatus = 'P'").select("o_custkey", "o_orderpriority")
    return t("orders").select("o_orderkey", "o_custkey", "o_orderpriority").join(removed, ["o_custkey", "o_orderpriority"], "left_anti").select("o_orderkey", "o_custkey", "o_orderpriority")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 7) AND o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def jn_add_new(t):
    """Not present yet, and removed before neither by study nor by subject: hashable anti joins instead of an OR."""
    new = t("orders").select("o_orderkey", "o_custkey")
    present = t("lineitem").where("l_linenumber = 7").select("l_orderkey")
    removed = t("orders").where("o_orderstatus = 'P'").select(c("o_orderkey").alias("study"))
    gone = t("customer").where("c_acctbal < 0").select("c_custkey")
    left = J.without_any(new, present, [("o_orderkey", "l_orderkey")])
    return J.without_any(J.without_any(left, removed, [("o_orderkey", "study")]), gone, [("o_custkey", "c_custkey")])


@query("WITH f AS (SELECT user_id, arg_min(value, event_id) FILTER (value > 50) AS filled FROM events GROUP BY user_id) SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal END, filled) AS balance FROM customer LEFT JOIN f ON user_id = c_custkey")
def jn_demographics(t):
    kept = F.when(c("value") > 50, c("value"))
    second = t("events").groupBy("user_id").agg(F.min_by(kept, F.when(kept.isNotNull(), c("event_id"))).alias("filled"))
    return t("customer").join(second, c("user_id") == c("c_custkey"), "left").select("c_custkey", F.coalesce(F.when(c("c_acctbal") > 0, c("c_acctbal")), c("filled")).alias("balance"))


@query("WITH p AS (SELECT o_orderkey, o_custkey FROM orders), ref AS (SELECT o_custkey, max(o_totalprice) AS reference FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey), fl AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R') "
       "SELECT count(*) AS planned, count(*) FILTER (reference IS NULL) AS unpaired, count(*) FILTER (l_orderkey IS NULL) AS without_flair, count(*) FILTER (reference IS NOT NULL AND l_orderkey IS NOT NULL) AS paired FROM p LEFT JOIN ref USING (o_custkey) LEFT JOIN fl ON l_orderkey = o_orderkey")
def jn_reference_pair(t):
    reference = t("orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.max("o_totalprice").alias("reference"))
    flair = t("lineitem").where("l_returnflag = 'R'").select("l_orderkey").distinct()
    p = t("orders").select("o_orderkey", "o_custkey").join(reference, "o_custkey", "left").join(flair, c("l_orderkey") == c("o_orderkey"), "left")
    return p.agg(F.count(F.lit(1)).alias("planned"), F.count_if(c("reference").isNull()).alias("unpaired"), F.count_if(c("l_orderkey").isNull()).alias("without_flair"), F.count_if(c("reference").isNotNull() & c("l_orderkey").isNotNull()).alias("paired"))


_DIRS = "dirs AS (SELECT DISTINCT 'http://' || split_part(url, '/', 3) || '/en' AS dir FROM pages)"


@query(f"WITH {_DIRS} SELECT page_id, url FROM pages WHERE EXISTS (SELECT 1 FROM dirs WHERE starts_with(url, dir || '/'))")
def jn_dir_cover(t):
    dirs = t("pages").select(F.concat(F.lit("http://"), F.split("url", "/")[2], F.lit("/en")).alias("dir")).distinct()
    return J.covered_by(t("pages").select("page_id", "url"), "url", dirs, "dir")


#: What each role may do.
POLICY = {
    "Clinician": ["AnalyseStudy", "ExportDeidentifiedReport", "ExportClinicalReport", "RecordMeasurement"],
    "Researcher": ["AnalyseStudy", "ExportDeidentifiedReport", "ExportDatasetManifest"],
    "Administrator": ["ReadAuditLog", "InstallModelPackage"],
    "Unspecified": [],
}
POLICY_SQL = "policy(role, capability) AS (VALUES " + ", ".join(f"('{r}', '{k}')" for r, ks in POLICY.items() for k in ks) + ")"
_ROLE_SQL = "['Clinician', 'Researcher', 'Administrator', 'Unspecified', 'Guest'][user_id % 5 + 1]"
_ASKED_SQL = "CASE event_type WHEN 'view' THEN 'AnalyseStudy' WHEN 'click' THEN 'ExportClinicalReport' WHEN 'signup' THEN 'ReadAuditLog' WHEN 'purchase' THEN 'ExportDatasetManifest' ELSE 'RecordMeasurement' END"


def asked(t):
    """Events as requests of actors: (event_id, role, capability)."""
    role = F.element_at(F.array(*map(F.lit, [*POLICY, "Guest"])), (c("user_id") % 5 + 1).cast("int"))
    wants = F.when(c("event_type") == "view", "AnalyseStudy").when(c("event_type") == "click", "ExportClinicalReport").when(c("event_type") == "signup", "ReadAuditLog").when(c("event_type") == "purchase", "ExportDatasetManifest").otherwise("RecordMeasurement")
    return t("events").select("event_id", role.alias("role"), wants.alias("capability"))


def granted(role, capability):
    """The policy as an expression: program text, so no join is needed."""
    out = F.lit(False)
    for name, capabilities in POLICY.items():
        out = F.when(role == name, capability.isin(*capabilities) if capabilities else F.lit(False)).otherwise(out)
    return out


@query(f"WITH {POLICY_SQL}, a AS (SELECT event_id, {_ROLE_SQL} AS role, {_ASKED_SQL} AS capability FROM events) SELECT a.role, a.capability, count(*) AS n, count(p.role) AS allowed FROM a LEFT JOIN policy p ON p.role = a.role AND p.capability = a.capability GROUP BY ALL")
def jn_policy(t):
    return asked(t).groupBy("role", "capability").agg(F.count(F.lit(1)).alias("n"), F.count_if(granted(c("role"), c("capability"))).alias("allowed"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size >= 25)")
def jn_files_by_series(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(t("part").where("p_size >= 25"), c("l_partkey") == c("p_partkey"), "left_semi")
