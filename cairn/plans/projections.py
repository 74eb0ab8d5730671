"""Row-level classification, geometry and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import dates as DT
from cairn.functions import geometry as G
from cairn.functions import matrices as M
from cairn.functions import hashing as H
from cairn.functions import text as T
from cairn.functions import uid as UID

from . import _bind as B
from ._catalogue import Catalogue
from .aggregates import DIRECTION_SQL, PLANE_SQL, normal
from .filters import _TIER_SQL, _WELL_SQL, tier, well_formed

cat = Catalogue()
query = cat.query
c = F.col
_S = "WITH " + B.SERIES


@query(f"{_S} SELECT study, ord, part, supp, CASE WHEN NOT ({_WELL_SQL}) THEN 'Unusable' ELSE {_TIER_SQL} END AS tier FROM series")
def prj_tier(t):
    return B.series(t).select("study", "ord", "part", "supp", tier().alias("tier"))


@query(f"{_S} SELECT study, ord, part, supp, {_WELL_SQL} AND (nx <> 0 OR ny <> 0 OR nz <> 0) AS well FROM series")
def prj_well_formed(t):
    return B.series(t).select("study", "ord", "part", "supp", (well_formed() & ((c("nx") != 0) | (c("ny") != 0) | (c("nz") != 0))).alias("well"))


@query(f"{_S} SELECT study, ord, part, supp, spacing > thickness * 1.05 AS gap FROM series")
def prj_slice_gap(t):
    return B.series(t).select("study", "ord", "part", "supp", (c("spacing") > c("thickness") * 1.05).alias("gap"))


@query(f"{_S} SELECT study, ord, part, supp, slices * spacing AS coverage, slices * spacing >= 100 AS covers FROM series")
def prj_coverage(t):
    mm = c("slices") * c("spacing")
    return B.series(t).select("study", "ord", "part", "supp", mm.alias("coverage"), (mm >= 100).alias("covers"))


@query(f"{_S} SELECT study, ord, part, supp, {DIRECTION_SQL} AS direction FROM series")
def prj_direction(t):
    return B.series(t).select("study", "ord", "part", "supp", G.direction(normal()).alias("direction"))


@query(f"{_S} SELECT study, ord, part, supp, {PLANE_SQL} AS plane FROM series")
def prj_plane(t):
    return B.series(t).select("study", "ord", "part", "supp", G.plane(normal()).alias("plane"))


_OPP = "CASE {} WHEN 'Left' THEN 'Right' WHEN 'Right' THEN 'Left' WHEN 'Anterior' THEN 'Posterior' WHEN 'Posterior' THEN 'Anterior' WHEN 'Superior' THEN 'Inferior' WHEN 'Inferior' THEN 'Superior' ELSE 'Unknown' END"


@query(f"{_S}, d AS (SELECT *, {DIRECTION_SQL} AS r FROM series) SELECT study, ord, part, supp, r AS \"right\", {_OPP.format('r')} AS \"left\", CASE WHEN nx = 0 AND ny = 0 AND nz = 0 THEN true ELSE greatest(abs(nx), abs(ny), abs(nz)) / sqrt(nx * nx + ny * ny + nz * nz) < 0.9 END AS oblique FROM d")
def prj_edge_labels(t):
    d = B.series(t).withColumn("right", G.direction(normal()))
    return d.select("study", "ord", "part", "supp", "right", G.opposite(c("right")).alias("left"), G.oblique(normal()).alias("oblique"))


@query("WITH " + B.VOXELS + " SELECT vol, x, y, z, CASE vol % 3 WHEN 0 THEN z WHEN 1 THEN y ELSE x END AS plane_index, CASE vol % 3 WHEN 2 THEN y ELSE x END AS across, CASE vol % 3 WHEN 0 THEN y ELSE z END AS down FROM voxels")
def prj_plane_addressing(t):
    axis = c("vol") % 3
    return B.voxels(t).select("vol", "x", "y", "z", F.when(axis == 0, c("z")).when(axis == 1, c("y")).otherwise(c("x")).alias("plane_index"), F.when(axis == 2, c("y")).otherwise(c("x")).alias("across"), F.when(axis == 0, c("y")).otherwise(c("z")).alias("down"))


_MARKERS = [("haste", "Flair"), ("them", "Flair"), ("the", "T1"), ("que", "T2")]
_LOW = f"translate(lower(text), '{T.LOOKALIKE_FROM}', '{T.LOOKALIKE_TO}')"


@query(f"SELECT doc_id, CASE " + " ".join(f"WHEN contains({_LOW}, '{T.latinised_literal(m)}') THEN '{n}'" for m, n in [*T.WEIGHTING_MARKERS[:4], *_MARKERS[1:], *T.WEIGHTING_MARKERS[4:]]) + " ELSE 'Unknown' END AS weighting FROM documents")
def prj_weighting_text(t):
    """The domain's markers, with a few of the test language's words so that every branch has rows."""
    markers = [*T.WEIGHTING_MARKERS[:4], *_MARKERS[1:], *T.WEIGHTING_MARKERS[4:]]
    return t("documents").select("doc_id", T.first_marker(c("text"), markers, "Unknown").alias("weighting"))


_PHYS = "SELECT l_orderkey, l_linenumber, l_extendedprice, ['SE', 'GR', 'EP', 'IR'][l_suppkey % 4 + 1] AS seq, ['MP', 'SK', 'TOF', ''][l_partkey % 4 + 1] AS var, CASE WHEN l_linestatus = 'F' THEN '3D' ELSE '2D' END AS acq, l_quantity * 60 AS tr, l_discount * 1200 AS te, CASE WHEN l_returnflag = 'R' THEN 900 ELSE 0 END AS ti, l_tax * 400 AS flip FROM lineitem"


@query(f"SELECT l_orderkey, l_linenumber, l_extendedprice, CASE WHEN seq = 'EP' OR var = 'TOF' THEN 'Unknown' WHEN tr <= 0 OR te <= 0 THEN 'Unknown' WHEN ti > 0 AND te >= 80 AND tr >= 2000 THEN 'Flair' WHEN var = 'MP' AND acq = '3D' AND te < 30 THEN 'T1' "
       f"WHEN tr < 800 AND te < 30 THEN CASE WHEN flip > 0 AND seq = 'GR' AND var <> 'MP' AND flip < degrees(acos(exp(-tr / 700))) * 0.5 THEN 'Unknown' ELSE 'T1' END WHEN tr >= 2000 AND te >= 80 THEN 'T2' ELSE 'Unknown' END AS weighting FROM ({_PHYS})")
def prj_weighting_physics(t):
    pick = lambda values, key: F.element_at(F.array(*map(F.lit, values)), (c(key) % 4 + 1).cast("int"))
    p = t("lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", pick(["SE", "GR", "EP", "IR"], "l_suppkey").alias("seq"), pick(["MP", "SK", "TOF", ""], "l_partkey").alias("var"), F.when(c("l_linestatus") == "F", "3D").otherwise("2D").alias("acq"),
        (c("l_quantity") * 60).alias("tr"), (c("l_discount") * 1200).alias("te"), F.when(c("l_returnflag") == "R", 900).otherwise(0).alias("ti"), (c("l_tax") * 400).alias("flip"),
    )
    return p.select("l_orderkey", "l_linenumber", "l_extendedprice", T.weighting_from_physics(*(c(k) for k in ("seq", "var", "acq", "tr", "te", "ti", "flip"))).alias("weighting"))


@query(f"SELECT doc_id, NOT (contains({_LOW}, 'hedno') OR contains({_LOW}, 'ohne')) AND (contains({_LOW}, 'with') OR contains({_LOW}, 'avec') OR contains({_LOW}, 'mit')) AS contrast FROM documents")
def prj_contrast(t):
    return t("documents").select("doc_id", T.contrast_enhanced(c("text"), ["hedno", "ohne"], ["with", "avec", "mit"]).alias("contrast"))


_PROTOCOLS = ["T1 +C", "T1 GADO", "Т1 с контрастом", "non-contrast", "t1 без контраста", "Pre Contrast T2", "Flair", "post-C"]
_SHOWN = "translate(lower(p_name || ' ' || [" + ", ".join(f"'{x}'" for x in _PROTOCOLS) + f"][p_size % 8 + 1]), '{T.LOOKALIKE_FROM}', '{T.LOOKALIKE_TO}')"
_ANY = lambda markers: " OR ".join(f"contains({_SHOWN}, '{T.latinised_literal(m)}')" for m in markers)


@query(f"SELECT p_partkey, NOT ({_ANY(T.NO_CONTRAST_MARKERS)}) AND ({_ANY(T.CONTRAST_MARKERS)}) AS contrast FROM part")
def prj_contrast_markers(t):
    """Contrast by the marker words of protocol names."""
    protocol = F.element_at(F.array(*map(F.lit, _PROTOCOLS)), (c("p_size") % 8 + 1).cast("int"))
    return t("part").select("p_partkey", T.contrast_enhanced(F.concat_ws(" ", "p_name", protocol)).alias("contrast"))


@query(f"SELECT p_partkey, translate(lower(p_name || ' Т' || p_size || ' МРТ'), '{T.LOOKALIKE_FROM}', '{T.LOOKALIKE_TO}') AS latin FROM part")
def prj_lookalike(t):
    return t("part").select("p_partkey", T.latinised(F.concat("p_name", F.lit(" Т"), c("p_size").cast("string"), F.lit(" МРТ"))).alias("latin"))


_AGE = "SELECT o_orderkey, CASE o_custkey % 5 WHEN 0 THEN lpad((o_custkey % 130)::VARCHAR, 3, '0') || 'Y' WHEN 1 THEN (o_custkey % 900)::VARCHAR || 'M' WHEN 2 THEN (o_custkey % 3000)::VARCHAR || 'W' WHEN 3 THEN (o_custkey % 130)::VARCHAR END AS stated, (DATE '1950-02-28' + (o_custkey % 20000)::INT) AS birth, o_orderdate::DATE AS seen FROM orders"
_AGE_SQL = ("CASE o_custkey % 5 WHEN 0 THEN o_custkey % 130 WHEN 1 THEN o_custkey % 900 // 12 WHEN 2 THEN o_custkey % 3000 // 52 WHEN 3 THEN o_custkey % 130 ELSE year(seen) - year(birth) - CASE WHEN month(seen) > month(birth) OR (month(seen) = month(birth) AND day(seen) >= "
            "CASE WHEN month(birth) = 2 AND day(birth) = 29 AND day(last_day(make_date(year(seen), 2, 1))) = 28 THEN 28 ELSE day(birth) END) THEN 0 ELSE 1 END END")


@query(f"SELECT o_orderkey, CASE WHEN age BETWEEN 0 AND 120 THEN least(age, 90) END AS age FROM (SELECT o_orderkey, {_AGE_SQL} AS age FROM (SELECT *, (DATE '1950-02-28' + (o_custkey % 20000)::INT) AS birth, o_orderdate::DATE AS seen FROM orders))")
def prj_age(t):
    k = c("o_custkey")
    text = lambda n: (k % n).cast("string")
    stated = F.when(k % 5 == 0, F.concat(F.lpad(text(130), 3, "0"), F.lit("Y"))).when(k % 5 == 1, F.concat(text(900), F.lit("M"))).when(k % 5 == 2, F.concat(text(3000), F.lit("W"))).when(k % 5 == 3, text(130))
    return t("orders").select("o_orderkey", DT.age_years(stated, F.date_add(F.lit("1950-02-28").cast("date"), (k % 20000).cast("int")), c("o_orderdate").cast("date")).alias("age"))


@query("SELECT c_custkey, CASE WHEN upper(trim(s)) IN ('M', 'F', 'O') THEN upper(trim(s)) END AS sex FROM (SELECT c_custkey, ' ' || lower(substr(c_mktsegment, 1, 1)) || ' ' AS s FROM customer)")
def prj_sex(t):
    s = F.upper(F.trim(F.concat(F.lit(" "), F.lower(F.substring("c_mktsegment", 1, 1)), F.lit(" "))))
    return t("customer").select("c_custkey", F.when(s.isin("M", "F", "O"), s).alias("sex"))


def _frame(*parts: str) -> str:
    return " || ".join(f"length({p}) || ':' || {p} || '|'" for p in parts)


@query(f"SELECT c_custkey, substr(sha256({_frame(chr(39) + 'salt' + chr(39), chr(39) + 'subject' + chr(39), 'c_name')}), 1, 32) AS pseudonym FROM customer")
def prj_pseudonym(t):
    return t("customer").select("c_custkey", H.pseudonym("salt", "subject", c("c_name")).alias("pseudonym"))


_TRIPLE = "upper(trim(c_name)) || '|' || upper(trim(c_mktsegment)) || '|' || c_nationkey"


@query(f"SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN substr(sha256({_frame(chr(39) + 'salt' + chr(39), chr(39) + 'subject-unmatched' + chr(39), 'c_custkey::VARCHAR')}), 1, 32) ELSE substr(sha256({_frame(chr(39) + 'salt' + chr(39), chr(39) + 'subject' + chr(39), '(' + _TRIPLE + ')')}), 1, 32) END AS subject_key FROM customer")
def prj_subject_key(t):
    triple = F.concat_ws("|", F.upper(F.trim("c_name")), F.upper(F.trim("c_mktsegment")), c("c_nationkey").cast("string"))
    return t("customer").select("c_custkey", F.when(c("c_nationkey") == 3, H.pseudonym("salt", "subject-unmatched", c("c_custkey").cast("string"))).otherwise(H.pseudonym("salt", "subject", triple)).alias("subject_key"))


@query("SELECT c_custkey, -(('0x' || substr(sha256(c_name), 1, 8))::BIGINT % 3650 + 1) AS shift FROM customer")
def prj_day_shift(t):
    return t("customer").select("c_custkey", H.day_shift(F.sha2("c_name", 256)).alias("shift"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 11 <> 0 THEN strftime(o_orderdate::DATE - (o_custkey % 3650 + 1)::INT, '%Y%m%d') || CASE WHEN o_custkey % 2 = 0 THEN '093000.5' ELSE '' END END AS shifted FROM orders")
def prj_shift_date(t):
    """Every eleventh date is unreadable and so dropped; half of them carry a time of day, which stays."""
    text = F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.when(c("o_custkey") % 2 == 0, "093000.5").otherwise(""))
    broken = F.when(c("o_custkey") % 11 == 0, F.replace(text, F.lit("19"), F.lit("x"))).otherwise(text)
    unread = F.when(c("o_custkey") % 11 == 0, F.concat(F.lit("?"), broken)).otherwise(broken)
    return t("orders").select("o_orderkey", DT.shifted(unread, -(c("o_custkey") % 3650 + 1)).alias("shifted"))


def uid_sql(value: str) -> str:
    h = f"sha256({value})"
    return f"'2.25.' || ('0x' || substr({h}, 1, 12) || '4' || substr({h}, 14, 3) || translate(substr({h}, 17, 1), '{UID.HEX}', '{UID.VARIANT}') || substr({h}, 18, 15))::UHUGEINT"


@query(f"SELECT c_custkey, {uid_sql(chr(39) + 'salt:' + chr(39) + ' || c_name')} AS uid FROM customer")
def prj_uid_remap(t):
    """2.25.<decimal of a version-4 UUID from the hash>."""
    return t("customer").select("c_custkey", UID.remapped(F.concat(F.lit("salt:"), c("c_name"))).alias("uid"))


@query(r"SELECT event_id, regexp_replace('tag (0018,0015) of ' || user_id || ' in ' || event_type, '(^|[^\w(,])\d+($|[^\w),])', '\1#\2', 'g') AS shape FROM events")
def prj_normalise_message(t):
    return t("events").select("event_id", T.message_shape(F.concat(F.lit("tag (0018,0015) of "), c("user_id").cast("string"), F.lit(" in "), c("event_type"))).alias("shape"))


@query("SELECT doc_id, left(text, 8) AS head, CASE WHEN length(text) > 120 THEN left(text, 120) || '…' ELSE text END AS short FROM documents")
def prj_head8(t):
    return t("documents").select("doc_id", F.substring("text", 1, 8).alias("head"), T.shortened(c("text")).alias("short"))


@query(r"""SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(replace(url, '^', ' '), '[<>:"/\\|?*]', '_', 'g'), '^[ .]+|[ .]+$', '', 'g'), ''), 'unnamed') AS name FROM pages""")
def prj_sanitize_name(t):
    return t("pages").select("page_id", T.file_name(c("url"), "unnamed").alias("name"))


@query("WITH " + B.VOXELS + " SELECT vol, x, y, z, CASE WHEN v <= 0.05 - 0.5 - (w - 1) / 2 THEN 0 WHEN v > 0.05 - 0.5 + (w - 1) / 2 THEN 255 ELSE round(((v - (0.05 - 0.5)) / (w - 1) + 0.5) * 255)::INT END AS grey FROM (SELECT *, 1.5::DOUBLE AS w FROM voxels)")
def prj_window_level(t):
    w, centre = 1.5, 0.05 - 0.5
    v = c("v")
    grey = F.when(v <= centre - (w - 1) / 2, 0).when(v > centre + (w - 1) / 2, 255).otherwise(F.round(((v - centre) / (w - 1) + 0.5) * 255).cast("int"))
    return B.voxels(t).select("vol", "x", "y", "z", grey.alias("grey"))


@query("WITH " + B.VOXELS + " SELECT vol, x, y, z, CASE WHEN vol % 2 = 0 THEN 3 - x ELSE x END AS shown_x, CASE WHEN vol % 4 < 2 THEN 3 - y ELSE y END AS shown_y FROM voxels")
def prj_display_transform(t):
    return B.voxels(t).select("vol", "x", "y", "z", F.when(c("vol") % 2 == 0, 3 - c("x")).otherwise(c("x")).alias("shown_x"), F.when(c("vol") % 4 < 2, 3 - c("y")).otherwise(c("y")).alias("shown_y"))


@query("SELECT event_id, concat_ws('/', event_type, CASE WHEN user_id % 2 = 0 THEN 'r' || user_id END, props->>'k') AS k FROM events")
def prj_finding_key(t):
    parameters = F.from_json("props", "map<string,string>")
    return t("events").select("event_id", F.concat_ws("/", "event_type", F.when(c("user_id") % 2 == 0, F.concat(F.lit("r"), c("user_id").cast("string"))), parameters["k"]).alias("k"))


@query("WITH " + B.VOXELS + " SELECT vol, x, y, z, greatest(0, least(255, round_even(grey * 0.6::DOUBLE + 200 * 0.4::DOUBLE, 0)))::INT AS blended FROM (SELECT *, floor(v * 300)::INT AS grey FROM voxels)")
def prj_overlay_blend(t):
    grey = F.floor(c("v") * 300).cast("int")
    return B.voxels(t).select("vol", "x", "y", "z", F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.rint(grey * F.lit(0.6) + F.lit(200) * F.lit(0.4)))).cast("int").alias("blended"))


@query("SELECT event_id, concat_ws(' · ', event_type, 'user ' || user_id, CASE WHEN value > 50 THEN 'high' END) AS line FROM events")
def prj_record_line(t):
    return t("events").select("event_id", F.concat_ws(" · ", "event_type", F.concat(F.lit("user "), c("user_id").cast("string")), F.when(c("value") > 50, "high")).alias("line"))


@query("SELECT p_partkey, CASE WHEN contains(s, ';') THEN '\"' || replace(s, '\"', '\"\"') || '\"' ELSE s END AS cell FROM (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name || '; \"' || p_type || '\"' ELSE p_name END AS s FROM part)")
def prj_quote_csv(t):
    s = F.when(c("p_size") % 3 == 0, F.concat("p_name", F.lit('; "'), "p_type", F.lit('"'))).otherwise(c("p_name"))
    return t("part").select("p_partkey", T.quoted_csv(s).alias("cell"))


@query("SELECT o_orderkey, line, depth, text, heading FROM (SELECT o_orderkey, unnest([{'line': 0, 'depth': 0, 'text': 'report', 'heading': true}, {'line': 1, 'depth': 1, 'text': 'study: ' || o_orderkey, 'heading': false}, "
       "{'line': 2, 'depth': 1, 'text': 'outcome', 'heading': true}, {'line': 3, 'depth': 2, 'text': 'kind: ' || o_orderstatus, 'heading': false}, {'line': 4, 'depth': 2, 'text': 'values', 'heading': true}, "
       "{'line': 5, 'depth': 3, 'text': '[0]: ' || o_totalprice, 'heading': false}, {'line': 6, 'depth': 3, 'text': '[1]: ' || o_custkey || '.0', 'heading': false}], recursive := true) FROM orders)")
def prj_outline(t):
    """Nested JSON as (depth, text) lines."""
    from cairn.functions.outline import outlined

    report = F.to_json(F.struct(c("o_orderkey").alias("study"), F.struct(c("o_orderstatus").alias("kind"), F.array("o_totalprice", "o_custkey").alias("values")).alias("outcome")))
    return outlined(t("orders").select("o_orderkey", report.alias("json")), "o_orderkey", "json")


# ---- scalar function families


@query("SELECT p_partkey, upper(trim(p_name)) AS u, contains(lower(p_name), 'a') AS has_a, starts_with(p_brand, 'Brand') AS is_brand, string_split(p_brand, '#')[2] AS number, lpad(p_size::VARCHAR, 4, '0') AS padded, concat_ws('-', p_brand, p_type) AS joined FROM part")
def fn_string(t):
    return t("part").select("p_partkey", F.upper(F.trim("p_name")).alias("u"), F.contains(F.lower("p_name"), F.lit("a")).alias("has_a"), F.startswith("p_brand", F.lit("Brand")).alias("is_brand"), F.split("p_brand", "#")[1].alias("number"), F.lpad(c("p_size").cast("string"), 4, "0").alias("padded"), F.concat_ws("-", "p_brand", "p_type").alias("joined"))


@query("SELECT doc_id, sha256(text) AS full_hash, substr(sha256(text), 1, 16) AS h16, upper(substr(sha256(text), 1, 32)) AS h32 FROM documents")
def fn_hash(t):
    h = F.sha2("text", 256)
    return t("documents").select("doc_id", h.alias("full_hash"), F.substring(h, 1, 16).alias("h16"), F.upper(F.substring(h, 1, 32)).alias("h32"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE o_orderdate::DATE END AS day, (o_orderdate::DATE + 45) AS later, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS days FROM orders")
def fn_date(t):
    text = F.when(c("o_custkey") % 9 == 0, "1999-1-1").otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    return t("orders").select("o_orderkey", DT.strict_date(text).alias("day"), F.date_add(c("o_orderdate").cast("date"), 45).alias("later"), F.datediff(c("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long").alias("days"))


@query("SELECT l_orderkey, l_linenumber, round(sqrt(l_quantity), 9) AS root, round(exp(-l_discount), 9) AS e, round(atan2(l_tax, l_discount), 9) AS a, greatest(10, least(40, l_quantity)) AS clamped, round(degrees(acos(least(1.0::DOUBLE, l_discount * 5))), 7) AS deg FROM lineitem")
def fn_math(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", F.round(F.sqrt("l_quantity"), 9).alias("root"), F.round(F.exp(-c("l_discount")), 9).alias("e"), F.round(F.atan2("l_tax", "l_discount"), 9).alias("a"), G.clamp(c("l_quantity"), 10.0, 40.0).alias("clamped"), F.round(F.degrees(F.acos(F.least(F.lit(1.0), c("l_discount") * 5))), 7).alias("deg"))


@query("SELECT l_orderkey, l_linenumber, round_even(l_quantity / 2, 0)::INT AS half_even, round(l_quantity / 2)::INT AS half_away, trunc(l_quantity / 3 - 5)::INT AS cut FROM lineitem")
def fn_rounding(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", F.rint(c("l_quantity") / 2).cast("int").alias("half_even"), F.round(c("l_quantity") / 2).cast("int").alias("half_away"), (c("l_quantity") / 3 - 5).cast("int").alias("cut"))


@query(f"{_S} SELECT study, ord, part, supp, round(nx * 0.5 + ny * 2 + nz, 9) + 0.0 AS dotted, round(ny * 1 - nz * 2, 9) + 0.0 AS cross_x, round(CASE WHEN nx * nx + ny * ny + nz * nz > 0 THEN nz / sqrt(nx * nx + ny * ny + nz * nz) ELSE 0 END, 7) + 0.0 AS unit_z FROM series")
def fn_vector(t):
    v, w = normal(), (F.lit(0.5), F.lit(2.0), F.lit(1.0))
    r = lambda x, n: F.round(x, n) + F.lit(0.0)
    return B.series(t).select("study", "ord", "part", "supp", r(G.dot(v, w), 9).alias("dotted"), r(G.cross(v, w)[0], 9).alias("cross_x"), r(G.normalised(v)[2], 7).alias("unit_z"))


@query(f"{_S} SELECT study, ord, part, supp, round(slices * spacing * nx + 10, 6) + 0.0 AS px, round(\"rows\" * row_mm - 5, 6) + 0.0 AS py FROM series")
def fn_matrix(t):
    """A 4 x 4 affine applied to a place of the grid."""
    r = lambda x: F.round(x, 6) + F.lit(0.0)
    grid = B.series(t).withColumn("m", M.affine(((c("spacing") * c("nx"), 0, 0), (0, c("row_mm"), 0), (0, 0, 1)), (10, -5, 0)))
    px, py, _ = M.applied(c("m"), (c("slices"), c("rows"), F.lit(0)))
    return grid.select("study", "ord", "part", "supp", r(px).alias("px"), r(py).alias("py"))


@query(f"{_S}, d AS (SELECT study, ord, part, supp, col_mm AS a, nx AS b, ny AS c, row_mm AS d, spacing AS s, col_mm * row_mm - nx * ny AS det FROM series) SELECT study, ord, part, supp, "
       "CASE WHEN abs(det * s) > 1e-12 THEN list_transform([d / det, -b / det, 0, (5 * b - 4 * d) / det, -c / det, a / det, 0, (4 * c - 5 * a) / det, 0, 0, 1 / s, -6 / s, 0, 0, 0, 1], lambda x: round(x, 6) + 0.0) END AS inverse FROM d")
def fn_matrix_inverse(t):
    """Inverse affines of every line item's grid."""
    grid = B.series(t).withColumn("m", M.affine(((c("col_mm"), c("ny"), 0), (c("nx"), c("row_mm"), 0), (0, 0, c("spacing"))), (4, 5, 6)))
    return grid.select("study", "ord", "part", "supp", F.transform(M.inverse(c("m")), lambda x: F.round(x, 6) + F.lit(0.0)).alias("inverse"))


@query("SELECT vec_id, len(list_filter(embedding, lambda x: x > 0.1)) AS n_high, len(list_filter(embedding, lambda x: x > 0.3)) > 0 AS any_very, len(list_filter(embedding, lambda x: x > -2)) = 64 AS all_over, coalesce(embedding[100], 0)::DOUBLE AS missing, list_sort(embedding)[1]::DOUBLE AS least FROM embeddings")
def fn_array(t):
    e = c("embedding")
    return t("embeddings").select("vec_id", F.size(F.filter(e, lambda x: x > 0.1)).alias("n_high"), F.exists(e, lambda x: x > 0.3).alias("any_very"), F.forall(e, lambda x: x > -2).alias("all_over"), F.coalesce(F.get(e, F.lit(99)), F.lit(0.0)).cast("double").alias("missing"), F.array_sort(e)[0].cast("double").alias("least"))


@query("SELECT event_id, coalesce((props->>'k'), 'none') AS k, 'none' AS absent, 'k=' || (props->>'k') || ';z=' || user_id AS sorted FROM events")
def fn_map(t):
    m = F.map_concat(F.create_map(F.lit("z"), c("user_id").cast("string")), F.from_json("props", "map<string,string>"))
    entries = F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";")
    return t("events").select("event_id", F.coalesce(m["k"], F.lit("none")).alias("k"), F.coalesce(m["absent"], F.lit("none")).alias("absent"), entries.alias("sorted"))


@query("SELECT event_id, (props->>'k')::INT AS k, (props->>'none') AS nothing, json_type(props) = 'OBJECT' AS is_object FROM events")
def fn_json(t):
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.get_json_object("props", "$.none").alias("nothing"), F.from_json("props", "map<string,string>").isNotNull().alias("is_object"))


@query("SELECT o_orderkey, printf('%.3f', o_totalprice) AS fixed, CASE WHEN o_totalprice >= 250000 THEN '+' ELSE '-' END || printf('%.2f', abs(o_totalprice - 250000)) AS signed FROM orders")
def fn_format(t):
    d = c("o_totalprice") - 250000
    return t("orders").select("o_orderkey", F.format_string("%.3f", c("o_totalprice")).alias("fixed"), F.concat(F.when(d >= 0, "+").otherwise("-"), F.format_string("%.2f", F.abs(d))).alias("signed"))


@query("SELECT doc_id, regexp_replace(text, '[0-9]+', '#', 'g') AS shape FROM documents")
def fn_regex(t):
    return t("documents").select("doc_id", F.regexp_replace("text", "[0-9]+", "#").alias("shape"))


# ---- geometry and measurements

_G = "g AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)"


def _g(t):
    return t("embeddings").select("vec_id", c("embedding").cast("array<double>").alias("e"))


def _at(i: int):
    return c("e")[i]


def _point(i: int) -> G.Vector:
    return _at(i), _at(i + 1), _at(i + 2)


@query(f"WITH {_G} SELECT vec_id, round(e[1] + e[2] * 3 + e[3] * 4, 7) + 0.0 AS px, round(e[4] + e[5] * 3 + e[6] * 4, 7) + 0.0 AS py FROM g")
def geo_to_patient(t):
    r = lambda x: F.round(x, 7) + F.lit(0.0)
    return _g(t).select("vec_id", r(_at(0) + _at(1) * 3 + _at(2) * 4).alias("px"), r(_at(3) + _at(4) * 3 + _at(5) * 4).alias("py"))


def _angle_sql(a: int, v: int, b: int) -> str:
    u = [f"(e[{a + k}] - e[{v + k}])" for k in range(3)]
    w = [f"(e[{b + k}] - e[{v + k}])" for k in range(3)]
    d = " + ".join(f"{x} * {y}" for x, y in zip(u, w))
    size = lambda p: "sqrt(" + " + ".join(f"{x} * {x}" for x in p) + ")"
    return f"degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, ({d}) / ({size(u)} * {size(w)})))))"


def _distance_sql(a: int, b: int) -> str:
    return "sqrt(" + " + ".join(f"(e[{a + k}] - e[{b + k}]) * (e[{a + k}] - e[{b + k}])" for k in range(3)) + ")"


@query(f"WITH {_G} SELECT vec_id, round({_distance_sql(1, 4)}, 8) AS distance, round({_angle_sql(1, 4, 7)}, 5) AS angle FROM g")
def geo_distance_angle(t):
    return _g(t).select("vec_id", F.round(G.length(G.minus(_point(0), _point(3))), 8).alias("distance"), F.round(G.angle_degrees(_point(0), _point(3), _point(6)), 5).alias("angle"))


@query(f"WITH {_G}, m AS (SELECT vec_id, {_distance_sql(1, 4)} AS horns, {_distance_sql(7, 10)} AS skull, abs(e[3]) >= abs(e[1]) AS axial FROM g) SELECT vec_id, CASE WHEN axial AND skull > 0 THEN round(horns / skull, 7) END AS evans, CASE WHEN axial AND skull > 0 THEN NOT (horns / skull BETWEEN 0.10 AND 0.60) END AS flagged FROM m")
def mea_evans(t):
    m = _g(t).select("vec_id", G.length(G.minus(_point(0), _point(3))).alias("horns"), G.length(G.minus(_point(6), _point(9))).alias("skull"), (F.abs(_at(2)) >= F.abs(_at(0))).alias("axial"))
    ok, value = c("axial") & (c("skull") > 0), c("horns") / c("skull")
    return m.select("vec_id", F.when(ok, F.round(value, 7)).alias("evans"), F.when(ok, ~value.between(0.10, 0.60)).alias("flagged"))


@query(f"WITH {_G}, m AS (SELECT vec_id, {_angle_sql(4, 1, 7)} AS a, abs(e[2]) >= abs(e[1]) AS coronal FROM g) SELECT vec_id, CASE WHEN coronal THEN round(a, 5) END AS callosal, CASE WHEN coronal THEN NOT (a BETWEEN 30 AND 150) END AS flagged FROM m")
def mea_callosal(t):
    m = _g(t).select("vec_id", G.angle_degrees(_point(3), _point(0), _point(6)).alias("a"), (F.abs(_at(1)) >= F.abs(_at(0))).alias("coronal"))
    return m.select("vec_id", F.when(c("coronal"), F.round("a", 5)).alias("callosal"), F.when(c("coronal"), ~c("a").between(30, 150)).alias("flagged"))


@query(f"WITH {_G}, m AS (SELECT vec_id, e[4] - e[1] AS ax, e[5] - e[2] AS ay, e[6] - e[3] AS az, e[10] - e[7] AS dx, e[11] - e[8] AS dy, e[12] - e[9] AS dz FROM g) SELECT vec_id, round(abs((dx * ax + dy * ay + dz * az) / (ax * ax + ay * ay + az * az)), 7) AS evans, round(degrees(atan2(ay, ax)), 5) + 0.0 AS rotation FROM m")
def mea_manual_evans(t):
    """Horn ends projected on the skull's axis, and the head's rotation in the plane."""
    axis, horns = G.minus(_point(3), _point(0)), G.minus(_point(9), _point(6))
    return _g(t).select("vec_id", F.round(F.abs(G.dot(horns, axis) / G.dot(axis, axis)), 7).alias("evans"), (F.round(F.degrees(F.atan2(axis[1], axis[0])), 5) + F.lit(0.0)).alias("rotation"))


@query(f"WITH {_G} SELECT vec_id, round({_angle_sql(4, 1, 7)}, 5) AS angle, round(degrees(asin(e[3] / sqrt(e[1] * e[1] + e[2] * e[2] + e[3] * e[3]))), 5) + 0.0 AS pitch, round(degrees(atan2(e[1], e[2])), 5) + 0.0 AS yaw FROM g")
def mea_manual_angle(t):
    r = lambda x: F.round(x, 5) + F.lit(0.0)
    return _g(t).select("vec_id", F.round(G.angle_degrees(_point(3), _point(0), _point(6)), 5).alias("angle"), r(F.degrees(F.asin(_at(2) / G.length(_point(0))))).alias("pitch"), r(F.degrees(F.atan2(_at(0), _at(1)))).alias("yaw"))


_ROOF = "r AS (SELECT vec_id, i - 32 AS x, embedding[i + 1]::DOUBLE AS y FROM embeddings, (SELECT unnest(range(64)) AS i))"


@query(f"WITH {_ROOF}, f AS (SELECT vec_id, regr_slope(y, x) FILTER (x BETWEEN -10 AND -1) AS ls, regr_intercept(y, x) FILTER (x BETWEEN -10 AND -1) AS li, regr_slope(y, x) FILTER (x BETWEEN 1 AND 10) AS rs, regr_intercept(y, x) FILTER (x BETWEEN 1 AND 10) AS ri FROM r GROUP BY vec_id) "
       "SELECT vec_id, round(degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (-1 - ls * rs) / (sqrt(1 + ls * ls) * sqrt(1 + rs * rs)))))), 3) AS angle, abs((ri - li) / (ls - rs)) <= 5 AS vertex_ok FROM f")
def mea_callosal_fit(t):
    r = t("embeddings").select("vec_id", F.posexplode("embedding").alias("i", "y")).select("vec_id", (c("i") - 32).alias("x"), c("y").cast("double").alias("y"))
    side = lambda cond, f: f(F.when(cond, c("y")), F.when(cond, c("x")))
    left, right = c("x").between(-10, -1), c("x").between(1, 10)
    f = r.groupBy("vec_id").agg(side(left, F.regr_slope).alias("ls"), side(left, F.regr_intercept).alias("li"), side(right, F.regr_slope).alias("rs"), side(right, F.regr_intercept).alias("ri"))
    vertex = (c("ri") - c("li")) / (c("ls") - c("rs"))
    return f.select("vec_id", F.round(G.roof_angle(c("ls"), c("rs")), 3).alias("angle"), (F.abs(vertex) <= 5).alias("vertex_ok"))


@query(f"WITH {_G} SELECT vec_id, round(degrees(asin((e[3] - e[6]) / {_distance_sql(1, 4)})), 5) + 0.0 AS pitch, round(degrees(atan2(e[6] - e[3], e[2] - e[5])), 5) + 0.0 AS level, "
       "round(e[2] + (e[5] - e[2]) * cos(radians(30)) - (e[6] - e[3]) * sin(radians(30)), 7) + 0.0 AS rotated_y FROM g")
def geo_pitch_level_rotate(t):
    ac, pc = _point(0), _point(3)
    r = lambda x, n: F.round(x, n) + F.lit(0.0)
    return _g(t).select("vec_id", r(G.pitch_degrees(ac, pc), 5).alias("pitch"), r(G.levelling_degrees(ac, pc), 5).alias("level"), r(G.rotated_about_x(pc, F.lit(30.0), ac)[1], 7).alias("rotated_y"))


_LINE = "l AS (SELECT vec_id, i, embedding[i + 1]::DOUBLE AS v FROM embeddings, (SELECT unnest(range(64)) AS i))"


def _line(t):
    return t("embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v")).withColumn("v", c("v").cast("double"))


@query(f"WITH {_LINE} SELECT vec_id, greatest(32 - 20, coalesce(max(i) FILTER (i < 32 AND v > 0.1) + 1, 0)) AS grown_left, least(32 + 20, coalesce(min(i) FILTER (i > 32 AND v > 0.1) - 1, 63)) AS grown_right FROM l GROUP BY vec_id")
def mea_grow(t):
    """From the middle outwards while the value stays at or below a threshold, 20 steps at most."""
    left = F.max(F.when((c("i") < 32) & (c("v") > 0.1), c("i"))) + 1
    right = F.min(F.when((c("i") > 32) & (c("v") > 0.1), c("i"))) - 1
    return _line(t).groupBy("vec_id").agg(F.greatest(F.lit(12), F.coalesce(left, F.lit(0))).alias("grown_left"), F.least(F.lit(52), F.coalesce(right, F.lit(63))).alias("grown_right"))


@query(f"WITH {_LINE} SELECT vec_id, i // 8 AS line, min(i % 8) FILTER (v > 0) AS first_on, max(i % 8) FILTER (v > 0) AS last_on FROM l GROUP BY ALL")
def mea_line_extent(t):
    on = F.when(c("v") > 0, c("i") % 8)
    return _line(t).groupBy("vec_id", F.floor(c("i") / 8).cast("int").alias("line")).agg(F.min(on).alias("first_on"), F.max(on).alias("last_on"))


@query(f"WITH {_LINE} SELECT vec_id, min(i) FILTER (v > 0.15 AND i <= 12) AS band FROM l GROUP BY vec_id")
def mea_dark_band(t):
    return _line(t).groupBy("vec_id").agg(F.min(F.when((c("v") > 0.15) & (c("i") <= 12), c("i"))).alias("band"))


@query(f"WITH {_LINE}, e AS (SELECT vec_id, i // 8 AS line, min(i % 8) FILTER (v > 0) AS a, max(i % 8) FILTER (v > 0) AS b FROM l GROUP BY ALL) SELECT vec_id, round(avg((a + b) / 2), 9) AS midline FROM e WHERE a IS NOT NULL GROUP BY vec_id")
def mea_midline(t):
    return mea_line_extent(t).where("first_on IS NOT NULL").groupBy("vec_id").agg(F.round(F.avg((c("first_on") + c("last_on")) / 2), 9).alias("midline"))
