"""A Merkle manifest of a table: leaves, a tree for each group, a tree over the groups, proofs and their verification.

A leaf is the SHA-256 of a row's fields, each as byte count and value. Leaves of a group stand in the order of their
ids; every ``FAN`` consecutive nodes of a level become the node above, the last run as few as there are; what remains
of a group is its subroot. Subroots, in the order of their groups, are the leaves of one more tree.

Nodes are labelled by nested intervals: a node carries the interval [lo, hi) of the leaf ranks that it covers, so a
node is an ancestor of another one if its interval contains the other's, and what a parent's interval has besides a
child's are the child's siblings. Levels are built in bands of ``BAND``: the nodes of one level are cut into buckets of
FAN^BAND, and a bucket, of bounded size, gives its nodes on all levels of the band. Proofs go down the bands: a node is
joined, level by level of its band, to the interval that contains it, whose bucket on that level is its lo divided by
the level's width; only then is the upper part of the path, found once for a bucket, attached to its members. So a leaf
makes BAND rows, whatever the height of the tree, and no key has more rows than a bucket has leaves.

Nulls: a null field counts as ``-``; a null id comes first in its group, a null group before all others. Rows of equal
id are ordered by their leaves; equal rows are leaves each. A long text is hashed where it is read and never shuffled. Extra columns are ignored. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._store import durable, scratch

#: Nodes that become one.
FAN = 3
#: Levels that a bucket holds.
BAND = 6


def digest(*parts: Column) -> Column:
    """The lowercase hex SHA-256 of inputs in a row."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def _width(level: int) -> int:
    return FAN**level


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with their ``rank`` from 0 within the group and the group's ``size``, without a window over a group.

    Rows are dealt by range of (group, order), numbered within ranges, and moved on by the group's rows in the ranges before.
    """
    order = [*order, "tie"]  # equal rows are dealt over ranges, too
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    dealt = durable(rows.repartitionByRange(group, *order).select("*", F.spark_partition_id().alias("part")))
    counts = dealt.groupBy(group, "part").agg(F.count(F.lit(1)).alias("here"))
    # A group's ranges are as many as it fills, so this window is over few rows.
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(group, "part", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("skipped"), F.sum("here").over(Window.partitionBy(group)).alias("size"))
    own = F.row_number().over(Window.partitionBy(group, "part").orderBy(*order)).cast("long") - 1
    return dealt.withColumn("own", own).join(counts, [group, "part"]).withColumn("rank", F.col("own") + F.col("skipped")).drop("own", "skipped", "part", "tie")


def _height(size: int) -> int:
    levels = 0
    while _width(levels) < size:
        levels += 1
    return levels


_PARENTS = "grp string, level int, lo long, hi long, kids array<struct<lo:bigint,hi:bigint,digest:string>>, digest string"


def _banded(nodes: DataFrame, base: int) -> DataFrame:
    """The parents that buckets of the nodes (grp, size, lo, hi, digest) of level ``base`` give on the levels of a band."""
    bucket = F.floor(F.col("lo") / _width(base + BAND)).cast("long").alias("bucket")

    def run(table: pa.Table) -> pa.Table:
        grp, size = table["grp"][0].as_py(), table["size"][0].as_py()
        level = sorted(zip(*(table[k].to_pylist() for k in ("lo", "hi", "digest"))))
        out: dict[str, list] = {k.split()[0]: [] for k in ("grp", "level", "lo", "hi", "kids", "digest")}
        for at in range(base + 1, min(base + BAND, _height(size)) + 1):
            above = []
            for k in range(0, len(level), FAN):
                kids = level[k: k + FAN]
                above.append((kids[0][0], kids[-1][1], hashlib.sha256("".join(x[2] for x in kids).encode()).hexdigest()))
                for name, value in zip(out, (grp, at, *above[-1][:2], [dict(zip(("lo", "hi", "digest"), x)) for x in kids], above[-1][2])):
                    out[name].append(value)
            level = above
        kid = pa.struct([("lo", pa.int64()), ("hi", pa.int64()), ("digest", pa.string())])
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.list_(kid), pa.string())
        return pa.table({name: pa.array(values, kind) for (name, values), kind in zip(out.items(), kinds)})

    return nodes.where(F.col("size") > _width(base)).select("*", bucket).groupBy("grp", "bucket").applyInArrow(run, _PARENTS)


#: A step of a proof: what stands left and right of a node in its parent.
_STEP = "struct<level:int,left:string,right:string>"


def _joined(kids: Column) -> Column:
    return F.array_join(F.transform(kids, lambda x: x["digest"]), "")


def _steps(nodes: DataFrame, parents: DataFrame, base: int) -> DataFrame:
    """(grp, lo, steps) of the nodes (grp, size, lo, hi) of a level: their paths within the band above it."""
    levels = F.expr(f"filter(sequence({base + 1}, {base + BAND}), x -> size > pow({FAN}, x - 1))")
    # Containing intervals of a level have one start for each multiple of its width, which makes the join an equi-join.
    width = F.element_at(F.array(*[F.lit(_width(k)) for k in range(base + 1, base + BAND + 1)]), F.col("level") - base)
    asked = nodes.select("grp", "lo", "hi", F.explode_outer(levels).alias("level")).withColumn("start", F.floor(F.col("lo") / width).cast("long") * width)
    held = parents.select("grp", "level", F.col("lo").alias("start"), F.col("hi").alias("until"), "kids")
    met = asked.join(held, ["grp", "level", "start"], "left").where(F.col("level").isNull() | (F.col("start") <= F.col("lo")) & (F.col("hi") <= F.col("until")))
    left, right = F.filter("kids", lambda x: x["hi"] <= F.col("lo")), F.filter("kids", lambda x: x["lo"] >= F.col("hi"))
    step = F.when(F.col("level").isNotNull(), F.struct("level", _joined(left).alias("left"), _joined(right).alias("right")))
    listed = F.array_sort(F.collect_list("step")).cast(f"array<{_STEP}>")
    return met.select("grp", "lo", step.alias("step")).groupBy("grp", "lo").agg(listed.alias("steps"))


def tree(leaves: DataFrame, top: int) -> tuple[DataFrame, DataFrame]:
    """The parents and, of every leaf (grp, rank, size, digest), the steps of its path: (parents, paths (grp, rank, steps)).

    ``top`` is the largest size of a group.
    """
    level = leaves.select("grp", "size", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "digest")
    bands, parents = [], []
    for base in range(0, max(1, _height(top)), BAND):
        found = durable(_banded(level, base))
        bands.append((base, level))
        parents.append(found)
        roots = found.where(F.col("level") == base + BAND)
        level = roots.join(leaves.select("grp", "size").distinct(), "grp").select("grp", "size", "lo", "hi", "digest")
    every = parents[0]
    for more in parents[1:]:
        every = every.unionByName(more)
    upper = None
    for (base, nodes), found in zip(bands[::-1], parents[::-1]):
        paths = _steps(nodes, found, base)
        if upper is not None:
            bucket = F.floor(F.col("lo") / _width(base + BAND)).cast("long") * _width(base + BAND)
            above = upper.select("grp", F.col("lo").alias("bucket"), F.col("steps").alias("above"))
            paths = paths.withColumn("bucket", bucket).join(above, ["grp", "bucket"], "left")
            paths = paths.withColumn("steps", F.concat("steps", F.coalesce("above", F.array().cast(f"array<{_STEP}>"))))
        upper = paths.select("grp", "lo", "steps")
    return every, upper.withColumnRenamed("lo", "rank")


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(steps, leaf, lambda h, x: digest(x["left"], h, x["right"]))


def proof(steps: Column) -> Column:
    """The siblings of a path, level by level, left to right."""
    return F.array_join(F.transform(steps, lambda x: F.concat(x["left"], x["right"])), "")


def manifest(rows: DataFrame, leaf: Column, id_col: str = "doc_id", group_col: str = "source", tampered: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, proofs) of a table.

    nodes (tree, grp, level, lo, hi, kids, digest): every inner node of the trees of the groups (``groups``) and of the
    tree over them (``top``). proofs (doc_id, leaf, now, subroot, root, steps, n_inner): a row of each leaf with its path, the first
    ``n_inner`` steps within its group, and the leaf ``now`` that ``tampered`` gives.
    """
    grp = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))  # null before all others
    found = rows.select(grp.alias("grp"), F.col(id_col).cast("long").alias("doc_id"), leaf.alias("digest"), (leaf if tampered is None else tampered).alias("now"))
    leaves = durable(ranked(found, "grp", ["doc_id", "digest", "now"]))
    inner, paths = tree(leaves, leaves.agg(F.max("size")).first()[0] or 0)
    roots = inner.where((F.col("lo") == 0)).groupBy("grp").agg(F.max_by("digest", "level").alias("digest"))
    lone = leaves.where("size = 1").select("grp", "digest")
    subroots = durable(roots.unionByName(lone).withColumn("all", F.lit("")))
    over = durable(ranked(subroots.select(F.col("all").alias("grp"), F.col("grp").alias("of"), "digest"), "grp", ["of"]))
    upper, upper_paths = tree(over, over.agg(F.max("size")).first()[0] or 0)
    root = upper.where("lo = 0").groupBy("grp").agg(F.max_by("digest", "level").alias("root")).unionByName(over.where("size = 1").select("grp", F.col("digest").alias("root")))
    groups = over.join(upper_paths, ["grp", "rank"]).join(F.broadcast(root), "grp").select(F.col("of").alias("grp"), F.col("digest").alias("subroot"), "root", F.col("steps").alias("outer"))
    proofs = leaves.join(paths, ["grp", "rank"]).join(durable(groups), "grp").select("doc_id", F.col("digest").alias("leaf"), "now", "subroot", "root", F.concat("steps", "outer").alias("steps"), F.size("steps").alias("n_inner"))
    nodes = inner.select(F.lit("groups").alias("tree"), "*").unionByName(upper.select(F.lit("top").alias("tree"), "*"))
    return nodes, proofs


def document_leaf(text: Column, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars")) -> Column:
    return digest(*(field(F.col(c)) for c in fields), field(text))


def verified(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of ``docs``, where half of the
    rows, by a hash of the id, have lost the line breaks of their text when they are held against the manifest."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    tampered = F.when(hit, document_leaf(F.replace(F.col("text"), F.lit("\n"), F.lit("")))).otherwise(document_leaf(F.col("text")))
    with scratch(docs.sparkSession):
        _, proofs = manifest(docs, document_leaf(F.col("text")), tampered=tampered)
        folded = proofs.withColumns({"proof_sha256": F.sha2(proof(F.col("steps")), 256), "folded_root": fold(F.col("now"), F.col("steps"))})
        out = folded.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
        return durable(out, keep=True)


#: The fields of a leaf in SQL, the low bit of a CRC-32 bit by bit, and both trees and the paths level by level.
VERIFIED_SQL = """
WITH RECURSIVE f AS (
  SELECT doc_id, coalesce('=' || source, '') AS g, text, list_transform(range(0, 8 * length(doc_id::VARCHAR)), lambda i: (ascii(substr(doc_id::VARCHAR, i // 8 + 1, 1)) >> (i % 8)::INT) & 1) AS bits,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head
  FROM documents),
e AS (
  SELECT *, coalesce(xor(list_reduce(list_prepend(4294967295, bits), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295) & 1 = 0, false) AS hit,
    replace(text, chr(10), '') AS bare
  FROM f),
l AS (
  SELECT doc_id, g, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || CASE WHEN hit THEN coalesce(strlen(bare) || ':' || bare, '-') ELSE coalesce(strlen(text) || ':' || text, '-') END) AS now
  FROM e),
d AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, now) - 1 AS r FROM l),
lv AS (
  SELECT g, 0 AS k, list(leaf ORDER BY r) AS nodes FROM d GROUP BY g
  UNION ALL
  SELECT g, k + 1, list_transform(range(0, (len(nodes) + 2) // 3), lambda i: sha256(array_to_string(nodes[3 * i + 1:3 * i + 3], ''))) FROM lv WHERE len(nodes) > 1),
sub AS (SELECT g, nodes[1] AS subroot, row_number() OVER (ORDER BY g) - 1 AS place FROM lv WHERE len(nodes) = 1),
tl AS (
  SELECT 0 AS k, list(subroot ORDER BY place) AS nodes FROM sub
  UNION ALL
  SELECT k + 1, list_transform(range(0, (len(nodes) + 2) // 3), lambda i: sha256(array_to_string(nodes[3 * i + 1:3 * i + 3], ''))) FROM tl WHERE len(nodes) > 1),
w AS (
  SELECT d.g, d.r, lv.k, lv.nodes, d.r // (3 ** lv.k)::BIGINT AS j FROM d JOIN lv USING (g) WHERE len(lv.nodes) > 1
  UNION ALL
  SELECT d.g, d.r, 1000 + tl.k, tl.nodes, sub.place // (3 ** tl.k)::BIGINT FROM d JOIN sub USING (g), tl WHERE len(tl.nodes) > 1),
s AS (
  SELECT g, r, row_number() OVER (PARTITION BY g, r ORDER BY k) AS i, array_to_string(nodes[3 * (j // 3) + 1:j], '') AS before, array_to_string(nodes[j + 2:3 * (j // 3) + 3], '') AS behind FROM w),
p AS (SELECT g, r, count(*) AS n, string_agg(before || behind, '' ORDER BY i) AS siblings FROM s GROUP BY g, r),
x AS (
  SELECT g, r, 0 AS i, now AS h FROM d
  UNION ALL
  SELECT x.g, x.r, x.i + 1, sha256(s.before || x.h || s.behind) FROM x JOIN s ON s.g = x.g AND s.r = x.r AND s.i = x.i + 1)
SELECT d.doc_id, d.leaf, sub.subroot, (SELECT nodes[1] FROM tl WHERE len(nodes) = 1) AS root, sha256(coalesce(p.siblings, '')) AS proof_sha256, x.h AS folded_root,
  x.h = (SELECT nodes[1] FROM tl WHERE len(nodes) = 1) AS verified
FROM d JOIN sub USING (g) LEFT JOIN p USING (g, r) JOIN x ON x.g = d.g AND x.r = d.r AND x.i = coalesce(p.n, 0)
"""
