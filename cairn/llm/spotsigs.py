"""SpotSigs document fingerprints. DataFrame functions only.

Common words (articles, prepositions, auxiliaries: ``ANTECEDENTS``) and the beginnings of lines mark spots in a text;
the ``chain`` content words that follow a spot, common words and line ends between them passed over, form a signature
with the spot's word itself; at the text's end there may be fewer of them. So every text with a content word has
signatures by one scheme, lists and texts of other languages by their lines. The set of the signatures' 64-bit hashes,
in order, is the fingerprint. Likeness of fingerprints is the Jaccard coefficient of their sets; two empty sets are
alike.

``similar_pairs`` finds all likely copies: equal sets are one class; classes are partitioned by set length into bands
whose bounds grow by 1 / threshold, so partners are in the same band or the next; they meet under the signatures of
their prefixes (rarest signatures first), are dropped by the length bound and verified. ``with_edited`` compares each text
with an edited form of itself and with the next document.

Nulls: a null text is empty: no signatures. Repeated rows have the same fingerprint. Rows with a null id come last in
the order of documents, rows of equal id stand in the order of their texts' hashes. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._store import durable, partitions

#: Common words of English, German, French and Spanish.
ANTECEDENTS = (
    "a an and are as at be but by for from had has have he her his in is it its not of on or she that the their there they this to was we were which will with would you "
    "als am auch auf aus bei das dass dem den der des die ein eine einem einen einer es für hat ich im ist mit nach nicht noch sich sie sind über um und von war wie zu zum zur "
    "au aux avec ce ces cette dans de du elle en est et il ils la le les leur mais ne ou par pas pour que qui sa se ses son sont sur un une "
    "al como con del el ella esta este fue ha la las lo los más no para pero por se sin su sus una y"
)
#: Stands for the beginning of a line.
LINE = "¶"


def _alternatives(words: list[str]) -> str:
    """A pattern of all words that tests each letter once."""
    heads: dict[str, list[str]] = {}
    for w in words:
        if w:
            heads.setdefault(w[0], []).append(w[1:])
    parts = [k + _alternatives(v) for k, v in sorted(heads.items())]
    if not parts:
        return ""
    return "(?:" + "|".join(parts) + ")" + ("?" if "" in words else "")


def spot_pattern(antecedents: str, chain: int) -> str:
    common = _alternatives(sorted({LINE, *antecedents.split()})) + "(?![^ ])"
    content = f"(?:{common} )*+(?!{common})[^ ]+ "
    return f"(?<![^ ])(?=({common} (?:{content}){{1,{chain}}}))"


def words_of(text: Column) -> Column:
    """Lower-cased words and the marks of the lines' beginnings, each followed by a space."""
    return F.concat(F.lit(f"{LINE} "), F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[\n\r]+", f" {LINE} "), rf"[^\p{{L}}\p{{N}}{LINE}]+", " ")), F.lit(" "))


def signatures(words: Column, antecedents: str = ANTECEDENTS, chain: int = 2) -> Column:
    """The ordered set of signature hashes of a text given as ``words_of``."""
    spots = F.regexp_extract_all(words, F.lit(spot_pattern(antecedents, chain)), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(spots, lambda x: F.xxhash64(x))))


def fingerprint(sigs: Column) -> Column:
    return F.array_join(F.transform(sigs, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b)).cast("double")
    total = F.size(a) + F.size(b) - both
    return F.when(total > 0, both / total).otherwise(1.0)


def similar_pairs(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, class_id) of every row with an id, and the pairs (a, b, likeness) of classes at ``threshold`` or more.

    A class is a distinct fingerprint and named by its smallest id. Texts without signatures are one class, in no pair.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), words_of(F.coalesce(F.col(text_col), F.lit(""))).alias("w"))
    rows = durable(rows.select("doc_id", signatures(F.col("w")).alias("sigs")).withColumn("h", F.struct(F.size("sigs"), F.xxhash64("sigs"))))
    classes = durable(rows.groupBy("h").agg(F.min("doc_id").alias("class_id"), F.min_by("sigs", "doc_id").alias("sigs")).where("class_id IS NOT NULL AND size(sigs) > 0"))
    members = rows.groupBy("h", "doc_id").agg(F.count(F.lit(1)).alias("n")).where("doc_id IS NOT NULL").join(rows.groupBy("h").agg(F.min("doc_id").alias("class_id")), "h").select("doc_id", "class_id")
    n = F.size("sigs")
    band = F.floor(F.log(n.cast("double")) / F.log(F.lit(1 / threshold)) + 1e-9)
    prefix = (n - F.ceil(n * threshold - 1e-9) + 1).cast("int")
    # Prefixes are taken in the order of rarity, so that a signature of very many classes is in few of them.
    each = classes.select("class_id", F.explode("sigs").alias("s"))
    counts = durable(each.groupBy("s").agg(F.count(F.lit(1)).alias("k")))
    ordered = each.join(counts, "s").groupBy("class_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "s"))), lambda x: x["s"]).alias("sigs"))
    listed = ordered.select("class_id", n.alias("n"), band.alias("band"), F.explode(F.slice("sigs", F.lit(1), prefix)).alias("s"))
    # Partners' lengths differ by 1 / threshold at most: the longer looks in its own band and the one below.
    short = listed.select(F.col("class_id").alias("a"), F.col("n").alias("na"), F.col("s"), F.col("band").alias("at"))
    long = listed.select(F.col("class_id").alias("b"), F.col("n").alias("nb"), F.col("s"), F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("at"))
    met = short.join(long, ["s", "at"]).where(
        ((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))) & (F.col("na") >= F.col("nb") * threshold - 1e-9)
    )
    pairs = met.select("a", "b").distinct()
    left, right = (classes.select(F.col("class_id").alias(k), F.col("sigs").alias(f"s{k}")) for k in "ab")
    return members, pairs.join(left, "a").join(right, "b").select("a", "b", jaccard(F.col("sa"), F.col("sb")).alias("likeness")).where(F.col("likeness") >= threshold - 1e-12)


def _looked_up(values: list, at: Column) -> Column:
    return F.get(F.array(*[F.lit(v).cast("long") for v in values]), at)


def _ranges(docs: DataFrame, n: int) -> tuple[Column, int]:
    """The number of a row's range as an expression, ascending in the order of documents reversed, and their number.

    Ids are cut at approximate quantiles, looked up in two steps. Rows without an id come first; they, and an id that
    fills ranges of its own, are cut by the hash of the text, the largest hash first, so no key's rows are one range.
    """
    rows, nulls, least, cuts = docs.agg(F.count(F.lit(1)), F.count_if(F.col("doc_id").isNull()), F.min("doc_id"), F.percentile_approx("doc_id", [k / n for k in range(1, n + 1)], 10 * n)).first()
    cuts = cuts or []
    hot = {k for k in cuts if cuts.count(k) > 1} if len(set(cuts)) < len(cuts) else set()
    starts = sorted({k for k in cuts if k > least} | {k + 1 for k in hot if k + 1 < 2**63})
    first = [least, *starts] if least is not None else []
    parts = [cuts.count(k) if k in hot else 1 for k in first]
    without = -(-nulls * n // rows) if nulls else 0
    bases = [without]
    for m in parts:
        bases.append(bases[-1] + m)
    step = max(1, round(len(starts) ** 0.5))
    groups = [starts[k: k + step] for k in range(0, len(starts), step)]
    number = F.lit(0)
    if groups:
        coarse = F.size(F.filter(F.array(*[F.lit(g[0]).cast("long") for g in groups]), lambda x: x <= F.col("doc_id")))
        fine = F.element_at(F.array(*[F.array(*[F.lit(v).cast("long") for v in g]) for g in groups]), F.greatest(coarse, F.lit(1)))
        number = F.when(coarse > 0, (coarse - 1) * step + F.size(F.filter(fine, lambda x: x <= F.col("doc_id")))).otherwise(0)
    own = F.col("doc_id").isNotNull()
    m = F.when(own, _looked_up(parts, number)).otherwise(without) if parts else F.lit(without)
    base = F.when(own, _looked_up(bases[:-1], number)).otherwise(0) if parts else F.lit(0)
    share = F.shiftright((F.shiftright("h", 32) + (1 << 31)) * m, 32)  # floor of m times the hash's place among all
    return base + (m - 1 - share), max(1, bases[-1])


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, sigs, next_text, next_sigs): each row of (doc_id, text, sigs) with the next one: descending id,
    rows without one last, equal ids by the hash of the text.

    Rows are windowed by range, never over all; the first row of a range is copied to the range before it, and the
    first of all to the last range, where it follows the last.
    """
    hashed = docs.withColumn("h", F.xxhash64("text"))
    number, n = _ranges(hashed, min(4096, 4 * partitions(docs)))
    ranged = hashed.withColumn("range", number.cast("int"))
    least = F.min_by(F.struct("doc_id", "h"), F.struct(F.col("doc_id").isNull(), F.bitwise_not("doc_id"), "h")).alias("t")
    tops = {r["range"]: r["t"] for r in ranged.groupBy("range").agg(least).collect()}
    used = sorted(tops)
    above = {k: used[(i + 1) % len(used)] for i, k in enumerate(used)}
    at = F.col("range")
    is_top = F.col("doc_id").eqNullSafe(_looked_up([tops[k][0] if k in tops else None for k in range(n)], at)) & (F.col("h") == _looked_up([tops[k][1] if k in tops else None for k in range(n)], at))
    target = _looked_up([above.get(k) for k in range(n)], at)
    last = F.col("range") == (used[-1] if used else 0)
    own = F.struct(F.col("range").alias("range"), F.lit(0).alias("halo"))
    copy = F.struct(target.cast("int").alias("range"), F.when(last, 2).otherwise(1).alias("halo"))
    dealt = ranged.withColumn("at", F.explode(F.when(is_top, F.array(own, copy)).otherwise(F.array(own)))).drop("range").select("*", "at.*").drop("at")
    order = Window.partitionBy("range").orderBy(F.col("halo") == 2, F.col("doc_id").desc_nulls_last(), "h", "text")
    following = F.coalesce(F.lead(F.struct("text", "sigs")).over(order), F.first(F.struct("text", "sigs")).over(order))
    return dealt.withColumn("next", following).where("halo = 0").select("doc_id", "text", "sigs", F.col("next.text").alias("next_text"), F.col("next.sigs").alias("next_sigs"))


def with_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("sigs", signatures(words_of(F.col("text"))))
    size = F.length("text")
    half = F.floor(size / 2).cast("int")
    edited = with_next(rows).withColumn("edited", F.concat(F.left(F.col("text"), size - half), F.left(F.col("next_text"), half)))
    edited = edited.select("doc_id", size.cast("long").alias("n_chars"), "edited", "sigs", "next_sigs").withColumn("esigs", signatures(words_of(F.col("edited"))))
    return edited.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("sigs")).alias("fingerprint"), fingerprint(F.col("esigs")).alias("edited_fingerprint"),
        jaccard(F.col("sigs"), F.col("esigs")).alias("near_edited"), jaccard(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )
