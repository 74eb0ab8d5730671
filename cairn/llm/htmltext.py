"""Main text of web pages by nearest-URL page differencing.

Pages are ordered by (host, path) over the cluster; a page is paired with the neighbour of its host whose path shares
the longer beginning with its own (the next one on a tie). Their text lines are aligned by a longest common
subsequence, and the lines that both have are deleted as the site's frame: menus, notices, adverts, footers. The lines
that are left show the page's main element, the strictest of article, main and content that has one of them (where the
two pages have all lines in common, the strictest that has text): what is outside it goes, and an exact check gives it
back its own lines that were deleted, as two articles of a site may say the same sentence. Lines in elements marked as
menus, headers, footers, sidebars, notices, adverts, forms or comments go as well.

The pages' keys are ranged first, without their html; the first and last page of a range are copied to the ranges
beside it, so that every page meets both of its neighbours. One range shuffle then orders the pages; a hot host spreads
over as many tasks as its pages need.

Nulls: a null html gives an empty text; pages with a null or hostless url are never paired. Repeated pages are paired
like others. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._html import Line, common_lines, lines, main_place
from ._store import partitions

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: Column) -> Column:
    return F.when(F.contains(url, F.lit("://")), F.element_at(F.split(url, "://", 2), 2)).otherwise("")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without it or for null."""
    return F.coalesce(F.translate(F.regexp_extract(after_scheme(url), "^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def main_text(own: list[Line], neighbour: list[Line] | None) -> tuple[str, int]:
    """A page's main text and the number of lines deleted because the neighbour has them too."""
    shared = set() if neighbour is None else set(common_lines([x.text for x in own], [x.text for x in neighbour]))
    place = main_place([x for i, x in enumerate(own) if i not in shared]) or main_place(own)
    kept = [i for i, x in enumerate(own) if not x.aside and (x.place & place if place else i not in shared)]
    return " ".join(own[i].text for i in kept), len(shared.difference(kept))


def _likeness(a: tuple, b: tuple | None) -> int:
    """Length of the common beginning of two paths of a host; -1 for other hosts and other ranges."""
    return len(os.path.commonprefix([a[3], b[3]])) if b is not None and a[2] and a[2] == b[2] and a[5] == b[5] else -1


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, n_shared) of every row of ``pages``."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.col(html_col).cast("string").alias("html"),
    )
    ordered = _with_neighbours(rows, partitions(pages))

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            columns = [batch.column(i) for i in range(7)]
            for i in range(batch.num_rows):
                page_id, url, host, path, html, at, halo = (c[i].as_py() for c in columns)
                yield page_id, url, host, path, lines(html), at, halo

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        before = here = None
        for after in _ended(parsed(batches)):
            if here is not None and not here[6]:
                nearest = after if _likeness(here, after) >= _likeness(here, before) else before
                text, shared = main_text(here[4], nearest[4] if _likeness(here, nearest) >= 0 else None)
                out.append((here[0], here[1], text, len(text), shared))
                if len(out) >= 500:
                    yield _batch(out)
                    out = []
            before, here = here, after
        yield _batch(out)

    return ordered.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_shared int")


_ORDER = ("host", "path", "page_id", "url")
_KEY = "struct<host:string,path:string,page_id:bigint,url:string>"


def _with_neighbours(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` with (at, halo): in order within each range ``at``; halo marks copies of the pages beside the range."""
    key = F.struct(*_ORDER)
    ranged = rows.select(*_ORDER).repartitionByRange(n, *_ORDER).groupBy(F.spark_partition_id().alias("part"))
    ends = ranged.agg(F.min(key).alias("first"), F.max(key).alias("last")).sort("first").select(F.to_json("first", {"ignoreNullFields": "false"}), F.to_json("last", {"ignoreNullFields": "false"})).collect()
    if not ends:
        return rows.withColumns({"at": F.lit(0), "halo": F.lit(False)})
    firsts, lasts = ([e[k] for e in ends] for k in (0, 1))
    listed = lambda found: F.from_json(F.lit("[" + ",".join(found) + "]"), f"array<{_KEY}>")
    step = max(1, round(len(firsts) ** 0.5))
    up_to = lambda found: F.size(F.filter(found, lambda x: x <= key))
    parts = "[" + ",".join("[" + ",".join(firsts[k: k + step]) + "]" for k in range(0, len(firsts), step)) + "]"
    coarse = F.greatest(up_to(listed(firsts[::step])), F.lit(1))
    number = (coarse - 1) * step + up_to(F.get(F.from_json(F.lit(parts), f"array<array<{_KEY}>>"), coarse - 1)) - 1
    at = F.col("own")
    # Of the places own, own - 1 (for the first) and own + 1 (for the last of its range) those that there are.
    places = F.array(
        at, F.when((F.get(listed(firsts), at) == key) & (at > 0), at - 1), F.when((F.get(listed(lasts), at) == key) & (at < len(firsts) - 1), at + 1)
    )
    dealt = rows.withColumn("own", number.cast("int")).withColumn("at", F.explode(F.filter(places, lambda x: x.isNotNull())))
    dealt = dealt.select("page_id", "url", "host", "path", "html", "at", (at != F.col("at")).alias("halo"))
    return dealt.repartitionByRange(n, "at").sortWithinPartitions("at", *_ORDER)


def _ended(items: Iterator[tuple]) -> Iterator[tuple | None]:
    yield from items
    yield None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 5
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["page_id", "url", "text", "n_chars", "n_shared"])
