"""URL verdicts by rules on host and path, as a sort-merge range join.

A host is written with its labels reversed and a dot after each (``net.example.www.``), so a host
and all its subdomains share a prefix, and a prefix is an interval of the sorted keys. Rules and
URLs are sorted together by range; each range is swept once with a stack of the rules that are
open at the key at hand. What is open where a range begins comes from one summary row for each
earlier range. The first sweep finds the hosts with rules above each URL's host, the second one,
over host and path, the longest rule of each such host.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from wavecohort.session import durable

UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """A-Z in small letters, all else unchanged."""
    return F.translate(text, UPPER, SMALL)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty for null and where ``://`` is missing."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return lowered(host), path


def reversed_host(host: Column) -> Column:
    """``www.example.net`` as ``net.example.www.``; the empty host, below which nothing lies, stays empty."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sorted range: each point with the rules of this range that are open there; last, what is open at its end."""
    chunk = TaskContext.get().partitionId()
    stack: list[str] = []
    first, last, number, kind = None, "", 0, None

    def out(keys, rows, keeps, opens, firsts):
        texts = pa.array(opens, pa.list_(pa.string())), pa.array(firsts, pa.string())
        arrays = [pa.array(keys, pa.string()), pa.array(rows, pa.int64()), texts[0], pa.array([chunk] * len(keys), pa.int32()), texts[1], keeps]
        return pa.RecordBatch.from_arrays(arrays, names=["_key", "_row", "_open", "_chunk", "_first", "_keep"])

    for b in batches:
        kind = b.schema.field(2).type
        found, opens = [], []
        for i, (last, point) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
            first = last if first is None else first
            while stack and not last.startswith(stack[-1]):
                stack.pop()
            if point:
                found.append(i)
                opens.append(list(stack))
            else:
                stack.append(last)
        if found:
            kept, at = b.take(pa.array(found)), (chunk << 33) + number
            yield out(kept.column(0), range(at, at + len(found)), kept.column(2), opens, [None] * len(found))
            number += len(found)
    if first is not None:
        yield out([last], [None], pa.nulls(1, kind), [stack], [first])


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the ends of all ranges in order, what is open where each range begins."""
    stack: list[str] = []
    for b in batches:
        before = []
        for last, first, opened in zip(*(b.column(n).to_pylist() for n in ("_key", "_first", "_open"))):
            while stack and not first.startswith(stack[-1]):
                stack.pop()
            before.append(list(stack))
            while stack and not last.startswith(stack[-1]):
                stack.pop()
            stack += opened
        yield pa.RecordBatch.from_arrays([b.column(b.schema.names.index("_chunk")), pa.array(before, pa.list_(pa.string()))], names=["_chunk", "_before"])


def open_prefixes(points: DataFrame, rules: DataFrame, key: Column, found: str) -> DataFrame:
    """``points`` with ``found``, the keys of all rules that are a prefix of ``key``, shortest first.

    ``rules`` has one column of different keys. ``_row`` numbers the points. Points of equal key are
    spread over ranges by a draw. A range leaves one row for the sweep over all
    ranges, with as many rules as are nested at its end.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in points.columns])
    kept = points.select(key.alias("_key"), F.lit(True).alias("_point"), whole.alias("_keep"))
    opening = rules.select(F.col(rules.columns[0]).alias("_key"), F.lit(False).alias("_point"))
    line = opening.unionByName(kept, allowMissingColumns=True).where(F.col("_key").isNotNull())
    line = line.repartitionByRange("_key", "_point", F.rand(11)).sortWithinPartitions("_key", "_point")
    schema = T.StructType.fromDDL("_key string, _row long, _open array<string>, _chunk int, _first string")
    schema.add("_keep", line.schema["_keep"].dataType)
    swept = durable(line.select("_key", "_point", "_keep").mapInArrow(_swept, schema), "swept")
    ends = swept.where(F.col("_row").isNull()).select("_key", "_first", "_open", "_chunk")
    before = ends.repartition(1).sortWithinPartitions("_chunk").mapInArrow(_carried, "_chunk int, _before array<string>")
    joined = swept.where(F.col("_row").isNotNull()).join(before, "_chunk", "left")
    opened = F.concat(F.filter("_before", lambda p: F.startswith(F.col("_key"), p)), F.col("_open"))
    return joined.select("_keep.*", "_row", opened.alias(found))


def judged(pages: DataFrame, rules: DataFrame, url: str = "url", otherwise: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, the longest fitting ``rule`` (host and path, null if none) and its ``verdict``.

    ``rules`` has host, path and verdict. A rule fits its host and all subdomains where the path
    begins with the rule's. The longest (host and path together, then host) wins; of equal rules with
    different verdicts the block. Rules without a host, or with a path that does not begin with a slash, fit
    nothing; a null path is an empty one. Pages no rule fits have the verdict ``otherwise``. Null URLs and those without
    ``://`` have an empty host and path. All rows stay, repeated ones too; columns named like the new
    ones are replaced. An empty table of pages gives an empty one, without rules nothing fits.
    """
    names = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    given = (
        rules.select(lowered(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), F.col("verdict"))
        .where("host != '' and (path = '' or path like '/%')")
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))  # block comes after allow
        .withColumn("above", reversed_host(F.col("host")))
    )
    host, path = host_and_path(F.col(url))
    carried = pages.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("page"), host.alias("host"), path.alias("path"))
    hosts = open_prefixes(carried, given.select("above").distinct(), reversed_host(F.col("host")), "hosts")
    hosts = durable(hosts, "hosts")
    plain = hosts.where(F.size("hosts") == 0).select("page.*", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict"))
    asks = hosts.where(F.size("hosts") > 0).select(F.col("_row").alias("number"), "page", "host", "path", F.explode("hosts").alias("above"))
    keys = given.select(F.concat("above", "path").alias("key"), F.concat("host", "path").alias("rule"), F.char_length("host").alias("n"), "verdict")
    deepest = open_prefixes(asks, keys.select("key"), F.concat("above", "path"), "open").withColumn("key", F.try_element_at("open", F.lit(-1)))
    matched = deepest.join(keys, "key", "left")
    best = F.max(F.when(F.col("rule").isNotNull(), F.struct(F.char_length("rule"), F.col("n"), F.col("rule"), F.col("verdict"))))
    fitted = matched.groupBy("number").agg(F.any_value(F.struct("page", "host", "path")).alias("at"), best.alias("best"))
    ruled = fitted.select("at.page.*", "at.host", "at.path", "best.rule", F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"))
    return plain.unionByName(ruled)
