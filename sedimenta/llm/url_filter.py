"""URL filter: sorted 64-bit digests in a memory-mapped file, probed by binary search and confirmed by string.

Rules are (verdict, host, path), hashed with xxhash64 and sorted. Up to a bound they are files in the
shared folder that Spark ships to every executor, where workers map them. Beyond it, digest ranges of
the rules are probed where they lie by the distinct digests that URLs ask for. A URL's candidate keys
are the parent domains of its host and the prefixes of its path that are as long as some rule's.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from .common import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def digest(host: str, path: str) -> int:
    return xxhash.xxh64_intdigest(f"{len(host)} {host}{path}".encode("utf-8", "surrogatepass"))


def _digests_of(rules: pa.Table | pa.RecordBatch) -> pa.Array:
    """Digests of columns h and p as signed 64-bit integers."""
    out = np.empty(rules.num_rows, np.uint64)
    for lo in range(0, rules.num_rows, 10_000):
        part = rules.slice(lo, 10_000)
        out[lo : lo + 10_000] = [digest(h, p) for h, p in zip(part.column("h").to_pylist(), part.column("p").to_pylist(), strict=True)]
    return pa.array(out.view(np.int64))


class DigestFile:
    """Sorted digests with the strings, host lengths and verdicts of their rules."""

    PARTS = {"digests": "<u8", "ends": "<i8", "text": np.uint8, "hosts": "<i4", "allow": np.uint8}

    def __init__(self, parts: dict[str, np.ndarray]):
        self.digests, self.ends, self.text, self.hosts, self.allow = (parts[p] for p in self.PARTS)

    @classmethod
    def mapped(cls, folder: str, name: str) -> DigestFile:
        return cls({p: np.memmap(os.path.join(folder, f"{name}.{p}"), dtype=kind, mode="r") for p, kind in cls.PARTS.items()})

    @classmethod
    def of(cls, rules: list[tuple[str, str, str]]) -> DigestFile:
        own = list(zip(*rules, strict=True)) or [[]] * 3
        table = pa.table([pa.array(c, pa.string()) for c in own], names=["verdict", "h", "p"])
        return cls.of_table(table.append_column("digest", _digests_of(table)))

    @classmethod
    def of_table(cls, rules: pa.Table) -> DigestFile:
        """From columns verdict, h, p and digest: sorted as arrays, no rule becomes an object of its own."""
        digests = rules.column("digest").to_numpy().view(np.uint64)
        order = np.argsort(digests, kind="stable")
        text = pc.cast(pc.binary_join_element_wise(rules.column("h"), rules.column("p"), ""), pa.large_binary()).take(pa.array(order))
        text = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
        text = pa.concat_arrays(text.chunks) if isinstance(text, pa.ChunkedArray) else text
        ends = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False).astype("<i8"))
        joined = np.frombuffer(text.buffers()[2], np.uint8)[: int(ends[-1])] if len(ends) and ends[-1] else np.zeros(0, np.uint8)
        hosts = pc.utf8_length(rules.column("h")).to_numpy()[order].astype("<i4")
        allow = pc.equal(rules.column("verdict"), "allow").to_numpy()[order].astype(np.uint8)
        return cls({"digests": digests[order].astype("<u8"), "ends": ends, "text": joined, "hosts": hosts, "allow": allow})

    def bytes(self) -> dict[str, bytes]:
        return {p: a.tobytes() for p, a in zip(self.PARTS, (self.digests, self.ends, self.text, self.hosts, self.allow), strict=True)}

    def find(self, wanted: np.ndarray) -> list[list[int]]:
        """The rules of each digest: none, or one, or several of which strings decide."""
        lo, hi = np.searchsorted(self.digests, wanted, "left"), np.searchsorted(self.digests, wanted, "right")
        return [list(range(a, b)) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]

    def string(self, j: int) -> str:
        return self.text[(self.ends[j - 1] if j else 0) : self.ends[j]].tobytes().decode("utf-8", "surrogatepass")


def candidates(host: str, path: str, lengths: dict[int, list[int]]) -> Iterator[tuple[str, str]]:
    """Suffixes of the host at dots with prefixes of the path, of the lengths that rules have (by host length)."""
    for n, paths in lengths.items():
        if n == len(host) or n < len(host) and host[len(host) - n - 1] == ".":
            for k in paths:
                if k > len(path):
                    break
                yield host[len(host) - n :], path[:k]


def _probe(name: str, lengths: dict[int, list[int]], default: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = DigestFile.mapped(SparkFiles.getRootDirectory(), name)
        for batch in batches:
            keys, of = [], []
            for i, (host, path) in enumerate(zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)):
                own = list(candidates(host, path, lengths))
                keys += own
                of += [i] * len(own)
            best: dict[int, tuple[int, int]] = {}
            found = rules.find(np.fromiter((digest(*k) for k in keys), dtype="<u8", count=len(keys)))
            for i, (host, path), js in zip(of, keys, found, strict=True):
                for j in js:  # equal digests: only the stored string tells
                    if rules.hosts[j] == len(host) and rules.string(j) == host + path:
                        best[i] = max(best.get(i, (-1, 0)), (len(host + path), j))
            rule = [rules.string(best[i][1]) if i in best else None for i in range(batch.num_rows)]
            verdict = [("allow" if rules.allow[best[i][1]] else "block") if i in best else default for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=[*batch.schema.names, "rule", "verdict"])

    return run


def _ship(spark: SparkSession, rules: DigestFile) -> str:
    """Rule files in the shared folder, fetched by every executor."""
    name = f"rules-{uuid.uuid4().hex}"
    for part, raw in rules.bytes().items():
        path = f"{shared_folder(spark)}/{name}.{part}"
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
        for lo in range(0, len(raw), 1 << 22):
            out.write(bytearray(raw[lo : lo + (1 << 22)]))
        out.close()
        spark.sparkContext.addFile(path)
    return name


def _asked(lengths: dict[int, list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, found = [], []
            for r, host, path in zip(*(batch.column(c).to_pylist() for c in ("row", "host", "path")), strict=True):
                own = [digest(*k) for k in candidates(host, path, lengths)]
                row += [r] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(np.array(found, np.uint64).view(np.int64))], names=["row", "digest"])

    return run


def _ruled(table: pa.Table, asked: pa.Table) -> pa.Table:
    """The rules of a digest range whose digests were asked for."""
    wanted = np.unique(asked.column("digest").to_numpy().view(np.uint64))
    rules = DigestFile.of_table(table.filter(pc.is_in(table.column("digest"), pa.array(wanted.view(np.int64)))))
    out = [(w, rules.string(j), int(rules.hosts[j]), "allow" if rules.allow[j] else "block") for w, js in zip(wanted.view(np.int64).tolist(), rules.find(wanted), strict=True) for j in js]
    columns = list(zip(*out, strict=True)) or [[]] * 4
    return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.int32(), pa.string()), strict=True)], names=["digest", "text", "n_host", "verdict"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.append_column("digest", _digests_of(batch))


def _by_ranges(rows: DataFrame, rules: DataFrame, lengths: dict[int, list[int]], default: str, ranges: int, salts: int = 16) -> DataFrame:
    """Verdicts by rules(verdict, h, p, digest) in digest ranges: distinct digests are probed there, hits come back to the rows.

    Hits are one row a rule and are copied for `salts` parts of the rows, so that a rule that most URLs ask for meets them in several tasks.
    """
    rows = cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()), "urls")  # row numbers are as written
    part = F.expr(f"pmod(digest, {ranges})").alias("part")
    asked = rows.mapInArrow(_asked(lengths), "row long, digest long")
    filed = rules.select("*", part)
    distinct = asked.select("digest").distinct().select("digest", part)
    hits = filed.groupBy("part").cogroup(distinct.groupBy("part")).applyInArrow(_ruled, "digest long, text string, n_host int, verdict string")
    hits = hits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    found = asked.withColumn("salt", F.expr(f"cast(pmod(row, {salts}) as int)")).join(hits, ["digest", "salt"]).join(rows, "row")
    sure = "right(host, n_host) = left(text, n_host) and startswith(path, substring(text, n_host + 1)) and (length(host) = n_host or right(host, n_host + 1) = '.' || left(text, n_host))"
    best = found.where(sure).groupBy("row").agg(F.max_by(F.struct("text", "verdict"), F.length("text")).alias("b"))
    out = rows.join(best, "row", "left")
    return out.select("page_id", "host", "path", F.col("b.text").alias("rule"), F.coalesce("b.verdict", F.lit(default)).alias("verdict"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, default: str = "allow", most_rules: int = 1_000_000) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of pages(page_id, url).

    A rule fits its host and all subdomains where the path starts with the rule's; the longest rule
    wins (of equal rules the first of a list, in a table the one that blocks); without one the verdict
    is `default`, as for a URL on no list. rules: a list, or a table (verdict, host, path) of any size;
    rows of it with nulls are no rules. Files of most_rules rules at most reach every executor; more
    rules are probed in digest ranges of that size, with the same results.

    Null URLs and URLs without :// have empty hosts and paths. Rows stay one for one; other columns
    are ignored.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not isinstance(rules, DataFrame):
        rules = list({(h, p): (v, h, p) for v, h, p in reversed(rules)}.values())
        n, lengths = len(rules), _lengths((len(h), len(p)) for _, h, p in rules)
        if 0 < n <= most_rules:
            return _by_files(rows, DigestFile.of(rules), lengths, default)
        own = spark.createDataFrame(rules, "verdict string, h string, p string")
    else:
        own = rules.selectExpr("verdict", "host as h", "path as p").where("verdict is not null and h is not null and p is not null")
        own = own.groupBy("h", "p").agg(F.max("verdict").alias("verdict")).select("verdict", "h", "p")
    own = cut_lineage(own.mapInArrow(_digests, "verdict string, h string, p string, digest long"), "rules")
    n = own.count()
    if not n:
        return rows.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    lengths = _lengths(tuple(r) for r in own.select(F.length("h"), F.length("p")).distinct().collect())  # as many as lengths of hosts and paths
    if n <= most_rules:
        return _by_files(rows, DigestFile.of_table(own.toArrow()), lengths, default)
    return _by_ranges(rows, own, lengths, default, -(-n // most_rules))


def _by_files(rows: DataFrame, rules: DigestFile, lengths: dict[int, list[int]], default: str) -> DataFrame:
    name = _ship(rows.sparkSession, rules)
    return rows.mapInArrow(_probe(name, lengths, default), "page_id long, host string, path string, rule string, verdict string")


def _lengths(pairs) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for h, p in sorted(set(pairs)):
        out.setdefault(h, []).append(p)
    return out
