"""Refinement in order: each artifact is held against what the earlier ones, and the merges they caused, have made of the knowledge.

The result is that of one loop over all artifacts of a type, but types are cut into parts that are folded
side by side. A first cut joins artifacts whose overlap may reach the limit. A merge makes an entry that none
of the artifacts is; every such version is then held against all artifacts, parts that it links are joined
and folded anew, until no version links two parts. From then on no artifact has a match outside its part,
so that by induction over the order each decision is that of the loop. Joining more than needed is never
wrong: a value that very many hold links them all without any pair.

A part streams through its task in order: the task holds the entries the part keeps, not its artifacts.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.components import components
from ..session import let_workers_import, written
from ..sources.pages import concept_artifacts
from ..sources.versions import VersionedTable
from .refinement import DUPLICATE, ENRICHED, KEY_FIELDS, MERGED_LISTS

#: Columns of saved knowledge.
ENTRIES = "type_id string, file_name string, body string, sources array<string>"
_LOG = "part long, id long, kind string, seq long, type_id string, decision string, match string, overlap double, added array<string>, enriched array<string>, sets array<array<string>>, entry string, body string, sources array<string>"
Sets = list[frozenset[str]]
Merge = Callable[[dict, dict], dict]


def values(data: object, path: str) -> list:
    """Values at a path: `f` a field, `f[]` the items of a list, `*` the keys of an object; a list at the end gives its items, an object its values."""
    found = [data]
    for step in path.split("."):
        objects = [x for x in found if isinstance(x, dict)]
        if step == "*":
            found = [k for x in objects for k in x]
        elif step.endswith("[]"):
            found = [item for x in objects if isinstance(x.get(step[:-2]), list) for item in x[step[:-2]]]
        else:
            found = [x[step] for x in objects if step in x]
    return [v for x in found for v in (x if isinstance(x, list) else x.values() if isinstance(x, dict) else [] if x is None else [x])]


def parsed(body: str | None) -> dict:
    """The JSON object of a body; empty if it is none."""
    try:
        out = json.loads(body or "")
    except ValueError:
        return {}
    return out if isinstance(out, dict) else {}


def key_sets(data: dict, type_id: str) -> Sets:
    """The identifying values of each first path, in lower case; false ones count as none."""
    return [frozenset(str(v).lower() for v in values(data, p) if v) for p in KEY_FIELDS.get(type_id, ((), ()))[0]]


def text_lengths(data: dict, type_id: str) -> list[int]:
    """Length of the texts at each second path."""
    return [sum(len(str(v)) for v in values(data, p)) for p in KEY_FIELDS.get(type_id, ((), ()))[1]]


def simple_merge(old: dict, new: dict) -> dict:
    """`old` with those items of the lists of `new` whose id (else name) no old item has. Lists that a side lacks, and fields that are no lists, stay."""
    name = lambda item: str(item.get("id") or item.get("name") or "").lower() if isinstance(item, dict) else ""
    out = dict(old)
    for field in MERGED_LISTS:
        a, b = old.get(field), new.get(field)
        if isinstance(a, list) and isinstance(b, list):
            known = {name(x) for x in a}
            out[field] = a + [x for x in b if name(x) and name(x) not in known]
    return out


class _Entry:
    def __init__(self, name: str, body: str | None, sets: Sets, lengths: list[int], sources: list[str]):
        self.name, self.body, self.sets, self.lengths, self.sources = name, body, sets, lengths, sources


class _Part:
    """The entries of one part in order, found by the values they hold."""

    def __init__(self, type_id: str, least: float, merge: Merge):
        self.type_id, self.least, self.merge = type_id, least, merge
        self.entries: list[_Entry] = []
        self.holders: dict[tuple[int, str], set[int]] = {}

    def hold(self, at: int, sets: Sets) -> None:
        for path, s in enumerate(sets):
            for v in s:
                self.holders.setdefault((path, v), set()).add(at)

    def drop(self, at: int, sets: Sets) -> None:
        for path, s in enumerate(sets):
            for v in s:
                self.holders[path, v].discard(at)

    def best(self, sets: Sets) -> tuple[float, int]:
        """Largest overlap with an entry and its place, the first of equal ones."""
        shared = Counter((at, path) for path, s in enumerate(sets) for v in s for at in self.holders.get((path, v), ()))
        score, place = 0.0, -1
        for at in sorted({at for at, _ in shared}):
            shares = [shared[at, p] / (len(a) + len(b) - shared[at, p]) for p, (a, b) in enumerate(zip(sets, self.entries[at].sets, strict=True)) if a or b]
            overlap = sum(shares) / len(shares)
            if overlap > score:
                score, place = overlap, at
        return score, place

    def add(self, entry: _Entry) -> None:
        self.hold(len(self.entries), entry.sets)
        self.entries.append(entry)

    def take(self, row: dict) -> Iterator[dict]:
        """Decide one artifact: its log row, and the version that it makes of an entry if that has other values."""
        log = {"id": row["id"], "seq": row["seq"], "type_id": self.type_id}
        data, sets = parsed(row["body"]), [frozenset(s) for s in row["sets"]]
        lengths = text_lengths(data, self.type_id)
        if row["entry"] is not None:
            return self.add(_Entry(row["entry"], row["body"], sets, lengths, row["sources"] or []))
        score, at = self.best(sets)
        if score < self.least:
            self.add(_Entry(str(row["seq"]), row["body"], sets, lengths, row["sources"] or []))
            yield log | {"kind": "decision", "decision": "add"}
            return
        old, (first, second) = self.entries[at], KEY_FIELDS[self.type_id]
        added = sorted(f"{p}={v}" for p, a, b in zip(first, sets, old.sets, strict=True) for v in a - b)
        enriched = [p for p, a, b in zip(second, lengths, old.lengths, strict=True) if a > b * ENRICHED]
        yield log | {"kind": "decision", "decision": "merge" if added or enriched else "skip", "match": old.name, "overlap": score, "added": added, "enriched": enriched}
        if added or enriched:
            merged = self.merge(parsed(old.body), data)
            new = _Entry(old.name, json.dumps(merged, ensure_ascii=False), key_sets(merged, self.type_id), text_lengths(merged, self.type_id), list(dict.fromkeys([*old.sources, *(row["sources"] or [])])))
            if new.sets != old.sets:
                self.drop(at, old.sets), self.hold(at, new.sets)
                yield log | {"kind": "version", "sets": [sorted(s) for s in new.sets]}
            self.entries[at] = new

    def kept(self) -> Iterator[dict]:
        for e in self.entries:
            yield {"kind": "entry", "type_id": self.type_id, "entry": e.name, "body": e.body, "sources": e.sources}


def _fold(least: float, merge: Merge, names: list[str]):
    def run(batches):
        part, state, out = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != part:
                    if state:
                        out += [{"part": part} | r for r in state.kept()]
                    part, state = row["part"], _Part(row["type_id"], least, merge)
                out += [{"part": part} | r for r in state.take(row)]
                if len(out) >= 1000:
                    yield _batch(out, names)
                    out = []
        if state:
            out += [{"part": part} | r for r in state.kept()]
        for i in range(0, len(out), 1000):
            yield _batch(out[i : i + 1000], names)

    return run


_ARROW = {"part": pa.int64(), "id": pa.int64(), "seq": pa.int64(), "overlap": pa.float64(), "added": pa.list_(pa.string()), "enriched": pa.list_(pa.string()), "sources": pa.list_(pa.string()), "sets": pa.list_(pa.list_(pa.string()))}


def _batch(rows: list[dict], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], _ARROW.get(n, pa.string())) for n in names], names=names)


def _with_sets(batches):
    for batch in batches:
        sets = [[sorted(s) for s in key_sets(parsed(b), t)] for b, t in zip(batch.column("body").to_pylist(), batch.column("type_id").to_pylist(), strict=True)]
        yield batch.append_column("sets", pa.array(sets, pa.list_(pa.list_(pa.string()))))


def _values(sets: DataFrame) -> DataFrame:
    return sets.select("node", "type_id", F.posexplode("sets").alias("path", "s")).where("size(s) > 0").select("node", "type_id", "path", F.size("s").alias("n"), F.explode("s").alias("value"))


def _keys(sets: DataFrame, often: DataFrame, least: float) -> DataFrame:
    """The rarest values of each path that a partner of the least overlap must share one of."""
    ranked = _values(sets).join(often, ["type_id", "path", "value"], "left").select("node", "type_id", "path", "n", F.struct(F.coalesce("f", F.lit(0)).alias("f"), "value").alias("o"))
    ranked = ranked.groupBy("node", "type_id", "path", "n").agg(F.array_sort(F.collect_list("o")).alias("o"))
    prefix = F.expr(f"slice(transform(o, x -> x.value), 1, n - cast(ceil({least} * n) as int) + 1)")
    return ranked.select("node", "type_id", "path", "n", F.explode(prefix).alias("value"))


_OVERLAP = "filter(transform(x, (s, i) -> if(size(s) + size(y[i]) = 0, cast(null as double), size(array_intersect(s, y[i])) / size(array_union(s, y[i])))), o -> o is not null)"


def _links(left: DataFrame, right: DataFrame, left_keys: DataFrame, right_keys: DataFrame, least: float, crowd: int) -> DataFrame:
    """(a, b): parts of rows of left and right(node, sets, part) whose overlap may reach `least`.

    Values that at most `crowd` rows of a side hold give pairs, which are compared; of more, all holders are linked to one.
    """
    at = ["type_id", "path", "value"]
    l, r = left_keys.join(left.select("node", "part"), "node"), right_keys.join(right.select("node", "part"), "node")
    held = l.groupBy(at).agg(F.count("*").alias("k"), F.min("part").alias("one")).join(r.groupBy(at).agg(F.count("*").alias("m"), F.min("part").alias("other")), at)
    held = written(held.withColumn("many", F.expr(f"k > {crowd} or m > {crowd}")), "held")
    many = held.where("many")
    stars = l.join(many, at).selectExpr("one as a", "part as b").union(r.join(many, at).selectExpr("other as a", "part as b")).union(many.selectExpr("one as a", "other as b"))
    few = held.where("not many").select(at)
    pairs = l.join(few, at, "left_semi").join(r.selectExpr("node as mate", "part as b", "n as m", *at), at).where(f"part <> b and n >= {least} * m and m >= {least} * n").select("node", "mate").distinct()
    both = pairs.join(left.selectExpr("node", "part as a", "sets as x"), "node").join(right.selectExpr("node as mate", "part as b", "sets as y"), "mate")
    alike = both.withColumn("o", F.expr(_OVERLAP)).where(f"size(o) > 0 and aggregate(o, 0D, (p, q) -> p + q) / size(o) >= {least} - 1e-9D").select("a", "b")
    return stars.union(alike).where("a <> b").distinct()


def refine(artifacts: DataFrame, saved: DataFrame | None = None, merge: Merge = simple_merge, least: float = DUPLICATE, crowd: int = 64) -> tuple[DataFrame, DataFrame]:
    """Decisions on artifacts(seq, type_id, source_url, body) taken in order of seq, and the knowledge they leave.

    First table: seq, type_id, decision (add, merge or skip), match (name of the entry that is alike: its file name if
    it was saved before, else the seq of its first artifact), overlap, added (path=value) and enriched (paths). Second
    table: type_id, entry, body and sources of each entry, those of `saved` (ENTRIES) included, which come first by name.

    Each artifact is held against the entries as the earlier ones left them: the entry of the largest overlap, the
    first of equal ones, if it reaches `least`. What adds values or has over 1.2 times as much text is merged by
    `merge`, else skipped. Bodies that are no JSON objects, types without fields and artifacts without values are
    added. Rows that share a seq come in the order of the scan; null seqs come first. Rows of a null type form a type.
    """
    spark = artifacts.sparkSession
    let_workers_import(spark)
    source = F.when(F.coalesce("source_url", F.lit("")) != "", F.array("source_url"))
    rows = artifacts.select(F.col("seq").cast("long"), "type_id", F.lit(None).cast("string").alias("entry"), "body", source.alias("sources"))
    if saved is not None:
        rows = saved.select(F.lit(None).cast("long").alias("seq"), "type_id", F.col("file_name").alias("entry"), "body", "sources").union(rows)
    rows = rows.withColumn("type_id", F.coalesce("type_id", F.lit(""))).mapInArrow(_with_sets, "seq long, type_id string, entry string, body string, sources array<string>, sets array<array<string>>")
    # artifacts of equal values are in one part anyway; those without values are parts of their own
    rows = written(rows.withColumn("id", F.monotonically_increasing_id()).withColumn("any", F.expr("exists(sets, s -> size(s) > 0)")), "artifacts")
    classes = written(rows.where("any").groupBy("type_id", "sets").agg(F.min("id").alias("node")).withColumn("part", F.col("node")), "classes")
    often = written(_values(classes).groupBy("type_id", "path", "value").agg(F.count("*").alias("f")), "often")
    keys = written(_keys(classes, often, least), "keys")
    found, logs, todo = _links(classes, classes, keys, keys, least, crowd), None, None
    while True:
        joined = components(found).selectExpr("node as part", "component")
        if logs is not None:
            if joined.isEmpty():
                break
            todo = joined.select("component").distinct()
            logs = logs.join(joined.select("part"), "part", "left_anti")
        classes = written(classes.join(joined, "part", "left").select("node", "type_id", "sets", F.coalesce("component", "part").alias("part")), "classes")
        placed = rows.where("any").join(classes.select("type_id", "sets", "part"), ["type_id", "sets"])
        if todo is not None:
            placed = placed.join(todo.withColumnRenamed("component", "part"), "part", "left_semi")
        columns = ["part", "id", "seq", "type_id", "entry", "body", "sources", "sets"]
        ordered = placed.select(columns).repartition("part").sortWithinPartitions("part", F.col("entry").asc_nulls_last(), "seq", "id")
        new = written(ordered.mapInArrow(_fold(least, merge, [c.split()[0] for c in _LOG.split(", ")]), _LOG), "folded")
        logs = new if logs is None else written(logs.unionByName(new), "log")
        versions = written(new.where("kind = 'version'").select("type_id", "sets", "part").distinct().withColumn("node", F.monotonically_increasing_id()), "versions")
        found = _links(versions, classes, _keys(versions, often, least), keys, least, crowd)
    single = rows.where("not any")
    alone = single.where("entry is null").selectExpr("seq", "type_id", "'add' as decision", "cast(null as string) as match", "cast(null as double) as overlap", "cast(null as array<string>) as added", "cast(null as array<string>) as enriched")
    decided = logs.where("kind = 'decision'").select(alone.columns).unionByName(alone)
    left = single.selectExpr("type_id", "coalesce(entry, cast(seq as string)) as entry", "body", "coalesce(sources, array()) as sources")
    return decided, logs.where("kind = 'entry'").select(left.columns).unionByName(left)


def file_names(entries: DataFrame) -> DataFrame:
    """Entries as they are saved (ENTRIES): an entry saved before keeps its name, a new one gets `{last part of the type}_{clean slug}.json`; of equal names the one of the greatest seq stays."""
    slug = F.regexp_replace(F.coalesce(F.get_json_object("body", "$.content_slug"), F.lit("unknown")), r"[^\p{L}\p{N}_]", "_")
    name = F.when(F.col("entry").endswith(".json"), F.col("entry")).otherwise(F.concat(F.element_at(F.split("type_id", r"\."), -1), F.lit("_"), slug, F.lit(".json")))
    last = F.struct(F.expr("try_cast(entry as long)").alias("at"), "body", "sources")
    return entries.groupBy("type_id", name.alias("file_name")).agg(F.max(last).alias("e")).select("type_id", "file_name", "e.body", "e.sources")


def refine_and_save(artifacts: DataFrame, saved: VersionedTable, dry_run: bool = False, **options) -> DataFrame:
    """Refine artifacts against the saved knowledge (ENTRIES) and publish what they leave as its next version: the decisions. A dry run publishes nothing."""
    if dry_run:
        return refine(artifacts, saved.read(), **options)[0]
    out = []

    def change(old: DataFrame) -> DataFrame:
        decided, left = refine(artifacts, old, **options)
        out.append(decided)
        return file_names(left)

    saved.update(change)
    return out[0]


def r03_refined_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each artifact when merges change what later ones meet."""
    decided, _ = refine(concept_artifacts(spark, sf_dir))
    return decided.select("seq", "decision", "match", F.round("overlap", 6).alias("overlap"), F.array_join("added", "|").alias("added"), F.coalesce(F.size("enriched"), F.lit(0)).alias("enriched"))


def r03_refined_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The knowledge that the artifacts leave: elements and sources of each entry."""
    _, left = refine(concept_artifacts(spark, sf_dir))
    items = F.expr("coalesce(json_array_length(get_json_object(body, '$.elements')), 0)")
    return left.select("entry", items.alias("elements"), F.size("sources").alias("sources"), F.md5("body").alias("body_md5"))


QUERIES = {q.__name__: q for q in (r03_refined_in_order, r03_refined_entries)}
ORACLES: dict[str, str] = {}
