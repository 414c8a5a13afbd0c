"""Refinement of JSON artifacts: values by path, field overlap, increments, decisions, merges and provenance.

A body that is null or no JSON object has no values. Values compare in lower case; null, empty, zero and
false ones count as none. Decisions are set-based: each artifact is held against all earlier ones of its
type as they came, not against what earlier merges would have made of them, so that no type is a fold in
one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from ..sources.pages import CONCEPTS, CONCEPTS_SQL, concept_artifacts

#: Paths that tell what an artifact of a type is about, and those that may be enriched: fixed values.
KEY_FIELDS = {
    "diagrams.dfd.concepts": (["elements[].id", "elements[].name"], ["description"]),
    "diagrams.dfd.rules": (["rules[].id", "rules[].name"], ["description"]),
    "diagrams.dfd.examples": (["scenarios[].name", "scenarios[].domain"], ["case_name", "description"]),
    "diagrams.dfd.templates": (["categories[].templates[].id", "categories[].templates[].name"], ["categories[].name"]),
    "diagrams.dfd.validation": (["validation_rules[].id", "validation_rules[].name"], ["description"]),
    "diagrams.dfd.levels": (["leveling_principles[].id", "decomposition_rules[].id"], ["description"]),
    "theory": (["concepts[].id", "concepts[].name", "principles[].id"], ["description"]),
    "mappings": (["semantic_cues.*", "linguistic_patterns[].pattern"], []),
    "schema": (["title", "properties.*"], []),
    "domain": (["domain_id", "concepts[].name"], ["description"]),
    "examples": (["example_id", "title"], ["description"]),
    "rules": (["rule_id", "rules[].id"], ["description"]),
}
#: Lists whose items a merge brings together, fixed values.
MERGED_LISTS = ["elements", "rules", "scenarios", "categories", "validation_rules", "concepts", "principles", "leveling_principles", "decomposition_rules"]
#: Least overlap of a duplicate, and by how much more text counts as enriched: fixed values.
DUPLICATE, ENRICHED = 0.6, 1.2


def values_at(body: str, path: str) -> Column:
    """Values of a JSON column at a path, as texts: `f` a field, `f[]` the items of a list, `*` the keys of an object.

    A list at the end gives its items, an object its values. Missing fields give none.
    """
    step = {
        "[]": "flatten(transform({0}, x -> coalesce(from_json(get_json_object(x, '$.{1}'), 'array<string>'), array())))",
        "*": "flatten(transform({0}, x -> coalesce(json_object_keys(x), array())))",
        ".": "filter(transform({0}, x -> get_json_object(x, '$.{1}')), x -> x is not null)",
    }
    out = f"if({body} is null, array(), array({body}))"
    for part in path.split("."):
        kind = "*" if part == "*" else "[]" if part.endswith("[]") else "."
        out = step[kind].format(out, part.removesuffix("[]"))
    leaf = "flatten(transform({0}, x -> coalesce(case when startswith(x, '[') then from_json(x, 'array<string>') when startswith(x, '{{') then map_values(from_json(x, 'map<string,string>')) end, array(x))))"
    return F.expr(leaf.format(out))


def key_values(body: str, path: str) -> Column:
    """The distinct values at a path that identify, in lower case and sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(values_at(body, path), lambda x: ~x.isin("", "0", "0.0", "false", "null", "[]", "{}")), F.lower)))


def field_overlap(pairs: list[tuple[Column, Column]]) -> Column:
    """Mean Jaccard overlap of pairs of value sets, over those where either side has values; 0 without any."""
    share = [F.when((F.size(a) > 0) | (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))) for a, b in pairs]
    n = sum((s.isNotNull().cast("int") for s in share), F.lit(0))
    return F.when(n > 0, sum((F.coalesce(s, F.lit(0.0)) for s in share), F.lit(0.0)) / n).otherwise(0.0)


def increments(new: str, old: str, type_id: str) -> tuple[Column, Column]:
    """What the body `new` adds to `old`: values of the first paths as path=value, and the second paths whose text is over 1.2 times as long."""
    primary, secondary = KEY_FIELDS[type_id]
    named = lambda p: lambda x: F.concat(F.lit(f"{p}="), x)
    added = [F.transform(F.array_except(key_values(new, p), key_values(old, p)), named(p)) for p in primary]
    length = lambda body, p: F.aggregate(values_at(body, p), F.lit(0), lambda n, x: n + F.length(x))
    longer = [F.when(length(new, p) > length(old, p) * ENRICHED, F.lit(p)) for p in secondary]
    return F.flatten(F.array(*added)), F.array_compact(F.array(*longer)) if longer else F.array().cast("array<string>")


def duplicates(artifacts: DataFrame, type_id: str, least: float = DUPLICATE) -> DataFrame:
    """seq, match, overlap: of each artifact(seq, body) of one type, the earlier one of the largest overlap, ties to the first, if it reaches least.

    Artifacts of equal value sets are one class, whose first is the match of all others. Classes meet over the
    rarest values of a path: a mean of at least `least` needs one path of that overlap, and two sets of that
    overlap share a value among the first size - ceil(least * size) + 1 by rarity. Pairs go by ids alone, once each.
    """
    primary = KEY_FIELDS[type_id][0]
    sets = artifacts.select("seq", F.explode(F.array(F.array(*(key_values("body", p) for p in primary)))).alias("s"))
    classes = sets.groupBy("s").agg(F.min("seq").alias("rep"))
    own = sets.join(classes, "s").where("seq <> rep and exists(s, v -> size(v) > 0)").selectExpr("seq", "rep as match", "1.0D as overlap")
    values = classes.select("rep", F.posexplode("s").alias("path", "v")).where("size(v) > 0").select("rep", "path", F.size("v").alias("n"), F.explode("v").alias("value"))
    rare = values.join(values.groupBy("path", "value").agg(F.count("*").alias("f")), ["path", "value"])
    ordered = rare.groupBy("rep", "path", "n").agg(F.array_sort(F.collect_list(F.struct("f", "value"))).alias("o"))
    keys = ordered.select("rep", "path", "n", F.expr(f"explode(slice(o, 1, n - cast(ceil({least} * n) as int) + 1))").alias("k")).select("rep", "path", "n", "k.value")
    a, b = keys, keys.selectExpr("rep as match", "path", "n as m", "value")
    pairs = a.join(b, ["path", "value"]).where(f"match < rep and n >= {least} * m and m >= {least} * n").select("rep", "match").distinct()
    left, right = classes.selectExpr("rep", "s as x"), classes.selectExpr("rep as match", "s as y")
    both = pairs.join(left, "rep").join(right, "match")
    scored = both.select("rep", "match", field_overlap([(F.col("x")[i], F.col("y")[i]) for i in range(len(primary))]).alias("overlap")).where(F.col("overlap") >= least)
    best = scored.groupBy("rep").agg(F.max(F.struct("overlap", (-F.col("match")).alias("m"))).alias("b"))
    return own.unionByName(best.selectExpr("rep as seq", "-b.m as match", "b.overlap"))


def decisions(artifacts: DataFrame, type_id: str) -> DataFrame:
    """seq, match, overlap, added, enriched and decision: merge for a duplicate that adds something, skip for one that does not, else add."""
    found = artifacts.join(duplicates(artifacts, type_id), "seq", "left")
    rows = found.join(artifacts.select(F.col("seq").alias("match"), F.col("body").alias("old")), "match", "left")
    added, enriched = increments("body", "old", type_id)
    rows = rows.select("seq", "match", "overlap", "source_url", F.when(F.col("match").isNotNull(), added).alias("added"), F.when(F.col("match").isNotNull(), enriched).alias("enriched"))
    return rows.withColumn("decision", F.expr("case when match is null then 'add' when size(added) > 0 or size(enriched) > 0 then 'merge' else 'skip' end"))


def simple_merge(old: str, new: str, name: str) -> Column:
    """The list `name` of a merge, as JSON texts: the old items, then the new ones whose id (else name) no old item has. Null if a side lacks the list."""
    items = "from_json(get_json_object({}, '$.{}'), 'array<string>')"
    a, b = items.format(old, name), items.format(new, name)
    key = "lower(coalesce(nullif(get_json_object(x, '$.id'), ''), nullif(get_json_object(x, '$.name'), '')))"
    return F.expr(f"concat({a}, filter({b}, x -> {key} is not null and not array_contains(coalesce(filter(transform({a}, x -> {key}), x -> x is not null), array()), {key})))")


def provenance(old_url: Column, new_url: Column) -> Column:
    """Where a merged artifact comes from: url and role of each source, each URL once."""
    both = F.array(F.struct(old_url.alias("url"), F.lit("existing").alias("role")), F.when(~new_url.eqNullSafe(old_url), F.struct(new_url.alias("url"), F.lit("new").alias("role"))))
    return F.filter(F.array_compact(both), lambda s: F.coalesce(s["url"], F.lit("")) != "")


def p04_path_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of each artifact at a list's field, a plain field, an object's keys and an object as a whole."""
    paths = {"ids": "elements[].id", "description": "description", "meta_keys": "meta.*", "meta": "meta"}
    return concept_artifacts(spark, sf_dir).select("seq", *(F.array_join(values_at("body", p), "|").alias(k) for k, p in paths.items()))


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = concept_artifacts(spark, sf_dir)
    return rows.join(rows.select((F.col("seq") + 1).alias("seq"), F.col("body").alias("old")), "seq")


def a16_field_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of each artifact with the one before it."""
    pairs = [(key_values("body", p), key_values("old", p)) for p in KEY_FIELDS[CONCEPTS][0]]
    return _neighbours(spark, sf_dir).select("seq", F.round(field_overlap(pairs), 6).alias("overlap"))


def a17_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each artifact adds to the one before it (X02 the added values)."""
    added, enriched = increments("body", "old", CONCEPTS)
    rows = _neighbours(spark, sf_dir).select("seq", F.array_join(F.array_sort(added), "|").alias("added"), F.array_join(enriched, "|").alias("enriched"))
    return rows.withColumn("has_increment", F.expr("added <> '' or enriched <> ''"))


def r05_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicates among all artifacts without writing anything."""
    return duplicates(concept_artifacts(spark, sf_dir), CONCEPTS).withColumn("overlap", F.round("overlap", 6))


def r03_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decisions(concept_artifacts(spark, sf_dir), CONCEPTS)
    return rows.select("seq", "match", F.array_join(F.array_sort("added"), "|").alias("added"), F.size("enriched").alias("enriched"), "decision").fillna({"enriched": 0}).withColumn("enriched", F.greatest("enriched", F.lit(0)))


def a24_refine_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many artifacts a refinement sees, finds doubled, merges, skips and adds."""
    d = F.col("decision")
    return decisions(concept_artifacts(spark, sf_dir), CONCEPTS).agg(
        F.count("*").alias("total"), F.count_if(d != "add").alias("duplicates_found"), F.count_if(d == "merge").alias("merged"), F.count_if(d == "skip").alias("skipped"), F.count_if(d == "add").alias("added")
    )


def j14_simple_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each artifact merged into the one before it: names of the merged elements."""
    merged = F.transform(simple_merge("old", "body", "elements"), lambda x: F.get_json_object(x, "$.name"))
    return _neighbours(spark, sf_dir).select("seq", F.size(merged).alias("elements"), F.array_join(merged, "|").alias("names"))


def r04_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of each artifact that merges into an earlier one (X06: each URL once)."""
    rows = concept_artifacts(spark, sf_dir)
    merged = decisions(rows, CONCEPTS).where("decision = 'merge'").join(rows.select(F.col("seq").alias("match"), F.col("source_url").alias("old_url")), "match")
    return merged.select("seq", F.array_join(F.transform(provenance(F.col("old_url"), F.col("source_url")), lambda s: F.concat(s["role"], F.lit(" "), s["url"])), "|").alias("sources"))


def k06_saved_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File of each kind of event of a user as a refined artifact: last part of the type and a clean slug; of equal names the last one stays."""
    slug = F.regexp_replace(F.coalesce(F.concat_ws("-", F.col("event_type"), F.col("user_id") % 97), F.lit("unknown")), r"[^\p{L}\p{N}_]", "_")
    name = F.concat(F.lit("concepts_"), slug, F.lit(".json"))
    return table(spark, sf_dir, "events").groupBy(name.alias("file_name")).agg(F.max("event_id").alias("event_id"))


QUERIES = {q.__name__: q for q in (p04_path_values, a16_field_overlap, a17_increments, r05_preview, r03_decisions, a24_refine_counters, j14_simple_merge, r04_provenance, k06_saved_names)}
_SETS = "WITH " + CONCEPTS_SQL + """, k AS (SELECT *, list_sort(list_distinct(list_filter(ids, lambda x: x NOT IN ('', '0', 'false')))) AS i, list_sort(list_distinct(list_filter(list_transform(names, lambda x: lower(x)), lambda x: x NOT IN ('', '0', 'false')))) AS m FROM a),
  p AS (SELECT x.seq, y.seq AS match, x.url, y.url AS old_url, x.description, y.description AS old, x.i, x.m, y.i AS oi, y.m AS om, x.names, y.names AS old_names, x.ids, y.ids AS old_ids,
    CASE WHEN len(x.i) + len(y.i) > 0 THEN 1 ELSE 0 END AS n1, CASE WHEN len(x.m) + len(y.m) > 0 THEN 1 ELSE 0 END AS n2 FROM k x JOIN k y ON y.seq < x.seq),
  o AS (SELECT *, CASE WHEN n1 + n2 = 0 THEN 0.0::DOUBLE ELSE (coalesce(len(list_intersect(i, oi)) / nullif(len(list_distinct(list_concat(i, oi))), 0)::DOUBLE, 0) + coalesce(len(list_intersect(m, om)) / nullif(len(list_distinct(list_concat(m, om))), 0)::DOUBLE, 0)) / (n1 + n2) END AS overlap FROM p),
  d AS (SELECT *, list_sort(list_concat(list_transform(list_filter(i, lambda x: NOT list_contains(oi, x)), lambda x: 'elements[].id=' || x), list_transform(list_filter(m, lambda x: NOT list_contains(om, x)), lambda x: 'elements[].name=' || x))) AS added,
    length(description) > length(old) * 1.2 AS longer FROM o),
  b AS (SELECT * FROM d WHERE overlap >= 0.6 QUALIFY row_number() OVER (PARTITION BY seq ORDER BY overlap DESC, match) = 1),
  r AS (SELECT a.seq, b.match, b.added, b.longer, b.url, b.old_url, CASE WHEN b.match IS NULL THEN 'add' WHEN len(b.added) > 0 OR b.longer THEN 'merge' ELSE 'skip' END AS decision FROM a LEFT JOIN b USING (seq))"""
ORACLES = {
    "p04_path_values": "WITH " + CONCEPTS_SQL + " SELECT seq, array_to_string(ids, '|') AS ids, description, 'source_url|number' AS meta_keys, url || '|' || seq AS meta FROM a",
    "a16_field_overlap": _SETS + " SELECT seq, round(overlap, 6) AS overlap FROM o WHERE match = seq - 1",
    "a17_increments": _SETS + " SELECT seq, array_to_string(added, '|') AS added, CASE WHEN longer THEN 'description' ELSE '' END AS enriched, len(added) > 0 OR longer AS has_increment FROM d WHERE match = seq - 1",
    "r05_preview": _SETS + " SELECT seq, match, round(overlap, 6) AS overlap FROM b",
    "r03_decisions": _SETS + " SELECT seq, match, array_to_string(added, '|') AS added, CASE WHEN longer THEN 1 ELSE 0 END AS enriched, decision FROM r",
    "a24_refine_counters": _SETS + " SELECT count(*) AS total, count(*) FILTER (decision <> 'add') AS duplicates_found, count(*) FILTER (decision = 'merge') AS merged, count(*) FILTER (decision = 'skip') AS skipped, count(*) FILTER (decision = 'add') AS added FROM r",
    "j14_simple_merge": _SETS + """, z AS (SELECT seq, list_concat(old_names, list_transform(list_filter(list_zip(ids, names), lambda x: NOT list_contains(old_ids, x[1])), lambda x: x[2])) AS z FROM d WHERE match = seq - 1)
      SELECT seq, CAST(len(z) AS INTEGER) AS elements, array_to_string(z, '|') AS names FROM z""",
    "r04_provenance": _SETS + " SELECT seq, 'existing ' || old_url || CASE WHEN url <> old_url THEN '|new ' || url ELSE '' END AS sources FROM r WHERE decision = 'merge'",
    "k06_saved_names": "SELECT 'concepts_' || event_type || '_' || user_id % 97 || '.json' AS file_name, max(event_id) AS event_id FROM events GROUP BY 1",
}
