"""Controlled vocabulary, canonical ids, alignment, shapes and resolution checks as joins.

Vocabularies are dimensions: (id, label, alt_labels). They may be of any size;
whether one is broadcast is left to the planner, which knows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.text import canonical_urn, norm_label


def label_index(terms: DataFrame) -> DataFrame:
    """(key, id, label): every label and alternative label, normalised; of several terms with one key the least id."""
    labels = F.explode(F.array_distinct(F.concat(F.array("label"), F.coalesce("alt_labels", F.array().cast("array<string>")))))
    rows = terms.select("id", "label", labels.alias("surface")).select(norm_label(F.col("surface")).alias("key"), "id", "label")
    return rows.groupBy("key").agg(F.min(F.struct("id", "label")).alias("t")).select("key", "t.id", "t.label")


def label_conflicts(terms: DataFrame) -> DataFrame:
    """(kind, value): ids given twice and keys that name more than one id."""
    ids = terms.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit("duplicate id").alias("kind"), F.col("id").cast("string").alias("value"))
    labels = F.explode(F.concat(F.array("label"), F.coalesce("alt_labels", F.array().cast("array<string>"))))
    keys = terms.select("id", labels.alias("s")).groupBy(norm_label(F.col("s")).alias("value")).agg(F.countDistinct("id").alias("n")).filter("n > 1")
    return ids.unionByName(keys.select(F.lit("ambiguous label").alias("kind"), "value"))


def resolve(rows: DataFrame, column: str, terms: DataFrame, out: str) -> DataFrame:
    """Adds ``out``_id and ``out``_label of the term that the surface in ``column`` names, else nulls."""
    index = label_index(terms).select(F.col("key").alias("__gl_key"), F.col("id").alias(f"{out}_id"), F.col("label").alias(f"{out}_label"))
    return rows.withColumn("__gl_key", norm_label(F.col(column))).join(index, "__gl_key", "left").drop("__gl_key")


def normalize_entities(entities: DataFrame, types: DataFrame, concepts: DataFrame) -> DataFrame:
    """entities (raw_type, raw_label, …) with type_id, concept_id, preferred label, and ``reasons``: empty for those accepted."""
    rows = resolve(resolve(entities, "raw_type", types, "type"), "raw_label", concepts, "concept")
    reasons = F.array_compact(F.array(F.when(F.col("type_id").isNull(), F.lit("type")), F.when(F.col("concept_id").isNull(), F.lit("label"))))
    return rows.withColumn("reasons", reasons)


def issue_ids(concepts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(registry: concept_id, canonical_id, label; URNs issued more than once)."""
    registry = concepts.select(F.col("id").alias("concept_id"), canonical_urn(F.col("label")).alias("canonical_id"), "label")
    return registry, registry.groupBy("canonical_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def merge_raw_nodes(nodes: DataFrame, concepts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(canonical nodes: canonical_id, concept_id, label, aliases by raw_id, merged_count; unresolved rows).

    nodes has raw_id, surface, raw_type, source_doc. Aliases are gathered per
    concept; merged counts and unresolved rows add up to the input.
    """
    rows = resolve(nodes, "surface", concepts, "concept")
    alias = F.struct("raw_id", "surface", "raw_type", "source_doc")
    merged = rows.filter("concept_id is not null").groupBy("concept_id", F.col("concept_label").alias("label")).agg(F.sort_array(F.collect_list(alias)).alias("aliases"), F.count(F.lit(1)).alias("merged_count"))
    return merged.withColumn("canonical_id", canonical_urn(F.col("label"))), rows.filter("concept_id is null").select("raw_id", "surface", "raw_type", "source_doc")


def alignment_problems(mappings: DataFrame, concepts: DataFrame, kbs: DataFrame) -> DataFrame:
    """(kind, internal, kb): mappings to unknown concepts or bases, and more than one exact match of a concept in a base."""
    lost = mappings.join(concepts.select(F.col("id").alias("internal")), "internal", "left_anti").select(F.lit("unknown concept").alias("kind"), "internal", "kb")
    base = mappings.join(kbs.select("kb"), "kb", "left_anti").select(F.lit("unknown base").alias("kind"), "internal", "kb")
    twice = mappings.filter("match = 'exact'").groupBy("internal", "kb").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit("several exact").alias("kind"), "internal", "kb")
    return lost.unionByName(base).unionByName(twice)


def external_url(template: Column, external_id: Column) -> Column:
    """The template with ``{id}`` replaced; without a template the id itself."""
    return F.when(template.isNull(), external_id).otherwise(F.replace(template, F.lit("{id}"), external_id))


def misjoined(merge_map: DataFrame, guarded: list[str]) -> DataFrame:
    """Targets that more than one guarded name maps to: name -> target must keep them apart."""
    return merge_map.filter(F.col("name").isin(guarded)).groupBy("target").agg(F.countDistinct("name").alias("n")).filter("n > 1")


def not_fixpoints(merge_map: DataFrame) -> DataFrame:
    """Rows of a merge map whose target is itself mapped elsewhere."""
    onward = merge_map.select(F.col("name").alias("target"), F.col("target").alias("onward"))
    return merge_map.join(onward, "target").filter("onward <> target").select("name", "target", "onward")


def coreferences(entities: DataFrame) -> DataFrame:
    """(first, id): mentions equal in source, normalised name and type, each paired with the first of them."""
    rows = entities.select("id", "source_id", norm_label(F.col("name")).alias("key"), "type")
    first = rows.groupBy("source_id", "key", "type").agg(F.min("id").alias("first"))
    return rows.join(first, ["source_id", "key", "type"]).filter("id <> first").select("first", "id")


def substring_trap(a: Column, b: Column) -> Column:
    """Whether the shorter name stands in the longer one as one of its words, or glued into one: such names are different things."""
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    words = F.split(long, " ")
    inside = F.array_contains(words, short)
    return (short != long) & ((~short.contains(" ") & inside & (F.size(words) > 1)) | (long.contains(short) & ~inside))


def mock_embedding(text: Column) -> Column:
    """64 values from the SHA-256 digests of the trimmed lower-case text with ``#0`` and ``#1``, scaled to -1..1 and unit length."""
    norm = F.lower(F.trim(text))
    digits = F.concat(F.sha2(F.concat(norm, F.lit("#0")), 256), F.sha2(F.concat(norm, F.lit("#1")), 256))
    raw = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.conv(F.substring(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("double") / 255.0 * 2.0 - 1.0)
    return F.transform(F.arrays_zip(raw.alias("v"), F.array_repeat(F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, v: s + v * v)), 64).alias("n")), lambda x: F.when(x["n"] == 0, x["v"]).otherwise(x["v"] / x["n"]))


def _violation(rule: str, path: str):
    return lambda problem: F.struct(F.lit(rule).alias("rule_id"), F.lit(path).alias("path"), problem.alias("problem"))


def node_violations(nodes: DataFrame, shapes: list[dict]) -> DataFrame:
    """(node_id, rule_id, path, problem) by node shapes: {id, target_class, properties: [{path, min_count, datatype, pattern, in}]}.

    A missing required property ends the checks of that property; a missing
    optional one skips them; else datatype, pattern (from the start) and closed
    set may all fail. nodes has node_id, label and the properties as strings.
    """
    found = []
    for shape in shapes:
        target = F.lit(True) if shape["target_class"] == "*" else F.col("label") == shape["target_class"]
        for prop in shape["properties"]:
            value = F.col(prop["path"])
            present = value.isNotNull() & (value != "")
            tests = []
            if prop.get("datatype") == "int":
                tests.append(("datatype", value.try_cast("long").isNull()))
            if prop.get("pattern"):
                tests.append(("pattern", ~value.rlike("^(?:" + prop["pattern"] + ")")))
            if prop.get("in"):
                tests.append(("in", ~value.isin(prop["in"])))
            problems = F.array(*([F.when(~present, F.lit("missing"))] if prop.get("min_count", 0) >= 1 else []), *[F.when(present & bad, F.lit(name)) for name, bad in tests], F.lit(None).cast("string"))
            found.append(F.when(target, F.transform(F.array_compact(problems), _violation(shape["id"], prop["path"]))))
    every = F.flatten(F.array(*[F.coalesce(x, F.array().cast("array<struct<rule_id:string,path:string,problem:string>>")) for x in found]))
    return nodes.select("node_id", F.explode(every).alias("v")).select("node_id", "v.rule_id", "v.path", "v.problem")


def narrower(concepts: DataFrame) -> DataFrame:
    """(id, narrower): direct children of every concept that has some, sorted; concepts has id and broader."""
    return concepts.filter("broader is not null").groupBy(F.col("broader").alias("id")).agg(F.sort_array(F.collect_list("id")).alias("narrower"))


def skos_triples(concepts: DataFrame) -> DataFrame:
    """(s, p, o) of concepts (id, label, alt_labels, broader)."""
    t = lambda p, o, rows=concepts: rows.select(F.col("id").cast("string").alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o")).filter("o is not null")
    alt = concepts.select("id", F.explode("alt_labels").alias("a"))
    down = concepts.filter("broader is not null").select(F.col("broader").alias("id"), F.col("id").alias("child"))
    return t("rdf:type", F.lit("skos:Concept")).unionByName(t("skos:prefLabel", F.col("label"))).unionByName(t("skos:broader", F.col("broader"))).unionByName(t("skos:altLabel", F.col("a"), alt)).unionByName(t("skos:narrower", F.col("child"), down))


def rdfs_triples(classes: DataFrame, properties: DataFrame) -> DataFrame:
    """(s, p, o) of classes (id, parent) and properties (id, domain, range)."""
    t = lambda rows, p, o: rows.select(F.col("id").cast("string").alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o")).filter("o is not null")
    out = t(classes, "rdf:type", F.lit("rdfs:Class")).unionByName(t(classes, "rdfs:subClassOf", F.col("parent")))
    return out.unionByName(t(properties, "rdf:type", F.lit("rdf:Property"))).unionByName(t(properties, "rdfs:domain", F.col("domain"))).unionByName(t(properties, "rdfs:range", F.col("range")))


def best_candidate(mentions: DataFrame, candidates: DataFrame) -> DataFrame:
    """(mention, name, score): of each mention's candidates (mention, name) the one whose stand-in embedding is nearest, at ties the least name."""
    unit = candidates.select("mention", "name", mock_embedding(F.col("mention")).alias("a"), mock_embedding(F.col("name")).alias("b"))
    score = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    ranked = unit.join(mentions.select("mention").distinct(), "mention").select("mention", "name", F.round(score, 6).alias("score"))
    return ranked.withColumn("r", F.row_number().over(Window.partitionBy("mention").orderBy(F.desc("score"), "name"))).filter("r = 1").drop("r")
