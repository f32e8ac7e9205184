"""Relational helpers of the query layer: nested records, grouped names, shares, stratified samples, nested sets, and the catalogue queries over the BioSQL tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Qualifier terms left out of feature records.
HIDDEN_TERMS = (255, 256, 262)
FLANK = 5000


def nested_records(df: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One row for each key with its sorted records."""
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("records"))


def joined_values(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Values of each key, in order, joined by a comma."""
    return df.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(value)), lambda v: v.cast("string")), ", ").alias(name))


def merged_values(df: DataFrame, keys: Sequence[str], name: str, value: str, repeated: Sequence[str] = ("strand", "length", "name")) -> DataFrame:
    """(keys, name, values): every value for the repeated names, distinct ones for the others."""
    both = df.groupBy(*keys, name).agg(F.sort_array(F.collect_list(value)).alias("_all"))
    return both.select(*keys, name, F.when(F.col(name).isin(*repeated), F.col("_all")).otherwise(F.array_distinct("_all")).alias("values"))


def counts_with_share(df: DataFrame, outer: Sequence[str], inner: Sequence[str]) -> DataFrame:
    counts = df.groupBy(*outer, *inner).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(*outer)))


def matched_names(df: DataFrame, name: str, match: str) -> DataFrame:
    """(name, matches): all names that share a match with each, itself included."""
    sets = df.select(name, match).distinct()
    other = sets.select(F.col(name).alias("_other"), match)
    return sets.join(other, match).groupBy(name).agg(F.sort_array(F.collect_set("_other")).alias("matches"))


def class_pairs(df: DataFrame, block: Sequence[str], key: str, value: str, ordered: bool = False) -> DataFrame:
    """(kind, i, j, a, b): every pair of a block's keys, with copies given once.

    Rows of a block with an equal value (nulls are equal) form a class, named by its least key. A `member` row leads from each key i to its class j,
    with that value as both a and b; a `pair` row has two classes i < j of a block and their values, or both orders of them if `ordered`. What holds for
    keys x and y of a block is what the row of their classes says, or the member row if they are copies. Rows with a null key or block pair with none and are left out.
    """
    rows = df.select(*block, F.col(key).alias("i"), F.col(value).alias("a")).dropna(subset=[*block, "i"])
    classes = rows.groupBy(*block, "a").agg(F.min("i").alias("j"))
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in block]
    member = rows.alias("x").join(classes.alias("y"), [*same, F.col("x.a").eqNullSafe(F.col("y.a"))]).select(F.lit("member").alias("kind"), "x.i", "y.j", "x.a", F.col("y.a").alias("b"))
    apart = F.col("x.j") != F.col("y.j") if ordered else F.col("x.j") < F.col("y.j")
    pair = classes.alias("x").join(classes.alias("y"), [*same, apart]).select(F.lit("pair").alias("kind"), F.col("x.j").alias("i"), "y.j", "x.a", F.col("y.a").alias("b"))
    return member.unionByName(pair)


def stratified_sample(df: DataFrame, strata: Sequence[str], k: int, seed: int, key: str) -> DataFrame:
    """k rows of each stratum: those of least seeded hash of their key, so a rerun draws the same."""
    w = Window.partitionBy(*strata).orderBy(F.xxhash64(F.lit(seed), key), key)
    return df.withColumn("_nth", F.row_number().over(w)).filter(F.col("_nth") <= k).drop("_nth")


def nested_set(region: DataFrame, nation: DataFrame, customer: DataFrame) -> DataFrame:
    """(node, kind, key, left_value, right_value) of the region / nation / customer hierarchy; childless nations and regions are left out.

    Boundaries follow from ranks: a leaf takes two numbers, so with k leaves and m nations before it, its left is 2k + 2m + region openings.
    """
    c = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("r"), F.col("c_nationkey").alias("n"), F.col("c_custkey").alias("c"))
    sizes = c.groupBy("r", "n").agg(F.count("*").alias("size"))
    w = Window.orderBy("r", "n")  # one row for each nation
    per = sizes.withColumn("before", F.sum("size").over(w) - F.col("size")).withColumn("nth", F.row_number().over(w) - 1).withColumn("region", F.dense_rank().over(Window.orderBy("r")) - 1)
    left_n = 2 * F.col("before") + 2 * F.col("nth") + 2 * F.col("region") + 1
    nations = per.select("r", "n", "size", left_n.alias("lo"), (left_n + 2 * F.col("size") + 1).alias("hi"))
    leaf = c.withColumn("k", F.row_number().over(Window.partitionBy("r", "n").orderBy("c")) - 1).join(nations, ["r", "n"])
    rows = leaf.select(F.concat(F.lit("c"), "c").alias("node"), F.lit("customer").alias("kind"), F.col("c").cast("long").alias("key"), (F.col("lo") + 1 + 2 * F.col("k")).alias("left_value"), (F.col("lo") + 2 + 2 * F.col("k")).alias("right_value"))
    rows = rows.union(nations.select(F.concat(F.lit("n"), "n"), F.lit("nation"), F.col("n").cast("long"), "lo", "hi"))
    return rows.union(nations.groupBy("r").agg((F.min("lo") - 1).alias("lo"), (F.max("hi") + 1).alias("hi")).select(F.concat(F.lit("r"), "r"), F.lit("region"), F.col("r").cast("long"), "lo", "hi"))


def operons_within(bioentry: DataFrame, operon: DataFrame, operon_loc: DataFrame, name: str, start: int = 1, end: int = 100_000_000) -> DataFrame:
    """Operon locations of an entry within a range, forward in length, by start."""
    rows = bioentry.filter(F.col("name") == name).select("bioentry_id").join(operon, "bioentry_id").join(operon_loc.filter(F.col("start_pos").between(start, end) & F.col("end_pos").between(start, end)), "operon_id")
    return rows.filter("end_pos - start_pos > 0").orderBy("start_pos", "operon_id")


def features(bioentry: DataFrame, seqfeature: DataFrame, qualifiers: DataFrame, term: DataFrame, locations: DataFrame | None = None, where: Column | None = None) -> DataFrame:
    """(seqfeature_id, sftype, locs, nvs): nested feature records of the entries that meet a condition."""
    kinds = term.select(F.col("term_id").alias("type_term_id"), F.col("name").alias("sftype"))
    f = (bioentry if where is None else bioentry.filter(where)).select("bioentry_id").join(seqfeature, "bioentry_id").join(kinds, "type_term_id")
    nvs = qualifiers.filter(~F.col("term_id").isin(*HIDDEN_TERMS)).join(term.select("term_id", "name"), "term_id").groupBy("seqfeature_id").agg(F.sort_array(F.collect_list(F.struct("name", "value"))).alias("nvs"))
    out = f.join(nvs, "seqfeature_id", "left")
    if locations is not None:
        locs = locations.groupBy("seqfeature_id").agg(F.sort_array(F.collect_list(F.struct(F.col("start_pos").alias("start"), F.col("end_pos").alias("end"), "strand", (F.col("end_pos") - F.col("start_pos") + 1).alias("len")))).alias("locs"))
        out = out.join(locs, "seqfeature_id", "left")
    return out


def hit_features(hits: DataFrame, feature_locations: DataFrame, flank: int = FLANK) -> DataFrame:
    """Features wholly within each hit's range widened by flank, per genome `name`; sorted by type within a hit."""
    from .intervals import containment_join

    wide = hits.withColumn("from", F.greatest(F.lit(1), F.col("start") - flank)).withColumn("to", F.col("end") + flank).withColumnRenamed("start", "hit_start").withColumnRenamed("end", "hit_end")
    return containment_join(feature_locations, wide, ["name"], 2 * flank)


def base_info(names: DataFrame, bioentry: DataFrame, taxon: DataFrame, taxon_name: DataFrame, ancestor: DataFrame) -> DataFrame:
    """Entry, scientific name and lineage of each distinct name; names without an entry stay, with nulls."""
    t = taxon.join(taxon_name.filter("name_class = 'scientific name'").select("taxon_id", F.col("name").alias("taxon")), "taxon_id").join(ancestor, "ncbi_taxon_id", "left")
    return names.select("name").distinct().join(bioentry.join(t, "taxon_id"), "name", "left")


def names_to_lineage(names: DataFrame, bioentry: DataFrame, taxon: DataFrame, ancestor: DataFrame) -> DataFrame:
    return names.select("name").distinct().join(bioentry.select("name", "taxon_id"), "name").join(taxon.select("taxon_id", "ncbi_taxon_id"), "taxon_id").join(ancestor, "ncbi_taxon_id").select("name", "ancestors")


def taxon_root(taxon_name: DataFrame, name: str) -> DataFrame:
    """The least taxon id whose name begins with a term, the case of its first letter aside."""
    pattern = f"^[{name[0].lower()}{name[0].upper()}]" + name[1:]
    return taxon_name.filter(F.col("name").rlike(pattern)).agg(F.min("taxon_id").alias("taxon_id"))


def taxon_subtree(taxon: DataFrame, root: DataFrame, leaves: bool = False) -> DataFrame:
    """Nodes below one root row: its two boundaries join as one broadcast row."""
    span = taxon.join(root, "taxon_id").select(F.col("left_value").alias("_lo"), F.col("right_value").alias("_hi"))
    rows = taxon.join(F.broadcast(span), F.col("left_value").between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")  # one root
    return rows.filter("left_value + 1 = right_value") if leaves else rows


def genomes_by_rank(taxon: DataFrame, bioentry: DataFrame, rank: str) -> DataFrame:
    """(rank_taxon, names): entries at the leaves below each node of a rank, by walking parents from the nested set."""
    from .intervals import descendants

    nodes = taxon.withColumnRenamed("taxon_id", "node")
    below = descendants(nodes, nodes.filter(F.col("node_rank") == rank).select("node"))
    leaf = nodes.filter("left_value + 1 = right_value").select("node")
    rows = below.join(leaf, "node").join(bioentry.select(F.col("taxon_id").alias("node"), "name"), "node")
    return rows.groupBy(F.col("root").alias("rank_taxon")).agg(F.sort_array(F.collect_set("name")).alias("names"))


def count_genomes(bioentry: DataFrame, taxon: DataFrame, ancestor: DataFrame, lineage: str) -> DataFrame:
    """Distinct taxa of complete chromosomes (NC names, no plasmids) whose lineage has a taxon."""
    rows = bioentry.filter(F.col("name").rlike("^NC") & ~F.lower("description").rlike("plasmid")).join(taxon, "taxon_id").join(ancestor.filter(F.col("ancestors").rlike(f", {lineage}")), "ncbi_taxon_id")
    return rows.agg(F.countDistinct("taxon_id").alias("genomes"))


def rna_by_taxon(hits: DataFrame, genomes: DataFrame, rnas: DataFrame, taxa: DataFrame) -> DataFrame:
    """(rna, taxon, n, total, pct, names) for every asked pair with genomes: hits (rna, name), genomes (name, taxon); the asked lists are short by nature."""
    total = genomes.groupBy("taxon").agg(F.countDistinct("name").alias("total"))
    found = hits.join(genomes, "name").groupBy("rna", "taxon").agg(F.countDistinct("name").alias("n"), F.sort_array(F.collect_set("name")).alias("names"))
    asked = taxa.select("taxon").distinct().withColumn("rna", F.explode(F.array(*[F.lit(r["rna"]) for r in rnas.select("rna").distinct().orderBy("rna").collect()])))
    rows = asked.join(total, "taxon").join(found, ["rna", "taxon"], "left").filter("total > 0")
    return rows.select("rna", "taxon", F.coalesce("n", F.lit(0)).alias("n"), "total", (100.0 * F.coalesce("n", F.lit(0)) / F.col("total")).alias("pct"), "names")
