from quillon.operators import operons, relational
from quillon.plans.service import Service


def test_requests(spark, tmp_path):
    for name, text in (("a.ent", "x/1-3/1\ny/2-4/1\n"), ("b.ent", "y/2-4/1\n")):
        (tmp_path / name).write_text(text)
    s = Service(spark, {"genomes": spark.createDataFrame([("y", "AACCGG")], "name string, seq string")})
    a, b = (str(tmp_path / n) for n in ("a.ent", "b.ent"))
    assert [r["name"] for r in s.ask("entry-setop", "difference", a, b).collect()] == ["x"]
    assert [r["seq"] for r in s.ask("name-seqs", b).collect()] == ["ACC"]
    assert s.ask("nothing")["error"] == "unknown request" and s.ask("entry-setop", "join", a, b)["error"] == "KeyError"
    job = s.ask("run-config", "Cluster: k 3\n", "me", {"cluster": (lambda: 7, []), "sccs": (lambda: 8, ["cluster"])})
    assert s.jobs.result(job, "cluster") == 7 and s.ask("check-job", job) == "done"


def test_operon_regions(spark):
    genes = spark.createDataFrame([("g", 1, 100, 200, 1), ("g", 1, 210, 300, 1), ("g", 2, 500, 600, -1)], "name string, operon_id long, start_pos long, end_pos long, strand int")
    hits = spark.createDataFrame([("g", 1, 400), ("g", -1, 450), ("h", 1, 100)], "name string, strand int, at long")
    got = {(r["name"], r["strand"]): (r["region_start"], r["region_end"]) for r in operons.hit_regions(hits, genes).collect()}
    assert got == {("g", 1): (301, 425), ("g", -1): (425, 499), ("h", 1): (1, 125)}
    assert {(r["strand"], r["id"]): r["genes"] for r in operons.gene_lists(genes).collect()} == {(1, 1): [[100, 200], [210, 300]], (-1, -2): [[500, 600]]}
    assert [r["start_pos"] for r in operons.downstream_genes(spark.createDataFrame([("g", 1, 50)], hits.schema), genes).collect()] == [210]


def test_catalogue_queries(spark):
    taxon = spark.createDataFrame([(1, 10, "root", 1, 8), (2, 20, "genus", 2, 5), (3, 30, "species", 3, 4), (4, 40, "genus", 6, 7)], "taxon_id long, ncbi_taxon_id long, node_rank string, left_value long, right_value long")
    bioentry = spark.createDataFrame([(1, "NC_1", "chromosome", 3), (2, "NC_2", "a plasmid", 3), (3, "NZ_3", "x", 4)], "bioentry_id long, name string, description string, taxon_id long")
    ancestor = spark.createDataFrame([(30, "Bacteria, Firmicutes, Bacillus"), (40, "Bacteria, Other")], "ncbi_taxon_id long, ancestors string")
    names = spark.createDataFrame([(2, "Bacillus", "scientific name"), (3, "bacillus subtilis", "scientific name")], "taxon_id long, name string, name_class string")
    root = relational.taxon_root(names, "Bacillus")
    assert sorted(r["taxon_id"] for r in relational.taxon_subtree(taxon, root).collect()) == [2, 3]
    assert [r["taxon_id"] for r in relational.taxon_subtree(taxon, root, leaves=True).collect()] == [3]
    assert {r["rank_taxon"]: r["names"] for r in relational.genomes_by_rank(taxon, bioentry, "genus").collect()} == {2: ["NC_1", "NC_2"], 4: ["NZ_3"]}
    assert relational.count_genomes(bioentry, taxon, ancestor, "Firmicutes").first()["genomes"] == 1
    hits = spark.createDataFrame([("L20", "NC_1")], "rna string, name string")
    genomes = spark.createDataFrame([("NC_1", "Bacilli"), ("NC_2", "Bacilli")], "name string, taxon string")
    rows = relational.rna_by_taxon(hits, genomes, spark.createDataFrame([("L20",), ("L21",)], "rna string"), spark.createDataFrame([("Bacilli",), ("None",)], "taxon string")).collect()
    assert {(r["rna"], r["taxon"]): (r["n"], r["total"], r["pct"]) for r in rows} == {("L20", "Bacilli"): (1, 2, 50.0), ("L21", "Bacilli"): (0, 2, 0.0)}
