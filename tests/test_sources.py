from quillon.sources import hits, sequences

STO = "# STOCKHOLM 1.0\n#=GF AU me\n\nNC_1/1-8/1   ACGU-CGU\nNC_2/5-9/1   ACG..CGA\n#=GC SS_cons <<....>>\n\nNC_1/1-8/1   AA\nNC_2/5-9/1   CC\n#=GC SS_cons ..\n//\n"


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fna").write_text(">x one\nACGU\nAC\n\n>gi|1|ref|NC_000913.2|\nGG\n>y\n")
    rows = {r["name"]: r["seq"] for r in sequences.read_sequences(spark, str(tmp_path / "a.fna")).collect()}
    assert rows == {"x": "ACGUAC", "gi|1|ref|NC_000913.2|": "GG", "y": ""}
    assert [r["name"] for r in sequences.ncbi_fasta(sequences.read_fasta(spark, str(tmp_path / "a.fna"))).collect()] == ["NC_000913"]
    sequences.write_fasta(sequences.read_fasta(spark, str(tmp_path / "a.fna")), str(tmp_path / "out"))
    assert {r["name"]: r["seq"] for r in sequences.read_fasta(spark, str(tmp_path / "out")).collect()} == rows


def test_stockholm_round_trip(spark, tmp_path):
    (tmp_path / "s.sto").write_text(STO)
    rows = sequences.read_stockholm(spark, str(tmp_path / "s.sto"))
    got = {r["name"]: r["seq"] for r in rows.collect()}
    assert got == {"NC_1/1-8/1": "ACGU-CGUAA", "NC_2/5-9/1": "ACG..CGACC"}
    assert sequences.consensus(spark, str(tmp_path / "s.sto")).first()["seq"] == "<<....>>.."
    assert sequences.check_stockholm(spark, str(tmp_path / "s.sto")).count() == 0
    sequences.write_stockholm(rows, str(tmp_path / "out"), ss_cons="<<....>>..")
    again = {r["name"]: r["seq"] for r in sequences.read_stockholm(spark, str(tmp_path / "out")).collect()}
    assert again == {k: v.replace("-", ".") for k, v in got.items()}
    for block in (None, 4):
        sequences.write_clustal(rows, str(tmp_path / "aln"), block)
        assert {r["name"]: r["seq"] for r in sequences.read_clustal(spark, str(tmp_path / "aln")).collect()} == {k: v.replace(".", "-") for k, v in got.items()}
    assert {r["name"] for r in sequences.read_directory(spark, str(tmp_path)).collect()} == set(got)


def test_check_finds_faults(spark, tmp_path):
    (tmp_path / "b.sto").write_text("# STOCKHOLM 1.0\nnoentry ACG!\nN/1-3/1 AC\n#=GC SS_cons ....\n//\n")
    faults = {r["problem"]: r["names"] for r in sequences.check_stockholm(spark, str(tmp_path / "b.sto")).collect()}
    assert faults == {"invalid sequence characters": ["noentry"], "invalid entry": ["noentry"], "length differs from consensus": ["N/1-3/1"]}


def test_entries(spark, tmp_path):
    (tmp_path / "e.ent").write_text("NC_1/5-9/1, 0.5\n# note\nNC_2/9-3\n")
    rows = sequences.read_entries(spark, str(tmp_path / "e.ent"))
    assert sorted((r["name"], r["start"], r["end"], r["strand"], r["score"]) for r in rows.collect()) == [("NC_1", 5, 9, "1", 0.5), ("NC_2", 3, 9, "-1", None)]
    sequences.write_entries(rows, str(tmp_path / "o"), ["score"])
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "o")).collect()) == ["NC_1/5-9/1, 0.5", "NC_2/3-9/-1"]


def test_operons_and_taxonomy(spark, tmp_path):
    (tmp_path / "o.opr").write_text("h\th\th\nNC_1\t1\t5..90\t+\tx\tP1\ta\tb\tc\tCOG1\nshort\t2\n")
    r = hits.read_operons(spark, str(tmp_path / "o.opr")).first()
    assert (r["name"], r["operon_id"], r["start_pos"], r["end_pos"], r["strand"], r["cog"]) == ("NC_1", 1, 5, 90, 1, "COG1")
    (tmp_path / "nodes.dmp").write_text("1\t|\t1\t|\tno rank\t|\n2\t|\t1\t|\tgenus\t|\n")
    assert [(r["id"], r["parent_id"]) for r in hits.read_taxonomy_nodes(spark, str(tmp_path / "nodes.dmp")).collect()] == [(1, 1), (2, 1)]


def test_reports():
    table = "# INFERNAL 1.1\n# query CM file: a.cm\n# target database: g.fna\n rank E bits\n ---- ---\n (1) ! 1e-5 30.0 0.1 NC_1 10 50 + cm no 0.45 -\n\n"
    got = list(hits.parse_report(table))
    assert got[0]["entry"] == "NC_1" and got[0]["evalue"] == 1e-5 and got[0]["strand"] == 1 and got[0]["gc"] == 0.45
    blocks = "# command cmsearch a.cm g.fna\n>NC_2\n  Plus strand results:\n Query = 1 - 9, Target = 5 - 13\n Score = 12.5, E = 0.01, P = 0.001, GC = 40\n\n <<..>>\n 1 ACG 3\n ...\n 5 ACG 7\n"
    got = list(hits.parse_report(blocks))
    assert got[0]["entry"] == "NC_2" and (got[0]["start"], got[0]["end"], got[0]["score"]) == (5, 13, 12.5) and got[0]["structure"] == "<<..>>"
