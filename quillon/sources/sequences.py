"""FASTA, Stockholm, Clustal and entry files.

FASTA is read by record separator, so a file of any size splits over tasks. Alignments are files of bounded size by nature and are read whole,
one row each, then exploded into lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.coords import entry_parts


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value), line_no from 0."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "value"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, description, seq); wrapped sequences are joined. Blank and # lines inside a record are dropped; records without a name are skipped."""
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "^>", "").alias("value"))
    parts = F.split("value", r"\r?\n")
    body = F.filter(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda x: (F.trim(x) != "") & ~x.startswith("#"))
    head = F.trim(parts[0])
    out = rows.select("file", F.split(head, r"\s+")[0].alias("name"), head.alias("description"), F.array_join(F.transform(body, lambda x: F.trim(x)), "").alias("seq"))
    return out.filter("name <> ''")


def ncbi_fasta(fasta: DataFrame) -> DataFrame:
    """Records of `gi|..|..|NC_x.v|` headers, complete chromosomes only, named by accession without version."""
    accession = F.get(F.split("name", r"\|"), 3)
    return fasta.withColumn("name", F.regexp_replace(accession, r"\.[0-9]+$", "")).filter(F.col("name").rlike("^NC_"))


def read_stockholm(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, name, seq): the sequences of Stockholm files, blocks of one name joined in order."""
    rows = lines(spark, path).filter((F.trim("value") != "") & ~F.col("value").startswith("#") & ~F.col("value").startswith("//"))
    return _joined(rows, F.regexp_extract("value", r"^(\S+)\s+(\S+)", 1), F.regexp_extract("value", r"^(\S+)\s+(\S+)", 2))


def read_clustal(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, name, seq): Clustal files, blocks joined, conservation lines and banner dropped."""
    rows = lines(spark, path).filter((F.trim("value") != "") & ~F.upper("value").startswith("CLUSTAL") & F.col("value").rlike(r"^\S"))
    return _joined(rows, F.regexp_extract("value", r"^(\S+)\s+(\S+)", 1), F.regexp_extract("value", r"^(\S+)\s+(\S+)", 2))


def _joined(rows: DataFrame, name: Column, chunk: Column) -> DataFrame:
    got = rows.select("file", "line_no", name.alias("name"), chunk.alias("chunk")).filter("name <> ''")
    seq = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "chunk"))), lambda s: s["chunk"]), "")
    return got.groupBy("file", "name").agg(F.min("line_no").alias("row"), seq.alias("seq")).select("file", "row", "name", "seq")


def stockholm_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, tag, key, value): GF, GC, GS and GR lines; GC chunks of one key are separate rows."""
    rows = lines(spark, path).filter(F.col("value").rlike(r"^#=G[FCSR]\s"))
    p = r"^#=(G[FCSR])\s+(\S+)\s*(.*)$"
    return rows.select("file", "line_no", *(F.regexp_extract("value", p, k).alias(n) for k, n in ((1, "tag"), (2, "key"), (3, "value"))))


def consensus(spark: SparkSession, path: str, key: str = "SS_cons") -> DataFrame:
    """(file, seq): a GC line with its blocks joined."""
    rows = stockholm_annotations(spark, path).filter((F.col("tag") == "GC") & (F.col("key") == key)).select("file", "line_no", "key", F.trim("value").alias("chunk"))
    return rows.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "chunk"))), lambda s: s["chunk"]), "").alias("seq"))


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, start, end, strand, score) of entry files `name/s-e/strand[, score...]`."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.split("value", r"\s*,\s*").alias("f")).filter((F.trim(F.col("f")[0]) != "") & ~F.col("f")[0].startswith("#"))
    return rows.select("file", entry_parts(F.trim(F.col("f")[0])).alias("p"), F.get("f", 1).try_cast("double").alias("score")).select("file", "p.*", "score")


_READERS = {"sto": read_stockholm, "aln": read_clustal, "ent": read_entries, "fna": read_fasta, "fa": read_fasta, "hitfna": read_fasta, "fasta": read_fasta}


def read_sequences(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """The reader for a file's extension, or a given kind."""
    kind = kind or path.rstrip("*").rpartition(".")[2]
    if kind not in _READERS:
        raise ValueError(f"no reader for {kind!r}; known: {', '.join(_READERS)}")
    return _READERS[kind](spark, path)


def read_directory(spark: SparkSession, path: str, kinds: tuple[str, ...] = ("sto",)) -> DataFrame:
    """Alignments of a folder and those below it, files with more than one sequence only; `dir` is the file's folder."""
    from pyspark.sql.window import Window

    out = None
    for kind in kinds:
        rows = _READERS[kind](spark, f"{path.rstrip("/")}/*.{kind}")
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    many = F.count("*").over(Window.partitionBy("file"))
    return out.withColumn("_n", many).filter("_n > 1").drop("_n").withColumn("dir", F.regexp_extract("file", r"([^/]+)/[^/]+$", 1))


def check_stockholm(spark: SparkSession, path: str) -> DataFrame:
    """(file, problem, names): one row for each kind of fault of each file, none for a good file.

    Faults: characters outside the alphabet, names that occur twice (seen as twice the consensus length), lengths that differ from the consensus, names that are no entry, unknown consensus characters.
    """
    seqs = read_stockholm(spark, path)
    cons = consensus(spark, path).withColumnRenamed("seq", "cons")
    rows = seqs.join(cons, "file", "left")
    n, m = F.length("seq"), F.length("cons")
    rules = {
        "invalid sequence characters": ~F.col("seq").rlike(r"^[ACGTUacgtuRYSWKMBDHVNrryswkmbdhvn.\-]+$"),
        "duplicate names": m.isNotNull() & (n >= 2 * m),
        "length differs from consensus": m.isNotNull() & (n != m) & (n < 2 * m),
        "invalid entry": ~F.col("name").rlike(r"^[^/\s]+/c?[0-9]+-[0-9]+(/-?1)?$"),
        "no consensus": m.isNull(),
        "invalid consensus characters": m.isNotNull() & ~F.col("cons").rlike(r"^[<>(){}\[\]_,:.~\-A-Za-z]*$"),
    }
    faults = F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()])
    found = rows.select("file", "name", F.explode(F.filter(faults, lambda x: x.isNotNull())).alias("problem"))
    return found.groupBy("file", "problem").agg(F.sort_array(F.collect_set("name")).alias("names"))


def write_lines(rows: DataFrame, path: str, order: list[str]) -> None:
    """One ordered text file from (order columns, value): for outputs of an alignment's size."""
    rows.coalesce(1).sortWithinPartitions(*order).select("value").write.mode("overwrite").text(path)


def write_fasta(seqs: DataFrame, path: str, name: str = "name", seq: str = "seq") -> None:
    """Records in as many files as there are partitions."""
    seqs.select(F.concat(F.lit(">"), name, F.lit("\n"), seq).alias("value")).write.mode("overwrite").text(path)


def split_fasta(seqs: DataFrame, path: str) -> None:
    """One folder for each record's name."""
    seqs.select("name", F.concat(F.lit(">"), "name", F.lit("\n"), "seq").alias("value")).write.mode("overwrite").partitionBy("name").text(path)


def write_entries(entries: DataFrame, path: str, extra: list[str] | None = None) -> None:
    """`name/s-e/strand`, with extra values after it, comma-separated."""
    from ..functions.coords import make_entry

    entry = make_entry("name", "start", "end", "strand")
    value = F.concat_ws(", ", entry, *(F.col(c).cast("string") for c in extra or []))
    entries.select(value.alias("value")).write.mode("overwrite").text(path)


def stockholm_lines(seqs: DataFrame, ss_cons: str | None = None, origin: str = "", comments: tuple[str, ...] = ()) -> DataFrame:
    """(part, row, value): a Stockholm file's lines with names padded to column 40 and one closing //."""
    spark = seqs.sparkSession
    head = ["# STOCKHOLM 1.0", *([f"#=GF AU {origin}"] if origin else []), *(f"#=GF CC {c}" for c in comments), ""]
    rows = spark.createDataFrame([(0, i, v) for i, v in enumerate(head)], "part int, row int, value string")
    body = seqs.select(F.lit(1).alias("part"), F.col("row").cast("int").alias("row"), F.concat(F.rpad("name", 40, " "), F.translate("seq", "-", ".")).alias("value"))
    tail = [(2, 0, "#=GC SS_cons".ljust(40) + ss_cons)] if ss_cons else []
    return rows.union(body).union(spark.createDataFrame([*tail, (3, 0, "//")], rows.schema))


def write_stockholm(seqs: DataFrame, path: str, **parts) -> None:
    write_lines(stockholm_lines(seqs, **parts), path, ["part", "row"])


def write_clustal(seqs: DataFrame, path: str, block: int | None = None) -> None:
    """Clustal file, `.` as `-`; in blocks of `block` characters if asked."""
    spark = seqs.sparkSession
    seq = F.translate("seq", ".", "-")
    if block:
        cut = seqs.select("row", "name", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("seq"), F.lit(block)), lambda i: F.substring(seq, i, F.lit(block)))).alias("part", "chunk"))
    else:
        cut = seqs.select("row", "name", F.lit(0).alias("part"), seq.alias("chunk"))
    rows = cut.select(F.col("part").cast("int").alias("part"), F.col("row").cast("int").alias("row"), F.concat(F.rpad("name", 40, " "), "chunk").alias("value"))
    gaps = rows.select("part", F.lit(1 << 30).alias("row"), F.lit("").alias("value")).distinct()
    write_lines(rows.union(gaps).union(spark.createDataFrame([(-1, 0, "CLUSTAL W"), (-1, 1, "")], rows.schema)), path, ["part", "row"])


def stockholm_to_fasta(seqs: DataFrame, path: str) -> None:
    write_fasta(seqs.withColumn("seq", F.translate("seq", "-.", "")), path)
