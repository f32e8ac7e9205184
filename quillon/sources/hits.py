"""Hit tables, search reports, operon and taxonomy files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.coords import make_entry
from . import schemas


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """The 15-column hit table by its fixed schema; short rows keep nulls."""
    return spark.read.schema(schemas.HIT_COLUMNS).option("header", True).option("enforceSchema", True).csv(path)


def hit_info(hits: DataFrame) -> DataFrame:
    """(name, start, end, evalue, score, status, note), by name without regard to case."""
    return hits.filter("hit_end is not null").select("name", F.col("hit_start").alias("start"), F.col("hit_end").alias("end"), "evalue", "score", F.lit("new").alias("status"), F.lit("N/A").alias("note")).orderBy(F.lower("name"), "start")


def read_legacy_hits(spark: SparkSession, path: str) -> DataFrame:
    """The same columns from the older table: fields 4, 9, 10, 24, 11, 15 and 13; status code 0 rfam, 1 overlap, 2 new."""
    f = F.split("value", ",")
    rows = spark.read.text(path).filter(F.size(f) >= 24).select(f.alias("f"))
    at = lambda k: F.trim(F.get("f", F.lit(k)))
    return rows.select(
        at(4).alias("name"), at(9).try_cast("long").alias("start"), at(10).try_cast("long").alias("end"), at(24).try_cast("double").alias("evalue"), at(11).try_cast("double").alias("score"),
        F.get(F.array(*map(F.lit, ("rfam", "overlap", "new"))), at(15).try_cast("int")).alias("status"), at(13).alias("note"),
    ).filter("start is not null and end is not null")


def new_hits(info: DataFrame) -> DataFrame:
    """Rows of status new, of complete genomes, not marked duplicate."""
    return info.filter((F.col("status") == "new") & ~F.col("name").rlike("^NZ_") & ~F.lower(F.coalesce("note", F.lit(""))).rlike("duplicate"))


def entries_as_hits(entries: DataFrame, evalue: float = 0.0) -> DataFrame:
    """Entries shaped as hit rows; start and end change places on strand -1."""
    back = F.col("strand") == "-1"
    return entries.select("name", F.when(back, F.col("end")).otherwise(F.col("start")).alias("start"), F.when(back, F.col("start")).otherwise(F.col("end")).alias("end"), F.lit(evalue).alias("evalue"), F.lit(0.0).alias("score"), F.lit("new").alias("status"), "strand")


def hits_as_entries(info: DataFrame) -> DataFrame:
    """(entry): start > end means strand -1."""
    return info.select(make_entry("name", F.least("start", "end"), F.greatest("start", "end"), F.when(F.col("start") > F.col("end"), "-1").otherwise("1")).alias("entry"))


def known_entries(entries: DataFrame, genomes: DataFrame) -> DataFrame:
    """Entries whose genome is in the catalogue."""
    return entries.join(genomes.select("name"), "name", "left_semi")


def read_search(spark: SparkSession, path: str) -> DataFrame:
    """Alignment-search CSV (format 10 columns); self-hits out, e-value below 0.5."""
    return spark.read.schema(schemas.SEARCH_COLUMNS).csv(path).filter("evalue < 0.5 and not (qseqid = sseqid and qstart = sstart and qend = send)")


def full_length(search: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad): queries (qseqid, size) with an exact full-length hit, and their hits; and queries without one."""
    good = search.join(sizes, "qseqid").filter((F.col("qstart") == 1) & (F.col("qend") == F.col("size")) & (F.col("evalue") < 1e-5) & (F.abs(F.col("send") - F.col("sstart")) + 1 == F.col("size")))
    return good, sizes.join(good.select("qseqid").distinct(), "qseqid", "left_anti")


def combined(info: DataFrame, order: list[str], key: str = "name") -> DataFrame:
    """One row for each key: the last in order."""
    return info.groupBy(key).agg(F.max_by(F.struct(*[c for c in info.columns if c != key]), F.struct(*order)).alias("r")).select(key, "r.*")


_REPORT = "file string, cm string, target string, entry string, strand int, start long, end long, score double, evalue double, pvalue double, gc double, structure string, seq string"


def read_search_report(spark: SparkSession, path: str) -> DataFrame:
    """Covariance-search reports of both dialects, one row for each hit. Reports are read whole and parsed as streams of lines."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, text in zip(batch["file"], batch["value"], strict=True):
                rows.extend({"file": file, **hit} for hit in parse_report(text))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _REPORT.split(", ")])

    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return whole.mapInPandas(run, _REPORT)


def parse_report(text: str) -> Iterator[dict]:
    """Hits of a 1.1 report (a table below a dashed line) or a 1.0 report (blocks below `>` lines)."""
    lines = text.splitlines()
    if any(x.startswith("# target database") or "INFERNAL 1.1" in x for x in lines[:15]):
        cm = next((x.split(":", 1)[1].strip() for x in lines if x.startswith("# query CM file")), None)
        target = next((x.split(":", 1)[1].strip() for x in lines if x.startswith("# target")), None)
        rule = next((i for i, x in enumerate(lines) if x.strip().startswith("----")), len(lines))
        for x in lines[rule + 1 :]:
            f = x.split()
            if len(f) < 9 or not f[0].startswith("("):
                if not x.strip():
                    break
                continue
            start, end = int(f[6]), int(f[7])
            yield {"cm": cm, "target": target, "entry": f[5], "strand": 1 if f[8] == "+" else -1, "start": start, "end": end, "score": float(f[3]), "evalue": float(f[2]), "gc": float(f[11]) if len(f) > 11 else None}
        return
    cm = next((x.split()[-2] for x in lines if x.startswith("# command") and len(x.split()) > 3), None)
    entry, strand, hit, block = None, 1, None, []
    for x in [*lines, ">"]:
        s = x.strip()
        if s.startswith(">"):
            if hit:
                yield hit | _block(block)
            entry, hit, block = s[1:].strip() or None, None, []
        elif s.startswith(("Plus strand", "Minus strand")):
            if hit:
                yield hit | _block(block)
            strand, hit, block = (1 if s.startswith("Plus") else -1), None, []
        elif s.startswith("Query =") and entry:
            if hit:
                yield hit | _block(block)
            place = s.split("Target =")[1].split("-")
            hit, block = {"cm": cm, "entry": entry, "strand": strand, "start": int(place[0]), "end": int(place[1])}, []
        elif s.startswith("Score =") and hit:
            for part in s.split(","):
                name, _, value = part.partition("=")
                hit[{"Score": "score", "E": "evalue", "P": "pvalue", "GC": "gc"}.get(name.strip(), "_")] = float(value.strip())
            hit.pop("_", None)
        elif hit and s:
            block.append(s)


def _block(lines: list[str]) -> dict:
    """Structure (each first line of four) and target letters (each fourth) of an alignment block."""
    return {"structure": "".join(lines[0::4]) or None, "seq": "".join(x.split()[1] for x in lines[3::4] if len(x.split()) > 1) or None}


def best_hits(report: DataFrame) -> DataFrame:
    """The least e-value of each entry."""
    from ..operators.windows import best_per_key

    return best_per_key(report.drop("file"), ["entry"], "evalue", ["start", "end"])


def read_operons(spark: SparkSession, path: str) -> DataFrame:
    """(name, operon_id, start, end, strand, protein_id, cog) of tab-separated operon files; the header and rows of fewer than 10 fields are left out."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).filter(F.size(f) >= 10).select(f.alias("f"))
    place = F.split(F.col("f")[2], r"\.\.")
    return rows.select(
        F.col("f")[0].alias("name"), F.col("f")[1].try_cast("long").alias("operon_id"), place[0].try_cast("long").alias("start_pos"), F.get(place, 1).try_cast("long").alias("end_pos"),
        F.when(F.col("f")[3] == "-", -1).otherwise(1).alias("strand"), F.col("f")[5].alias("protein_id"), F.col("f")[9].alias("cog"),
    ).filter("operon_id is not null")


def operon_tables(rows: DataFrame, bioentry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The operon and operon_loc tables of the entries known."""
    known = rows.join(bioentry.select("name", "bioentry_id"), "name")
    return known.select("operon_id", "bioentry_id").dropDuplicates(), known.select("operon_id", "start_pos", "end_pos", "strand", "protein_id", "cog").dropDuplicates()


def operons_dense(rows: DataFrame) -> DataFrame:
    """One row (dense): whether operon ids run from 1 without a gap."""
    return rows.agg((F.max("operon_id") == F.count_distinct("operon_id")).alias("dense"))


def read_taxonomy_nodes(spark: SparkSession, path: str) -> DataFrame:
    """(id, parent_id) of a nodes dump."""
    f = F.split("value", r"\t\|\t?")
    return spark.read.text(path).select(f[0].try_cast("long").alias("id"), f[1].try_cast("long").alias("parent_id")).filter("id is not null")


def read_taxonomy_names(spark: SparkSession, path: str) -> DataFrame:
    """(id, name) of a names dump, scientific names."""
    f = F.split("value", r"\t\|\t?")
    return spark.read.text(path).select(f[0].try_cast("long").alias("id"), f[1].alias("name"), F.get(f, 3).alias("kind")).filter("kind = 'scientific name'").drop("kind")


def create_tables(spark: SparkSession, names: dict[str, str]) -> None:
    """Empty catalogue tables of given schemas."""
    for name, schema in names.items():
        spark.createDataFrame([], schema).write.mode("ignore").saveAsTable(name)


def drop_tables(spark: SparkSession, *names: str) -> None:
    for name in names:
        spark.sql(f"drop table if exists {name}")


def append_new(rows: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct rows whose natural key isn't in a table yet: what an idempotent load adds."""
    return rows.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def rna_families(annotations: DataFrame) -> DataFrame:
    """(file, then one column for each GF key): header values of new-family alignments, one row for each verified organism, one with null without any."""
    keys = ("NAME", "CLUSTER", "VERSION", "GENE", "TAXON", "DB", "SUBSET", "PUB", "NOTES")
    gf = annotations.filter("tag = 'GF'")
    head = gf.groupBy("file").agg(*(F.max(F.when(F.upper("key") == k, F.col("value"))).alias(k.lower()) for k in keys))
    checked = gf.filter(F.upper("key").isin("VIVO", "VITRO")).select("file", F.explode(F.split("value", r"\s*,\s*")).alias("verified_id"), F.lower("key").alias("how")).distinct()
    return head.join(checked, "file", "left")


def match_by_sequence(alignment: DataFrame, candidates: DataFrame) -> DataFrame:
    """(name, other): aligned rows and candidate entries of equal sequence once gaps are gone and T is U."""
    plain = lambda c: F.translate(F.upper(c), "T.-", "U")
    return alignment.select("name", plain("seq").alias("_s")).join(candidates.select(F.col("name").alias("other"), plain("seq").alias("_s")), "_s").select("name", "other")


def corrected_coordinates(alignment: DataFrame, genomes: DataFrame) -> DataFrame:
    """(name, genome, start, end, strand, status) of aligned rows by exact search of their sequence in their own genome: same, moved or missing."""
    from ..functions.coords import entry_parts
    from ..functions.sequences import reverse_complement

    plain = lambda c: F.translate(F.upper(c), "U.-", "T")
    rows = alignment.select("name", entry_parts("name").alias("p"), plain("seq").alias("s")).withColumn("genome", F.col("p.name"))
    rows = rows.join(genomes.select(F.col("name").alias("genome"), plain("seq").alias("g")), "genome", "left")
    forward, backward = F.instr("g", F.col("s")), F.instr("g", reverse_complement("s"))
    at = F.when(forward > 0, forward).when(backward > 0, backward).cast("long")
    rows = rows.select("name", "genome", "p", at.alias("start"), (at + F.length("s") - 1).alias("end"), F.when(forward > 0, "1").when(backward > 0, "-1").alias("strand"))
    same = (F.col("start") == F.col("p.start")) & (F.col("end") == F.col("p.end")) & (F.col("strand") == F.col("p.strand"))
    return rows.select("name", "genome", "start", "end", "strand", F.when(F.col("start").isNull(), "missing").when(same, "same").otherwise("moved").alias("status"))


def renamed(alignment: DataFrame, candidates: DataFrame, seed: int) -> DataFrame:
    """alignment with `new_name`: one candidate of equal sequence by a seeded draw, null without any."""
    from ..operators.relational import stratified_sample

    picked = stratified_sample(match_by_sequence(alignment, candidates), ["name"], 1, seed, "other").withColumnRenamed("other", "new_name")
    return alignment.join(picked, "name", "left")
