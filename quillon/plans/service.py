"""One entry point for what clients ask by name: set operations, sequences of entries, lineages, file checks, taxon tables, jobs."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relational, setops
from ..sources import hits, sequences
from .config import entry_request, parse_config
from .jobs import Jobs, caught


class Service:
    """Requests over a catalogue of tables: genomes (name, seq), bioentry, taxon, taxon_name, ancestor. Every answer is a DataFrame or a plain value."""

    def __init__(self, spark: SparkSession, catalogue: dict[str, DataFrame]) -> None:
        self.spark, self.tables, self.jobs = spark, catalogue, Jobs(spark)
        self.requests: dict[str, Callable[..., Any]] = {
            "entry-setop": self.entry_setop, "name-seqs": self.name_sequences, "name-taxa": self.name_taxa, "check-sto": self.check_sto, "csv-entries": self.csv_entries,
            "rna-taxon-info": self.rna_taxon_info, "run-config": self.run_config, "check-job": self.jobs.check, "job-result": self.jobs.results, "features": self.features,
        }

    def ask(self, request: str, *args: Any, **options: Any) -> Any:
        """The answer, or what went wrong as a value."""
        if request not in self.requests:
            return {"error": "unknown request", "message": f"known: {', '.join(self.requests)}"}
        return caught(lambda: self.requests[request](*args, **options))

    def entry_setop(self, op: str, *paths: str, mode: str = "exact", names: bool = False, delta: int = 10) -> DataFrame:
        sets = [sequences.read_entries(self.spark, p).select("name", "start", "end", "strand") for p in paths]
        return setops.set_operation(op, *sets, mode=mode, full=not names, delta=delta, genomes=self.tables.get("genomes"))

    def name_sequences(self, path: str, rna: bool = False) -> DataFrame:
        entries = sequences.read_entries(self.spark, path).select("name", "start", "end", "strand")
        return setops.with_sequences(entries, self.tables["genomes"], rna)

    def name_taxa(self, path: str) -> DataFrame:
        names = self.spark.read.text(path).select(F.trim("value").alias("name")).filter("name <> ''")
        return relational.names_to_lineage(names, self.tables["bioentry"], self.tables["taxon"], self.tables["ancestor"])

    def check_sto(self, path: str) -> DataFrame:
        return sequences.check_stockholm(self.spark, path)

    def csv_entries(self, path: str, legacy: bool = False) -> DataFrame:
        info = hits.read_legacy_hits(self.spark, path) if legacy else hits.hit_info(hits.read_hits(self.spark, path))
        return hits.hits_as_entries(hits.new_hits(info))

    def rna_taxon_info(self, request: str) -> DataFrame:
        rnas, taxa = entry_request(request)
        asked = [self.spark.createDataFrame([(x,) for x in xs], f"{c} string") for xs, c in ((rnas, "rna"), (taxa, "taxon"))]
        return relational.rna_by_taxon(self.tables["rna_hits"], self.tables["genome_taxa"], *asked)

    def features(self, name: str) -> DataFrame:
        t = self.tables
        return relational.features(t["bioentry"], t["seqfeature"], t["qualifiers"], t["term"], t.get("location"), F.col("name") == name)

    def run_config(self, text: str, user: str, stages: dict[str, tuple[Callable[..., Any], list[str]]]) -> int:
        """Starts a job with a task for each section of the configuration that has a stage; returns its number."""
        config = parse_config(text)
        wanted = {name: stage for name, stage in stages.items() if name in config.options or name in config.files}
        job = self.jobs.add(user, {n: (f, [d for d in deps if d in wanted]) for n, (f, deps) in wanted.items()})
        self.jobs.start(job)
        return job
