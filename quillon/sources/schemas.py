"""Fixed schemas of the file formats."""

from __future__ import annotations

HIT_COLUMNS = (
    "name string, orig_start long, orig_end long, hit_start long, hit_end long, hit_strand byte, hit_rel_start long, hit_rel_end long, "
    "score double, evalue double, pvalue double, gc double, structure string, tgt_seq string, orig_tgt_seq string"
)
SEARCH_COLUMNS = "qseqid string, qstart int, qend int, evalue double, sseqid string, sstart int, send int"
BIOENTRY = "bioentry_id long, name string, version int, description string, identifier string, taxon_id long"
TAXON = "taxon_id long, ncbi_taxon_id long, node_rank string, left_value long, right_value long"
TAXON_NAME = "taxon_id long, name string, name_class string"
ANCESTOR = "ncbi_taxon_id long, ancestors string"
SEQFEATURE = "seqfeature_id long, bioentry_id long, type_term_id long"
LOCATION = "seqfeature_id long, start_pos long, end_pos long, strand byte"
QUALIFIER = "seqfeature_id long, term_id long, value string"
TERM = "term_id long, name string"
OPERON = "operon_id long, bioentry_id long"
OPERON_LOC = "operon_id long, start_pos long, end_pos long, strand byte, protein_id string, cog string"
RNAHIT = "rnahit_id long, name string, cluster string, version string, gene_name string, ncbi_taxon_id long, db string, subset string, pub string, notes string, loaded date"
VERIFIED = "verified_id long, rnahit_id long, verified_taxon_id long, verified_loc string"
GENOME_RNAHIT = "genome_rnahit_id long, bioentry_id long, rnahit_id long"
