"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, edit_counts, hmm_lm, language_id, near_dedup, packing, pii, quality_classifier, quality_rules, substring_dedup


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(spark, documents(spark, sf_dir))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(spark, documents(spark, sf_dir))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.sanitise(spark, documents(spark, sf_dir))
    return rows.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_report", 256).alias("base_sha256"), "spans")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_counts.token_counts(spark, documents(spark, sf_dir))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, documents(spark, sf_dir))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(spark, documents(spark, sf_dir))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_scores(spark, documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(spark, documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_lm.language_model_scores(spark, documents(spark, sf_dir))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.substring_dedup(spark, documents(spark, sf_dir))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_pii": op3_pii,
    "op4_token_counts": op4_token_counts,
    "op5_packing": op5_packing,
    "op6_language_id": op6_language_id,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_decontamination": op8_decontamination,
    "op9_hmm_lm": op9_hmm_lm,
    "op10_substring_dedup": op10_substring_dedup,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = r"[\x20\x09-\x0D]+"

ORACLE_SQL = {
    "op1_near_dedup": rf"""
with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_SPACE}'), lambda x: x <> '') as w from documents),
sh as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from w),
n as (select doc_id, count(*) as n from sh group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as m from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * m >= 75 * (x.n + y.n - m)),
e2 as (select a, b from e union select b, a from e),
r as (select a, b from e2 union select r.a, e2.b from r join e2 on r.b = e2.a),
c as (select a, min(b) as c from r group by a)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(c.c, d.doc_id)) as component_id, d.doc_id = least(d.doc_id, coalesce(c.c, d.doc_id)) as kept
from documents d left join n on n.doc_id = d.doc_id left join c on c.a = d.doc_id""",
    "op10_substring_dedup": rf"""
with w as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '') as w from documents),
win as (select doc_id, i as p, array_to_string(w[i:i + 34], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 33)) as i from w where len(w) >= 35)),
rep as (select doc_id, p from win join (select s from win group by s having count(*) > 1) using (s)),
hit as (select distinct doc_id, unnest(range(p, p + 35)) as i from rep),
word as (select doc_id, unnest(range(1, len(w) + 1)) as i, unnest(w) as x from w),
kept as (select doc_id, array_to_string(list(x order by i), ' ') as t, count(*) as k from word anti join hit using (doc_id, i) group by doc_id)
select w.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(k, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256 from w left join kept using (doc_id)""",
}
