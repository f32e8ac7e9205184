"""Queries: counting, descriptive statistics, information."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.similarity import letter_pairs, ngrams
from ..operators import alignment, counting, info, stats
from .base import ALIGNED_SQL, RNA_SQL, aligned, r6, registry, rna, table

QUERIES, ORACLE_SQL, query = registry()
_GRAMS = "select {by} unnest(list_transform(range(1, length({t}) - {n} + 2), lambda i: substring({t}, i, {n}))) as item from {src} where length({t}) >= {n}"


def _grams(src: str, t: str, n: int, by: str = "") -> str:
    return _GRAMS.format(src=src, t=t, n=n, by=by)


@query(f"select item, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as p from ({_grams('part', 'p_name', 2)}) group by item")
def ngram_freq(spark, sf):
    rows = counting.ngram_probabilities(table(spark, sf, "part"), "p_name", 2)
    return rows.select("item", "n", r6(F.col("p"), "p"))


@query(f"select lang, item, count(*) as n, round(count(*) / sum(count(*)) over (partition by lang), 6) as p from ({_grams('documents', 'text', 2, 'lang,')}) group by lang, item")
def cc_ngram_freqs(spark, sf):
    rows = counting.ngram_probabilities(table(spark, sf, "documents"), "text", 2, ["lang"])
    return rows.select("lang", "item", "n", r6(F.col("p"), "p"))


@query(f"""with g as ({_grams('documents', 'text', 1, 'lang,')}), c as (select lang, item, count(*) as n, 'group' as level from g group by lang, item union all select null, item, count(*), 'all' from g group by item)
select lang, item, n, level, round(n / sum(n) over (partition by level, lang), 6) as p from c""")
def freqs_with_totals(spark, sf):
    rows = counting.grouped_with_totals(table(spark, sf, "documents"), ngrams("text", 1), "lang")
    return rows.select("lang", "item", "n", "level", r6(F.col("p"), "p"))


@query(f"select distinct item from ({_grams('part', 'p_type', 3)})")
def gram_alphabet(spark, sf):
    return counting.alphabet(table(spark, sf, "part"), "p_type", 3)


_BEFORE = ", ".join(f"count(*) filter (ch = '{b}') over (partition by doc_id order by i rows between unbounded preceding and 1 preceding) as {b}" for b in "ACGU")
_ORDERED = f"""with s as (select doc_id, lang, string_split({RNA_SQL}, '') as q from documents), x as (select doc_id, lang, unnest(q) as ch, unnest(range(len(q))) as i from s), w as (select lang, ch, {_BEFORE} from x where ch <> ''),
k as ({' union all '.join(f"select lang, '{b}' as a, ch as b, sum({b})::bigint as n from w group by 1, 2, 3" for b in "ACGU")}) """


@query(f"{_ORDERED} select lang, least(a, b) || greatest(a, b) as item, sum(n)::bigint as n from k group by 1, 2 having sum(n) > 0")
def combins_freq_sym(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", rna().alias("q"))
    return counting.combination_frequencies(docs, "q", "doc_id", ["lang"])


@query(f"{_ORDERED} select lang, a || b as item, n from k where n > 0")
def combins_freq_nonsym(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", rna().alias("q"))
    return counting.combination_frequencies(docs, "q", "doc_id", ["lang"], symmetric=False)


@query(f"select least(item, reverse(item)) as item, count(*) as n from ({_grams('part', 'p_name', 2)}) group by 1")
def coalesce_reversible(spark, sf):
    return counting.merge_reversible(counting.ngram_frequencies(table(spark, sf, "part"), "p_name", 2))


@query("select l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) as weighted_mean, round(avg(l_discount), 6) as mean, median(l_extendedprice) as median from lineitem group by 1")
def weighted_mean_median(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(r6(stats.weighted_mean("l_discount", "l_quantity"), "weighted_mean"), r6(F.avg("l_discount"), "mean"), F.median("l_extendedprice").alias("median"))


@query("with e as (select l_linestatus, l_tax, unnest(range(0, l_quantity::bigint)) as k from lineitem) select l_linestatus, median(l_tax) as median from e group by 1")
def weighted_median(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_linestatus").agg(stats.weighted_median("l_tax", "l_quantity").alias("median"))


@query("select l_returnflag, count(*) as n, round(sum(l_quantity), 2) as sum, round(avg(l_quantity), 6) as mean, median(l_quantity) as median, round(var_pop(l_quantity), 6) as variance, round(stddev_pop(l_quantity), 6) as std from lineitem group by 1")
def variance_std(spark, sf):
    s = stats.summary(table(spark, sf, "lineitem"), "l_quantity", ["l_returnflag"])
    return s.select("l_returnflag", "n", F.round("sum", 2).alias("sum"), r6(F.col("mean"), "mean"), "median", r6(F.col("variance"), "variance"), r6(F.col("std"), "std"))


@query("with g as (select o_orderpriority, count(*) as n, var_pop(o_totalprice) as v from orders group by 1) select round(sum((n - 1) * v) / (sum(n) - count(*)), 2) as avg_variance, round(sqrt(sum((n - 1) * v) / (sum(n) - count(*))), 4) as avg_std from g")
def avg_variance(spark, sf):
    s = stats.pooled_variance(table(spark, sf, "orders"), "o_totalprice", "o_orderpriority")
    return s.select(F.round("avg_variance", 2).alias("avg_variance"), F.round("avg_std", 4).alias("avg_std"))


@query("select l_returnflag, round(covar_pop(l_quantity, l_extendedprice), 2) as covariance, round(corr(l_quantity, l_extendedprice), 6) as correlation from lineitem group by 1")
def covariance_correlation(spark, sf):
    s = stats.association(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return s.select("l_returnflag", F.round("covariance", 2).alias("covariance"), r6(F.col("correlation"), "correlation"))


@query("select l_orderkey, round(ln(product(1 + l_quantity)), 6) as log_product, round(sum(ln(1 + l_quantity)), 6) as log_sum from lineitem group by 1")
def products(spark, sf):
    s = table(spark, sf, "lineitem").groupBy("l_orderkey")
    return s.agg(r6(F.ln(F.product(1 + F.col("l_quantity"))), "log_product"), r6(F.sum(F.ln(1 + F.col("l_quantity"))), "log_sum"))


@query("select ((select sum(s_nationkey)::bigint from supplier) * (select sum(p_size)::bigint from part))::bigint as cross_sum")
def cross_reduce(spark, sf):
    return stats.cross_reduce(table(spark, sf, "supplier"), table(spark, sf, "part"), "s_nationkey", "p_size")


@query("select l_returnflag, count(*) filter (l_linestatus = 'F') as f, count(*) filter (l_linestatus = 'O') as o from lineitem where l_discount < 0.05 group by 1")
def pivot_counts(spark, sf):
    rows = counting.pivot_counts(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", F.col("l_discount") < 0.05, ["F", "O"])
    return rows.select("l_returnflag", F.coalesce("F", F.lit(0)).alias("f"), F.coalesce("O", F.lit(0)).alias("o"))


def _h(expr: str) -> str:
    return f"(log2(sum({expr})) - sum({expr} * log2({expr})) / sum({expr}))"


@query(f"select l_returnflag, round({_h('n')}, 6) as entropy from (select l_returnflag, l_shipdate::date as d, count(*)::double as n from lineitem group by 1, 2) group by 1")
def entropy_by_group(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_returnflag", F.to_date("l_shipdate").alias("d"))
    return info.shannon_entropy(rows, "d", ["l_returnflag"]).select("l_returnflag", r6(F.col("entropy"), "entropy"))


_HS = """with b as (select o_orderstatus as x, o_orderpriority as y, l_returnflag as z from lineitem join orders on l_orderkey = o_orderkey),
h(k, v) as (select 'x', entropy(x) from b union all select 'y', entropy(y) from b union all select 'z', entropy(z) from b union all select 'xy', entropy(x || '|' || y) from b union all select 'xz', entropy(x || '|' || z) from b
union all select 'yz', entropy(y || '|' || z) from b union all select 'xyz', entropy(x || '|' || y || '|' || z) from b), e as (select max(v) filter (k = 'x') as x, max(v) filter (k = 'y') as y, max(v) filter (k = 'z') as z,
max(v) filter (k = 'xy') as xy, max(v) filter (k = 'xz') as xz, max(v) filter (k = 'yz') as yz, max(v) filter (k = 'xyz') as xyz from h) """


def _xyz(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(F.col("o_orderstatus").alias("x"), F.col("o_orderpriority").alias("y"), F.col("l_returnflag").alias("z"))


@query(_HS + "select round(xyz, 6) as joint_entropy from e")
def joint_entropy(spark, sf):
    return info.joint_entropy(_xyz(spark, sf), ["x", "y", "z"]).select(r6(F.col("joint_entropy"), "joint_entropy"))


@query(_HS + "select round(xy - y, 6) as conditional_entropy from e")
def cond_entropy(spark, sf):
    return info.conditional_entropy(_xyz(spark, sf), "x", "y").select(r6(F.col("conditional_entropy"), "conditional_entropy"))


@query(_HS + "select round(x + y - xy, 6) as mutual_information, round(xy, 6) as joint_entropy, round(1 - (x + y - xy) / xy, 6) as variation_information from e")
def mutual_info(spark, sf):
    return info.mutual_information(_xyz(spark, sf), "x", "y").select(*(r6(F.col(c), c) for c in ("mutual_information", "joint_entropy", "variation_information")))


@query(_HS + "select round(xz + yz - xyz - z, 6) as conditional_mutual_information from e")
def cond_mutual_info(spark, sf):
    return info.conditional_mutual_information(_xyz(spark, sf), "x", "y", "z").select(r6(F.col("conditional_mutual_information"), "conditional_mutual_information"))


@query(_HS + "select round(x + y + z - xyz, 6) as total_correlation from e")
def total_correlation(spark, sf):
    return info.total_correlation(_xyz(spark, sf), ["x", "y", "z"]).select(r6(F.col("total_correlation"), "total_correlation"))


@query(_HS + "select round(-(x + y + z) + xy + xz + yz - xyz, 6) as interaction_information from e")
def interaction_info(spark, sf):
    return info.interaction_information(_xyz(spark, sf), ["x", "y", "z"]).select(r6(F.col("interaction_information"), "interaction_information"))


@query("select l_returnflag, l_linestatus, count(*) as n, round(count(*) / sum(count(*)) over (partition by l_linestatus), 6) as p from lineitem group by 1, 2")
def cond_probability(spark, sf):
    rows = info.conditional_probability(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")
    return rows.select("l_returnflag", "l_linestatus", "n", r6(F.col("p"), "p"))


@query("select least(o_orderstatus, l_returnflag) as a, greatest(o_orderstatus, l_returnflag) as b, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as p from lineitem join orders on l_orderkey = o_orderkey group by 1, 2")
def joint_prob_sym(spark, sf):
    rows = _xyz(spark, sf).select(F.col("x").alias("a"), F.col("z").alias("b"))
    return info.joint_probability(rows, "a", "b", symmetric=True).select("a", "b", "n", r6(F.col("p"), "p"))


_LANGS = f"with c as (select lang, item, count(*)::double as n from ({_grams('documents', 'text', 2, 'lang,')}) group by 1, 2), d as (select lang, item, n / sum(n) over (partition by lang) as p from c) "


@query(_LANGS + "select q.lang, round(sum(p.p * log2(p.p / q.p)), 6) as kld from (select * from d where lang = 'en') p join d q using (item) where q.lang <> 'en' group by 1")
def kld_lang_profiles(spark, sf):
    d = counting.ngram_probabilities(table(spark, sf, "documents"), "text", 2, ["lang"])
    others = d.filter("lang <> 'en'").select("lang", "item", "p")
    en = d.filter("lang = 'en'").select("item", F.col("p").alias("p"))
    p = others.select("lang").distinct().join(en)  # one row for each language
    return info.relative_entropy(p, others, by=["lang"]).select("lang", r6(F.col("kld"), "kld"))


@query(_LANGS + """, k as (select l.lang, i.item from (select distinct lang from d where lang <> 'en') l, (select distinct item from d) i),
m as (select k.lang, coalesce(a.p, 0) as p, coalesce(b.p, 0) as q from k left join d a on a.lang = 'en' and a.item = k.item left join d b on b.lang = k.lang and b.item = k.item)
select lang, round(sum(case when p > 0 then 0.3 * p * log2(p / (0.3 * p + 0.7 * q)) else 0 end + case when q > 0 then 0.7 * q * log2(q / (0.3 * p + 0.7 * q)) else 0 end), 6) as divergence from m where p + q > 0 group by 1""")
def lambda_div(spark, sf):
    d = counting.ngram_probabilities(table(spark, sf, "documents"), "text", 2, ["lang"])
    others = d.filter("lang <> 'en'").select("lang", "item", "p")
    p = others.select("lang").distinct().join(d.filter("lang = 'en'").select("item", "p"))  # one row for each language
    return info.lambda_divergence(p, others, 0.3, by=["lang"]).select("lang", r6(F.col("divergence"), "divergence"))


@query(_LANGS + """, k as (select a.lang as a, b.lang as b, i.item from (select distinct lang from d) a join (select distinct lang from d) b on a.lang < b.lang, (select distinct item from d) i),
m as (select k.a, k.b, coalesce(x.p, 0) as p, coalesce(y.p, 0) as q from k left join d x on x.lang = k.a and x.item = k.item left join d y on y.lang = k.b and y.item = k.item)
select a, b, round(sum(case when p > 0 then 0.5 * p * log2(p / (0.5 * p + 0.5 * q)) else 0 end + case when q > 0 then 0.5 * q * log2(q / (0.5 * p + 0.5 * q)) else 0 end), 6) as divergence from m where p + q > 0 group by 1, 2""")
def js_lang_matrix(spark, sf):
    d = counting.ngram_probabilities(table(spark, sf, "documents"), "text", 2, ["lang"])
    return info.jensen_shannon_pairs(d, "lang").select("a", "b", r6(F.col("divergence"), "divergence"))


@query("select o_orderstatus, o_orderpriority, round(log2(count(*) * (sum(count(*)) over ()) / ((sum(count(*)) over (partition by o_orderstatus)) * (sum(count(*)) over (partition by o_orderpriority)))), 6) as lod from orders group by 1, 2")
def lod_scores(spark, sf):
    return info.lod_scores(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority").select("o_orderstatus", "o_orderpriority", r6(F.col("lod"), "lod"))


# The alignment: every part's whole name and type, with gaps up to the longest.
_PART = "p_name || '-' || p_type"
_ALN = f"with t as (select p_partkey as name, {ALIGNED_SQL.format(_PART)} as seq from part), m as (select max(length(seq)) as m from t), x as (select name, unnest(range(m)) as col, rpad(seq, m::int, '.') as seq from t, m), c as (select name, col, substring(seq, col + 1, 1) as ch from x) "


def _aln(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("name"), aligned(F.concat("p_name", F.lit("-"), "p_type")).alias("seq"))
    width = rows.agg(F.max(F.length("seq")).alias("m"))
    return rows.join(F.broadcast(width)).select("name", F.expr("rpad(seq, m, '.')").alias("seq"))  # one row


@query(_ALN + f"select col::int as col, round({_h('n')}, 6) as entropy, sum(n)::bigint as n from (select col, ch, count(*)::double as n from c where ch <> '.' group by 1, 2) group by 1")
def aln_column_entropy(spark, sf):
    return alignment.column_entropy(_aln(spark, sf)).select("col", r6(F.col("entropy"), "entropy"), "n")


@query(_ALN + """, p as (select a.col as i, b.col as j, a.ch as a, b.ch as b, count(*)::double as n from c a join c b on a.name = b.name and a.col < b.col where a.ch <> '.' and b.ch <> '.' group by 1, 2, 3, 4),
xy as (select i, j, ln(sum(n)) - sum(n * ln(n)) / sum(n) as h from p group by 1, 2), px as (select i, j, ln(sum(n)) - sum(n * ln(n)) / sum(n) as h from (select i, j, a, sum(n) as n from p group by 1, 2, 3) group by 1, 2),
py as (select i, j, ln(sum(n)) - sum(n * ln(n)) / sum(n) as h from (select i, j, b, sum(n) as n from p group by 1, 2, 3) group by 1, 2)
select xy.i::int as i, xy.j::int as j, round(px.h + py.h - xy.h, 6) as mutual_information, round(xy.h, 6) as joint_entropy from xy join px using (i, j) join py using (i, j)""")
def aln_mutual_info(spark, sf):
    rows = alignment.column_information(_aln(spark, sf))
    return rows.select("i", "j", r6(F.col("mutual_information"), "mutual_information"), r6(F.col("joint_entropy"), "joint_entropy"))


@query(_ALN + """, p as (select a.col as i, a.ch || b.ch as item, count(*) as n from c a join c b on a.name = b.name and b.col = a.col + 1 where a.ch <> '.' and b.ch <> '.' group by 1, 2)
select i::int as i, coalesce(sum(n) filter (item = 'AU'), 0)::bigint as au, coalesce(sum(n) filter (item = 'UA'), 0)::bigint as ua, coalesce(sum(n) filter (item = 'GC'), 0)::bigint as gc, coalesce(sum(n) filter (item = 'CG'), 0)::bigint as cg,
round(coalesce(sum(n) filter (item in ('AU', 'UA', 'GC', 'CG')), 0) / sum(n), 6) as paired from p group by 1""")
def bp_stats(spark, sf):
    pairs = alignment.pair_counts(_aln(spark, sf)).filter("j = i + 1").select("i", F.concat("a", "b").alias("item"), "n")
    return counting.base_pair_stats(pairs, ["i"]).select("i", "au", "ua", "gc", "cg", r6(F.col("paired"), "paired"))


@query(f"with g as ({_grams(f"(select {ALIGNED_SQL.format('text')} as q from documents)", 'q', 2)}), c as (select item, count(*) as n from g where item not like '%.%' group by 1) select item, n, round(n / sum(n) over (), 6) as p from c")
def background_dist(spark, sf):
    docs = table(spark, sf, "documents").select(aligned("text").alias("q"))
    return counting.background(docs, "q", 2).select("item", "n", r6(F.col("p"), "p"))


@query("select label, count(*) as n from (select label, unnest(list_distinct(list_transform(range(1, length(t)), lambda i: substring(t, i, 2)))) as g from (select p_brand as label, p_name as t from part)) group by 1")
def distinct_grams_by_brand(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_brand").alias("label"), F.explode(letter_pairs("p_name", 2)).alias("g"))
    return rows.groupBy("label").agg(F.count("*").alias("n"))


@query("select unnest(string_split(props, ',')) as token, count(*) as n from events group by 1")
def token_frequencies(spark, sf):
    return counting.token_counts(table(spark, sf, "events"), "props")
