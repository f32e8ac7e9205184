"""Queries: array, coordinate, entry, name, gap, gram and vector columns, and set operations on entries, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays, coords, sequences, similarity, vectors
from ..operators import counting, setops
from .base import r6, registry, table
from .queries_scalars import _ENTRY, _entries

QUERIES, ORACLE_SQL, query = registry()


def _letters(c):
    return F.regexp_extract_all(F.col(c), F.lit("(?s)."), F.lit(0))


def _joined(c):
    return F.array_join(c, "")


_FIRST = "with t as (select p_partkey, string_split(p_name, '') as c from part), k as (select *, list_position(list_transform(c, lambda x: x = 'e'), true) as pos, list_position(list_transform(range(2, len(c) + 1), lambda i: c[i] = c[i - 1]), true) as same from t) "


@query(_FIRST + "select p_partkey, c[3] as third, case when pos > 0 then array_to_string(c[pos:], '') else '' end as dropped, array_to_string(case when pos > 0 then c[:pos - 1] else c end, '') as taken, array_to_string(case when same > 0 then c[:same] else c end, '') as unchanged, list_contains(c, 'z') as has_z from k")
def array_cuts(spark, sf):
    c, e = _letters("p_name"), lambda x: x == "e"
    rows = table(spark, sf, "part").select("p_partkey", c.alias("c"))
    return rows.select(
        "p_partkey", arrays.third("c").alias("third"), _joined(arrays.drop_until("c", e)).alias("dropped"), _joined(arrays.take_until("c", e)).alias("taken"),
        _joined(arrays.take_until_nochange("c")).alias("unchanged"), arrays.contains("c", "z").alias("has_z"),
    )


@query("with t as (select p_partkey, string_split(p_name, '') as a, string_split(p_type, '') as b from part) select p_partkey, array_to_string(list_transform(range(1, least(len(a), len(b)) + 1), lambda i: a[i] || b[i]), '|') as turned from t")
def transpose_rows(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.array(_letters("p_name"), _letters("p_type")).alias("r"))
    return rows.select("p_partkey", F.array_join(F.transform(arrays.transpose("r"), _joined), "|").alias("turned"))


@query("with n as (select l_orderkey, l_returnflag as k, count(*) as n from lineitem group by 1, 2), a as (select * from n where k <> 'N'), b as (select * from n where k <> 'R') select l_orderkey, k, (coalesce(a.n, 0) + coalesce(b.n, 0))::bigint as n from a full join b using (l_orderkey, k)")
def merge_maps(spark, sf):
    n = table(spark, sf, "lineitem").groupBy("l_orderkey", F.col("l_returnflag").alias("k")).agg(F.count("*").alias("n"))
    side = lambda other, name: F.map_from_entries(F.coalesce(F.collect_list(F.when(F.col("k") != other, F.struct("k", "n"))), F.array())).alias(name)
    rows = n.groupBy("l_orderkey").agg(side("N", "a"), side("R", "b"))
    return rows.select("l_orderkey", F.explode(arrays.merge_with(lambda k, x, y: x + y, "a", "b")).alias("k", "n"))


_XYZ = "with t as (select o_orderkey, (o_orderkey % 97)::bigint as x, (o_custkey % 89)::bigint as y, (o_totalprice::bigint % 83)::bigint as z, case when o_orderkey % 2 = 0 then 1 else -1 end as strand from orders), u as (select *, least(x, y) as s1, greatest(x, y) as e1, least(y, z) as s2, greatest(y, z) as e2 from t) "


def _xyz(spark, sf):
    o = table(spark, sf, "orders")
    t = o.select("o_orderkey", (F.col("o_orderkey") % 97).alias("x"), (F.col("o_custkey") % 89).cast("long").alias("y"), (F.round("o_totalprice").cast("long") % 83).alias("z"), F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(-1).alias("strand"))
    return t.select("*", F.least("x", "y").alias("s1"), F.greatest("x", "y").alias("e1"), F.least("y", "z").alias("s2"), F.greatest("y", "z").alias("e2"))


_OV = "greatest(least(e1, e2) - greatest(s1, s2) + 1, 0)"


@query(_XYZ.replace("o_totalprice::bigint", "round(o_totalprice)::bigint") + f"""select o_orderkey, x < y and y <= z as open_closed, x <= y and y < z as closed_open, (x < y and y <= z) or (z <= y and y < x) as inside, case when abs(x - least(y, z)) <= abs(x - greatest(y, z)) then least(y, z) else greatest(y, z) end as closer,
case when strand >= 0 then x < y and y <= z else x <= y and y < z end as hit_inside, {_OV}::bigint as overlap, (s1 <= s2 and e2 <= e1) or (s2 <= s1 and e1 <= e2) or {_OV} / ((e1 - s1 + e2 - s2 + 2) / 2.0) >= 0.8 as duplicate from u""")
def coordinate_tests(spark, sf):
    return _xyz(spark, sf).select(
        "o_orderkey", coords.open_closed("x", "y", "z").alias("open_closed"), coords.closed_open("x", "y", "z").alias("closed_open"), coords.between("x", "y", "z").alias("inside"),
        coords.closer("x", "y", "z").alias("closer"), coords.hit_between("strand", "x", "y", "z").alias("hit_inside"), coords.overlap("s1", "e1", "s2", "e2").alias("overlap"),
        coords.duplicate_location("s1", "e1", "s2", "e2").alias("duplicate"),
    )


@query(_XYZ.replace("o_totalprice::bigint", "round(o_totalprice)::bigint") + "select o_orderkey, case when strand >= 0 then 1000 + x - 1 else 1000 - x end as hit_from, case when strand >= 0 then 1000 + y else 1000 - y + 1 end as hit_to from u")
def hit_locations(spark, sf):
    at = coords.hit_location(F.lit(1000).cast("long"), F.lit(2000), "x", "y", "strand")
    return _xyz(spark, sf).select("o_orderkey", at[0].alias("hit_from"), at[1].alias("hit_to"))


@query(f"with e as (select o_orderkey, {_ENTRY} as e from orders), p as (select *, split_part(split_part(e, '/', 2), '-', 1) as s, split_part(split_part(e, '/', 2), '-', 2) as t from e) select o_orderkey, regexp_matches(e, '[0-9]+-[0-9]+') as located, case when e like '%/-1' then t || '-' || s else s || '-' || t end as location, regexp_replace(regexp_replace(s || ' mid ' || t, '^\\s*[0-9]+\\s*', ''), '\\s*[0-9]+\\s*$', '') as bare from p")
def entry_texts(spark, sf):
    e = _entries(spark, sf)
    p = coords.entry_parts("entry")
    bare = coords.without_locations(F.concat(p["start"].cast("string"), F.lit(" mid "), p["end"].cast("string")))
    return e.select("o_orderkey", coords.has_location("entry").alias("located"), coords.entry_location("entry").alias("location"), bare.alias("bare"))


@query("with n as (select p_partkey, case when p_size % 3 = 0 then p_brand || '.sto' else p_brand || '-' || p_size || '.sto' end as f from part), v as (select *, coalesce(try_cast(regexp_extract(f, '-([0-9]+)\\.sto$', 1) as int), 0) as v from n) select p_partkey, v::int as version, regexp_replace(f, '(-[0-9]+)?\\.sto$', '') || '-' || (v + 1) || '.sto' as next_name from v")
def file_versions(spark, sf):
    name = F.when(F.col("p_size") % 3 == 0, F.concat("p_brand", F.lit(".sto"))).otherwise(F.concat("p_brand", F.lit("-"), F.col("p_size").cast("string"), F.lit(".sto")))
    return table(spark, sf, "part").select("p_partkey", name.alias("f")).select("p_partkey", coords.sto_version("f").alias("version"), coords.next_sto_name("f").alias("next_name"))


@query("select p_partkey, regexp_matches(p_name, '^[0-9]+$') as name_digits, regexp_matches(p_partkey::varchar, '^[0-9]+$') as key_digits, lower(p_name) < lower(p_type) as less, lower(p_name) > lower(p_type) as greater, lower(p_name) = lower(p_type) as equal, upper(p_name) as normed from part")
def string_tests(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", sequences.is_digits("p_name").alias("name_digits"), sequences.is_digits(F.col("p_partkey").cast("string")).alias("key_digits"), sequences.less_ignoring_case("p_name", "p_type").alias("less"),
        sequences.greater_ignoring_case("p_name", "p_type").alias("greater"), sequences.equal_ignoring_case("p_name", "p_type").alias("equal"), sequences.normed("p_name").alias("normed"),
    )


@query("with g as (select doc_id, text, length(text) - length(replace(replace(text, '.', ''), '-', '')) as n from documents) select doc_id, n::bigint as gaps, n > 0 as gapped, round(case when length(text) > 0 then n / length(text)::double end, 6) as share, length(replace(replace(text, '.', ''), '-', ''))::int as residues from g")
def gap_columns(spark, sf):
    return table(spark, sf, "documents").select("doc_id", sequences.gap_count("text").alias("gaps"), sequences.has_gap("text").alias("gapped"), r6(sequences.gap_fraction("text"), "share"), F.length(sequences.degap("text")).alias("residues"))


_CODES = "list_transform(string_split(s, ''), lambda c: case when c between 'a' and 'z' then ascii(c) - 97 when c = ' ' then 27 else 28 end)"


@query(f"""with t as (select p_partkey, p_name as s, length(p_name) as n from part), c as (select *, {_CODES} as c from t), l as (select *, list_transform(c, lambda x: least(x, 27)) as l from c)
select p_partkey, len(list_distinct(flatten(list_transform(range(1, n), lambda k: list_transform(range(1, n - k + 2), lambda i: substring(s, i, k))))))::int as grams, list_sum(c)::bigint as code_sum, len(list_distinct(list_transform(range(1, n), lambda i: l[i] * 28 + l[i + 1])))::int as places,
len(list_distinct(list_concat(list_transform(range(1, n), lambda i: substring(s, i, 2)), list_transform(range(1, n - 1), lambda i: substring(s, i, 3)))))::int as bi_tri from l""")
def gram_sets(spark, sf):
    codes = F.aggregate(similarity.normed_codepoints("p_name"), F.lit(0).cast("long"), lambda a, x: a + x)
    return table(spark, sf, "part").select("p_partkey", F.size(similarity.all_grams("p_name")).alias("grams"), codes.alias("code_sum"), F.size(similarity.ngram_vector("p_name")).alias("places"), F.size(similarity.bi_tri_grams("p_name")).alias("bi_tri"))


@query(_XYZ.replace("o_totalprice::bigint", "round(o_totalprice)::bigint") + """, a as (select o_orderkey, list_distinct([x, y]) as a, list_distinct([y, z]) as b from u where y > 0)
select o_orderkey, round(list_sum(list_intersect(a, b)) / list_sum(list_distinct(list_concat(a, b)))::double, 6) as score from a""")
def frequency_jaccard(spark, sf):
    return _xyz(spark, sf).filter("y > 0").select("o_orderkey", r6(similarity.frequency_jaccard(F.array("x", "y"), F.array("y", "z")), "score"))


@query("""with e as (select vec_id, embedding::double[] as v from embeddings) select vec_id, round(list_sum(v), 5) as total, round(list_sum(v[:3]), 5) as third_sum, round(list_sum(v) * list_sum(v), 4) as crossed, round((v[1] + v[1]) * (v[2] + v[2]), 5) as lockstep, round(v[1] * v[2] * v[3], 6) as product,
round((v[1] + v[2]) / 2, 5) as middle, round(v[1] / sqrt(list_inner_product(v, v)), 5) as unit from e""")
def vector_folds(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    five = lambda c, n: (F.round(c, 5) + 0.0).alias(n)
    two = F.slice("v", 1, 2)
    return e.select(
        "vec_id", five(vectors.total("v"), "total"), five(F.get(vectors.cumsum("v"), 2), "third_sum"), (F.round(vectors.cross_sum("v", "v"), 4) + 0.0).alias("crossed"), five(vectors.lockstep_product(two, two), "lockstep"),
        (F.round(vectors.product(F.slice("v", 1, 3)), 6) + 0.0).alias("product"), five(vectors.midpoint(F.array(F.get("v", 0)), F.array(F.get("v", 1)))[0], "middle"), five(vectors.unit("v")[0], "unit"),
    )


@query("with w as (select unnest(string_split(p_name || ' ' || p_size, ' ')) as w from part) select count(*) filter (w <> '' and not regexp_matches(w, '^[0-9]+$'))::bigint as words, count(*) filter (regexp_matches(w, '^[0-9]+$'))::bigint as numbers, (select count(*) from part)::bigint as lines from w")
def line_words(spark, sf):
    return counting.line_word_counts(table(spark, sf, "part").select(F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("line")), "line")


_SETS = f"with e as (select o_orderstatus as st, split_part(e, '/', 1) as name, split_part(split_part(e, '/', 2), '-', 1)::bigint as start, split_part(split_part(e, '/', 2), '-', 2)::bigint as \"end\", split_part(e, '/', 3) as strand from (select o_orderstatus, {_ENTRY} as e from orders)), a as (select distinct name, start, \"end\", strand from e where st = 'F'), b as (select distinct name, start, \"end\", strand from e where st = 'O') "


def _entry_sets(spark, sf):
    key = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    e = _entries(spark, sf).join(key, "o_orderkey").select("o_orderstatus", coords.entry_parts("entry").alias("p"))
    return [e.filter(F.col("o_orderstatus") == s).select("p.*") for s in ("F", "O")]


@query(_SETS + "select * from a union select * from b")
def entry_union(spark, sf):
    return setops.set_operation("union", *_entry_sets(spark, sf))


@query(_SETS + "select name from a intersect select name from b")
def entry_names_intersect(spark, sf):
    return setops.set_operation("intersect", *_entry_sets(spark, sf), full=False)


@query(_SETS + "select * from a except select * from b")
def entry_difference(spark, sf):
    return setops.set_operation("difference", *_entry_sets(spark, sf))
