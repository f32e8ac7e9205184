"""Personal data by patterns and information-theoretic sanitisation (operator 3). Only DataFrame expressions are used.

Patterns find protected entities. Words of a document with an entity are candidates for disclosing it: over the corpus, a term t
reveals an entity e when their pointwise mutual information is close to the information of the entity itself,
log2 P(e | t) / P(e) >= share * -log2 P(e). An entity is a value or the group it belongs to: an address's host, a network, a card's issuer,
a number's area. A term that reveals a value is removed from every document with it; one that reveals a group only is generalised to what sort
of word it is. Copies of one context count once as evidence, and a term needs several different contexts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

_LOCAL, _HOST = "A-Za-z0-9._%+-", "A-Za-z0-9-"
#: Patterns of each kind, in the order of the report. \G and the look-behinds keep a long run from being tried at each of its
#: characters, and possessive groups keep the matcher's stack flat; neither changes what matches.
KINDS = (
    ("email", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_HOST}]++(?:\.[{_HOST}]++)++"),
    ("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+"),
    ("card", r"[0-9](?:[\x20-]?[0-9])++"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)
#: Stands for a base span where the words around it are read.
_BLANK = "\uffff"
#: Words on either side of an entity whose different surroundings count as evidence within one document too, and the characters read for them.
NEAR, READ = 4, 96
#: Share of an entity's information that a term must reveal, and the different contexts that must show it.
DISCLOSURE, CONTEXTS = 0.9, 3
#: Share of documents up to which a group of values counts as an entity; what more documents show is nobody's secret (6.6 bits at most).
COMMON = 0.01
#: Disclosing terms that may be broadcast; beyond, document frequencies come by a shuffled join.
BROADCAST_TERMS = 500_000

_SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    places = F.transform(F.split(F.reverse(digits), ""), lambda c, i: c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1))
    return F.aggregate(places, F.lit(0), lambda a, x: a + F.coalesce(F.when(x > 9, x - 9).otherwise(x), F.lit(0))) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        trimmed = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(trimmed(p)) <= 3) & (F.coalesce(F.substring(trimmed(p), 1, 3).cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(_digits(value)).between(16, 19) & _luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def spans_of(df: DataFrame, text: str, kind: str, pattern: str, needs: Column) -> DataFrame:
    """df with a column of the kind's spans: code-point offsets from the lengths of matches and of what is between them."""
    found, between = f"_{kind}_found", f"_{kind}_between"
    df = df.withColumn(found, F.when(needs, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    df = df.withColumn(between, F.when(F.size(found) > 0, F.split(text, pattern, -1)).otherwise(F.array().cast("array<string>")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("spans"))

    def step(acc: Column, pair: Column) -> Column:
        begin = acc["at"] + F.length(pair["b"])
        end = begin + F.length(pair["f"])
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), pair["f"].alias("value"))
        return F.struct(end.alias("at"), F.when(_valid(kind, pair["f"]), F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    pairs = F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda f, b: F.struct(f.alias("f"), b.alias("b")))
    return df.withColumn(kind, F.when(F.size(found) > 0, F.aggregate(pairs, start, step, lambda a: a["spans"])).otherwise(F.array().cast(_SPAN))).drop(found, between)


def base_spans(docs: DataFrame, carried: tuple[Column, ...] = ()) -> DataFrame:
    """doc_id, text, carried columns and `base`: the valid spans by kind, then start. A null text counts as empty."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *carried)
    digit = F.col("text").rlike("[0-9]")
    needs = {"email": F.contains("text", F.lit("@")), "phone": F.contains("text", F.lit("+")) & digit, "ip": digit, "card": digit}
    for kind, pattern in KINDS:
        rows = spans_of(rows, "text", kind, pattern, needs[kind])
    return rows.withColumn("base", F.concat(*(k for k, _ in KINDS))).drop(*(k for k, _ in KINDS))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), lambda w: F.length(w) > 0)


def free_words(text: Column, base: Column) -> Column:
    """The distinct lower-case words of a text that no base span touches."""
    letters = r"[\p{L}\p{M}\p{N}]"
    blanked = F.regexp_replace(_cleaned(text, base, F.lit(_BLANK)), rf"(?:(?<!{letters}){letters}++)?+{_BLANK}{letters}*+", " ")
    return F.array_distinct(_words(F.when(F.size(base) > 0, blanked).otherwise(text)))


def _group(kind: Column, value: Column) -> Column:
    """The group of values that one belongs to: host, network of three numbers, six digits of a card, four of a phone."""
    digits = _digits(value)
    part = F.when(kind == "email", F.substring_index(value, "@", -1)).when(kind == "ip", F.substring_index(value, ".", 3))
    return F.concat(kind, F.lit(":"), part.when(kind == "card", F.substring(digits, 1, 6)).otherwise(F.substring(digits, 1, 4)))


def disclosing_terms(rows: DataFrame) -> DataFrame | None:
    """(doc_id, terms, hints): the terms to remove from each document and those to generalise, None if the corpus has neither.

    rows: doc_id, text, base. Each word of a document with an entity is a candidate, wherever it stands outside the base spans. Evidence are
    different texts (by the least hash of their 5-word runs, so near copies mostly count once) or different surroundings of the entity
    with the word near. What can't have enough evidence, or fails already against the documents with entities, isn't counted over the corpus.
    """
    spark = rows.sparkSession
    some = rows.filter("size(base) > 0 and doc_id is not null")
    left = F.substring(F.col("text"), F.greatest(F.col("s.start") - READ + 1, F.lit(1)), F.least(F.col("s.start"), F.lit(READ)))
    right = F.substring(F.col("text"), F.col("s.end") + 1, F.lit(READ))
    near = F.array_distinct(F.concat(F.slice(F.reverse(_words(left)), 1, NEAR), F.slice(_words(right), 1, NEAR)))
    run = _words(F.col("text"))
    about = F.array_min(F.transform(F.sequence(F.lit(1), F.greatest(F.size("_run") - 4, F.lit(1))), lambda i: F.xxhash64(F.slice("_run", i, 5))))
    seen = some.withColumn("_run", run).select("doc_id", "text", about.alias("about"), F.explode("base").alias("s"))
    value = F.lower("s.value")
    named = F.explode(F.array(F.struct(value.alias("entity"), F.lit(False).alias("grouped")), F.struct(_group(F.col("s.kind"), value).alias("entity"), F.lit(True).alias("grouped")))).alias("e")
    seen = written(seen.select("doc_id", "about", named, near.alias("near"), F.xxhash64(left, right).alias("context")).select("doc_id", "about", "e.*", "near", "context"), "pii-entities")
    total = rows.count()
    p_e = F.col("df_e") / F.lit(float(total))
    reveals = lambda p_e_t: F.log2(p_e_t / p_e) >= DISCLOSURE * -F.log2(p_e)
    entities = seen.groupBy("entity", "grouped").agg(F.countDistinct("doc_id").alias("df_e"), F.countDistinct("about").alias("texts"), F.countDistinct("context").alias("contexts"))
    entities = written(entities.filter((F.greatest("texts", "contexts") >= CONTEXTS) & (p_e < 1) & (~F.col("grouped") | (p_e <= COMMON))).select("entity", "df_e", "grouped"), "pii-counts")
    mentions = seen.select("doc_id", "about", "entity", "grouped").distinct().join(entities, ["entity", "grouped"])
    words = some.select("doc_id", F.explode(free_words(F.col("text"), F.col("base"))).alias("term")).filter(F.length("term") > 1).distinct()
    words = written(words, "pii-words")
    around = words.groupBy("term").agg(F.count("*").alias("df_around"))
    words = words.join(around, "term").join(mentions.select("doc_id").distinct(), "doc_id", "left_semi")
    # documents with the term and some entity are among those with the term, so what fails here fails on the whole corpus
    together = mentions.join(words, "doc_id").filter(reveals(F.least(F.col("df_e") / F.col("df_around"), F.lit(1.0))))
    together = written(together.select("doc_id", "about", "entity", "grouped", "term", "df_e", "df_around"), "pii-together")
    close = seen.select("entity", F.explode("near").alias("term"), "context").distinct().groupBy("entity", "term").agg(F.count("*").alias("contexts")).filter(F.col("contexts") >= CONTEXTS)
    pairs = together.groupBy("entity", "term").agg(F.max("df_e").alias("df_e"), F.max("df_around").alias("df_around"), F.countDistinct("doc_id").alias("df_te"), F.countDistinct("about").alias("texts"))
    pairs = pairs.filter(reveals(F.col("df_te") / F.col("df_around"))).join(close, ["entity", "term"], "left")
    pairs = pairs.filter(F.greatest("texts", F.coalesce("contexts", F.lit(0))) >= CONTEXTS)
    strong = written(pairs.select("entity", "term", "df_e", "df_te"), "pii-pairs")
    terms = strong.select("term").distinct()
    n_terms = terms.count()
    if not n_terms:
        return None
    words = rows.select(F.explode(free_words(F.col("text"), F.col("base"))).alias("term"))
    if n_terms <= BROADCAST_TERMS:
        words = words.join(F.broadcast(terms), "term", "left_semi")
        df = words.groupBy("term").agg(F.count("*").alias("df"))
    else:
        df = words.groupBy("term").agg(F.count("*").alias("df")).join(terms, "term", "left_semi")
    revealing = strong.join(df, "term").filter(reveals(F.least(F.col("df_te") / F.col("df"), F.lit(1.0))))
    revealing = written(revealing.select("entity", "term"), "pii-revealing")
    n_revealing = revealing.count()
    if not n_revealing:
        return None
    by_pair = F.broadcast(revealing) if n_revealing <= BROADCAST_TERMS else revealing
    own = together.join(by_pair, ["entity", "term"], "left_semi").groupBy("doc_id")
    own = own.agg(F.collect_set(F.when(~F.col("grouped"), F.col("term"))).alias("terms"), F.collect_set("term").alias("hints"))
    return written(own.select("doc_id", "terms", F.array_except("hints", "terms").alias("hints")), "pii-doc-terms")


def term_spans(rows: DataFrame) -> DataFrame:
    """rows with `extra`: spans of the words in `terms` (kind term) and `hints` (kind number or word) that no base span touches."""
    pattern = r"[\p{L}\p{M}\p{N}]+"
    none = F.array().cast("array<string>")
    rows = rows.withColumn("terms", F.coalesce("terms", none)).withColumn("hints", F.coalesce("hints", none))
    rows = spans_of(rows, "text", "term", pattern, F.size("terms") + F.size("hints") > 0)
    free = lambda s: ~F.exists("base", lambda b: (s["start"] < b["end"]) & (b["start"] < s["end"]))
    sort = lambda s: F.when(F.array_contains("terms", F.lower(s["value"])), "term").when(s["value"].rlike(r"^\p{N}+$"), "number").otherwise("word")
    named = lambda s: F.struct(sort(s).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))
    mine = F.filter("term", lambda s: (F.array_contains("terms", F.lower(s["value"])) | F.array_contains("hints", F.lower(s["value"]))) & free(s))
    return rows.withColumn("extra", F.sort_array(F.transform(mine, named))).drop("term")


def _report(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _cleaned(text: Column, spans: Column, mark: Column | None = None) -> Column:
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.upper(s["kind"]).alias("tag"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        piece = F.concat(F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), F.concat(F.lit("["), s["tag"], F.lit("]")) if mark is None else mark)
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.array_append(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(order, start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.greatest(F.length(text) - a["at"], F.lit(0)))))


def sanitise(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_report, spans, clean_text.

    clean_text has each span replaced by its kind in brackets, after the base kinds `term`, `number` and `word` by kind, then start; overlapping spans become one. Null texts count as empty. Rows with a null
    doc_id get the pattern spans only; rows of one doc_id share their terms. An empty table gives no rows. Other columns are ignored.
    """
    rows = _spanned(docs)
    spans = F.concat("base", "extra")
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    counts = [of(kind).alias(f"n_{kind}") for kind, _ in KINDS]
    return rows.select("doc_id", *counts, _report(F.col("base")).alias("base_report"), _report(spans).alias("spans"), _cleaned(F.col("text"), spans).alias("clean_text"))


def sanitised_rows(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with every text sanitised (null stays null), n_chars (if there) its new length, and all other columns as they were."""
    rows = _spanned(docs, (F.struct(*docs.columns).alias("_row"),))
    clean = F.when(F.col("_row")["text"].isNotNull(), _cleaned(F.col("text"), F.concat("base", "extra")))
    rows = rows.select("_row", clean.alias("_clean"))
    new = {"text": F.col("_clean"), "n_chars": F.length("_clean")}
    return rows.select(*(new.get(c, F.col("_row")[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))


def _spanned(docs: DataFrame, carried: tuple[Column, ...] = ()) -> DataFrame:
    rows = base_spans(docs, carried)
    terms = disclosing_terms(base_spans(docs))
    if terms is None:
        rows = rows.withColumn("extra", F.array().cast(_SPAN))
    else:
        rows = term_spans(rows.join(terms, "doc_id", "left"))
    return rows
