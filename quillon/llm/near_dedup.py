"""MinHash near-deduplication by chosen-path set similarity join (operator 1).

Each document is the set of its 5-word shingles. Documents with equal sets form a class whose least id stands for
it. A tree starts by branching the representatives on one minwise token; a node that is too large branches again
on one or two further minwise tokens chosen from its path (1/threshold branches are expected), and a small node is
compared exhaustively. Twelve trees miss a pair at the threshold with a chance of 6e-8 where first-level nodes are small;
where they must branch further the chance grows with the depth (README). Comparison in a node uses sketches; every link is then confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Rolling, WordHashes, at_rest, forget, mixed, over_arrow, raw, word_hashes, written
from .components import connected_components

WIDTH = 5
#: Minwise tokens in a sketch; agreement counts estimate similarity with a standard error of 0.054 at 0.75.
SKETCH = 64
#: Agreements that make a pair a candidate: a pair at a similarity of 0.75 has fewer with a chance of 6e-9.
AGREE = 27
#: Agreements that a strong candidate has.
STRONG = 54
#: Agreements with a leader that whatever links to one of its strong candidates has: distances add up to 0.41, less 4.6 standard errors.
HALO = 20
TREES = 12
#: A node of at most so many members is compared exhaustively.
SMALL = 128
#: A node above this branches in a Spark step of its own, so no task ever gathers more.
LARGE = 4096
DEPTH = 24
#: Followers of one leader that one verification task takes.
FOLLOWERS = 256
_MULTIPLIERS = mixed(np.arange(1, SKETCH + 1, dtype=np.uint64)) | np.uint64(1)


def shingles(text: bytes | None, hashes: WordHashes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a text; a shorter text is one shingle, no words give none."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    values = hashes.array(words)
    return np.unique(Rolling(values).windows(min(width, len(words))) ^ np.uint64(min(width, len(words))))


def sketch(found: np.ndarray) -> np.ndarray:
    """The minwise tokens of a set, 32 bits of each."""
    best = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 4096):
        part = found[at : at + 4096]
        np.minimum(best, (part[None, :] * _MULTIPLIERS[:, None]).min(axis=1), out=best)
    return (mixed(best) >> np.uint64(32)).astype(np.uint32)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, sig, sketch) of every document: the set's size, a 128-bit digest and the minwise tokens."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes = word_hashes()
        sizes, sigs, sketches = [], [], []
        for text in raw(batch.column(1)):
            found = shingles(text, hashes)
            sizes.append(len(found))
            sigs.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
            sketches.append(sketch(found).tobytes() if len(found) else None)
        return pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), pa.array(sketches, pa.binary())], ["doc_id", "n_shingles", "sig", "sketch"])

    return over_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id", "text"], "doc_id long, n_shingles long, sig binary, sketch binary", run)


def path_coordinates(path: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The one or two minwise tokens on which the nodes with these path hashes branch; the second is -1 two times in three."""
    draw = mixed(path.astype(np.uint64))
    first = (draw % np.uint64(SKETCH)).astype(np.int64)
    second = ((draw >> np.uint64(16)) % np.uint64(SKETCH)).astype(np.int64)
    return first, np.where((draw >> np.uint64(40)) % np.uint64(3) == 0, second, -1)


def _child(path: np.ndarray, coordinate: np.ndarray, value: np.ndarray) -> np.ndarray:
    return mixed(path.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + coordinate.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + value.astype(np.uint64))


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, SKETCH)


def first_level(reps: DataFrame) -> DataFrame:
    """(node, id): each representative in the first node of each tree."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens = _sketches(batch.column(1))[:, :TREES]
        trees = np.arange(TREES, dtype=np.uint64)
        nodes = _child(trees + np.uint64(1), trees, tokens)
        return pa.record_batch([pa.array(nodes.ravel().view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), TREES))], ["node", "id"])

    return over_arrow(reps, ["id", "sketch"], "node long, id long", run)


def branch(members: DataFrame) -> DataFrame:
    """(node, id, sketch) to the same one level deeper."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        nodes = batch.column(0).to_numpy().view(np.uint64)
        tokens = _sketches(batch.column(2))
        out, rows = [], []
        for coordinate in path_coordinates(nodes):
            take = np.flatnonzero(coordinate >= 0)
            out.append(_child(nodes[take], coordinate[take], tokens[take, coordinate[take]]).view(np.int64))
            rows.append(take)
        take = pa.array(np.concatenate(rows))
        return pa.record_batch([pa.array(np.concatenate(out)), batch.column(1).take(take), batch.column(2).take(take)], ["node", "id", "sketch"])

    return over_arrow(members, ["node", "id", "sketch"], "node long, id long, sketch binary", run)


def _leaves(node: int, tokens: np.ndarray, ids: np.ndarray, small: int) -> Iterator[np.ndarray]:
    """Positions of the members of each small node under this one."""
    todo = [(np.uint64(node), np.arange(len(ids)), 0)]
    while todo:
        path, members, depth = todo.pop()
        if len(members) < 2:
            continue
        if len(members) <= small:
            yield members
            continue
        if depth == DEPTH or (tokens[members] == tokens[members[0]]).all():
            order = members[np.argsort(ids[members], kind="stable")]  # sketches that agree throughout: blocks that share the leader
            for at in range(1, len(order), small - 1):
                yield np.concatenate([order[:1], order[at : at + small - 1]])
            continue
        for coordinate in path_coordinates(np.array([path])):
            c = int(coordinate[0])
            if c < 0:
                continue
            values = tokens[members, c]
            order = np.argsort(values, kind="stable")
            cuts = np.flatnonzero(np.diff(values[order])) + 1
            for group in np.split(members[order], cuts):
                if len(group) > 1:
                    child = _child(np.array([path]), np.array([c]), tokens[group[:1], c])[0]
                    todo.append((child, group, depth + 1))


def _agreements(tokens: np.ndarray) -> np.ndarray:
    """How many minwise tokens each pair of rows shares."""
    n = len(tokens)
    out = np.zeros((n, n), np.int16)
    for k in range(tokens.shape[1]):
        out += tokens[:, k][:, None] == tokens[:, k][None, :]
    return out


def _stars(tokens: np.ndarray, tries: int = 256) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(leader, followers, agreements with every member) in a large node: the least member leads all strong candidates of its own, the least of the rest theirs, and so on.

    Trees share leaders this way, so a group of copies yields few pairs however many trees see it.
    """
    free = np.ones(len(tokens), bool)
    for i in range(len(tokens)):
        if not free[i]:
            continue
        same = (tokens == tokens[i]).sum(axis=1)
        found = i + 1 + np.flatnonzero((same[i + 1 :] >= STRONG) & free[i + 1 :])
        if len(found):
            yield i, found, same
        free[found] = False
        tries -= 1
        if not tries:
            return


def compare_nodes(members: DataFrame, small: int = SMALL) -> DataFrame:
    """(node, id, sketch) sorted by node to candidate pairs.

    A node with few candidates yields all of them. A dense one yields, for each member, its least strong partner
    (or its best), and its members under `dense` for the second round. A large node yields its stars, and the small nodes
    below it for the second round; a crowd of near copies is taken out before it would follow every branch. Rows: (a, b, dense, sketch).
    """

    def flush(node: int, ids: list, sketches: list, out: list) -> None:
        order = np.unique(np.array(ids, np.int64), return_index=True)[1]
        if len(order) < 2:
            return
        keys = np.array(ids, np.int64)[order]
        tokens = np.frombuffer(b"".join(sketches[i] for i in order), np.uint32).reshape(-1, SKETCH)
        large = len(keys) > small
        rest = np.arange(len(keys))
        if large:
            inside = np.zeros(len(keys), bool)
            for i, found, alike in _stars(tokens):
                out.extend((int(keys[i]), int(keys[j]), 0, None) for j in found)
                if len(found) >= small // 2:  # a crowd goes no deeper: with all that one of it may link to, it waits for the second round
                    crowd = np.union1d(np.flatnonzero(alike >= HALO), np.append(found, i))
                    key = int(mixed(np.array([np.uint64(node) ^ np.uint64(i + 1)]))[0].view(np.int64))
                    out.extend((key, int(keys[j]), 1, tokens[j].tobytes()) for j in crowd)
                    inside[i] = inside[found] = True
            rest = np.flatnonzero(~inside)
        for nth, leaf in enumerate(_leaves(node, tokens[rest], keys[rest], small)):
            own = np.sort(rest[leaf])
            same = np.triu(_agreements(tokens[own]), 1)
            pairs = np.argwhere(same >= AGREE)
            if not len(pairs):
                continue
            if not large and len(pairs) <= 4 * len(own):
                out.extend((int(keys[own[i]]), int(keys[own[j]]), 0, None) for i, j in pairs)
                continue
            for j in range(1, 0 if large else len(own)):
                near = same[:j, j]
                strong = np.flatnonzero(near >= STRONG)
                i = strong[0] if len(strong) else int(near.argmax())
                if near[i] >= AGREE:
                    out.append((int(keys[own[i]]), int(keys[own[j]]), 0, None))
            key = int(mixed(np.array([np.uint64(node) + np.uint64(nth)]))[0].view(np.int64))
            out.extend((key, int(keys[i]), 1, tokens[i].tobytes()) for i in own)

    return _by_node(members, flush, ["node", "id", "sketch"], "a long, b long, dense int, sketch binary")


def linked(own: np.ndarray, other: np.ndarray) -> bool:
    """Whether two sorted sets have 100 * intersection >= 75 * union."""
    if not len(own) or 4 * min(len(own), len(other)) < 3 * max(len(own), len(other)):
        return False
    place = np.searchsorted(own, other)
    shared = int((own[np.minimum(place, len(own) - 1)] == other).sum())
    return 100 * shared >= 75 * (len(own) + len(other) - shared)


def compare_dense(members: DataFrame) -> DataFrame:
    """(node, id, sketch, component, grams) to links on full sets that join different components, within each node.

    Candidate pairs are tried from the most alike on; a pair that earlier links already join is passed over, so a node yields fewer links
    than it has members and no two components that any pair of the node links stay apart.
    """

    def flush(node: int, ids: list, sketches: list, comps: list, grams: list, out: list) -> None:
        parent = {c: c for c in comps}
        if len(parent) < 2:
            return

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        comp = np.array(comps, np.int64)
        same = np.triu(_agreements(np.frombuffer(b"".join(sketches), np.uint32).reshape(-1, SKETCH)), 1)
        same[comp[:, None] == comp[None, :]] = 0
        pairs = np.argwhere(same >= AGREE)
        sets = [np.frombuffer(g, np.uint64) for g in grams]
        for i, j in pairs[np.argsort(-same[pairs[:, 0], pairs[:, 1]], kind="stable")]:
            a, b = root(comps[i]), root(comps[j])
            if a != b and linked(sets[i], sets[j]):
                parent[b] = a
                out.append((ids[i], ids[j]))

    return _by_node(members, flush, ["node", "id", "sketch", "component", "grams"], "a long, b long")


def _by_node(members: DataFrame, flush, columns: list[str], schema: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    kinds = [types[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, held, out = None, [[] for _ in columns[1:]], []

        def table() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            out.clear()
            return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for key, *rest in zip(*cols, strict=True):
                if key != node:
                    if len(held[0]) > 1:
                        flush(node & 0xFFFFFFFFFFFFFFFF, *held, out)
                    node, held = key, [[] for _ in columns[1:]]
                for to, value in zip(held, rest, strict=True):
                    to.append(value)
            if len(out) > 5000:
                yield table()
        if len(held[0]) > 1:
            flush(node & 0xFFFFFFFFFFFFFFFF, *held, out)
        if out:
            yield table()
        batch = cols = held = None
        at_rest()

    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return members.select(*columns).repartition(parts, "node").sortWithinPartitions("node").mapInArrow(run, schema)


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) to those with 100 * intersection >= 75 * union of their full sets (id, grams).

    a leads: its set is sent once for each FOLLOWERS of its partners, a partner's set once for each pair, so no task takes a hub's whole following.
    """
    shares = pairs.groupBy("a").agg(F.count("*").alias("n"))
    lead = shares.select("a", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / FOLLOWERS).cast("int"))).alias("part"), F.ceil(F.col("n") / FOLLOWERS).cast("int").alias("parts"))
    follow = pairs.join(shares.select("a", F.ceil(F.col("n") / FOLLOWERS).cast("int").alias("parts")), "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts").cast("long")).cast("int").alias("part"))
    rows = lead.join(sets.withColumnRenamed("id", "a"), "a").select("a", "part", F.lit(0).alias("kind"), F.col("a").alias("b"), "grams")
    rows = rows.union(follow.join(sets.withColumnRenamed("id", "b"), "b").select("a", "part", F.lit(1).alias("kind"), "b", "grams"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            left, right = [], []
            for a, kind, b, grams in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = np.frombuffer(grams, np.uint64)
                if not kind:
                    leader, own = a, found
                elif a == leader and linked(own, found):
                    left.append(a)
                    right.append(b)
            if left:
                yield pa.record_batch([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])
        batch = own = found = None
        at_rest()

    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "a", "part").sortWithinPartitions("a", "part", "kind").select("a", "kind", "b", "grams").mapInArrow(run, "a long, b long")


def full_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, sig, grams): the packed full sets of the documents with these ids, and their digests."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes = word_hashes()
        sets = [shingles(t, hashes).tobytes() for t in raw(batch.column(1))]
        return pa.record_batch([batch.column(0), pa.array(map(xxhash.xxh3_128_digest, sets), pa.binary()), pa.array(sets, pa.binary())], ["id", "sig", "grams"])

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(ids.hint("merge"), "id", "left_semi")
    return over_arrow(rows, ["id", "text"], "id long, sig binary, grams binary", run)


def least_sets(sets: DataFrame) -> DataFrame:
    """(id, sig, grams) to one set (id, grams) of each id, the one of least digest."""
    return sets.groupBy("id").agg(F.min_by("grams", "sig").alias("grams"))


def near_duplicates(spark: SparkSession, docs: DataFrame, small: int = SMALL, large: int = LARGE) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id (least doc_id reachable over links), kept.

    Null or wordless texts have an empty set, link with nothing and stay. A null doc_id has a null component and is kept.
    Rows with one doc_id count as one document: they share a component, and of their different sets the one of least digest is compared. Other
    columns of docs are ignored.
    """
    sigs = written(signatures(docs), "dedup-signatures")
    classes = written(sigs.filter("sig is not null and doc_id is not null").groupBy("sig").agg(F.min("doc_id").alias("rep")), "dedup-classes")
    reps = sigs.join(classes.withColumnRenamed("rep", "doc_id"), ["sig", "doc_id"], "left_semi").groupBy(F.col("doc_id").alias("id")).agg(F.min(F.struct("sig", "sketch")).alias("least")).select("id", "least.sketch")
    first = first_level(reps)
    shared = first.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1")
    level = written(first.join(shared, "node").join(reps, "id").select("node", "id", "sketch", "n"), "dedup-nodes")
    leaves, tables = level.filter(F.col("n") <= large).drop("n"), [level]
    hot, depth = level.filter(F.col("n") > large).drop("n"), 1
    while hot.limit(1).count():  # hot nodes: one Spark step for each level, so they spread over tasks
        deeper = branch(hot)
        counts = deeper.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1")
        level = written(deeper.join(counts, "node").select("node", "id", "sketch", "n"), "dedup-nodes")
        tables.append(level)
        leaves = leaves.union(level.filter(F.col("n") <= large).drop("n"))
        hot, depth = level.filter(F.col("n") > large).drop("n"), depth + 1
        if depth == DEPTH:  # sketches that agree throughout: blocks that share the leader
            lead = hot.groupBy("node").agg(F.min("id").alias("lead"), F.count("*").alias("n"))
            block = hot.join(lead, "node").withColumn("block", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / (large // 2))))
            star = block.select(F.col("lead").alias("a"), F.col("id").alias("b")).filter("a <> b")
            leaves = leaves.union(block.select(F.xxhash64("node", "block").alias("node"), "id", "sketch"))
            break
    else:
        star = None
    found = written(compare_nodes(leaves, small), "dedup-candidates")
    pairs = found.filter("dense = 0").select("a", "b")
    pairs = written((pairs.union(star) if star is not None else pairs).distinct(), "dedup-pairs")
    dense = found.filter("dense = 1").select(F.col("a").alias("node"), F.col("b").alias("id"), "sketch")
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(dense.select("id")).distinct()
    sets = written(least_sets(full_sets(docs, ids)), "dedup-sets")
    for table in tables:
        forget(table)
    links = written(confirm(pairs, sets), "dedup-links")
    if dense.limit(1).count():  # second round: what the sparse links of dense nodes leave apart is compared in full
        comps = connected_components(links)
        apart = dense.join(comps, "id", "left").select("node", "id", "sketch", F.coalesce("component", "id").alias("component"))
        split = apart.groupBy("node").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi")
        links = links.union(written(compare_dense(apart.join(split, "node", "left_semi").join(sets, "id")), "dedup-links"))
        forget(comps)
    comps = connected_components(links)
    ids = classes.join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("sig", F.coalesce("component", "rep").alias("component"))
    rows = sigs.select("doc_id", "n_shingles", "sig").join(ids, "sig", "left")
    return rows.select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that stay: one of each group of linked documents, one row of each doc_id (that of least text), and every row without a doc_id."""
    own = "_" * (1 + max(map(len, docs.columns)))  # a name that docs hasn't
    ids = near_duplicates(spark, docs).filter("kept and doc_id is not null").select(F.col("doc_id").alias(own)).distinct()
    rows = docs.join(ids, docs["doc_id"].cast("long") == F.col(own), "left_semi")
    rows = rows.withColumn(own, F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).filter(F.col(own) == 1).drop(own)
    return rows.unionByName(docs.filter("doc_id is null"))
