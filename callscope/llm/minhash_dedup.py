"""MinHash near-duplicate groups.

A document's set holds the distinct hashes of its word shingles. Equal sets
collapse to one class first, however many copies there are. A class keeps the
minima of many universal hashes; bands of them key buckets. In a bucket every
member is compared with two hubs instead of with every other member: the
signatures first, then the full sets. The verified links make components by
alternating large-star and small-star. Members of buckets that are then still in
several components are compared across components, by an exact prefix filter:
with shingles in order of rarity, two similar sets share one of their first few,
so a family that shares boilerplate only yields no pairs. A shingle that very many
of these prefixes hold is compared in blocks, which only links leave. So no link
that a bucket shows is lost.

Defined results: a null or empty text has an empty set and is linked with
nothing; a null doc_id is kept and has a null component; rows that share a
doc_id but not a text are documents of their own, in the order of the texts'
hashes; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callscope.llm.common import gram_hashes, is_small, join_ids, release, slices, stage_table, text_tie, utf8, word_hashes

#: Bands of hashes: at similarity 0.8 a pair shares no bucket with probability 4e-7.
BANDS, ROWS = 28, 4
#: Signatures that agree in less than the threshold less this share are not compared in full (over six deviations).
SLACK = 0.25

#: Members of a shingle's group up to which its pairs are formed; beyond it blocks are compared.
PAIRED = 64
#: Pairs of a hub that are compared in one part.
HUB_PART = 512
#: Rows of one set from which its class is looked up by broadcast instead of by a shuffle.
HOT_CLASS = 20_000
#: Documents of either side of a block of the exact comparison.
QUERY_BLOCK, MEMBER_BLOCK = 256, 1024

_RNG = np.random.RandomState(20240229)
_A = _RNG.randint(0, 2**63 - 1, BANDS * ROWS, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.randint(0, 2**63 - 1, BANDS * ROWS, dtype=np.int64).astype(np.uint64)
_CHUNK = 1024


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles; of the whole sequence if there are fewer words."""
    h = word_hashes((text or b"").lower().split())  # bytes.lower() folds A-Z only
    return np.unique(gram_hashes(h, min(k, len(h)) or 1))


def signature(hashes: np.ndarray) -> np.ndarray:
    """Minima of the universal hashes (a x + b) mod 2^64, upper halves."""
    low = np.full(len(_A), 2**32 - 1, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), _CHUNK):
            x = hashes[at : at + _CHUNK]
            low = np.minimum(low, ((x[None, :] * _A[:, None] + _B[:, None]) >> np.uint64(32)).min(axis=1))
    return low.astype(np.uint32).view(np.int32)


def _signer(k: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, keys, sigs = [], [], []
            for data in batch.column("text"):
                s = shingle_set(data.as_py(), k)
                sizes.append(len(s))
                keys.append(hashlib.md5(s.tobytes()).digest() if len(s) else None)
                sigs.append(signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("tie"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.list_(pa.int32()))],
                ["doc_id", "tie", "n_shingles", "set_key", "sig"],
            )

    return sign


def _setter(k: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [shingle_set(data.as_py(), k).view(np.int64) for data in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "hashes"])

    return sets


def large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the node's least neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")


def small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge down, or only edges from above."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down")).union(edges.select("v", F.lit(0)))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.count(F.lit(1)).alias("all")).where("down > 1 or (down = 1 and all > 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge (u, v); the component is its least node."""
    edges = small_star(edges.select("u", "v").where("u != v")).checkpoint()
    while not _are_stars(edges):
        edges = small_star(large_star(edges)).checkpoint()
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())


def near_duplicates(docs: DataFrame, k: int = 5, threshold_percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row."""
    return _grouped(docs, k, threshold_percent).drop("tie")


def _grouped(docs: DataFrame, k: int, threshold_percent: int) -> DataFrame:
    """``near_duplicates`` with ``tie``, the hash of the row's text."""
    rows = docs.select("doc_id", utf8())
    kind = rows.schema["doc_id"].dataType.simpleString()
    signed = rows.withColumn("tie", text_tie()).mapInArrow(_signer(k), f"doc_id {kind}, tie long, n_shingles long, set_key binary, sig array<int>")
    signed = stage_table(signed, "signatures")
    # Where an id stands for several texts, documents are told apart by (id, hash of the text).
    named_twice = signed.where("doc_id is not null").groupBy("doc_id").agg(F.min("tie").alias("a"), F.max("tie").alias("b")).where("a != b")
    wide = not named_twice.isEmpty()
    node = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "tie")) if wide else F.col("doc_id")
    if wide:
        rows = rows.withColumn("tie", text_tie()).select(node.alias("doc_id"), "text")
        kind = rows.schema["doc_id"].dataType.simpleString()
    usable = signed.where("set_key is not null and doc_id is not null").withColumn("doc_id", node)
    classes = stage_table(
        usable.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.count(F.lit(1)).alias("rows")), "classes"
    )
    bands = [F.xxhash64(F.lit(b), *[F.get("sig", F.lit(ROWS * b + r)) for r in range(ROWS)]) for b in range(BANDS)]
    members = classes.select("rep", "n", F.explode(F.array(*bands)).alias("bucket"))
    hubs = [F.min("rep"), F.min_by("rep", F.xxhash64("rep", "bucket"))]  # the second differs from bucket to bucket
    counted = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.array(*hubs).alias("hubs")).where("size > 1")
    shared = stage_table(members.join(counted, "bucket").select("bucket", "size", "rep", "n", "hubs"), "buckets")  # buckets of one are gone

    pairs = _ordered(shared.select("rep", F.explode("hubs").alias("other")))
    links = stage_table(_verified(pairs, classes, rows, kind, k, threshold_percent), "links")
    comps = stage_table(components(links), "components")

    # Buckets whose members are still apart: what is left is compared across components.
    placed = _with_component(shared.where("size > 2"), comps)
    split = placed.groupBy("bucket").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where("least != most").select("bucket")
    apart = stage_table(placed.join(split, "bucket").select("rep", "comp").distinct(), "apart")
    release(shared)
    if not apart.isEmpty():
        more = stage_table(_across(apart, classes, rows, kind, k, threshold_percent), "more_links")
        if not more.isEmpty():
            stars = comps.select(F.col("node").alias("u"), F.col("component").alias("v"))
            comps = stage_table(components(stars.unionByName(more)), "components2")

    named = classes.join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left").select(
        "set_key", F.coalesce("component", "rep").alias("class_component")
    )
    # Rows without a set meet nothing; those of a set that very many rows have don't meet in one task.
    full, empty = signed.where("set_key is not null"), signed.where("set_key is null").withColumn("class_component", F.lit(None).cast(named.schema["class_component"].dataType))
    hot = stage_table(named.join(classes.where(F.col("rows") >= HOT_CLASS).select("set_key"), "set_key"), "hot_classes")
    if hot.isEmpty():
        out = full.join(named, "set_key", "left")
    elif is_small(hot.select("set_key")):
        rest = full.join(F.broadcast(hot.select("set_key")), "set_key", "left_anti")
        out = full.join(F.broadcast(hot), "set_key").unionByName(rest.join(named, "set_key", "left"))
    else:  # so many that none has a large share of the rows
        out = full.join(named, "set_key", "left")
    out = out.unionByName(empty).withColumn("node", node)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_component", "node"))
    out = out.select("doc_id", "tie", "n_shingles", component.alias("component"), "node")
    kept = F.coalesce(F.col("component") == F.col("node"), F.lit(True)).alias("kept")
    return out.select("doc_id", "tie", "n_shingles", F.col("component.doc_id" if wide else "component").alias("component_id"), kept)


def _ordered(pairs: DataFrame) -> DataFrame:
    pairs = pairs.where("rep != other")
    return pairs.select(F.least("rep", "other").alias("u"), F.greatest("rep", "other").alias("v")).distinct()


def _with_component(members: DataFrame, comps: DataFrame) -> DataFrame:
    named = members.join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left")
    return named.select("bucket", "rep", "n", "hubs", F.coalesce("component", "rep").alias("comp"))


def prefix_rows(apart: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(t, rep, comp, n, at, indexed) of the first shingles of each set, rarest first, that a similar set could share.

    A set of n with a similar one of at most n shares one of its first n - ceil(t n) + 1 shingles with the other's first
    m - ceil(2 t m / (1 + t)) + 1, which are ``indexed``.
    """
    rows = apart.join(sets.withColumnRenamed("doc_id", "rep"), "rep").select("rep", "comp", F.size("hashes").alias("n"), F.explode("hashes").alias("t"))
    held = rows.groupBy("t").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    order = Window.partitionBy("rep", "n").orderBy(F.coalesce("f", F.lit(1)), "t")  # a doc_id on several rows may have several sets
    ranked = rows.join(held, "t", "left").withColumn("at", F.row_number().over(order) - 1)
    ranked = ranked.where(F.col("f").isNotNull() & (F.col("at") <= F.col("n") - F.ceil(F.col("n") * percent / 100)))
    return ranked.select("t", "rep", "comp", "n", "at", (F.col("at") <= F.col("n") - F.ceil(F.col("n") * (2 * percent) / (100 + percent))).alias("indexed"))


def prefix_pairs(prefixes: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of different components whose prefixes meet, and whose sizes and places leave room for enough common shingles."""
    x, y = (prefixes.select("t", *[F.col(c).alias(f"{c}_{s}") for c in ("rep", "comp", "n", "at", "indexed")]) for s in "xy")
    need = F.ceil((F.col("n_x") + F.col("n_y")) * percent / (100 + percent))
    left = F.least(F.col("n_x") - F.col("at_x"), F.col("n_y") - F.col("at_y"))
    larger = (F.col("n_x") > F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("rep_x") > F.col("rep_y")))
    met = x.join(y.where("indexed_y"), "t").where(larger & (F.col("comp_x") != F.col("comp_y")) & (100 * F.col("n_y") >= percent * F.col("n_x")) & (left >= need))
    return _ordered(met.select(F.col("rep_x").alias("rep"), F.col("rep_y").alias("other")))


def _across(apart: DataFrame, classes: DataFrame, rows: DataFrame, kind: str, k: int, percent: int) -> DataFrame:
    """Links (u, v) between components, among the documents of ``apart`` (rep, comp)."""
    ids = apart.select(F.col("rep").alias("doc_id")).distinct()
    sets = stage_table(join_ids(rows, ids, "doc_id", "left_semi").mapInArrow(_setter(k), f"doc_id {kind}, hashes array<long>"), "apart_sets")
    prefixes = stage_table(prefix_rows(apart, sets, percent), "prefixes")
    groups = prefixes.groupBy("t").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("least"), F.max("comp").alias("most")).where("least != most")
    groups = stage_table(groups, "prefix_groups")
    few = prefixes.join(groups.where(F.col("size") <= PAIRED).select("t"), "t", "left_semi")
    links = _verified(prefix_pairs(few, percent), classes, rows, kind, k, percent)
    many = groups.where(F.col("size") > PAIRED).select("t", "least")
    if not many.isEmpty():
        hot = stage_table(prefixes.join(many, "t").select("rep", "comp", "least").distinct(), "hot")
        links = links.unionByName(_in_blocks(hot, sets, kind, percent))
    return links.distinct()


def _in_blocks(apart: DataFrame, sets: DataFrame, kind: str, percent: int) -> DataFrame:
    """Links (u, v) between components that meet in ``apart`` (rep, comp, least: a component that each meets).

    Components so joined are a family. Its members outside its largest component
    are compared with all of it in blocks: a task holds at most one block of
    either side, and only links leave it.
    """
    families = components(apart.select(F.col("comp").alias("u"), F.col("least").alias("v")).distinct())
    members = apart.select("rep", "comp").distinct().join(families.select(F.col("node").alias("comp"), F.col("component").alias("family")), "comp")
    members = stage_table(members, "family_members")
    sizes = members.groupBy("family", "comp").agg(F.count(F.lit(1)).alias("size"))
    plan = sizes.groupBy("family").agg(F.max_by("comp", F.struct("size", "comp")).alias("main"), F.sum("size").alias("all"), F.max("size").alias("largest"))
    blocks_of = lambda n, size: F.ceil(n / size).cast("int")
    plan = plan.select("family", "main", blocks_of(F.col("all") - F.col("largest"), QUERY_BLOCK).alias("nq"), blocks_of(F.col("all"), MEMBER_BLOCK).alias("nm"))
    dealt = members.join(plan, "family").withColumn("h", F.xxhash64("rep"))
    blocks = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    own = lambda n: F.pmod("h", n.cast("long")).cast("int")
    asked = dealt.where("comp != main").select("family", "rep", "comp", own(F.col("nq")).alias("q"), blocks(F.col("nm")).alias("m"), F.lit(True).alias("asks"))
    all_ = dealt.select("family", "rep", "comp", blocks(F.col("nq")).alias("q"), own(F.col("nm")).alias("m"), F.lit(False).alias("asks"))
    given = asked.unionByName(all_).join(sets.withColumnRenamed("doc_id", "rep"), "rep")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        left, right = group[group.asks], group[~group.asks]
        found: list[tuple] = []
        if len(left) and len(right):
            flat, place = np.unique(np.concatenate(right.hashes.to_list()), return_inverse=True)
            sizes_ = np.array([len(x) for x in right.hashes])
            starts = np.concatenate([[0], np.cumsum(sizes_)[:-1]])
            reps, comps_ = right.rep.to_numpy(), right.comp.to_numpy()
            for rep, comp, own_set in zip(left.rep, left.comp, left.hashes, strict=True):
                common = np.add.reduceat(np.isin(flat, own_set)[place], starts, dtype=np.int64)
                hit = (100 * common >= percent * (sizes_ + len(own_set) - common)) & np.array([c != comp for c in comps_], bool)
                found += [(rep, other) for other in reps[hit]]
        return pd.DataFrame(found, columns=["rep", "other"]) if found else pd.DataFrame({"rep": group.rep[:0], "other": group.rep[:0]})

    return _ordered(given.groupBy("family", "q", "m").applyInPandas(compare, f"rep {kind}, other {kind}"))


def _verified(pairs: DataFrame, classes: DataFrame, rows: DataFrame, kind: str, k: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets are similar: sizes and signatures sort out most others first."""
    side = lambda c: classes.select(F.col("rep").alias(c), F.col("n").alias(f"n{c}"), F.col("sig").alias(f"sig{c}"))
    near = pairs.join(side("u"), "u").where("nu > 0").join(side("v"), "v")
    near = near.where(f"100 * least(nu, nv) >= {percent} * greatest(nu, nv)")
    agree = F.size(F.filter(F.zip_with("sigu", "sigv", lambda a, b: a == b), lambda x: x))
    near = stage_table(near.where(agree >= int((percent / 100 - SLACK) * BANDS * ROWS)).select("u", "v", "nu", "nv"), "near")
    ids = near.select(F.col("u").alias("doc_id")).union(near.select("v")).distinct()
    # A doc_id on several rows may stand for several sets; each is tried.
    texts = join_ids(rows, ids, "doc_id", "left_semi")
    sets = stage_table(texts.mapInArrow(_setter(k), f"doc_id {kind}, hashes array<long>"), "sets")
    # The end with more pairs is the hub: its pairs are dealt in parts, and its set goes once to each part, not to each pair.
    ends = near.select(F.col("u").alias("hub")).unionByName(near.select(F.col("v").alias("hub")))
    degree = ends.groupBy("hub").agg(F.count(F.lit(1)).alias("degree"))
    of = lambda c: degree.select(F.col("hub").alias(c), F.col("degree").alias(f"d{c}"))
    sided = near.join(of("u"), "u").join(of("v"), "v")
    larger = F.col("du") >= F.col("dv")
    sided = sided.select(F.when(larger, F.col("u")).otherwise(F.col("v")).alias("hub"), F.when(larger, F.col("v")).otherwise(F.col("u")).alias("other"), F.ceil(F.greatest("du", "dv") / HUB_PART).cast("int").alias("parts"))
    sided = sided.withColumn("part", F.pmod(F.xxhash64("other"), F.col("parts").cast("long")).cast("int"))
    hubs = sided.select("hub", "part").distinct().join(sets.withColumnRenamed("doc_id", "hub"), "hub")
    given = sided.select("hub", "part", "other").join(sets.select(F.col("doc_id").alias("other"), F.col("hashes").alias("own")), "other")
    both = given.join(hubs, ["hub", "part"]).withColumn("common", F.size(F.array_intersect("own", "hashes")))
    alike = both.where(f"100 * common >= {percent} * (size(own) + size(hashes) - common)")
    return alike.select(F.least("hub", "other").alias("u"), F.greatest("hub", "other").alias("v")).distinct()


def drop_near_duplicates(docs: DataFrame, k: int = 5, threshold_percent: int = 80) -> DataFrame:
    """The documents' own columns, one document of each group: the one with the smallest id, once.

    A row is told by its id and the hash of its text, so of rows that share an id only those that duplicate another document go.
    Rows without an id stay. Texts are only joined with the narrow table of what goes.
    """
    grouped = stage_table(_grouped(docs, k, threshold_percent), "grouped")
    keys = ["__id", "__tie"]
    narrow = grouped.where("doc_id is not null").select(F.col("doc_id").alias("__id"), F.col("tie").alias("__tie"), "kept")
    gone = stage_table(narrow.where("not kept").select(*keys).distinct(), "gone")
    again = stage_table(narrow.where("kept").groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys), "again")
    rows = docs.withColumn("__id", F.col("doc_id")).withColumn("__tie", text_tie())
    kept = join_ids(rows, gone, keys, "left_anti")
    if not again.isEmpty():  # a document given twice under one id is one document
        first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])))
        once = join_ids(kept, again, keys, "left_semi").withColumn("__rank", first).where("__rank = 1").drop("__rank")
        kept = join_ids(kept, again, keys, "left_anti").unionByName(once)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
