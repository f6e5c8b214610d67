"""SimHash near-duplicates by multi-index hashing.

A fingerprint of 64 bits is a majority vote over the hashes of a text's word shingles.  Two fingerprints link when
they differ in at most two bits.  Links are found in an index over the halves of a fingerprint: of two bits that
differ, either at most one lies in the upper half (which is then met in a Hamming ball of radius 1 around it), or both
do and the lower halves are equal.  So that a half shared by many fingerprints is no hot key, what is left of the
distance splits the other half into one part more than bits may differ there: one part is equal, and is in the key.

Scale: equal fingerprints are one node; each node looks up about 40 keys of 43 to 51 bits; every candidate is verified
in the join itself, so what comes out are true links.  Links per node are bounded by the Hamming ball (2,080).
Components come from contracting the linked nodes alone, down to a size that one task can join.

``deduplicated`` is the same method for a true similarity of 0.8: a wider fingerprint (``shingles``), an index over its
bands, likely parts of Hamming balls, and links verified by the sets themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from . import shingles
from .common import cut, swept

LINK_BITS = 2
#: Edges of a graph whose components one task finds (4 MB of them).
AT_ONCE = 1 << 18
#: Sets of a key that are compared in pairs, 4 a set at most; larger keys go by their differences from a centre.
PAIRED = 9
#: Sets of larger keys that a set is compared with, before that.
NEAREST = 3
#: Shingles voted on at a time, so that one very long text stays within a few MB.
VOTE_BLOCK = 65536


def fingerprint(text: str | None, words: int = 3) -> int:
    """The 64-bit fingerprint of one text, unsigned; 0 for a text that is null or has no word."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # on bytes both act on ASCII alone
    if not parts:
        return 0
    if len(parts) < words:
        return xxhash.xxh64_intdigest(b" ".join(parts), 42)
    votes, n = np.zeros(64, dtype=np.int64), len(parts) - words + 1
    for at in range(0, n, VOTE_BLOCK):
        own = [xxhash.xxh64_intdigest(b" ".join(parts[i : i + words]), 42) for i in range(at, min(n, at + VOTE_BLOCK))]
        bits = np.unpackbits(np.array(own, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
        votes += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


def fingerprint_column(text: Column | str, words: int = 3) -> Column:
    """Fingerprint as a signed long (the bits of the unsigned one)."""

    @pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64))

    return of(text)


def _part(bits: Column, width: int, parts: int, i: int) -> Column:
    """The ``i``-th of ``parts`` near-equal parts of the lowest ``width`` bits."""
    lo, hi = width * i // parts, width * (i + 1) // parts
    return F.shiftrightunsigned(bits, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))


def _key(kind: int, half: Column, part: Column) -> Column:
    """kind (0 to 7, below 2^3), a half (32 bits) and a part of the other (16 bits at most) in one long."""
    return F.lit(kind << 48).bitwiseOR(F.shiftleft(half, 16)).bitwiseOR(part)


def links(prints: DataFrame) -> DataFrame:
    """(a, b), both ways, for all distinct values of column ``fp`` that differ in 1 or 2 bits; no pair twice."""
    mask = F.lit((1 << 32) - 1)
    hi, lo = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(mask)
    same_hi = [_key(i, hi, _part(lo, 32, 3, i)) for i in range(3)]  # upper halves equal, up to 2 bits differ below
    same_lo = [_key(3 + i, lo, _part(hi, 32, 3, i)) for i in range(3)]  # lower halves equal
    one_off = [_key(6 + i, hi, _part(lo, 32, 2, i)) for i in range(2)]  # upper halves differ in one bit
    stored = prints.select("fp", F.explode(F.array(*same_hi, *same_lo, *one_off)).alias("key")).withColumnRenamed("fp", "b")
    # the ball around the upper half: only bits that are set are cleared, as the other fingerprint of the pair needn't look too
    bit = F.col("bit")
    ball = prints.select("fp", F.explode(F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: F.expr("shiftrightunsigned(fp, 32)").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) != 0)).alias("bit"))
    near = F.shiftrightunsigned("fp", 32).bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    ball = ball.select("fp", F.explode(F.array(*[_key(6 + i, near, _part(lo, 32, 2, i)) for i in range(2)])).alias("key"))
    looked = prints.select("fp", F.explode(F.array(*same_hi, *same_lo)).alias("key")).unionAll(ball).withColumnRenamed("fp", "a")
    wide = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).between(1, LINK_BITS)
    found = looked.join(stored, "key").where(wide).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return found.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("l")).select("l.a", "l.b")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and label of all edges of one task: a forest in which the least node of a tree is its root."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            low, high = sorted((root(up.setdefault(a, a)), root(up.setdefault(b, b))))
            up[high] = low
    if up:
        yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array([root(x) for x in up], pa.int64())], names=["node", "label"])


def components(edges: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """(node, label) for every node of ``edges`` (columns a, b, both ways): label is the least node of its component.

    Graphs of more than ``at_once`` edges shrink first: every node goes to the least node around it, then on to where that
    one goes, and edges are put between what is left.  As nodes are hashes, each round leaves a fraction of them, so rounds
    grow with the logarithm of the graph.  A graph within the bound is joined in one task.  Every round is cut at the
    shared checkpoint folder.
    """
    edges, rounds = cut(edges), []
    while edges.count() > at_once:
        near = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to"))
        far = near.select(F.col("node").alias("to"), F.col("to").alias("far"))
        step = cut(near.join(far, "to").select("node", F.least("to", "far").alias("label")))
        rounds.append(step)
        left = edges.join(step.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").select("la", "b")
        left = left.join(step.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
        edges = cut(left.where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct())
    labels = cut(edges.where("a < b").select("a", "b").repartition(1).mapInArrow(_joined, "node long, label long"))
    for step in reversed(rounds):
        last = labels.select(F.col("node").alias("label"), F.col("label").alias("root"))
        labels = step.join(last, "label", "left").select("node", F.coalesce("root", "label").alias("label"))
    return cut(labels) if rounds else labels


def grouped(nodes: DataFrame) -> DataFrame:
    """fp, label, component_id, n_links of every row of ``nodes`` (distinct fp, with least, its least doc_id), as a checkpoint.

    label is the least fingerprint of the component; component_id and n_links as in ``near_duplicates``.
    """
    nodes = cut(nodes)
    edges = cut(links(nodes.select("fp")))
    labels = components(edges)
    named = nodes.join(labels, nodes["fp"] == labels["node"]).groupBy("label").agg(F.min("least").alias("component_id"))
    linked = labels.join(named, "label").join(edges.groupBy("a").agg(F.count("*").alias("n_links")), F.col("node") == F.col("a")).select("node", "label", "component_id", "n_links")
    out = nodes.join(linked, nodes["fp"] == linked["node"], "left")
    own = F.when(F.col("label").isNull(), F.col("least")).otherwise(F.col("component_id"))
    return cut(out.select("fp", F.coalesce("label", "fp").alias("label"), own.alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")))


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hexadecimal digits), component_id, n_links.

    component_id is the least doc_id reachable over links (a document's own included); n_links counts the distinct
    other fingerprints linked to the document's.  Null and wordless texts have fingerprint 0 and are linked like any
    other; a row with a null doc_id keeps its fingerprint and component but lends it no id (null if no row of the
    component has one); repeated rows each come out; an empty table gives an empty result.
    """
    prints = cut(docs.select("doc_id", fingerprint_column("text", words).alias("fp")))
    of_node = grouped(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    return prints.join(of_node, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("l")).select("l.a", "l.b")


def similar_groups(nodes: DataFrame, sets_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, label) for every set of ``nodes`` (name, bands) that is linked: label is the least name of its component.

    Sets that meet in the ball around a band (``shingles.around``) and have a true similarity of 0.8 or more link.  Each
    candidate is decided once, by the cheapest way there is for it, so that a set takes few comparisons however large its group is:

    1. Keys of more than ``PAIRED`` sets: a set is compared with the ``NEAREST`` least sets that it meets in most keys.  The components
       so far name the groups, a key's by its most frequent one, and ``across`` finds all links inside a group that these leave out.
    2. Smaller keys: sets are compared with the least one of each key, then what is still apart in pairs.  Two sets that are in one
       group of the first step are left out, as they have been decided there.

    ``sets_of`` gives name and set of the names it gets.
    """
    keys = shingles.looked_up(cut(shingles.shared(shingles.banded(nodes))))
    held = cut(keys.join(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key"))
    sets = swept(sets_of(held.select("name").distinct()))
    large = held.where(F.col("n") > PAIRED)
    firsts = large.groupBy("key").agg(F.min("name").alias("first"))
    shared = large.join(firsts, "key").where("name <> first").groupBy("name", "first").agg(F.count("*").alias("times"))
    best = shared.groupBy("name").agg(F.slice(F.sort_array(F.collect_list(F.struct("times", "first")), asc=False), 1, NEAREST)["first"].alias("best"))
    stars = best.select(F.col("name").alias("a"), F.explode("best").alias("b"))
    labels = components(both_ways(shingles.similar(stars, sets).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))))

    at = cut(large.join(labels, large["name"] == labels["node"], "left").select("key", "name", F.coalesce("label", "name").alias("label")))
    parts = at.groupBy("key", "label").agg(F.count("*").alias("n"))
    mains = parts.groupBy("key").agg(F.max(F.struct("n", "label")).alias("m"), F.count("*").alias("parts")).where("parts > 1")
    open_ = swept(at.join(mains.select("key", F.col("m.label").alias("main")), "key").select("main", "name", "label").distinct())
    sure, maybe = across(open_, sets)

    in_groups = open_.groupBy("name").agg(F.collect_set("main").alias("mains"))
    known = sets.select("name").join(labels.withColumnRenamed("node", "name"), "name", "left").join(in_groups, "name", "left")
    known = known.select("name", F.coalesce("label", "name").alias("label"), F.coalesce("mains", F.array().cast("array<bigint>")).alias("mains"))
    small = held.where(F.col("n") <= PAIRED).join(known, "name")
    small = swept(small.join(small.groupBy("key").agg(F.min(F.struct("name", "label", "mains")).alias("first")), "key"))
    fresh = (F.col("name") != F.col("first.name")) & (F.col("label") != F.col("first.label")) & ~F.arrays_overlap("mains", "first.mains")
    stars = small.where(fresh).select(F.col("first.name").alias("a"), F.col("name").alias("b"))
    linked = shingles.similar(stars.unionAll(maybe).distinct(), sets)
    labels = components(both_ways(_to_labels(labels).unionAll(sure).unionAll(linked)))

    few = small.where("n > 2").join(labels.select(F.col("node").alias("name"), F.col("label").alias("now")), "name", "left")
    few = few.select("key", "name", "mains", F.coalesce("now", "name").alias("label"), F.col("first.name").alias("first"))
    apart = (F.col("x.key") == F.col("y.key")) & (F.col("x.name") < F.col("y.name")) & (F.col("x.label") != F.col("y.label"))
    pairs = few.where("name <> first").alias("x").join(few.alias("y"), apart & ~F.arrays_overlap("x.mains", "y.mains"))
    linked = swept(shingles.similar(pairs.select(F.col("x.name").alias("a"), F.col("y.name").alias("b")).distinct(), sets))
    return components(both_ways(_to_labels(labels).unionAll(linked)))


def _to_labels(labels: DataFrame) -> DataFrame:
    """Components as pairs (a, b), one a node but the root's."""
    return labels.where("node <> label").select(F.col("label").alias("a"), F.col("node").alias("b"))


def across(at: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) across components: links for certain, and those that may be similar; none that is similar is missing but
    those that these links join anyway.

    ``at`` has main (a group: the most frequent component of a key), name and label (its component so far).  The centre
    of a group is what more than half of its sets hold.  A set is given by its differences from the centre: m shingles
    missing, e more.  Two sets are similar if and only if 18 times the differences they share is u + u' or more, where
    u is 10 m + 8 e - size of the centre.  So the set of least u is linked to all with a sum of 0 or less, and any other pair
    shares a difference: at the first one, in an order that is one for the whole group and has the rare ones last, what is
    left of both lists must reach the sum.  Lists are pruned by these bounds before they meet, so that members of a
    large group that are similar to no other cost what their own differences cost.
    """
    part = cut(at.join(sets, "name"))
    size = part.groupBy("main").agg(F.count("*").alias("n"))
    counted = part.select("main", F.explode("set").alias("s")).groupBy("main", "s").agg(F.count("*").alias("c")).where("c > 1")
    inner = F.col("c") * 2 > F.col("n")
    often = counted.join(size, "main").where(F.col("c") * shingles.OFTEN >= F.col("n")).withColumn("differ", F.when(inner, F.col("n") - F.col("c")).otherwise(F.col("c")))
    centres = often.groupBy("main").agg(F.collect_list(F.when(inner, F.col("s"))).alias("centre"), F.sort_array(F.collect_list(F.struct("differ", "s")), asc=False)["s"].alias("often"))
    none = F.array().cast("array<bigint>")
    off = part.join(centres, "main", "left").withColumns({"centre": F.coalesce("centre", none), "often": F.coalesce("often", none)})
    off = off.withColumns({"gone": F.array_except("centre", "set"), "more": F.array_except("set", "centre")})
    off = off.withColumn("u", F.size("gone") * 10 + F.size("more") * 8 - F.size("centre")).withColumn("d", F.concat("gone", "more"))
    listed = F.concat(F.array_intersect("often", "d"), F.sort_array(F.array_except("d", "often")))
    off = cut(off.select("main", "name", "label", "u", listed.alias("listed")))

    middle = off.groupBy("main").agg(F.min(F.struct("u", "name", "label")).alias("mid"))
    near = F.col("u") + F.col("mid.u") <= 0
    off = off.join(middle, "main").withColumn("near", near).withColumn("label", F.when(near, F.col("mid.label")).otherwise(F.col("label"))).withColumn("apart", F.col("label") != F.col("mid.label"))
    sure = off.where(F.col("near") & (F.col("name") != F.col("mid.name"))).select(F.least("name", "mid.name").alias("a"), F.greatest("name", "mid.name").alias("b"))
    least = off.where("apart").groupBy("main").agg(F.min("u").alias("least"))  # of two components one at least isn't the middle's
    posted = off.join(least, "main").select("main", "name", "label", "apart", "u", F.when(F.col("apart"), F.col("mid.u")).otherwise(F.col("least")).alias("other"), F.posexplode("listed").alias("at", "s"))
    reach = (F.col("at") + 1) * 18 - F.col("u")  # a partner's u is this at most
    posted = cut(posted.select("main", "s", "name", "label", "apart", "u", "other", reach.alias("reach")).where("reach >= other").drop("other"))
    met = posted.groupBy("main", "s").agg(F.max("reach").alias("most"), F.min("u").alias("low"), F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 <> l1")
    kept = swept(posted.join(met, ["main", "s"]).where("reach >= low AND u <= most").select(posted.columns))
    x, y = kept.where("apart").alias("x"), kept.alias("y")
    once = ~F.col("y.apart") | (F.col("x.name") < F.col("y.name"))
    fit = (F.col("x.reach") >= F.col("y.u")) & (F.col("y.reach") >= F.col("x.u")) & (F.col("x.label") != F.col("y.label"))
    found = x.join(y, (F.col("x.main") == F.col("y.main")) & (F.col("x.s") == F.col("y.s")) & once & fit)
    return sure, found.select(F.least("x.name", "y.name").alias("a"), F.greatest("x.name", "y.name").alias("b")).distinct()


def deduplicated(docs: DataFrame, words: int = 5) -> DataFrame:
    """``docs`` with one row of each component of near copies: the one with the least doc_id (null last).

    Near copies have sets of ``words``-word shingles with a Jaccard similarity of 0.8 or more (null and wordless texts are
    alike, a text of fewer words is one shingle).  At that similarity fingerprints of 64 bits differ in about 10 bits and
    in up to 19, more than whole Hamming balls can hold: fingerprints are wider here, and the index over their bands is
    searched in the likely part of the ball around each (see ``shingles``).  Every link is verified by the sets.  Of rows
    that repeat that id the one with the least text hash stays, of exact repeats one; texts of any length are read whole;
    an empty table gives an empty result.
    """
    prints = docs.select(shingles.sketched("text", words).alias("s"), F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_th")).alias("row"))
    nodes = cut(prints.groupBy("s.name").agg(F.min("row").alias("row"), F.first("s").alias("s")))  # equal sets are one from here on
    texts = docs.select(F.col("doc_id").alias("_d"), F.xxhash64("text").alias("_tt"), "text")

    def sets_of(names: DataFrame) -> DataFrame:
        wanted = nodes.select("name", "row._id", "row._th").join(names, "name")
        found = texts.join(wanted, F.col("_d").eqNullSafe(F.col("_id")) & (F.col("_tt") == F.col("_th")))
        return found.dropDuplicates(["name"]).select("name", shingles.shingle_column("text", words).alias("set"))

    labels = similar_groups(nodes.select("name", "s.bands"), sets_of)
    grouped_rows = nodes.join(labels, nodes["name"] == labels["node"], "left").select("row", F.coalesce("label", "name").alias("label"))
    first = grouped_rows.groupBy("label").agg(F.min("row").alias("f")).select("f._id", F.col("f._th").alias("_of"))
    # one hash is the key of both the join and what drops repeats, so that texts move once; ids are compared besides
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("_d"), F.xxhash64("text").alias("_th"), F.xxhash64("doc_id", F.xxhash64("text")).alias("_k"))  # whatever names docs has
    first = first.withColumn("_ok", F.xxhash64("_id", "_of"))
    same = F.when(F.col("_d").isNull(), F.col("_id").isNull()).otherwise(F.col("_d") == F.col("_id")) & (F.col("_th").bitwiseXOR(F.col("_of")) == 0)
    kept = rows.join(first, (F.col("_k") == F.col("_ok")) & same)
    return kept.dropDuplicates(["_ok", "_id", "_of"]).select("doc.*")
