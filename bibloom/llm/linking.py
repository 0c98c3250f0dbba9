"""Verified links between items that share a bucket, without forming all pairs of a bucket.

Each item is first compared with one pivot, the least id among the first items of its buckets.
Where that leaves several components in a bucket, the items outside its largest one are compared
with a few members of it. What is still apart then is compared in full, in blocks: a block of
outsiders with a block of the bucket is one row, dealt out by bucket and both blocks, so that
neither the rows nor the memory of a task grow with the pairs. So a bucket of any number of
copies costs about its own size, and yet no two items that share a bucket and belong together
stay apart: they are in one component already, or they are compared, and compared exactly.

Most pairs that are not similar are told by a bound before their sets are made. A set's elements
are dealt to 512 bits by hash, each bit the parity of its elements. Every element that only one
of two sets has changes one bit's parity, so the sets differ in at least as many elements as
their parities in bits; sets that differ in more elements than the similarity allows are not
similar, for certain.

Sides of joins that come from an aggregation are written first, where there are many rows: a join
that shares its exchange with an aggregation can't be split where a key is hot, one with
exchanges of its own is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibloom.llm.common import bounded, discard, materialize, once, settled
from bibloom.llm.components import connected_components

#: Members of a bucket's largest component that its outsiders are compared with.
PIVOTS = 4
#: Items of a block, on average.
BLOCK_ITEMS = 32
#: Words of 64 parity bits.
_WORDS = 8


def similar(a: Column, b: Column, threshold: float) -> Column:
    """Whether two arrays of distinct values have at least this Jaccard similarity.

    The arrays are bound by a lambda: a filter on plain expressions would compute them anew for
    each mention.
    """

    def enough(p: Column) -> Column:
        common = F.size(F.array_intersect(p["a"], p["b"]))
        return common >= F.lit(threshold) * (F.size(p["a"]) + F.size(p["b"]) - common) - 1e-9

    return F.exists(F.array(F.struct(a.alias("a"), b.alias("b"))), enough)


class Match:
    """How two items are compared: ``as_set`` makes a content an array of distinct whole numbers
    that are spread like hashes; similar are items of a Jaccard similarity of at least
    ``threshold``."""

    def __init__(self, as_set: Callable[[Column], Column], threshold: float):
        self.as_set, self.threshold = as_set, threshold

    def items(self, content: DataFrame) -> DataFrame:
        """(id, n, p0 to p7): the size of each item's set and its parities."""
        # outer: for an inner explosion Catalyst would make each set once more, to filter on it
        each = content.select("id", F.explode_outer(self.as_set(F.col("content"))).alias("h"))
        each = each.select("id", once(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bit"), once(F.expr(f"shiftright(h, 6) & {_WORDS - 1}")).alias("word"))
        parity = [F.bit_xor(F.when(F.col("word") == w, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"p{w}") for w in range(_WORDS)]
        return materialize(each.groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("n"), *parity), "items")

    def possible(self, x: Callable[[str], Column], y: Callable[[str], Column]) -> Column:
        """The bound, for two items by the names of their columns."""
        differ = sum((F.bit_count(x(f"p{w}").bitwiseXOR(y(f"p{w}"))) for w in range(_WORDS)), F.lit(0))
        t = self.threshold
        sizes = F.least(x("n"), y("n")) >= t * F.greatest(x("n"), y("n")) - 1e-9
        return sizes & (differ <= (1 - t) / (1 + t) * (x("n") + y("n")) + 1e-9)

    def similar(self, x: Column, y: Column) -> Column:
        return similar(self.as_set(x), self.as_set(y), self.threshold)


def colliding(signed: DataFrame) -> DataFrame:
    """(bucket, id): the items of buckets with more than one.

    ``signed`` is a written table with one row for each item: id and keys, an array of its
    buckets. Most buckets have one item; they are dropped by a count of the bare keys.
    """
    buckets = signed.select("id", F.explode("keys").alias("bucket"))
    repeated = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("bucket")
    repeated = materialize(repeated, "repeated-buckets")
    shared = materialize(buckets.join(bounded(repeated), "bucket").distinct(), "shared-buckets")
    discard(repeated)
    return shared


def linked_components(shared: DataFrame, content: DataFrame, match: Match) -> DataFrame:
    """(node, component) of the items with a verified link.

    ``shared`` comes from ``colliding``; ``content``, a written table, has id and content of its
    items.
    """
    items = match.items(content)
    hold = settled(shared.count())
    heads = hold(shared.groupBy("bucket").agg(F.min("id").alias("head")), "heads")
    star = shared.join(heads, "bucket").groupBy("id").agg(F.min("head").alias("pivot")).where(F.col("id") != F.col("pivot"))
    links = _links(star.select(F.col("pivot").alias("a"), F.col("id").alias("b")), items, content, match)
    components = materialize(connected_components(links, "a", "b"), "components")
    discard(links)
    if hold is materialize:
        discard(heads)
    left = _open(shared, components, 2)
    if left.isEmpty():
        discard(items, left)
        return components
    inside = left.where(~F.col("outside"))
    some = inside.groupBy("bucket").agg(F.min("id").alias("a"))
    for salt in range(1, PIVOTS):
        mask = F.xxhash64("bucket", F.lit(salt))
        # the least id after an exclusive or with a hash is as good as drawn
        drawn = inside.groupBy("bucket", mask.alias("mask")).agg(F.min(F.col("id").bitwiseXOR(mask)).alias("m"))
        some = some.unionByName(drawn.select("bucket", F.col("m").bitwiseXOR(F.col("mask")).alias("a")))
    some = hold(some.distinct(), "pivots")
    pairs = left.where("outside").select("bucket", F.col("id").alias("b")).join(some, "bucket").select("a", "b").distinct()
    components = _merged(components, _links(pairs, items, content, match))
    discard(left)
    left = _open(shared, components, 3)
    if not left.isEmpty():
        components = _merged(components, _block_links(left, items, content, match))
    discard(items, left)
    return components


def _links(pairs: DataFrame, items: DataFrame, content: DataFrame, match: Match) -> DataFrame:
    """The similar ones of some pairs (a, b), a few for each item."""
    side = lambda end: items.toDF(end, *(f"{end}_{c}" for c in items.columns[1:]))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    possible = match.possible(lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}"))
    return _verified(both.where(possible).select("a", "b"), content, match)


def _verified(pairs: DataFrame, content: DataFrame, match: Match) -> DataFrame:
    """The similar ones of the pairs (a, b) that the bound leaves: contents, which are far larger than
    sizes and parities, are joined to these alone, and only those of their items are shuffled."""
    pairs = materialize(pairs, "possible-pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    ends = materialize(ends, "possible-items")
    some = content.join(bounded(ends), "id", "left_semi")
    both = pairs.join(some.toDF("b", "b_content"), "b").join(some.toDF("a", "a_content"), "a")
    links = materialize(both.where(match.similar(F.col("a_content"), F.col("b_content"))).select("a", "b"), "links")
    discard(pairs, ends)
    return links


def _open(shared: DataFrame, components: DataFrame, least: int) -> DataFrame:
    """(bucket, id, component, outside) of the buckets of at least so many items, in several
    components; outside: not in the largest."""
    grouped = shared.join(bounded(components.withColumnRenamed("node", "id")), "id", "left")
    grouped = materialize(grouped.withColumn("component", F.coalesce("component", "id")), "grouped")
    hold = settled(grouped.count())
    sizes = hold(grouped.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n")), "parts")
    mixed = sizes.groupBy("bucket").agg(F.max(F.struct("n", "component"))["component"].alias("largest"), F.sum("n").alias("items"), F.count(F.lit(1)).alias("parts"))
    mixed = hold(mixed.where((F.col("parts") > 1) & (F.col("items") >= least)).select("bucket", "largest"), "mixed-buckets")
    found = grouped.join(mixed, "bucket").select("bucket", "id", "component", (F.col("component") != F.col("largest")).alias("outside"))
    found = materialize(found, "open-buckets")
    discard(grouped, *((sizes, mixed) if hold is materialize else ()))
    return found


def _merged(components: DataFrame, more: DataFrame) -> DataFrame:
    """The components after more links, a written table: only what these join is gone through."""
    if more.isEmpty():
        return components
    named = more
    for end in ("a", "b"):
        own = components.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
        named = named.join(own, end, "left").withColumn(f"c{end}", F.coalesce(f"c{end}", end))
    merged = connected_components(named, "ca", "cb").select(F.col("node").alias("component"), F.col("component").alias("head"))
    nodes = components
    for end in ("a", "b"):
        nodes = nodes.unionByName(named.select(F.col(end).alias("node"), F.col(f"c{end}").alias("component")))
    found = nodes.distinct().join(merged, "component", "left").select("node", F.coalesce("head", "component").alias("component"))
    return materialize(found, "components")


def _block_links(left: DataFrame, items: DataFrame, content: DataFrame, match: Match) -> DataFrame:
    """(a, b): the links between outsiders and items of other components in the same bucket.

    Rows hold the sizes and parities of a block's items, not their contents; pairs that the bound
    leaves, most of them links, are compared as those with pivots are. A pair that meets in several
    buckets is compared in the first. Every block of outsiders goes to each block of its bucket by
    a key of its own.
    """
    hold = settled(left.count())
    buckets = left.groupBy("id").agg(F.sort_array(F.collect_set("bucket")).alias("buckets"))  # a few for each item
    counts = hold(left.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_ITEMS)).cast("int").alias("blocks")), "bucket-counts")
    members = left.join(counts, "bucket").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    members = materialize(members.join(buckets, "id").join(items, "id"), "block-items")
    item = F.struct("id", "component", "buckets", *items.columns[1:])
    every = members.groupBy("bucket", "block").agg(F.collect_list(item).alias("items"))
    some = members.where("outside").groupBy("bucket", "block", "blocks").agg(F.collect_list(item).alias("outsiders"))
    meeting = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    some = some.select("bucket", F.col("block").alias("from"), "outsiders", meeting)
    rows = some.join(every, ["bucket", "block"]).repartition("bucket", "from", "block")

    def links_of(x: Column) -> Column:
        # cheap tests first; each pair only in the first bucket that both are in
        others = F.filter("items", lambda y: (x["component"] != y["component"]) & match.possible(lambda c: x[c], lambda c: y[c]))
        here = F.filter(others, lambda y: F.array_min(F.array_intersect(x["buckets"], y["buckets"])) == F.col("bucket"))
        return F.transform(here, lambda y: F.struct(F.least(x["id"], y["id"]).alias("a"), F.greatest(x["id"], y["id"]).alias("b")))

    links = F.flatten(F.transform("outsiders", links_of))
    found = rows.select(F.explode_outer(links).alias("link")).where(F.col("link").isNotNull()).select("link.a", "link.b").distinct()
    links = _verified(found, content, match)
    discard(members)
    return links
