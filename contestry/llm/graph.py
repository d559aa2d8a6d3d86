"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestry.session import materialise


def _smallest_neighbour(edges: DataFrame) -> DataFrame:
    """Each edge (u, v) with m, the smallest node among u and its neighbours."""
    least = edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return edges.join(least, "u")


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) for every node of the undirected ``edges`` (a, b).

    The component is its smallest node.  Alternating large and small stars hang
    every node below the smallest one it knows, which takes a number of rounds
    that grows with the logarithm of the longest path.  Each round is one table in
    the shared folder.  A node with many edges is joined to one row, so its edges
    can be split over tasks.  Null and looped edges are dropped.
    """
    links = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    links = materialise(links, label)
    seen = _digest(links)
    while True:
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _smallest_neighbour(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u > v").distinct()
        small = _smallest_neighbour(large)
        hung = small.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        links = materialise(hung.where("u > v").distinct(), label)
        now = _digest(links)
        if now == seen:
            break
        seen = now
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _digest(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first())



#: What a comparison of pairs (a, b) gives: sizes of both sets and of what they share,
#: b's members that a lacks (fresh), and a's members that b lacks (lost).
MEASURED = "a long, b long, shared long, na long, nb long, fresh array<long>, lost array<long>"


def linked(
    posts: DataFrame,
    measure: Callable[[DataFrame], DataFrame],
    percent: int,
    label: str,
    known_links: DataFrame | None = None,
    signatures: DataFrame | None = None,
    matches: int = 0,
) -> DataFrame:
    """(node, component) of nodes that share a list and whose sets are similar.

    ``posts`` (node, key, weight) puts nodes into lists; ``measure`` turns pairs (a, b)
    into ``MEASURED`` rows; a pair is linked when 100 * shared >= percent * united.
    With ``signatures`` (node, n, sig) pairs that cannot be linked by their sizes or
    have fewer than ``matches`` equal signature values are not measured, but for heads.

    First each node is compared with the heaviest node of its lists.  A node's weight
    says how common its keys are, so that the text which others are copies of heads a
    list, not a copy that differs from it and from the other copies.  Links within a
    component change nothing, so what is left is pairs of different components in one
    list.  For two nodes that were both measured against one head, what each lost of
    the head and has beside it tells exactly what the two share, so only links leave
    that join.  Pairs with a node whose signature is unlike
    the head's are compared by signature.  So a large group of copies costs a row per
    copy, and no link between components is lost.  Nodes without links may be missing
    from the result.
    """
    heads = posts.groupBy("key").agg(F.max(F.struct("weight", (-F.col("node")).alias("other"))).alias("head"))
    heads = heads.select("key", (-F.col("head.other")).alias("head"))
    listed = materialise(posts.select("key", "node").join(heads, "key"), f"{label}_lists")
    stars = listed.where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    # a head need not be similar to bound what its list's nodes share: a second equal value tells that it is related
    near = stars if signatures is None else _alike(stars, signatures, min(matches, 2), 0)
    similar = F.expr(f"100 * shared >= {percent} * (na + nb - shared)")
    measured = materialise(measure(near), f"{label}_measured")
    links = measured.where(similar).select("a", "b")
    if known_links is not None:
        links = links.unionByName(known_links)
    known = components(links, f"{label}_components")

    pairs = _beyond_heads(measured, known, percent)
    if signatures is not None:
        unlike = _unlike_heads(listed, measured, known, signatures, matches, percent)
        pairs = pairs.unionByName(unlike).distinct()
    more = materialise(measure(materialise(pairs, f"{label}_pairs")).where(similar).select("a", "b"), f"{label}_links")
    if more.isEmpty():
        return known
    joined = known.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(more)
    return components(joined, f"{label}_components")


def _side(signatures: DataFrame, name: str) -> DataFrame:
    return signatures.select(F.col("node").alias(name), F.col("n").alias(f"n{name}"), F.col("sig").alias(f"s{name}"))


def _signed(matches: int, percent: int) -> Column:
    """Sizes and signatures of a and b allow a link."""
    sizes = F.expr(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    return sizes & (F.size(F.array_intersect("sa", "sb")) >= matches)


def _alike(pairs: DataFrame, signatures: DataFrame, matches: int, percent: int) -> DataFrame:
    """The pairs whose sizes and signatures allow a link."""
    both = pairs.join(_side(signatures, "b"), "b").join(_side(signatures, "a"), "a")
    return both.where(_signed(matches, percent)).select("a", "b")


def _beyond_heads(measured: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that are linked, of nodes measured against one head.

    What two nodes share is the head without what either lost, and the fresh members
    they have in common.
    """
    own = known.select(F.col("node").alias("b"), F.col("component").alias("own"))
    main = known.select(F.col("node").alias("a"), F.col("component").alias("main"))
    placed = measured.join(own, "b", "left").join(main, "a", "left")
    placed = placed.select("a", "b", "shared", "na", "nb", "fresh", "lost", F.coalesce("own", "b").alias("own"), F.coalesce("main", "a").alias("main"))
    outside = placed.where("own <> main").select("a", *(F.col(c).alias(f"{c}_x") for c in ("b", "shared", "nb", "fresh", "lost", "own")))
    mixed = placed.join(outside.select("a").distinct(), "a", "left_semi")
    enough = f"{100 + percent} * ({{}}) >= {percent} * (nb_x + nb)"
    both_lost, both_fresh = "size(array_intersect(lost_x, lost))", "size(array_intersect(fresh_x, fresh))"
    joined = outside.join(
        mixed,
        (outside["a"] == mixed["a"])
        & F.expr("own_x <> own AND (own = main OR b_x < b)")
        & F.expr(enough.format("least(shared_x, shared) + least(size(fresh_x), size(fresh))"))
        & F.expr(enough.format(f"na - size(lost_x) - size(lost) + {both_lost} + {both_fresh}")),
    )
    return joined.select(F.least("b_x", "b").alias("a"), F.greatest("b_x", "b").alias("b")).distinct()


def _unlike_heads(
    listed: DataFrame, measured: DataFrame, known: DataFrame, signatures: DataFrame, matches: int, percent: int
) -> DataFrame:
    """Pairs of different components in one list, of which one node's signature is unlike the head's."""
    placed = listed.join(known, "node", "left").withColumn("own", F.coalesce("component", "node")).where("node <> head")
    mixed = placed.groupBy("key").agg(F.min("own").alias("low"), F.max("own").alias("high")).where("low <> high").select("key")
    placed = placed.join(mixed, "key").select("key", "node", "head", "own")
    met = measured.select(F.col("a").alias("head"), F.col("b").alias("node"), F.lit(True).alias("met"))
    placed = placed.join(met, ["head", "node"], "left")
    signed = placed.join(signatures, "node").select("key", F.col("met").isNotNull().alias("met"), "own", "node", "n", "sig")
    loose = signed.where("not met").select("key", F.col("own").alias("ca"), F.col("node").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    others = signed.select("key", F.col("met").alias("mb"), F.col("own").alias("cb"), F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    different = F.expr("ca <> cb AND (mb OR a < b)")
    joined = loose.join(others, (loose["key"] == others["key"]) & different & _signed(matches, percent))
    return joined.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
