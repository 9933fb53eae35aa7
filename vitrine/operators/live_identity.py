"""Classes of catalog rows that are the same live product, with no two rows of a class in conflict.

Rows of one market match by a shared number, or by name with equal quantities (or none). They
conflict if both have numbers and share none, or if their quantities differ. Matching isn't
transitive under conflicts: a row without a number may match two rows that conflict. So links
are taken in a fixed order (number and quantity, then name, then number alone with one
quantity unknown; ties by MD5), and a link joins two classes unless that would bring a
conflict into one, as in Kruskal's algorithm with forbidden pairs.

What never conflicts is one node from the start: rows with the same numbers and quantity, or
without numbers with the same name and quantity. Within a number's nodes of one quantity links
form a tree of degree three by rank, so links stay linear in the rows and no key has a hub; conflicting
pairs are never listed. Connected parts of bounded size are settled by one pass in a task, many
to a task; larger parts shrink in rounds that join all pairs of classes that are
each other's first link. Links that bring a conflict stay out for good, as classes only grow, so both
ways give the sequential result.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored
from .assignment import identity_classes
from .ordered import running_sum


def nodes_of(products: DataFrame) -> DataFrame:
    """id, node, market, gtins, quantity, name of products (id, market, name, gtins, quantity); ids tell rows apart."""
    rows = products.select(
        "id",
        "market",
        F.coalesce("name", F.lit("")).alias("name"),
        F.array_sort(F.array_distinct(F.array_compact(F.coalesce("gtins", F.array().cast("array<string>"))))).alias("gtins"),
        "quantity",
    )
    only = F.when(F.size("gtins") == 0, F.col("name")).otherwise("")
    rows = rows.withColumn("key", F.sha2(F.to_json(F.struct("market", "gtins", "quantity", only.alias("name")), {"ignoreNullFields": "false"}), 256))
    least = rows.groupBy("key").agg(F.min("id").alias("node"))
    return rows.join(least, "key").drop("key")


def links_of(rows: DataFrame) -> DataFrame:
    """ord (kind, tie), a, b: links between nodes, each once, a < b."""
    text = lambda *c: F.concat_ws("|", *(F.coalesce(F.col(x).cast("string"), F.lit("-")) for x in c))
    numbered = stored(rows.filter("size(gtins) > 0").select("node", "market", "quantity", F.explode("gtins").alias("gtin")).distinct(), "numbers")
    ranked = numbered.withColumn("key", text("market", "gtin", "quantity"))
    ranked = stored(running_sum(ranked, ["key"], ["node"], F.lit(1).cast("long"), "i").select("key", "node", "market", "gtin", "quantity", "i"), "ranks")
    up = ranked.select("key", F.col("i").alias("i"), F.col("node").alias("a"))
    tree = ranked.filter("i > 1").select("key", F.floor(F.col("i") / 2).alias("i"), F.col("node").alias("b")).join(up, ["key", "i"])
    heads = ranked.filter("i = 1")
    unknown = heads.filter("quantity IS NULL").select(F.col("market").alias("m"), F.col("gtin").alias("g"), F.col("node").alias("x"))
    known = heads.filter("quantity IS NOT NULL").join(unknown, F.col("market").eqNullSafe(F.col("m")) & (F.col("gtin") == F.col("g")))
    plain = rows.filter("size(gtins) = 0").select("node", "market", "quantity", "name").distinct().withColumn("key", text("market", "name", "quantity")).select("key", F.col("node").alias("x"))
    named = rows.filter("size(gtins) > 0").select("node", "market", "quantity", "name").distinct().withColumn("key", text("market", "name", "quantity")).select("key", "node").join(plain, "key")
    every = (
        tree.select(F.lit(0).alias("kind"), "a", "b")
        .union(named.select(F.lit(1), F.least("node", "x"), F.greatest("node", "x")))
        .union(known.select(F.lit(2), F.least("node", "x"), F.greatest("node", "x")))
    )
    once = every.groupBy("a", "b").agg(F.min("kind").alias("kind"))
    return once.select(F.struct("kind", F.md5(F.concat_ws("|", F.col("a").cast("string"), F.col("b").cast("string"))).alias("tie")).alias("ord"), "a", "b")


def clash(a: Column, b: Column) -> Column:
    """If two classes (quantity, sets) may not be one."""
    disjoint = F.exists(a["sets"], lambda x: F.exists(b["sets"], lambda y: ~F.arrays_overlap(x, y)))
    return F.coalesce(a["quantity"] != b["quantity"], F.lit(False)) | disjoint


def sequential(links: list[tuple], state: dict) -> dict:
    """node -> class; links are (order, a, b), state has (quantity, set of numbers or None) of each node."""
    up = {n: n for n in state}
    kept = {n: (q, [frozenset(s)] if s is not None and len(s) else []) for n, (q, s) in state.items()}

    def find(n):
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for _, a, b in sorted(links):
        a, b = sorted((find(a), find(b)))
        if a == b:
            continue
        (qa, sa), (qb, sb) = kept[a], kept[b]
        if (qa is not None and qb is not None and qa != qb) or any(x.isdisjoint(y) for x in sa for y in sb):
            continue
        up[b] = a
        kept[a] = (qa if qa is not None else qb, list(dict.fromkeys(sa + sb)))
        del kept[b]
    return {n: find(n) for n in up}


def in_tasks(links: DataFrame, nodes: DataFrame, parts: DataFrame, per_task: int) -> DataFrame:
    """node, class of connected parts, whole parts to a task."""
    n = max(1, -(-links.count() // per_task))
    task = F.pmod(F.xxhash64("part"), F.lit(n)).alias("task")
    left = links.join(parts.select(F.col("node").alias("a"), "part"), "a").select(task, "ord.kind", "ord.tie", "a", "b")
    right = nodes.join(parts, "node").select(task, "node", F.col("quantity"), "gtins")

    def settle(e: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        quantity = [None if pd.isna(q) else q for q in v["quantity"]]
        state = {n: (q, s) for n, q, s in zip(v["node"].tolist(), quantity, v["gtins"])}
        found = sequential([((k, t), a, b) for k, t, a, b in zip(e["kind"], e["tie"], e["a"].tolist(), e["b"].tolist())], state)
        return pd.DataFrame({"node": list(found), "class": list(found.values())}).astype("int64")

    return left.groupBy("task").cogroup(right.groupBy("task")).applyInPandas(settle, "node long, class long")


def in_rounds(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, class by rounds of mutual first links."""
    sets = F.when(F.size("gtins") > 0, F.array("gtins")).otherwise(F.array().cast("array<array<string>>"))
    member = stored(nodes.select("node", F.col("node").alias("class")), "members")
    classes = stored(nodes.select(F.col("node").alias("class"), "quantity", sets.alias("sets")), "classes")
    links = stored(links, "links")
    while True:
        of = classes.select(F.col("class").alias("c"), F.struct("quantity", "sets").alias("s"))
        at = links.join(of.select(F.col("c").alias("a"), F.col("s").alias("sa")), "a").join(of.select(F.col("c").alias("b"), F.col("s").alias("sb")), "b")
        links = stored(at.filter(~clash(F.col("sa"), F.col("sb"))).groupBy("a", "b").agg(F.min("ord").alias("ord")).select("ord", "a", "b"), "links")
        ends = links.select(F.col("a").alias("c"), "ord").union(links.select(F.col("b").alias("c"), "ord"))
        first = ends.groupBy("c").agg(F.min("ord").alias("first"))
        both = links.join(first.select(F.col("c").alias("a"), F.col("first").alias("fa")), "a").join(first.select(F.col("c").alias("b"), F.col("first").alias("fb")), "b")
        joined = stored(both.filter((F.col("fa") == F.col("ord")) & (F.col("fb") == F.col("ord"))).select(F.col("a").alias("to"), F.col("b").alias("from")), "joined")
        if joined.isEmpty():
            return member
        new = lambda df, c: df.join(joined, F.col(c) == F.col("from"), "left").withColumn(c, F.coalesce("to", c)).drop("to", "from")
        member = stored(new(member, "class"), "members")
        both = new(classes, "class").groupBy("class").agg(F.max("quantity").alias("quantity"), F.array_distinct(F.flatten(F.collect_list("sets"))).alias("sets"))  # two classes at most
        classes = stored(both, "classes")
        links = new(new(links, "a"), "b").filter("a <> b").select("ord", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def live_classes(products: DataFrame, most_part: int = 50_000) -> DataFrame:
    """id, class_id (smallest id of its class) of products (id long, market, name, gtins array of string, quantity string).

    Rows of other markets never match; a null market is one market, and a null name is the empty name. A part of
    more than most_part links is settled in rounds.
    """
    rows = stored(nodes_of(products), "rows")
    links = stored(links_of(rows), "links")
    nodes = rows.groupBy("node").agg(F.first("gtins").alias("gtins"), F.first("quantity").alias("quantity"))
    pairs = links.select(F.md5(F.concat_ws("|", "a", "b")).alias("key"), F.explode(F.array("a", "b")).alias("id"))
    parts = stored(identity_classes(pairs).select(F.col("id").alias("node"), F.col("component").alias("part")), "parts")
    sizes = links.join(parts, F.col("a") == F.col("node")).groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    large = stored(sizes.filter(F.col("n") > most_part).select("part"), "large")
    small = parts.join(large, "part", "left_anti")
    some = links.join(small.select(F.col("node").alias("a")), "a", "left_semi").select("ord", "a", "b")
    found = in_tasks(some, nodes, small, per_task=max(1, most_part))
    if not large.isEmpty():
        rest = parts.join(large, "part", "left_semi")
        found = found.union(in_rounds(links.join(rest.select(F.col("node").alias("a")), "a", "left_semi").select("ord", "a", "b"), nodes.join(rest.select("node"), "node", "left_semi")))
    return rows.join(found, "node", "left").select("id", F.coalesce("class", "node").alias("class_id"))
