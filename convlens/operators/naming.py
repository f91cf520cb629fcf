"""Names of clusters by a text model: by votes over samples, level by level up a hierarchy, and facet by facet."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convlens import providers as P
from convlens.functions import text as T
from convlens.operators import vectors as X
from convlens.session import checkpointed


def vote_names(members: DataFrame, model: P.TextModel, *, rounds: int = 3, inside: int = 10, outside: int = 10, chars: int = 500) -> DataFrame:
    """(cluster, name, description, votes): what the model says most often over samples of examples and of others.

    ``members`` has (cluster, id, text). A sample is the least hashes of id and round, so it is the same in any order;
    examples are cut to ``chars`` characters, as a prompt is. Of equally frequent names the greatest stays.
    """
    drawn = []
    for r in range(rounds):
        key = F.md5(F.concat(F.col("id").cast("string"), F.lit(f":{r}")).cast("binary"))
        rows = members.select("cluster", F.substring("text", 1, chars).alias("text"), key.alias("_key"))
        own = rows.withColumn("_n", F.row_number().over(Window.partitionBy("cluster").orderBy("_key"))).where(F.col("_n") <= inside)
        own = own.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("_n", "text"))).alias("_own"))
        # As many others as a cluster may need even if its own are among them.
        pool = rows.orderBy("_key").limit(10 * outside).agg(F.array_sort(F.collect_list(F.struct("_key", "cluster", "text"))).alias("_pool"))
        others = F.slice(F.filter("_pool", lambda x: x["cluster"] != F.col("cluster")), 1, outside)
        lines = lambda a: F.array_join(F.transform(a, lambda x: x["text"]), "\n")
        prompt = F.concat(lines(F.col("_own")), F.lit("\n\nNot such as:\n"), lines(others))
        drawn.append(own.crossJoin(F.broadcast(pool)).select("cluster", prompt.alias("prompt")))  # the pool is one row
    answers = P.complete(checkpointed(reduce(DataFrame.unionByName, drawn)), "prompt", model)
    said = answers.select("cluster", T.name_and_description(F.col("answer")).alias("g")).where("g is not null")
    votes = said.groupBy("cluster", "g.name").agg(F.count(F.lit(1)).alias("votes"), F.min("g.description").alias("description"))
    best = votes.groupBy("cluster").agg(F.max(F.struct("votes", "name", "description")).alias("b"))
    return best.select("cluster", "b.name", "b.description", "b.votes")


def named_hierarchy(clusters: DataFrame, model: P.TextModel, *, least_top: int = 5, share: int = 10) -> DataFrame:
    """(level, cluster, name, parent): groups of a ``share``-th of the clusters, again and again until few are left.

    ``clusters`` has (cluster, v, name). A level is grouped by k-means over its vectors; the model names each group from the
    names of its members; a level that does not shrink is the last. The top has no parents.
    """
    now, level, out = checkpointed(clusters.select("cluster", "v", "name")), 0, []
    n = now.count()
    while n > least_top:
        k = max(1, n // share)
        labels = checkpointed(X.kmeans(now.select(F.col("cluster").alias("id"), "v"), k, starts=1))
        joined = checkpointed(now.join(labels.select(F.col("id").alias("cluster"), F.col("label").alias("parent")), "cluster"))
        asked = joined.groupBy("parent").agg(F.array_join(F.slice(F.array_sort(F.collect_set("name")), 1, 10), ", ").alias("prompt"))
        named = P.complete(asked, "prompt", model).select(F.col("parent").alias("cluster"), F.coalesce(T.name_and_description(F.col("answer"))["name"], F.col("prompt")).alias("name"))
        out.append(joined.select(F.lit(level).alias("level"), "cluster", "name", "parent"))
        above = X.centroids(joined.select(F.col("cluster").alias("id"), "v", F.col("parent").alias("label")), "label")
        now = checkpointed(above.select(F.col("label").alias("cluster"), F.col("centroid").alias("v")).join(named, "cluster"))
        level, n, before = level + 1, now.count(), n
        if n >= before:
            break
    out.append(now.select(F.lit(level).alias("level"), F.col("cluster").cast("int").alias("cluster"), "name", F.lit(None).cast("int").alias("parent")))
    return reduce(DataFrame.unionByName, [o.withColumn("cluster", F.col("cluster").cast("long")) for o in out])


#: Categories have letters, and there is one for three clusters.
LETTERS = 26


def neighbourhoods(now: DataFrame, average: int) -> DataFrame:
    """``now`` with ``part``: clusters of a facet that are near each other, ``average`` in the mean and 3 x LETTERS at most."""
    sizes = {r["facet"]: r["n"] for r in now.groupBy("facet").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 2 * average).limit(1000).collect()}
    near = None
    for facet, n in sorted(sizes.items()):
        own = now.where(F.col("facet") == facet).select(F.col("cluster").alias("id"), "v")
        labels = X.kmeans(own, n // average, starts=1).select(F.col("id").alias("cluster"), F.col("label").alias("_k"))
        near = labels if near is None else near.unionByName(labels)
    placed = now.withColumn("_k", F.lit(0)) if near is None else now.join(checkpointed(near), "cluster", "left").withColumn("_k", F.coalesce("_k", F.lit(0)))
    count = placed.groupBy("facet", "_k").agg(F.ceil(F.count(F.lit(1)) / (2 * LETTERS)).alias("_parts"))
    return placed.join(count, ["facet", "_k"]).withColumn("part", F.concat_ws("/", "_k", F.pmod(F.xxhash64("cluster"), "_parts"))).drop("_k", "_parts")


def _listing(items: Column, first: Callable[[Column], Column]) -> Column:
    """Lines ``1: name - description``."""
    return F.array_join(F.transform(items, lambda x, i: F.concat(first(i), F.lit(": "), x["name"], F.lit(" - "), x["summary"])), "\n")


def facet_level(now: DataFrame, model: P.TextModel, *, average: int = 10, sample: int = 10) -> tuple[DataFrame, DataFrame]:
    """((cluster, parent), parents) of one level; both tables are as ``now``: (cluster, facet, name, summary, v), ids distinct.

    In each neighbourhood of a facet the model names a category for every three clusters (equal names are one; without any the first cluster's
    name stands), assigns each cluster by a letter (the first, if it says nothing else) and renames the categories that got members from
    ``sample`` of these. Categories of a facet whose new names are equal become one parent; its vector is the mean of its members'.
    """
    text = lambda c: F.coalesce(F.regexp_replace(c, r"\s+", " "), F.lit(""))
    member = F.struct("cluster", text(F.col("name")).alias("name"), text(F.col("summary")).alias("summary"))
    groups = neighbourhoods(now, average).groupBy("facet", "part").agg(F.array_sort(F.collect_list(member)).alias("m"))
    number = lambda i: (i + 1).cast("string")
    wanted = F.greatest(F.expr("size(m) div 3"), F.lit(1))
    ask = F.concat(F.lit("Name "), wanted.cast("string"), F.lit(" categories for the clusters of: "), "facet", F.lit("\n"), _listing(F.col("m"), number), F.lit("\n\nAnswer with lines Name: and Description: for each category."))
    named = P.complete(groups.withColumn("ask", ask), "ask", model).withColumn("c", T.higher_level_names(F.col("answer"))).drop("ask", "answer")
    once = F.aggregate("c", F.array().cast("array<struct<name:string,description:string>>"), lambda kept, x: F.when(F.exists(kept, lambda y: y["name"] == x["name"]), kept).otherwise(F.concat(kept, F.array(x))))
    usual = F.array(F.struct(F.col("m")[0]["name"].alias("name"), F.col("m")[0]["summary"].alias("description")))
    named = named.withColumn("c", F.slice(F.when(F.size(once) > 0, once).otherwise(usual), 1, LETTERS))
    named = named.withColumn("c", F.transform("c", lambda x: F.struct(x["name"].alias("name"), x["description"].alias("summary"))))
    ask = F.concat(F.lit("Assign each cluster to a category.\n"), _listing(F.col("m"), number), F.lit("\n\n"), _listing(F.col("c"), lambda i: F.char(65 + i)), F.lit("\n"))
    said = P.complete(named.withColumn("ask", ask), "ask", model).withColumn("to", T.assignments(F.col("answer"), F.size("m"), F.size("c"))).drop("ask", "answer")
    pairs = checkpointed(said.select("facet", "part", "c", F.explode(F.arrays_zip("m", "to")).alias("x")).select("facet", "part", F.col("x.to").alias("k"), F.col("c")[F.col("x.to")].alias("category"), "x.m"))
    full = pairs.groupBy("facet", "part", "k").agg(F.first("category").alias("category"), F.array_sort(F.collect_list("m")).alias("m"))
    ask = F.concat(F.lit("Rename the category: "), "category.name", F.lit("\n"), _listing(F.slice("m", 1, sample), number), F.lit("\n\nIt was described as: "), "category.summary")
    new = P.complete(full.withColumn("ask", ask), "ask", model).withColumn("g", T.name_and_description(F.col("answer")))
    new = new.select("facet", "part", "k", F.coalesce("g.name", "category.name").alias("name"), F.coalesce("g.description", "category.summary").alias("summary"))
    parents = checkpointed(new.groupBy("facet", "name").agg(F.min("summary").alias("summary")).withColumn("parent", F.monotonically_increasing_id()))
    links = checkpointed(pairs.select("facet", "part", "k", "m.cluster").join(new.select("facet", "part", "k", "name"), ["facet", "part", "k"]).join(parents.select("facet", "name", "parent"), ["facet", "name"]).select("cluster", "parent"))
    means = X.centroids(now.join(links, "cluster").select("v", F.col("parent").alias("label")), "label").select(F.col("label").alias("parent"), F.col("centroid").alias("v"))
    above = parents.join(means, "parent", "left").select(F.col("parent").alias("cluster"), "facet", "name", "summary", "v")
    return links, checkpointed(above)


def facet_hierarchy(clusters: DataFrame, model: P.TextModel, *, least_top: int = 5, average: int = 10, most_levels: int = 20) -> DataFrame:
    """(level, facet, cluster, name, parent): levels of ``facet_level`` until ``least_top`` clusters are left or a level does not shrink.

    The top has no parents. Null facets are one facet without a name. An empty table gives no rows.
    """
    now = checkpointed(clusters.select(F.col("cluster").cast("long").alias("cluster"), F.coalesce("facet", F.lit("")).alias("facet"), "name", "summary", "v"))
    out, level, n = [], 0, now.count()
    row = lambda df, parent: df.select(F.lit(level).alias("level"), "facet", "cluster", "name", parent.cast("long").alias("parent"))
    while n > least_top and level < most_levels:
        links, above = facet_level(now, model, average=average)
        fewer = above.count()
        if fewer >= n:
            break
        out.append(row(now.join(links, "cluster"), F.col("parent")))
        now, n, level = above, fewer, level + 1
    out.append(row(now, F.lit(None)))
    return reduce(DataFrame.unionByName, out)
