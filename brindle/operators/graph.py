"""Dependency graphs as edges(src, dst) and nodes(id): an edge src -> dst says that src depends on dst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.ranks import with_scalars
from ..session import forget, materialize


def latest_versions(versions: DataFrame, nulls: str = "first") -> DataFrame:
    """(crate_id, version_id): the newest version of each crate by updated_at, ties by the larger id.

    ``nulls="first"`` lets a missing date win (as a sort that puts missing values last and takes the last row does).
    """
    at = F.desc_nulls_first("updated_at") if nulls == "first" else F.desc_nulls_last("updated_at")
    order = W.partitionBy("crate_id").orderBy(at, F.desc("id"))
    return versions.withColumn("_n", F.row_number().over(order)).filter("_n = 1").select("crate_id", F.col("id").alias("version_id"))


def best_date(versions: DataFrame) -> DataFrame:
    """``versions`` with updated_at replaced by what the table has: updated_at, else created_at, else nothing (the id decides)."""
    seen = versions.agg(F.count("updated_at").alias("u"), F.count("created_at").alias("c")).first()
    chosen = "updated_at" if seen["u"] else "created_at" if seen["c"] else None
    return versions.withColumn("updated_at", F.col(chosen) if chosen else F.lit(None).cast("timestamp"))


def dependency_edges(dependencies: DataFrame, versions: DataFrame, crates: DataFrame, kind: Column | None = None) -> DataFrame:
    """Distinct (src, dst) from dependencies(version_id, crate_id) of latest versions, between known crates, without loops."""
    rows = dependencies if kind is None else dependencies.filter(kind)
    known = crates.select("id")
    latest = latest_versions(versions)
    return (
        rows.join(latest, "version_id").select(latest["crate_id"].alias("src"), rows["crate_id"].alias("dst")).filter("src <> dst")
        .join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst").distinct()
    )


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree) of every node."""
    n_in, n_out = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree")), edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))
    return nodes.select("id").join(n_in, "id", "left").join(n_out, "id", "left").select("id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("in_degree", "out_degree")])


def recent_downloads(downloads: DataFrame, versions: DataFrame, days: int = 90) -> DataFrame:
    """(crate_id, downloads) summed over dates from the last one minus ``days`` on, both ends included."""
    window = with_scalars(downloads, _last=F.max("date")).filter(F.col("date") >= F.col("_last") - F.expr(f"INTERVAL {days} DAYS"))
    return window.join(versions.select(F.col("id").alias("version_id"), F.col("crate_id")), "version_id").groupBy("crate_id").agg(F.sum("downloads").alias("downloads"))


def weights(nodes: DataFrame, downloads: DataFrame | None) -> DataFrame:
    """(id, w): log(1 + downloads), 0 downloads if unknown; 1 everywhere without ``downloads``."""
    if downloads is None:
        return nodes.select("id", F.lit(1.0).alias("w"))
    return nodes.select("id").join(downloads.withColumnRenamed("crate_id", "id"), "id", "left").select("id", F.log1p(F.coalesce("downloads", F.lit(0)).cast("double")).alias("w"))


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the least id in each weakly connected component, by large-star and small-star rounds until nothing changes."""
    now = materialize(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).filter("u <> v").distinct(), "wcc")
    n = now.count()
    while True:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low).filter("u <> v")
        new = materialize(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "wcc")
        grown = new.count()
        same = grown == n and not new.join(now, ["u", "v"], "left_anti").limit(1).count()
        forget(now)
        now, n = new, grown
        if same:
            break
    return nodes.select("id").join(now.withColumnRenamed("u", "id"), "id", "left").select("id", F.coalesce("v", "id").alias("component"))


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the least id in each strongly connected component.

    Nodes without in- or out-edges are trimmed off as components of their own; then every node takes the largest id that
    reaches it as its colour, and what reaches the colour's root backwards inside the colour is that root's component.
    """
    left = materialize(edges.filter("src <> dst").distinct(), "scc")
    n = left.count()
    done = None
    while True:
        while n:  # trim
            before = left
            left = materialize(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"), "scc")
            rest = left.count()
            forget(before)
            same, n = rest == n, rest
            if same:
                break
        if n == 0:
            break
        vertices = left.select(F.col("src").alias("id")).union(left.select("dst")).distinct()
        colour = materialize(vertices.withColumn("c", F.col("id")), "scc")
        while True:  # colours spread forwards until nothing changes
            came = left.join(colour.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.max("c").alias("d"))
            new = materialize(colour.join(came, "id", "left").select("id", F.greatest("c", "d").alias("c"), (F.coalesce("d", "c") > F.col("c")).alias("up")), "scc")
            colour = new.select("id", "c")
            if not new.filter("up").limit(1).count():
                break
        inner = left.join(colour.select(F.col("id").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("cd")), "dst").filter("cs = cd").select("src", "dst", F.col("cs").alias("c"))
        inner = materialize(inner, "scc")
        reach = front = materialize(colour.filter("id = c"), "scc")
        while True:  # backwards from the roots
            front = materialize(inner.join(front.select(F.col("id").alias("dst"), "c"), ["dst", "c"]).select(F.col("src").alias("id"), "c").distinct().join(reach, ["id", "c"], "left_anti"), "scc")
            if not front.limit(1).count():
                break
            reach = materialize(reach.union(front), "scc")
        done = reach if done is None else materialize(done.union(reach), "scc")
        ids = reach.select("id")
        left = materialize(left.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst"), "scc")
        n = left.count()
    if done is None:
        return nodes.select("id", F.col("id").alias("component"))
    least = done.groupBy("c").agg(F.min("id").alias("component"))
    return nodes.select("id").join(done.join(least, "c").select("id", "component"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def pagerank(nodes: DataFrame, edges: DataFrame, alpha: float = 0.85, tol: float | None = 1e-10, max_iter: int = 200) -> DataFrame:
    """(id, pagerank): power iteration with dangling mass spread evenly, until the L1 step is under ``tol`` (the first iterate that meets it), normalised at the end.

    Edges with their out-degree are written once, dealt by source. Every round writes its narrow ranks and deletes those
    before, so plans stay one join and one aggregate long; one look at the written table gives the step and the loose mass.
    """
    n = nodes.count()
    out = edges.groupBy("src").agg(F.count("*").alias("out"))
    links = materialize(edges.join(out, "src").repartition("src"), "links")
    now = materialize(nodes.select("id").join(out.withColumnRenamed("src", "id"), "id", "left").select("id", "out", F.lit(1.0 / n).alias("x"), F.lit(0.0).alias("step")), "rank") if n else nodes.select("id", F.lit(0.0).alias("x"))
    loose = F.coalesce(F.sum(F.when(F.col("out").isNull(), F.col("x"))), F.lit(0.0)).alias("loose")
    mass = now.agg(loose).first()["loose"] if n else 0.0
    for _ in range(max_iter if n else 0):
        came = links.join(now.select(F.col("id").alias("src"), "x"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("x") / F.col("out")).alias("got"))
        y = alpha * (F.coalesce("got", F.lit(0.0)) + F.lit(mass / n)) + (1 - alpha) / n
        new = materialize(now.join(came, "id", "left").select("id", "out", y.alias("x"), F.abs(y - F.col("x")).alias("step")), "rank")
        seen = new.agg(loose, F.sum("step").alias("step")).first()
        forget(now)
        now, mass = new, seen["loose"]
        if tol is not None and seen["step"] < tol:
            break
    return with_scalars(now, _all=F.sum("x")).select("id", (F.col("x") / F.col("_all")).alias("pagerank"))


def cached_pagerank(nodes: DataFrame, edges: DataFrame, path: str, force: bool = False, **options) -> DataFrame:
    """PageRank from the table at ``path`` if it covers 98 % of the ids, else computed and written there; ``force`` computes anyway. Ids that a good cache lacks have rank 0."""
    spark = nodes.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not force and where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        known = spark.read.parquet(path)
        if {"id", "pagerank"} <= set(known.columns) and cache_coverage(known, nodes).first()["valid"]:
            return nodes.select("id").join(known.select("id", "pagerank"), "id", "left").select("id", F.coalesce("pagerank", F.lit(0.0)).alias("pagerank"))
    pagerank(nodes, edges, **options).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def cache_coverage(cached: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row (covered, total, coverage, valid): a cache is good if it has 98 % of the ids."""
    hit = nodes.select("id").join(cached.select("id").distinct().withColumn("_hit", F.lit(1)), "id", "left").agg(F.count("_hit").alias("covered"), F.count("*").alias("total"))
    share = F.col("covered") / F.nullif(F.col("total"), F.lit(0))
    return hit.select("covered", "total", share.alias("coverage"), (share >= 0.98).alias("valid"))


def hops(edges: DataFrame, most: int = 6, sources: DataFrame | None = None) -> DataFrame:
    """(src, dst, dist) of all pairs at 1 to ``most`` hops along edges, level by level; src <> dst.

    The frontier is one join and one anti-join a level, both dealt by (src, dst); for graphs whose pairs explode, pass
    ``sources`` in blocks, as all results are by source.
    """
    first = edges.filter("src <> dst").distinct()
    if sources is not None:
        first = first.join(sources.select(F.col("id").alias("src")), "src", "left_semi")
    found = front = materialize(first.withColumn("dist", F.lit(1)), "hops")
    step = edges.select(F.col("src").alias("dst"), F.col("dst").alias("next"))
    for d in range(2, most + 1):
        onward = front.join(step, "dst").select("src", F.col("next").alias("dst")).filter("src <> dst").distinct()
        front = materialize(onward.join(found.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("dist", F.lit(d)), "hops")
        if not front.limit(1).count():
            break
        found = found.unionByName(front)
    return found


#: Sources whose pairs rest as a table at one time.
SOURCES = 1_000_000


def decay_scores(nodes: DataFrame, edges: DataFrame, weight: DataFrame, alpha: float = 0.7, beta: float = 0.7, most_up: int = 6, most_down: int = 6) -> DataFrame:
    """(id, s_down, s_up): weights of all that depend on a node, and of all it depends on, decayed by distance; 0 without any.

    Pairs are found for ``SOURCES`` sources at a time, by hash, and only their sums stay.
    """
    weight = materialize(weight.select("id", "w"), "weight")
    blocks = max(1, -(-edges.select("src").distinct().count() // SOURCES))
    parts = None
    for k in range(blocks):
        some = None if blocks == 1 else nodes.select("id").filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k)
        pairs = materialize(hops(edges, max(most_up, most_down), some), "pairs")
        up = pairs.filter(F.col("dist") <= most_up).join(weight.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum(F.col("w") * F.exp(-beta * F.col("dist"))).alias("u"))
        down = pairs.filter(F.col("dist") <= most_down).join(weight.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("w") * F.exp(-alpha * F.col("dist"))).alias("d"))
        own = up.select("id", "u", F.lit(0.0).alias("d")).unionByName(down.select("id", F.lit(0.0).alias("u"), "d")).groupBy("id").agg(F.sum("u").alias("u"), F.sum("d").alias("d"))
        done = materialize(own, "decay")
        forget(pairs)
        parts = done if parts is None else parts.unionByName(done)
    sums = parts.groupBy("id").agg(F.sum("d").alias("s_down"), F.sum("u").alias("s_up"))
    return nodes.select("id").join(sums, "id", "left").select("id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("s_down", "s_up")])


def combined(d: Column, u: Column, method: str = "linear", lam: float = 0.8) -> Column:
    """One score from two scaled ones; an unknown method is linear."""
    if method == "geo":
        return F.sqrt(d * u)
    if method == "harmonic":
        return F.when(d + u > 0, 2 * d * u / (d + u)).otherwise(0.0)
    if method in ("max", "min"):
        return (F.greatest if method == "max" else F.least)(d, u)
    return lam * d + (1 - lam) * u


def importance(scores: DataFrame, method: str = "linear", lam: float = 0.8) -> DataFrame:
    """(id, importance) of decay scores, each scaled to 0..1 over all nodes (0 if constant)."""
    s = with_scalars(materialize(scores, "scores"), _dl=F.min("s_down"), _dh=F.max("s_down"), _ul=F.min("s_up"), _uh=F.max("s_up"))

    def scale(c: str, lo: str, hi: str) -> Column:
        return F.when(F.col(hi) <= F.col(lo), 0.0).otherwise((F.col(c) - F.col(lo)) / (F.col(hi) - F.col(lo)))

    return s.select("id", combined(scale("s_down", "_dl", "_dh"), scale("s_up", "_ul", "_uh"), method, lam).alias("importance"))


def layer_stats(edges: DataFrame, weight: DataFrame, seed: int, most: int = 6) -> DataFrame:
    """(direction, distance, n, sum_weight, avg_weight) for distances 1 to ``most`` around one node, from it alone in both directions; empty layers are zeros."""
    spark = edges.sparkSession
    start = spark.createDataFrame([(seed,)], "id bigint")
    up = hops(edges, most, start).select(F.lit("up").alias("direction"), F.col("dist").alias("distance"), F.col("dst").alias("id"))
    down = hops(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), most, start).select(F.lit("down").alias("direction"), F.col("dist").alias("distance"), F.col("dst").alias("id"))
    made = up.unionByName(down).join(weight, "id").groupBy("direction", "distance").agg(F.count("*").alias("n"), F.sum("w").alias("sum_weight"))
    spine = spark.createDataFrame([(d, k) for d in ("up", "down") for k in range(1, most + 1)], "direction string, distance int")
    full = spine.join(made, ["direction", "distance"], "left")
    return full.select("direction", "distance", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("sum_weight", F.lit(0.0)).alias("sum_weight"), F.coalesce(F.col("sum_weight") / F.col("n"), F.lit(0.0)).alias("avg_weight"))


def summary(nodes: DataFrame, edges: DataFrame, weak: DataFrame, strong: DataFrame | None = None) -> DataFrame:
    """One row: nodes, edges, mean degree, number of components, label and size of the largest weak one (least label on ties)."""
    sizes = weak.groupBy("component").agg(F.count("*").alias("size"))
    big = sizes.agg(F.count("*").alias("wcc_count"), F.max(F.struct("size", (-F.col("component")).alias("c"))).alias("top"))
    one = nodes.agg(F.count("*").alias("nodes")).crossJoin(edges.agg(F.count("*").alias("edges"))).crossJoin(big)
    if strong is not None:
        one = one.crossJoin(strong.agg(F.count_distinct("component").alias("scc_count")))
    extra = ["scc_count"] if strong is not None else []
    return one.select("nodes", "edges", (F.col("edges") / F.col("nodes")).alias("avg_degree"), "wcc_count", *extra, (-F.col("top.c")).alias("biggest_wcc"), F.col("top.size").alias("biggest_wcc_size"))


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends in ``ids`` (id)."""
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")


def find_by_name(nodes: DataFrame, name: str) -> DataFrame:
    """The node of a name: the exact one, or else the only one that matches without regard to case; errors are ValueErrors."""
    name = (name or "").strip()
    if not name:
        raise ValueError("a name is needed")
    exact = nodes.filter(F.col("name") == name)
    if exact.limit(1).count():
        return exact
    like = nodes.filter(F.lower("name") == name.lower())
    n = like.limit(2).count()
    if n != 1:
        raise ValueError(f"{'no' if not n else 'more than one'} crate is named {name!r}")
    return like
