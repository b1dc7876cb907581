"""Compositions: graph building and profile extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridloom.functions.ordering import running_sums
from gridloom.functions.rounds import materialize
from gridloom.operators import candidates as C, components as CC, filters as N, matching as M, profiles as P, regions as G, tiles as T
from gridloom.operators.labels import to_undirected
from gridloom.operators.messages import symmetrize

OBJ = ["image_id", "label"]


def find_tip(endpoints: DataFrame, centroids: DataFrame) -> DataFrame:
    """Endpoint farthest from the object's bright centre; objects with one endpoint drop out."""
    e = endpoints.join(centroids.select(*OBJ, "cy", "cx"), OBJ)
    e = e.withColumn("dist", F.sqrt((F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy")) + (F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx"))))
    best = e.groupBy(*OBJ).agg(F.count("*").alias("n"), F.min(F.struct((-F.round("dist", 9)).alias("d"), "y", "x", "dist")).alias("m"))
    return best.filter("n >= 2").select(*OBJ, "m.y", "m.x", "m.dist")


def _one_channel(pixels: DataFrame) -> DataFrame:
    """Image sizes; an image with more values than places stops the query."""
    g = pixels.groupBy("image_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"), F.count(F.lit(1)).alias("_n"))
    bad = F.raise_error(F.lit("pixels must be a single channel: some pixel has more than one value")).cast("bigint")
    return g.select("image_id", F.when(F.col("_n") <= F.col("h") * F.col("w"), F.col("h")).otherwise(bad).alias("h"), "w")


def build_graph(labels: DataFrame, pixels: DataFrame, gt: DataFrame | None, rules: DataFrame | None, k: int = 6, min_frac: float = 0.1, cap_factor: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and directed labelled edges of every image in one plan.

    `gt` has (image_id, y, x, frag, gt); without it all edges are negative and nodes untyped.  With a
    `cap_factor`, edges end at that multiple of their image's mean major axis.  `pixels` must be one
    channel: a channel column, or a pixel with two values, stops the query, since intensity features of
    mixed channels would be wrong without a sign of it.
    """
    if not {"image_id", "y", "x", "v"} <= set(pixels.columns) or {"c", "channel"} & set(pixels.columns):
        raise ValueError("pixels must be a single channel (image_id, y, x, v): reduce channels first")
    sizes = _one_channel(pixels)
    boundary, _ = materialize(G.inner_boundary(labels, sizes))
    nodes = G.node_features(labels, pixels)
    shapes, _ = materialize(G.region_basic(labels).join(G.region_moments(labels), OBJ))
    edges = C.knn_edges(shapes, boundary, k)
    if cap_factor is not None:
        scale = shapes.groupBy("image_id").agg(F.avg(F.when(F.col("major") > 0, F.col("major"))).alias("_major"))
        edges = edges.join(scale, "image_id").filter(F.col("dist") <= cap_factor * F.col("_major")).drop("_major")
    feats = C.edge_features(edges, shapes, boundary, pixels, sizes)
    feats = feats.withColumnsRenamed({"i": "src", "j": "dst"})
    if gt is None:
        feats = feats.withColumn("edge_label", F.lit(0))
    else:
        assign, _ = materialize(M.assign_to_gt(gt, min_frac))
        true = CC.merge_edges(labels, boundary, assign).select("image_id", F.col("i").alias("src"), F.col("j").alias("dst"), F.lit(1).alias("_t"))
        feats = feats.join(true, ["image_id", "src", "dst"], "left").withColumn("edge_label", F.coalesce("_t", F.lit(0))).drop("_t")
        if rules is not None:
            c = gt.filter("gt > 0").select("image_id", F.col("gt").alias("label"), "y", "x")
            shape = G.region_basic(c).join(G.region_moments(c), OBJ).join(G.region_perimeter(c), OBJ).join(G.region_solidity(c), OBJ)
            types = M.node_types(assign, M.classify_cells(M.cell_metrics(shape), rules))
            nodes = nodes.join(types.withColumnRenamed("frag", "label"), OBJ, "left")
    return nodes, to_undirected(feats)


def merge_fragments(nodes: DataFrame, scores: DataFrame, labels: DataFrame, threshold: float = 0.5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scored candidate edges to whole cells.

    `nodes` (graph_id, node, label), `scores` (graph_id, src, dst, prob, any more columns) in one or both
    directions, `labels` (image_id, label, y, x), where an image is a graph.  Returns

    * the record (graph_id, cell, topology, n_nodes, pos, node, label): every node with its cell and its place
      along it.  Nodes off the longest path of a branched cell have no place; cyclic cells, which
      have no order, keep their nodes by number;
    * the merged label map (image_id, y, x, label);
    * the edges that were followed, with their cell and all their columns.

    Both directions of an edge take the mean score; edges from a node to itself don't count.
    """
    keys = ["graph_id", "cell"]
    true = symmetrize(scores, "prob").filter((F.col("prob") >= threshold) & (F.col("src") != F.col("dst")))
    true, _ = materialize(true)
    und = true.select("graph_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    cells, _ = materialize(CC.graph_components(nodes, und))
    top, _ = materialize(CC.topology(cells, und).select(*keys, "n_nodes", "topology"))
    member = cells.join(top, keys)
    looped = member.filter("topology = 'cyclic'").select(*keys, "node").withColumn("_one", F.lit(1))
    by_number = running_sums(looped, keys, "node", {"pos": "_one"}).select(*keys, (F.col("pos") - 1).cast("int").alias("pos"), "node")
    order = CC.chain_order(cells, und).select(*keys, "pos", "node").unionByName(by_number)
    record = member.join(order, [*keys, "node"], "left").join(nodes.select("graph_id", "node", "label"), ["graph_id", "node"])
    record, _ = materialize(record.select(*keys, "topology", "n_nodes", "pos", "node", "label"))
    merged = CC.relabel(labels, record.select(F.col("graph_id").alias("image_id"), "label", "cell"))
    return record, merged, true.join(cells.withColumnRenamed("node", "src"), ["graph_id", "src"])


def extract_profiles(labels: DataFrame, signal: DataFrame, nuclei: DataFrame, pixel_size: float, bin_size: float, steps: int = 20) -> DataFrame:
    """Signal and nuclei intensity against the distance from each object's tip.

    Skeleton per object, extended endpoints, the endpoint farthest from the bright nucleus as
    tip, shortest-path distance inside the object, then means per distance bin.
    """
    labels, _ = materialize(labels.select(*OBJ, "y", "x"))
    sizes = N.image_sizes(signal)
    skel = T.thin(labels, OBJ)
    flat = skel.select("image_id", "y", "x")
    ext, _ = materialize(N.extend_endpoints(flat, labels, steps, sizes))
    ends = N.skeleton_degree(ext).filter("kind = 'endpoint'").join(labels, ["image_id", "y", "x"])
    tips, _ = materialize(find_tip(ends, P.bright_centroid(labels, nuclei)))
    mask = labels.join(tips.select(*OBJ), OBJ, "left_semi")
    dist = T.geodesic_distance(mask, tips, pixel_size, OBJ)
    sig = signal.select("image_id", "y", "x", F.col("v").alias("signal"))
    nuc = nuclei.select("image_id", "y", "x", F.col("v").alias("nuclei"))
    px = dist.join(sig, ["image_id", "y", "x"]).join(nuc, ["image_id", "y", "x"]).withColumnRenamed("dist", "distance")
    px, _ = materialize(px)
    out = None
    for ch in ("signal", "nuclei"):
        p = P.bin_profile(px.withColumn("intensity", F.col(ch)), bin_size, ["image_id"]).withColumn("channel", F.lit(ch))
        out = p if out is None else out.unionByName(p)
    return out
