"""Walks of any length along edges of which every node has at most one: redirects from hop to hop, canonical addresses.

Pointer doubling: after k rounds every node knows where 2**k steps lead, so a walk of n steps takes log(n) joins of one table with
itself. A walk that has reached its end leaves the rounds. A walk of n steps holds walks of all lengths below, so when a round ends none, those
left lead into rings; they go on until the places they reach no longer become fewer, which are then the rings' nodes. The way
into a ring is a walk that ends at its nodes. Every round is written to the checkpoint folder, so lineage stays short.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .crawl import ensure_checkpoints

Tables = Callable[[str], DataFrame]

#: Hops that a fetch follows at most, and issues of canonical chains begin above so many (fixed values).
MAX_HOPS, CANONICAL_HOPS = 10, 2


def _round(moving: DataFrame, state: DataFrame, max_hops: int) -> DataFrame:
    """The moving nodes, each moved on by the steps that the node it is at has taken; done where that has no edge, or is done."""
    on = state.select(F.col("node").alias("n2"), F.col("at").alias("at2"), F.col("steps").alias("steps2"), F.col("hops").alias("hops2"), F.col("done").alias("done2"))
    return moving.join(on, F.col("at") == F.col("n2"), "left").select(
        "node", F.coalesce("at2", "at").alias("at"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps"),
        F.slice(F.concat("hops", F.coalesce("hops2", F.array().cast(state.schema["hops"].dataType))), 1, max_hops).alias("hops"), F.coalesce("done2", F.lit(True)).alias("done"),
    )


def _doubled(edges: DataFrame, max_hops: int) -> tuple[DataFrame, DataFrame]:
    """(ended, rest): node, at, steps, hops of walks that end, and of those that never do, then at nodes of rings. edges: source, target, hop."""
    state = edges.select(F.col("source").alias("node"), F.col("target").alias("at"), F.lit(1).cast("long").alias("steps"), F.array("hop").alias("hops"), F.lit(False).alias("done")).checkpoint()
    left, before = state.count(), -1
    while left and left != before:
        state = state.where("done").unionByName(_round(state.where("not done"), state, max_hops)).checkpoint()
        before, left = left, state.where("not done").count()
    rest, places, before = state.where("not done"), -1, -2
    while left and places != before:
        rest = _round(rest, rest, max_hops).checkpoint()
        before, places = places, rest.select("at").distinct().count()
    return state.where("done").drop("done"), rest.drop("done")


def _rings(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, ring (its least node) and size of rings. nodes: all nodes of rings; labels spread by doubling."""
    own = edges.join(nodes, edges["source"] == nodes["node"], "left_semi")
    state = own.select(F.col("source").alias("node"), F.col("target").alias("at"), F.least("source", "target").alias("ring")).checkpoint()
    taken, total = 1, state.count()
    while taken < total:
        on = state.select(F.col("node").alias("n2"), F.col("at").alias("at2"), F.col("ring").alias("ring2"))
        new = state.join(on, F.col("at") == F.col("n2")).select("node", F.col("at2").alias("at"), F.least("ring", "ring2").alias("ring")).checkpoint()
        settled = new.select("node", F.col("ring").alias("now")).join(state.select("node", "ring"), "node").where("now <> ring").isEmpty()
        state, taken = new, 2 * taken
        if settled:
            break
    sizes = state.groupBy("ring").agg(F.count("*").alias("size"))
    return state.select("node", "ring").join(sizes, "ring").select("node", "ring", "size")


def walks(edges: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """A row for every node with an edge: start, final, length, has_loop, hops. edges: source, target and any hop column, one edge a source.

    final is the node without an edge that the walk ends at, or the first that it meets twice; length counts the hops until then; hops are
    the first max_hops of the hop values. Edges with a null end are none.
    """
    ensure_checkpoints(edges.sparkSession)
    edges = edges.where("source is not null and target is not null").select("source", "target", *(["hop"] if "hop" in edges.columns else [F.col("target").alias("hop")]))
    ended, left = _doubled(edges, max_hops)
    out = ended.select(F.col("node").alias("start"), F.col("at").alias("final"), F.col("steps").alias("length"), F.lit(False).alias("has_loop"), "hops")
    if left.isEmpty():
        return out
    rings = _rings(edges, left.select(F.col("at").alias("node")).distinct()).checkpoint()
    within = rings.join(edges, F.col("node") == F.col("source")).select("node", "size")
    into = edges.join(left.select("node"), F.col("source") == F.col("node"), "left_semi").join(rings.select("node"), F.col("source") == F.col("node"), "left_anti")
    tails, _ = _doubled(into, 1)
    entered = tails.join(rings.select(F.col("node").alias("r"), "size"), F.col("at") == F.col("r")).select("node", F.col("at").alias("final"), (F.col("steps") + F.col("size")).alias("length"))
    inside = within.select("node", F.col("node").alias("final"), F.col("size").alias("length"))
    loops = entered.unionByName(inside).join(left.select("node", "hops"), "node")
    # hops beyond the walk's length are those of a further round
    return out.unionByName(loops.select(F.col("node").alias("start"), "final", "length", F.lit(True).alias("has_loop"), F.slice("hops", F.lit(1), F.least(F.col("length"), F.lit(max_hops)).cast("int")).alias("hops")))


def resolved(base: Column, ref: Column) -> Column:
    """A reference as an address: absolute ones as they are, others by scheme, host, path or query of the base; '.' and '..' go from paths."""
    scheme = "^[A-Za-z][A-Za-z0-9+.-]*:"
    root, path = F.regexp_extract(base, scheme + "//[^/?#]*", 0), F.regexp_extract(base, scheme + "//[^/?#]*([^?#]*)", 1)
    folder = F.regexp_extract(path, "^(.*/)", 1)
    whole = F.when(ref.startswith("/"), ref).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), ref))
    tree = F.regexp_extract(whole, "^[^?#]*", 0)
    parts = F.split(F.substring(tree, F.lit(2), F.length(tree)), "/")
    step = lambda kept, x: F.when(x == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).when(x == ".", kept).otherwise(F.concat(kept, F.array(x)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    # what ends in a dot segment is a folder
    clean = F.when(tree.rlike("(^|/)[.][.]?(/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0), "/").otherwise(""))).otherwise(tree)
    return (
        F.when(ref.isNull() | base.isNull(), None).when(ref.rlike(scheme), ref).when(ref.startswith("//"), F.concat(F.regexp_extract(base, scheme, 0), ref)).when(ref == "", F.regexp_extract(base, "^[^#]*", 0))
        .when(ref.startswith("?"), F.concat(root, path, ref)).when(ref.startswith("#"), F.concat(F.regexp_extract(base, "^[^#]*", 0), ref)).otherwise(F.concat(root, clean, F.substring(whole, F.length(tree) + 1, F.length(whole))))
    )


def redirect_chains(responses: DataFrame, max_hops: int = MAX_HOPS, follow: str = "any") -> DataFrame:
    """Chains of recorded responses: start_url, final_url, length, has_loop, hops (url, status_code, location), too_long (more hops than are followed).

    responses: url, status_code, location. Of several redirects of a URL the least row counts; rows that lead nowhere hide none. follow: any, same_host or none, which hops are followed.
    """
    if follow not in ("any", "same_host", "none"):
        raise ValueError(f"follow is any, same_host or none, not {follow!r}")
    row = responses.where("url is not null and status_code between 300 and 399 and location <> ''").groupBy("url").agg(F.min(F.struct("status_code", "location")).alias("r"))
    moved = row.select(F.col("url").alias("source"), resolved(F.col("url"), F.col("r.location")).alias("target"), F.struct("url", "r.status_code", "r.location").alias("hop"))
    host = lambda c: F.lower(F.regexp_extract(c, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    kept = {"any": F.lit(True), "same_host": host("source") == host("target"), "none": F.lit(False)}[follow]
    found = walks(moved.where(kept), max_hops)
    return found.select(F.xxhash64("start").alias("id"), F.col("start").alias("start_url"), F.col("final").alias("final_url"), F.col("length").cast("int").alias("length"), "has_loop", "hops", (F.col("length") > max_hops).alias("too_long"))


def canonical_walks(pages: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """Pages whose canonical address leads on: url, canonical, final, length, has_loop, hops (addresses), and the issue it makes.

    pages: url, canonical. A chain above CANONICAL_HOPS is a warning, a loop an error. Pages that name themselves lead nowhere.
    """
    edges = pages.where("canonical <> '' and canonical <> url").groupBy(F.col("url").alias("source")).agg(F.min("canonical").alias("target"))
    found = walks(edges, max_hops)
    long = F.col("length") > CANONICAL_HOPS
    say = lambda loop, chain: F.when(F.col("has_loop"), loop).when(long, chain)
    return found.select(
        F.col("start").alias("url"), F.element_at("hops", 1).alias("canonical"), "final", "length", "has_loop", "hops", F.when(F.col("has_loop") | long, "canonical_chain").alias("issue_code"), say("error", "warning").alias("issue_type"), say("high", "medium").alias("severity"),
        say(F.lit("Canonical chain contains a loop"), F.concat(F.lit("Canonical chain detected (length: "), F.col("length").cast("string"), F.lit(")"))).alias("message"),
    )


def _redirect_walks(t: Tables) -> DataFrame:
    hop = lambda h: F.concat_ws(" ", h["status_code"].cast("string"), h["url"], h["location"])
    return redirect_chains(t("locations")).select("start_url", "final_url", "length", "has_loop", F.array_join(F.transform("hops", hop), " > ").alias("hops"))


def _canonical_walks(t: Tables) -> DataFrame:
    return canonical_walks(t("wide").select("url", "canonical")).select("url", "canonical", "final", "length", "has_loop", "issue_code", "issue_type", "severity", "message")


WALKS: dict[str, Callable[[Tables], DataFrame]] = {"A02_redirect_walks": _redirect_walks, "P01_canonical_walks": _canonical_walks}
