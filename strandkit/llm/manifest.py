"""A Merkle manifest of a dataset: leaves, roots and proofs of membership, by cogrouped subtree exchange."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandkit.llm.common import checkpoint, join_counted
from strandkit.operators.numbering import number_rows

#: Nodes under one node, and levels of a tree that a superblock finishes by itself.
FAN, LEVELS = 16, 3
BLOCK = FAN**LEVELS
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def node_hash(*parts: str) -> str:
    """Lowercase hex SHA-256 of the parts, one after the other; digests go in as hex text."""
    return sha256("".join(parts).encode()).hexdigest()


def leaf_hash(*fields: Column) -> Column:
    """A row's leaf: of its fields, each `-` if null, else the number of its bytes in UTF-8, `:` and the value."""
    written = [F.when(f.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string"))) for f in fields]
    return F.sha2(F.concat(*written), 256)


def levels_above(n: int, most: int = LEVELS) -> int:
    """Levels from n nodes up to the root, most of them at most."""
    levels = 0
    while n > 1 and levels < most:
        n, levels = -(-n // FAN), levels + 1
    return levels


def reduced(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes of each level, from those given up; every FAN consecutive nodes become one, a last run of fewer, even one, too."""
    out = [nodes]
    for _ in range(levels):
        nodes = [node_hash(*nodes[at : at + FAN]) for at in range(0, len(nodes), FAN)]
        out.append(nodes)
    return out


def siblings(tree: list[list[str]], at: int) -> Iterator[tuple[str, str]]:
    """For a node of the lowest level, level by level: the others of its run before it, and behind it, joined."""
    for nodes in tree[:-1]:
        first = at // FAN * FAN
        yield "".join(nodes[first:at]), "".join(nodes[at + 1 : first + FAN])
        at //= FAN


def folded(node: str, path: list[tuple[str, str]]) -> str:
    """The root that a node and its siblings give."""
    for before, behind in path:
        node = node_hash(before, node, behind)
    return node


def _next_level(nodes: DataFrame) -> DataFrame:
    """nodes(tree, no, n, node), n the number of nodes of the tree, reduced by a superblock each: LEVELS levels or up to the root."""

    def run(key, rows):
        n = int(rows["n"].iloc[0])
        levels = levels_above(n)
        top = reduced(rows.sort_values("no")["node"].tolist(), levels)[-1][0]
        return pd.DataFrame({"tree": [key[0]], "no": [key[1]], "n": [-(-n // FAN**levels)], "node": [top]})

    return nodes.groupBy("tree", F.floor(F.col("no") / BLOCK).alias("block")).applyInPandas(run, "tree long, no long, n long, node string")


def climb(nodes: DataFrame) -> DataFrame:
    """For each of nodes(tree, no, n, node): (tree, no, root, path), path the pairs (before, behind) of siblings up to its tree's root.

    Superblocks are reduced by themselves, and their roots are the nodes of the next, 4,096 times smaller exchange; on the way back each is
    cogrouped with its path above, its outer nodes, and passes on longer paths. nodes are read twice, so settle them before.
    """
    above = checkpoint(_next_level(nodes))
    if above.where("n > 1").limit(1).count():
        outer = climb(above)
    else:
        outer = above.select("tree", "no", F.col("node").alias("root"), F.lit(None).cast("array<struct<before:string,behind:string>>").alias("path"))

    def run(key, rows, around):
        rows = rows.sort_values("no")
        tree = reduced(rows["node"].tolist(), levels_above(int(rows["n"].iloc[0])))
        outside = [] if around["path"].iloc[0] is None else list(around["path"].iloc[0])
        paths = [[{"before": a, "behind": b} for a, b in siblings(tree, at)] + outside for at in range(len(rows))]
        return pd.DataFrame({"tree": rows["tree"].to_numpy(), "no": rows["no"].to_numpy(), "root": around["root"].iloc[0], "path": paths})

    blocks = nodes.groupBy("tree", F.floor(F.col("no") / BLOCK).alias("block"))
    return blocks.cogroup(outer.groupBy("tree", "no")).applyInPandas(run, "tree long, no long, root string, path array<struct<before:string,behind:string>>")


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), text_col: str = "text", with_paths: bool = False) -> DataFrame:
    """The Merkle tree over all rows, a proof for each, and what the proofs give for texts that were tampered with.

    A group's leaves ascend by id; while there are several nodes, every 16 consecutive ones become their hash. What remains
    is the group's subroot; the subroots, ordered by group, make the root in the same way. A row's proof are the hashes of its
    runs' other nodes, level by level up to the root. Where 5 divides the crc32 of the id, the text's A-Z are lower-cased, and the
    root is folded from the leaf of that and the old proof.

    Returns the id, leaf, subroot, root, proof_sha256 (hash of the proof's nodes from left to right), folded_root, verified
    (folded_root = root) and, if with_paths, group_no, place (the leaf's number in its group) and path (the siblings before
    and behind, for each level): what a client needs to check a row by itself.

    Only hashes are shuffled, not texts. Leaves are numbered by ranges of group and id; superblocks of 4,096 are the only groups, so
    a group that holds most rows makes many of them. Null groups are one, the first; null ids come first in a group and are not
    tampered with; equal ids are in order of their leaves, and equal rows have one leaf each, with different proofs. A null or empty text is a value like others.
    Ids must be integers. An empty table gives no rows.
    """
    plain = [F.col(f"`{c}`") for c in fields]
    lowered = [F.translate(x, UPPER, LOWER) if c == text_col else x for c, x in zip(fields, plain)]
    tampered = F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    leaves = docs.select(F.col(f"`{group_col}`").alias("source"), F.col(f"`{id_col}`").alias("id"), leaf_hash(*plain).alias("node"), F.when(tampered, leaf_hash(*lowered)).alias("tampered"))
    numbered = checkpoint(number_rows(checkpoint(leaves), ["id", "node"], "no", by=["source"]))
    sizes = numbered.groupBy("source").agg(F.count("*").alias("n"))
    groups = checkpoint(number_rows(sizes, ["source"], "tree").withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))))
    sums = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.ceil(F.col("n") / BLOCK)), F.lit(0)).alias("blocks"), F.count("*").alias("groups")).first()
    keyed = numbered.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-")))
    nodes = checkpoint(join_counted(keyed, groups.select("key", "tree", F.col("n").alias("size"), "n"), "key", "n", sums.rows).select(F.col("id").cast("string").alias("id"), "tree", "no", F.col("size").alias("n"), "node", "tampered"))
    above = checkpoint(_next_level(nodes.select("tree", "no", "n", "node")))
    inner = checkpoint(climb(above)) if above.where("n > 1").limit(1).count() else above.select("tree", "no", F.col("node").alias("root"), F.lit(None).cast("array<struct<before:string,behind:string>>").alias("path"))
    # the tree over the groups
    subroots = inner.where("no = 0").select("tree", F.col("root").alias("node"))
    tops = checkpoint(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("no"), F.lit(sums.groups).cast("long").alias("n"), "node"))
    top = checkpoint(climb(tops)).select(F.col("no").alias("tree"), F.col("root").alias("whole"), F.col("path").alias("upper"))
    blocks = groups.select("tree", F.ceil(F.col("n") / BLOCK).alias("n_blocks"))
    counted = top.join(blocks, "tree")
    outer = join_counted(inner, counted, "tree", "n_blocks", sums.blocks)

    def run(key, rows, around):
        rows = rows.sort_values("no")
        leaves = rows["node"].tolist()
        tree = reduced(leaves, levels_above(int(rows["n"].iloc[0])))
        parts = [x for x in (around["path"].iloc[0], around["upper"].iloc[0]) if x is not None]
        outside = [(s["before"], s["behind"]) for part in parts for s in part]
        root = around["whole"].iloc[0]
        proofs, roots, paths = [], [], []
        for at, (leaf, other) in enumerate(zip(leaves, rows["tampered"].tolist())):
            path = [*siblings(tree, at), *outside]
            proofs.append(node_hash(*[x for pair in path for x in pair]))
            roots.append(folded(other or leaf, path))
            if with_paths:
                paths.append([{"before": a, "behind": b} for a, b in path])
        out = {"id": rows["id"].to_numpy(), "leaf": leaves, "subroot": around["root"].iloc[0], "root": root, "proof_sha256": proofs, "folded_root": roots, "verified": [x == root for x in roots]}
        if with_paths:
            out |= {"group_no": rows["tree"].to_numpy(), "place": rows["no"].to_numpy(), "path": paths}
        return pd.DataFrame(out)

    schema = "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + ", group_no long, place long, path array<struct<before:string,behind:string>>" * with_paths
    done = nodes.groupBy("tree", F.floor(F.col("no") / BLOCK).alias("block")).cogroup(outer.groupBy("tree", "no")).applyInPandas(run, schema)
    return done.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType)).withColumnRenamed("id", id_col)
