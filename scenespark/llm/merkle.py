"""Merkle manifest: a tree of hashes per group of rows, stored as parents' preimages.

Leaves are hashes of whole rows. Runs of eight hashes, joined to one string of 64-character slots, are a
parent's preimage, and its hash is the next level's node. Each preimage is stored; then paths are made from the root down: a
parent's path is its own preimage before its parent's path. A leaf joins one path, cuts its own slot out of
each preimage for the siblings of its proof, and puts a changed hash into the slots to fold a root anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, crc_mod, stored
from .sharding import numbered

ARITY = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def framed(value: Column) -> Column:
    """UTF-8 byte count, colon, value; a null is a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the strings joined."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def levels(nodes: DataFrame) -> list[DataFrame]:
    """The tree's levels, from nodes (g, at, n, h): group, place, nodes of the group at this level, hash.

    Each level above the first has a row (g, at, n, h, preimage) for each parent; a group
    ends where it has one node left. A parent has eight children at most, whatever the group's size.
    """
    out, most = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        runs = out[-1].where("n > 1").groupBy("g", F.shiftright("at", 3).alias("at"), F.shiftright(F.col("n") + 7, 3).alias("n")).agg(F.array_sort(F.collect_list(F.struct(F.col("at").alias("child"), "h"))).alias("c"))
        pre = F.array_join(F.transform("c", lambda x: x["h"]), "")
        out.append(stored(runs.select("g", "at", "n", F.sha2(pre.cast("binary"), 256).alias("h"), pre.alias("preimage"))))
        most = (most + 7) // 8
    return out


def paths(tree: list[DataFrame], above: DataFrame) -> DataFrame:
    """The nodes of the lowest level of ``tree``, each with path and slots, preimages and places in them from its parent to the last root.

    ``above`` has a row for each group: g, the path and slots of the group's own root in the tree over the groups, and any
    further columns, which come down with the path.
    """
    more = [c for c in above.columns if c not in ("g", "path", "slots")]
    done = None
    for level in reversed(range(len(tree))):
        here = tree[level]
        # a group's root: what stands above it is the path of the group
        now = here.where("n = 1").join(above.withColumnRenamed("g", "_g"), F.col("g").eqNullSafe(F.col("_g"))).select(*here.columns, "path", "slots", *more)
        if done is not None:
            up = done.select(F.col("g").alias("_g"), F.col("at").alias("_at"), F.concat(F.array("preimage"), "path").alias("path"), F.col("slots").alias("_slots"), *more)
            kids = here.where("n > 1").join(up, F.col("g").eqNullSafe(F.col("_g")) & (F.shiftright("at", 3) == F.col("_at")))
            now = kids.select(*here.columns, "path", F.concat(F.array(F.pmod("at", F.lit(ARITY)).cast("int")), "_slots").alias("slots"), *more).unionByName(now)
        done = stored(now) if level else now
    return done


def siblings(path: Column, slots: Column) -> Column:
    """The preimages of a path, each without its own 64 characters, joined from the leaf up."""
    cut = F.zip_with(path, slots, lambda p, s: F.concat(F.substring(p, F.lit(1), s * 64), F.substring(p, s * 64 + 65, F.lit(64 * ARITY))))
    return F.array_join(cut, "")


def folded(leaf: Column, path: Column, slots: Column) -> Column:
    """The root that a leaf's hash gives when it is put into its slot of each preimage of the path."""
    steps = F.arrays_zip(path.alias("p"), slots.alias("s"))
    return F.aggregate(steps, leaf, lambda h, x: digest(F.substring(x["p"], F.lit(1), x["s"] * 64), h, F.substring(x["p"], x["s"] * 64 + 65, F.lit(64 * ARITY))))


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows with their place within group g (at, from 0) and the group's number of rows (n)."""
    ranked = numbered(rows, [F.col(c) for c in order], "_place")
    per = ranked.groupBy(F.col("g").alias("_g")).agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("n"))
    return ranked.join(per, F.col("g").eqNullSafe(F.col("_g"))).withColumn("at", F.col("_place") - F.col("_first")).drop("_g", "_first", "_place")


def manifest(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, leaf, subroot, root, proof_sha256, folded_root, verified, lang.

    Leaves are ordered within a lang by id (none first), rows of one id by leaf, then as they
    were stored; equal rows are interchangeable, so that runs agree. A null lang is a group of its own and the first. Where 3 divides
    the crc32 of the id, the folded root is that of the text with A to Z lower-cased, so verified is true there if
    the text has no capitals (a null id has no crc and is not tampered with; null and empty texts are the same
    either way). Texts of any length are hashed whole. A column of FIELDS that the table lacks counts as null; other columns are not read,
    whatever their names; an empty table gives no rows.
    """
    field = {c: (F.col(c) if c in docs.columns else F.lit(None).cast("string")) for c in FIELDS} | {"doc_id": F.col(id_col).cast("long")}
    low = F.translate(field["text"].cast("string"), CAPITALS, CAPITALS.lower())
    touched = F.coalesce(crc_mod(id_col, 3) == 0, F.lit(False))
    head = [framed(field[c]) for c in FIELDS[:-1]]
    leaf = digest(*head, framed(field["text"]))
    rows = docs.select(field["doc_id"].alias("id"), field["lang"].cast("string").alias("g"), leaf.alias("h"), F.when(touched, digest(*head, framed(low))).alias("tampered"))
    # texts are hashed once, by the write
    rows = stored(rows).withColumn("_row", F.monotonically_increasing_id())
    leaves = stored(placed(rows, ["g", "id", "h", "_row"]).drop("_row"))
    below = levels(leaves.select("g", "at", "n", "h"))
    subroots = below[0].where("n = 1").select("g", "h")
    for level in below[1:]:
        subroots = subroots.unionByName(level.where("n = 1").select("g", "h"))
    # the tree over the groups: one group of all, whose root has nothing above it
    subroots = checkpoint(subroots.select(F.col("g").alias("lang"), "h", F.lit("").alias("g")))
    over = levels(checkpoint(placed(subroots, ["lang"])))
    last = over[-1].where("n = 1").first()  # one row
    nothing = docs.sparkSession.range(1).select(F.lit("").alias("g"), F.array().cast("array<string>").alias("path"), F.array().cast("array<int>").alias("slots"))
    top = checkpoint(paths(over, nothing).select(F.col("lang").alias("g"), F.col("h").alias("subroot"), "path", "slots"))
    out = paths([leaves, *below[1:]], top).withColumn("root", F.lit(last and last["h"]).cast("string"))
    proof, again = siblings(F.col("path"), F.col("slots")), folded(F.coalesce("tampered", "h"), F.col("path"), F.col("slots"))
    out = out.select(F.col("id").alias(id_col), F.col("h").alias("leaf"), "subroot", "root", F.sha2(proof.cast("binary"), 256).alias("proof_sha256"), again.alias("folded_root"), F.col("g").alias("lang"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
