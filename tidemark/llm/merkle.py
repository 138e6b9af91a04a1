"""A Merkle manifest of a table: a tree of hashes per group, a tree over the groups' roots, and a proof per row.

Leaves of a group ascend by id. Every level joins each node with the nodes of its run at computed sibling indices
(the index with its last bit flipped for two, slot offsets for wider runs); a node then knows what stands on its left
and right, and the rows in slot zero emit the parents. A run at the end may be shorter, down to one node. Levels are
written tables, so a lost executor costs one level at most.

Proofs are read off the same joins. ``STRIDE`` levels above a block of at most ``BLOCK`` nodes are gathered per block
(below 2 * BLOCK entries whatever the group), and each stride receives the path above its block from the next one, so
no row is shuffled once per level and no task holds a group.

Null ids come first, rows of one id ascend by hash, and rows alike in everything are interchangeable. Null is a group
of its own, the first. A null field is hashed as ``-``. An empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.common import stored

BLOCK = 256
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Add ``n`` (rows of ``grp``) and ``idx`` (place from 0 in ``order``) by sorted ranges and chained counts.

    ``order`` must tell all rows apart, else equal rows share one range.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(rows.repartitionByRange(parts, F.col("grp"), *order).withColumn("rng", F.spark_partition_id()))
    upto = Window.partitionBy("grp").orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("grp")
    starts = ranged.groupBy("grp", "rng").agg(F.count(F.lit(1)).alias("held")).select(
        "grp", "rng", F.coalesce(F.sum("held").over(upto), F.lit(0)).alias("start"), F.sum("held").over(whole).alias("n"))
    local = F.row_number().over(Window.partitionBy("grp", "rng").orderBy(*order)) - 1
    return ranged.withColumn("local", local).join(starts, ["grp", "rng"]).withColumn("idx", F.col("start") + F.col("local")).drop("rng", "local", "start")


@dataclass
class Tree:
    """``levels[i]`` has (grp, n, idx, h, left, right) of level i; ``tops`` has (grp, height, h) of each group."""

    levels: list[DataFrame]
    tops: DataFrame
    arity: int

    @property
    def stride(self) -> int:
        """How many levels a block of at most BLOCK nodes spans."""
        s = 1
        while self.arity ** (s + 1) <= BLOCK:
            s += 1
        return s


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Add ``left`` and ``right``: the hashes of the run's other nodes before and after each node, joined."""
    out = nodes
    slot = F.pmod("idx", F.lit(arity))
    others = []
    for d in range(1, arity):
        near = F.col("idx").bitwiseXOR(F.lit(1)) if arity == 2 else F.col("idx") - slot + F.pmod(slot + d, F.lit(arity))
        other = nodes.select("grp", F.col("idx").alias("sib"), F.col("h").alias(f"h{d}"))
        out = out.withColumn("sib", near).join(other, ["grp", "sib"], "left").drop("sib")
        others.append(F.struct(F.pmod(slot + d, F.lit(arity)).alias("at"), F.col(f"h{d}").alias("h")))
    run = F.array_sort(F.filter(F.array(*others), lambda x: x["h"].isNotNull()))

    def side(keep) -> Column:
        return F.array_join(F.transform(F.filter(run, lambda x: keep(x["at"])), lambda x: x["h"]), "")

    return out.withColumn("left", side(lambda at: at < slot)).withColumn("right", side(lambda at: at > slot)).drop(*[f"h{d}" for d in range(1, arity)])


def tree(leaves: DataFrame, arity: int = 2) -> Tree:
    """All levels over ``leaves`` (grp, n, idx, h and what else they carry); the height follows the largest group."""
    largest = leaves.agg(F.max("n")).first()[0] or 0
    levels, tops = [], []
    nodes = leaves
    while True:
        # lone nodes are roots: only leaves keep them, so that every leaf has its row
        held = nodes if not levels else nodes.filter("n > 1")
        tops.append(nodes.filter("n = 1").select("grp", F.lit(len(levels)).alias("height"), "h"))
        if largest <= 1 and levels:
            break
        levels.append(stored(with_siblings(held, arity)))
        nodes = levels[-1].filter((F.col("n") > 1) & (F.pmod("idx", F.lit(arity)) == 0)).select(
            "grp", F.ceil(F.col("n") / arity).cast("long").alias("n"), F.floor(F.col("idx") / arity).cast("long").alias("idx"), digest(F.col("h"), F.col("right")).alias("h"))
        largest = -(-largest // arity)
    found = tops[0]
    for t in tops[1:]:
        found = found.unionByName(t)
    return Tree(levels, stored(found), arity)


def with_paths(built: Tree, above: DataFrame) -> DataFrame:
    """The leaves with ``path``: what stands on their left and right, level by level.

    ``above`` has grp, path (of the group's root, may be empty) and columns that every leaf of the group receives.
    """
    a, s = built.arity, built.stride
    passed = [c for c in above.columns if c not in ("grp", "path")]
    tops = above.join(built.tops.select("grp", F.floor((F.greatest("height", F.lit(1)) - 1) / s).alias("stride")), "grp")
    down = None
    for b in reversed(range(-(-len(built.levels) // s))):
        own = built.levels[b * s:(b + 1) * s]
        base = own[0]
        carried = [c for c in base.columns if c not in ("grp", "idx", "left", "right")]
        entries = None
        for i, level in enumerate(own):
            extra = [F.col(c) if i == 0 else F.lit(None).cast(base.schema[c].dataType).alias(c) for c in carried]
            # lone leaves have no step of their own
            rows = level.select(
                "grp", F.floor(F.col("idx") / a ** (s - i)).alias("blk"),
                F.struct(F.lit(i).alias("lvl"), "idx", "left", "right", (F.col("n") > 1).alias("step"), *extra).alias("e"))
            entries = rows if entries is None else entries.unionByName(rows)
        roots = tops.filter(F.col("stride") == b).select("grp", F.lit(0).cast("long").alias("blk"), "path", *passed)
        if down is not None:
            roots = roots.unionByName(down.select("grp", F.col("idx").alias("blk"), "path", *passed))
        blocks = entries.groupBy("grp", "blk").agg(F.sort_array(F.collect_list("e")).alias("es")).join(
            roots.withColumnRenamed("path", "upper"), ["grp", "blk"])
        kinds = F.sequence(F.lit(0), F.lit(len(own) - 1))
        held = F.transform(kinds, lambda i: F.size(F.filter("es", lambda e: (e["lvl"] == i) & e["step"])))
        starts = F.transform(kinds, lambda i: F.aggregate(F.slice("held", F.lit(1), i), F.lit(0), lambda x, y: x + y))
        blocks = blocks.withColumn("held", held).withColumn("starts", starts)
        wide = [a ** i for i in range(s + 1)]
        power = F.array(*[F.lit(w).cast("long") for w in wide])

        def step(e: Column, i: Column) -> Column:
            first = F.col("blk") * F.get(power, F.lit(s) - i)
            place = F.floor(e["idx"] / F.get(power, i)) - first
            at = F.get(F.col("es"), (F.get(F.col("starts"), i) + place).cast("int"))
            return F.struct(at["left"].alias("left"), at["right"].alias("right"))

        leaves = F.slice("es", F.lit(1), F.size(F.filter("es", lambda e: e["lvl"] == 0)))
        steps = F.filter(kinds, lambda i: F.get(F.col("held"), i) > 0)
        walked = F.transform(leaves, lambda e: F.struct(e.alias("e"), F.transform(steps, lambda i: step(e, i)).alias("own")))
        down = blocks.select("grp", "upper", *passed, F.explode(walked).alias("w")).select(
            "grp", F.col("w.e.idx").alias("idx"), *[F.col(f"w.e.{c}").alias(c) for c in carried], F.concat("w.own", "upper").alias("path"), *passed)
    return down


def manifest(
    docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = FIELDS, arity: int = 2,
    tampered: dict[str, Column] | None = None,
) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) per row.

    ``tampered`` replaces fields by other values for the check of a row's proof: its root is then folded from the
    changed leaf and the original siblings, and ``verified`` tells whether it still is the root.
    """
    changed = {c: (tampered or {}).get(c, F.col(f"`{c}`")) for c in fields}
    leaf = digest(*[field(F.col(f"`{c}`")) for c in fields])
    rows = stored(docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(f"`{group_col}`").cast("string")), F.lit("")).alias("grp"), F.col(f"`{id_col}`").alias("id"),
        leaf.alias("h"), (digest(*[field(changed[c]) for c in fields]) if tampered else leaf).alias("shown"), F.monotonically_increasing_id().alias("nth")))
    placed = numbered(rows, [F.col("id").asc_nulls_first(), F.col("h"), F.col("nth")]).drop("nth")
    groups = tree(placed, arity)
    named = groups.tops.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "h")
    whole = tree(numbered(named, [F.col("name")]), arity)
    none = F.array().cast("array<struct<left:string,right:string>>")
    over = with_paths(whole, whole.tops.select("grp", none.alias("path"), F.col("h").alias("root"))) if whole.levels else None
    over = over.select(F.col("name").alias("grp"), "path", F.col("h").alias("subroot"), "root")
    walked = with_paths(groups, stored(over))
    folded = F.aggregate("path", F.col("shown"), lambda h, p: digest(p["left"], h, p["right"]))
    proof = F.sha2(F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), ""), 256)
    return walked.select(
        F.col("id").alias("doc_id"), F.col("h").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
