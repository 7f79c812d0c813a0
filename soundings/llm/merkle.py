"""Merkle manifest of a table: every row's leaf, its proof and the roots, by a butterfly exchange.

Rows become leaves (SHA-256 over their columns), leaves are numbered in order within their
tree, and a tree is cut into aligned units of ``FANOUT ** HEIGHT`` leaves, each a whole
subtree.  Units never depend on how rows lie in files, so a tree with most of the rows is
just many units.  A unit hashes its own subtree once.

Then units swap subtree roots.  In round r the ``FANOUT`` neighbouring groups of
``FANOUT ** r`` units below one ancestor meet: a unit sends the root it has to one unit of
each other group and gets one root from each, the same that its peers get.  All units of a
group hash the ancestor for themselves, so after the last round every unit knows its root
and all upper siblings of its leaves; nothing is sent down again.  Where the last group of a
tree is short, its units send to every unit of the others that has no peer in it.

A round moves at most ``FANOUT`` digests a unit, whatever the size of a tree, and there are
as many rounds as a number of units has digits to the base ``FANOUT``.  The trees' roots are
the leaves of one more tree, built the same way.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from soundings.session import cut_lineage

FANOUT = 8
#: A unit holds FANOUT ** HEIGHT leaves, 4096: some 300 KB.
HEIGHT = 4

LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digest(data: bytes) -> bytes:
    """Lowercase hex SHA-256, as bytes."""
    return sha256(data).hexdigest().encode()


def leaf_of(*columns: Column) -> Column:
    """Digest of a row: each value as byte count, colon and text, or a minus where it is NULL."""
    parts = []
    for column in columns:
        text = column.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


# ----------------------------------------------------------------- one unit, in a task

def levels_of(leaves: list[bytes], height: int | None) -> list[list[bytes]]:
    """For each level the joined digests of its runs, lowest first; last comes the level of the root alone.

    With ``height`` None the levels end where one node remains, else after ``height``
    levels, also if a level has a single node before that.
    """
    out, nodes = [], leaves
    while len(nodes) > 1 if height is None else len(out) < height:
        runs = [b"".join(nodes[i:i + FANOUT]) for i in range(0, len(nodes), FANOUT)]
        out.append(runs)
        nodes = [digest(r) for r in runs]
    return [*out, nodes]


def without(run: bytes, place: int) -> tuple[bytes, bytes]:
    """What stands before and after the digest at ``place`` of a run."""
    return run[:64 * place], run[64 * place + 64:]


def climb(levels: list[list[bytes]], i: int) -> Iterator[tuple[bytes, bytes]]:
    """Siblings before and after the path of leaf ``i``, level by level."""
    for runs in levels[:-1]:
        i, place = divmod(i, FANOUT)
        yield without(runs[i], place)


def fold(node: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """Root that a leaf and the siblings of its path give."""
    for before, after in path:
        node = digest(before + node + after)
    return node


# ---------------------------------------------------------------- numbering and cutting

def _pack(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows of a task as arrays of up to ``most`` rows of one group, numbered within task and group."""
    part, at, last = TaskContext.get().partitionId(), 0, object()
    for batch in batches:
        groups = batch.column("grp").to_pylist()
        cuts = [i for i in range(1, len(groups)) if groups[i] != groups[i - 1]]
        for a, b in zip([0, *cuts], [*cuts, len(groups)]):
            if a < b and groups[a] != last:
                last, at = groups[a], 0
            for c in range(a, b, most):
                rows = batch.slice(c, min(b, c + most) - c)
                ends = pa.array([0, len(rows)], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [rows.column("grp").slice(0, 1), pa.array([part], pa.int32()), pa.array([at], pa.int64()), pa.array([len(rows)], pa.int32()),
                     *(pa.ListArray.from_arrays(ends, rows.column(name)) for name in ("key", "leaf", "other"))],
                    ["grp", "part", "at", "n", "keys", "leaves", "others"])
                at += len(rows)


def _pieces(leaves: DataFrame, height: int) -> DataFrame:
    """Pieces of units: grp, unit, total (leaves of the tree), first (place of the first leaf), keys, leaves, others.

    ``leaves`` has grp, key, leaf and other (a second leaf, or NULL).  Leaves stand in order of
    key, NULL first; those with equal keys in order of their digests.  Leaves equal in both are
    dealt by the order of the written table, so that many of them do not meet in one task.
    """
    most = FANOUT ** height
    grp, key = (leaves.schema[c].dataType.simpleString() for c in ("grp", "key"))
    order = [F.col("grp").asc_nulls_first(), F.col("key").asc_nulls_first(), "leaf", "other", "tie"]
    sorted_rows = (leaves.withColumn("tie", F.monotonically_increasing_id())
                   .repartitionByRange(*order).sortWithinPartitions(*order).select("grp", "key", "leaf", "other"))
    packed = cut_lineage(sorted_rows.mapInArrow(
        partial(_pack, most=most), f"grp {grp}, part int, at long, n int, keys array<{key}>, leaves array<string>, others array<string>"))
    # tasks follow one another in the order of their numbers
    counts = packed.groupBy(F.col("grp").alias("g"), F.col("part").alias("p")).agg(F.sum("n").alias("rows"))
    before = counts.selectExpr("g", "p", "sum(rows) over (partition by g order by p) - rows as before", "sum(rows) over (partition by g) as total")
    placed = packed.join(before, F.col("grp").eqNullSafe(F.col("g")) & (F.col("part") == F.col("p"))).withColumn("start", F.col("before") + F.col("at"))
    # a row of up to as many leaves as a unit has reaches into one more unit at most
    units = F.explode(F.sequence(F.floor(F.col("start") / most), F.floor((F.col("start") + F.col("n") - 1) / most)))
    cut = placed.select("*", units.alias("unit")).select(
        "*", F.greatest("start", F.col("unit") * most).alias("first"), F.least(F.col("start") + F.col("n"), (F.col("unit") + 1) * most).alias("end"))
    inside = [F.slice(c, (F.col("first") - F.col("start") + 1).cast("int"), (F.col("end") - F.col("first")).cast("int")).alias(c)
              for c in ("keys", "leaves", "others")]
    return cut_lineage(cut.select("grp", "unit", "total", "first", *inside))


def _gather(pieces: pa.Table, height: int) -> tuple[pa.Array, list[str], list[str | None], list[list[bytes]]]:
    """Keys, leaves, other leaves and levels of a unit."""
    rows = pieces.sort_by("first").combine_chunks()
    keys, leaves, others = (pa.concat_arrays([c.flatten() for c in rows.column(name).chunks]) for name in ("keys", "leaves", "others"))
    leaves = leaves.to_pylist()
    return keys, leaves, others.to_pylist(), levels_of([x.encode() for x in leaves], None if rows["total"][0].as_py() <= FANOUT ** height else height)


def _root(pieces: pa.Table, height: int) -> pa.Table:
    root = _gather(pieces, height)[-1][-1][0].decode()
    return pieces.select(["grp", "unit", "total"]).slice(0, 1).append_column("node", pa.array([root], pa.string()))


# -------------------------------------------------------------------- butterfly exchange

def _peers(width: int) -> Column:
    """Units that a unit sends its group's root to, itself included; a group has ``width`` units, the tree's last maybe fewer.

    Peers have the same place in their groups.  The units of a short group serve several places each.
    """
    unit, nothing = F.col("unit"), F.expr("cast(array() as array<bigint>)")
    group = F.floor(unit / width)
    own = F.least(F.lit(width).cast("long"), F.col("size") - group * width)
    first = F.floor(unit / (FANOUT * width)) * FANOUT * width
    end = F.least(first + FANOUT * width, F.col("size"))

    def in_group(digit: Column) -> Column:
        start = first + digit * width + unit % width
        stop = F.least(first + (digit + 1) * width, end) - 1
        return F.when(group % FANOUT == digit, F.array(unit)).when(start >= end, nothing).otherwise(F.sequence(start, stop, own))

    return F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(FANOUT - 1).cast("long")), in_group))


def _exchange(units: DataFrame, rounds: int, height: int) -> DataFrame:
    """grp, unit, node (root of the tree) and upper, the siblings (before, after) of each round."""
    state = units.select("grp", "unit", F.ceil(F.col("total") / FANOUT ** height).alias("size"), "node",
                         F.expr("cast(array() as array<struct<before: string, after: string>>)").alias("upper"))
    for r in range(rounds):
        width = FANOUT ** r
        sent = state.select("grp", "size", "unit", "node", "upper", (F.floor(F.col("unit") / width) % FANOUT).alias("digit"), F.explode(_peers(width)).alias("to"))
        own = F.col("to") == F.col("unit")
        met = sent.groupBy("grp", "to").agg(
            F.max("size").alias("size"), F.max(F.when(own, F.col("digit"))).alias("digit"),
            F.first(F.when(own, F.col("upper")), ignorenulls=True).alias("upper"),
            F.sort_array(F.collect_list(F.struct("digit", "node"))).alias("met"))

        def joined(keep) -> Column:
            return F.array_join(F.transform(F.filter("met", keep), lambda x: x["node"]), "")

        done = F.col("size") <= width  # one root is left in this tree
        state = met.select(
            "grp", F.col("to").alias("unit"), "size",
            F.when(done, F.col("met")[0]["node"]).otherwise(F.sha2(joined(lambda x: F.lit(True)), 256)).alias("node"),
            F.when(done, F.col("upper")).otherwise(F.concat("upper", F.array(F.struct(
                joined(lambda x: x["digit"] < F.col("digit")).alias("before"),
                joined(lambda x: x["digit"] > F.col("digit")).alias("after"))))).alias("upper"))
    return state.select("grp", "unit", "node", "upper")


def forest(leaves: DataFrame, height: int) -> tuple[DataFrame, DataFrame]:
    """The trees over ``leaves`` (grp, key, leaf, other): pieces of units, and what each unit knows after the exchange."""
    pieces = _pieces(cut_lineage(leaves), height)
    grp = leaves.schema["grp"].dataType.simpleString()
    units = cut_lineage(pieces.groupBy("grp", "unit").applyInArrow(lambda unit: _root(unit, height), f"grp {grp}, unit long, total long, node string"))
    most, rounds = units.agg(F.max("total")).first()[0] or 0, 0
    while FANOUT ** (height + rounds) < most:
        rounds += 1
    return pieces, cut_lineage(_exchange(units, rounds, height))


def _path(pieces: pa.Table, known: pa.Table, height: int) -> pa.Table:
    """For every leaf of a unit its key, the root, and the siblings on its path from below."""
    keys, leaves, _, levels = _gather(pieces, height)
    upper = known["upper"][0].as_py()
    path = [[{"before": b.decode(), "after": a.decode()} for b, a in climb(levels, i)] + upper for i in range(len(leaves))]
    return pa.table([keys, pa.array(known["node"].to_pylist() * len(leaves), pa.string()),
                     pa.array(path, pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())])))], ["tree", "root", "path"])


def _proofs(pieces: pa.Table, known: pa.Table, height: int) -> pa.Table:
    """For every leaf of a unit its key, roots, proof and folded root."""
    keys, leaves, others, levels = _gather(pieces, height)
    subroot, root = known["node"][0].as_py(), known["root"][0].as_py()
    above = [(p["before"].encode(), p["after"].encode()) for p in [*known["upper"][0].as_py(), *known["path"][0].as_py()]]
    tail, proof, folded = b"".join(b + a for b, a in above), [], []
    for i, (leaf, other) in enumerate(zip(leaves, others)):
        path = list(climb(levels, i))
        proof.append(sha256(b"".join(b + a for b, a in path) + tail).hexdigest())
        folded.append(fold((other or leaf).encode(), path + above).decode())
    n = len(leaves)
    return pa.table([keys, pa.array(leaves, pa.string()), pa.array([subroot] * n, pa.string()), pa.array([root] * n, pa.string()),
                     pa.array(proof, pa.string()), pa.array(folded, pa.string()), pa.array([f == root for f in folded], pa.bool_())],
                    ["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


def _meet(pieces: DataFrame, known: DataFrame, function, height: int, schema: str) -> DataFrame:
    return pieces.groupBy("grp", "unit").cogroup(known.groupBy("grp", "unit")).applyInArrow(lambda a, b: function(a, b, height), schema)


def manifest(docs: DataFrame, columns: tuple[str, ...] = LEAF_COLUMNS, id_column: str = "doc_id",
             tree_column: str = "lang", altered: dict[str, Column] | None = None,
             height: int = HEIGHT) -> DataFrame:
    """One row per row of ``docs``: its id, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified``.

    A leaf is the digest of ``columns``.  There is one tree for each value of ``tree_column``
    (NULL is a value, and comes first), its leaves by ascending id; the trees' roots are the
    leaves of the last tree.  ``altered`` gives some columns other values as a later reader
    might see them: ``folded_root`` is the root that the altered row and the manifest's
    siblings give, and ``verified`` tells whether that is the root.  ``height`` is that of a unit.

    NULL ids come first in their tree; rows with equal ids stand in order of their digests,
    so repeated rows have a place each and the same leaf.  A NULL value differs from an empty one.
    An empty table has no rows and no root.  Texts of any length are hashed where they are
    read and go no further.  Columns not named take no part and are not returned.
    """
    value = {c: F.col(c) for c in columns}
    other = leaf_of(*{**value, **altered}.values()) if altered else F.lit(None).cast("string")
    pieces, known = forest(docs.select(
        F.col(tree_column).cast("string").alias("grp"), F.col(id_column).alias("key"), leaf_of(*value.values()).alias("leaf"), other.alias("other")), height)
    subroots = known.filter("unit = 0").select(
        F.lit(0).alias("grp"), F.col("grp").alias("key"), F.col("node").alias("leaf"), F.lit(None).cast("string").alias("other"))
    top = cut_lineage(_meet(*forest(subroots, height), _path, height, "tree string, root string, path array<struct<before: string, after: string>>"))
    known = known.join(top, F.col("grp").eqNullSafe(F.col("tree"))).drop("tree")
    key = docs.schema[id_column].dataType.simpleString()
    return _meet(pieces, known, _proofs, height, f"key {key}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
                 ).withColumnRenamed("key", id_column)


def tampered_text(id_column: str = "doc_id", text_column: str = "text", every: int = 3) -> Column:
    """The text with A-Z lower-cased where ``every`` divides the id's CRC-32; other texts, and those of NULL ids, unchanged."""
    hit = F.crc32(F.col(id_column).cast("string").cast("binary")) % every == 0
    return F.when(hit, F.translate(F.col(text_column), CAPITALS, CAPITALS.lower())).otherwise(F.col(text_column))
