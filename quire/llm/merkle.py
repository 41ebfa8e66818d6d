"""Merkle manifest of a table: a tree of digests for each group of rows, a tree over the groups' roots, and proofs for every row.

A row's leaf is the sha256 of its fields, each ``-`` if null, else its UTF-8 bytes' number, a colon and the value. In a group, leaves
ascend by id; every two consecutive nodes become the digest of their digests, a single last one too, until one is left. The groups'
roots, ordered by group (null first, else bytewise), give the table's root likewise.

The trees are climbed in supersteps over RDDs. A vertex stands for ``2 ** bits`` consecutive nodes of a level and the small tree above
them: children send their digests to it, it hashes when it has them all and forwards its own digest to its parent, so that one
superstep climbs ``bits`` levels. Reverse supersteps send to each vertex the siblings above it; it adds those within itself and passes
the longer paths on to its children, down to the rows, which fold theirs up again. A vertex has a bounded number of children
whatever the group, so a hot group is as well dealt out as others. The driver sees a few numbers for each partition and the root.

Leaves are written to the shared folder before; all else is recomputed from them, or from shuffles, if an executor is lost.

Cases: rows with a null id come first in their group; rows of one id ascend by leaf, and equal rows have equal leaves and leave the
tree the same in any order (each has its own place and proof); an empty table gives no rows; a group of one row has its leaf
as root; columns that are no fields are ignored, whatever their names.
"""

from __future__ import annotations

from hashlib import sha256

from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.base import written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels that one superstep climbs.
BITS = 10


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """A field as it goes into the leaf."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def stacked(nodes: list[str], alone: bool, bits: int) -> list[list[str]]:
    """The levels of a vertex: its children's digests, then those above, up to its one own digest.

    A vertex that is alone on its level ends where one node is left, any other at ``bits`` levels, however few children it has.
    """
    levels = [nodes]
    while len(levels[-1]) > 1 if alone else len(levels) <= bits:
        last = levels[-1]
        levels.append([digest("".join(last[i : i + 2])) for i in range(0, len(last), 2)])
    return levels


def siblings(levels: list[list[str]], at: int) -> tuple[str, str]:
    """The digests beside the nodes over child ``at``, level by level, and which sides they are on: l, r or - for none."""
    path, sides = [], []
    for level in levels[:-1]:
        beside = at ^ 1
        found = beside < len(level)
        path.append(level[beside] if found else "")
        sides.append("-" if not found else "l" if at & 1 else "r")
        at >>= 1
    return "".join(path), "".join(sides)


def folded(node: str, path: str, sides: str) -> str:
    """The digest that a node and the siblings above it lead to."""
    at = 0
    for side in sides:
        beside = "" if side == "-" else path[at : at + 64]
        at += len(beside)
        node = digest(beside + node if side == "l" else node + beside)
    return node


def gathered(at: int, parts) -> tuple[list, bool]:
    """The children ``(digest, payload)`` of vertex ``at`` in order, and whether no other vertex is on its level of the tree."""
    parts = list(parts)
    runs = sorted((p for p in parts if p is not None), key=lambda p: p[0])
    return [child for _, run in runs for child in run], at == 0 and len(runs) == len(parts)


def dealt(rows: DataFrame, order: list[str], parts: int, bits: int) -> tuple[RDD, int]:
    """The rows ``tree, digest, payload...`` as messages to their vertices, and the number of rows of the largest tree."""
    in_order = rows.repartitionByRange(parts, "tree", *order).sortWithinPartitions("tree", *order).select("tree", "digest", "payload").rdd

    def ends(i, rows):
        first, last, n, most, single = None, None, 0, 0, True
        for row in rows:
            if n and row[0] == last:
                n += 1
            else:
                if n:
                    single = False
                else:
                    first = row[0]
                last, n = row[0], 1
            most = max(most, n)
        if n:
            yield i, first, last, n, most, single

    begins, tree, before, largest = {}, None, 0, 0
    for i, first, last, n, most, single in sorted(in_order.mapPartitionsWithIndex(ends).collect(), key=lambda x: x[0]):
        begins[i] = before if before and first == tree else 0
        tree, before = last, n + (begins[i] if single else 0)
        largest = max(largest, before, most, most + begins[i])  # an upper bound where several trees meet

    def messages(i, rows):
        tree, at, run = None, 0, []
        for row in rows:
            if not run or row[0] != tree or at >> bits != (at - 1) >> bits:
                if run:
                    yield from sent(tree, at - len(run), run, bits)
                    at = at if row[0] == tree else 0
                else:
                    at = begins[i]
                tree, run = row[0], []
            run.append((row[1], tuple(row[2])))
            at += 1
        if run:
            yield from sent(tree, at - len(run), run, bits)

    return in_order.mapPartitionsWithIndex(messages), largest


def sent(tree, at: int, run: list, bits: int):
    """Consecutive nodes' message to their parent; the first node beyond vertex 0 tells that one that it is not alone."""
    yield (tree, at >> bits), (at & (1 << bits) - 1, run)
    if at == 1 << bits:
        yield (tree, 0), None


def climbed(messages: RDD, largest: int, parts: int, bits: int) -> tuple[list[RDD], RDD]:
    """The vertices of each superstep, and ``(tree, root, superstep)`` of each tree."""
    steps, roots = [], []
    while not steps or largest > 1:
        vertices = messages.groupByKey(parts)
        steps.append(vertices)

        def forward(vertex):
            (tree, at), children = vertex
            children, alone = gathered(at, children)
            return tree, at, alone, stacked([d for d, _ in children], alone, bits)[-1][0]

        hashed = vertices.map(forward)
        roots.append(hashed.filter(lambda x: x[2]).map(lambda x, step=len(steps) - 1: (x[0], x[3], step)))
        messages = hashed.filter(lambda x: not x[2]).flatMap(lambda x: sent(x[0], x[1], [(x[3], None)], bits))
        largest = (largest + (1 << bits) - 1) >> bits
    return steps, messages.context.union(roots)


def descended(steps: list[RDD], tops: RDD, parts: int, bits: int, row) -> RDD:
    """``row(digest, payload, path, sides, carried)`` for each child of the first superstep's vertices.

    ``tops`` has ``(tree, superstep, (path, sides, carried))`` for each tree: what is above its root.
    """
    paths = tops.context.emptyRDD()
    for step in range(len(steps) - 1, -1, -1):
        here = tops.filter(lambda x, step=step: x[1] == step).map(lambda x: ((x[0], 0), x[2]))
        above = paths.union(here).partitionBy(parts)

        def onward(vertex):
            (tree, at), (children, (path, sides, carried)) = vertex
            children, alone = gathered(at, children)
            levels = stacked([d for d, _ in children], alone, bits)
            for i in range(len(children)):
                own, on = siblings(levels, i)
                yield (tree, at << bits | i), (own + path, on + sides, carried)

        def finished(vertex):
            (_, at), (children, (path, sides, carried)) = vertex
            children, alone = gathered(at, children)
            levels = stacked([d for d, _ in children], alone, bits)
            known: dict = {}
            for i, (d, payload) in enumerate(children):
                yield row(d, payload, siblings(levels, i), (path, sides, carried), known)

        paths = steps[step].join(above, parts).flatMap(onward if step else finished)
    return paths


def proofs(docs: DataFrame, claim: dict[str, Column] | None = None, tree_col: str = "lang", id_col: str = "doc_id", fields: tuple[str, ...] = FIELDS, bits: int = BITS) -> DataFrame:
    """``id, leaf, subroot, root, path, sides, folded_root`` for every row of ``docs``.

    ``path`` holds the hexadecimal digests beside the way from the leaf to the root and ``sides`` a letter a level: l or r for a
    digest on the left or right, - for none. ``folded_root`` is what the leaf that is claimed leads to: that of the row with the
    values of ``claim`` in place of the fields it names, or else the row's own. Whoever has a row, its path and the root can do the same by folded().
    """
    spark = docs.sparkSession
    own = leaf([F.col(c) for c in fields])
    said = leaf([(claim or {}).get(c, F.col(c)) for c in fields])
    rows = docs.select(F.col(tree_col).alias("tree"), F.col(id_col).cast("long").alias("id"), own.alias("digest"), (said if claim else F.lit(None).cast("string")).alias("said"))
    rows = rows.select("tree", "id", "digest", F.when(F.col("said") != F.col("digest"), F.col("said")).alias("said"), F.monotonically_increasing_id().alias("row"))
    leaves, _ = written(rows, "leaves")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), leaves.count() >> 18)
    leaves = leaves.withColumn("payload", F.struct("id", "said"))
    steps, subroots = climbed(*dealt(leaves, ["id", "digest", "row"], parts, bits), parts, bits)
    groups, _ = written(spark.createDataFrame(subroots, "payload string, digest string, step int").withColumn("payload", F.struct("payload", "step")), "subroots")
    groups = groups.withColumn("tree", F.lit(None).cast("string"))
    tops, roots = climbed(*dealt(groups, ["payload"], parts, bits), parts, bits)
    top = roots.collect()  # one row: the table's root
    start = spark.sparkContext.parallelize([(tree, step, ("", "", root)) for tree, root, step in top], 1)

    def subroot(d, payload, inner, outer, known):
        (path, sides), (above, on, root) = inner, outer
        return payload[0], payload[1], (path + above, sides + on, (d, root))

    def proof(d, payload, inner, outer, known):
        (path, sides), (above, on, (group_root, root)) = inner, outer
        top_node = folded(payload[1] or d, path, sides)
        if top_node not in known:  # the untouched rows of a vertex share what is above it
            known[top_node] = folded(top_node, above, on)
        return payload[0], d, group_root, root, path + above, sides + on, known[top_node]

    found = descended(steps, descended(tops, start, parts, bits, subroot), parts, bits, proof)
    return spark.createDataFrame(found, "id long, leaf string, subroot string, root string, path string, sides string, folded_root string", verifySchema=False)
