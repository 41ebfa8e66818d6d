"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits. It is cut into ``blocks`` blocks; two fingerprints within ``distance`` bits differ in at most
``distance // blocks`` bits of one block. Each block has its anchors: the words of a code of covering radius one, the
(15, 11) Hamming code on its first 15 bits with its other bits free. A fingerprint goes to every anchor within the
covering radius plus the block's threshold, and is a query at its nearest anchor alone. If x and y are within the
threshold, y is at x's nearest anchor (triangle inequality), so no link is lost and an anchor compares queries with
members only. Fingerprints are made distinct first, so copies cost nothing. An anchor with more than ``split`` members
is dealt to several tasks by chunks of its members.

Cases: a null text is the empty one; empty texts have fingerprint zero, which links like any other; texts with fewer words
than a shingle are one shingle; repeated rows share their fingerprint; a null id takes part and is never the component's
name unless its component has no other; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.base import beside, checkpointed, named, slices, whole_text
from quire.llm.components import connected_components, for_each_salt, salted

SEED = 42
HAMMING_BITS = 15


def fingerprint(text: str, words: int = 4) -> int:
    """The 64-bit SimHash of a text's word shingles, as an unsigned integer."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII letters and white space only
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        hashes = [digest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: 1 - words].tolist(), ends[words - 1 :].tolist(), strict=True)]
    n, votes = len(hashes), np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        block = np.array(hashes[at : at + 65536], dtype="<u8")
        votes += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, carried: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, fp`` (long, the fingerprint's bits) for every row, and the columns ``carried`` (of type long)."""

    def run(batches):
        for b in slices(batches):
            fps = np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), *b.columns[2:]], names=["doc_id", "fp", *carried])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"), *carried)
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", "fp", *carried)))


def _cuts(blocks: int) -> list[tuple[int, int]]:
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def _patterns(width: int, radius: int) -> list[np.ndarray]:
    """For each syndrome, the error patterns of at most ``radius`` bits that lead to an anchor."""
    bits = min(HAMMING_BITS, width)
    column = [i + 1 if i < bits else 0 for i in range(width)]
    layers = [[(0, 0, -1)]]
    for _ in range(radius):
        layers.append([(p | 1 << i, s ^ column[i], i) for p, s, last in layers[-1] for i in range(last + 1, width)])
    found: list[list[int]] = [[] for _ in range(16)]
    for p, s, _ in (x for layer in layers for x in layer):
        found[s].append(p)
    return [np.array(x, dtype=np.uint64) for x in found]


def _syndromes(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values), np.int64)
    for i in range(HAMMING_BITS):
        out ^= np.where(values >> np.uint64(i) & np.uint64(1), i + 1, 0)
    return out


def replicas(fps: np.ndarray, distance: int, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor keys, the index of the fingerprint that each belongs to, and whether it is its nearest anchor."""
    keys, whose, home = [], [], []
    for k, (lo, hi) in enumerate(_cuts(blocks)):
        part = fps >> np.uint64(lo) & np.uint64((1 << (hi - lo)) - 1)
        syndrome = _syndromes(part)
        for s, patterns in enumerate(_patterns(hi - lo, 1 + distance // blocks)):
            at = np.flatnonzero(syndrome == s)
            if len(at):
                nearest = np.uint64(1 << (s - 1) if s else 0)
                anchors = part[at][:, None] ^ patterns[None, :]
                keys.append((np.uint64(k << 56) | anchors).ravel())
                whose.append(np.repeat(at, len(patterns)))
                home.append(np.tile(patterns == nearest, len(at)))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
    return np.concatenate(keys), np.concatenate(whose), np.concatenate(home)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index of each index's component, over links a-b."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        live = ra != rb
        if not live.any():
            break
        a, b, ra, rb = a[live], b[live], ra[live], rb[live]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def compare(keys: np.ndarray, fps: np.ndarray, home: np.ndarray, distance: int, budget: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """Links that span what the anchors' queries and members connect: pairs of a fingerprint and its component's least.

    ``keys`` is sorted. Pairs are compared in blocks of ``budget``; after each block its links are folded into a forest.
    """
    distinct, index = np.unique(fps, return_inverse=True)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(keys)])
    group = np.repeat(np.arange(len(starts)), sizes)
    queries = np.flatnonzero(home & (sizes[group] > 1))
    width = sizes[group[queries]]
    upto = np.cumsum(width)
    a_all, b_all, at = [], [], 0
    held = 0
    while at < len(queries):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + budget, side="right")))
        q, w = queries[at:end], width[at:end]
        left = np.repeat(q, w)
        right = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w) + np.repeat(starts[group[q]], w)
        hit = np.bitwise_count(fps[left] ^ fps[right]) <= distance
        hit &= index[left] != index[right]
        a_all.append(index[left[hit]])
        b_all.append(index[right[hit]])
        held += len(a_all[-1])
        if held > 4 * budget:  # keep a spanning forest instead of all links
            root = _roots(len(distinct), np.concatenate(a_all), np.concatenate(b_all))
            moved = np.flatnonzero(root != np.arange(len(root)))
            a_all, b_all, held = [moved], [root[moved]], len(moved)
        at = end
    if not a_all:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    root = _roots(len(distinct), np.concatenate(a_all), np.concatenate(b_all))
    moved = np.flatnonzero(root != np.arange(len(root)))
    return distinct[moved], distinct[root[moved]]


def blocks_for(n: int) -> int:
    """How many blocks cost least for ``n`` different fingerprints; either number loses no link.

    Three blocks give a fingerprint some 48 anchors, of which there are 3 * 2^18, so that it is compared with n / 2^12.4 others; two
    give it some 690, and comparisons with n / 2^18.5. At 300 ns a copy and 5 ns a comparison they break even at some 2e8.
    """
    return 3 if n < 200_000_000 else 2


def links(distinct: DataFrame, distance: int = 4, blocks: int = 3, split: int = 16384) -> DataFrame:
    """``u, v``: pairs of distinct fingerprints (column fp) that span everything linked at ``distance`` bits or fewer."""
    spark = distinct.sparkSession

    def spread(batches):
        for b in batches:
            fps = b.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(fps), 4096):
                part = fps[at : at + 4096]
                keys, whose, home = replicas(part, distance, blocks)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(part[whose].view(np.int64)), pa.array(home)], names=["anchor", "fp", "home"])

    rows = distinct.select("fp").mapInArrow(spread, "anchor long, fp long, home boolean")
    hot = rows.groupBy("anchor").count().where(F.col("count") > split).select("anchor", F.ceil(F.col("count") / split).cast("int").alias("chunks"))
    hot = checkpointed(hot)
    n_hot = hot.count()
    if n_hot:
        hot = F.broadcast(hot) if n_hot <= 100_000 else hot
        mine = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
        rows = rows.join(hot, "anchor", "left")
        whole = rows.where("chunks is null").select("anchor", "fp", "home", F.lit(0).alias("chunk"))
        # A member sits in its own chunk; a query visits every chunk, where it is no member unless the chunk is its own.
        members = rows.where("chunks is not null").select("anchor", "fp", F.lit(False).alias("home"), mine.alias("chunk"))
        visits = rows.where("chunks is not null and home").select("anchor", "fp", "home", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
        rows = whole.union(members).union(visits)
    else:
        rows = rows.withColumn("chunk", F.lit(0))

    def run(batches):
        held: list[tuple[np.ndarray, ...]] = []
        n = 0

        def flush(parts, last):
            key, chunk, fps, home = (np.concatenate(x) for x in zip(*parts, strict=True))
            tag = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (chunk[1:] != chunk[:-1])])
            cut = len(key) if last else int(tag[-1])
            ids = np.repeat(np.arange(len(tag)), np.diff(np.r_[tag, len(key)]))
            out = compare(ids[:cut], fps[:cut], home[:cut], distance) if cut else (np.zeros(0, np.uint64),) * 2
            rest = [(key[cut:], chunk[cut:], fps[cut:], home[cut:])] if cut < len(key) else []
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in out], names=["u", "v"]), rest

        for b in batches:
            held.append((b.column(0).to_numpy(), b.column(3).to_numpy(), b.column(1).to_numpy().view(np.uint64), b.column(2).to_numpy(zero_copy_only=False)))
            n += b.num_rows
            if n >= 1 << 18:
                out, held = flush(held, False)
                n = sum(len(x[0]) for x in held)
                if out.num_rows:
                    yield out
        if held:
            out, _ = flush(held, True)
            if out.num_rows:
                yield out

    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n_parts, "anchor", "chunk").sortWithinPartitions("anchor", "chunk")
    return dealt.mapInArrow(run, "u long, v long").distinct()


def rooted(distinct: DataFrame, distance: int = 4, blocks: int | None = None) -> DataFrame:
    """``distinct`` (column fp and others) with ``root``: a fingerprint that names the component; one without links names its own."""
    roots = checkpointed(connected_components(links(distinct, distance, blocks or blocks_for(distinct.count()))))
    return distinct.join(roots, distinct.fp == roots.node, "left").select(*(distinct[c] for c in distinct.columns), F.coalesce("root", "fp").alias("root"))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, distance: int = 4, blocks: int | None = None, salts: int = 16) -> DataFrame:
    """``doc_id, fp, component_id`` for every row; component_id is the least id that links of ``distance`` bits reach.

    Only fingerprints that have a link are joined with their component, whose rows are dealt to ``salts`` tasks. The join
    with the rows, where copies share a fingerprint, is one of two plain shuffles, so that adaptive execution splits it.
    """
    fps = checkpointed(fingerprints(docs, id_col, text_col, words))
    distinct = checkpointed(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = checkpointed(connected_components(links(distinct, distance, blocks or blocks_for(distinct.count()))))
    linked = distinct.join(roots, distinct.fp == roots.node).select("fp", "least", "root")
    best = linked.groupBy("root").agg(F.min("least").alias("best"))
    named = salted(linked, "fp", salts).join(for_each_salt(best, salts), ["root", "_salt"]).select(F.col("fp").alias("_fp"), "best")
    member = checkpointed(distinct.join(named, distinct.fp == named._fp, "left").select("fp", F.coalesce("best", "least").alias("component_id")))
    return fps.join(member, "fp").select("doc_id", "fp", "component_id")


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, distance: int = 4, blocks: int | None = None) -> DataFrame:
    """One row of each component, with all its columns: that of the least id, null ids last, and of the least hashes among equal ids.

    A component goes by its fingerprints, never by an id, so rows with a null id or the same id stay apart if their texts do.
    A row is found again by two 64-bit hashes of all its columns; rows that are equal in all of them are one. All columns stay as
    they are, whatever their names.
    """
    every = [F.to_json(F.struct(named(c))) if "map<" in kind else named(c) for c, kind in docs.dtypes]  # maps have no hash
    keyed = docs.select(beside(docs), named(id_col).alias("id"), named(text_col).alias("text"), F.xxhash64(*every).alias("h1"), F.xxhash64(F.lit(1), *every).alias("h2"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h1", "h2")).alias("first")
    distinct = checkpointed(fingerprints(keyed, "id", "text", words, ("h1", "h2")).groupBy("fp").agg(first))
    keep = rooted(distinct, distance, blocks).groupBy("root").agg(F.min("first").alias("first")).select("first.h1", "first.h2")
    # Each task leaves one of its equal rows, so that no group of them meets whole; what is left has one row a key in the join.
    once = keyed.select("row", "h1", "h2").dropDuplicates(["h1", "h2"])
    return once.join(keep, ["h1", "h2"], "left_semi").select("row.*")


def hex_digits(fp: str = "fp"):
    """A fingerprint as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
