"""Removal of repeated passages: every byte of a ``length``-byte string that starts anywhere else, too.

1. Cut points. A window of ``length`` bytes names its minimizer, the least hash of its 64-byte strings (the first one on
   ties). Equal windows name equal minimizers at the same place in the window, so windows need comparing only with
   those that name the same string. Following windows of a text that name one occurrence make up one snippet.
2. Snippets whose minimizer occurs once are done. Where all snippets of a minimizer are equal, all their windows repeat.
   The others go, each different snippet once, to shards by their minimizer.
3. In each shard a suffix array is refined the Larsson-Sadakane way (first keys of eight bytes, then only groups that are
   not single, doubling the depth) and Kasai's lower bound carries common prefixes from one window to the next, in
   step over all snippets. A window repeats if it shares ``length`` bytes with a neighbour.
4. A minimizer with more than ``split`` different snippets is dealt to several shards. Each of these gives its distinct
   windows as sorted digests of 128 bits; digests meet by range, and a binary search of each in the merged array says
   which windows occur in more than one shard.

Cases: a null text is the empty one and loses nothing, like any text shorter than ``length`` bytes; repeated rows are copies of
each other and lose all that is long enough; equal ids with different texts are told apart by the text's hash; null ids
match only null ids; an empty table gives no rows; columns besides id and text are ignored.
"""

import hashlib
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.base import beside, named, remove, slices, whole_text, written

GRAM = 64
#: Bytes of text that are hashed at once; a longer text is taken in pieces that overlap by a window.
PIECE = 1 << 17
#: Odd multipliers of the hash; any will do.
MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position on that has as many."""
    n = len(data) - 7
    h = np.ndarray((n,), "<u8", data, 0, (1,)) * MIX[0]
    h ^= h >> np.uint64(32)
    for step, by in zip((8, 16, 32), MIX[1:4], strict=True):
        h = h[:-step] * by + h[step:]
        h ^= h >> np.uint64(29)
    h *= MIX[4]
    h ^= h >> np.uint64(32)
    return h


def minimizers(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows that name one minimizer: its hash, the first window's position and the number of windows.

    ``bounds`` are the starts of the texts in ``data`` and its end; windows do not cross them.
    """
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(data) < length:
        return none
    h = gram_hashes(data)
    low = np.uint64((1 << 24) - 1)
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    width, span = length - GRAM + 1, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    where = (least & low).astype(np.int64)
    inside = np.zeros(len(where) + 1, np.int32)
    sizes = np.diff(bounds)
    fits = sizes >= length
    np.add.at(inside, bounds[:-1][fits], 1)
    np.add.at(inside, bounds[:-1][fits] + sizes[fits] - length + 1, -1)
    at = np.flatnonzero(np.cumsum(inside[:-1]))
    if not len(at):
        return none
    named = where[at]
    first = np.flatnonzero(np.r_[True, (named[1:] != named[:-1]) | (at[1:] != at[:-1] + 1)])
    return h[named[first]], at[first], np.diff(np.r_[first, len(at)])


def _pieces(texts, length: int):
    """Lists of (row, offset, bytes) of about PIECE bytes; a long text comes in pieces whose windows do not overlap."""
    held, n = [], 0
    for row, data in texts:
        step = PIECE - length + 1
        for at in range(0, max(1, len(data) - length + 1), step):
            part = data[at : at + PIECE]
            if len(part) < length:
                continue
            held.append((row, at, part))
            n += len(part)
            if n >= PIECE:
                yield held
                held, n = [], 0
    if held:
        yield held


def occurrences(docs: DataFrame, length: int) -> DataFrame:
    """A row per different snippet of a piece of text: minimizer, snippet hash, document (id and text hash), the places of
    its first windows and the number of its windows. So a text that repeats one line a thousand times gives few rows."""
    schema = "gram long, snippet long, doc_id long, mark long, at array<int>, n int"

    def run(batches):
        for b in slices(batches):
            ids, marks = b.column(0), b.column(1)
            texts = ((i, t.encode("utf-8", "surrogatepass")) for i, t in enumerate(b.column(2).to_pylist()))
            for piece in _pieces(texts, length):
                data = b"".join(x[2] for x in piece)
                bounds = np.cumsum([0, *(len(x[2]) for x in piece)])
                gram, at, n = minimizers(np.frombuffer(data, np.uint8), bounds, length)
                if not len(gram):
                    continue
                text = np.searchsorted(bounds, at, side="right") - 1
                digest, view = xxhash.xxh64_intdigest, memoryview(data)
                ends = (at + n + (length - 1)).tolist()
                snippet = np.array([digest(view[a:z]) for a, z in zip(at.tolist(), ends, strict=True)], np.uint64)
                row = np.array([x[0] for x in piece])[text]
                start = at - bounds[text] + np.array([x[1] for x in piece])[text]
                by = np.lexsort((start, snippet, gram, row))
                row, gram, snippet, start, n = row[by], gram[by], snippet[by], start[by], n[by]
                first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (gram[1:] != gram[:-1]) | (snippet[1:] != snippet[:-1])])
                places = pa.ListArray.from_arrays(pa.array(np.r_[first, len(row)], pa.int32()), pa.array(start, pa.int32()))
                take = pa.array(row[first])
                cols = [pa.array(gram[first].view(np.int64)), pa.array(snippet[first].view(np.int64)), ids.take(take), marks.take(take), places, pa.array(n[first], pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, ["gram", "snippet", "doc_id", "mark", "at", "n"])

    return docs.mapInArrow(run, schema)


def suffix_array(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ``data`` in the order of their suffixes up to ``depth`` bytes at least, and each position's group."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    key = np.ndarray((n,), ">u8", padded, 0, (1,)).astype(np.uint64)
    order = np.argsort(key)
    sorted_key = key[order]
    new = np.r_[True, sorted_key[1:] != sorted_key[:-1]]
    group = np.empty(n, np.int64)
    group[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    slots = np.arange(n)
    h = 8
    while h < depth:
        ends = np.r_[new[1:], True]
        slots = slots[~(new & ends)]  # slots whose group is not single
        if not len(slots):
            break
        sub = order[slots]
        ahead = sub + h
        after = np.where(ahead < n, group[np.minimum(ahead, n - 1)] + 1, 0)
        key = group[sub].astype(np.uint64) << np.uint64(32) | after.astype(np.uint64)
        by = np.argsort(key)
        sub, key = sub[by], key[by]
        order[slots] = sub
        new = np.r_[True, key[1:] != key[:-1]]
        group[sub] = slots[np.flatnonzero(new)[np.cumsum(new) - 1]]
        h *= 2
    return order, group


def common_prefixes(data: np.ndarray, order: np.ndarray, first: np.ndarray, n: np.ndarray, length: int) -> np.ndarray:
    """For each window in ``order``, the bytes that it shares with the one before, up to ``length``.

    Kasai's bound: what a window shares with its forerunner is at most one byte less for the next window, if the
    forerunner's next window comes before it in the order. All snippets (first window, number of windows) go in step.
    """
    size = len(data)
    place = np.full(size + 1, -1, np.int64)
    place[order] = np.arange(len(order))
    words = np.ndarray((size,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))
    shared = np.zeros(len(order), np.int64)
    by = np.argsort(-n, kind="stable")
    first, n = first[by], n[by]
    h = np.zeros(len(first), np.int64)
    prior = np.full(len(first), -1, np.int64)
    for t in range(int(n[0]) if len(n) else 0):
        live = int(np.searchsorted(-n, -t, side="left"))
        i = first[:live] + t
        slot = place[i]
        j = np.where(slot > 0, order[np.maximum(slot - 1, 0)], -1)
        p = prior[:live]
        follows = (p >= 0) & (place[p + 1] >= 0) & (place[p + 1] < slot)
        low = np.where(follows, np.maximum(h[:live] - 1, 0), 0)
        low[j < 0] = 0
        todo = np.flatnonzero(j >= 0)
        while len(todo):
            x = words[i[todo] + low[todo]] ^ words[j[todo] + low[todo]]
            same = x == 0
            bit = (x & (~x + np.uint64(1))).astype(np.float64)
            low[todo] += np.where(same, 8, (np.frexp(np.where(same, 1.0, bit))[1] - 1) >> 3)
            todo = todo[same & (low[todo] < length)]
        low = np.minimum(low, length)
        shared[slot] = low
        h[:live], prior[:live] = low, j
    return shared


def repeated_windows(snippets: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Over the snippets' windows in order: does it repeat; and the windows' order, shared bytes and positions."""
    sizes = np.array([len(s) for s in snippets])
    first = np.cumsum(sizes) - sizes
    n = sizes - length + 1
    data = np.frombuffer(b"".join(snippets), np.uint8)
    order, _ = suffix_array(data, length)
    window = np.zeros(len(data) + 1, np.int32)
    np.add.at(window, first, 1)
    np.add.at(window, first + n, -1)
    window = np.cumsum(window[:-1]) > 0
    order = order[window[order]]
    shared = common_prefixes(data, order, first, n, length)
    twice = shared >= length
    twice[:-1] |= twice[1:]
    out = np.zeros(len(data), bool)
    out[order[twice]] = True
    return out[window], order, shared, np.flatnonzero(window)


def _runs(mask: np.ndarray) -> np.ndarray:
    """Start and end of each run of true values, in turn, as 32-bit integers."""
    edge = np.flatnonzero(np.diff(np.r_[0, mask.astype(np.int8), 0]))
    return edge.astype("<i4")


def _shards(batches, limit: int, columns: int):
    """Batches joined to lists of whole groups; a group has one value in each of the first two columns."""
    held = [[] for _ in range(columns)]
    size, last = 0, None
    for b in batches:
        for row in zip(*(b.column(k).to_pylist() for k in range(columns)), strict=True):
            if size >= limit and row[:2] != last:
                yield held
                held, size = [[] for _ in range(columns)], 0
            last = row[:2]
            size += len(row[-1])
            for store, x in zip(held, row, strict=True):
                store.append(x)
    if held[0]:
        yield held


def _windows_of(snippets: DataFrame, length: int, limit: int) -> DataFrame:
    """gram, snippet, and the runs of its windows that repeat within the shard (gram, shard)."""

    def run(batches):
        for gram, _, snippet, copies, data in _shards(batches, limit, 5):
            twice, _, _, _ = repeated_windows(data, length)
            at, out = 0, []
            for s, c in zip(data, copies, strict=True):
                n = len(s) - length + 1
                out.append(_runs(np.ones(n, bool) if c > 1 else twice[at : at + n]).tobytes())
                at += n
            yield pa.RecordBatch.from_arrays([pa.array(gram, pa.int64()), pa.array(snippet, pa.int64()), pa.array(out, pa.binary())], ["gram", "snippet", "runs"])

    return snippets.mapInArrow(run, "gram long, snippet long, runs binary")


def _across(snippets: DataFrame, length: int, limit: int, parts: int) -> DataFrame:
    """As _windows_of, for the windows of split minimizers that occur in more than one shard."""

    def digests(batches):
        for gram, shard, snippet, _, data in _shards(batches, limit, 5):
            _, order, shared, _ = repeated_windows(data, length)
            text = b"".join(data)
            sizes = np.array([len(s) for s in data])
            first = np.cumsum(sizes) - sizes
            # Windows of one run in the suffix array are equal: those of one shard are one row, with the digest of the first.
            whose = np.searchsorted(first, order, side="right") - 1
            own = np.array(shard)[whose]
            lead = np.flatnonzero((shared < length) | np.r_[True, own[1:] != own[:-1]])
            raw = np.frombuffer(b"".join(hashlib.blake2b(text[p : p + length], digest_size=16).digest() for p in order[lead].tolist()), ">u8").reshape(-1, 2).astype(np.uint64).view(np.int64)
            snippet_of, at = np.array(snippet, np.int64)[whose], (order - first[whose]).astype(np.int32)
            ends = np.r_[lead, len(order)].astype(np.int32)
            owner = whose[lead]
            for k in range(0, len(lead), 1 << 16):
                z = min(k + (1 << 16), len(lead))
                lists = [pa.ListArray.from_arrays(pa.array(ends[k : z + 1] - ends[k]), pa.array(x[ends[k] : ends[z]])) for x in (snippet_of, at)]
                cols = [raw[k:z, 0], raw[k:z, 1], own[lead[k:z]], np.array(gram, np.int64)[owner[k:z]]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), *lists], ["high", "low", "shard", "gram", "snippets", "ats"])

    rows = snippets.mapInArrow(digests, "high long, low long, shard long, gram long, snippets array<long>, ats array<int>")

    def merge(batches):
        # Digests come in order, a row for each shard that has them; one that a binary search finds more than once crosses.
        rest = None
        for b in chain(batches, (None,)):
            t = pa.Table.from_batches([x for x in (rest, b) if x is not None]).combine_chunks() if rest is not None or b is not None else None
            if t is None or not t.num_rows:
                continue
            keys = np.empty(t.num_rows, dtype=[("high", np.int64), ("low", np.int64)])
            keys["high"], keys["low"] = t.column(0).to_numpy(), t.column(1).to_numpy()
            done = t.num_rows if b is None else int(np.searchsorted(keys, keys[-1:], side="left")[0])
            rest = t.slice(done).to_batches()[0] if done < t.num_rows else None
            some = keys[:done]
            twice = np.flatnonzero(np.searchsorted(some, some, side="right") - np.searchsorted(some, some, side="left") > 1)
            for at in range(0, len(twice), 4096):
                part = t.take(pa.array(twice[at : at + 4096]))
                n = pc.list_value_length(part.column(4))
                gram = np.repeat(part.column(3).to_numpy(), n.to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(gram), *(pc.list_flatten(part.column(k).combine_chunks()) for k in (4, 5))], ["gram", "snippet", "at"])

    met = rows.repartition(parts, "high", "low").sortWithinPartitions("high", "low").select("high", "low", "shard", "gram", "snippets", "ats").mapInArrow(merge, "gram long, snippet long, at int")

    def runs(batches):
        for b in batches:
            out = []
            for places in b.column(2).to_pylist():
                p = np.unique(np.array(places))
                gap = np.flatnonzero(np.diff(p) > 1)
                out.append(np.stack([p[np.r_[0, gap + 1]], p[np.r_[gap, len(p) - 1]] + 1], axis=1).astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["gram", "snippet", "runs"])

    return met.groupBy("gram", "snippet").agg(F.collect_list("at")).mapInArrow(runs, "gram long, snippet long, runs binary")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).select("doc_id", F.xxhash64("text").alias("mark"), "text")


def _same(a: DataFrame, b: DataFrame):
    return a.doc_id.eqNullSafe(b.doc_id) & (a.mark == b.mark)


def spans(docs: DataFrame, length: int = 200, split: int = 2048, shard_bytes: int = 1 << 18) -> DataFrame:
    """``doc_id, mark, places``: binary places of the repeated windows, for the texts that have any.

    ``docs`` has doc_id, mark (text hash) and text. ``split`` is the number of different snippets of a minimizer
    beyond which it goes to several shards, ``shard_bytes`` the size beyond which a shard takes no further minimizer.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    occ, occ_path = written(occurrences(docs, length), "grams")
    more = occ.groupBy("gram").agg(F.sum(F.size("at")).alias("c"), F.min("snippet").alias("a"), F.max("snippet").alias("z"))
    # Written, so that the join is one of two plain shuffles, and adaptive execution splits a gram of very many rows.
    more, more_path = written(more.where("c > 1").select("gram", (F.col("a") == F.col("z")).alias("alike")), "repeated")
    hits, _ = written(occ.join(more, "gram"), "hits")
    remove(spark, occ_path)
    remove(spark, more_path)
    unlike = hits.where("not alike").groupBy("gram", "snippet").agg(F.sum(F.size("at")).alias("copies"), F.min(F.struct("doc_id", "mark", F.get("at", F.lit(0)).alias("at"), "n")).alias("r"))
    chosen = unlike.select("gram", "snippet", "copies", "r.*").groupBy("doc_id", "mark").agg(F.collect_list(F.struct("gram", "snippet", "copies", "at", "n")).alias("wanted"))

    def cut(batches):
        for b in slices(batches):
            for wanted, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                cols = [[w[k] for w in wanted] for k in ("gram", "snippet", "copies")]
                texts = [data[w["at"] : w["at"] + w["n"] + length - 1] for w in wanted]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array(texts, pa.binary())], ["gram", "snippet", "copies", "data"])

    texts = docs.join(chosen, _same(docs, chosen)).select("wanted", "text").mapInArrow(cut, "gram long, snippet long, copies long, data binary")
    snippets, _ = written(texts.dropDuplicates(["gram", "snippet"]), "snippets")
    many = snippets.groupBy("gram").count().where(F.col("count") > split).select("gram", F.ceil(F.col("count") / split).alias("shards"))
    dealt = snippets.join(many, "gram", "left").select("gram", F.when(F.col("shards").isNull(), F.lit(0)).otherwise(F.pmod("snippet", "shards")).cast("long").alias("shard"), "snippet", "copies", "data", F.col("shards").isNotNull().alias("split"))
    cols = ["gram", "shard", "snippet", "copies", "data"]
    sorted_ = lambda df: df.select(cols).repartition(parts, "gram", "shard").sortWithinPartitions("gram", "shard")
    found = _windows_of(sorted_(dealt), length, shard_bytes)
    if not many.isEmpty():
        found = found.union(_across(sorted_(dealt.where("split")), length, shard_bytes, parts))
    verdict, _ = written(found.groupBy("gram", "snippet").agg(F.collect_list("runs").alias("runs")), "verdicts")
    place = [F.col("doc_id"), F.col("mark"), F.col("at"), F.col("n")]
    alike = hits.where("alike").select(*place, F.lit(None).cast("array<binary>").alias("runs"))
    other = hits.where("not alike").join(verdict, ["gram", "snippet"]).select(*place, "runs")
    all_ = alike.union(other.where(F.exists("runs", lambda r: F.length(r) > 0)))
    # A set: rows that are repeated as a whole bring the same places, which partial sets make one before the shuffle.
    return all_.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("at", "n", "runs")).alias("places"))


def _removed(size: int, places, length: int) -> np.ndarray:
    """Starts and ends of the maximal runs of bytes that the windows cover."""
    starts, ends = [], []
    for p in () if places is None else places:
        at = np.asarray(p["at"], np.int64)
        if p["runs"] is None:
            starts.append(at)
            ends.append(at + p["n"] + length - 1)
        else:
            for r in p["runs"]:
                pair = np.frombuffer(r, "<i4").reshape(-1, 2)
                starts.append(np.add.outer(at, pair[:, 0]).ravel())
                ends.append(np.add.outer(at, pair[:, 1]).ravel() + length - 1)
    if not starts:
        return np.zeros((0, 2), np.int64)
    a, z = np.concatenate(starts), np.concatenate(ends)
    by = np.argsort(a, kind="stable")
    a, z = a[by], np.maximum.accumulate(z[by])
    new = np.flatnonzero(np.r_[True, a[1:] > z[:-1]])
    return np.stack([a[new], z[np.r_[new[1:] - 1, len(a) - 1]]], axis=1)


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, **limits) -> DataFrame:
    """For every row: ``doc_id, mark, n_bytes, n_removed, n_spans, kept`` (the bytes that remain)."""
    rows = keyed(docs, id_col, text_col)
    found = spans(rows, length, **limits)

    def run(batches):
        for b in slices(batches):
            sizes, gone, runs, kept = [], [], [], []
            for text, places in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                cut = _removed(len(data), places, length)
                edges = [0, *cut.ravel().tolist(), len(data)]
                sizes.append(len(data))
                gone.append(int((cut[:, 1] - cut[:, 0]).sum()))
                runs.append(len(cut))
                kept.append(b"".join(data[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True)) if len(cut) else data)
            longs = [pa.array(x, pa.int64()) for x in (sizes, gone, runs)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *longs, pa.array(kept, pa.binary())], ["doc_id", "mark", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = rows.join(found, _same(rows, found), "left").select(rows.doc_id, rows.mark, rows.text, "places")
    return joined.mapInArrow(run, "doc_id long, mark long, n_bytes long, n_removed long, n_spans long, kept binary")


def cut_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, drop_emptied: bool = False, **limits) -> DataFrame:
    """``docs`` with the repeated passages cut out of the text, and what is left's length in n_chars if that column is there.

    All other columns stay as they are, whatever their names. ``drop_emptied`` leaves out the rows that lose their last word.
    """
    marked = docs.select(beside(docs), named(id_col).cast("long").alias("doc_id"), F.coalesce(named(text_col), F.lit("")).alias("text"))
    marked = marked.withColumn("mark", F.xxhash64("text"))
    found = spans(marked.select("doc_id", "mark", "text"), length, **limits)

    @F.pandas_udf("text string, removed long")
    def cut(texts: pd.Series, places: pd.Series) -> pd.DataFrame:
        kept, gone = [], []
        for text, p in zip(texts, places, strict=True):
            data = text.encode("utf-8", "surrogatepass")
            runs = _removed(len(data), p, length)
            edges = [0, *runs.ravel().tolist(), len(data)]
            kept.append(b"".join(data[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True)).decode("utf-8", "ignore") if len(runs) else text)
            gone.append(int((runs[:, 1] - runs[:, 0]).sum()))
        return pd.DataFrame({"text": kept, "removed": gone})

    joined = marked.join(found, _same(marked, found), "left").select("row", marked.text, "places")
    out = joined.select("row", cut("text", "places").alias("cut"))
    if drop_emptied:
        out = out.where((F.col("cut.removed") == 0) | F.col("cut.text").rlike(r"[^\x20\x09-\x0D]"))
    was = F.col("row").getField
    columns = {text_col: F.when(F.col("cut.removed") > 0, F.col("cut.text")).otherwise(was(text_col)), "n_chars": F.length(F.col("cut.text")).cast("long")}
    return out.select(*(columns.get(c, was(c)).alias(c) for c in docs.columns))
