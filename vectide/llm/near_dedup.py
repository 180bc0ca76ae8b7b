"""Near-duplicate detection with bottom-k sketches from one hash function.

1. A document's shingles are hashed once; documents with equal sets form a class. A class's sketch is its k smallest
   hashes.
2. Inverted lists of retained values generate pairs. In one order of all values, rare before frequent, a pair that
   shares enough of its sketches shares one of each side's first values, so only those have lists.
3. The estimate from the union's sketch drops pairs that are clearly below the limit.
4. Exact Jaccard on full sets confirms links: first each class with its likeliest partner, then, by component, only
   pairs that would still join two components.

Lists longer than LIST are not paired. Their classes get an exact index over full sets instead: by size band, the
first shingles in rare-first order that a pair above the limit must share. Lists that are still long hold mostly near
copies of each other: all members are compared to a few of the list, and members that end up in another component than
most of the list are looked at again. If pairing them with their lists would be more than MORE pairs a row, their lists
are first split by a second shingle, and so on, as a linked pair shares not only the first shingles but, a place
further, the next ones too. All pairs that are left are compared.

A list never meets in one task: what is known of a long list is broadcast, as there can be few long ones.

What chance leaves: a linked pair of two sets of more than k shingles shares fewer than SHARED of the union's k smallest
values in about one of ten million cases (k = 64, limit 0.8), and so it is for a pair with one such set in the estimate
from the union's sketch. The index entries of a set of at most k shingles allow for partners whose sketches are cut and
lose no link. Different shingles with equal 64-bit hashes would count as one.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectide.llm.common import as_text, discard, join_counted, stored, table, tidy
from vectide.llm.words import Words, blocks, mixed

#: Retained hashes; how many of a union's k smallest a linked pair shares at least; the longest list that is paired; members that a longer list is compared to.
K, SHARED, LIST, HEADS = 64, 33, 32, 8
#: Pairs a row that may be compared without splitting lists further, and the most shingles that split a list.
MORE, DEEPEST = 4096, 4
#: Splitting lists goes on only while it leaves at most such a share of the pairs; lists of near copies don't get shorter by it.
GAIN = 0.5
#: Links need PARTS * common >= LIMIT * union.
LIMIT, PARTS = 80, 100
#: Counters of the frequencies that order values; the ratio of sizes in a band.
COUNTERS, BAND = 1 << 20, 1.06
_STEP = 0x9E3779B97F4A7C15


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted hashes; a text of fewer words is one shingle, one without words none."""
    w = Words(texts)
    per = w.per_doc()
    off = np.concatenate([[0], np.cumsum(per)])
    rolled = np.zeros(max(0, len(w.hash) - width + 1), dtype=np.uint64)
    for k in range(width):
        rolled += w.hash[k : k + len(rolled)] * np.uint64(pow(_STEP, k, 2**64))
    rolled = mixed(rolled)
    out = []
    for k, n in enumerate(per):
        a = off[k]
        if n >= width:
            out.append(np.unique(rolled[a : a + n - width + 1]))
        elif n:
            short = sum(int(h) * pow(_STEP, j, 2**64) for j, h in enumerate(w.hash[a : a + n])) + int(n)
            out.append(mixed(np.array([short % 2**64], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def sketched(docs: DataFrame, id_col: str, text_col: str, width: int, k: int) -> DataFrame:
    """id, n (shingles), digest of the set, sketch (bytes of its k smallest hashes) of each row."""
    rows = docs.select(F.col(id_col).alias("id"), as_text(text_col).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, kept in blocks(batches, "text", ["id"]):
            sets = shingle_sets(texts, width)
            yield pa.RecordBatch.from_arrays([kept.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s[:k].tobytes() for s in sets], pa.binary())], names=["id", "n", "digest", "sketch"])

    return rows.mapInArrow(work, f"id {rows.schema['id'].dataType.simpleString()}, n long, digest binary, sketch binary")


def _arrays(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in column]


def frequencies(sets: DataFrame, column: str) -> np.ndarray:
    """Counters of values by their leading bits, COUNTERS at most: the same for all, so that they give one order."""
    shift = np.uint64(64 - (COUNTERS.bit_length() - 1))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(COUNTERS, dtype=np.int64)
        for batch in batches:
            values = _arrays(batch.column(0))
            if values:
                np.add.at(sums, (mixed(np.concatenate(values)) >> shift).astype(np.int64), 1)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(sums[used])], names=["at", "n"])

    got = sets.select(column).mapInArrow(work, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    out = np.zeros(COUNTERS, dtype=np.int64)
    out[got["at"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return np.minimum(out, 2**31 - 1).astype(np.int32)


def _ranked(values: np.ndarray, counters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values from rare to frequent, and their counters."""
    freq = counters[(mixed(values) >> np.uint64(64 - (COUNTERS.bit_length() - 1))).astype(np.int64)]
    order = np.lexsort((values, freq))
    return values[order], freq[order]


def least_overlap(n: int, m: int) -> int:
    """The fewest common shingles of linked sets of n and m."""
    return -(-LIMIT * (n + m) // (PARTS + LIMIT))


@lru_cache(1 << 16)
def _bands(n: int) -> list[tuple[int, int]]:
    """For a set of n: each band of the smaller partner's size and how many first shingles to index there."""
    out = {}
    low = max(1, -(-LIMIT * n // PARTS))
    for band in range(int(math.log(low) / math.log(BAND)), int(math.log(n) / math.log(BAND)) + 1):
        smallest = max(low, math.ceil(BAND**band - 1e-9))
        if smallest <= n:
            out[band] = n - least_overlap(n, smallest) + 1
    return list(out.items())


@lru_cache(1 << 16)
def sketch_overlap(n: int, k: int, shared: int) -> int:
    """The fewest common sketch values of a set of n and any linked partner; a partner of more than k has lost all beyond k, in the worst case common ones."""
    if n > k:
        return shared
    return min(least_overlap(n, m) - max(0, m - k) for m in range(-(-LIMIT * n // PARTS), PARTS * n // LIMIT + 1))


def sketch_index(classes: DataFrame, counters: np.ndarray, k: int, shared: int) -> DataFrame:
    """key, at, id, n: a row for each of a sketch's first values that is not alone."""
    sent = classes.sparkSession.sparkContext.broadcast(counters)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids, sizes, pos = [], [], [], []
            for i, n, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _arrays(batch.column(2)), strict=True):
                v, f = _ranked(s, sent.value)
                need = sketch_overlap(n, k, shared)
                v, f = v[: len(s) - need + 1], f[: len(s) - need + 1]
                at = np.flatnonzero(f > 1)
                keys.append(v[at])
                pos.append(at)
                ids += [i] * len(at)
                sizes += [n] * len(at)
            yield _index_rows(keys, pos, ids, sizes, np.zeros(len(ids), dtype=np.int32))

    return classes.select("id", "n", "sketch").mapInArrow(work, _INDEX)


_INDEX = "key long, band int, at int, id long, n long"


def _index_rows(keys: list[np.ndarray], pos: list[np.ndarray], ids: list[int], sizes: list[int], bands: np.ndarray) -> pa.RecordBatch:
    key = np.concatenate([*keys, np.zeros(0, np.uint64)]).view(np.int64)
    at = np.concatenate([*pos, np.zeros(0, np.int64)]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(bands), pa.array(at), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64())], names=["key", "band", "at", "id", "n"])


def set_index(sets: DataFrame, counters: np.ndarray) -> DataFrame:
    """key, band, at, id, n: for each size band of the smaller partner, a row for each first shingle that is not alone."""
    sent = sets.sparkSession.sparkContext.broadcast(counters)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, n, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _arrays(batch.column(2)), strict=True):
                v, f = _ranked(s, sent.value)
                rows = [(band, np.flatnonzero(f[:first] > 1)) for band, first in _bands(n)]
                some = [(band, at) for band, at in rows if len(at)]
                size = sum(len(at) for _, at in some)
                if size:
                    yield _index_rows([v[at] for _, at in some], [at for _, at in some], [i] * size, [n] * size, np.repeat(np.array([b for b, _ in some], np.int32), [len(at) for _, at in some]))

    return sets.select("id", "n", "shingles").mapInArrow(work, _INDEX)


def lists(index: DataFrame, label: str) -> DataFrame:
    """The index with the length of each row's list; lists of one are gone."""
    index = stored(index, f"{label}-index")
    sizes = stored(index.groupBy("key", "band").agg(F.count("*").alias("size")).where("size > 1"), f"{label}-sizes")
    out = stored(join_counted(index, sizes, ["key", "band"], "size"), f"{label}-lists")
    discard(index, sizes)
    return out


def _fit(whole: bool, depth: int = 1):
    """Whether rows a, b of one list can be linked by their sizes and, if places count in whole sets, by what comes from the list's last value on: the first common values of a linked pair leave both enough."""
    sizes = PARTS * F.least("na", "nb") >= LIMIT * F.greatest("na", "nb")
    if not whole:
        return sizes
    need = F.ceil(LIMIT * (F.col("na") + F.col("nb")) / (PARTS + LIMIT)) - (depth - 1)
    return sizes & (F.col("na") - F.col("pa") >= need) & (F.col("nb") - F.col("pb") >= need)


def _side(rows: DataFrame, name: str, *more: str) -> DataFrame:
    return rows.select("key", "band", F.col("id").alias(name), F.col("n").alias(f"n{name}"), F.col("at").alias(f"p{name}"), *more)


def _ordered(both: DataFrame, depth: int = 1) -> DataFrame:
    """Distinct pairs a < b of members of one list of whole sets that may be linked."""
    fit = both.where((F.col("a") != F.col("b")) & _fit(True, depth))
    return fit.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def listed_pairs(listed: DataFrame, whole: bool) -> DataFrame:
    """Distinct pairs a < b of members of short lists that may be linked."""
    short = listed.where(F.col("size") <= LIST)
    both = _side(short, "a").join(_side(short, "b"), ["key", "band"])
    return both.where((F.col("a") < F.col("b")) & _fit(whole)).select("a", "b").distinct()


def star_pairs(listed: DataFrame) -> DataFrame:
    """Members of long lists with a few of the list, those whose first shared value comes earliest and so have least of their own."""
    long = listed.where(F.col("size") > LIST)
    first = F.row_number().over(Window.partitionBy("key", "band").orderBy(F.col("at") / F.col("n"), "id"))
    heads = stored(long.withColumn("k", first).where(F.col("k") <= HEADS), "near-heads")
    return _ordered(join_counted(_side(long, "a"), _side(heads, "b", "size"), ["key", "band"], "size"))


def apart_lists(members: DataFrame, label: str) -> DataFrame:
    """Of members of long lists with their roots, the lists of more than one root: key, band, at, id, n, size, aparts (of the list), apart (whether the row has another root than most)."""
    by_root = members.groupBy("key", "band", "root").agg(F.count("*").alias("n_root"))
    most = by_root.groupBy("key", "band").agg(F.max(F.struct("n_root", "root")).alias("most"), F.sum("n_root").alias("size"))
    most = most.select("key", "band", F.col("most.root").alias("most"), "size", (F.col("size") - F.col("most.n_root")).alias("aparts")).where("aparts > 0")
    found = join_counted(members.drop("size"), stored(most, f"{label}-most"), ["key", "band"], "size")
    return stored(found.select("key", "band", "at", "id", "n", "size", "aparts", (F.col("root") != F.col("most")).alias("apart")), f"{label}-apart")


def deeper(lists: DataFrame, sets: DataFrame, counters: np.ndarray, depth: int, label: str) -> DataFrame:
    """apart_lists, each split by one more shingle: after depth values in common, a linked pair shares another one among the first that leave enough."""
    sent = sets.sparkSession.sparkContext.broadcast(counters)
    # the lists that a set is in are bounded by its own first shingles
    own = lists.groupBy("id").agg(F.collect_list(F.struct("key", "band", "at", "apart")).alias("lists"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, n, s, lists_of in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _arrays(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                v, f = _ranked(s, sent.value)
                first = dict(_bands(n))
                keys, places, bands, aparts = [], [], [], []
                for x in lists_of:
                    at = x["at"] + 1 + np.flatnonzero(f[x["at"] + 1 : first[x["band"]] + depth] > 1)
                    keys.append(mixed(v[at] ^ mixed(np.array([x["key"]], np.int64).view(np.uint64))))
                    places.append(at)
                    bands.append(np.full(len(at), x["band"], np.int32))
                    aparts.append(np.full(len(at), x["apart"], bool))
                size = sum(map(len, keys))
                if size:
                    rows = _index_rows(keys, places, [i] * size, [n] * size, np.concatenate(bands))
                    yield rows.append_column("apart", pa.array(np.concatenate(aparts)))

    rows = stored(own.join(sets, "id").select("id", "n", "shingles", "lists").mapInArrow(work, f"{_INDEX}, apart boolean"), f"{label}-index")
    sizes = rows.groupBy("key", "band").agg(F.count("*").alias("size"), F.sum(F.col("apart").cast("long")).alias("aparts")).where("size > 1 and aparts > 0")
    out = stored(join_counted(rows, stored(sizes, f"{label}-sizes"), ["key", "band"], "size"), f"{label}-lists")
    discard(rows)
    return out


def _work(lists: DataFrame) -> int:
    """How many pairs apart_pairs looks at."""
    return lists.agg(F.sum(F.when(F.col("apart"), F.col("size")))).first()[0] or 0


def apart_pairs(lists: DataFrame, sets: DataFrame, counters: np.ndarray, rows: int) -> DataFrame:
    """Distinct pairs of each row that is apart with the other rows of its list that it may be linked to; lists are split while that is more than MORE pairs a row and helps."""
    depth, work = 1, _work(lists)
    while depth < DEEPEST and work > MORE * rows:
        split = deeper(lists, sets, counters, depth, f"near-deep-{depth}")
        left = _work(split)
        if left > GAIN * work:
            discard(split)
            break
        lists, work, depth = split, left, depth + 1
    of = stored(lists.where("apart"), "near-sides")
    return _ordered(join_counted(_side(lists, "a"), _side(of, "b", "size"), ["key", "band"], "size"), depth)


def estimated(pairs: DataFrame, classes: DataFrame, k: int, shared: int) -> DataFrame:
    """a, b, share: pairs whose estimate from the union's sketch does not rule out a link. A sketch is sent as the leading 32 bits of its values."""
    from pyspark.sql.types import BinaryType

    @F.pandas_udf(BinaryType())
    def short(sketch):
        return sketch.map(lambda b: (np.frombuffer(b, np.uint64) >> np.uint64(32)).astype(np.uint32).tobytes())

    few = classes.select("id", short("sketch").alias("sketch"))
    x = few.select(F.col("id").alias("a"), F.col("sketch").alias("x"))
    y = few.select(F.col("id").alias("b"), F.col("sketch").alias("y"))
    both = pairs.join(x.hint("merge"), "a").join(y.hint("merge"), "b").select("a", "b", "x", "y")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            share = np.zeros(batch.num_rows, dtype=np.float64)
            for j, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                s, t = np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32)
                u = np.sort(np.concatenate([s, t]))
                twice = u[1:] == u[:-1]
                firsts = np.concatenate([[True], ~twice])
                rank = np.cumsum(firsts)[:-1][twice]
                size = int(firsts.sum())
                same = int((rank <= k).sum())
                if len(s) < k and len(t) < k:
                    # both are whole sets, so this is exact but for equal leading bits
                    same = int(twice.sum())
                    share[j] = same / max(1, size) if PARTS * (same + 1) >= LIMIT * size else -1
                else:
                    share[j] = same / min(k, size) if same >= shared * min(k, size) / k else -1
            keep = pa.array(share >= 0)
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(share)], names=["a", "b", "share"])
            yield out.filter(keep)

    return both.mapInArrow(work, "a long, b long, share double")


def full_sets(docs: DataFrame, needed: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """id, n, shingles of the needed classes (id, doc, digest), from one document of each."""
    rows = docs.select(F.col(id_col).alias("doc"), as_text(text_col).alias("text")).join(needed.select("id", "doc", "digest").hint("merge"), "doc").select("id", "digest", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for texts, kept in blocks(batches, "text", ["id", "digest"]):
            out = []
            for i, d, s in zip(kept.column(0).to_pylist(), kept.column(1).to_pylist(), shingle_sets(texts, width), strict=True):
                if i not in seen and _digest(s) == d:
                    seen.add(i)
                    out.append((i, len(s), s.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary())], names=["id", "n", "shingles"])

    return rows.mapInArrow(work, "id long, n long, shingles binary")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs a, b that are links by their full sets."""
    x = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    both = pairs.select("a", "b").join(x.hint("merge"), "a").join(y.hint("merge"), "b").select("a", "b", "x", "y")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                u = np.sort(np.concatenate([s, t]))
                same = int((u[1:] == u[:-1]).sum())
                keep.append(PARTS * same >= LIMIT * (len(s) + len(t) - same))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(work, "a long, b long").distinct()


def components(edges: DataFrame, label: str) -> DataFrame:
    """id, root of every end of edges a, b: alternating large and small stars until nothing changes; a root is its component's smallest id."""
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{label}-edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = stored(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"{label}-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), f"{label}-small")
        discard(now, large)
        now, seen = new, mark
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen:
            return now.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def rooted(rows: DataFrame, roots: DataFrame, col: str, out: str) -> DataFrame:
    """rows with the root of an id column, itself if it has none."""
    r = roots.select(F.col("id").alias(col), F.col("root").alias(out))
    return rows.join(r, col, "left").withColumn(out, F.coalesce(out, col))


def crossing(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends have different roots."""
    return rooted(rooted(pairs, roots, "a", "ra"), roots, "b", "rb").where("ra <> rb")


def joined(roots: DataFrame, links: DataFrame, label: str) -> DataFrame:
    """Roots after more links between components."""
    over = rooted(rooted(links, roots, "a", "ra"), roots, "b", "rb")
    ends = over.select(F.col("a").alias("id"), F.col("ra").alias("old")).unionByName(over.select(F.col("b").alias("id"), F.col("rb").alias("old")))
    top = components(over.select(F.col("ra").alias("a"), F.col("rb").alias("b")), label).select(F.col("id").alias("old"), F.col("root").alias("top"))
    every = roots.select("id", F.col("root").alias("old")).unionByName(ends).distinct()
    return stored(every.join(top, "old", "left").select("id", F.coalesce("top", "old").alias("root")), f"{label}-roots")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, k: int = K, shared: int = SHARED
) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (the smallest id of all that links reach), kept.

    A text without words, or null, has no shingles and no links; its component is its own id. Rows with a null id are
    in no component and kept. Rows that repeat a text are in one component; those that repeat its smallest id are all
    kept. An empty table gives no rows; other input columns may have any names; texts of any length are read whole.
    """
    spark = docs.sparkSession
    tidy(spark)
    rows = stored(sketched(docs, id_col, text_col, width, k), "near-rows")
    same = (F.min("id").alias("doc"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.count("*").alias("copies"))
    classes = rows.where("n > 0 and id is not null").groupBy("digest").agg(*same)
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()), "near-classes")

    listed = lists(sketch_index(classes, frequencies(classes, "sketch"), k, shared), "near-sketch")
    tidy(spark)
    found = stored(estimated(listed_pairs(listed, False), classes, k, shared), "near-pairs")
    crowded = stored(listed.where(F.col("size") > LIST).select("id").distinct(), "near-crowded")
    needed = found.select(F.col("a").alias("id")).unionByName(found.select(F.col("b").alias("id"))).unionByName(crowded).distinct()
    sets = stored(full_sets(docs, classes.join(needed, "id"), id_col, text_col, width), "near-sets")
    tidy(spark)

    own = stored(sets.join(crowded, "id", "left_semi"), "near-own")
    order = frequencies(own, "shingles")
    longer = lists(set_index(own, order), "near-set")
    tidy(spark)
    more = stored(estimated(listed_pairs(longer, True).unionByName(star_pairs(longer)).distinct(), classes, k, shared), "near-more")
    pairs = found.unionByName(more).distinct()
    tidy(spark)

    ends = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "share"))
    best = ends.groupBy("a").agg(F.max(F.struct("share", F.col("b").alias("b"))).alias("best"))
    best = best.select(F.least("a", "best.b").alias("a"), F.greatest("a", "best.b").alias("b")).distinct()
    roots = stored(components(stored(verified(best, sets), "near-best"), "near-1"), "near-roots")
    tidy(spark)
    roots = joined(roots, stored(verified(crossing(pairs, roots), sets), "near-links"), "near-2")
    tidy(spark)

    members = stored(rooted(longer.where(F.col("size") > LIST), roots, "id", "root"), "near-members")
    apart = apart_lists(members, "near")
    if not apart.isEmpty():
        rest = stored(crossing(apart_pairs(apart, own, order, classes.count()), roots).select("a", "b"), "near-rest")
        roots = joined(roots, stored(verified(estimated(rest, classes, k, shared), sets), "near-late"), "near-3")
        discard(rest)
        tidy(spark)

    labelled = stored(rooted(classes.select("id", "doc", "digest", "copies"), roots, "id", "root"), "near-labelled")
    smallest = labelled.groupBy("root").agg(F.min("doc").alias("component_id"))
    of = stored(labelled.join(smallest, "root").select("digest", "copies", "component_id"), "near-components")
    discard(classes, listed, found, crowded, sets, own, longer, more, members, apart, labelled)
    linked = "n > 0 and id is not null"
    out = join_counted(rows.where(linked).select("id", "n", "digest"), of, ["digest"], "copies", "left").select("id", "n", "component_id")
    lone = rows.where(f"not ({linked})").select("id", "n", F.col("id").alias("component_id"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
    return out.unionByName(lone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def op4_bottomk_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)
