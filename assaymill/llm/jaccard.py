"""Exact Jaccard join of word-shingle sets: pivots, regions around them, regions joined again and exactly.

Documents of equal sets are one class. In plain text nearly all distances between documents are 1, where
pivots tell nothing apart, so regions start from what two linked sets must share. Of the shingles of a set
in one global order (frequent ones last), take the first fifth and a twentieth more: linked sets share a
twentieth of the smaller one's shingles there, so classes with fewer shared first shingles drop out. The members
of a shingle's region have a pivot, its smallest id. Every class goes to its nearest pivot (most shared first shingles), links to
pivots are verified on whole sets, and components join what is linked. Shingles that no other set left has
can't be shared, which bounds what a pair can have in common. Regions whose members are still in several
components are joined again: each member with all of its largest region, its home, in blocks; then the pairs that
meet only in regions that are home to neither, one by one. So each pair that links is compared or connected
already, and copies are never expanded into pairs. Triangle-inequality windows on distances to pivots were tried
and tell too little apart here (see README); set sizes, common parts and shared first shingles bound pairs instead.

Only ``order_of`` estimates anything: shingle frequencies, which decide the order and never a result.
Null and wordless texts have an empty set and link with nothing; texts of fewer than five words are one
shingle; null keys link with nothing; repeated rows are one class, texts of one key are classes of their own;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewise import lower, row_hashes, runs, span_hashes
from .common import kept, run_folder, small_or_joined, spread, stored, trim, whole_text
from .graph import components, forest
from .quality import pieces

WORDS, SHARE = 5, 80
#: A set of n shingles and any set it links with share n // SURE of their first shingles, taking that many more.
SURE = 20
#: Slots of the frequency estimate, what an estimate counts as frequent, and slots whose levels one row holds.
SLOTS, FREQUENT, LEVELS = 1 << 22, 16, 1 << 16
#: Logarithm of the estimated frequency above which a region starts in parts of about so many members.
HOT_LEVEL = 10
#: Ids that are sent to all tasks at most, and rounds of dropping classes that share too little.
IDS_AT_ONCE, PRUNINGS = 2_000_000, 2
#: Sets that are compared with as many others at once, their bytes, and shingles of them that are looked at together.
BLOCK, BLOCK_BYTES, COLUMNS = 512, 8 << 20, 2048
IN_WORD = np.ones(256, bool)
IN_WORD[[32, *range(9, 14)]] = False


def shingles(raw: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    small = lower(raw)
    s, e = runs(IN_WORD[small], at)
    words, first = span_hashes(small, s, e), np.searchsorted(s, at)
    full = row_hashes(words, WORDS)
    for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if j - i >= WORDS:
            yield np.unique(full[i : j - WORDS + 1])
        else:
            yield row_hashes(words[i:j], j - i) if j > i else np.empty(0, np.uint64)


def slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def order_of(docs: DataFrame) -> Broadcast:
    """A level for each slot: 0, or the logarithm of how many of the texts, by estimate, have shingles that fall there.

    A task reports the slots that stand out four times above its mean; the table has SLOTS entries at any size.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.uint32)  # a task's texts are far fewer
        for b in batches:
            for raw, at in pieces(b.column(1)):
                each = [np.unique(slot(u)) for u in shingles(raw, at)]
                u, n = np.unique(np.concatenate(each) if each else np.empty(0, np.int64), return_counts=True)
                total[u] += n.astype(np.uint32)
        out = np.flatnonzero(total >= max(2, 4 * total.mean()))
        n = total[out].astype(np.int64)
        del total
        yield pa.RecordBatch.from_arrays([pa.array(out), pa.array(n)], names=["slot", "n"])
        trim()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for b in batches:
            chunk, at, n = (c.to_numpy() for c in b.columns)
            for k in np.unique(chunk).tolist():
                own = chunk == k
                made.setdefault(k, np.zeros(LEVELS, np.uint8))[at[own]] = np.frexp(n[own].astype(float))[1]  # bits of n
        yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.int64()), pa.array([x.tobytes() for x in made.values()], pa.binary())], names=["chunk", "levels"])

    seen = docs.mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    dealt = seen.select(F.floor(F.col("slot") / LEVELS).alias("chunk"), (F.col("slot") % LEVELS).alias("at"), "n").repartition(spread(docs.sparkSession), "chunk")
    level = np.zeros(SLOTS, np.uint8)
    for r in dealt.mapInArrow(build, "chunk long, levels binary").collect():  # a byte for each slot at most
        level[r.chunk * LEVELS :][:LEVELS] = np.frombuffer(r.levels, np.uint8)
    return docs.sparkSession.sparkContext.broadcast(level)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without those that an equal set of a smaller id stands for; rows of one id aren't told apart."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [digest(u) for raw, at in pieces(b.column(1)) for u in shingles(raw, at)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary())], names=["id", "key"])

    known = docs.where("id IS NOT NULL")
    keys = stored(known.mapInArrow(go, "id long, key binary"), "digests")
    many = keys.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most")
    copies = stored(keys.join(many, "key").where("id > least").select("id").distinct(), "copies")
    return known.join(F.broadcast(copies) if copies.count() <= IDS_AT_ONCE else copies, "id", "left_anti")


def digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def summaries(docs: DataFrame, order: Broadcast) -> DataFrame:
    """(id, mark, n, key, first): size and digest of each set, and its first shingles in the global order."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = order.value
        for b in batches:
            sizes, keys, firsts = [], [], []
            for raw, at in pieces(b.column(1)):
                for u in shingles(raw, at):
                    sizes.append(len(u))
                    keys.append(digest(u))
                    own = level[slot(u)]
                    most = len(u) - -(-SHARE * len(u) // 100) + max(1, len(u) // SURE) if len(u) else 0
                    firsts.append((u[np.lexsort((u, own))] if own.any() else u)[:most])
            ends = np.cumsum([0, *map(len, firsts)])
            flat = pa.array(np.concatenate(firsts).view(np.int64) if firsts else [], pa.int64())
            columns = [b.column(0), b.column(2), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "mark", "n", "key", "first"])
            del sizes, keys, firsts, ends, flat, columns
        trim()

    return docs.mapInArrow(go, "id long, mark long, n long, key binary, first array<long>")


def around_pivots(members: DataFrame) -> DataFrame:
    """(region, salt, id, pivot) of all but the pivots: the smallest id of each region is its pivot.

    Parts (salt >= 0) keep a row of their pivot also, for it has yet to meet the region's other parts.
    Regions stream by in order, so a task holds a batch whatever the size of a region.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            region, salt, ids = (c.to_numpy() for c in b.columns)
            new = np.concatenate([[last is None or (region[0], salt[0]) != last[:2]], (region[1:] != region[:-1]) | (salt[1:] != salt[:-1])])
            begin = np.maximum.accumulate(np.where(new, np.arange(len(ids)), -1))
            pivot = np.where(begin >= 0, ids[begin], last[2] if last else 0)
            last = region[-1], salt[-1], pivot[-1]
            rest = np.flatnonzero((ids != pivot) | (salt >= 0))
            yield pa.RecordBatch.from_arrays([pa.array(x[rest]) for x in (region, salt, ids, pivot)], names=["region", "salt", "id", "pivot"])

    spark = members.sparkSession
    return members.select("region", "salt", "id").repartition(spread(spark), "region", "salt").sortWithinPartitions("region", "salt", "id").mapInArrow(go, "region long, salt int, id long, pivot long")


def sets_of(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, hashes) of classes (class, doc, key), each read from that text of its document whose set has its digest.

    A bounded list of classes is broadcast, a longer one joined.
    """
    named = F.broadcast(classes) if classes.count() <= IDS_AT_ONCE // 2 else classes

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = (u for raw, at in pieces(b.column(1)) for u in shingles(raw, at))
            made = [u.tobytes() if digest(u) == key else None for u, key in zip(own, b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=["id", "hashes"])

    read = docs.join(named, F.col("id") == F.col("doc")).select("class", "text", "key")
    made = stored(read.mapInArrow(go, "id long, hashes binary").where("hashes IS NOT NULL"), "shingle-sets")
    return made if made.count() == made.select("id").distinct().count() else made.dropDuplicates(["id"])


def common_counts(sets: DataFrame) -> DataFrame:
    """(id, alone): how many of a set's shingles no other of the sets has."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = np.frombuffer(raw.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), i))], names=["token", "id"])

    once = sets.mapInArrow(go, "token long, id long").groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).where("n = 1")
    return once.groupBy("id").agg(F.count(F.lit(1)).alias("alone"))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, shared, union) of pairs of ids, on whole sets."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shared, union = [], []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                small, large = sorted((x, y), key=len)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                shared.append(int((large[at] == small).sum()))
                union.append(len(x) + len(y) - shared[-1])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(shared, pa.int64()), pa.array(union, pa.int64())], names=["a", "b", "shared", "union"])

    one, other = (sets.select(F.col("id").alias(c), F.col("hashes").alias(f"set_{c}")) for c in "ab")
    loaded = pairs.select("a", "b").join(one, "a").join(other, "b").select("a", "b", "set_a", "set_b")
    return stored(loaded.mapInArrow(go, "a long, b long, shared long, union long"), "verified")


def may_link(n_x: str, c_x: str, n_y: str, c_y: str) -> Column:
    """Whether sizes and common parts leave room for a link: the intersection is no larger than either common part."""
    return F.least(n_x, n_y, c_x, c_y) * (100 + SHARE) >= (F.col(n_x) + F.col(n_y)) * SHARE


def incidence(sets: list[np.ndarray], columns: np.ndarray) -> np.ndarray:
    """Which of the sorted columns each set has."""
    out = np.zeros((len(sets), len(columns)), np.float32)
    for i, x in enumerate(sets):
        at = np.searchsorted(columns, x)
        at = at[(at < len(columns))]
        x = x[: len(at)]
        out[i, at[columns[at] == x]] = 1
    return out


def shared_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """The intersection size of every set of ``a`` with every set of ``b``, by products of 0/1 matrices."""
    columns = np.intersect1d(np.unique(np.concatenate(a)), np.unique(np.concatenate(b)), assume_unique=True)
    out = np.zeros((len(a), len(b)), np.float32)
    for i in range(0, len(columns), COLUMNS):
        some = columns[i : i + COLUMNS]
        inside = lambda x: x[np.searchsorted(x, some[0]) : np.searchsorted(x, some[-1], "right")]
        out += incidence([inside(x) for x in a], some) @ incidence([inside(x) for x in b], some).T
    return np.rint(out).astype(np.int64)


def in_blocks(members: DataFrame, row: Column, size: Column, side: str) -> DataFrame:
    """(region, array of rows): the members of each region in blocks of about BLOCK rows and BLOCK_BYTES."""
    parts = members.groupBy("region").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum(size) / BLOCK_BYTES)).alias("parts"))
    dealt = members.join(parts, "region").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    return dealt.groupBy("region", "part").agg(F.collect_list(row).alias(side)).drop("part")


def unmet_pairs(members: DataFrame) -> DataFrame:
    """(id, id_b) of members of one region in two components that neither's home has brought together and that may link.

    ``members``: (region, id, component, home, visited, n, c). Each block of a region meets each other one under a key of
    their own, so no task holds a region, and only what is still to be compared becomes a row.
    """
    parts = members.groupBy("region").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    dealt = members.join(parts, "region").withColumn("block", F.pmod(F.xxhash64("id"), F.col("parts")))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    one = dealt.withColumn("block_b", every)
    other = dealt.withColumn("block_a", every).select(*[F.col(x).alias(f"{x}_b") for x in (*members.columns, "block")], "block_a")
    meet = (F.col("region") == F.col("region_b")) & (F.col("block") == F.col("block_a")) & (one["block_b"] == other["block_b"])
    differ = (F.col("id") < F.col("id_b")) & (F.col("component") != F.col("component_b"))
    unmet = ~F.array_contains("visited_b", F.col("home")) & ~F.array_contains("visited", F.col("home_b"))
    return one.join(other, meet & differ & unmet & may_link("n", "c", "n_b", "c_b")).select("id", "id_b").distinct()


def joined_blocks(hosts: DataFrame, guests: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links that join what links between the members that have a region as home and all members of it.

    ``hosts`` and ``guests``: (region, id). Members go in blocks of about BLOCK and BLOCK_BYTES, and a pair of blocks
    returns only as many links as its components need, so no task holds a region and no pair of members becomes a row.
    """
    sized = sets.withColumn("bytes", F.octet_length("hashes"))

    def blocks(members: DataFrame, side: str) -> DataFrame:
        return in_blocks(members.join(sized, "id"), F.struct("id", "hashes"), F.col("bytes"), side)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                one, other = (b.column(c)[i].values for c in (0, 1))
                ids = [x.field("id").to_numpy() for x in (one, other)]
                has = [[np.frombuffer(v.as_buffer(), np.uint64) for v in x.field("hashes")] for x in (one, other)]
                shared = shared_counts(*has)
                sizes = [np.array([len(v) for v in x]) for x in has]
                link = shared * (100 + SHARE) >= (sizes[0][:, None] + sizes[1]) * SHARE
                edges = np.array(forest(link), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(ids[0][edges[:, 0]]), pa.array(ids[1][edges[:, 1]])], names=["a", "b"])
        trim()

    spark = sets.sparkSession
    pairs = blocks(hosts, "one").join(blocks(guests, "other"), "region").select("one", "other").repartition(spread(spark))
    return stored(pairs.mapInArrow(go, "a long, b long").where("a <> b"), "block-links")


def linked(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("shared") * 100 >= F.col("union") * SHARE).select("a", "b")


def pair(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def open_regions(members: DataFrame, found: DataFrame) -> DataFrame:
    """(region, id, component, size) of the regions whose members are in several components, one region for each set of members."""
    of = members.join(found, "id", "left").select("region", "id", F.coalesce("component", "id").alias("component"))
    mark = F.xxhash64("id")
    stats = of.groupBy("region").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("size"), F.bit_xor(mark).alias("x"), F.sum(F.shiftright(mark, 20)).alias("y")
    )
    kept = stats.where("lo <> hi").groupBy("size", "x", "y").agg(F.min("region").alias("region")).select("region", "size")
    return of.join(kept, "region")


def mark_of(text: str) -> Column:
    """Tells the texts of one key apart."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def join_sets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    with run_folder(docs.sparkSession, "jaccard"):
        return kept(joined(docs, key, text).drop("mark"), "shingle-components")


def joined(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, mark, n_shingles, component_id) of every document."""
    texts = whole_text(docs, key, text).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), mark_of(text).alias("mark"))
    order = order_of(one_of_each(texts))
    all_sets = stored(summaries(texts, order), "summaries")
    known = all_sets.where("n > 0 AND id IS NOT NULL")
    # classes have numbers of their own, for one id can have several texts
    classes = known.groupBy("key").agg(F.min("id").alias("doc"), F.first("n").alias("n"), F.first("first").alias("first"))
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()), "set-classes")

    # a region of a frequent shingle starts in parts, which meet again when regions are joined; others have salt -1
    parts = [(i, 1 << min(int(v) - HOT_LEVEL, 20)) for i, v in enumerate(order.value) if v > HOT_LEVEL]
    salt = docs.sparkSession.createDataFrame(parts, "slot long, parts int")
    members = classes.select(F.explode("first").alias("region"), "id").withColumn("slot", F.shiftrightunsigned("region", 64 - SLOTS.bit_length() + 1))
    members = members.join(F.broadcast(salt), "slot", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("id"), F.col("parts")), F.lit(-1)).cast("int"))  # SLOTS rows at most
    near, alive = stored(around_pivots(members), "regions"), classes.select("id", "n")
    for _ in range(PRUNINGS):
        # a class that shares too few of its first shingles with others links with nothing; in a part it may with another part
        pivots = near.select("region", "salt", F.col("pivot").alias("id")).distinct()
        met = near.where("id <> pivot").select("region", "salt", "id").unionByName(pivots)
        shared = met.groupBy("id").agg(F.count(F.lit(1)).alias("met"))
        least = F.greatest(F.lit(1), F.floor(F.col("n") / (SURE * 5 // 4)))
        alive = stored(alive.join(shared, "id").where(F.col("met") >= least).drop("met"), "alive")
        near = stored(around_pivots(met.join(alive.select("id"), "id", "left_semi")), "regions")
    sets = sets_of(texts, classes.join(alive.select("id"), "id", "left_semi").select(F.col("id").alias("class"), "doc", "key"))
    # shingles that no other set has can't be shared: what remains bounds the intersection with any set
    rest = alive.select("id", "n").join(common_counts(sets), "id", "left").withColumn("c", F.col("n") - F.coalesce("alone", F.lit(0)))
    marks = rest.where(F.col("c") * 100 >= F.col("n") * SHARE).select("id", "n", "c")
    heads = stored(classes.select("id", "first").join(marks, "id"), "heads")
    near = stored(around_pivots(met.join(heads.select("id"), "id", "left_semi")), "regions")

    candidates = stored(near.where("id <> pivot").groupBy("id", "pivot").agg(F.count(F.lit(1)).alias("n_shared")), "candidates")
    sure = lambda c: F.greatest(F.lit(1), F.floor(F.col(c) / SURE))

    def fits(df: DataFrame, x: str, y: str) -> DataFrame:
        """Pairs whose sizes, common parts and first shingles allow a link."""
        for c, s in ((x, "x"), (y, "y")):
            df = df.join(heads.select(F.col("id").alias(c), F.col("n").alias(f"n_{s}"), F.col("c").alias(f"c_{s}"), F.col("first").alias(f"first_{s}")), c)
        first = F.size(F.array_intersect("first_x", "first_y")) >= F.least(sure("n_x"), sure("n_y"))
        return df.where(may_link("n_x", "c_x", "n_y", "c_y")).where(first).drop("n_x", "n_y", "c_x", "c_y", "first_x", "first_y")

    nearest = fits(candidates, "id", "pivot").groupBy("id").agg(F.max_by("pivot", F.struct("n_shared", -F.col("pivot"))).alias("pivot"))
    checked = verified(nearest.select(*pair("id", "pivot")).distinct(), sets)
    links = linked(checked)
    found = stored(components(links), "components")

    def apart(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) in different components that are not verified yet."""
        sides = [found.select(F.col("id").alias(c), F.col("component").alias(f"c_{c}")) for c in "ab"]
        out = pairs.join(sides[0], "a", "left").join(sides[1], "b", "left")
        out = out.where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b").distinct()
        return out.join(checked, ["a", "b"], "left_anti")

    def verify(pairs: DataFrame) -> None:
        nonlocal checked, links, found
        new = verified(apart(pairs), sets)
        checked = stored(checked.unionByName(new), "verified")
        joined = linked(new)
        if joined.isEmpty():
            return
        links = stored(links.unionByName(joined), "links")
        found = stored(components(links), "components")

    verify(fits(candidates, "id", "pivot").select(*pair("id", "pivot")))
    # parts of one region have not met yet, so their pivots are in here as well
    inner = near.select("region", "id").distinct()
    left = stored(open_regions(inner, found), "open-regions")
    # every member is compared with all of its largest region, its home
    home = left.groupBy("id").agg(F.max_by("region", F.struct("size", "region")).alias("home"))
    home = stored(home, "homes")
    hosts = home.select(F.col("home").alias("region"), "id")
    guests = left.join(hosts.select("region").distinct(), "region", "left_semi").select("region", "id")
    links = stored(links.unionByName(joined_blocks(hosts, guests, sets)), "links")
    found = stored(components(links), "components")

    # what is left are pairs that meet only in a region that is home to neither
    left = open_regions(inner, found).join(home, "id")
    visits = guests.groupBy("id").agg(F.collect_set("region").alias("visited"))
    left = stored(left.join(visits, "id").join(heads.select("id", "n", "c"), "id").drop("size"), "open-regions")
    pairs = stored(unmet_pairs(left), "unmet-pairs")
    verify(fits(pairs, "id", "id_b").select(*pair("id", "id_b")))

    of = classes.select("id", "key", "doc").join(found, "id", "left").select("key", "doc", F.coalesce("component", "id").alias("component"))
    of = of.join(of.groupBy("component").agg(F.min("doc").alias("component_id")), "component").select("key", "component_id")
    out = all_sets.select("id", "mark", "n", "key").join(of, "key", "left")
    return out.select(F.col("id").alias("doc_id"), "mark", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows, with all their columns, that stand for their component: of each group the smallest key.

    Rows without a key stay; of repeated rows of a kept key all stay, and other texts of that key go by their own component.
    """
    with run_folder(docs.sparkSession, "jaccard"):
        gone = joined(docs, key, text).where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("gone_key"), F.col("mark").alias("gone_mark"))
        gone = small_or_joined(kept(gone.distinct(), "near-copies"))  # else the texts would be shuffled for it
    same = (docs[key].cast("long") == gone["gone_key"]) & (F.xxhash64(F.coalesce(docs[text].cast("string"), F.lit(""))) == gone["gone_mark"])
    return docs.join(gone, same, "left_anti").select(docs.columns)
