"""Near-duplicate texts: a size-aware heavy-light join of n-gram sets by Jaccard similarity.

Two sets of sizes ``n <= m`` are linked when ``100 * |both| >= percent * |either|``.
Then their symmetric difference has at most ``(n + m) * (100 - percent) / (100 + percent)``
members, so the number ``t`` of members they must share is fixed by ``n`` and ``m``.

* Light sets, up to a boundary size, enumerate their subsets of exactly those sizes
  ``t``; two linked light sets meet in a subset.
* Heavy sets scan inverted lists.  A list belongs to one n-gram and holds every set
  that has it among its rarest ones; linked sets share at least ``c`` of their rarest
  ``n - ceil(n * percent / 100) + c`` members, whatever order "rarest" stands for.  ``c`` is
  one for small sets and grows with their size, so large sets that share a list or two by
  chance are told apart without reading them.  Light sets large enough to link with a
  heavy one are in the lists too.
* The boundary minimises subsets to enumerate plus list entries to scan, from the
  counts of all sets by size and the frequencies of all n-grams.

Rarity comes from one array of counters over all n-grams of all documents (of fixed
size, four megabytes, so it may be broadcast); it only orders n-grams and cannot lose a link.

Lists are not turned into pairs.  Each set is first compared with the one set that most of its
lists name as their leader: of the sets of about one size the one found in most lists, which in a
group of near copies is what they were copied from.  That contracts such groups, round by round,
until the lists hold few pairs of different components for their entries or a round takes away
few of these pairs.  After that only sets of one list that still lie in different
components are compared, and of these only pairs that no leader holds apart: two sets differ in at
least as many members as their distances to a third one differ.  Sets equal as a whole count
once.  Every comparison is exact on the whole sets.

Members are 64-bit hashes of the n-grams, and a set is named by a 64-bit hash of its
members; a second hash guards the name, and the job stops if two sets share one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from llm.common import among, connected_components, cut_lineage, marked_places, quiet_shuffles, signed, small_batches, text_digest
from llm.words import SMALL_PIECE, Words, mix, pieces, split_words
from nearkin.session import remove_tables, written_tables

COUNTER_BITS, BLOCK_BITS, SLOTS = 22, 16, 8
LARGEST_BOUNDARY = 24  # subsets of larger sets outnumber any list
MOST_LEADER_ROUNDS = 6
FEW_PAIRS, LEAST_GAIN = 64, 0.1  # pairs of different components for each list entry; share of them that a round takes away
GRAMS_PER_LIST = 50
PARITY = [f"p{i}" for i in range(8)]
MEASURED = ["doc_id", "digest", "size", "set", "guard", "block", "counts", *PARITY]

_SEEDS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def shared_needed(n: int, m: int, percent: int) -> int:
    """The least number of common members that links sets of sizes n and m."""
    return -(-percent * (n + m) // (100 + percent))


def shared_lists(n: int) -> int:
    """How many lists two linked sets share if the smaller has n members."""
    return 1 + n // GRAMS_PER_LIST


def kept_prefix(n: int, percent: int) -> int:
    return min(n, n - (n * percent + 99) // 100 + shared_lists(n))


def subset_sizes(n: int, percent: int) -> list[int]:
    """Sizes of the subsets in which a set of size n can meet a linked one."""
    partners = range(max(1, n * percent // 100), n * 100 // percent + 2)
    found = {t for m in partners if (t := shared_needed(n, m, percent)) <= min(n, m)}
    return sorted(found)


def gram_sets(words: Words, n: int) -> list[np.ndarray]:
    """Per text the sorted distinct n-grams; a shorter text is one gram as a whole."""
    at, grams = words.runs(n)
    cuts = np.searchsorted(at, words.first)
    found = []
    for t, count in enumerate(words.counts()):
        if count >= n:
            found.append(np.unique(grams[cuts[t] : cuts[t + 1]]))
        elif count:
            value = np.zeros(1, dtype=np.uint64)
            for h in words.hashes[words.first[t] : words.first[t + 1]]:
                value = mix(value + h)
            found.append(mix(value + np.uint64(count)))
        else:
            found.append(np.empty(0, dtype=np.uint64))
    return found


def set_names(grams: np.ndarray) -> tuple[int, int]:
    """A name and its guard, as signed integers."""
    if not len(grams):
        return 0, 0
    sums = np.array([mix(grams ^ s).sum(dtype=np.uint64) for s in _SEEDS])
    name, guard = signed(mix(sums + np.uint64(len(grams))))
    return int(name), int(guard)


def parity(grams: np.ndarray) -> np.ndarray:
    """512 bits, each the parity of the members that hash to it.

    A member that only one of two sets has changes one bit, so the bits in which the
    sets differ never outnumber the members in which they differ.
    """
    odd = np.bincount((grams >> np.uint64(8) & np.uint64(511)).astype(np.int64), minlength=512) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _may_link(x: str, y: str, percent: int) -> Column:
    """Whether sizes n and m and the parities leave room for a link; never false for linked sets."""
    differing = sum((F.bit_count(F.col(f"{x}{i}").bitwiseXOR(F.col(f"{y}{i}"))) for i in range(1, 8)),
                    F.bit_count(F.col(f"{x}0").bitwiseXOR(F.col(f"{y}0"))))
    return (F.least("n", "m") * 100 >= F.greatest("n", "m") * percent) & (
        differing * (100 + percent) <= (F.col("n") + F.col("m")) * (100 - percent)
    )


def _measure(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(1 << COUNTER_BITS, dtype=np.uint32)
        for batch in batches:
            for piece in pieces(batch, "text", SMALL_PIECE):
                rows, bits = [], []
                for grams in gram_sets(split_words(piece.column("text"), lower=True), n):
                    rows.append((len(grams), *set_names(grams)))
                    bits.append(parity(grams))
                    np.add.at(counters, (grams >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), np.uint32(1))
                size, name, guard = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), piece.column("digest"), pa.array(size, pa.int64()), pa.array(name, pa.int64()),
                     pa.array(guard, pa.int64()), pa.nulls(len(size), pa.int32()), pa.nulls(len(size), pa.binary()), *map(pa.array, np.array(bits).T)],
                    MEASURED,
                )
        blocks = counters.reshape(-1, 1 << BLOCK_BITS)
        used = np.flatnonzero(blocks.any(axis=1))
        none = pa.nulls(len(used), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [none, pa.nulls(len(used), pa.binary()), none, none, none, pa.array(used, pa.int32()), pa.array([_sparse(blocks[i]) for i in used], pa.binary()), *[none] * 8],
            MEASURED,
        )

    return run


def _sparse(counts: np.ndarray) -> bytes:
    """A byte for each of a block's counts, 255 at most, and of those from 255 on the places, two bytes each, and the rest, eight bytes each."""
    low = np.minimum(counts, 255).astype(np.uint8)
    at = np.flatnonzero(low == 255)
    return low.tobytes() + at.astype("<u2").tobytes() + (counts[at] - 255).astype("<u8").tobytes()


def _added(parts: Iterator[pa.RecordBatch]) -> np.ndarray:
    total = np.zeros(1 << BLOCK_BITS, dtype=np.uint64)
    for part in parts:
        for raw in part.column("counts"):
            data, size = raw.as_buffer(), 1 << BLOCK_BITS
            n = (len(data) - size) // 10
            total += np.frombuffer(data, np.uint8, size)
            total[np.frombuffer(data, "<u2", n, size)] += np.frombuffer(data, "<u8", n, size + 2 * n)
    return total


def _add_some(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_arrays(
        [pa.array([key[0].as_py()], pa.int32()), pa.array([_sparse(_added(parts))], pa.binary())], ["block", "counts"]
    )


def _rank_block(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = _added(parts).astype(np.float64)
    yield pa.RecordBatch.from_arrays(
        [pa.array([key[0].as_py()], pa.int32()), pa.array([how_often(total).tobytes()], pa.binary()),
         pa.array([total.sum()]), pa.array([(total**2).sum()])],
        ["block", "often", "total", "squares"],
    )


def how_often(counts: np.ndarray) -> np.ndarray:
    """A byte that grows with the count, eight steps for each doubling."""
    return np.minimum(8 * np.log2(1 + counts), 255).astype(np.uint8)


def _frequencies(measured: DataFrame) -> tuple[np.ndarray, float]:
    """How often n-grams occur, a byte for each of 2**22 counters over all documents, and the entries seen per entry posted."""
    slot = F.pmod(F.spark_partition_id(), F.lit(SLOTS)).alias("slot")
    parts = (
        measured.where("block is not null").select("block", slot, "counts")
        .groupBy("block", "slot").applyInArrow(_add_some, "block int, counts binary")
        .groupBy("block").applyInArrow(_rank_block, "block int, often binary, total double, squares double").collect()
    )
    often = np.zeros((1 << (COUNTER_BITS - BLOCK_BITS), 1 << BLOCK_BITS), dtype=np.uint8)
    for r in parts:
        often[r["block"]] = np.frombuffer(r["often"], dtype=np.uint8)
    total = sum(r["total"] for r in parts) or 1.0
    return often.ravel(), 1 + max(0.0, sum(r["squares"] for r in parts) / total - 1 - total / often.size)


def boundary(sizes: DataFrame, scanned: float, percent: int) -> int:
    """The size up to which enumerating subsets is cheaper than scanning lists.

    ``sizes`` has one row per distinct set, ``scanned`` is the entries seen per entry posted; at most ``LARGEST_BOUNDARY + 1`` counts reach the driver.
    """
    rows = (
        sizes.select(F.least("size", F.lit(LARGEST_BOUNDARY + 1)).alias("s"), "size")
        .groupBy("s").agg(F.count("*").alias("c"), F.sum((F.col("size") * (100 - percent) / 100).cast("long") + 1).alias("p"))
        .collect()
    )
    number, entries = {r["s"]: r["c"] for r in rows}, {r["s"]: r["p"] for r in rows}

    def cost(x: int) -> float:
        light = sum(number.get(n, 0) * sum(comb(n, t) for t in subset_sizes(n, percent)) for n in range(1, x + 1))
        return light + scanned * sum(e for n, e in entries.items() if n >= (x + 1) * percent // 100)

    return min(range(LARGEST_BOUNDARY + 1), key=cost)


def _post(n: int, percent: int, bound: int, shared):
    least_listed = (bound + 1) * percent // 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = shared.value
        for batch in batches:
            for piece in pieces(batch, "text", SMALL_PIECE):
                keys, names, sizes, seen = [], [], [], set()
                for grams in gram_sets(split_words(piece.column("text"), lower=True), n):
                    name, size = set_names(grams)[0], len(grams)
                    if not size or name in seen:
                        continue
                    seen.add(name)
                    own = []
                    if size >= least_listed:
                        often = rarity[(grams >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)]
                        own.append(grams[np.lexsort((grams, often))[: kept_prefix(size, percent)]])
                    if size <= bound:
                        for t in subset_sizes(size, percent):
                            chosen = np.array(list(combinations(range(size), t)), dtype=np.int64)
                            value = np.zeros(len(chosen), dtype=np.uint64)
                            for column in chosen.T:
                                value = mix(value + grams[column])
                            own.append(mix(value + np.uint64(t)))
                    own = np.concatenate(own)
                    keys.append(own)
                    names.append(np.full(len(own), name, dtype=np.int64))
                    sizes.append(np.full(len(own), size, dtype=np.int32))
                if keys:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(signed(np.concatenate(keys))), pa.array(np.concatenate(names)), pa.array(np.concatenate(sizes))],
                        ["key", "set", "size"],
                    )

    return run


def _compatible(posted: DataFrame, percent: int) -> DataFrame:
    """The list entries of sets that share enough lists with sets of about their size, with how many ``lists`` a set has.

    Of a list ordered by size the neighbours of a set are nearest to it in size.  If a set of the
    list can be linked with it, the neighbour on that side lies between and can be, too.
    """
    by_size, of_set = Window.partitionBy("key").orderBy("size"), Window.partitionBy("set")
    below, above = F.lag("size").over(by_size), F.lead("size").over(by_size)
    least = F.floor(F.ceil(F.col("size") * percent / 100) / GRAMS_PER_LIST) + 1
    lists = posted.repartition("key").distinct()  # one shuffle for this and for the order by size
    for _ in range(2):
        near = lists.select("key", "set", "size", below.alias("below"), above.alias("above")).where(
            (F.col("below") * 100 >= F.col("size") * percent) | (F.col("size") * 100 >= F.col("above") * percent)
        )
        counted = near.select("key", "set", "size", F.count("*").over(of_set).alias("lists"))
        lists = cut_lineage(counted.where(F.col("lists") >= least))
    return lists


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", SMALL_PIECE):
                found = gram_sets(split_words(piece.column("text"), lower=True), n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([set_names(g)[0] for g in found], pa.int64()), pa.array([g.tobytes() for g in found], pa.binary())],
                    ["set", "grams"],
                )

    return run


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        both = [
            len(np.intersect1d(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64), assume_unique=True))
            for a, b in zip(batch.column("x"), batch.column("y"))
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), batch.column("n"), batch.column("m"), pa.array(both, pa.int64())],
            ["a", "b", "n", "m", "both"],
        )


def measure_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a, b`` (with sizes ``n, m``) and how many members ``both`` have, counted on whole sets."""
    pairs = cut_lineage(pairs)
    ends = pairs.select(F.col("a").alias("set")).unionByName(pairs.select(F.col("b").alias("set")))
    sets = among(sets, marked_places(ends, "set"), "set")
    left = sets.select(F.col("set").alias("a"), F.col("grams").alias("x"))
    right = sets.select(F.col("set").alias("b"), F.col("grams").alias("y"))
    return cut_lineage(
        pairs.join(left, "a").join(right, "b").select("a", "b", "n", "m", "x", "y").mapInArrow(_common, "a long, b long, n int, m int, both long")
    ).select("a", "b", "both", "n", "m")


def _linked(measured: DataFrame, percent: int) -> DataFrame:
    return measured.where(F.col("both") * 100 >= percent * (F.col("n") + F.col("m") - F.col("both")))


def _placed(lists: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """List entries with the component of their set and how many ``entries`` the list has; only lists that hold several components.

    Then those lists, with the number of ``pairs`` of entries of different components.
    """
    found = connected_components(links)
    placed = cut_lineage(lists.join(found.withColumnRenamed("node", "set"), "set", "left").withColumn(
        "component", F.coalesce("component", "set")
    ))
    counted = placed.groupBy("key", "component").agg(F.count("*").alias("c")).groupBy("key").agg(
        F.sum("c").alias("entries"), F.sum(F.col("c").cast("double") * F.col("c")).alias("squares"), F.count("*").alias("components")
    )
    mixed = cut_lineage(counted.where("components > 1").select(
        "key", "entries", ((F.col("entries").cast("double") * F.col("entries") - F.col("squares")) / 2).alias("pairs")
    ))
    return cut_lineage(placed.join(mixed.select("key", "entries"), "key")), mixed


def _pairs_left(mixed: DataFrame) -> tuple[float, int]:
    """How many pairs of entries of different components lists hold, and how many entries."""
    seen = mixed.agg(F.sum("pairs").alias("pairs"), F.sum("entries").alias("entries")).first()
    return seen["pairs"] or 0.0, seen["entries"] or 0


def _marks(parities: DataFrame, of: str, as_: str) -> DataFrame:
    return parities.select(F.col("set").alias(of), *(F.col(p).alias(f"{as_}{p[1:]}") for p in PARITY))


def _leader_pairs(placed: DataFrame, parities: DataFrame, percent: int, turn: int) -> DataFrame:
    """For each set ``a`` the leader ``b`` of another component that most of its lists name.

    A list has a leader for each class of sizes; every other round the classes lie half a step further.
    """
    steps = float(np.log(100 / percent))
    class_ = F.floor(F.log(F.col("size").cast("double")) / steps + 0.5 * (turn % 2))
    placed = placed.withColumn("class", class_)
    # Later rounds also try other leaders than the most frequent one.
    rank = F.struct("lists", F.hash("set"), "set") if turn < 1 else F.struct(F.xxhash64("set", F.lit(turn)), "lists", "set")
    leaders = cut_lineage(placed.groupBy("key", "class").agg(F.max(F.struct(rank.alias("rank"), "set", "size", "component")).alias("l")))
    named = placed.join(leaders, ["key", "class"]).where(F.col("component") != F.col("l.component")).select(
        F.col("set").alias("a"), F.col("size").alias("n"), F.col("l.set").alias("b"), F.col("l.size").alias("m"),
    ).where(F.least("n", "m") * 100 >= F.greatest("n", "m") * percent)
    votes = named.groupBy("a", "n", "b", "m").agg(F.count("*").alias("votes"))
    votes = votes.join(_marks(parities, "b", "y"), "b").join(_marks(parities, "a", "x"), "a").where(_may_link("x", "y", percent))
    return votes.groupBy("a").agg(F.max(F.struct("votes", "b", "n", "m")).alias("v")).select("a", "v.b", "v.n", "v.m")


def _distances(measured: list[DataFrame]) -> DataFrame:
    """``set, from``: the leaders a set was measured with and in how many members it differs, itself if it is one."""
    all_ = measured[0]
    for more in measured[1:]:
        all_ = all_.unionByName(more)
    far = (F.col("n") + F.col("m") - 2 * F.col("both")).cast("int")
    one = all_.select(F.col("a").alias("set"), F.struct(F.col("b").alias("leader"), far.alias("far")).alias("f")).unionByName(
        all_.select(F.col("b").alias("set"), F.struct(F.col("b").alias("leader"), F.lit(0).alias("far")).alias("f"))
    )
    return one.groupBy("set").agg(F.collect_set("f").alias("from"))  # at most two for each round


def _held_apart(x: str, y: str, percent: int) -> Column:
    """Whether a common leader shows that two sets differ in too many members to be linked."""
    room = (F.col("n") + F.col("m")) * (100 - percent)

    def far(p: Column, q: Column) -> Column:
        return (p["leader"] == q["leader"]) & (F.abs(p["far"] - q["far"]) * (100 + percent) > room)

    return F.coalesce(F.exists(x, lambda p: F.exists(y, lambda q: far(p, q))), F.lit(False))


def similar_sets(docs: DataFrame, n: int = 3, percent: int = 90) -> tuple[DataFrame, DataFrame]:
    """``members`` (doc_id, digest, size, set, component) and ``links`` (a, b, both, n, m) that connect the sets.

    ``component`` is the smallest set name reachable by links.  The links connect every
    component fully; links inside a component that was already connected are not repeated.
    A null or empty text has the empty set, size 0, and is linked with nothing.
    Both are written, links last, and read no other table written here.
    ``digest`` tells apart the texts of rows with one doc_id.
    """
    quiet_shuffles(docs.sparkSession)
    small_batches(docs.sparkSession)
    spark, first = docs.sparkSession, written_tables()
    docs = docs.select("doc_id", "text")
    measured = cut_lineage(docs.withColumn("digest", text_digest()).mapInArrow(
        _measure(n), "doc_id long, digest binary, size long, set long, guard long, block int, counts binary, " + ", ".join(f"{p} long" for p in PARITY)
    ))
    often, scanned = _frequencies(measured)
    rows = measured.where("block is null")
    names = cut_lineage(
        rows.where("size > 0").groupBy("set").agg(
            F.min("doc_id").alias("doc_id"), F.min("size").alias("size"),
            (F.min("guard") != F.max("guard")).alias("clash"), *(F.min(p).alias(p) for p in PARITY),
        )
    )
    members = cut_lineage(rows.select("doc_id", "digest", "size", "set"))
    remove_tables(spark, first, first + 1)
    if not names.where("clash").isEmpty():
        raise ValueError("two different sets have one 64-bit name; choose other seeds")
    bound = boundary(names, scanned, percent)
    shared, first = spark.sparkContext.broadcast(often), written_tables()
    # Entries go straight to the tasks that read their lists; they outnumber all that is written here.
    lists = _compatible(docs.mapInArrow(_post(n, percent, bound, shared), "key long, set long, size int"), percent)
    shared.destroy()
    remove_tables(spark, first, written_tables() - 1)  # all but the lists themselves
    # The sets that share a list with another set, and the texts of one document for each.
    sharing = cut_lineage(names.join(lists.select("set").distinct(), "set", "left_semi"))
    parities, wanted = sharing.select("set", *PARITY), sharing.select("doc_id", "set")
    texts = among(docs, marked_places(wanted, "doc_id"), "doc_id")
    sets = among(texts.mapInArrow(_sets(n), "set long, grams binary"), marked_places(wanted, "set"), "set")
    sets = cut_lineage(sets.join(wanted, "set", "left_semi").dropDuplicates(["set"]))
    links, measured_with, placed, before = None, [], lists.withColumn("component", F.col("set")), 0.0
    for turn in range(MOST_LEADER_ROUNDS):
        first = written_tables()
        found = measure_pairs(_leader_pairs(placed, parities, percent, turn), sets)
        remove_tables(spark, first, written_tables() - 1)
        measured_with.append(found)
        new = _linked(found, percent)
        if turn > 1 and new.isEmpty():
            break
        links = new if links is None else links.unionByName(new)
        first, outdated = written_tables(), first - 1
        placed, mixed = _placed(placed.drop("component", "entries"), links)  # a list of one component keeps to one
        pairs, entries = _pairs_left(mixed)
        remove_tables(spark, first, written_tables() - 1)
        if turn:  # the first round reads the lists, which stay
            remove_tables(spark, outdated, outdated + 1)
        if turn and (pairs <= FEW_PAIRS * entries or pairs > (1 - LEAST_GAIN) * before):
            break  # both layouts of the classes and both kinds of leaders were tried
        before = pairs
    # Linked sets share c lists, so they still meet if each leaves its c - 1 longest ones.
    order = Window.partitionBy("set").orderBy(F.desc("entries"), "key")
    least = F.floor(F.ceil(F.col("size") * percent / 100) / GRAMS_PER_LIST)
    short = placed.withColumn("turn", F.row_number().over(order)).where(F.col("turn") > least)
    short = cut_lineage(short.join(parities, "set").join(cut_lineage(_distances(measured_with)), "set", "left"))
    left = short.select("key", F.col("set").alias("a"), F.col("size").alias("n"), "component", F.col("from").alias("x"), *(F.col(p).alias(f"x{p[1:]}") for p in PARITY))
    right = short.select("key", F.col("set").alias("b"), F.col("size").alias("m"), F.col("component").alias("other"), F.col("from").alias("y"), *(F.col(p).alias(f"y{p[1:]}") for p in PARITY))
    rest = left.join(right, "key").where(
        (F.col("a") < F.col("b")) & (F.col("component") != F.col("other")) & _may_link("x", "y", percent) & ~_held_apart("x", "y", percent)
    )
    links = links.unionByName(_linked(measure_pairs(rest.select("a", "n", "b", "m").distinct(), sets), percent))
    components = connected_components(links)
    members = cut_lineage(members.join(components.withColumnRenamed("node", "set"), "set", "left").withColumn(
        "component", F.when(F.col("size") > 0, F.coalesce("component", "set"))
    ).select("doc_id", "digest", "size", "set", "component"))
    return members, cut_lineage(links)


def near_duplicates(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest linked doc_id).

    Null and empty texts have n_shingles 0 and stay alone.  Repeated rows are linked
    through their equal sets.  A null doc_id never names a component that has another id.
    """
    first = written_tables()
    members, _ = similar_sets(docs, n, percent)
    remove_tables(docs.sparkSession, first, written_tables() - 2)  # all but these two
    remove_tables(docs.sparkSession, written_tables() - 1, written_tables())  # the links
    least = cut_lineage(members.where("size > 0").groupBy("component").agg(F.min("doc_id").alias("least")))
    return members.join(least, "component", "left").select(
        "doc_id", F.col("size").alias("n_shingles"),
        F.when(F.col("size") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def keep_first(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The documents, all columns, with one text of each component: of the smallest doc_id, nulls last.

    Of several texts with that id the one of the smallest digest stays.  Rows are told apart by
    doc_id and text, so repeated rows of the text that stays are all kept, as are texts without words.
    """
    begin = written_tables()
    members, _ = similar_sets(docs, n, percent)
    remove_tables(docs.sparkSession, begin, written_tables() - 2)  # all but these two
    members = members.where("size > 0").select("component", "doc_id", "digest")
    first = cut_lineage(members.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("first")))
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("digest") == F.col("first.digest"))
    drop = cut_lineage(members.join(first, "component").where(~stays).select(F.struct("doc_id", "digest").alias("k")).distinct())
    remove_tables(docs.sparkSession, begin, written_tables() - 1)
    rows = docs.select(F.struct("doc_id", text_digest().alias("digest")).alias("k"), F.struct("*").alias("row"))
    marked = marked_places(drop, "k")
    left = among(rows, marked, "k", how="left_anti").unionByName(among(rows, marked, "k").join(drop, "k", "left_anti"))
    return left.select("row.*")
