"""Near-duplicate groups: SuperMinHash signatures, banding, verification on whole shingle sets, union-find.

1. Every text becomes its set of word shingles, the set's digest, and the keys of ``BANDS`` bands of ``ROWS`` signature values.
   Equal sets are one class, named by its smallest id; only classes go on.
2. Classes with an equal band key are a bucket. Each member is compared with the bucket's smallest id (a star: as many
   comparisons as members), and links that hold on the whole sets join components.
3. Buckets that still hold several components are compared in full between those components, in blocks of bounded size that hold
   the sets and give out only links that join something; so output stays linear in the members whatever the bucket.
4. Links are contracted by union-find inside each task, and the rest is joined by alternating star rounds over all tasks.

With 48 bands of 6, two texts with a similarity of 0.8 share a bucket with probability 1 - 5e-7, and more similar ones almost
surely; every pair in a bucket is either compared on its whole sets or already in one component. There is no cap anywhere.

Defined results: a null text, or one without words, has an empty set, links with nothing and is its own component. Rows with a
null id get their set size, component null, and link with nothing. Rows that repeat an id are judged each for itself, and those
that repeat id and text agree. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import map_batches, map_partitions, steps, type_of, unused
from riskloom.llm.shingles import band_keys, shingle_sets, super_minhash
from riskloom.operators.graph import components
from riskloom.session import materialise

BANDS, ROWS = 48, 6
#: Members and shingles of a block: what one comparison task holds.
BLOCK_ROWS, BLOCK_SHINGLES = 1500, 1_500_000
#: Bits of the filter that keeps unneeded texts out of shuffles. Its size is fixed; it only saves work.
FILTER_BITS = 1 << 24


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def describe(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, digest, keys); ``keys`` is empty for an empty set."""
    def run(batch):
        raw = [t or b"" for t in batch.column(1).cast("binary").to_pylist()]
        n, of, keys = [], [], []
        for a, b in steps(raw):
            sets = shingle_sets(raw[a:b], words)
            n += map(len, sets)
            of += map(digest, sets)
            found = band_keys(super_minhash(sets, BANDS * ROWS), ROWS)
            keys += [k if len(s) else [] for k, s in zip(found, sets)]
        return {"id": batch.column(0), "n": n, "digest": of, "keys": pa.array(keys, pa.list_(pa.int64()))}

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, run, {"id": type_of(rows, "id"), "n": "long", "digest": "binary", "keys": "array<long>"})


class Sets:
    """Union-find with path halving; the smaller name is the root."""

    def __init__(self):
        self.parent: dict = {}

    def find(self, x):
        parent = self.parent
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b


def linked(sets: list[np.ndarray], side: np.ndarray, part: list, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs (places) that link and join two components. Side 0 is compared with side 1, side 2 with itself.

    Shingles are numbered within the block, so that one place is compared with all others by one gather and sum.
    """
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    if not len(flat):
        return
    _, number = np.unique(flat, return_inverse=True)
    end = np.cumsum(size)
    owner = np.repeat(np.arange(len(sets)), size)
    groups, names = Sets(), sorted(set(part))
    at = {p: i for i, p in enumerate(names)}
    label = np.array([at[p] for p in part])
    if side[0] == 2 or (side == 2).all():
        largest = np.bincount(label).argmax()
        seekers = np.flatnonzero(label != largest)  # a pair of two components has a member outside the largest
    else:
        seekers = np.flatnonzero(side == 0)
    mark = np.zeros(int(number.max()) + 1, bool)
    for i in seekers.tolist():
        open_ = (label != label[i]) & (size > 0) & (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i]))
        if side[i] == 0:
            open_ &= side == 1
        if not size[i] or not open_.any():
            continue
        own = number[end[i] - size[i]:end[i]]
        mark[own] = True
        both = np.bincount(owner, mark[number], len(sets)).astype(np.int64)
        mark[own] = False
        for j in np.flatnonzero(open_ & (100 * both >= percent * (size + size[i] - both))).tolist():
            if groups.join(int(label[i]), int(label[j])):
                yield i, j
        roots = {x: groups.find(x) for x in list(groups.parent)}
        if roots:
            label = np.array([roots.get(x, x) for x in range(len(names))])[label]


def needed(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without most rows whose id is not among ``ids``: a filter of fixed size, which never loses one."""
    words = ids.select(F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)).alias("p"))
    words = words.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    found = words.toPandas()  # at most FILTER_BITS / 64 rows
    bits[found["w"].to_numpy(dtype=np.int64)] = found["bits"].to_numpy(dtype=np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def maybe(place: pd.Series) -> pd.Series:
        p = place.to_numpy(dtype=np.int64)
        return pd.Series((shared.value[p >> 6] >> (p & 63)) & 1 == 1)

    return docs.where(F.col("id").isNotNull()).where(maybe(F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))))


def compare(tasks: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) found by comparison tasks, contracted where they are found: the same components with at most one link per
    node and Spark task. ``tasks``: (task, id, digest, side, part); ``texts``: (id, text)."""
    kind = type_of(texts, "id")
    rows = tasks.join(needed(texts, tasks), "id").select("task", "side", "id", "digest", "part", F.col("text").cast("binary").alias("text"))
    rows = rows.repartition("task").sortWithinPartitions("task", "side", "id")

    def run(batches):
        key, held, sets = None, [], Sets()
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != key:
                    contract(held, sets)
                    key, held = row[0], []
                held.append(row)
        contract(held, sets)
        ends = [(x, r) for x in sets.parent if (r := sets.find(x)) != x]
        yield {"a": [r for _, r in ends], "b": [x for x, _ in ends]}

    def contract(held, sets):
        for a, b in links(held):
            sets.join(a, b)

    def links(held):
        if len(held) < 2:
            return
        sets = []
        raw = [r[5] or b"" for r in held]
        for a, b in steps(raw):
            sets += shingle_sets(raw[a:b], words)
        # an id may have other texts too: the digest tells the text that is meant
        right = [i for i, s in enumerate(sets) if digest(s) == held[i][3]]
        held, sets = [held[i] for i in right], [sets[i] for i in right]
        if len(held) > 1:
            yield from ((held[i][2], held[j][2]) for i, j in linked(sets, np.array([r[1] for r in held]), [r[4] for r in held], percent))

    return map_partitions(rows, run, {"a": kind, "b": kind})


def stars(members: DataFrame) -> DataFrame:
    """Comparison tasks of each bucket's smallest id with the others; ``members``: (key, id, digest, lead)."""
    pairs = members.where(F.col("id") != F.col("lead")).select("lead", "id", "digest").distinct()
    heads = members.where(F.col("id") == F.col("lead")).select("lead", "digest").distinct()
    count = pairs.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("parts"))
    spread = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    one = pairs.join(count, "lead").select(F.struct("lead", spread.alias("k")).alias("task"), "id", "digest", F.lit(1).alias("side"), F.col("id").alias("part"))
    zero = heads.join(count, "lead").select("lead", "digest", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("k"))
    zero = zero.select(F.struct("lead", "k").alias("task"), F.col("lead").alias("id"), "digest", F.lit(0).alias("side"), F.col("lead").alias("part"))
    return one.unionByName(zero).withColumn("task", F.concat_ws(":", "task.lead", "task.k"))


def blocks(members: DataFrame) -> DataFrame:
    """Comparison tasks within buckets of several components; ``members``: (key, id, digest, n, part).

    Buckets with the same members are taken once. A large bucket is dealt into blocks, and each pair of blocks is a task.
    """
    mixed = members.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles"),
                                       F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("who"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("who2"))
    mixed = mixed.where("low <> high").groupBy("who", "who2", "rows").agg(F.min("key").alias("key"), F.max("shingles").alias("shingles"))
    parts = F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    rows = members.join(mixed.select("key", parts.alias("parts")), "key")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    task = F.concat_ws(":", "key", F.least("own", "other"), F.greatest("own", "other"))
    return rows.select(task.alias("task"), "id", "digest", side.alias("side"), "part")


def near_groups(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row. Texts link when 100 * common >= percent * union of their sets."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = materialise(describe(docs, words, id_col, text_col))
    usable = found.where("n > 0 AND id IS NOT NULL")
    classes = materialise(usable.groupBy("digest").agg(F.min("id").alias("rep"), F.max("n").alias("n")))
    keyed = usable.select("id", "digest", "keys").join(classes.select("digest", "rep", "n"), "digest").where("id = rep")
    rows = keyed.select(F.explode("keys").alias("key"), "id", "digest", "n").distinct()
    shared = rows.groupBy("key").agg(F.min("id").alias("lead"), F.max("id").alias("last")).where("lead < last").select("key", "lead")
    members = materialise(rows.join(shared, "key"))

    first = materialise(compare(stars(members), texts, words, percent))
    part = components(first).withColumnRenamed("account", "id").withColumnRenamed("component", "of")
    placed = materialise(members.join(part, "id", "left").select("key", "id", "digest", "n", F.coalesce("of", "id").alias("part")))
    more = compare(blocks(placed), texts, words, percent)
    links = first.unionByName(more)
    part = components(links).select(F.col("account").alias("rep"), "component")
    named = classes.select("digest", "rep").join(part, "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    out = found.select("id", "n", "digest").join(named, "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def keep_first(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay: one document of each group. An id goes with all its rows where one of them is a later copy."""
    [name] = unused(docs, "__dropped")
    dropped = near_groups(docs, words, percent, id_col, text_col).where("NOT kept").select(F.col(id_col).alias(name)).distinct()
    return docs.join(dropped, F.col(id_col) == F.col(name), "left_anti")
