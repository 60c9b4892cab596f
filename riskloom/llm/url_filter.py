"""URL filtering: rules on host and path, and a cascade of Bloom filters that holds a list of hosts exactly.

The cascade's first level holds the listed hosts. Its false positives among *all* hosts of the corpus make the second level, the
listed hosts that the second level takes by mistake make the third, and so on until a level takes nobody by mistake. A key of
the corpus is listed if the first level that lacks it is an even one. The answer is exact for every key of that universe, and a
look-up needs a few bits instead of a join.

Hosts are dealt into shards by hash and each shard has a cascade of its own, so building works on bounded groups. The shards'
bits are used in rounds of at most ``round_bytes``: each round broadcasts some shards and answers the pages whose hosts belong
to them, so a broadcast stays bounded however long the list is.

Rules: a rule is a verdict, a host and the beginning of a path. It fits its host, all subdomains, and paths with that beginning.
The longest fitting rule (host, then path) decides; the cascade decides where none fits, for the host or any of its parents.

Defined results: a url that is null or without ``://`` has an empty host and path, and is allowed unless the empty host is
listed (it is not, by construction). Rows that repeat a page are judged each for itself; other columns are not read. Null and
empty entries of the list are ignored. An empty table gives an empty result, an empty list allows all.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import map_batches, type_of
from riskloom.session import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hosts that one shard holds on average, probes per key, bits per key.
SHARD_HOSTS, PROBES, BITS = 20_000, 4, 8


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the production query, as its contract gives them.
RULES = (Rule("allow", "org"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case."""
    return F.when(_whole(url), F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.when(_whole(url), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise("")


def _whole(url: Column) -> Column:
    return F.coalesce(F.instr(url, "://") > 0, F.lit(False))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null. Rules are few; a chain of tests from long to short."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.host), len(r.path), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


# ------------------------------------------------------------------ cascade

def places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    """``PROBES`` bit places of each key (signed 64-bit hashes) on a level; double hashing, another pair per level."""
    x = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    step = (x >> np.uint64(32)) | np.uint64(1)
    return ((x & np.uint64(0xFFFFFFFF))[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) % np.uint64(size)


def inside(keys: np.ndarray, level: int, bits: np.ndarray) -> np.ndarray:
    at = places(keys, level, bits.size * 8)
    return ((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def build(listed: np.ndarray, rest: np.ndarray) -> list[bytes]:
    """The levels for one shard's universe of distinct hashes. Keys whose hash is both listed and not cannot occur (see ``cascade``)."""
    levels: list[bytes] = []
    hold, against = listed, rest
    while len(hold):
        bits = np.zeros(max(1, (len(hold) * BITS + 7) // 8), np.uint8)
        at = places(hold, len(levels), bits.size * 8).ravel()
        np.bitwise_or.at(bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        levels.append(bits.tobytes())
        hold, against = against[inside(against, len(levels) - 1, bits)], hold
    return levels


def member(keys: np.ndarray, levels: list[bytes]) -> np.ndarray:
    """Whether each key of the universe is listed."""
    out, open_ = np.zeros(len(keys), bool), np.arange(len(keys))
    for k, raw in enumerate(levels):
        here = inside(keys[open_], k, np.frombuffer(raw, np.uint8))
        out[open_[~here]] = k % 2 == 1
        open_ = open_[here]
    out[open_] = len(levels) % 2 == 1
    return out


def shard_count(n: int) -> int:
    return max(1, -(-n // SHARD_HOSTS))


def cascade(hosts: DataFrame, listed: DataFrame) -> tuple[DataFrame, int]:
    """(shard, level, bits) over all hosts of the corpus, and the number of shards. ``hosts`` and ``listed``: one column ``host``.

    A key is the host's 64-bit hash. Should two hosts share a hash, one of them listed, the cascade could not tell them apart;
    this is looked for over the whole universe and refused.
    """
    named = listed.where(F.col("host").isNotNull() & (F.col("host") != "")).select("host").distinct().withColumn("on", F.lit(1))
    universe = hosts.select("host").distinct().withColumn("on", F.lit(0)).unionByName(named).groupBy("host").agg(F.max("on").alias("on"))
    universe = materialise(universe.withColumn("key", F.xxhash64("host")))
    if not universe.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("on").alias("on")).where("n > 1 AND on = 1").isEmpty():
        raise ValueError("two hosts share a hash")
    shards = shard_count(universe.count())

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        on = pdf["on"].to_numpy() == 1
        keys = pdf["key"].to_numpy()
        levels = build(keys[on], keys[~on])
        return pd.DataFrame({"shard": int(pdf["shard"].iloc[0]), "level": range(len(levels)), "bits": levels})

    dealt = universe.select("key", "on", F.pmod(F.col("key"), F.lit(shards)).cast("int").alias("shard"))
    return materialise(dealt.groupBy("shard").applyInPandas(fill, "shard int, level int, bits binary")), shards


def looker(levels, shards: int):
    """A function of arrays of keys: whether one of them is listed in a shard of this round."""
    @F.pandas_udf("boolean")
    def hit(keys: pd.Series) -> pd.Series:
        count = keys.map(len).to_numpy()
        flat = np.concatenate([np.zeros(0, np.int64), *keys]).astype(np.int64)
        of, shard = np.repeat(np.arange(len(keys)), count), flat % shards
        found = np.zeros(len(keys), bool)
        for s in np.unique(shard).tolist():
            if s in levels.value:
                mine = shard == s
                np.logical_or.at(found, of[mine], member(flat[mine], levels.value[s]))
        return pd.Series(found)

    return hit


def probe(pages: DataFrame, table: DataFrame, shards: int, hosts_col: str, round_bytes: int = 32 << 20) -> DataFrame:
    """``pages`` with ``listed``: whether any key of the array ``hosts_col`` (hashes) is listed."""
    sizes = table.groupBy("shard").agg(F.sum(F.length("bits")).alias("n")).orderBy("shard").toLocalIterator()
    rounds, size = [[]], 0
    for r in sizes:
        if size and size + r.n > round_bytes:
            rounds.append([])
            size = 0
        rounds[-1].append(r.shard)
        size += r.n
    out = pages.withColumn("listed", F.lit(False))
    for low, high in [(x[0], x[-1]) for x in rounds if x]:
        levels: dict[int, list[bytes]] = {}
        for r in table.where(F.col("shard").between(low, high)).orderBy("shard", "level").collect():  # at most round_bytes
            levels.setdefault(r.shard, []).append(bytes(r.bits))
        hit = looker(pages.sparkSession.sparkContext.broadcast(levels), shards)
        out = out.withColumn("listed", F.col("listed") | hit(F.col(hosts_col)))
    return out


def parents(host: Column) -> Column:
    """The host and all its parents: a.b.c, b.c, c."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws(".", F.slice(parts, i, F.size(parts) - i + 1)))


def judge(pages: DataFrame, listed: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", round_bytes: int = 32 << 20) -> DataFrame:
    """(id, host, path, rule, verdict, listed) of every row. ``listed``: one column ``host``; its subdomains are blocked too."""
    url = F.col(url_col)
    rows = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"))
    names = rows.select("host").distinct().select(F.explode(parents(F.col("host"))).alias("host"))
    low = listed.select(F.translate("host", UPPER, LOWER).alias("host"))
    table, shards = cascade(names, low)
    keyed = rows.withColumn("__keys", F.transform(parents(F.col("host")), lambda h: F.xxhash64(h)))
    out = probe(keyed, table, shards, "__keys", round_bytes).withColumn("__rule", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("__rule.verdict"), F.when(F.col("listed"), "block").otherwise("allow"))
    return out.select(id_col, "host", "path", F.col("__rule.rule").alias("rule"), verdict.alias("verdict"), "listed")
