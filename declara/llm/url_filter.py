"""URL filter: rules by host and path, then a sorted digest array of listed domains and pages.

Listed strings (domains, or host and path of a page) are kept as 64-bit xxhash digests, sorted, next to the strings
themselves; the list is cut into shards by digest, one stored row per shard.  URLs are reduced to distinct host and
path; each gives as probes its domain and all parent domains, and host with path.  Distinct probes meet the shard
of their digest; a task maps the keys of its shard into memory, finds all probes by one vectorised binary search and
confirms hits on the stored strings, so colliding digests do no harm.  Shards grow in number with the list and
with the URLs, and a host that many pages share is probed once.

The map is anonymous memory filled from the stored row: the shared folder need not be a mounted file system.

Defined results: a null URL or one without ``://`` has empty host and path and matches nothing; hosts above 253
characters are no domain names and are looked up whole; repeated rows and null ids are kept; an empty table gives no
rows; an empty list allows everything.
"""

from __future__ import annotations

import mmap

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from declara.session import stored

#: Longest name that can be a domain.
LONGEST_HOST = 253


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Rule string and verdict of the longest fitting rule (verdict, host, path); null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule = F.when(fits, name + start).otherwise(rule)
        verdict = F.when(fits, say).otherwise(verdict)
    return rule, verdict


def digest_shards(listed: DataFrame, shards: int) -> DataFrame:
    """The list as stored shards: shard, keys (sorted digests), ends (of the strings), strings.  ``listed`` has ``entry``."""
    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["digest", "entry"])
        raw = [e.encode() for e in part["entry"]]
        return pd.DataFrame({"shard": part["shard"].iloc[:1], "keys": [part["digest"].to_numpy("<i8").tobytes()],
                             "ends": [np.cumsum([len(r) for r in raw]).astype("<i8").tobytes()], "strings": [b"".join(raw)]})

    distinct = listed.select("entry").filter("entry is not null and entry != ''").distinct()
    keyed = distinct.select("entry", F.xxhash64("entry").alias("digest"))
    return stored(keyed.withColumn("shard", F.pmod("digest", F.lit(shards))).groupBy("shard").applyInPandas(
        build, "shard bigint, keys binary, ends binary, strings binary"), "digests")


def _mapped(raw: bytes) -> np.ndarray:
    region = mmap.mmap(-1, max(len(raw), 8))
    region.write(raw)
    return np.frombuffer(region, "<i8", len(raw) // 8)


def lookup(probes: np.ndarray, strings: list[bytes], keys: np.ndarray, ends: np.ndarray, listed: bytes) -> np.ndarray:
    """Which probes (digests, with their strings) are listed."""
    hit = np.zeros(len(probes), bool)
    at = np.searchsorted(keys, probes)
    open_ = np.flatnonzero(at < len(keys))
    while len(open_):
        open_ = open_[keys[at[open_]] == probes[open_]]
        for i in open_:
            j = at[i]
            hit[i] |= listed[ends[j - 1] if j else 0:ends[j]] == strings[i]
        at[open_] += 1  # equal digests stand together
        open_ = open_[~hit[open_] & (at[open_] < len(keys))]
    return hit


def listed_urls(urls: DataFrame, listed: DataFrame, per_shard: int = 1_000_000) -> DataFrame:
    """The distinct (host, path) of ``urls`` that the list names."""
    spark = urls.sparkSession
    distinct = stored(urls.select("host", "path").filter("host != ''").distinct(), "urls")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(least, -(-(distinct.count() * 6 + listed.count()) // per_shard))
    array = digest_shards(listed, shards)
    labels = F.split("host", r"\.")
    parents = F.when(F.length("host") <= LONGEST_HOST, F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    ).otherwise(F.array("host"))
    probes = distinct.select("host", "path", F.explode(F.array_distinct(
        F.concat(parents, F.array(F.concat("host", "path"))))).alias("probe"))
    asked = (probes.select("probe").filter("probe != ''").distinct().withColumn("digest", F.xxhash64("probe"))
             .withColumn("shard", F.pmod("digest", F.lit(shards))))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"probe": pd.Series([], dtype=object)})
        row = right.iloc[0]
        hit = lookup(left["digest"].to_numpy(), [p.encode() for p in left["probe"]], _mapped(row["keys"]),
                     _mapped(row["ends"]), row["strings"])
        return left.loc[hit, ["probe"]]

    hits = asked.groupBy("shard").cogroup(array.groupBy("shard")).applyInPandas(search, "probe string")
    # the probes outgrow what the optimizer sees of the stored URLs, so neither side is broadcast
    return probes.join(hits.hint("merge"), "probe").select("host", "path").distinct()


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id",
          url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, listed of every row: the rule's verdict, else block where listed."""
    host, path = host_and_path(F.col(url_col))
    split = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = split.withColumns({"rule": rule, "verdict": verdict})
    hits = listed_urls(ruled.filter("rule is null"), listed).withColumn("listed", F.lit(True))
    found = ruled.join(hits, ["host", "path"], "left")
    in_list = F.coalesce("listed", F.lit(False)) & F.col("rule").isNull()
    return found.select("page_id", "host", "path", "rule",
                        F.coalesce("verdict", F.when(in_list, "block").otherwise("allow")).alias("verdict"),
                        in_list.alias("listed"))


def suspicious_domains(pages: DataFrame, words: list[str], url_col: str = "url") -> DataFrame:
    """Domains of ``pages`` with one of ``words`` in a label, as a list of entries."""
    host, _ = host_and_path(F.col(url_col))
    term = "|".join(words)
    entry = F.regexp_extract("host", rf"(?<![a-z0-9-])((?:[a-z0-9]+-)*(?:{term})(?:-[a-z0-9]+)*\..+)$", 1)
    return (pages.select(host.alias("host")).filter(F.length("host") <= LONGEST_HOST).distinct()
            .select(entry.alias("entry")).filter("entry != ''").distinct())
