"""URL allow/block rules by a Bloom filter cascade, in DataFrame functions only.

A rule is (host, path prefix, verdict).  It fits a url whose host is the rule's or a subdomain of it and
whose path starts with the rule's.  Every url yields one candidate key per rule *shape* (number of host
labels, path length), so a rule fits exactly when its key is among the candidates.  Which candidates are
rules is answered by a cascade of Bloom filters: level 0 holds the listed keys, level 1 the unlisted
keys of the corpus that level 0 lets through, level 2 the listed keys that level 1 lets through, and so
on until a level has no false positive over the corpus's whole key universe.  The first level that
misses a key decides, which is exact for every key of the corpus, without a join of pages and rules.

Scale: the only passes over the pages read the url column twice (distinct-key estimate for sizing, false
positives of level 0, pre-aggregated before their shuffle); no page is shuffled.  The filters travel as
literal bit arrays whose size follows the rule list (bounded by ``max_rules``) and the logarithm of the
corpus, never the corpus itself.

Defined cases: a null url or one without ``://`` has empty host and path and no candidate; a host of
fewer labels than a rule's, or a shorter path, never fits; of several fitting rules the longest string
wins, then the longer host; repeated pages and null ids keep their rows; an empty table gives an empty
result.  Other columns of the input, also ones named like an output, are not read.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storewatch.session import Scope

ALLOW, BLOCK = "allow", "block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Level:
    """One Bloom filter: ``bits`` positions in 64-bit ``words``, ``hashes`` probes, its own ``salt``."""
    words: tuple[int, ...]
    bits: int
    hashes: int
    salt: int

    def passes(self, key: Column) -> Column:
        table = F.lit(list(self.words)).cast("array<bigint>")
        hit = F.lit(True)
        for pos in _positions(key, self.bits, self.hashes, self.salt):
            word = F.element_at(table, (F.shiftright(pos, 6) + 1).cast("int"))
            hit = hit & (F.getbit(word, F.pmod(pos, F.lit(64)).cast("int")) == 1)
        return hit


def _positions(key: Column, bits: int, hashes: int, salt: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(salt), F.lit(j)), F.lit(bits)) for j in range(hashes)]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.coalesce(F.regexp_extract(url, parts, 1), F.lit(""))
    return F.translate(host, _UPPER, _LOWER), F.coalesce(F.regexp_extract(url, parts, 2), F.lit(""))


def candidate_keys(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """Array of the keys a url could be listed under: one per (labels, path length) that it is long enough for."""
    labels = F.when(host == "", F.lit(0)).otherwise(F.size(F.split(host, r"\.", -1)))
    keys = [F.when((labels >= n) & (F.length(path) >= size),
                   F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, size))) for n, size in shapes]
    return F.array_compact(F.array(*keys))


def _bloom(keys: DataFrame, n: int, rate: float, salt: int) -> Level:
    """Filter over column ``key`` (n distinct keys) that lets a share ``rate`` of other keys through."""
    hashes = max(1, round(math.log2(1 / rate)))
    bits = max(64, math.ceil(n * hashes / math.log(2) / 64) * 64)
    pos = keys.select(F.explode(F.array(*_positions(F.col("key"), bits, hashes, salt))).alias("pos"))
    rows = (pos.groupBy(F.shiftright("pos", 6).alias("word"))
            .agg(F.expr("bit_or(shiftleft(1L, cast(pos % 64 as int)))").alias("set")).collect())
    words = [0] * (bits // 64)
    for r in rows:
        words[r.word] = r.set
    return Level(tuple(words), bits, hashes, salt)


def build_cascade(universe: DataFrame, listed: DataFrame, scope: Scope, n_listed: int, salt: int = 0) -> list[Level]:
    """Levels that tell ``listed`` keys from all others of ``universe`` exactly (both: column ``key``)."""
    if n_listed == 0:
        return []
    n_all = universe.agg(F.approx_count_distinct("key").alias("n")).first().n
    levels = [_bloom(listed, n_listed, min(0.5, 0.7 * n_listed / max(n_all, n_listed)), salt)]
    wrong = (universe.filter(levels[0].passes(F.col("key"))).distinct()
             .join(F.broadcast(listed), "key", "left_anti"))          # listed: at most max_rules rows
    inside, outside = listed, scope.table(wrong)
    while (n := outside.count()) > 0:
        level = _bloom(outside, n, 0.5, salt + len(levels))
        levels.append(level)
        inside, outside = outside, scope.table(inside.filter(level.passes(F.col("key"))))
    return levels


def is_listed(key: Column, levels: list[Level]) -> Column:
    """The first level that misses the key decides: even levels hold listed keys, odd ones unlisted."""
    out = F.lit(len(levels) % 2 == 1)
    for i in range(len(levels) - 1, -1, -1):
        out = F.when(levels[i].passes(key), out).otherwise(F.lit(i % 2 == 1))
    return out


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url",
                 default: str = ALLOW, max_rules: int = 100_000) -> DataFrame:
    """``id_col``, host, path, rule (the fitting rule's ``host + path`` or null), verdict of every url.

    ``rules``: (host, path prefix, ``allow`` | ``block``), at most ``max_rules``; a path starts with ``/``.
    A url that no rule fits is not listed and gets ``default``."""
    if len(rules) > max_rules:
        raise ValueError(f"{len(rules)} rules; the cascade is sized for at most {max_rules}")
    if any(not p.startswith("/") or v not in (ALLOW, BLOCK) for _, p, v in rules):
        raise ValueError("a rule is (host, path starting with '/', allow or block)")
    spark = pages.sparkSession
    host, path = split_url(F.col(url_col))
    urls = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    if id_col in ("host", "path", "rule", "verdict"):
        raise ValueError(f"id column {id_col!r} would clash with an output column")
    if not rules:
        return urls.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    shapes = sorted({(h.count(".") + 1, len(p)) for h, p, _ in rules})
    keys = candidate_keys(F.col("host"), F.col("path"), shapes)
    by_key = {h + p: v for h, p, v in rules}
    blocked = [k for k, v in by_key.items() if v == BLOCK]
    key_table = lambda names: spark.range(1).select(F.explode(F.lit(names).cast("array<string>")).alias("key"))
    listed = key_table(list(by_key))
    with Scope(spark) as scope:
        universe = urls.select(F.explode(keys).alias("key"))
        member = build_cascade(universe, listed, scope, len(by_key))
        block = build_cascade(listed, key_table(blocked), scope, len(blocked), salt=1 << 20)
    slots = [F.col("_keys")[i] for i in range(len(shapes))]
    fitting = F.array_compact(F.array(*[
        F.when((F.size("_keys") > i) & is_listed(k, member),
               F.struct(F.length(k).alias("size"), F.instr(k, "/").alias("head"), k.alias("key")))
        for i, k in enumerate(slots)]))
    best = (urls.withColumn("_keys", keys).withColumn("rule", F.array_max(fitting)["key"]))
    verdict = (F.when(F.col("rule").isNull(), F.lit(default))
               .when(is_listed(F.col("rule"), block), F.lit(BLOCK)).otherwise(F.lit(ALLOW)))
    return best.select(F.col(id_col), "host", "path", "rule", verdict.alias("verdict"))
