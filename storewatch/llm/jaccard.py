"""N-gram Jaccard join with adaptive multi-match prefixes, up to connected components.

A document is its set of distinct n-word shingles; two documents link when ``den * |x & y| >= num * |x | y|``.
All documents order their shingles alike, rare first.  With a = ceil(num * |x| / den), the l-prefix of x is
its first |x| - a + l shingles, and linked documents share at least l shingles of their l-prefixes.  A longer
prefix costs postings but lets far fewer candidates through, so each document picks its own l with the least
estimated cost: the postings its prefix meets, plus the candidates they can give (their number over l) times
the price of a verification.  For a pair the smaller of the two l holds; shingles carry the least l that
reaches them (their layer), so one posting list serves every l.  Candidates are verified on their whole sets.

Documents with the same set are one node.  Links inside a component that is already connected add nothing,
so pairs are not enumerated there: first every posting list proposes to each node its neighbour in order of
size and the list's hub, the verified ones are connected; then lists are searched in full, but only for pairs of different
components: short lists by a join, long ones in blocks, the nodes outside their largest component against all.  Every link between different
components is therefore found; a group of near copies costs its size, not its square.

Scale: shingle frequencies, used for the order and the cost only, are counts of 2^20 hash buckets over all
documents (4 MB, the one broadcast).  Texts are read twice in place, and once in each of the two
rounds of verification for the sets of the documents in candidate pairs (their ids are broadcast up to a checked number,
beyond it the texts are shuffled).  Posting lists are keyed by shingle
and pass through sorts, windows and joins that spill; nothing is collected but the bucket counts.

Defined cases: null, empty or blank texts have an empty set and link with nothing; with fewer than n words
the whole sequence is the one shingle; rows that repeat an id share a component; rows without an id are told
apart by their text, count as larger than any id (ids must be below 2^62) and are returned with a null id, a component of only such rows
with a null component_id; an empty table gives an empty result; other columns are not read.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storewatch.llm import packed
from storewatch.llm.graph import components
from storewatch.llm.words import inside, mix, ngram_hash, row_slices, word_hashes
from storewatch.session import Scope, cut_lineage
from storewatch.sources.tables import small_side

SLICE = 2 << 20
BUCKET_BITS, PIECE = 20, 4096
MATCHES = (1, 2, 4, 8, 16, 32, 64)  # the l a document can choose from
VERIFY_COST = 100.0                 # of one candidate, in postings (two whole sets move)
_LISTED = ("node", "n", "l", "layer", "pos", "c")
SHORT_LIST = 32                     # nodes of a list whose pairs are joined; longer ones are searched in blocks
QUERY_BLOCK, NODE_BLOCK = 512, 4096 # nodes of a block
BROADCAST_IDS = 200_000             # ids of documents to fetch; beyond it the texts are shuffled
NO_ID = 2**62  # keys of rows without an id start here


def shingles(col: pa.Array, n: int, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and row of every shingle (repeats included), and the rows' word counts."""
    lanes, starts = word_hashes(col, 1, lower)
    at, row = inside(starts, n)
    hashes = ngram_hash(lanes[0], n, 0)[at] if len(at) else np.zeros(0, np.uint64)
    words = np.diff(starts)
    short = np.flatnonzero((words > 0) & (words < n))
    if len(short):
        whole = np.array([ngram_hash(lanes[0][starts[i]:starts[i + 1]], int(words[i]), 0)[0] for i in short], np.uint64)
        hashes = np.concatenate([hashes, mix(whole ^ words[short].astype(np.uint64))])
        row = np.concatenate([row, short])
    return hashes, row, words


def distinct_shingles(col: pa.Array, n: int, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes sorted by (row, hash), their row, and the rows' set sizes."""
    hashes, row, words = shingles(col, n, lower)
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[new], row[new], np.bincount(row[new], minlength=len(words))


@dataclass
class Texts:
    """The documents (id, text) and what makes and compares their sets."""
    rows: DataFrame
    n: int
    lower: bool
    num: int
    den: int


def bucket_counts(rows: DataFrame, n: int, lower: bool) -> np.ndarray:
    """Shingles of all documents per hash bucket."""
    size = 1 << BUCKET_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for lo, hi in row_slices(batch.column(1), SLICE):
                hashes = shingles(batch.column(1).slice(lo, hi - lo), n, lower)[0]
                total += np.bincount((hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=size)
        pieces = total.astype("<u4").reshape(-1, PIECE)
        used = np.flatnonzero(pieces.any(axis=1))
        yield pa.RecordBatch.from_pydict({"piece": pa.array(used, pa.int32()),
                                          "counts": pa.array([pieces[i].tobytes() for i in used], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for row in packed.rows_of(batches):
            total[row["piece"]] = total.get(row["piece"], 0) + np.frombuffer(row["counts"], "<u4").astype("<i8")
        yield pa.RecordBatch.from_pydict({"piece": pa.array(list(total), pa.int32()),
                                          "counts": pa.array([v.tobytes() for v in total.values()], pa.binary())})

    out = np.zeros((size // PIECE, PIECE), np.int64)
    parts = min(size // PIECE, packed.partitions(rows.sparkSession))
    summed = (rows.select("id", "text").mapInArrow(count, "piece int, counts binary")
              .repartition(parts, "piece").mapInArrow(add, "piece int, counts binary"))
    for r in summed.collect():  # size / PIECE rows, 8 MB together
        out[r.piece] += np.frombuffer(r.counts, "<i8")
    return out.reshape(-1)


def choose_matches(cost: np.ndarray, size: np.ndarray, spare: np.ndarray, more: np.ndarray) -> np.ndarray:
    """l of every row. ``cost``: estimated list length of its shingles in prefix order; ``spare``: |x| - a;
    ``more``: matches beyond l that a linked document of the same size shares (see ``_enough``)."""
    first = np.concatenate([[0], np.cumsum(size)])
    total = np.concatenate([[0.0], np.cumsum(cost)])
    best, chosen = np.full(len(size), np.inf), np.ones(len(size), np.int64)
    for matches in MATCHES:
        ok = matches <= size - spare
        end = first[:-1] + np.minimum(spare + matches, size)
        price = np.where(ok, (total[end] - total[first[:-1]]) * (1 + VERIFY_COST / (matches + more)), np.inf)
        better = price < best
        best[better], chosen[better] = price[better], matches
    return chosen


def prefixes(rows: DataFrame, n: int, num: int, den: int, lower: bool) -> DataFrame:
    """id, n, s1, s2 (size and 128-bit hash of the set), l and the prefix (shingles, rare first) of each document."""
    counts = bucket_counts(rows, n, lower)
    usual = float(np.median(counts))
    excess = np.maximum(counts - usual - 2 * np.sqrt(usual), 1.0).astype(np.float32)
    rank = np.minimum(counts, 65_535).astype(np.uint16)
    shared = rows.sparkSession.sparkContext.broadcast((rank, excess))  # 6 MB whatever the corpus
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()),
                        ("l", pa.int32()), ("prefix", pa.list_(pa.int64()))])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, excess = shared.value
        for batch in batches:
            for lo, hi in row_slices(batch.column(1), SLICE):
                hashes, row, size = distinct_shingles(batch.column(1).slice(lo, hi - lo), n, lower)
                sums = [np.zeros(hi - lo, np.uint64) for _ in range(2)]
                edges = np.concatenate([[0], np.cumsum(size)])
                for k in range(2):
                    run = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes ^ np.uint64(k + 1)), dtype=np.uint64)])
                    sums[k] = mix(run[edges[1:]] - run[edges[:-1]])
                bucket = (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
                key = rank[bucket].astype(np.uint64) << np.uint64(48) | hashes >> np.uint64(16)
                order = np.lexsort((key, row))
                hashes, bucket = hashes[order], bucket[order]
                spare = size - -(-num * size // den)
                more = -(-2 * num * size // (num + den)) - (size - spare)
                chosen = choose_matches(excess[bucket].astype(float), size, spare, more)
                take = np.where(size > 0, np.minimum(spare + chosen, size), 0)
                ends = np.concatenate([[0], np.cumsum(take)])
                at = np.repeat(edges[:-1] - ends[:-1], take) + np.arange(ends[-1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(size, pa.int64()),
                     *(pa.array(s.view(np.int64)) for s in sums), pa.array(chosen, pa.int32()),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(hashes[at].view(np.int64)))], schema=schema)

    return rows.select("id", "text").mapInArrow(emit, "id long, n long, s1 long, s2 long, l int, prefix array<long>")


def shingle_sets(rows: DataFrame, n: int, lower: bool) -> DataFrame:
    """node, set (sorted 64-bit hashes) of each row."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in row_slices(batch.column(1), SLICE):
                hashes, _, size = distinct_shingles(batch.column(1).slice(lo, hi - lo), n, lower)
                edges = np.concatenate([[0], np.cumsum(size)])
                sets = [hashes[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
                yield pa.RecordBatch.from_pydict({"node": batch.column(0).slice(lo, hi - lo), "set": pa.array(sets, pa.binary())})

    return rows.select("id", "text").mapInArrow(emit, "node long, set binary")


def verified(pairs: DataFrame, texts: Texts, scope: Scope) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough; only the sets of documents in a pair are made."""
    num, den = texts.num, texts.den
    pairs = scope.table(pairs.select("a", "b"))
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    wanted = texts.rows.join(small_side(scope.table(ids), BROADCAST_IDS), "id", "left_semi").dropDuplicates(["id", "text"])
    sets = scope.table(shingle_sets(wanted, texts.n, texts.lower))
    left = sets.select(F.col("node").alias("a"), F.col("set").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("y"))
    with_sets = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                place = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[place] == x).sum())
                good[i] = den * both >= num * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), batch.column(1).filter(pa.array(good))],
                                             names=["a", "b"])

    return scope.table(with_sets.mapInArrow(check, "a long, b long"))


def _needed(size: Column, num: int, den: int) -> Column:
    """a: the least overlap of a set of this size with a linked one."""
    return F.ceil(F.lit(num) * size / F.lit(den))


def _least_shared(x: str, y: str, num: int, den: int, size: str | None = None) -> Column:
    """Shingles that linked documents share in their l-prefixes, l the smaller of the two (``size``: column of y's size).

    Linked sets overlap in o >= num (n1 + n2) / (num + den).  Of the two prefixes, the one that ends earlier in the
    common order holds all common shingles up to there, so all but (size - prefix) of the o are in both."""
    n1, n2, l = F.col(f"n{x}"), F.col(size or f"n{y}"), F.least(f"l{x}", f"l{y}")  # noqa: E741
    overlap = F.ceil(F.lit(num) * (n1 + n2) / F.lit(num + den))
    return F.greatest(l, l + overlap - F.greatest(_needed(n1, num, den), _needed(n2, num, den)))


def _possible(x: str, y: str, num: int, den: int) -> Column:
    """Whether a shingle that rows x and y of a list share counts, and leaves the two a chance to be linked: their
    sizes fit, either has enough shared shingles at all, and what lies before and after the shingle in both
    orders is enough for the overlap."""
    n1, n2, p1, p2 = F.col(f"n{x}"), F.col(f"n{y}"), F.col(f"pos{x}"), F.col(f"pos{y}")
    room = F.least(p1, p2) + 1 + F.least(n1 - p1, n2 - p2) - 1
    return ((den * F.least(n1, n2) >= num * F.greatest(n1, n2))
            & (F.greatest(f"layer{x}", f"layer{y}") <= F.least(f"l{x}", f"l{y}"))
            & (F.least(f"c{x}", f"c{y}") >= _least_shared(x, y, num, den))
            & ((num + den) * room >= num * (n1 + n2)))


def _enough(met: DataFrame, num: int, den: int) -> DataFrame:
    """a, b, shared: the pairs that meet in enough lists. ``met``: rows of a list with another (columns with ``_``)."""
    pairs = met.select(F.least("node", "node_").alias("a"), F.greatest("node", "node_").alias("b"),
                       _least_shared("", "_", num, den).alias("least"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("shared"), F.max("least").alias("least")).filter("shared >= least").drop("least")


def row_key(id_col: str, text_col: str) -> Column:
    """The id; without one, a key above all ids made from the text."""
    own = F.lit(NO_ID) + F.pmod(F.xxhash64(F.col(text_col).cast("string")), F.lit(NO_ID - 1))
    return F.coalesce(F.col(id_col).cast("long"), own)


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 80,
                   den: int = 100, lower: bool = True) -> DataFrame:
    """id, n_shingles, component_id (smallest id reachable by links of Jaccard >= num / den) of every row, and
    row_key, group_key: the same for rows without an id (see :func:`row_key`)."""
    if not 0 < num <= den or n < 1:
        raise ValueError("n must be positive and the threshold in (0, 1]")
    spark = docs.sparkSession
    packed.limit_batches(spark)
    parts = packed.partitions(spark)
    rows = docs.select(row_key(id_col, text_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = Texts(rows, n, lower, num, den)
    with Scope(spark) as scope:
        with Scope(spark) as inner:
            made = inner.table(prefixes(rows, n, num, den, lower))
            info = scope.table(made.select("id", "n", "s1", "s2"))
            classes = scope.table(info.filter("n > 0").groupBy("n", "s1", "s2").agg(F.min("id").alias("node")))
            nodes = made.filter("n > 0").join(classes.select(F.col("node").alias("id")), "id", "left_semi")
            spare = F.col("n") - F.ceil(F.lit(num) * F.col("n") / F.lit(den)).cast("long")
            posted = nodes.select(F.col("id").alias("node"), "n", "l", spare.alias("spare"), F.posexplode("prefix").alias("pos", "token"))
            posted = posted.select("token", "node", "n", "l", "pos", F.greatest(F.lit(1), F.col("pos") + 1 - F.col("spare")).cast("int").alias("layer"))
            posted = posted.repartition(parts, "token").dropDuplicates(["token", "node", "n"])
            lists = _with_partners(_with_partners(posted, num, den, inner), num, den, scope)
        links = _near_links(lists, texts, scope)
        found = components(links, scope)
        links = links.unionByName(_cross_links(lists, texts, found, scope))
        found = components(links, scope)
        labels = classes.join(found, "node", "left").select("n", "s1", "s2", F.coalesce("component", "node").alias("component"))
        group = F.coalesce("component", "id")
        known = lambda c: F.when(c < NO_ID, c)
        return cut_lineage(info.join(labels, ["n", "s1", "s2"], "left").select(
            known(F.col("id")).alias(id_col), F.col("n").alias("n_shingles"), known(group).alias("component_id"),
            F.col("id").alias("row_key"), group.alias("group_key")))


def _with_partners(posted: DataFrame, num: int, den: int, scope: Scope) -> DataFrame:
    """Postings of nodes that can have a partner: shared shingles only, of nodes that have enough of them (column c)
    for the sizes and the l that their lists offer.  Dropping nodes shortens lists, so a second call drops more."""
    with Scope(posted.sparkSession) as inner:
        return scope.table(_able(inner.table(_listed(posted)), num, den))


def _listed(posted: DataFrame) -> DataFrame:
    """Shared shingles only, with the least l and the sizes of their lists."""
    per_token = Window.partitionBy("token")
    return posted.drop("c").withColumns({
        "many": F.count("*").over(per_token), "l_": F.min("l").over(per_token),
        "lo": F.min("n").over(per_token), "hi": F.max("n").over(per_token)}).filter("many > 1").drop("many")


def _able(listed: DataFrame, num: int, den: int) -> DataFrame:
    n = F.col("n")
    ends = {"lo": F.greatest("lo", F.ceil(F.lit(num) * n / F.lit(den))), "hi": F.least("hi", F.floor(F.lit(den) * n / F.lit(num)))}
    fit = listed.withColumns(ends).filter("lo <= hi")     # partners are at most so small and so large
    # the needed number rises with the partner's size up to n and falls beyond it (but for one, by rounding): least at an end
    need = F.least(_least_shared("", "_", num, den, "lo"), _least_shared("", "_", num, den, "hi") - 1)
    able = fit.groupBy("node").agg(F.count("*").alias("c"), F.min(need).alias("need")).filter("c >= need").select("node", "c")
    return fit.drop("l_", "lo", "hi").join(able, "node")


def _near_links(lists: DataFrame, texts: Texts, scope: Scope) -> DataFrame:
    """Verified links of each node with two others: the list neighbour in order of size that it shares most with,
    and the hub it shares most with.  A list's hub is the node with the largest share of its prefix in lists at all:
    edits put shingles of their own into a prefix, so the text that near copies were made from comes first."""
    num, den = texts.num, texts.den
    by_size = Window.partitionBy("token").orderBy("n", "node")
    near = lists.select("*", *[F.lag(c).over(by_size).alias(f"{c}_") for c in _LISTED])
    part = F.col("c") / F.least(F.col("n"), F.col("n") - _needed(F.col("n"), num, den) + F.col("l"))
    hubs = lists.groupBy("token").agg(F.max_by(F.struct(*_LISTED), F.struct(part, "n", "node")).alias("hub"))
    hub = lists.join(hubs, "token").select("*", *[F.col(f"hub.{c}").alias(f"{c}_") for c in _LISTED])

    def best(met: DataFrame) -> DataFrame:
        met = met.filter(F.col("node_").isNotNull() & (F.col("node_") != F.col("node")) & _possible("", "_", num, den))
        both = _enough(met, num, den)
        each = both.select("a", "b", "shared").unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"), "shared"))
        return each.groupBy("b").agg(F.max_by("a", F.struct("shared", "a")).alias("a"))

    tried = best(near).unionByName(best(hub)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return verified(tried, texts, scope)


def _cross_links(lists: DataFrame, texts: Texts, found: DataFrame, scope: Scope) -> DataFrame:
    """Verified links between nodes of different components.

    Nodes that share one of the lists of up to SHORT_LIST nodes meet there.  The others share a longer list; all longer lists with the
    same largest component form a group, and a group's nodes outside that component are searched in blocks against all its
    nodes (:func:`_block_pairs`).  Either way a pair's shared shingles are all counted, in short lists for pairs that share no other."""
    num, den = texts.num, texts.den
    named = scope.table(lists.join(found, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component"))
    sizes = named.groupBy("token", "comp").agg(F.count("*").alias("k"))
    big = sizes.groupBy("token").agg(F.max_by("comp", F.struct("k", "comp")).alias("big"), F.count("*").alias("comps"), F.sum("k").alias("k"))
    open_ = scope.table(named.join(big.filter("comps > 1").drop("comps"), "token"))
    few = open_.filter(F.col("k") <= SHORT_LIST)
    small = few.filter("comp <> big").select("token", *[F.col(c).alias(f"{c}_") for c in (*_LISTED, "comp")])
    met = few.join(small, "token").filter(
        (F.col("comp") != F.col("comp_")) & ((F.col("comp") == F.col("big")) | (F.col("node") < F.col("node_")))
        & _possible("", "_", num, den))
    pairs = _enough(met, num, den).unionByName(_block_pairs(open_, open_.filter(F.col("k") > SHORT_LIST), num, den))
    return verified(pairs.select("a", "b").distinct(), texts, scope)


def _block_pairs(open_: DataFrame, long: DataFrame, num: int, den: int) -> DataFrame:
    """a, b, shared: the pairs of different components that share a list of ``long`` and enough lists of ``open_``.

    A group's outsiders (nodes outside its largest component) are dealt to blocks of about QUERY_BLOCK and all its nodes to blocks of
    about NODE_BLOCK; a task holds the outsiders of one pair of blocks, streams the nodes and counts shared shingles in numpy,
    so only pairs that share enough leave it."""
    spark = open_.sparkSession
    parts = packed.partitions(spark)
    inside = open_.join(long.select("node").distinct(), "node", "left_semi")
    held = inside.groupBy("node").agg(F.first("n").alias("n"), F.first("l").alias("l"), F.first("c").alias("c"), F.first("comp").alias("comp"),
                                     F.collect_list(F.struct("token", "pos", "layer")).alias("of"))  # at most a prefix each
    member = long.groupBy("big", "node").agg(F.first("comp").alias("comp"))
    group = member.groupBy("big").agg(F.count("*").alias("all"), F.count(F.when(F.col("comp") != F.col("big"), 1)).alias("out"))
    blocks = lambda n, size: F.ceil(F.col(n) / F.lit(size)).cast("int")
    member = member.drop("comp").join(group.select("big", blocks("out", QUERY_BLOCK).alias("q"), blocks("all", NODE_BLOCK).alias("d")), "big")
    known = member.join(held, "node")
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cols = ["node", "n", "l", "c", "comp", "of"]
    queries = known.filter("comp <> big").select("big", own("q").alias("q"), F.explode(upto("d")).alias("d"), F.lit(0).alias("kind"), *cols)
    nodes = known.select("big", F.explode(upto("q")).alias("q"), own("d").alias("d"), F.lit(1).alias("kind"), *cols)

    def columns(rows: list[dict]) -> tuple[np.ndarray, ...]:
        many = np.array([len(r["of"]) for r in rows])
        flat = [np.array([x[k] for r in rows for x in r["of"]], np.int64) for k in ("token", "pos", "layer")]
        return (*(np.array([r[k] for r in rows], np.int64) for k in ("node", "n", "l", "c", "comp")), np.repeat(np.arange(len(rows)), many), *flat)

    def least(n1, l1, n2, l2):
        l = np.minimum(l1, l2)  # noqa: E741
        needed = lambda n: -(-num * n // den)
        return np.maximum(l, l - (-num * (n1 + n2) // (num + den)) - np.maximum(needed(n1), needed(n2)))

    def meet(x: tuple, y: tuple) -> dict:
        """Pairs of queries x and nodes y; the conditions are those of :func:`_possible` and :func:`_enough`."""
        order = np.argsort(x[6], kind="stable")
        token = x[6][order]
        lo, hi = np.searchsorted(token, y[6], side="left"), np.searchsorted(token, y[6], side="right")
        at = np.repeat(np.arange(len(lo)), hi - lo)
        of = order[np.arange(len(at)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[at]]
        i, j = x[5][of], y[5][at]
        n1, n2, l1, l2, p1, p2 = x[1][i], y[1][j], x[2][i], y[2][j], x[7][of], y[7][at]
        need = least(n1, l1, n2, l2)
        room = np.minimum(p1, p2) + 1 + np.minimum(n1 - p1, n2 - p2) - 1
        ok = ((x[4][i] != y[4][j]) & (den * np.minimum(n1, n2) >= num * np.maximum(n1, n2)) & (np.maximum(x[8][of], y[8][at]) <= np.minimum(l1, l2))
              & (np.minimum(x[3][i], y[3][j]) >= need) & ((num + den) * room >= num * (n1 + n2)))
        cell, first, shared = np.unique(i[ok] * len(y[0]) + j[ok], return_index=True, return_counts=True)
        good = shared >= need[ok][first]
        i, j = cell[good] // len(y[0]), cell[good] % len(y[0])
        return {"a": np.minimum(x[0][i], y[0][j]), "b": np.maximum(x[0][i], y[0][j]), "shared": shared[good]}

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, asked, waiting = None, [], None, []

        def flush() -> Iterator[pa.RecordBatch]:
            if waiting and asked is not None:
                made = meet(asked, columns(waiting))
                if len(made["a"]):
                    yield pa.RecordBatch.from_pydict(made)
            waiting.clear()

        for batch in batches:
            for row in batch.to_pylist():
                if (row["big"], row["q"], row["d"]) != cell:
                    yield from flush()
                    cell, held, asked = (row["big"], row["q"], row["d"]), [], None
                if row["kind"] == 0:
                    held.append(row)
                    continue
                if asked is None and held:
                    asked = columns(held)
                waiting.append(row)
                if len(waiting) >= 256:
                    yield from flush()
        yield from flush()

    dealt = queries.unionByName(nodes).repartition(parts, "big", "q", "d").sortWithinPartitions("big", "q", "d", "kind")
    return dealt.mapInArrow(search, "a long, b long, shared long")
