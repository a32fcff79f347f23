"""Hidden Markov language model over whole texts.

Words of all training texts are counted exactly.  The model has a few latent states, a first state distribution, a
transition matrix and an emission distribution per state; so that the model's size does not follow the vocabulary, states emit
one of ``classes`` word classes (a hash of the word) or the end of the text, and a word is drawn within its class with its
smoothed share of the corpus counts, whatever the state: P(word | state) = P(class | state) * (c + 0.1) / (n + 0.1 (v + 1)),
n and v being the class's training words, with repeats and without.  A text's probability is therefore the forward sum over its
classes times the words' shares, and both are exact.

Training is Baum-Welch over all training texts: tasks compute expected counts by scaled forward and backward recursions and hand
on their sums, which are added up by pieces of the matrix and normalised on the driver (states x classes numbers, whatever the
corpus).  States begin with hashed, unequal emissions and tend to stay.

Long texts are cut into segments of ``SEGMENT`` tokens that are worked on side by side: products of the segments' transfer
matrices give the forward and backward vectors at every border, so the recursions stay exact and a text of any length costs its
length.  Likelihoods are sums of the logarithms of the scale factors.

Scale: texts are read once and kept as word codes per slice (some MB of text, whole rows); each iteration reads only those.  Words go to
buckets of their hash in packed rows, once per slice, where their uses are added up, and the totals come back to the slices.
What is broadcast is the model (states x classes).

Defined cases: a null text is empty and still has its end; a null id is in no fold and is held out; rows that repeat an id are texts of
their own; without training texts all counts are zero and the model stays as it begins; words are told apart by 96 bits of a hash;
an empty table gives an empty result; other columns are not read.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storewatch.llm import packed
from storewatch.llm.words import mix, row_slices, split_words
from storewatch.session import Scope, cut_lineage

SLICE = 16 << 20
SEGMENT = 1024
WORK = 1 << 19       # tokens worked on at a time
RESCALE = 12         # steps between rescalings: a product of so many emissions is far from the smallest double
PIECE = 4096         # expected counts in a piece of the matrix
FIXED = float(1 << 16)   # expected counts are summed as integers, so that their order does not matter
SMOOTH = 0.1
SUMS = "piece int, data binary"
#: Rows of a slice (bucket null): its texts and the class of each of its words.  Rows of a bucket: words with hash and training uses.
ENCODED = ("slice long, bucket int, doc_id array<long>, train array<boolean>, sizes array<long>, codes binary, classes binary, "
           "place binary, h1 binary, h2 binary, uses binary")
_ENCODED = pa.schema([("slice", pa.int64()), ("bucket", pa.int32()), ("doc_id", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_())),
                      ("sizes", pa.list_(pa.int64()))] + [(n, pa.binary()) for n in ("codes", "classes", "place", "h1", "h2", "uses")])
SCORES = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def held_out(doc_id: Column, folds: int = 10) -> Column:
    """Rows that training never sees: crc32 of the id as text is divisible by ``folds``, or there is no id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


@dataclass
class Model:
    first: np.ndarray   # (states,)
    move: np.ndarray    # (states, states)
    emit: np.ndarray    # (states, classes + 1), the last column ends a text

    @staticmethod
    def begin(states: int, classes: int, seed: int = 1) -> Model:
        """Unequal hashed emissions; a state is kept with probability 0.9."""
        noise = mix(np.arange(states * (classes + 1), dtype=np.uint64) + np.uint64(seed << 32)) >> np.uint64(11)
        emit = 0.5 + noise.reshape(states, classes + 1) / float(1 << 53)
        move = np.full((states, states), 0.1 / max(states - 1, 1))
        np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
        return Model(np.full(states, 1 / states), move, emit / emit.sum(axis=1, keepdims=True))

    @staticmethod
    def of_counts(first: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Model:
        """Normalised expected counts; every event keeps a small share of its own."""
        norm = lambda x, least: (x + least) / (x + least).sum(axis=-1, keepdims=True)
        return Model(norm(first, 0.1), norm(move, 0.1), norm(emit, 0.01))


class Segments:
    """Texts of classes (flat ``obs``, offsets ``starts``) cut into segments of at most ``size`` tokens."""

    def __init__(self, obs: np.ndarray, starts: np.ndarray, size: int = SEGMENT):
        self.obs, lens = obs, np.diff(starts)
        count = -(-lens // size)
        self.text = np.repeat(np.arange(len(lens)), count)
        self.nth = np.arange(len(self.text)) - np.repeat(np.cumsum(count) - count, count)
        self.begin = starts[self.text] + self.nth * size
        self.size = np.minimum(size, starts[self.text + 1] - self.begin)
        self.final = self.nth == count[self.text] - 1

    def groups(self, which: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Segments (longest first) of about WORK tokens together, their tokens by step, and how many segments each step has."""
        cut = np.cumsum(self.size[which]) // WORK
        for part in np.split(which, np.flatnonzero(np.diff(cut)) + 1):
            if len(part):
                part = part[np.argsort(-self.size[part], kind="stable")]
                active = np.searchsorted(-self.size[part], -np.arange(self.size[part[0]]), side="left")
                step = np.repeat(np.arange(len(active)), active)
                rank = np.arange(len(step)) - np.repeat(np.cumsum(active) - active, active)
                yield part, self.begin[part[rank]] + step, active


def _borders(seg: Segments, model: Model, by_class: np.ndarray, backward: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each segment the distribution of its first state given the text before, and (``backward``) the likelihood, up to a
    factor, of all that follows it by the first state behind it (ones behind a text's end)."""
    states = len(model.first)
    entry = np.tile(model.first, (len(seg.text), 1))
    behind = np.ones((len(seg.text), states))
    inner = np.flatnonzero(~seg.final)
    if not len(inner):
        return entry, behind
    through = np.empty((len(seg.text), states, states))  # by the first states of a segment and of the one behind it
    for part, at, active in seg.groups(inner):
        m = np.tile(np.eye(states), (len(part), 1, 1))  # inner segments are all of full size
        for t, obs in enumerate(seg.obs[at].reshape(len(active), len(part))):
            m *= by_class[obs][:, None, :]
            m = (m.reshape(-1, states) @ model.move).reshape(m.shape)
            if t % RESCALE == RESCALE - 1:
                m /= m.sum(axis=(1, 2), keepdims=True)
        through[part] = m
    last = int(seg.nth.max())
    order = inner[np.argsort(seg.nth[inner], kind="stable")]
    by_nth = np.split(order, np.searchsorted(seg.nth[order], np.arange(1, last)))
    for here in by_nth:
        e = (entry[here][:, None, :] @ through[here])[:, 0]
        entry[here + 1] = e / e.sum(axis=1, keepdims=True)
    if backward:
        value = np.ones((len(seg.text), states))  # likelihood of a segment and all behind it by its first state
        for part, at, active in seg.groups(np.flatnonzero(seg.final & (seg.nth > 0))):
            seen, begins = by_class[seg.obs[at]], np.cumsum(active) - active
            u = np.ones((len(part), states))
            for t in range(len(active) - 1, -1, -1):
                n = active[t]
                b = (u[:n] @ model.move.T) * seen[begins[t]:begins[t] + n]
                u[:n] = b / b.sum(axis=1, keepdims=True)
            value[part] = u
        for here in reversed(by_nth):
            behind[here] = value[here + 1]
            v = (through[here] @ value[here + 1][:, :, None])[:, :, 0]
            value[here] = v / v.sum(axis=1, keepdims=True)
    return entry, behind


def _forward(seen: np.ndarray, model: Model, active: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward vectors of a group's tokens in place of ``seen`` (their emissions), rescaled every few steps, and the scale factors."""
    scale, a, lo = np.ones(len(seen)), entry, 0
    for t, n in enumerate(active):
        hi = lo + n
        now = seen[lo:hi]
        now *= a[:n]
        if t % RESCALE == RESCALE - 1:
            scale[lo:hi] = now.sum(axis=1)
            now /= scale[lo:hi, None]
        a, lo = now @ model.move, hi
    return seen, scale


def _last_tokens(active: np.ndarray) -> np.ndarray:
    """Place of each segment's last token among a group's tokens."""
    begins = np.cumsum(active) - active
    size = np.searchsorted(-active, -np.arange(active[0]), side="left")  # steps that have more than that many segments
    return begins[size - 1] + np.arange(active[0])


def log_likelihoods(obs: np.ndarray, starts: np.ndarray, model: Model, size: int = SEGMENT) -> np.ndarray:
    """Natural logarithm of each text's probability (every text has at least its end)."""
    seg, by_class = Segments(obs, starts, size), np.ascontiguousarray(model.emit.T)
    entry, _ = _borders(seg, model, by_class, False)
    out = np.zeros(len(starts) - 1)
    for part, at, active in seg.groups(np.arange(len(seg.text))):
        alpha, scale = _forward(by_class[seg.obs[at]], model, active, entry[part])
        rank = np.arange(len(at)) - np.repeat(np.cumsum(active) - active, active)
        of = np.bincount(rank, weights=np.log(scale), minlength=len(part)) + np.log(alpha[_last_tokens(active)].sum(axis=1))
        np.add.at(out, seg.text[part], of)
    return out


def expected_counts(obs: np.ndarray, starts: np.ndarray, model: Model, size: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected first states, moves and emissions of the texts under the model.

    Backward vectors are divided by the forward ones' scale factors, and begin so that the two multiply to 1 at a segment's last
    token, hence at every token."""
    seg, by_class = Segments(obs, starts, size), np.ascontiguousarray(model.emit.T)
    entry, behind = _borders(seg, model, by_class, True)
    states, width = model.emit.shape
    first, moves, emits = np.zeros(states), np.zeros((states, states)), np.zeros((states, width))
    back = np.ascontiguousarray(model.move.T)
    for part, at, active in seg.groups(np.arange(len(seg.text))):
        codes = seg.obs[at]
        seen = by_class[codes]
        alpha, scale = _forward(seen.copy(), model, active, entry[part])
        seen /= scale[:, None]
        ends = alpha[_last_tokens(active)]
        u = behind[part] / (ends * (behind[part] @ back)).sum(axis=1, keepdims=True)
        goes_on = ~seg.final[part]
        moves += ends[goes_on].T @ u[goes_on]
        beta, hi = np.empty_like(seen), len(codes)
        for n in active[::-1]:
            lo = hi - n
            np.matmul(u[:n], back, out=beta[lo:hi])
            np.multiply(beta[lo:hi], seen[lo:hi], out=u[:n])
            seen[lo:hi] = u[:n]
            hi = lo
        after = np.arange(active[0], len(codes))
        moves += alpha[after - np.repeat(active[:-1], active[1:])].T @ seen[after]
        beta *= alpha
        for k in range(states):
            emits[k] += np.bincount(codes, weights=beta[:, k], minlength=width)
        first += beta[:active[0]][seg.nth[part] == 0].sum(axis=0)
    return first, moves * model.move, emits


def pack_codes(codes: np.ndarray) -> bytes:
    """Compressed word codes, byte by byte of the 32 bits: the high ones are mostly equal."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpack_codes(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)


def encode(rows: DataFrame, classes: int, buckets: int, slice_bytes: int = SLICE) -> DataFrame:
    """ENCODED rows of texts (doc_id, train, text): one per slice of texts, and its distinct words by bucket of their hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slice_id = TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo, hi in row_slices(batch.column(2), slice_bytes):
                words = split_words(batch.column(2).slice(lo, hi - lo), lower=True)
                train = np.asarray(batch.column(1).slice(lo, hi - lo))
                name = np.frombuffer(b"".join(xxhash.xxh3_128_digest(w) for w in words.vocab.to_pylist()), ">u8").reshape(-1, 2).astype(np.uint64)
                uses = np.bincount(words.codes[np.repeat(train, words.counts)], minlength=len(name))
                whole = {"slice": slice_id, "doc_id": batch.column(0).slice(lo, hi - lo).to_pylist(), "train": train.tolist(),
                         "sizes": words.counts.tolist(), "codes": pack_codes(words.codes), "classes": (name[:, 0] % np.uint64(classes)).astype("<u4").tobytes()}
                yield pa.RecordBatch.from_pylist([whole], schema=_ENCODED)
                bucket = (name[:, 1] % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
                cols = (order.astype("<u4"), name[order, 0].astype("<u8"), (name[order, 1] >> np.uint64(32)).astype("<u4"), uses[order].astype("<u8"))
                yield pa.RecordBatch.from_pylist(
                    [{"slice": slice_id, "bucket": i, **{n: v[a:b].tobytes() for n, v in zip(("place", "h1", "h2", "uses"), cols, strict=True)}}
                     for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a], schema=_ENCODED)
                slice_id += 1

    return rows.select("doc_id", "train", "text").mapInArrow(run, ENCODED)


def _pieces(total: np.ndarray) -> pa.RecordBatch:
    """A vector of 64-bit integers as rows of PIECE numbers, those of zeros left out."""
    rows = np.zeros(-(-len(total) // PIECE) * PIECE, "<i8")
    rows[:len(total)] = total
    rows = rows.reshape(-1, PIECE)
    used = np.flatnonzero(rows.any(axis=1))
    return pa.RecordBatch.from_pydict({"piece": pa.array(used, pa.int32()), "data": pa.array([rows[i].tobytes() for i in used], pa.binary())})


def add_up(pieces: DataFrame, size: int) -> np.ndarray:
    """Sum of the tasks' vectors: pieces are added in parallel, the driver sees one vector."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for row in packed.rows_of(batches):
            total[row["piece"]] = total.get(row["piece"], 0) + np.frombuffer(row["data"], "<i8")
        yield pa.RecordBatch.from_pydict({"piece": pa.array(list(total), pa.int32()), "data": pa.array([v.tobytes() for v in total.values()], pa.binary())})

    out = np.zeros((-(-size // PIECE), PIECE), np.int64)
    parts = min(len(out), packed.partitions(pieces.sparkSession))
    for r in pieces.repartition(parts, "piece").mapInArrow(add, SUMS).collect():  # ``size`` numbers
        out[r.piece] = np.frombuffer(r.data, "<i8")
    return out.reshape(-1)[:size]


def word_totals(encoded: DataFrame, parts: int, scope: Scope) -> DataFrame:
    """slice, place, total: the training uses of the words at these places of the slice's vocabulary; and, without a slice, the
    first hash (as place) and uses of the distinct words that training texts have.

    A task streams its buckets in order and holds the words of one, each once per slice that has it."""
    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            slices, place, h1, h2, uses = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((h2, h1))
            new = np.ones(len(order), bool)
            new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
            group = np.cumsum(new) - 1
            total = np.zeros(group[-1] + 1, np.int64)
            np.add.at(total, group, uses[order])
            each = np.empty(len(order), np.int64)
            each[order] = total[group]
            edges = np.concatenate([[0], np.flatnonzero(np.diff(slices)) + 1, [len(slices)]])
            known = total > 0
            yield pa.RecordBatch.from_pydict({
                "slice": pa.array(np.append(slices[edges[:-1]], 0), pa.int64(), mask=np.append(np.zeros(len(edges) - 1, bool), True)),
                "place": pa.array([place[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)] + [h1[order][new][known].tobytes()], pa.binary()),
                "total": pa.array([each[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)] + [total[known].tobytes()], pa.binary())})

        bucket = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != bucket:
                    yield from flush()
                    bucket = row["bucket"]
                place = np.frombuffer(row["place"], "<u4")
                held.append((np.full(len(place), row["slice"], np.int64), place, np.frombuffer(row["h1"], "<u8"), np.frombuffer(row["h2"], "<u4"),
                             np.frombuffer(row["uses"], "<u8").astype(np.int64)))
        yield from flush()

    words = encoded.where("bucket is not null").select("slice", "bucket", "place", "h1", "h2", "uses")
    return scope.table(words.repartition(parts, "bucket").sortWithinPartitions("bucket", "slice").mapInArrow(
        totals, "slice long, place binary, total binary"))


def class_totals(totals: DataFrame, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Training words of each class, with repeats and distinct."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses, distinct = np.zeros(classes, np.int64), np.zeros(classes, np.int64)
        for batch in batches:
            for h1, total in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = (np.frombuffer(h1, "<u8") % np.uint64(classes)).astype(np.int64)
                np.add.at(uses, at, np.frombuffer(total, "<i8"))
                distinct += np.bincount(at, minlength=classes)
        yield _pieces(np.concatenate([uses, distinct]))

    # rows without a slice hold the distinct used words of a bucket
    both = add_up(totals.where("slice is null").select("place", "total").mapInArrow(run, SUMS), 2 * classes)
    return both[:classes], both[classes:]


def _observations(classes: np.ndarray, codes: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of all tokens, each text's followed by its end; offsets of the texts; text of each word."""
    text = np.repeat(np.arange(len(sizes)), sizes)
    obs = np.full(len(codes) + len(sizes), end, np.int64)
    obs[np.arange(len(codes)) + text] = classes[codes]
    return obs, np.concatenate([[0], np.cumsum(sizes + 1)]), text


def baum_welch(encoded: DataFrame, model: Model) -> Model:
    """One round over all training texts: expected counts summed over the tasks, normalised."""
    states, width = model.emit.shape
    spark = encoded.sparkSession
    shared = spark.sparkContext.broadcast(model)  # states x classes numbers
    size = states + states * states + states * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for row in batch.to_pylist():
                train, sizes = np.array(row["train"], bool), np.array(row["sizes"], np.int64)
                codes = unpack_codes(row["codes"])[np.repeat(train, sizes)]
                if train.any():
                    obs, starts, _ = _observations(np.frombuffer(row["classes"], "<u4"), codes, sizes[train], width - 1)
                    total += np.concatenate([x.reshape(-1) for x in expected_counts(obs, starts, shared.value)])
        yield _pieces(np.round(total * FIXED).astype(np.int64))

    slices = encoded.where("bucket is null").select("train", "sizes", "codes", "classes")
    total = add_up(slices.mapInArrow(run, SUMS), size) / FIXED
    shared.destroy()
    first, moves, emits = np.split(total, [states, states + states * states])
    return Model.of_counts(first, moves.reshape(states, states), emits.reshape(states, width))


def score_texts(docs: DataFrame, train: Column, states: int = 6, classes: int = 1 << 14, rounds: int = 3, seed: int = 1,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (smoothed unigrams) and score (this model), log10, of every
    row; the model learns from the rows where ``train`` holds."""
    spark = docs.sparkSession
    packed.limit_batches(spark)
    parts = packed.partitions(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"),
                       F.col(text_col).cast("string").alias("text"))
    with Scope(spark) as scope:
        encoded = scope.table(encode(rows, classes, packed.doc_buckets(parts)))
        totals = word_totals(encoded, parts, scope)
        uses, distinct = class_totals(totals, classes)
        ends = rows.where("train").count()
        model = Model.begin(states, classes, seed)
        for _ in range(rounds if ends else 0):
            model = baum_welch(encoded, model)
        n, v = int(uses.sum()) + ends, int(distinct.sum()) + (1 if ends else 0)
        rest = SMOOTH * (v + 1) + n
        shared = spark.sparkContext.broadcast((model, uses + SMOOTH * (distinct + 1)))  # states x classes and classes numbers

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, of_class = shared.value
            found: list[tuple] = []
            for batch in batches:
                for row in batch.to_pylist():
                    if row["total"] is not None:
                        found.append((np.frombuffer(row["place"], "<u4"), np.frombuffer(row["total"], "<i8")))
                        continue
                    cls, codes, sizes = np.frombuffer(row["classes"], "<u4"), unpack_codes(row["codes"]), np.array(row["sizes"], np.int64)
                    count = np.zeros(len(cls), np.int64)
                    for place, total in found:
                        count[place] = total
                    found.clear()
                    obs, starts, text = _observations(cls, codes, sizes, classes)
                    per_text = lambda of_word: np.bincount(text, weights=of_word[codes], minlength=len(sizes))
                    base = per_text(np.log10((count + SMOOTH) / rest)) + np.log10((ends + SMOOTH) / rest)
                    share = per_text(np.log10((count + SMOOTH) / of_class[cls]))
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(row["doc_id"], pa.int64()), "held_out": [not t for t in row["train"]], "n_tokens": sizes + 1,
                        "n_known": per_text((count > 0).astype(float)).astype(np.int64) + (1 if ends else 0),
                        "train_tokens": np.full(len(sizes), n), "base_score": base,
                        "score": log_likelihoods(obs, starts, model) / np.log(10) + share})

        none = F.lit(None).cast("binary")
        back = totals.where("slice is not null").select(
            "slice", F.lit(0).alias("kind"), F.expr("cast(null as array<long>)").alias("doc_id"), F.expr("cast(null as array<boolean>)").alias("train"),
            F.expr("cast(null as array<long>)").alias("sizes"), none.alias("codes"), none.alias("classes"), "place", "total")
        texts = encoded.where("bucket is null").select("slice", F.lit(1).alias("kind"), "doc_id", "train", "sizes", "codes", "classes",
                                                       none.alias("place"), none.alias("total"))
        together = back.unionByName(texts).repartition(parts, "slice").sortWithinPartitions("slice", "kind")
        return cut_lineage(together.mapInArrow(score, SCORES))
