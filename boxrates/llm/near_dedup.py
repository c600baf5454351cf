"""MinHash near-duplicates: consistent weighted sampling over TF-IDF shingles.

1. Document frequencies of shingles are counted over all documents in hashed counters. A
   shingle's weight is its count in the text times an inverse document frequency.
2. Improved consistent weighted sampling draws ``SAMPLES`` samples per text; two texts agree
   in a sample with a probability equal to their weighted Jaccard similarity. The first
   ``BANDS * ROWS`` are banded.
3. Texts that share a band are compared with the hub of that band, the text that has most
   others in its bands; the weighted Jaccard similarity of whole texts decides. Linked texts
   form classes, and what is already in one class is not compared again.
4. Where a band's texts are still of several classes, those outside its largest class are
   compared with all texts of other classes there, so no pair that shares a band and could
   be a link is passed over. Before their texts, their samples are compared, and the weights
   of the shingles that each of them shares with no other such text.

Texts with the same words are one node throughout, so copies are never paired.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxrates.llm.common import stored, text_of
from boxrates.llm.components import components
from boxrates.llm.pieces import Remembered

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 3
#: Samples in all; the first are banded. Pairs are judged by four bits of each.
SAMPLES = 192
#: Texts at the similarity 0.8 agree in 156 of 192 on average, and in fewer than these once in
#: 10^5 pairs.
LEAST_AGREED = 132
PLANES = 4
#: Shingles of a text that are sampled at a time.
BLOCK = 4096
#: Words whose codes a task remembers.
WORDS_KEPT = 100_000
#: What rounding may take from a bound on the similarity.
ROUNDING = 1e-6
#: Shingles in one batch of ``_own_weights``, at least; a text's stay together.
PER_BATCH = 1 << 16
#: Bytes of vectors that a verifying task keeps at hand.
KEPT_BYTES = 48 << 20
DF_BITS = 18
#: Shingles in at most this share of the texts all have the full weight.
RARE = 0.005
SLICES = 16
_TABLE_BITS = 14
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

_WORDS = re.compile(r"[^\W_]+")


def _chunk(chunk: str) -> bytes:
    if chunk.isalnum():
        return xxhash.xxh3_64_digest(chunk)
    return b"".join(xxhash.xxh3_64_digest(w) for w in _WORDS.findall(chunk))


def new_memo() -> Remembered:
    return Remembered(_chunk, WORDS_KEPT)


def word_codes(text: str, memo: Remembered) -> np.ndarray:
    """A 64-bit code per word (letters and digits, in lower case), in order."""
    return np.frombuffer(b"".join(map(memo.__getitem__, text.lower().split())), dtype=np.uint64)


def _texts(batch: pa.RecordBatch, column: str = "text") -> Iterator[str]:
    """The texts of a batch; few of them are strings at a time."""
    column = batch.column(column)
    for start in range(0, len(column), 64):
        yield from column.slice(start, 64).to_pylist()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MULTIPLIER
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles in ascending order and how often each occurs.

    A text shorter than a shingle is one shingle; one without words has none.
    """
    if not len(codes):
        return codes, np.zeros(0, np.int64)
    width = min(SHINGLE, len(codes))
    n = len(codes) - width + 1
    total = codes[:n].copy()
    for i in range(1, width):
        total = total * _MULTIPLIER + codes[i : i + n]
    return np.unique(mix(total), return_counts=True)


# --- weights ---------------------------------------------------------------------------


def _count_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashed document counters of a partition, in slices."""
    memo, counts, n = new_memo(), np.zeros(1 << DF_BITS, np.int64), 0
    for batch in batches:
        for text in _texts(batch):
            n += 1
            found = shingles(word_codes(text, memo))[0]
            counts[np.unique(found >> np.uint64(64 - DF_BITS)).astype(np.int64)] += 1
    if n:
        yield pa.RecordBatch.from_pydict(
            {
                "slice": pa.array(range(SLICES), pa.int32()),
                "n": pa.array([n] * SLICES, pa.int64()),
                "counts": [c.tobytes() for c in np.split(counts, SLICES)],
            }
        )


def _add_frequencies(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of each slice over this task's rows."""
    sums: dict[int, np.ndarray] = {}
    texts: dict[int, int] = {}
    for batch in tables:
        for s, n, raw in zip(*(batch.column(c).to_pylist() for c in ("slice", "n", "counts")), strict=True):
            counts = np.frombuffer(raw, np.int64)
            sums[s] = sums[s] + counts if s in sums else counts
            texts[s] = texts.get(s, 0) + n
    if sums:
        yield pa.RecordBatch.from_pydict(
            {
                "slice": pa.array(list(sums), pa.int32()),
                "n": pa.array(list(texts.values()), pa.int64()),
                "counts": [c.tobytes() for c in sums.values()],
            }
        )


@dataclass(frozen=True)
class Weights:
    """Inverse document frequencies, between 1 and 2.

    ``common`` maps counters of frequent shingles to their weight; it has a fixed bound, as
    at most (shingles per text) / RARE counters can be that full. All others weigh 2.
    """

    common: dict[int, float]

    @functools.cached_property
    def table(self) -> np.ndarray:
        table = np.full(1 << DF_BITS, 2.0)
        for counter, weight in self.common.items():
            table[counter] = weight
        return table

    def of(self, keys: np.ndarray, times: np.ndarray) -> np.ndarray:
        return self.table[(keys >> np.uint64(64 - DF_BITS)).astype(np.int64)] * times


def idf(share: np.ndarray) -> np.ndarray:
    """2 for shingles in at most the share RARE of texts, falling to 1 for those in all."""
    return 1 + np.minimum(1, np.log(np.minimum(1, share)) / math.log(RARE))


def frequencies(docs: DataFrame) -> Weights:
    """Weights from all texts. What reaches the driver has a fixed size."""
    kind = "slice int, n bigint, counts binary"
    parts = docs.select(text_of().alias("text")).mapInArrow(_count_frequencies, kind)
    dealt = parts.repartition(SLICES, "slice")
    rows = dealt.mapInArrow(_add_frequencies, kind).collect()
    common: dict[int, float] = {}
    for row in rows:
        counts = np.frombuffer(row.counts, np.int64)
        full = np.nonzero(counts > RARE * row.n)[0]
        first = row.slice * ((1 << DF_BITS) // SLICES)
        weights = idf(counts[full] / row.n)
        common |= {int(first + c): float(w) for c, w in zip(full, weights, strict=True)}
    return Weights(common)


# --- samples ---------------------------------------------------------------------------


@functools.cache
def _variates():
    """Gamma and uniform variates of consistent weighted sampling, per sample and key hash.

    Keys take theirs from a table of 2^14 draws per sample; of keys with the same draws the
    smallest goes first.
    """
    draw = np.random.default_rng(20)
    shape = (1 << _TABLE_BITS, SAMPLES)  # a key's variates lie together
    r = draw.gamma(2.0, 1.0, shape).astype(np.float32)
    c = draw.gamma(2.0, 1.0, shape).astype(np.float32)
    beta = draw.random(shape, dtype=np.float32)
    log_c = np.log(c)
    step, value = _sample_values(r, log_c, beta, np.float32(math.log(2.0)))
    return r, log_c, beta, step, value


def _sample_values(r, log_c, beta, log_weight):
    """Quantised weight and log of the sampling value of each key."""
    step = np.floor(log_weight / r + beta)
    return step.astype(np.int16), log_c - r * (step - beta + 1)


def samples(keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """SAMPLES 32-bit marks; texts agree in one as often as their weighted Jaccard says.

    Keys are taken in blocks, so that memory does not grow with the text.
    """
    low, marks = _samples_of_block(keys[:BLOCK], weights[:BLOCK])
    for start in range(BLOCK, len(keys), BLOCK):
        values, others = _samples_of_block(keys[start : start + BLOCK], weights[start : start + BLOCK])
        marks = np.where(values < low, others, marks)
        low = np.minimum(values, low)
    return marks


def _samples_of_block(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least sampling value and mark of each sample."""
    r, log_c, beta, full_step, full_value = _variates()
    place = (keys & np.uint64((1 << _TABLE_BITS) - 1)).astype(np.int64)
    values = full_value.take(place, axis=0)
    other = np.nonzero(weights != 2.0)[0]
    if len(other):
        at = place[other]
        logs = np.log(weights[other]).astype(np.float32)[:, None]
        steps, values[other] = _sample_values(r[at], log_c[at], beta[at], logs)
    best = values.argmin(axis=0)
    every = np.arange(SAMPLES)
    step = full_step[place[best], every].astype(np.int64)
    if len(other):
        where = np.searchsorted(other, best)
        where[where == len(other)] = 0
        own = np.nonzero(other[where] == best)[0]
        step[own] = steps[where[own], own]
    marks = (mix(keys[best] + step.astype(np.uint64) * _MULTIPLIER) >> np.uint64(33)).astype(np.int32)
    return values[best, every], marks


def _bands(marks: np.ndarray) -> np.ndarray:
    total = np.arange(BANDS, dtype=np.uint64)
    for column in marks[: BANDS * ROWS].reshape(BANDS, ROWS).T:
        total = mix(total * _MULTIPLIER + column.astype(np.uint64))
    return total.view(np.int64)


def _planes(marks: np.ndarray) -> np.ndarray:
    """The lowest four bits of the marks, in bit planes: all lowest bits first, 64 to a number."""
    planes = (marks[None, :] >> np.arange(PLANES)[:, None]) & 1
    return np.packbits(planes.astype(np.uint8), axis=1).view(np.int64).ravel()


SIGNED = (
    "doc_id {id}, text_hash bigint, node binary, total double, marks array<bigint>, bands array<bigint>"
)


def _sign(weights: Weights):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = new_memo()
        for batch in batches:
            nodes, totals, marks, bands = [], [], [], []
            for text in _texts(batch):
                codes = word_codes(text, memo)
                nodes.append(node_of(codes))
                keys, times = shingles(codes)
                own = weights.of(keys, times)
                totals.append(float(own.sum()))
                drawn = samples(keys, own) if len(keys) else None
                marks.append(None if drawn is None else _planes(drawn))
                bands.append([] if drawn is None else _bands(drawn))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "text_hash": batch.column("text_hash"),
                    "node": pa.array(nodes, pa.binary()),
                    "total": pa.array(totals, pa.float64()),
                    "marks": pa.array(marks, pa.list_(pa.int64())),
                    "bands": pa.array(bands, pa.list_(pa.int64())),
                }
            )

    return sign


def node_of(codes: np.ndarray) -> bytes:
    """Digest of a text's words: texts with the same words are one node."""
    return xxhash.xxh3_128_digest(codes.tobytes())


# --- links -----------------------------------------------------------------------------


def similarity(a, b) -> float:
    """Weighted Jaccard similarity of two sparse vectors (ascending keys, weights)."""
    (keys_a, w_a), (keys_b, w_b) = a, b
    place = np.searchsorted(keys_a, keys_b)
    place[place == len(keys_a)] = 0
    shared = keys_a[place] == keys_b
    low = np.minimum(w_a[place[shared]], w_b[shared]).sum()
    return float(low / (w_a.sum() + w_b.sum() - low))


class _Vectors(dict):
    """Weighted shingles by text; all are forgotten when they outgrow ``KEPT_BYTES``."""

    def __init__(self, weights: Weights):
        super().__init__()
        self.weights, self.memo, self.held = weights, new_memo(), 0

    def __missing__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        keys, times = shingles(word_codes(text, self.memo))
        vector = keys, self.weights.of(keys, times)
        self.held += 4 * len(text) + 16 * len(keys) + 400
        if self.held > KEPT_BYTES:
            self.clear()
            self.held = 4 * len(text) + 16 * len(keys) + 400
        self[text] = vector
        return vector


def _verify(weights: Weights, least: float):
    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector = _Vectors(weights)
        for batch in batches:
            pairs = zip(_texts(batch, "text_a"), _texts(batch, "text_b"), strict=True)
            found = [similarity(vector[a], vector[b]) >= least for a, b in pairs]
            yield batch.select(["a", "b"]).filter(pa.array(found, pa.bool_()))

    return linked


def _links(pairs: DataFrame, texts: DataFrame, weights: Weights, least: float) -> DataFrame:
    """The pairs (``a, b``) whose whole texts are similar enough.

    The text of ``a`` may be wanted by very many pairs; those are dealt to several tasks, and
    its text goes to each of them.
    """
    per_task = 512
    pairs = stored(pairs, "pairs")
    wanted = pairs.groupBy("a").agg(F.ceil(F.count("*") / per_task).alias("salts"))
    salted = pairs.join(wanted, "a").withColumn(
        "salt", F.pmod(F.xxhash64("b"), F.col("salts"))
    )
    hubs = texts.join(wanted, texts["node"] == wanted["a"]).select(
        "a", F.col("text").alias("text_a"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("salt")
    )
    with_b = salted.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(hubs, ["a", "salt"]).select("a", "b", "text_a", "text_b")
    return stored(both.mapInArrow(_verify(weights, least), "a binary, b binary"), "linked")


def _alike(x: str, y: str, least: float) -> Column:
    """Whether the totals and samples of two rows leave the similarity possible."""
    near = F.least(f"{x}.total", f"{y}.total") >= least * F.greatest(f"{x}.total", f"{y}.total")
    return near & (_agreed(x, y) >= LEAST_AGREED)


def _agreed(x: str, y: str) -> Column:
    """In how many samples the marks of two rows agree.

    Each number is read once, as a join's condition is not freed of repeated expressions.
    """
    words = SAMPLES // 64
    agreed = F.lit(SAMPLES)
    for word in range(words):
        differ = [
            F.col(f"{x}.marks")[i].bitwiseXOR(F.col(f"{y}.marks")[i])
            for i in range(word, PLANES * words, words)
        ]
        agreed = agreed - F.bit_count(functools.reduce(Column.bitwiseOR, differ))
    return agreed


def _stars(spots: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Each text with the hub of each of its bands, where they are alike."""
    pairs = spots.filter(F.col("node") != F.col("a")).select("a", F.col("node").alias("b")).distinct()
    x = nodes.select(F.col("node").alias("a"), "total", "marks").alias("x")
    y = nodes.select(F.col("node").alias("b"), "total", "marks").alias("y")
    known = pairs.join(y, "b").select("a", "b", F.struct("total", "marks").alias("y"))
    return stored(
        known.join(x, "a").filter(_alike("x", "y", least)).select("a", "b"), "stars"
    )


def _classes(spots: DataFrame, roots: DataFrame) -> DataFrame:
    known = roots.select("node", F.col("root").alias("class"))
    return stored(
        spots.join(known, "node", "left").withColumn("class", F.coalesce("class", "node")), "classes"
    )


def _joined_classes(links: DataFrame, roots: DataFrame) -> DataFrame:
    """``root, last``: classes that further links join, and the root of what they form."""
    for end in ("a", "b"):
        own = roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
        links = links.join(own, end, "left").withColumn(f"root_{end}", F.coalesce(f"root_{end}", end))
    joined = components(links.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct())
    return joined.select(F.col("node").alias("root"), F.col("root").alias("last"))


def _shared_bands(nodes: DataFrame) -> DataFrame:
    """``node, band, a`` of bands with several nodes; ``a`` is the hub of the band.

    The hub is the node that has most others in its bands: of a text and its edited copies
    that is the text they were made from, or the least edited, which most are similar to.
    """
    counts = nodes.select(F.explode("bands").alias("band")).groupBy("band").agg(F.count("*").alias("n"))
    spots = nodes.select("node", F.explode("bands").alias("band"))
    spots = stored(spots.join(counts.filter("n > 1"), "band"), "shared")
    degrees = spots.groupBy("node").agg(F.sum("n").alias("degree"))
    hubs = spots.join(degrees, "node").groupBy("band").agg(
        F.max(F.struct("degree", "node"))["node"].alias("a")
    )
    return stored(spots.drop("n").join(hubs, "band"), "spots")


def _weighted_shingles(weights: Weights):
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = new_memo()
        for batch in batches:
            ids, keys, own, held = [], [], [], 0
            for i, text in zip(batch.column("id").to_pylist(), _texts(batch), strict=True):
                found, times = shingles(word_codes(text, memo))
                ids.append(np.full(len(found), i, np.int64))
                keys.append(found.view(np.int64))
                own.append(weights.of(found, times))
                held += len(found)
                if held >= PER_BATCH:
                    yield _batch_of(ids, keys, own)
                    ids, keys, own, held = [], [], [], 0
            if held:
                yield _batch_of(ids, keys, own)

    return explode


def _batch_of(*columns: list[np.ndarray]) -> pa.RecordBatch:
    arrays = [pa.array(np.concatenate(c)) for c in columns]
    return pa.RecordBatch.from_arrays(arrays, names=["id", "shingle", "weight"])


def _own_weights(members: DataFrame, texts: DataFrame, weights: Weights) -> DataFrame:
    """``id, own``: the weight of a node's shingles that no other of ``members`` has.

    ``id`` is the hash of a node; nodes without such shingles are left out.
    """
    rows = members.select("node").distinct().join(texts, "node").select(F.xxhash64("node").alias("id"), "text")
    each = rows.mapInArrow(_weighted_shingles(weights), "id bigint, shingle bigint, weight double")
    # With one row per shingle, the first id and weight are of that row.
    single = (
        each.groupBy("shingle")
        .agg(F.count("*").alias("n"), F.first("id").alias("id"), F.first("weight").alias("weight"))
        .filter("n = 1")
    )
    return stored(single.groupBy("id").agg(F.sum("weight").alias("own")), "own")


def _not_too_different(x: str, y: str, least: float) -> Column:
    """Whether the weights that two rows can't share leave the similarity possible.

    At most the rest of either can be shared, and all of one and the own part of the other
    are in their union.
    """
    shared = F.least(f"{x}.rest", f"{y}.rest")
    union = F.greatest(
        F.col(f"{x}.total") + F.col(f"{y}.total") - F.col(f"{y}.rest"),
        F.col(f"{x}.total") + F.col(f"{y}.total") - F.col(f"{x}.rest"),
    )
    return shared >= (least - ROUNDING) * union


def _rest(spots: DataFrame, nodes: DataFrame, texts: DataFrame, weights: Weights, least: float) -> DataFrame:
    """Pairs of different classes in one band that may yet be links.

    Only bands with several classes are looked at; a row of the band's largest class is
    never compared with another of it. A row that shares too little of its weight with all
    others is compared with none.
    """
    counts = spots.groupBy("band", "class").agg(F.count("*").alias("n"))
    bands = (
        counts.groupBy("band")
        .agg(F.count("*").alias("n_classes"), F.max_by("class", F.struct("n", "class")).alias("top"))
        .filter("n_classes > 1")
        .drop("n_classes")
    )
    members = stored(spots.join(bands, "band"), "members")
    own = _own_weights(members, texts, weights)
    known = nodes.select("node", "total", "marks", "bands").withColumn("id", F.xxhash64("node"))
    known = members.join(known, "node").join(own, "id", "left").drop("id")
    known = known.withColumn("rest", F.col("total") - F.coalesce("own", F.lit(0.0))).drop("own")
    mixed = stored(known.filter(F.col("rest") >= (least - ROUNDING) * F.col("total")), "mixed")
    x, y = mixed.filter(F.col("class") != F.col("top")).alias("x"), mixed.alias("y")
    # A pair of two rows outside the largest class is taken once.
    once = (F.col("y.class") == F.col("y.top")) | (F.col("x.node") < F.col("y.node"))
    apart = F.col("x.class") != F.col("y.class")
    # A pair that shares several bands is taken in the smallest of them.
    first = F.array_min(F.array_intersect("x.bands", "y.bands")) == F.col("x.band")
    same = F.col("x.band") == F.col("y.band")
    possible = _not_too_different("x", "y", least) & _alike("x", "y", least)
    joined = x.join(y, same & apart & once & possible & first)
    return joined.select(
        F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")
    ).distinct()


def near_classes(docs: DataFrame, *, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, class_id, class_size, kept, text_hash``; one row per row of ``docs``.

    Documents are of one class if a chain of links leads from one to the other; a link is a
    weighted Jaccard similarity of the TF-IDF shingles of five words of at least
    ``similarity``. ``class_id`` is the smallest ``doc_id`` of the class and its row is
    ``kept``. A pair of exactly the similarity 0.8 shares no band once in a million times.

    - Words are runs of letters and digits in lower case. NULL, empty and wordless texts are
      one class.
    - A text of fewer than five words is one shingle of all its words.
    - NULL ids are larger than all others; a class of them alone has a NULL ``class_id``.
    - Repeated rows are of one class; those that repeat its smallest id are all ``kept``,
      and ``drop_near`` leaves one of them.
    - Classes are told apart by their texts: several may have the same ``class_id``.
    - Other columns are ignored. An empty table gives an empty table.
    """
    return _rooted(docs, similarity).drop("root")


def _rooted(docs: DataFrame, similarity: float) -> DataFrame:
    """``near_classes`` with the ``root`` of each row's class, a digest that no other class has."""
    weights = frequencies(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(
        "doc_id", text_of().alias("text"), F.xxhash64(text_of()).alias("text_hash")
    )
    signed = stored(rows.mapInArrow(_sign(weights), SIGNED.format(id=kind)), "signed")
    nodes = signed.groupBy("node").agg(
        F.first("total").alias("total"), F.first("marks").alias("marks"), F.first("bands").alias("bands"),
        F.min("text_hash").alias("text_hash"),
    )
    nodes = stored(nodes, "nodes")
    spots = _shared_bands(nodes)
    # Whole texts of all nodes that share a band with another, each once.
    involved = spots.select("node").distinct().join(nodes.select("node", "text_hash"), "node")
    texts = rows.select("text", "text_hash").join(involved.hint("shuffle_hash"), "text_hash")
    texts = stored(texts.groupBy("node").agg(F.first("text").alias("text")), "texts")

    links = _links(_stars(spots, nodes, similarity), texts, weights, similarity)
    roots = stored(components(links), "components")
    spots = _classes(spots.drop("a"), roots)
    rest = _links(_rest(spots, nodes, texts, weights, similarity), texts, weights, similarity)
    last = stored(_joined_classes(rest, roots), "components")

    of_node = signed.select("node", "doc_id", "text_hash").join(roots, "node", "left")
    of_node = of_node.withColumn("root", F.coalesce("root", "node")).drop("node")
    of_node = of_node.join(last, "root", "left").withColumn("root", F.coalesce("last", "root")).drop("last")
    of_node = stored(of_node, "roots")
    classes = of_node.groupBy("root").agg(
        F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")
    )
    kept = F.col("doc_id").eqNullSafe(F.col("class_id"))
    return of_node.join(classes, "root").select(
        "doc_id", "class_id", "class_size", kept.alias("kept"), "text_hash", "root"
    )


def drop_near(docs: DataFrame, *, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class of near-duplicates, with the columns of ``docs``.

    Classes that have the same ``class_id``, or none, keep a row each.
    """
    kept = _rooted(docs, similarity).filter("kept")
    kept = kept.groupBy("root", "class_id").agg(F.min("text_hash").alias("text_hash"))
    keyed = docs.withColumn("_hash", F.xxhash64(text_of()))
    same = keyed["doc_id"].eqNullSafe(kept["class_id"]) & (keyed["_hash"] == kept["text_hash"])
    # Rows that repeat id and text are left once.
    return (
        keyed.join(kept.hint("shuffle_hash"), same, "left_semi")
        .dropDuplicates(["doc_id", "_hash"])
        .drop("_hash")
    )
