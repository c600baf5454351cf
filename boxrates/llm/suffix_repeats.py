"""Removal of long byte strings that occur elsewhere, by sparse enhanced suffix arrays.

A full suffix array would hold an entry for every byte. Here suffixes start at anchors only:
each place ``i`` where a string of ``length`` bytes can start is served by the place of the
smallest gram hash among the next ``window`` places. That choice depends on the string alone,
so equal strings are served by anchors that lie alike in them. The places that one anchor
serves are neighbours and make a segment.

1. Segments are counted by a digest of all their bytes. Copies of a segment are repeats in
   full, however many there are, and need nothing more.
2. Segments with equal bytes behind their anchors, at least one of which has no copy, form a
   class. Of each distinct segment in it one keeps its bytes.
3. A class is a suffix array: its anchors' suffixes, sorted, with the lengths of common
   prefixes of neighbours. A stack scan yields its common-prefix intervals. Within an
   interval the suffixes are compared by what lies left of them: where left extensions stop
   agreeing a repeat is maximal, and a member's longest extensions tell which of its bytes
   any other occurrence shares.
4. Classes of very many distinct segments are not gathered. The strings that they could share
   are halved by where the anchor lies in them, and members meet again only with those that
   equal them in all that every string of a half must hold, and so on. A class that stays
   crowded ends with members that share one whole string, so nothing is left to compare.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxrates.llm.common import stored, text_of
from boxrates.llm.winnowing import WORDS, mixed, shared_fingerprints, text_key

LENGTH = 400
MANY = 4096  # distinct segments of a class that one task takes
GRAM = 24
_BITS = 18
_BLOCK = 1 << _BITS  # bytes that are hashed at once; a place has this many bits

SEGMENT = (
    "h bigint, f1 bigint, f2 bigint, digest binary, s int, a int, e int, n bigint, "
    "lo int, hi int"
)


class Hashes:
    """Hashes of all substrings of a block, from prefix sums modulo 2^64."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 1 << 64, 256, np.uint64)
        odd = int(rng.integers(0, 1 << 63)) * 2 + 1
        self.power = np.cumprod(np.r_[np.uint64(1), np.full(_BLOCK, odd, np.uint64)])
        self.inverse = np.cumprod(np.r_[np.uint64(1), np.full(_BLOCK, pow(odd, -1, 1 << 64), np.uint64)])

    def sums(self, block: np.ndarray) -> np.ndarray:
        result = np.zeros(len(block) + 1, np.uint64)
        np.cumsum(self.table[block] * self.power[: len(block)], out=result[1:])
        return result

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (sums[end] - sums[start]) * self.inverse[start]


def window_of(length: int) -> int:
    """Places among which an anchor is chosen: a power of two below two thirds of the length."""
    return 1 << max(0, (2 * length // 3).bit_length() - 1)


class Segmenter:
    """Segments of texts, block by block."""

    def __init__(self, length: int):
        self.length = length
        self.window = window_of(length)
        self.gram = min(GRAM, length - self.window + 1)
        self.hashes = Hashes(11), Hashes(12)

    def segments(self, block: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        """``h, f1, f2, s, a, e`` of the segments of the places ``starts`` of a block."""
        sums = [h.sums(block) for h in self.hashes]
        first = self.hashes[0]
        at = np.arange(len(block) - self.gram + 1)
        low = (sums[0][self.gram :] - sums[0][: -self.gram]) * first.inverse[: len(at)]
        low = mixed(low) >> np.uint64(_BITS) << np.uint64(_BITS) | at.astype(np.uint64)
        step = 1
        while step < self.window:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        anchors = (low[starts] & np.uint64(_BLOCK - 1)).astype(np.int64)
        new = np.flatnonzero(np.r_[True, anchors[1:] != anchors[:-1]])
        s, a = starts[new], anchors[new]
        e = starts[np.r_[new[1:], len(starts)] - 1]
        h = mixed(first.of(sums[0], a, a + self.length - self.window + 1))
        shape = ((a - s) << 32 | (e - s)).astype(np.uint64)
        f1, f2 = (mixed(mixed(k.of(x, s, e + self.length)) + shape) for k, x in zip(self.hashes, sums, strict=True))
        return h.view(np.int64), f1.view(np.int64), f2.view(np.int64), s, a, e


def _pieces(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Blocks of ``(text, first place, bytes)``. A long text gives several pieces that overlap."""
    held, size, most = [], 0, _BLOCK - 1
    for number, text in enumerate(texts):
        at = 0
        while len(text) - at >= length:
            if most - size < min(len(text) - at, 2 * length):
                yield held
                held, size = [], 0
            piece = text[at : at + most - size]
            held.append((number, at, piece))
            size += len(piece)
            at += len(piece) - length + 1
    if held:
        yield held


def _segment(length: int):
    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Segmenter(length)
        for batch in batches:
            digests = batch.column("digest").to_pylist()
            for held in _pieces(batch.column("bytes").to_pylist(), length):
                block = np.frombuffer(b"".join(p[2] for p in held), np.uint8)
                sizes = np.array([len(p[2]) for p in held])
                first = np.cumsum(sizes) - sizes
                starts = np.concatenate([f + np.arange(n - length + 1) for f, n in zip(first, sizes, strict=True)])
                h, f1, f2, s, a, e = maker.segments(block, starts)
                piece = np.searchsorted(first, s, "right") - 1
                shift = np.array([p[1] for p in held])[piece] - first[piece]
                s, a, e = s + shift, a + shift, e + shift
                text = np.array([p[0] for p in held])[piece]
                # Of segments that the block holds several times one goes on, with their number.
                _, one, group, n = np.unique(
                    np.stack([h, f1, f2]), axis=1, return_index=True, return_inverse=True, return_counts=True
                )
                again = np.flatnonzero(n[group] > 1)
                keys = pa.array([digests[i] for i in text[one]], pa.binary())
                yield _batch([h[one], f1[one], f2[one], keys, s[one], a[one], e[one], n, None, None])
                if len(again):
                    t, lo, hi = _merged(text[again], s[again], e[again] + length)
                    keys = pa.array([digests[i] for i in t], pa.binary())
                    yield _batch([None, None, None, keys, None, None, None, None, lo, hi])

    return segment


_TYPES = [pa.int64()] * 3 + [pa.binary()] + [pa.int32()] * 3 + [pa.int64()] + [pa.int32()] * 2


def _batch(columns: list) -> pa.RecordBatch:
    size = next(len(c) for c in columns if c is not None)
    arrays = [
        pa.nulls(size, t) if c is None else c if isinstance(c, pa.Array) else pa.array(c.astype(t.to_pandas_dtype()), t)
        for c, t in zip(columns, _TYPES, strict=True)
    ]
    return pa.RecordBatch.from_arrays(arrays, [f.split(" ")[0] for f in SEGMENT.split(", ")])


def _merged(text: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans of texts, ascending by text and start, joined where they touch."""
    order = np.lexsort((lo, text))
    text, lo, hi = text[order], lo[order], hi[order]
    far = np.int64(hi.max()) + 1
    reach = np.maximum.accumulate(text.astype(np.int64) * far + hi)  # texts keep to themselves
    new = np.r_[True, (text[1:] != text[:-1]) | (text[1:] * far + lo[1:] > reach[:-1])]
    last = np.r_[np.flatnonzero(new)[1:], len(text)] - 1
    return text[new], lo[new], (reach[last] - text[last] * far)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row of two tables."""
    if not a.shape[1]:
        return np.zeros(len(a), np.int64)
    differ = a != b
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


def _padded(strings: list[bytes], fill: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Strings as rows of equal width, and their lengths."""
    sizes = np.array([len(s) for s in strings])
    width = int(sizes.max()) if len(sizes) else 0
    table = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8)
    return table.reshape(len(strings), width), sizes


def _prefixes(strings: list[bytes]) -> np.ndarray:
    """Length of the common prefix of each string and the one before it; 0 for the first."""
    table, sizes = _padded(strings)
    result = np.zeros(len(strings), np.int64)
    result[1:] = np.minimum(_common(table[1:], table[:-1]), np.minimum(sizes[1:], sizes[:-1]))
    return result


def intervals(prefix: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Common-prefix intervals ``(prefix, first, last)`` of a suffix array, inner ones first."""
    stack = [(0, 0)]
    for i, now in enumerate([*prefix[1:].tolist(), 0], 1):
        first = i - 1
        while stack and stack[-1][0] > now:
            value, first = stack.pop()
            yield value, first, i - 1
        if not stack or stack[-1][0] < now:
            stack.append((now, first))


def extents(prefix: np.ndarray, lefts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix how far left and right of its anchor it takes part in repeats.

    ``prefix`` belongs to the sorted suffixes; ``lefts`` is what precedes each, read backwards.
    All repeats of a suffix hold its anchor, so their union is one span; 0, 0 is none.
    """
    left, right = np.zeros(len(lefts), np.int64), np.zeros(len(lefts), np.int64)
    order = np.array(sorted(range(len(lefts)), key=lefts.__getitem__))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    table, sizes = _padded(lefts)
    for value, first, last in intervals(prefix):
        inside = np.arange(first, last + 1)
        inside = inside[sizes[inside] >= length - value]
        if len(inside) < 2:
            continue
        # Neighbours in the order of left extensions part where the repeat ends on the left.
        inside = inside[np.argsort(rank[inside])]
        part = np.minimum(_common(table[inside[1:]], table[inside[:-1]]), np.minimum(sizes[inside[1:]], sizes[inside[:-1]]))
        longest = np.maximum(np.r_[part, 0], np.r_[0, part])
        repeat = (np.r_[part, -1] >= length - value) | (np.r_[-1, part] >= length - value)
        inside, longest = inside[repeat], longest[repeat]
        left[inside] = np.maximum(left[inside], longest)
        right[inside] = np.maximum(right[inside], value)
    return left, right


def _classes(length: int):
    """Spans of the segments without a copy, from rows sorted by class and suffix."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if kept is None else [kept, batch]).combine_chunks()
            batch = table.to_batches()[0]
            h = batch.column("h").to_numpy()
            ends = np.flatnonzero(h[1:] != h[:-1]) + 1
            cut = int(ends[-1]) if len(ends) else 0
            kept = batch.slice(cut)
            if cut:
                yield spans(batch.slice(0, cut))
        if kept is not None and kept.num_rows:
            yield spans(kept)

    def spans(rows: pa.RecordBatch) -> pa.RecordBatch:
        h, a, n = (rows.column(c).to_numpy() for c in ("h", "a", "n"))
        lefts = [x[::-1] for x in rows.column("left").to_pylist()]
        prefix = _prefixes(rows.column("right").to_pylist())
        new = np.r_[True, h[1:] != h[:-1]]
        prefix[new] = 0
        first = np.flatnonzero(new)
        count = np.diff(np.r_[first, len(h)])
        left, right = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        # Pairs, most of the classes, all at once.
        i = first[count == 2]
        if len(i):
            x, y = ([lefts[j] for j in i + k] for k in (0, 1))
            (x, n_x), (y, n_y) = _padded(x), _padded(y)
            width = min(x.shape[1], y.shape[1])
            part = np.minimum(np.minimum(n_x, n_y), _common(x[:, :width], y[:, :width]) if width else 0)
            found = part + prefix[i + 1] >= length
            for j in (i[found], i[found] + 1):
                left[j], right[j] = part[found], prefix[i[found] + 1]
        for i, m in zip(first[count > 2], count[count > 2], strict=True):
            left[i : i + m], right[i : i + m] = extents(prefix[i : i + m], lefts[i : i + m], length)
        take = np.flatnonzero((right > 0) & (n == 1))
        return pa.RecordBatch.from_arrays(
            [
                rows.column("digest").take(pa.array(take)),
                pa.array((a - left)[take].astype(np.int32)),
                pa.array((a + right)[take].astype(np.int32)),
            ],
            ["digest", "lo", "hi"],
        )

    return scan


def _keyed(docs: DataFrame) -> DataFrame:
    text = text_of()
    return docs.select(F.unhex(F.sha2(text, 256)).alias("digest"), text.cast("binary").alias("bytes"))


def _halved(rows: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Crowded classes cut in two, and spans of segments whose half equals another one's.

    A class holds strings whose anchor lies between ``x`` and ``y`` bytes from their start, so
    they share ``x`` bytes before it and ``length - y`` from it on.
    """
    middle = F.floor((F.col("x") + F.col("y")) / 2).cast("int")
    halves = F.array(F.struct(F.col("x"), middle.alias("y")), F.struct((middle + 1).alias("x"), F.col("y")))
    rows = rows.filter("x < y").withColumn("half", F.explode(halves))
    rows = rows.withColumns(
        {
            "x": F.col("half.x"),
            "y": F.col("half.y"),
            "near": F.greatest(F.col("half.x"), F.col("a") - F.col("e")),
            "far": F.least(F.col("half.y"), F.col("a") - F.col("s")),
        }
    ).filter("near <= far")
    rows = rows.select(
        "digest",
        (F.col("a") - F.col("far")).alias("s"),
        "a",
        (F.col("a") - F.col("near")).alias("e"),
        "n",
        F.expr("substring(left, octet_length(left) - far + 1, far)").alias("left"),
        F.expr(f"substring(right, 1, {length} - near)").alias("right"),
        "x",
        "y",
    )
    shared = F.expr(f"concat(substring(left, octet_length(left) - x + 1, x), substring(right, 1, {length} - y))")
    whole = F.unhex(F.sha2(F.concat("left", "right"), 256))
    rows = rows.withColumns({"h": F.xxhash64("x", "y", shared), "f": whole, "at": F.octet_length("left")})
    rows = stored(rows, "halves")
    kinds = rows.groupBy("h", "f", "at").agg(F.sum("n").alias("copies"))
    classes = kinds.groupBy("h").agg(F.count("*").alias("distinct"), F.count_if(F.col("copies") == 1).alias("single"))
    kinds = kinds.join(classes.filter("distinct > 1 or single = 0"), "h")
    rows = stored(rows.join(kinds, ["h", "f", "at"]), "halves")
    end = (F.col("e") + length).cast("int")
    same = rows.filter("n = 1 and copies > 1").select("digest", F.col("s").alias("lo"), end.alias("hi"))
    # Of equal halves one goes on, known to have copies.
    giver = F.min(F.struct("digest", "s", "a", "e", "left", "right", "x", "y", "distinct")).alias("g")
    rows = rows.filter("distinct > 1 and single > 0").groupBy("h", "f", "at").agg(giver, F.max("copies").alias("n"))
    return stored(rows.select("h", "n", "g.*"), "classes"), same


def repeated_spans(docs: DataFrame, *, length: int = LENGTH, many: int = MANY) -> DataFrame:
    """``digest, spans``: for each distinct text with repeats the byte spans that they cover.

    ``digest`` is the SHA-256 of the text's bytes; spans ``(lo, hi)``, ascending, may overlap.
    ``many`` decides how work is split and never changes the result.
    """
    long = _keyed(docs).filter(F.octet_length("bytes") >= length)
    segments = long.mapInArrow(_segment(length), SEGMENT)
    exact = ["h", "f1", "f2"]
    counted = segments.filter("h is not null").groupBy(*exact).agg(F.sum("n").alias("copies"))
    classes = counted.groupBy("h").agg(
        F.sum("copies").alias("all"),
        F.count("*").alias("distinct"),
        F.count_if(F.col("copies") == 1).alias("single"),
    )
    classes = classes.filter(F.col("all") > 1).select("h", "distinct", "single")
    counted = counted.join(classes, "h")
    open_class = ((F.col("distinct") > 1) & (F.col("single") > 0)).alias("open")
    counted = stored(counted.select(*exact, "copies", "distinct", open_class), "segments")
    hits = segments.join(counted, exact, "left").filter("h is null or copies is not null")
    hits = stored(hits.select("digest", "s", "a", "e", "lo", "hi", *exact, "copies", "distinct", "open"), "hits")

    end = F.col("e") + F.lit(length)
    full = hits.filter("copies > 1").select("digest", F.col("s").alias("lo"), end.alias("hi"))
    local = hits.filter("copies is null").select("digest", "lo", "hi")

    # One occurrence of each distinct segment of an open class brings its bytes.
    place = F.struct("digest", "s", "a", "e")
    givers = hits.filter("open").groupBy(*exact).agg(
        F.min(place).alias("p"), F.first("copies").alias("n"), F.first("distinct").alias("distinct")
    )
    wanted = F.collect_list(F.struct("h", "p.s", "p.a", "p.e", "n", "distinct")).alias("wanted")
    wanted = givers.groupBy(F.col("p.digest").alias("digest")).agg(wanted)
    texts = long.groupBy("digest").agg(F.first("bytes").alias("bytes"))  # copies merge before the shuffle
    bytes_of = texts.join(wanted, "digest").select("digest", "bytes", F.explode("wanted").alias("w"))
    rows = bytes_of.select(
        "digest",
        "w.*",
        F.expr("substring(bytes, w.s + 1, w.a - w.s)").alias("left"),
        F.expr(f"substring(bytes, w.a + 1, w.e + {length} - w.a)").alias("right"),
    )
    rows = stored(rows, "classes")
    scan, parts = _classes(length), []
    crowded = rows.withColumns({"x": F.lit(0), "y": F.lit(window_of(length) - 1)})
    while True:
        small = crowded.filter(F.col("distinct") <= many)
        small = small.repartition("h").sortWithinPartitions("h", "right")
        parts.append(small.mapInArrow(scan, "digest binary, lo int, hi int"))
        crowded = crowded.filter(F.col("distinct") > many)
        if crowded.isEmpty():
            break
        crowded, same = _halved(crowded, length)
        parts.append(same)

    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    spans = full.unionByName(local).unionByName(found)
    spans = spans.groupBy("digest", "lo").agg(F.max("hi").alias("hi"))
    return spans.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("spans"))


def _cut(bytes_: bytes, spans: list[dict]) -> tuple[bytes, int]:
    """What is left without the spans, and how many runs were taken out."""
    kept, at, runs = [], 0, 0
    for span in spans:
        if span["lo"] > at or not runs:
            kept.append(bytes_[at : span["lo"]])
            runs += 1
        at = max(at, span["hi"])
    return b"".join([*kept, bytes_[at:]]), runs


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("bytes", "spans"))
        left = [_cut(b, spans) for b, spans in zip(*columns, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("digest"),
                pa.array([k for k, _ in left], pa.binary()),
                pa.array([r for _, r in left], pa.int64()),
                pa.array([hashlib.sha256(k).hexdigest() for k, _ in left], pa.string()),
            ],
            ["digest", "kept", "n_spans", "kept_sha256"],
        )


def without_repeats(docs: DataFrame, *, length: int = LENGTH, many: int = MANY, words: int = WORDS) -> DataFrame:
    """Every row's id with what is left of its text.

    Output per row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared``. A
    byte goes if a string of ``length`` bytes that covers it starts at any other place of any
    text, the same text included; strings are judged on the input.

    ``n_shared`` removes nothing. It tells of passages of ``words`` words or more that another
    row holds, also where they are shorter than ``length`` bytes: see ``shared_fingerprints``.

    - NULL and empty texts, and those shorter than ``length``, stay as they are.
    - Repeated rows and copies of a text are repeats of each other: all their bytes go.
    - Texts of any length are hashed in blocks that overlap. Ids are not looked at.
    - Other columns are ignored. An empty table gives an empty table.
    """
    text = text_of()
    rows = docs.select(
        "doc_id", F.octet_length(text).cast("bigint").alias("n_bytes"), F.unhex(F.sha2(text, 256)).alias("digest"), text_key().alias("key")
    )
    spans = stored(repeated_spans(docs, length=length, many=many), "spans")
    cut = kept_texts(docs, spans).drop("kept")
    found = rows.join(cut, "digest", "left").join(shared_fingerprints(docs, words=words), "key", "left")
    n_kept = F.coalesce("n_kept", "n_bytes")
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - n_kept).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("bigint").alias("n_spans"),
        F.coalesce("kept_sha256", F.lower(F.hex("digest"))).alias("kept_sha256"),
        F.coalesce("n_shared", F.lit(0)).cast("bigint").alias("n_shared"),
    )


def kept_texts(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``digest, kept, n_kept, n_spans, kept_sha256`` of each distinct text that ``spans`` cuts."""
    texts = _keyed(docs).groupBy("digest").agg(F.first("bytes").alias("bytes"))
    cut = texts.join(spans, "digest").mapInArrow(
        _remove, "digest binary, kept binary, n_spans bigint, kept_sha256 string"
    )
    return cut.withColumn("n_kept", F.octet_length("kept").cast("bigint"))
