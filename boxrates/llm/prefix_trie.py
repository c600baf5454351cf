"""Prefix trie of conversations: which of them share their first turns, and what that saves.

The upper nodes of the trie, those with very many turns below them, are merged globally by
aggregation. Every other node lies with its whole subtree in one shard, the shard of its
topmost ancestor that is not an upper node. A shard numbers its turns densely, packs them
into a double-array trie (BASE, CHECK) and walks all its conversations through the arrays at
once, so that a subtree's sums are final when the shard is done; they are then added up
along the upper nodes in as many rounds as the logarithm of their depth.

A first turn that a third of all conversations share, copies of a conversation in any number
and a very long conversation all become upper nodes and are never gathered in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxrates.llm.common import stored

CROWDED = 200_000  # turns below a node that make it an upper node
FAMILY = 20
_CHUNK = 12  # bits of the ids that are written down together
_WORD = r"[^\x20\x09-\x0D]+"
_TRIED = 1 << 20
NO_ENDS = hashlib.sha256(b"").hexdigest()

_NODE = (
    "node binary, parent binary, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, "
    "n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, top boolean"
)


def _prefix(depth: Column, over) -> Column:
    """Digest of a prefix: its turns, each hashed with its place, summed up in four lanes."""
    lanes = []
    for seed in (1, 2):
        mixed = F.xxhash64(F.lit(seed), depth, F.col("key"))
        lanes += [mixed.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(mixed, 32)]
    sums = [F.sum(F.when(depth > 0, lane).otherwise(F.lit(0))).over(over) for lane in lanes]
    return F.unhex(F.md5(F.concat_ws(",", depth, *sums)))


def rebuilt(conversations: DataFrame, *, family: int = FAMILY) -> DataFrame:
    """``conv_id, depth, key, words``: the rebuilt turns, and one row of depth 0 for each id.

    The first turns, as many as the checksum of the id modulo 4 says, come from the first
    conversation of each ``family`` of ids. All is done where the family's turns lie, in
    one shuffle of digests; windows spill, so a long conversation needs no memory.
    """
    text = [F.coalesce(F.col(c), F.lit("")) for c in ("role", "text")]
    # The length of the role keeps (ab, c) and (a, bc) apart.
    whole = F.concat_ws(":", F.char_length(text[0]).cast("string"), *text)
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        "turn",
        F.unhex(F.substring(F.sha2(whole, 256), 1, 32)).alias("key"),
        F.regexp_count(text[1], F.lit(_WORD)).cast("bigint").alias("words"),
    )
    turns = turns.withColumn("base", F.col("conv_id") - F.col("conv_id") % family).repartition("base")
    one = Window.partitionBy("base", "conv_id")
    own = F.row_number().over(one.orderBy(F.col("turn").asc_nulls_first(), "key")).cast("bigint")
    turns = turns.withColumn("n", own).withColumn(
        "kept", F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    )
    item = F.struct(F.col("n").alias("depth"), "key", "words")
    heads = F.collect_list(F.when((F.col("conv_id") == F.col("base")) & (F.col("n") <= 3), item))
    turns = turns.withColumn("heads", F.array_sort(heads.over(Window.partitionBy("base"))))
    taken = F.least("kept", F.size("heads").cast("bigint"))
    root = F.struct(F.lit(0).cast("bigint").alias("depth"), F.lit(b"").alias("key"), F.lit(0).cast("bigint").alias("words"))
    first = F.concat(F.array(root), F.slice("heads", 1, F.greatest(taken, F.lit(0)).cast("int")))
    later = F.struct((F.col("n") - F.col("kept") + taken).alias("depth"), "key", "words")
    none = F.array().cast("array<struct<depth:bigint,key:binary,words:bigint>>")
    rows = F.concat(
        F.when(F.col("n") == 1, first).otherwise(none),
        F.when(F.col("n") > F.col("kept"), F.array(later)).otherwise(none),
    )
    return turns.select("base", "conv_id", F.explode(rows).alias("t")).select("base", "conv_id", "t.*")


def _steps(turns: DataFrame) -> DataFrame:
    """Each turn with its node, the node above it and how many turns its conversation has from it on."""
    over = Window.partitionBy("base", "conv_id")
    ordered = over.orderBy("depth")
    return turns.withColumn("node", _prefix(F.col("depth"), ordered)).select(
        "conv_id",
        "depth",
        "key",
        "words",
        "node",
        F.lag("node").over(ordered).alias("parent"),
        (F.max("depth").over(over) - F.col("depth")).alias("onward"),
    )


class DoubleArray:
    """A trie over rows of dense codes, packed level by level into BASE and CHECK.

    A child of state ``s`` by code ``c`` is cell ``base[s] + c``, and ``check`` of that cell
    is ``s``. State 0 is the root. ``codes`` holds one row per step, ``path`` and ``level``
    tell to which sequence and place it belongs; both ascend.
    """

    def __init__(self, path: np.ndarray, level: np.ndarray, codes: np.ndarray):
        size = max(64, 2 * len(codes))
        self.base = np.zeros(size, np.int64)
        self.check = np.full(size, -1, np.int64)
        self.check[0] = 0
        self.end = 1  # every cell from here on is free
        self.free = 1  # every cell below is taken
        state = np.zeros(int(path.max()) + 1 if len(path) else 0, np.int64)
        spread = int(codes.max()) + 1 if len(codes) else 1
        for at in range(int(level.max()) + 1 if len(level) else 0):
            here = level == at
            who, code = path[here], codes[here]
            edges = np.unique(state[who] * spread + code)
            self._add(edges // spread, edges % spread)
            state[who] = self.base[state[who]] + code

    def _room(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])

    def _add(self, states: np.ndarray, codes: np.ndarray) -> None:
        first = np.flatnonzero(np.r_[True, states[1:] != states[:-1]])
        count = np.diff(np.r_[first, len(states)])
        for i in np.flatnonzero(count > 1)[np.argsort(-count[count > 1], kind="stable")]:
            children = codes[first[i] : first[i] + count[i]]
            self._place(states[first[i]], children)
        # Only children fill the holes, then the free end.
        single = first[count == 1]
        holes = np.flatnonzero(self.check[self.free : self.end] < 0)[: len(single)] + self.free
        cells = np.r_[holes, self.end + np.arange(len(single) - len(holes))]
        self._room(int(cells.max()) + 1 if len(cells) else 0)
        self.base[states[single]] = cells - codes[single]
        self.check[cells] = states[single]
        if len(cells):
            self.end = max(self.end, int(cells.max()) + 1)
            if len(cells) > len(holes):
                self.free = self.end

    def _place(self, state: int, children: np.ndarray) -> None:
        """The first place of a block of holes where all children fit, else the free end."""
        span = children - children[0]
        holes = np.flatnonzero(self.check[self.free : self.end] < 0)
        starts = holes[: max(1, _TRIED // len(children))] + self.free
        self._room(self.end + int(span[-1]) + 1)
        cells = np.minimum(starts[:, None] + span, self.end)
        fits = np.flatnonzero(((self.check[cells] < 0) | (cells == self.end)).all(axis=1))
        start = starts[fits[0]] if len(fits) else self.end
        self.base[state] = start - children[0]
        self.check[start + span] = state
        self._room(int(start + span[-1]) + 2)
        self.end = max(self.end, int(start + span[-1]) + 1)

    def walk(self, path: np.ndarray, level: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The state after each step; raises where a step is not in the trie."""
        state = np.zeros(int(path.max()) + 1 if len(path) else 0, np.int64)
        after = np.empty(len(codes), np.int64)
        for at in range(int(level.max()) + 1 if len(level) else 0):
            here = np.flatnonzero(level == at)
            who = path[here]
            cell = self.base[state[who]] + codes[here]
            if (self.check[cell] != state[who]).any():
                raise KeyError("a sequence is not in the trie")
            after[here] = state[who] = cell
        return after


def _dense(values: pa.Array, order: np.ndarray) -> np.ndarray:
    """Numbers from 0 in the order of first appearance, so that siblings lie close together."""
    raw = values.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    _, at, inverse = np.unique(raw[order], return_index=True, return_inverse=True)
    rank = np.empty(len(at), np.int64)
    rank[np.argsort(at)] = np.arange(len(at))
    result = np.empty(len(raw), np.int64)
    result[order] = rank[inverse]
    return result


def _ends_digest(ids: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, np.sort(ids).tolist())).encode()).hexdigest()


def _shard(steps: pa.Table) -> pa.Table:
    """All nodes of a shard. Its rows are the steps of conversations from a shard root on."""
    steps = steps.sort_by([("conv_id", "ascending"), ("depth", "ascending")]).combine_chunks()
    conv, depth, words, onward = (
        steps.column(c).to_numpy() for c in ("conv_id", "depth", "words", "onward")
    )
    start = np.r_[True, conv[1:] != conv[:-1]]
    path = np.cumsum(start) - 1
    level = depth - depth[start][path]
    node, key = steps.column("node").combine_chunks(), steps.column("key").combine_chunks()
    # Shard roots differ by their whole prefix, steps below them by their turn.
    codes = _dense(pa.array(np.where(level == 0, node.to_numpy(zero_copy_only=False), key.to_numpy(zero_copy_only=False)), pa.binary()), np.lexsort((path, level)))
    trie = DoubleArray(path, level, codes)
    cell = trie.walk(path, level, codes)
    cells, row, at = np.unique(cell, return_index=True, return_inverse=True)
    n = len(cells)
    convs = np.bincount(at, minlength=n)
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, at, conv)
    above = np.searchsorted(cells, trie.check[cells])
    above = np.where(level[row] == 0, n, above)  # n stands for what is above the shard
    children = np.bincount(above, minlength=n + 1)
    leaves = np.r_[(children[:n] == 0).astype(np.int64), 0]
    saved = np.r_[(convs - 1) * words[row], 0]
    for at_level in range(int(level.max()), 0, -1):
        here = np.flatnonzero(level[row] == at_level)
        np.add.at(leaves, above[here], leaves[here])
        np.add.at(saved, above[here], saved[here])
    ends = np.full(n, NO_ENDS, object)
    last = np.flatnonzero(onward == 0)
    last = last[np.argsort(at[last], kind="stable")]
    for group in np.split(last, np.flatnonzero(np.diff(at[last])) + 1) if len(last) else []:
        ends[at[group[0]]] = _ends_digest(conv[group])
    top = level[row] == 0
    columns = [
        node.take(pa.array(row)),
        steps.column("parent").combine_chunks().take(pa.array(row)),
        depth[row],
        least,
        pa.array(np.where(top, 0, np.r_[least, 0][above]), mask=top),
        convs,
        children[:n],
        leaves[:n],
        saved[:n],
        pa.array(ends, pa.string()),
        top,
    ]
    names = [field.split(" ")[0] for field in _NODE.split(", ")]
    return pa.table(dict(zip(names, columns, strict=True)))


def _ended(ends: DataFrame) -> DataFrame:
    """``node, ends_sha256`` from ``node, conv_id``.

    Ids are written down in chunks of neighbours; the digest of a node is taken chunk by
    chunk in order, so a task holds one chunk of a node, however many end there.
    """
    chunk = F.shiftright("conv_id", _CHUNK).alias("chunk")
    text = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    chunks = ends.groupBy("node", chunk).agg(text.alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []
        for batch in batches:
            done = []
            for node, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if node != now:
                    if state is not None:
                        done.append((now, state.hexdigest()))
                    now, state = node, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield rows(done)
        if state is not None:
            yield rows([(now, state.hexdigest())])

    def rows(done: list) -> pa.RecordBatch:
        nodes, digests = zip(*done, strict=True) if done else ((), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(nodes, pa.binary()), pa.array(digests, pa.string())], ["node", "ends_sha256"]
        )

    dealt = chunks.repartition("node").sortWithinPartitions("node", "chunk")
    return dealt.mapInArrow(digest, "node binary, ends_sha256 string")


def _summed(upper: DataFrame, depth: int) -> DataFrame:
    """``node, n_leaves, saved_tokens`` summed over all upper nodes below and at each.

    Each round adds what lies twice as far below as the round before.
    """
    now = stored(upper.select("node", F.col("parent").alias("up"), "n_leaves", "saved_tokens"), "upper")
    for _ in range(depth.bit_length()):
        sent = now.filter("up is not null").groupBy("up").agg(
            F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s")
        )
        further = now.select(F.col("node").alias("up"), F.col("up").alias("next"))
        now = now.join(further, "up", "left").join(sent.withColumnRenamed("up", "node"), "node", "left")
        now = stored(
            now.select(
                "node",
                F.col("next").alias("up"),
                (F.col("n_leaves") + F.coalesce("l", F.lit(0))).alias("n_leaves"),
                (F.col("saved_tokens") + F.coalesce("s", F.lit(0))).alias("saved_tokens"),
            ),
            "upper",
        )
    return now.drop("up")


def prefix_nodes(
    conversations: DataFrame, *, family: int = FAMILY, crowded: int = CROWDED
) -> DataFrame:
    """One row per node of the trie of all rebuilt conversations.

    Output: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256``. Ids are integers; of a conversation's turns with equal numbers the one
    with the smaller digest comes first.

    - NULL numbers come before all others; NULL roles and texts are empty.
    - Rows without an id take no part. Repeated rows are turns of their own.
    - Other columns are ignored. An empty table gives an empty table, without a root.
    - Texts of any length enter as digests alone.
    - ``crowded`` decides how work is split and never changes the result.
    """
    steps = stored(_steps(rebuilt(conversations, family=family)), "steps")
    # Turns from the node on, for all conversations through it, tell how heavy a subtree is.
    heavy = steps.groupBy("node").agg(
        F.count("*").alias("n_convs"),
        F.min("conv_id").alias("conv_id"),
        F.first("parent").alias("parent"),
        F.first("depth").alias("depth"),
        F.first("words").alias("words"),
        F.sum(F.col("onward") + 1).alias("below"),
    )
    heavy = stored(heavy.filter((F.col("below") > crowded) | (F.col("depth") == 0)), "heavy")
    below, deepest = heavy.agg(F.max(F.when(F.col("depth") == 0, F.col("below"))), F.max("depth")).first()
    marks = heavy.select("node", F.lit(True).alias("upper"))
    marked = steps.join(marks, "node", "left")
    light = marked.filter("upper is null").drop("upper")
    first = F.min_by("node", "depth").over(Window.partitionBy("conv_id"))
    # Subtrees are no heavier than ``crowded``; so many are dealt to a shard on average.
    shards = (below or 0) // crowded + 1
    shard = F.pmod(F.xxhash64(first), F.lit(shards)).alias("shard")
    lower = stored(light.select(shard, *steps.columns).groupBy("shard").applyInArrow(_shard, _NODE), "nodes")

    tops = lower.filter("top").groupBy(F.col("parent").alias("node")).agg(
        F.count("*").alias("n_tops"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s")
    )
    under = heavy.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_under"))
    upper = heavy.join(tops, "node", "left").join(under, "node", "left")
    children = F.coalesce("n_tops", F.lit(0)) + F.coalesce("n_under", F.lit(0))
    upper = upper.withColumn("n_children", children).select(
        *heavy.columns,
        "n_children",
        (F.coalesce("l", F.lit(0)) + (F.col("n_children") == 0).cast("bigint")).alias("n_leaves"),
        (F.coalesce("s", F.lit(0)) + (F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"),
    )
    upper = stored(upper, "upper")
    sums = _summed(upper, deepest or 0)
    ended = _ended(marked.filter("upper and onward = 0").select("node", "conv_id"))
    names = heavy.select(F.col("node").alias("parent"), F.col("conv_id").alias("above"))
    upper = (
        upper.drop("n_leaves", "saved_tokens")
        .join(sums, "node")
        .join(ended, "node", "left")
        .join(names, "parent", "left")
    )
    columns = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    digest = F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256")
    upper = upper.select(*columns, F.col("above").alias("parent_conv_id"), digest)
    inner = lower.filter("not top").select(*columns, "parent_conv_id", "ends_sha256")
    outer = lower.filter("top").drop("parent_conv_id").join(names, "parent", "left")
    outer = outer.select(*columns, F.col("above").alias("parent_conv_id"), "ends_sha256")
    return upper.unionByName(inner).unionByName(outer).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )
