"""N-gram Jaccard join (operator 2): a size-aware heavy-light join of shingle sets.

A document's set holds its distinct five-word shingles as 64-bit hashes. Equal sets
are one node. Nodes link where the Jaccard similarity is 0.75 or more.

Light sets: of two sets with sizes a and b that link, c = ceil(3 (a + b) / 7)
elements are common. Small sets enumerate their subsets of c elements for each size
of a partner; sets of both sizes with one subset in common link for certain, so a
bucket needs no more than a link from each member to one of them.

Heavy sets: inverted lists over each set's rarest elements, as many as a partner cannot
all lack, read in two passes. How frequent a shingle is, is known from one of SAMPLED
sets, so that a shingle of many texts is listed only for sets that have little else. First every set of a list is compared with one set of it,
chosen to be the most typical; what links are found join most of a large group of near
copies at once. Then sets in different components are counted by the lists they share:
two sets that link share a number that follows from their sizes, since only so few of
their elements can differ. Pairs that reach it are compared. For components of many
sets, each set that shares a list with one is compared with all of it, in blocks, where
sizes and bitmaps that bound the common elements from above first rule sets out. So a
list of near copies costs comparisons in proportion to its length, and no pair of a
list in different components is left out. What of a list is longer than LONG is
compared in pairs of blocks, and a set that very many are compared with is copied to
several tasks, so no list and no group is one task's work.

The boundary between light and heavy comes from the histogram of sizes: that with
the least cost of subsets, list entries and comparisons in lists.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import coded, cut, hash64, if_small, map_slices, mix, ship, signed, slices, spans, words
from .components import components

WORDS = 5
#: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Cost of an entry in an inverted list, and of a comparison with another one, in subsets.
LIST_COST = 3.0
COMPARE_COST = 0.05
#: Largest boundary that is tried.
MOST_LIGHT = 16
#: One of so many sets tells how frequent shingles are, and those in LEAST_SAMPLED of these are frequent. The order of elements never decides a result.
SAMPLED = 32
LEAST_SAMPLED = 4
#: Frequent shingles that are broadcast at most (16 bytes each); more are joined.
MOST_FREQUENT = 1_000_000
#: Sets in a block of the second pass; a component of more is compared in blocks.
BLOCK = 192
#: Entries of a list that are paired in one task.
LONG = 500
#: Sets that a task compares with one group's at most, about.
PASSING = 300
_K = np.uint64(0x9FB21C651E98DF25)


def needed(a: int, b: int) -> int:
    """Common elements of two sets of sizes a and b that link."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def prefix_size(n: np.ndarray) -> np.ndarray:
    """Elements of a set of n that cannot all be missing from a partner."""
    return n - -(-PERCENT * n // 100) + 1


def partners(n: int, most: int) -> list[tuple[int, int, int]]:
    """(a, b, c) of each pair of sizes with n in it that can link, up to ``most``."""
    out = []
    for m in range(1, most + 1):
        a, b = min(n, m), max(n, m)
        if needed(a, b) <= a:
            out.append((a, b, needed(a, b)))
    return out


#: From this size on, sets are listed whatever the boundary is.
ALWAYS_LISTED = 2 * MOST_LIGHT


def boundary(sizes: dict[int, tuple[int, int]], length: float = 1.0) -> int:
    """Largest light size, by the cost of subsets of light sets against list entries of the others.

    ``sizes``: number of sets and of their list entries by size, those of ALWAYS_LISTED
    elements or more together; ``length``: the mean length of the list that an entry is in.
    """

    def cost(most: int) -> float:
        light = sum(f * sum(comb(n, c) for _, _, c in partners(n, most)) for n, (f, _) in sizes.items() if 0 < n <= most)
        listed = sum(entries for n, (_, entries) in sizes.items() if n and 100 * n >= PERCENT * (most + 1))
        return light + (LIST_COST + COMPARE_COST * length) * listed

    return min(range(MOST_LIGHT + 1), key=lambda b: (cost(b), b))


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes in order, flat, and n + 1 offsets."""
    flat, off = words(texts, lower=True)
    count = np.diff(off)
    if not len(flat):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    distinct, codes = coded(flat)
    w = hash64(distinct)[codes]
    h = np.zeros(len(w), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(WORDS):
            n = max(len(w) - k, 0)
            h[:n] = h[:n] * _K + w[k:]
        h = mix(h)
    parts = []
    for a, n in zip(off[:-1].tolist(), count.tolist(), strict=True):
        if n >= WORDS:
            parts.append(np.unique(h[a : a + n - WORDS + 1]))
        elif n:
            g = np.uint64(n)
            with np.errstate(over="ignore"):
                for x in w[a : a + n]:
                    g = g * _K + x
            parts.append(mix(np.array([g])))
        else:
            parts.append(np.zeros(0, np.uint64))
    return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def node_of(flat: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A hash of each set."""
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(flat ^ _K), dtype=np.uint64)])
        return signed(mix(sums[off[1:]] - sums[off[:-1]] + np.diff(off).astype(np.uint64) * _K))


def sketch(held: np.ndarray) -> bytes:
    """A bit for each element's hash, in a power of two of bits that is twice the set's size or more."""
    size = max(64, 1 << int(2 * len(held) - 1).bit_length()) if len(held) else 64
    bits = np.zeros(size, np.uint8)
    bits[(held & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def find_nodes(rows: DataFrame) -> DataFrame:
    """(id, node, n, sketch binary, small array<long>, sample array<long>) of each row (id, text).

    ``small``: the set itself, if it has MOST_LIGHT elements or fewer; ``sample``: the
    same for one of SAMPLED sets, chosen by their hash, once for equal sets of a slice.
    """

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        flat, off = shingle_sets(part.column(1))
        node, n = node_of(flat, off), np.diff(off)
        own = np.zeros(len(node), bool)
        own[np.unique(node, return_index=True)[1]] = True
        cols = [part.column(0), pa.array(node), pa.array(n, pa.int32()), pa.array([sketch(flat[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], pa.binary())]
        for chosen in (n <= MOST_LIGHT, own & (node % SAMPLED == 0)):
            at = pa.array(np.concatenate([[0], np.cumsum(np.where(chosen, n, 0))]), pa.int32())
            cols.append(pa.ListArray.from_arrays(at, pa.array(signed(flat[np.repeat(chosen, n)]))))
        return pa.RecordBatch.from_arrays(cols, ["id", "node", "n", "sketch", "small", "sample"])

    return map_slices(rows, "text", run, f"id {rows.schema['id'].dataType.simpleString()}, node long, n int, sketch binary, small array<long>, sample array<long>")


def frequent_shingles(found: DataFrame) -> tuple[DataFrame, float]:
    """Frequent shingles (h, c) with the number of sampled sets that hold them, a stored table; and the mean length of an
    element's list, were all elements listed.
    """
    each = found.filter(F.size("sample") > 0).select(F.explode("sample").alias("h")).groupBy("h").agg(F.count("*").alias("c"))
    frequent = cut(each.filter(F.col("c") >= LEAST_SAMPLED), "frequent")
    total = found.agg(F.sum(F.greatest(F.size("sample"), F.lit(0))).alias("n")).first()["n"] or 0
    often = frequent.agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c") * SAMPLED).alias("pairs")).first()
    return frequent, 1.0 if not total else (total - (often["n"] or 0) + (often["pairs"] or 0)) / total


@cache
def _subsets(n: int, c: int) -> np.ndarray:
    return np.array(list(combinations(range(n), c)), np.int64)


def light_links(found: DataFrame, light: int) -> DataFrame:
    """Links (u, v) among sets of up to ``light`` elements, by equal subsets.

    A bucket of sizes a < b holds for certain only links between both sizes, so it
    counts if it has both. Then all its members link to its smallest node, by one
    step or two.
    """
    sets = found.filter((F.col("n") > 0) & (F.col("n") <= light) & F.col("id").isNotNull()).select("node", "n", "small").dropDuplicates(["node"])

    def run(batches):
        for part in batches:
            node, n = part.column(0).to_numpy(), part.column(1).to_numpy()
            flat, off = part.column(2).flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(n)])
            for size in range(1, light + 1):
                at = np.flatnonzero(n == size)
                if not len(at):
                    continue
                held = mix(flat[off[at][:, None] + np.arange(size)] ^ _K)
                for a, b, c in partners(size, light):
                    with np.errstate(over="ignore"):
                        sub = mix(held[:, _subsets(size, c)].sum(2, dtype=np.uint64) + np.uint64(a << 32 | b << 16 | c) * _K)
                    rows = [signed(sub.ravel()), np.repeat(node[at], sub.shape[1]), np.full(sub.size, size, np.int32), np.full(sub.size, a == b)]
                    yield pa.RecordBatch.from_arrays([pa.array(r) for r in rows], ["key", "node", "n", "one_size"])

    ship(found.sparkSession)
    entries = sets.mapInArrow(run, "key long, node long, n int, one_size boolean")
    held = entries.groupBy("key").agg(F.min("node").alias("v"), F.max("node").alias("w"), F.min("n").alias("a"), F.max("n").alias("b"), F.first("one_size").alias("one_size"))
    held = held.filter((F.col("v") < F.col("w")) & (F.col("one_size") | (F.col("a") < F.col("b")))).select("key", "v")
    return entries.join(held, "key").filter("node <> v").select(F.col("node").alias("u"), "v").distinct()


def list_entries(rows: DataFrame, light: int, frequent: DataFrame) -> DataFrame:
    """Entries (h, node, x) of the inverted lists: each set under its rarest elements, as many as a partner cannot all lack.

    Elements that are not known to be frequent come first, in order of hash; then the
    frequent ones, rarest first. The upper half of ``x`` is the share of frequent
    elements, 0 to 255: how typical the set is; the lower half is its size. Light sets are listed if a heavy one can link to them. Equal sets of a slice
    give entries once. More than MOST_FREQUENT frequent shingles are not broadcast, but
    joined with all elements.
    """
    if frequent.count() > MOST_FREQUENT:
        return _joined_entries(rows, light, frequent)
    table = frequent.toArrow()
    h = table["h"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(h)
    sent = rows.sparkSession.sparkContext.broadcast((h[order], table["c"].to_numpy().astype(np.int32)[order]))

    def run(part: pa.RecordBatch) -> pa.RecordBatch | None:
        common, times = sent.value
        flat, off, node, n, first = _listed(part.column(1), light)
        if len(common):
            at = np.minimum(np.searchsorted(common, flat), len(common) - 1)
            often = np.where(common[at] == flat, times[at], 0)
        else:
            often = np.zeros(len(flat), np.int64)
        sizes, taken, typical = prefix_size(n[first]), [], []
        for k, p in zip(first.tolist(), sizes.tolist(), strict=True):
            h, f = flat[off[k] : off[k + 1]], often[off[k] : off[k + 1]]
            hot = f > 0
            if hot.any():
                h = np.concatenate([h[~hot], h[hot][np.argsort(f[hot], kind="stable")]])
            taken.append(h[:p])
            typical.append(int(255 * hot.mean()))
        if not taken:
            return None
        cols = [signed(np.concatenate(taken)), np.repeat(node[first], sizes), np.repeat(np.array(typical, np.int64) << 32 | n[first], sizes)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["h", "node", "x"])

    return map_slices(rows, "text", run, "h long, node long, x long")


def _listed(texts: pa.Array, light: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Elements and offsets of the sets of texts, their nodes and sizes, and the rows that are to be listed."""
    flat, off = shingle_sets(texts)
    node, n = node_of(flat, off), np.diff(off)
    _, first = np.unique(node, return_index=True)
    return flat, off, node, n, first[(n[first] > 0) & (100 * n[first] >= PERCENT * (light + 1))]


def _joined_entries(rows: DataFrame, light: int, frequent: DataFrame) -> DataFrame:
    """The entries of ``list_entries``, by a join of all elements with the frequent ones and a rank within each set."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch | None:
        flat, off, node, n, first = _listed(part.column(1), light)
        if not len(first):
            return None
        held = spans(off[:-1][first], n[first])
        return pa.RecordBatch.from_arrays([pa.array(signed(flat[held])), pa.array(np.repeat(node[first], n[first])), pa.array(np.repeat(n[first], n[first]), pa.int32())], ["h", "node", "n"])

    each = map_slices(rows, "text", run, "h long, node long, n int").distinct().join(frequent, "h", "left")
    w = Window.partitionBy("node")
    unsigned = F.col("h").bitwiseXOR(F.lit(-(1 << 63)))
    ranked = each.withColumn("place", F.row_number().over(w.orderBy(F.coalesce("c", F.lit(0)), unsigned))).withColumn("often", F.count("c").over(w))
    size = F.col("n") - F.ceil(F.lit(PERCENT) * F.col("n") / F.lit(100)) + 1
    typical = F.floor(F.lit(255) * F.col("often") / F.col("n"))
    return ranked.filter(F.col("place") <= size).select("h", "node", (F.shiftleft(typical.cast("long"), 32) + F.col("n")).alias("x"))


def read_lists(entries: DataFrame, tasks: int) -> DataFrame:
    """Lists of two nodes or more, as rows (h, node, n, first, first_n).

    ``first`` is the list's most typical node. A list of two is one row, with h NULL:
    a pair, if its sizes fit. Longer ones have a row for each node. Lists come sorted
    and are read as a stream, so that a long one needs no memory.
    """

    def tell(h, node, n, head, whole) -> pa.RecordBatch | None:
        """Rows of lists that stand complete in the arrays (``whole``), or go on (then they have many nodes)."""
        size = np.bincount(head, minlength=len(h))[head]
        pair = whole & (size == 2) & (np.arange(len(h)) != head) & (100 * np.minimum(n, n[head]) >= PERCENT * np.maximum(n, n[head]))
        many = (size > 2) | ~whole
        out = np.flatnonzero(pair | many)
        if not len(out):
            return None
        cols = [pa.array(h[out], mask=pair[out]), *(pa.array(c[out]) for c in (node, n.astype(np.int32), node[head], n[head].astype(np.int32)))]
        return pa.RecordBatch.from_arrays(cols, names)

    names = ["h", "node", "n", "first", "first_n"]

    def run(batches):
        held = [np.zeros(0, np.int64)] * 3  # the list that may go on
        opened = None  # the first of a long list that has been told so far
        for batch in _and_end(batches):
            if batch is not None:
                h, node, x = (np.concatenate([a, c.to_numpy(zero_copy_only=False)]) for a, c in zip(held, batch.columns, strict=True))
            else:
                h, node, x = held
            if not len(h):
                continue
            n = x & 0xFFFFFFFF
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            again = ~new
            again[1:] &= node[1:] == node[:-1]  # a set that another task has listed too
            if opened is not None:  # the rest of a long list
                rest = h == opened[0]
                if (more := rest & ~again & (node != opened[1])).any():
                    k = int(more.sum())
                    yield pa.RecordBatch.from_arrays([pa.array(h[more]), pa.array(node[more]), pa.array(n[more].astype(np.int32)), pa.array(np.full(k, opened[1])), pa.array(np.full(k, opened[2], np.int32))], names)
                if rest.all() and batch is not None:
                    held = [h[-1:][:0]] * 3
                    continue
                opened = None
                h, node, n, x, new, again = (c[~rest] for c in (h, node, n, x, new, again))
                if not len(h):
                    held = [h] * 3
                    continue
            h, node, n, x, new = (c[~again] for c in (h, node, n, x, new))
            head = np.flatnonzero(new)[np.cumsum(new) - 1]
            last = int(head[-1]) if batch is not None else len(h)
            if len(h) - last > 1000:  # a long list: told now, its end to come
                opened = (h[last], node[last], n[last])
                whole = np.arange(len(h)) < last
                part, held = tell(h, node, n, head, whole), [h[:0]] * 3
            else:
                part, held = tell(h[:last], node[:last], n[:last], head[:last], np.ones(last, bool)), [h[last:], node[last:], x[last:]]
            if part is not None:
                yield part

    ship(entries.sparkSession)
    ranged = entries.repartition(tasks, "h").sortWithinPartitions("h", F.desc(F.shiftright("x", 32)), "node")
    return ranged.mapInArrow(run, "h long, node long, n int, first long, first_n int")


def _and_end(batches):
    yield from batches
    yield None


class Sieve:
    """Sketches to compare with. A bit that one set has and the other lacks is an element that is not common."""

    def __init__(self):
        self.held: dict[int, tuple[list[bytes], list[int], list[int]]] = {}
        self.stacks: dict[tuple[int, int], np.ndarray] = {}

    def add(self, node: int, n: int, marks: bytes) -> None:
        for column, value in zip(self.held.setdefault(len(marks), ([], [], [])), (marks, node, n), strict=True):
            column.append(value)

    def _stack(self, size: int, folded: int) -> np.ndarray:
        if (size, folded) not in self.stacks:
            whole = np.frombuffer(b"".join(self.held[size][0]), np.uint8).reshape(-1, size // folded, folded)
            self.stacks[size, folded] = np.bitwise_or.reduce(whole, axis=1)
        return self.stacks[size, folded]

    def partners(self, node: int, n: int, marks: bytes) -> list[int]:
        """Nodes that the sketches do not rule out."""
        out: list[int] = []
        own = np.frombuffer(marks, np.uint8)
        for size, (_, nodes, sizes) in self.held.items():
            folded = min(size, len(marks))
            mine = np.bitwise_or.reduce(own.reshape(-1, folded), axis=0)
            theirs = self._stack(size, folded)
            m = np.array(sizes)
            common = np.minimum(m - np.bitwise_count(theirs & ~mine).sum(1, dtype=np.int64), n - np.bitwise_count(mine & ~theirs).sum(1, dtype=np.int64))
            ok = ((100 + PERCENT) * common >= PERCENT * (m + n)) & (np.array(nodes) != node)
            out += [nodes[k] for k in np.flatnonzero(ok)]
        return out


def sieve(groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of groups (g, role, node) with a partner in their group that sizes and sketches do not rule out."""

    def run(batches):
        group, block, told = None, Sieve(), set()
        for batch in batches:
            for part in (batch.slice(a, 1024) for a in range(0, batch.num_rows, 1024)):
                out: tuple[list, ...] = ([], [], [])

                def tell(role: int, node: int, out=out) -> None:
                    for column, value in zip(out, (group, role, node), strict=True):
                        column.append(value)

                for g, role, node, n, marks in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if g != group:
                        group, block, told = g, Sieve(), set()
                    if role == 0:
                        block.add(node, n, marks)
                    elif found := block.partners(node, n, marks):
                        tell(1, node)
                        for v in found:
                            if v not in told:
                                told.add(v)
                                tell(0, v)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64()), strict=True)], ["g", "role", "node"])

    ship(nodes.sparkSession)
    rows = _spread(groups, "groups-to-sieve").join(nodes.select("node", "n", "sketch"), "node").select("g", "role", "node", "n", "sketch")
    tasks = 2 * int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = rows.repartition(tasks, "g").sortWithinPartitions("g", "role", "node").mapInArrow(run, "g long, role int, node long")
    return cut(left, "sieved").join(nodes.select("node", "id"), "node")


def compare(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Links (u, v) between sets of role 1 and of role 0 in the same group: groups (g, role, node, id), rows (id, text).

    A group's sets of role 0 are held in memory, those of role 1 pass by. Groups are
    broadcast to the texts if they are few; if not, both sides are shuffled by id.
    """

    def run(batches):
        group, block = None, Block()
        for batch in batches:
            for part in slices(batch, 3):
                flat, off = shingle_sets(part.column(3))
                found = node_of(flat, off)
                us, vs = [], []
                for k, (g, role, node) in enumerate(zip(*(part.column(c).to_pylist() for c in range(3)), strict=True)):
                    if g != group:
                        group, block = g, Block()
                    if found[k] != node:
                        continue  # an id may have several texts
                    held = flat[off[k] : off[k + 1]]
                    if role == 0:
                        block.add(node, held)
                    else:
                        for v in block.links(node, held):
                            us.append(node)
                            vs.append(v)
                if us:
                    yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    ship(rows.sparkSession)
    texts = rows.join(if_small(_spread(groups, "groups")), "id").select("g", "role", "node", "text")
    tasks = 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return texts.repartition(tasks, "g").sortWithinPartitions("g", "role", "node").mapInArrow(run, "u long, v long")


def _spread(groups: DataFrame, tag: str) -> DataFrame:
    """Groups with a column g, stored, where those with more than PASSING sets of role 1 are split, and have their sets of role 0 in each part."""
    groups = cut(groups, tag)
    sizes = groups.filter("role = 1").groupBy("g").agg(F.count("*").alias("passing")).filter(F.col("passing") > PASSING)
    sizes = cut(sizes.select("g", F.ceil(F.col("passing") / F.lit(PASSING)).alias("parts")), tag + "-sizes")
    if sizes.isEmpty():
        return groups
    split = groups.join(if_small(sizes), "g", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.array(F.pmod(F.xxhash64("node"), F.col("parts")))
    split = split.withColumn("part", F.explode(F.when(F.col("role") == 1, own).otherwise(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))))
    return split.withColumn("g", F.when(F.col("parts") > 1, F.xxhash64("g", "part")).otherwise(F.col("g"))).drop("parts", "part")


class Block:
    """Sets to compare with: their elements in order, with the set that each is from."""

    def __init__(self):
        self.nodes: list[int] = []
        self.sets: list[np.ndarray] = []
        self.sorted: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None = None

    def add(self, node: int, held: np.ndarray) -> None:
        if not self.nodes or self.nodes[-1] != node:
            self.nodes.append(node)
            self.sets.append(held)

    def links(self, node: int, held: np.ndarray) -> list[int]:
        if not self.nodes:
            return []
        if self.sorted is None:
            n = np.array([len(s) for s in self.sets])
            flat = np.concatenate(self.sets)
            order = np.argsort(flat, kind="stable")
            self.sorted = flat[order], np.repeat(np.arange(len(n)), n)[order], n, np.array(self.nodes)
        flat, owner, n, nodes = self.sorted
        a, b = np.searchsorted(flat, held, "left"), np.searchsorted(flat, held, "right")
        hit = b > a
        common = np.bincount(owner[spans(a[hit], (b - a)[hit])], minlength=len(n))
        link = (100 * common >= PERCENT * (n + len(held) - common)) & (nodes != node)
        return nodes[link].tolist()


def _shared(a: Column, b: Column) -> Column:
    """Lists that two sets of sizes a and b that link have in common at least.

    The common elements are ``needed``; all but so many of each set's are listed.
    """
    top = F.greatest(a, b)
    need = F.ceil(F.lit(PERCENT) * (a + b) / F.lit(100 + PERCENT))
    return need - F.ceil(F.lit(PERCENT) * top / F.lit(100)) + 1


def _sizes_fit(a: Column, b: Column) -> Column:
    return F.lit(100) * F.least(a, b) >= F.lit(PERCENT) * F.greatest(a, b)


def _groups(pairs: DataFrame) -> DataFrame:
    """Groups to compare each pair (u, v): a group for each v."""
    one = pairs.select(F.col("v").alias("g"), F.lit(1).alias("role"), F.col("u").alias("node"))
    return pairs.select(F.col("v").alias("g"), F.lit(0).alias("role"), F.col("v").alias("node")).distinct().unionByName(one)


def first_pairs(lists: DataFrame) -> DataFrame:
    """A pair (u, v) for each set: of its lists' most typical sets, that with which it shares the most lists.

    Only pairs with half the lists or more that linked sets must share are kept; the
    second pass does not rely on any of them.
    """
    a, b = F.col("n"), F.col("first_n")
    met = lists.filter((F.col("node") != F.col("first")) & _sizes_fit(a, b))
    pairs = met.groupBy(F.col("node").alias("u"), F.col("first").alias("v"), "n", "first_n").agg(F.count("*").alias("k"))
    return pairs.filter(2 * F.col("k") >= _shared(a, b)).groupBy("u").agg(F.max_by("v", F.struct("k", "v")).alias("v"))


def _second_pass(lists: DataFrame, comps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is left to compare: pairs (u, v) of sets in different components that share as many lists as linked sets
    must; and, for components of more than BLOCK sets, groups of each set that shares a list, with blocks of the component.
    """
    sizes = comps.groupBy("component").agg(F.count("*").alias("k"))
    placed = if_small(cut(comps.join(sizes, "component").select("node", "component", "k"), "placed"))
    place = lambda rows, node, c, k: rows.join(placed.select(F.col("node").alias(node), F.col("component").alias("p"), F.col("k").alias("q")), node, "left").withColumn(c, F.coalesce("p", F.col(node))).withColumn(k, F.coalesce("q", F.lit(1))).drop("p", "q")
    joined = place(lists.filter("h IS NOT NULL").select("h", "node", "n"), "node", "c", "k")
    joined = cut(joined, "placed-lists")
    mixed = joined.groupBy("h").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count(F.when(F.col("k") <= BLOCK, 1)).alias("members")).filter("c0 < c1")
    mixed = cut(mixed.select("h", F.greatest(F.ceil(F.col("members") / F.lit(LONG)), F.lit(1)).alias("parts")), "mixed-lists")
    rest = cut(joined.join(if_small(mixed), "h"), "rest")
    small = rest.filter(F.col("k") <= BLOCK).withColumn("i", F.pmod(F.xxhash64("node"), F.col("parts")))
    small = small.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).withColumn("i0", F.least("i", "j")).withColumn("i1", F.greatest("i", "j"))
    a, b = small.alias("a"), small.alias("b")
    n, m = F.col("a.n"), F.col("b.n")
    same = (F.col("a.h") == F.col("b.h")) & (F.col("a.i0") == F.col("b.i0")) & (F.col("a.i1") == F.col("b.i1")) & ((F.col("a.i0") == F.col("a.i1")) | (F.col("a.i") != F.col("b.i")))
    met = a.join(b, same & (F.col("a.node") < F.col("b.node")) & (F.col("a.c") != F.col("b.c")) & _sizes_fit(n, m))
    met = met.select(F.col("a.node").alias("u"), F.col("b.node").alias("v"), n.alias("n"), m.alias("m"))
    low, other = F.col("node") < F.col("first"), F.col("node") > F.col("first")
    twos = lists.filter("h IS NULL").select(F.least("node", "first").alias("u"), F.greatest("node", "first").alias("v"), F.when(low, F.col("n")).otherwise(F.col("first_n")).alias("n"), F.when(other, F.col("n")).otherwise(F.col("first_n")).alias("m"))
    pairs = met.unionByName(twos).groupBy("u", "v", "n", "m").agg(F.count("*").alias("shared"))
    pairs = cut(pairs.filter(F.col("shared") >= _shared(F.col("n"), F.col("m"))).select("u", "v"), "pairs")
    pairs = place(place(pairs, "u", "cu", "ku"), "v", "cv", "kv").filter("cu <> cv").select("u", "v")
    # components in blocks
    large = rest.filter(F.col("k") > BLOCK).select("h", F.col("c").alias("main"), F.col("k").alias("size")).distinct()
    other = (F.col("c") != F.col("main")) & (F.struct("k", "c") < F.struct("size", "main"))
    near = rest.join(large, "h").filter(other).select("node", "main").distinct()
    both = place(place(lists.filter("h IS NULL").select("node", "first"), "node", "c", "k"), "first", "d", "l").filter((F.col("c") != F.col("d")) & (F.greatest("k", "l") > BLOCK))
    first_is_main = F.struct("k", "c") < F.struct(F.col("l").alias("k"), F.col("d").alias("c"))
    both = both.select(F.when(first_is_main, F.col("node")).otherwise(F.col("first")).alias("node"), F.when(first_is_main, F.col("d")).otherwise(F.col("c")).alias("main"))
    near = cut(near.unionByName(both).distinct(), "near")
    held = near.select("main").distinct().join(comps.select("node", F.col("component").alias("main")), "main")
    blocks = held.groupBy("main").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("blocks"))
    zero = held.join(blocks, "main").select(F.xxhash64("main", F.pmod(F.xxhash64("node"), F.col("blocks"))).alias("g"), F.lit(0).alias("role"), "node")
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    one = near.join(blocks, "main").select("main", "node", each.alias("b")).select(F.xxhash64("main", "b").alias("g"), F.lit(1).alias("role"), "node")
    return pairs, zero.unionByName(one)


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component): groups of documents that links of similarity 0.75 or more join, a row for each input row.

    ``component`` is the smallest id of the group. A text without words has an empty
    set and is alone, as is a NULL text. A row with NULL id is linked with nothing
    and has component NULL. Rows with equal texts are in one group, as are rows that
    share an id and a text. An empty table gives an empty one. Other columns are left out.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    found = cut(find_nodes(rows), "sets")
    nodes = found.filter("n > 0 AND id IS NOT NULL").groupBy("node", "n").agg(F.min(F.struct("id", "sketch")).alias("z"))
    nodes = cut(nodes.select("node", "n", "z.id", "z.sketch"), "nodes")
    listed = F.col("n") - F.ceil(F.lit(PERCENT) * F.col("n") / F.lit(100)) + 1
    sizes = {r["size"]: (r["f"], r["entries"]) for r in nodes.groupBy(F.least("n", F.lit(ALWAYS_LISTED)).alias("size")).agg(F.count("*").alias("f"), F.sum(listed).alias("entries")).collect()}
    frequent, length = frequent_shingles(found)
    light = boundary(sizes, length)
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), sum(e for _, e in sizes.values()) // 1_500_000)
    some = rows.filter("id IS NOT NULL")
    lists = cut(read_lists(list_entries(some, light, frequent), tasks), "lists")
    ids = nodes.select("node", "id")
    links = light_links(found, light).unionByName(compare(some, _groups(cut(first_pairs(lists), "pairs")).join(ids, "node")))
    comps = cut(components(links), "components")
    pairs, blocks = _second_pass(lists, comps)
    groups = _groups(pairs).join(ids, "node").unionByName(sieve(blocks, nodes).select("g", "role", "node", "id"))
    more = compare(some, groups.select("g", "role", "node", "id"))
    known = comps.select(F.col("node").alias("u"), F.col("component").alias("v"))
    comps = components(known.unionByName(more))
    placed = ids.join(comps, "node", "left").select("node", "id", F.coalesce("component", "node").alias("c"))
    least = cut(placed.groupBy("c").agg(F.min("id").alias("least")), "least")  # so that a large group's rows can be split
    named = cut(placed.join(least, "c").select("node", "least"), "named")
    out = found.select("id", "node", "n").join(named, "node", "left")
    alone = (F.col("n") == 0) | F.col("id").isNull()
    return out.select("id", F.col("n").cast("long").alias("n_shingles"), F.when(alone, F.col("id")).otherwise(F.col("least")).alias("component"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay if one of each group does, with all their columns.

    That with the group's smallest id stays. Of rows that repeat its id and text one
    stays; rows with the same id and other texts stay if their own group has that id
    as its smallest. Rows with NULL id or without words stay all.
    """
    got = cut(similar_groups(docs, id_col, text_col), "groups")
    mark = "_" + "_".join(docs.columns)
    keep = got.filter("id = component AND n_shingles > 0").select(F.col("id").alias(mark)).distinct()
    loose = F.col(id_col).isNull() | ~F.coalesce(text_col, F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    held = docs.filter(~loose).join(keep, F.col(id_col) == F.col(mark), "left_semi")
    if not got.filter("id IS NOT NULL").groupBy("id").count().filter("count > 1").isEmpty():
        held = held.dropDuplicates([id_col, text_col])
    return held.unionByName(docs.filter(loose))
