"""N-gram Jaccard join with signature trees.

A text's set is its distinct ``k``-word shingles. Two texts link when the intersection is
at least ``sim`` percent of the union. The result is exact but for 64-bit hashes.

1. All shingles of all texts are counted once, packed (``heads``). A set whose own
   shingles, which no other text has, are more than it may have apart from a similar one
   links with nothing, and that is most of the sets of a corpus. Texts with the same set
   are one class. Only the sets of the classes that are left are written.
2. Which of these can meet at all: shingles are ordered from rare to frequent (a count
   sketch of fixed size over these sets), and two sets that link share one of the first
   n - ceil(sim n) + 1 of each. Sets that share such a shingle form a bundle; bundles of
   the same members are one. A passage that very many texts share stands last in the
   order and makes no bundle.
3. Inside a bundle, a signature tree: leaves hold a bitmap of their shingles and their
   size, inner nodes the OR of bitmaps, the range of sizes and the most shingles that
   found no free bit. The tree is joined with itself from the root; a pair of nodes is cut
   when the common bits plus those shingles can't reach the overlap that its sizes need,
   or when its sizes are too far apart. Only members of pairs of leaves that stay get their
   sets, and are verified on these, unless they are connected already.
4. Three rounds keep this small and whole: each set in its largest bundle; then one set
   of each component in every bundle; then all members of the bundles that still hold
   more than one component. Bundles above ``CHUNK`` members are dealt into chunks, in the
   last round into all pairs of chunks, so no task holds an unbounded group.

Only edges that join two components are written (fewer than there are rows). What a scan
of a written table tells again (ids, a filter, few distinct edges) is not written, and short
rows are written in few files: each file costs a process of an executor where the shared
folder is a local one.

Defined results: A-Z are lower-cased; a text of fewer than ``k`` words is one shingle; no
words or a null text: empty set, linked with nothing; ids may be of any type that has an
order; a null id gets no links and a null component; repeated rows are in one component,
rows of one id with different texts each in that of their text; an empty table gives an empty result;
other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirestream.llm.blocks import dealt, lanes_for, lean, packed, spread, unpacked
from quirestream.llm.graph import components
from quirestream.llm.staging import few, parts, small_batches, stage
from quirestream.llm.tokens import SPACED, U, grams, mix64, words

K, SIM = 5, 80
#: Counters of the frequency sketch; members of a bundle that one task joins; ids that are broadcast at most.
SKETCH, CHUNK, SEND = 1 << 22, 2048, 1_000_000
#: Shingles and rows of one block at most, unless one row has more.
BLOCK, ROWS = 1 << 20, 1 << 16
FANOUT = 8


def shingle_sets(column: pa.Array, k: int = K) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    for w in words(column, SPACED):
        g = grams(w.hashes, k)
        for lo, hi in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True):
            if hi - lo >= k:
                yield np.unique(g[lo : hi - k + 1])
            elif hi > lo:
                yield grams(w.hashes[lo:hi], hi - lo)
            else:
                yield np.zeros(0, U)


def _key(s: np.ndarray) -> int:
    """The name of a set, from its shingles."""
    return int(mix64(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U))


def _long(x: list[int]) -> pa.Array:
    return pa.array(np.array(x, U).view(np.int64))


def set_table(docs: DataFrame, text_col: str, k: int) -> DataFrame:
    """id (the set's name), n and the set itself, of each row that has one."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [s for s in shingle_sets(b.column(0), k) if len(s)]
            for i in range(0, len(sets), 1000):
                some = sets[i : i + 1000]
                yield pa.RecordBatch.from_arrays([_long([_key(s) for s in some]), pa.array([len(s) for s in some], pa.int64()), pa.array([s.tobytes() for s in some], pa.binary())], ["id", "n", "grams"])

    return docs.select(F.col(text_col).alias("t")).mapInArrow(run, "id long, n long, grams binary")


def heads(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """id, n, key (the set's name, null without shingles) and lonely: how many of the
    shingles surely occur in no other row.

    The shingles of a block of rows go out packed, by lanes of their hash, cut to the bits
    that tell the shingles of this input apart; a lane sees all rows of a shingle and
    answers with counts for the rows of each block."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    size = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    lanes = lanes_for(size // 6, parts(spark))
    short = U(max(0, 64 - max(32, size.bit_length() + 5)))
    lists = f"id array<{kind}>, n array<long>, key array<long>"
    names = ["block", "lane", "kind", "k", "c", "id", "n", "key"]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId() << 32, 0
        ids: list[pa.Array] = []
        held: list[np.ndarray] = []
        total = 0

        def send() -> pa.RecordBatch:
            nonlocal seen
            block, seen = part + seen, seen + 1
            n = np.array([len(s) for s in held])
            keys = _long([_key(s) for s in held])
            every = np.concatenate(held)
            held.clear()
            order = np.argsort(every, kind="stable")
            every = every[order]
            row = np.repeat(np.arange(len(n), dtype=np.uint32), n)[order]
            del order
            out = [(lane, packed(every[at] >> short, True), packed(row[at])) for lane, at in dealt(spread(every, lanes))]
            m = len(out)
            cols = [pa.array([block] * (m + 1)), pa.array([x[0] for x in out] + [block % lanes]), pa.array([0] * m + [5], pa.int32()), *(pa.array([x[i] for x in out] + [None], pa.binary()) for i in (1, 2))]
            own = [pa.concat_arrays(ids), pa.array(n.astype(np.int64)), pa.array(keys.to_numpy(), mask=n == 0)]
            return pa.RecordBatch.from_arrays([*cols, *(pa.ListArray.from_arrays(pa.array([0] * (m + 1) + [len(n)], pa.int32()), x) for x in own)], names)

        for b in batches:
            at = 0
            for i, s in enumerate(shingle_sets(b.column(1), k)):
                held.append(s)
                total += len(s)
                if total >= BLOCK or len(held) >= ROWS:
                    ids.append(b.column(0).slice(at, i + 1 - at))
                    at = i + 1
                    yield send()
                    ids, total = [], 0
            if at < b.num_rows:
                ids.append(b.column(0).slice(at))
        if held:
            yield send()

    @lean
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane, got = None, []

        def solve() -> pa.RecordBatch:
            sizes = [len(x) for _, x, _ in got]
            every = np.concatenate([x for _, x, _ in got])
            order = np.argsort(every, kind="stable")
            in_order = every[order]
            same = np.concatenate([[False], in_order[1:] == in_order[:-1], [False]])
            alone = np.zeros(len(every), bool)
            alone[order] = ~(same[1:] | same[:-1])
            out = []
            for (block, _, row), mark in zip(got, np.split(alone, np.cumsum(sizes)[:-1]), strict=True):
                count = np.bincount(row[mark].astype(np.int64))
                who = np.flatnonzero(count)
                out.append((block, packed(who, True), packed(count[who])))
            none = [pa.nulls(len(out), t) for t in types]
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out]), pa.array([lane] * len(out)), pa.array([4] * len(out), pa.int32()), *(pa.array([x[i] for x in out], pa.binary()) for i in (1, 2)), *none], names)

        for b in batches:
            types = [c.type for c in b.columns[5:]]
            own = np.flatnonzero(b.column(2).to_numpy() == 5)
            if len(own):
                yield b.take(pa.array(own))
            for block, at, what, x, row in zip(*(c.to_pylist() for c in b.columns[:5]), strict=True):
                if at != lane:
                    if got:
                        yield solve()
                    lane, got = at, []
                if what == 0:
                    got.append((block, unpacked(x, True), unpacked(row).astype(np.uint32)))
        if got:
            yield solve()

    @lean
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a block's own row comes before its counts
        block = own = None

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(c.flatten() for c in own), pa.array(lonely)], ["id", "n", "key", "lonely"])

        for b in batches:
            for i, (name, what, who, count) in enumerate(zip(*(b.column(c).to_pylist() for c in (0, 2, 3, 4)), strict=True)):
                if what == 5:
                    if own is not None:
                        yield rows()
                    block, own = name, [c.slice(i, 1) for c in b.columns[5:]]
                    lonely = np.zeros(len(own[1].flatten()), np.int64)
                elif name == block:
                    lonely[unpacked(who, True).astype(np.int64)] += unpacked(count).astype(np.int64)
        if own is not None:
            yield rows()

    schema = f"block long, lane long, kind int, k binary, c binary, {lists}"
    sent = docs.select(F.col(id_col), F.col(text_col).alias("t")).mapInArrow(run, schema)
    answers = sent.repartition(lanes, "lane").sortWithinPartitions("lane", "block").mapInArrow(answer, schema)
    by_block = answers.repartition(parts(spark), "block").sortWithinPartitions("block", F.desc("kind"))
    return by_block.mapInArrow(gather, f"id {kind}, n long, key long, lonely long")


def _views(column: pa.Array) -> list[np.ndarray]:
    """uint64 arrays over a binary column, without copies."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, off, data = column.buffers()
    if len(column) == 0 or data is None:
        return [np.zeros(0, U)] * len(column)
    at = np.frombuffer(off, np.int32, column.offset + len(column) + 1)[column.offset :].tolist()
    raw = memoryview(data)
    return [np.frombuffer(raw[a:b], U) for a, b in zip(at[:-1], at[1:], strict=True)]


def frequency_sketch(sets: DataFrame) -> np.ndarray:
    """How many texts have each shingle, by shingle modulo ``SKETCH``; the same few MB for any input."""
    blocks = 16

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int32)
        for b in batches:
            for s in _views(b.column(0)):
                np.add.at(total, (s & U(SKETCH - 1)).astype(np.int64), 1)
        # a byte a counter: few are above 255 in one task, and what is so frequent is told from noise anyway
        for i, part in enumerate(np.split(np.minimum(total, 255).astype(np.uint8), blocks)):
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([part.tobytes()], pa.binary())], ["block", "part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for b in batches:
            for i, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found[i] = found.get(i, 0) + np.frombuffer(p, np.uint8).astype(np.uint32)
        for i, p in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([p.tobytes()], pa.binary())], ["block", "part"])

    sums = sets.select("grams").mapInArrow(count, "block long, part binary").repartition(blocks, "block").mapInArrow(add, "block long, part binary")
    out = np.zeros(SKETCH, np.uint32)
    for r in sums.collect():  # SKETCH counters of four bytes in all
        out[r.block * (SKETCH // blocks) : (r.block + 1) * (SKETCH // blocks)] += np.frombuffer(r.part, np.uint32)
    return out


def levels(sketch: np.ndarray) -> np.ndarray:
    """The counts as an order from rare to frequent. Any order that is the same for all
    texts gives the same links; the rarer what comes first, the fewer bundles."""
    return np.minimum(sketch, 65535).astype(np.uint16)


def prefix_length(n: int, sim: int) -> int:
    return n - -(-sim * n // 100) + 1


def needed(total: np.ndarray | int, sim: int) -> np.ndarray | int:
    """Least intersection of two linked sets whose sizes sum to ``total``."""
    return -(-sim * total // (100 + sim))


def _prefixes(sets: DataFrame, level, sim: int) -> DataFrame:
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lv = level.value
        for b in batches:
            ids = b.column(0).to_numpy()
            token, at = [], []
            for s in _views(b.column(1)):
                p = prefix_length(len(s), sim)
                order = lv[(s & U(SKETCH - 1)).astype(np.int64)]
                token.append(s[np.argsort(order, kind="stable")[:p]])
                at.append(p)
            if token:
                n = np.repeat(np.array(at), at)  # prefix lengths stand for sizes
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(token).view(np.int64)), pa.array(np.repeat(ids, at)), pa.array(n.astype(np.int32))], ["token", "id", "p"])

    return sets.select("id", "grams").mapInArrow(run, "token long, id long, p int")


def _runs(batches: Iterator[pa.RecordBatch], least: int = 200_000) -> Iterator[list[np.ndarray]]:
    """Columns of a stream that is sorted by its first column, cut between its values."""
    held: list[list[np.ndarray]] = []
    rows = 0
    for b in batches:
        held.append([c.to_numpy() for c in b.columns])
        rows += b.num_rows
        if rows >= least:
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            cut = int(np.searchsorted(cols[0], cols[0][-1]))
            if cut:
                yield [c[:cut] for c in cols]
            held, rows = [[c[cut:] for c in cols]], len(cols[0]) - cut
    if rows:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _name(ids: np.ndarray) -> int:
    """A bundle's name, from its members."""
    name = (int(mix64(ids.astype(U)).sum(dtype=U)) + len(ids) * 0x9E3779B97F4A7C15) % (1 << 64)
    return name - (1 << 64) if name >> 63 else name


def bundles(prefixes: DataFrame, sim: int) -> DataFrame:
    """bundle and id: the sets that share a shingle of their prefixes; same members, one bundle."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for token, ids, p in _runs(batches):
            edge = np.flatnonzero(np.diff(token)) + 1
            lo, hi = np.concatenate([[0], edge]), np.concatenate([edge, [len(token)]])
            many = hi - lo > 1
            out_b, out_i = [], []
            for a, z in zip(lo[many].tolist(), hi[many].tolist(), strict=True):
                who, first = np.unique(ids[a:z], return_index=True)
                if len(who) < 2:
                    continue
                size = p[a:z][first]
                # prefixes grow with sets: where they are too far apart, so are the sets
                by = np.sort(size)
                if not (by[:-1] + 2 >= by[1:] * (sim / 100) - 2).any():
                    continue
                name = _name(who)
                if name not in seen:
                    seen.add(name)
                    out_b.append(np.full(len(who), name))
                    out_i.append(who)
            if out_b:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_b)), pa.array(np.concatenate(out_i))], ["bundle", "id"])

    spread = prefixes.repartition(parts(prefixes.sparkSession), "token").sortWithinPartitions("token")
    return spread.mapInArrow(run, "bundle long, id long").distinct()


class Forest:
    def __init__(self, labels: np.ndarray) -> None:
        _, self.up = np.unique(labels, return_inverse=True)

    def join(self, a: int, b: int) -> bool:
        x, y = self.up[a], self.up[b]
        if x == y:
            return False
        self.up[self.up == y] = x
        return True


def _linked(a: np.ndarray, b: np.ndarray, sim: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < sim * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    same = int((b[at] == a).sum())
    return 100 * same >= sim * (len(a) + len(b) - same)


def _buckets(n: int) -> int:
    """Buckets of the bitmap of a set: a power of two, half its size at least."""
    return max(16, 1 << (max(n, 1) // 2).bit_length())


def loads(s: np.ndarray, buckets: int) -> np.ndarray:
    """Shingles in each bucket (15 at most)."""
    return np.minimum(np.bincount((s & U(buckets - 1)).astype(np.int64), minlength=buckets), 15).astype(np.uint8)


def nibbles(load: np.ndarray) -> bytes:
    """Two buckets a byte: the short form of a bitmap, as it is shuffled."""
    return (load[::2] | load[1::2] << 4).tobytes()


def from_nibbles(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    return np.stack([raw & 15, raw >> 4], axis=1).reshape(-1)


_UNARY = np.array([(1 << min(c, 8)) - 1 for c in range(16)], np.uint8)


def bitmap(load: np.ndarray) -> np.ndarray:
    """A shingle sets the next free one of its bucket's 8 bits. So the bits that two sets
    have in common number the least of their loads, and OR is the largest load."""
    return _UNARY[load].view(U)


def tree_pairs(leaf: np.ndarray, size: np.ndarray, sim: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of members (rows of ``leaf``, their bitmaps) that the signature tree joined
    with itself can't rule out."""
    order = np.lexsort((leaf[:, 0], size))
    bm, small = leaf[order], size[order]
    spare = small - np.bitwise_count(bm).sum(axis=1, dtype=np.int64)
    # levels of (bitmap, least size, largest size, most collisions), leaves first
    tree = [(bm, small, small, spare)]
    while len(tree[-1][0]) > 1:
        bm, lo, hi, e = tree[-1]
        at = np.arange(0, len(bm), FANOUT)
        tree.append((np.bitwise_or.reduceat(bm, at, axis=0), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(e, at)))
    x, y = np.zeros(1, np.int64), np.zeros(1, np.int64)
    step = np.arange(FANOUT)
    for depth in range(len(tree) - 1, -1, -1):
        bm, lo, hi, e = tree[depth]
        keep = [np.zeros((2, 0), np.int64)]
        some = max(16, (1 << 18) // bm.shape[1])  # two MB of bitmaps at once
        for c in range(0, len(x), some):
            i, j = x[c : c + some], y[c : c + some]
            ok = 100 * hi[i] >= sim * lo[j]  # rows are ordered by size: i is the smaller side
            i, j = i[ok], j[ok]
            common = np.bitwise_count(bm[i] & bm[j]).sum(axis=1, dtype=np.int64) + np.minimum(e[i], e[j])
            ok = np.minimum(common, np.minimum(hi[i], hi[j])) >= needed(lo[i] + lo[j], sim)
            keep.append(np.stack([i[ok], j[ok]]))
        x, y = np.concatenate(keep, axis=1)
        if depth:
            count = len(tree[depth - 1][0])
            cx, cy = np.broadcast_arrays(x[:, None, None] * FANOUT + step[None, :, None], y[:, None, None] * FANOUT + step[None, None, :])
            ok = (cx <= cy) & (cx < count) & (cy < count)
            if depth == 1:
                ok &= cx < cy
            x, y = cx[ok], cy[ok]
    return order[x], order[y]


def tree_links(sets: list[np.ndarray], labels: np.ndarray, sim: int = SIM, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join two components of the members ``sets`` (labels: components so far).
    With ``side``, only pairs of different sides count."""
    forest = Forest(labels)
    found: list[tuple[int, int]] = []
    if len(np.unique(forest.up)) < 2:
        return found
    if len(sets) == 2:
        return [(0, 1)] if (side is None or side[0] != side[1]) and _linked(sets[0], sets[1], sim) else found
    size = np.array([len(s) for s in sets], np.int64)
    buckets = _buckets(int(size.max()))
    a, b = tree_pairs(np.stack([bitmap(loads(s, buckets)) for s in sets]), size, sim)
    if side is not None:
        ok = side[a] != side[b]
        a, b = a[ok], b[ok]
    batch = 256
    while len(a):
        for i, j in zip(a[:batch].tolist(), b[:batch].tolist(), strict=True):
            if forest.up[i] != forest.up[j] and _linked(sets[i], sets[j], sim):
                forest.join(i, j)
                found.append((i, j))
        a, b = a[batch:], b[batch:]
        ok = forest.up[a] != forest.up[b]
        a, b = a[ok], b[ok]
    return found


def _fold(load: np.ndarray, buckets: int) -> np.ndarray:
    return np.minimum(load.reshape(-1, buckets).sum(axis=0, dtype=np.int64), 15).astype(np.uint8) if len(load) > buckets else load


def possible(sizes: np.ndarray, maps: list[np.ndarray], labels: np.ndarray, sim: int, side: np.ndarray | None = None) -> np.ndarray:
    """Which members of a bundle have a possible partner of another label. Linked sizes
    are so near that their bitmaps are equally long, or one is twice the other's and folds."""
    out = np.zeros(len(sizes), bool)
    length = np.array([len(m) for m in maps])
    for n in np.unique(length).tolist():
        who = np.flatnonzero((length == n) | (length == 2 * n))
        if len(who) < 2:
            continue
        a, b = tree_pairs(np.stack([bitmap(_fold(maps[i], n)) for i in who]), sizes[who], sim)
        a, b = who[a], who[b]
        ok = labels[a] != labels[b]
        if side is not None:
            ok &= side[a] != side[b]
        out[a[ok]] = True
        out[b[ok]] = True
    return out


def signatures(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """id, n and the short form of the bitmap of the sets in ``ids``."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            maps = [nibbles(loads(s, _buckets(len(s)))) for s in _views(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(maps, pa.binary())], ["id", "n", "bits"])

    return _only(sets, ids).mapInArrow(run, "id long, n long, bits binary").dropDuplicates(["id"])


def _sent(ids: DataFrame) -> DataFrame:
    """``ids``, to be sent to all tasks if they are ``SEND`` at most."""
    return F.broadcast(ids) if ids.count() <= SEND else ids


def _only(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is in ``ids``."""
    return sets.join(_sent(ids), "id", "left_semi")


def _by_bundle(rows: DataFrame, solve, schema: str) -> DataFrame:
    """``solve(columns)`` for each bundle; it returns rows. The first column is the bundle."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, []
        out: list[tuple] = []
        names = [x.split()[0] for x in schema.split(", ")]
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[0] != name:
                    if len(held) > 1:
                        out += solve(*map(list, zip(*held, strict=True)))
                    name, held = row[0], []
                held.append(row)
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names)
                out = []
        if len(held) > 1:
            out += solve(*map(list, zip(*held, strict=True)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names)

    return rows.repartition(parts(rows.sparkSession), "bundle").sortWithinPartitions("bundle").mapInArrow(run, schema)


def _links(rows: DataFrame, sets: DataFrame, signs: DataFrame, sim: int) -> DataFrame:
    """Edges a, b among the rows bundle, id, label, side (sides differ or are all 0). Bitmaps
    go to the bundles first; sets only follow for members with a possible partner."""

    def cut(bundle: list, ids: list, labels: list, sides: list, n: list, bits: list) -> list[tuple]:
        side = np.array(sides) if len(set(sides)) > 1 else None
        ok = possible(np.array(n), [from_nibbles(x) for x in bits], np.array(labels), sim, side)
        left = np.flatnonzero(ok).tolist()
        # what is left of several bundles is often the same: it is then one bundle
        name = _name(np.sort(np.array([ids[i] for i in left], np.int64))) if left else 0
        return [(name, ids[i], labels[i], sides[i]) for i in left]

    def solve(bundle: list, ids: list, labels: list, sides: list, data: list) -> list[tuple]:
        side = np.array(sides) if len(set(sides)) > 1 else None
        return [(ids[i], ids[j]) for i, j in tree_links([np.frombuffer(d, U) for d in data], np.array(labels), sim, side)]

    left = _by_bundle(rows.join(signs, "id").select("bundle", "id", "label", "side", "n", "bits"), cut, "bundle long, id long, label long, side long")
    left = stage(few(left.distinct()), "possible")
    wanted = _only(sets.select("id", "grams"), left.select("id").distinct()).dropDuplicates(["id"])
    return _by_bundle(left.join(wanted, "id").select("bundle", "id", "label", "side", "grams"), solve, "a long, b long")


def _chunked(rows: DataFrame, all_pairs: bool) -> DataFrame:
    """Bundles of more than ``CHUNK`` members in chunks; with ``all_pairs`` every two of them meet."""
    sizes = rows.groupBy("bundle").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks"))
    dealt = rows.join(sizes, "bundle").withColumn("g", F.pmod(F.xxhash64("id"), F.col("chunks")))
    if not all_pairs:
        return dealt.select(F.xxhash64("bundle", "g").alias("bundle"), "id", "label", F.lit(0).alias("side"))
    dealt = dealt.withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    pair = F.xxhash64("bundle", F.least("g", "x"), F.greatest("g", "x"))
    return dealt.select(F.when(F.col("chunks") == 1, F.col("bundle")).otherwise(pair).alias("bundle"), "id", "label", F.when(F.col("chunks") == 1, 0).otherwise(F.col("g")).cast("int").alias("side"))


def _labelled(rows: DataFrame, edges: DataFrame | None) -> DataFrame:
    """Rows of the bundles that hold more than one component, with labels."""
    rows = rows.select("bundle", "id")
    if edges is None:
        return rows.withColumn("label", F.col("id"))
    labels = stage(components(edges), "labels")
    rows = rows.join(labels, "id", "left").select("bundle", "id", F.coalesce("component", "id").alias("label"))
    mixed = rows.groupBy("bundle").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("bundle")
    return rows.join(mixed, "bundle", "left_semi")


def similar_sets(sets: DataFrame, sim: int = SIM) -> DataFrame:
    """Edges a, b between ids of sets that link: enough of them for the components."""
    spark = sets.sparkSession
    level = spark.sparkContext.broadcast(levels(frequency_sketch(sets)))
    rows = stage(few(bundles(_prefixes(sets, level, sim), sim)), "bundles")
    signs = stage(few(signatures(sets, rows.select("id").distinct())), "signatures")
    sized = rows.groupBy("bundle").agg(F.count(F.lit(1)).alias("c"))
    largest = rows.join(sized, "bundle").groupBy("id").agg(F.max(F.struct("c", "bundle")).alias("m")).select("m.bundle", "id")
    edges = stage(few(_links(_chunked(_labelled(largest, None), False), sets, signs, sim)), "links1")
    left = stage(few(_labelled(rows, edges)), "mixed")
    if not left.isEmpty():
        one = left.groupBy("bundle", "label").agg(F.min("id").alias("id"))
        more = stage(few(_links(_chunked(one, False), sets, signs, sim)), "links2")
        edges = edges.unionByName(more)
        left = stage(few(_labelled(left, edges)), "mixed")
    if not left.isEmpty():
        more = stage(few(_links(_chunked(left, True), sets, signs, sim)), "links3")
        edges = edges.unionByName(more)
    return edges


def near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = K, sim: int = SIM) -> DataFrame:
    """``id_col``, ``n_shingles``, ``set_id`` (least id with the same set) and ``component_id`` of every row."""
    small_batches(docs.sparkSession)
    rows = stage(few(heads(docs, id_col, text_col, k)), "heads")
    classes = rows.where("n > 0 and id is not null").groupBy("key").agg(F.min("id").alias("set_id"), F.max("n").alias("n"), F.max("lonely").alias("lonely"))
    classes = stage(few(classes), "classes")
    # a set links with none if more of its shingles are its own than it may have apart from another
    some = classes.where(F.col("lonely") <= F.col("n") - F.ceil(F.col("n") * sim / 100)).select("key", "set_id")
    texts = docs.select(F.col(id_col).alias("set_id"), F.col(text_col).alias("t"))
    texts = texts.join(_sent(some.select("set_id").distinct()), "set_id", "left_semi")
    sets = set_table(texts, "t", k).join(_sent(some.select(F.col("key").alias("id"))), "id", "left_semi")
    labels = components(similar_sets(stage(sets, "sets"), sim))
    classes = classes.join(labels.withColumnRenamed("id", "key"), "key", "left").select("key", "set_id", F.coalesce("component", "key").alias("label"))
    classes = stage(few(classes), "labelled")
    least = classes.groupBy("label").agg(F.min("set_id").alias("component_id"))
    classes = classes.join(least, "label").select("key", "set_id", "component_id")
    out = rows.join(classes, "key", "left")
    alone = F.col("id").isNull() | (F.col("n") == 0)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), *(F.when(alone, F.col("id")).otherwise(F.col(c)).alias(c) for c in ("set_id", "component_id")))
