"""Substring dedup: the common-prefix interval tree of a sparse suffix array.

A text's suffixes are taken at anchors: of every ``SPAN`` bytes the position whose
``GRAM`` bytes hash lowest, the first of ties. Two equal strings of ``SPAN`` bytes have
their anchor at the same offset, so all repeats meet among the suffixes of one anchor
hash, and one position in some 85 is a suffix.

Per anchor hash the suffixes are sorted. A scan of neighbours' common prefixes with a
stack yields the tree of intervals: all suffixes that share a prefix of some length. In
each interval the texts to the left are sorted, and a scan of these yields the sets of
members that agree to the left and differ one byte further. Such a left-diverse set whose
common left and right parts make up ``SPAN`` bytes is a maximal repeat, unless all of it
agrees further to the right, too. ``repeat_groups`` tells them with all occurrences.

``repeated_spans`` removes the bytes of all groups. For that it is enough how far each member
reaches in the innermost of its sets, so the sets around these are not listed. Where the left
texts agree as far as they are held, the repeat goes on at the anchor before.

What keeps this small: equal texts are one class, and all their bytes repeat. Suffixes
whose surroundings (``SPAN`` bytes to both sides) are equal need no comparison, one of
them stands for all; the middle of a long repeat is settled so. Only distinct surroundings
of anchors that occur again are shuffled as bytes. An anchor hash with more than ``GROUP``
of these is settled by counting the hashes of its windows of ``SPAN`` bytes instead: a sum
that is combined before the shuffle, so no task holds an unbounded group. Surroundings are
not written, and short rows are written in few files: each file costs an executor three
processes where the shared folder is a local one. Workers give memory back when a task ends.

Defined results: null text is empty; texts shorter than ``SPAN`` bytes lose nothing;
matches don't cross texts; overlapping occurrences in one text count; repeated rows are
copies, so all their bytes go if they have ``SPAN`` or more; an empty table gives an
empty result; other columns are left alone.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirestream.llm.blocks import lean
from quirestream.llm.staging import few, parts
from quirestream.llm.staging import stage_tidily as stage
from quirestream.llm.tokens import U, buffers, mix64, slices

SPAN, GRAM = 200, 32
LEFT = SPAN - GRAM
#: Distinct surroundings of one anchor hash that one task compares; ids that are broadcast at most.
GROUP, SEND = 4096, 1_000_000

_BYTE = mix64(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    held = _POWERS.get(base)
    if held is None or len(held) < n:
        held = np.full(max(n, 1 << 21) + 1, U(base), U)
        held[0] = 1
        _POWERS[base] = held = np.multiply.accumulate(held)
    return held[:n]


class Rolling:
    """Hash of any substring of a buffer in constant time."""

    def __init__(self, buf: np.ndarray) -> None:
        n = len(buf)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(_BYTE[buf] * _powers(_BASE, n), out=self.sums[1:])
        self.back = _powers(_INVERSE, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(U))


def _lowest(n: int, rolling: Rolling) -> np.ndarray:
    """For each window of ``SPAN`` bytes in a buffer of ``n``, the position of its anchor."""
    if n < SPAN:
        return np.zeros(0, np.int64)
    at = np.arange(n - GRAM + 1)
    bits = max(22, int(n).bit_length())
    mask = U((1 << bits) - 1)
    low = (rolling.of(at, at + GRAM) & ~mask) | at.astype(U)  # the first of equal hashes is least
    width, reach = 1, LEFT + 1
    best = low
    while 2 * width <= reach:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    if width < reach:
        best = np.minimum(best[: len(low) - reach + 1], best[reach - width : reach - width + len(low) - reach + 1])
    return (best & mask).astype(np.int64)


def anchors(buf: np.ndarray, cut: np.ndarray, rolling: Rolling) -> np.ndarray:
    """Positions of the anchors of all documents (``cut``: their offsets, one more)."""
    best = _lowest(len(buf), rolling)
    start = np.arange(len(best))
    doc = np.searchsorted(cut, start, "right") - 1
    return np.unique(best[start + SPAN <= cut[doc + 1]])


def _scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row per document: row (a number), id, n bytes, sha, and its anchors: hash, hash of
    the surroundings, position."""
    key = docs.schema[id_col].dataType.simpleString()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId() << 40, 0
        for b in batches:
            offsets, raw = buffers(b.column(1))
            for i, j in slices(offsets):
                cut = offsets[i : j + 1] - offsets[i]
                buf = raw[offsets[i] : offsets[j]]
                rolling = Rolling(buf)
                pos = anchors(buf, cut, rolling)
                doc = np.searchsorted(cut, pos, "right") - 1
                a, z = np.maximum(pos - LEFT, cut[doc]), np.minimum(pos + SPAN, cut[doc + 1])
                around = rolling.of(a, z) ^ mix64((pos - a).astype(U))
                name = rolling.of(pos, pos + GRAM)
                at = pa.array(np.searchsorted(doc, np.arange(j - i + 1)).astype(np.int32))
                sha = [hashlib.sha256(buf[x:y]).digest() for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (name.view(np.int64), around.view(np.int64), (pos - cut[doc]).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(j - i, dtype=np.int64) + (part + seen)), b.column(0).slice(i, j - i), pa.array(np.diff(cut)), pa.array(sha, pa.binary()), *lists], ["row", "id", "n", "sha", "name", "around", "pos"])
                seen += j - i
        _POWERS.clear()

    texts = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return texts.mapInArrow(run, f"row long, id {key}, n long, sha binary, name array<long>, around array<long>, pos array<int>")


PLACE = "name long, around long, row long, pos int, kind int, salt int"


def _combined(lists: DataFrame) -> DataFrame:
    """Anchors as rows, told apart before they are shuffled. kind 0: the surroundings occur
    again in this batch, and another row stands for them; it is settled, and salted, so that
    what is very frequent does not meet in one task. 1: the only one. 2: stands for several."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            name, around, pos = (c.flatten().to_numpy() for c in b.columns[1:4])
            row = np.repeat(b.column(0).to_numpy(), b.column(1).value_lengths().fill_null(0).to_numpy())
            if len(name) == 0:
                continue
            order = np.lexsort((pos, row, around, name))
            n, a = name[order], around[order]
            first = np.concatenate([[True], (n[1:] != n[:-1]) | (a[1:] != a[:-1])])
            size = np.diff(np.append(np.flatnonzero(first), len(n)))
            kind = np.zeros(len(n), np.int32)
            kind[first] = np.where(size > 1, 2, 1)
            salt = np.where(kind == 0, 1 + (row[order] * 31 + pos[order]) % 9973, 0).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (n, a, row[order], pos[order], kind, salt)], ["name", "around", "row", "pos", "kind", "salt"])

    return lists.select("row", "name", "around", "pos").mapInArrow(run, PLACE)


def _meetings(places: DataFrame) -> DataFrame:
    """What has to be settled. kind 0: the surroundings occur elsewhere, too. kind 1: the
    first of its surroundings, at a hash with several."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a stream in order of (name, around); no group is held, only its first rows
        name = around = None
        first: tuple | None = None  # first row of these surroundings, until it is settled
        lead: tuple | None = None  # first row of this name, until other surroundings come
        for b in batches:
            names, arounds, rows, pos, kinds = (b.column(i).to_numpy() for i in range(5))
            plain = np.flatnonzero(kinds == 0)
            out: list[tuple] = list(zip(names[plain].tolist(), rows[plain].tolist(), pos[plain].tolist(), kinds[plain].tolist(), strict=True))
            at = np.flatnonzero(kinds > 0)
            # single rows whose name differs from both neighbours' say nothing; skip them in bulk
            lone = kinds[at] == 1
            n_ = names[at]
            same = n_[1:] == n_[:-1]
            lone[1:] &= ~same
            lone[:-1] &= ~same
            if len(at):
                lone[0] &= name is None or n_[0] != name
                lone[-1] = False
            for i in at[~lone].tolist():
                n, a, r, p = int(names[i]), int(arounds[i]), int(rows[i]), int(pos[i])
                several = kinds[i] == 2
                if n != name:
                    name, around, first, lead = n, a, None if several else (n, r, p), (n, r, p)
                    if several:
                        out.append((n, r, p, 0))
                elif a == around:
                    if first is not None:
                        out.append((*first, 0))
                        first = None
                    out.append((n, r, p, 0))
                else:
                    if lead is not None:
                        out.append((*lead, 1))
                        lead = None
                    out.append((n, r, p, 1))
                    if several:
                        out.append((n, r, p, 0))
                    around, first = a, None if several else (n, r, p)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["name", "row", "pos", "kind"])

    spread = places.repartition(parts(places.sparkSession), "name", "salt").sortWithinPartitions("name", "salt", "around", "row", "pos")
    return spread.select("name", "around", "row", "pos", "kind").mapInArrow(run, "name long, row long, pos int, kind int")


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n - 1  # a[:lo] == b[:lo], a[:hi + 1] != b[:hi + 1]
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def intervals(common: list[int]) -> Iterator[tuple[int, int, int]]:
    """Depth, first and last of the intervals of a sorted list, inner ones first, by a scan with
    a stack. ``common``: how far neighbours agree."""
    stack: list[tuple[int, int]] = []
    for i, depth in enumerate([*common, -1]):
        begin = i
        while stack and stack[-1][0] > depth:
            d, begin = stack.pop()
            yield d, begin, i
        if not stack or stack[-1][0] < depth:
            stack.append((depth, begin))


class Least:
    """The least of any range of an array, in constant time."""

    def __init__(self, values: list[int]) -> None:
        self.levels = [np.asarray(values, np.int64)]
        while len(self.levels[-1]) > 1 << (len(self.levels) - 1):
            x, w = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(x[:-w], x[w:]))

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Least of [lo, hi) for each pair; no range is empty."""
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(lo), np.int64)
        for k in np.unique(level).tolist():
            at = level == k
            out[at] = np.minimum(self.levels[k][lo[at]], self.levels[k][hi[at] - (1 << k)])
        return out


class Suffixes:
    """Suffixes of one anchor hash: the interval tree of what follows it, and in each interval
    how far the members agree to the left. ``right``: what follows each anchor; ``left``: what
    stands before it, reversed."""

    def __init__(self, right: list[bytes], left: list[bytes], span: int = SPAN) -> None:
        self.span, m = span, len(right)
        order = sorted(range(m), key=right.__getitem__)
        by_left = sorted(range(m), key=left.__getitem__)
        self.lcp = [_common(right[x], right[y]) for x, y in zip(order[:-1], order[1:], strict=True)]
        before = [_common(left[x], left[y]) for x, y in zip(by_left[:-1], by_left[1:], strict=True)]
        self.order, self.by_left = np.array(order, np.int64), np.array(by_left, np.int64)
        self.place, self.rank = np.empty(m, np.int64), np.empty(m, np.int64)
        self.place[self.order] = self.rank[self.by_left] = np.arange(m)
        self.before, self.most = Least(before), max(before, default=0)

    def _nodes(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Depth of each interval in which members agree for ``span`` bytes, its members in
        order of their left texts, and how far neighbours in this order agree to the left."""
        for d, x, y in intervals(self.lcp):
            if d + self.most < self.span:
                continue
            rank = np.sort(self.rank[self.order[x : y + 1]])
            part = self.before.of(rank[:-1], rank[1:])
            if part.max() + d >= self.span:
                yield d, self.by_left[rank], part

    def reaches(self) -> Iterator[tuple[int, int, int]]:
        """Member, bytes to the left and to the right that its smallest groups cover: in each
        interval the innermost left extension of a member, where it reaches further than inside."""
        m = len(self.order)
        done_l, done_r = np.full(m, -1), np.full(m, -1)
        for d, who, part in self._nodes():
            best = np.maximum(np.append(part, 0), np.append(0, part))
            new = (best + d >= self.span) & ((best > done_l[who]) | (d > done_r[who]))
            who, best = who[new], best[new]
            done_l[who], done_r[who] = np.maximum(done_l[who], best), np.maximum(done_r[who], d)
            yield from ((int(i), int(a), d) for i, a in zip(who, best, strict=True))

    def groups(self) -> Iterator[tuple[list[int], int, int]]:
        """All maximal repeats: members, bytes to the left and to the right. In an interval, each
        set of members that agree to the left and differ one byte further (left-diverse) is one,
        unless all of them agree further to the right, too: then a deeper interval tells it."""
        ahead = Least(self.lcp)
        for d, who, part in self._nodes():
            for left, x, y in intervals(part.tolist()):
                if left + d >= self.span:
                    at = self.place[who[x : y + 1]]
                    if ahead.of(at.min(keepdims=True), at.max(keepdims=True))[0] == d:
                        yield who[x : y + 1].tolist(), left, d


def _settled(contexts: DataFrame) -> DataFrame:
    """row, start, end of the repeats among distinct surroundings."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, []
        out: list[tuple] = []

        def solve() -> None:
            if len(held) > 1:
                for i, a, z in Suffixes([c[l:] for _, _, l, c in held], [c[:l][::-1] for _, _, l, c in held]).reaches():
                    out.append((held[i][0], held[i][1] - a, held[i][1] + z))

        for b in batches:
            for n, r, p, l, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if n != name:
                    solve()
                    name, held = n, []
                if not held or held[-1][:2] != (r, p):
                    held.append((r, p, l, c))
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["row", "start", "end"])
                out.clear()
        solve()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["row", "start", "end"])

    spread = contexts.repartition(parts(contexts.sparkSession), "name").sortWithinPartitions("name", "row", "pos")
    return spread.select("name", "row", "pos", "l", "ctx").mapInArrow(run, "row long, start long, end long")


def _windows(contexts: DataFrame) -> DataFrame:
    """The same for hashes with very many surroundings: windows that have this anchor and whose hash occurs twice."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[np.ndarray]] = [[], [], []]
            for _, r, p, l, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
                rolling = Rolling(np.frombuffer(c, np.uint8))
                s = np.flatnonzero(_lowest(len(c), rolling) == l)
                if len(s) > 0:
                    out[0].append(np.full(len(s), r))
                    out[1].append(s + (p - l))
                    out[2].append(rolling.of(s, s + SPAN).view(np.int64))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["row", "start", "h"])
        _POWERS.clear()

    found = contexts.select("name", "row", "pos", "l", "ctx").mapInArrow(run, "row long, start long, h long").distinct()
    twice = found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    return found.join(twice, "h", "left_semi").select("row", "start", (F.col("start") + SPAN).alias("end"))


def _texts(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """``wanted`` (id, sha and more; a row a text) with the text as bytes."""
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t")).where(F.length("t") >= SPAN)
    ids = wanted.select("id")
    if ids.count() <= SEND:
        texts = texts.join(F.broadcast(ids), texts["id"].eqNullSafe(ids["id"]), "left_semi")
    texts = texts.withColumn("sha", F.unhex(F.sha2("t", 256)))
    return wanted.join(texts, texts["id"].eqNullSafe(wanted["id"]) & (texts["sha"] == wanted["sha"])).select(wanted["*"], "t")


CONTEXT = "name long, row long, pos long, l long, ctx binary"


def _cut(before: int, after: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Surroundings of anchors (row, list of pos and name, text) as bytes; l: bytes before the anchor."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (*[pa.int64()] * 4, pa.binary()), strict=True)], ["name", "row", "pos", "l", "ctx"])

        for b in batches:
            out: list[tuple] = []
            for r, at, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for x in at:
                    p = x["pos"]
                    a = max(0, p - before)
                    out.append((x["name"], r, p, p - a, t[a : p + after]))
                    if len(out) > 5000:
                        yield batch(out)
                        out = []
            if out:
                yield batch(out)

    return run


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(z, out[-1][1])
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: id, n bytes, ``spans`` (maximal runs of repeated
    bytes: start, end) and ``kept_sha256`` of the other bytes."""
    scan = stage(_scan(docs, id_col, text_col), "anchors")
    classes = scan.groupBy("sha").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("copies"))
    single = stage(few(classes.join(scan.select("row", "id", "n"), "row").select("row", "id", "sha", "n", "copies")), "classes")
    lone = scan.select("row", "name", "around", "pos").join(single.where(f"n >= {SPAN}").select("row", F.col("copies").alias("c")), "row")
    # by row from here on, so that each joins where it is. whole: anchors of kind 0; at: those of kind 1
    lists = _meetings(_combined(lone)).groupBy("row").agg(F.collect_list(F.expr("if(kind = 0, cast(pos as long), null)")).alias("whole"), F.collect_list(F.expr("if(kind = 1, struct(pos, name), null)")).alias("at"))
    meet = stage(few(lists.join(single, "row").select("row", "id", "sha", "n", "copies", "whole", "at")), "meetings")
    # surroundings as bytes, where there are several for one hash
    need = meet.where(F.size("at") > 0).select("row", "id", "sha", "at")
    ones = need.select("row", "id", "sha", F.explode("at").alias("x")).select("row", "id", "sha", "x.pos", "x.name")
    large = stage(few(ones.groupBy("name").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > GROUP).select("name")), "large")

    def contexts(wanted: DataFrame) -> DataFrame:
        return _texts(docs, id_col, text_col, wanted).select("row", "at", "t").mapInArrow(_cut(LEFT, SPAN), CONTEXT).where(F.length("ctx") >= SPAN)

    def parted(found: DataFrame) -> DataFrame:
        return found.groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("part"))

    @F.pandas_udf("array<struct<start:long,end:long>>")
    def merge(spans: pd.Series) -> pd.Series:
        return spans.map(lambda s: [{"start": a, "end": z} for a, z in _merged([(x["start"], x["end"]) for x in s])])

    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    wide = lambda p: F.struct(F.greatest(p - LEFT, F.lit(0).cast("long")).alias("start"), F.least(p + SPAN, F.col("n")).alias("end"))
    covered = meet.where("copies = 1").select("row", "id", "sha", F.filter(F.transform("whole", wide), lambda s: s["end"] - s["start"] >= SPAN).alias("spans"))
    rest = contexts(need)
    if not large.isEmpty():  # each name stands for more than GROUP rows, so these are few
        many = ones.join(large, "name", "left_semi").groupBy("row", "id", "sha").agg(F.collect_set(F.struct("pos", "name")).alias("at"))
        found = _windows(contexts(stage(few(many), "many")))
        found = stage(few(parted(found).select("row", merge("part").alias("part"))), "windows")
        covered = covered.join(found, "row", "left").select("row", "id", "sha", F.concat("spans", F.coalesce("part", none)).alias("spans"))
        rest = rest.join(large, "name", "left_anti")
    covered = covered.join(parted(_settled(rest)), "row", "left").select("id", "sha", merge(F.concat("spans", F.coalesce("part", none))).alias("spans"))
    covered = stage(few(covered.where(F.size("spans") > 0)), "covered")

    @F.pandas_udf("string")
    def digest(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(text, spans, strict=True):
            h, at = hashlib.sha256(), 0
            for x in s:
                h.update(t[at : x["start"]])
                at = x["end"]
            h.update(t[at:])
            out.append(h.hexdigest())
        return pd.Series(out)

    kept = _texts(docs, id_col, text_col, covered).select("sha", "spans", digest("t", "spans").alias("kept_sha256"))
    all_ = single.where(f"copies > 1 and n >= {SPAN}").select("sha", F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n").alias("end"))).alias("spans"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"))
    result = stage(few(kept.unionByName(all_).dropDuplicates(["sha"])), "kept")
    out = scan.select("id", "n", "sha").join(result, "sha", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_bytes"), F.coalesce("spans", none).alias("spans"), F.coalesce("kept_sha256", F.lower(F.hex("sha"))).alias("kept_sha256"))


def without_repeats(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The bytes outside of ``spans`` (start, end; in order)."""
    out, at = [], 0
    for a, z in spans:
        out.append(text[at:a])
        at = z
    return b"".join([*out, text[at:]])


GROUPS = "grp string, row long, pos long, a long, z long, goes_on boolean"


def _told(contexts: DataFrame, reach: int) -> DataFrame:
    """Maximal repeats among the distinct surroundings of each anchor hash: grp, row and pos of
    the member, bytes before and after the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, []
        out: list[tuple] = []

        def tell(members: list[int], a: int, z: int) -> None:
            _, _, l, c, _ = held[members[0]]
            text = c[l - a : l + z]
            buf = np.frombuffer(text, np.uint8)
            if a <= LEFT and _lowest(SPAN, Rolling(buf[:SPAN]))[0] == a:  # else an anchor before tells it
                out.extend((hashlib.sha256(text).hexdigest(), held[i][0], held[i][1], a, z, z == reach) for i in members)

        def solve() -> Iterator[pa.RecordBatch]:
            suffixes = Suffixes([c[l:] for _, _, l, c, _ in held], [c[:l][::-1] for _, _, l, c, _ in held])
            same = (([i], l, len(c) - l) for i, (_, _, l, c, n) in enumerate(held) if n > 1 and len(c) >= SPAN)
            for members, a, z in itertools.chain(same, suffixes.groups()):
                tell(members, a, z)
                if len(out) > 10_000:
                    yield batch()

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["grp", "row", "pos", "a", "z", "goes_on"])
            out.clear()
            return made

        for b in batches:
            for n, *one in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if n != name:
                    if held:
                        yield from solve()
                    name, held = n, []
                if not held or held[-1][:2] != one[:2]:
                    held.append(one)
        if held:
            yield from solve()
        if out:
            yield batch()

    spread = contexts.repartition(parts(contexts.sparkSession), "name").sortWithinPartitions("name", "row", "pos")
    return spread.select("name", "row", "pos", "l", "ctx", "n").mapInArrow(run, GROUPS)


def _told_windows(contexts: DataFrame) -> DataFrame:
    """The same for hashes with very many surroundings: each window whose anchor this is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r, p, l, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
                at = np.flatnonzero(_lowest(len(c), Rolling(np.frombuffer(c, np.uint8))) == l).tolist()
                if at:
                    yield pa.RecordBatch.from_pylist([{"grp": hashlib.sha256(c[x : x + SPAN]).hexdigest(), "row": r, "pos": p, "a": l - x, "z": x + SPAN - l, "goes_on": True} for x in at])

    return contexts.select("row", "pos", "l", "ctx").mapInArrow(run, GROUPS)


def repeat_groups(docs: DataFrame, *, reach: int = 1000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The maximal repeats of ``SPAN`` bytes or more with all their occurrences: ``grp`` (the
    string's SHA-256), id, ``start``, ``end``, ``goes_on``. A repeat is maximal where two of its
    occurrences differ one byte before it, and two one byte behind it; a text's ends differ from
    all. It is told at the first anchor of its own, which all its occurrences have.

    What follows an anchor is held for ``reach`` bytes. A repeat that is longer is told up to
    there, as one that ``goes_on``. For an anchor hash with more than ``GROUP`` distinct surroundings the groups are windows of ``SPAN``
    bytes that go on. A row of ``docs`` gives as many rows as it has occurrences; null ids stay
    null; an empty table gives none.
    """
    reach = max(reach, SPAN)
    scan = stage(_scan(docs, id_col, text_col), "anchors")
    classes = scan.groupBy("sha").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("copies"))
    single = stage(classes.join(scan.select("row", "id", "n"), "row").where(f"n >= {SPAN}"), "classes")
    marks = scan.join(single.select("row", "copies"), "row").select("row", "copies", F.explode(F.arrays_zip("name", "pos")).alias("x")).select("row", "copies", F.col("x.name").alias("name"), F.col("x.pos").cast("long").alias("pos"))
    often = marks.groupBy("name").agg(F.sum("copies").alias("k")).where("k > 1").select("name")

    def surroundings(at: DataFrame) -> DataFrame:
        need = at.groupBy("row").agg(F.collect_set(F.struct("pos", "name")).alias("at")).join(single.select("row", "id", "sha"), "row")
        return _texts(docs, id_col, text_col, need).select("row", "at", "t").mapInArrow(_cut(LEFT + 1, reach), CONTEXT)

    # equal surroundings are compared once; the first of them stands for all
    alike = ["name", "l", "h"]
    places = stage(surroundings(marks.join(often, "name", "left_semi")).select("name", "l", F.sha2("ctx", 256).alias("h"), "row", "pos").distinct(), "places")
    leads = places.join(single.select("row", "copies"), "row").groupBy(*alike).agg(F.min(F.struct("row", "pos")).alias("lead"), F.sum("copies").alias("n"))
    leads = stage(leads.select(*alike, F.col("lead.row").alias("lead"), F.col("lead.pos").alias("lead_pos"), "n"), "leads")
    names = leads.groupBy("name").agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("most")).where("k > 1 or most > 1")
    first = leads.join(names.withColumn("large", F.col("k") > GROUP), "name").select(F.col("lead").alias("row"), F.col("lead_pos").alias("pos"), "name", "n", "large")
    contexts = stage(surroundings(first).join(first, ["row", "pos", "name"]), "surroundings")
    told = _told(contexts.where("not large"), reach).unionByName(_told_windows(contexts.where("large")))
    told = told.select("grp", F.col("row").alias("lead"), F.col("pos").alias("lead_pos"), "a", "z", "goes_on")
    found = places.join(leads.drop("n"), alike).join(told, ["lead", "lead_pos"])
    found = found.select("grp", "row", (F.col("pos") - F.col("a")).alias("start"), (F.col("pos") + F.col("z")).alias("end"), "goes_on")
    spans = found.groupBy("grp", "row", "start", "end").agg(F.min("goes_on").alias("goes_on"))
    spans = stage(spans.join(single.select("row", "sha"), "row").join(scan.select("sha", "id"), "sha").select("grp", "id", "start", "end", "goes_on"), "groups")
    several = spans.groupBy("grp").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("grp")
    return spans.join(several, "grp", "left_semi").select("grp", F.col("id").alias(id_col), "start", "end", "goes_on")
