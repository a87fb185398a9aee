"""N-gram Jaccard join by universe partitioning and the pigeonhole principle.

A document is the set of its hashed word n-grams. Sizes fall into bands such that the sets of a linked
pair lie in one band or in neighbouring ones; the pair is found in the scheme of the smaller one's band.
If two sets are linked, they differ in at most H elements. A scheme cuts the universe of hashes into
segments with H + 1 units in all, and some to spare: an equality segment counts one unit, a one-deletion
segment two. If none of the segments of a set matched, each would differ by its units, which is more
than H in all; so some segment is equal, or, for the second kind, equal but for one element. Documents
emit a signature per equality segment, and for one-deletion segments also one per deleted element. How
many segments are of which kind is allocated per band by the cost of signatures and of unselective ones.
Segments of one element or none are too common to be signatures and carry no unit; a set whose segments
carry too few units emits, besides, the elements of its prefix (the smallest hashes), by which two such
sets that are linked find each other.

Equal sets are one set, known by its digest; from here on sets are compared, not documents, and of equal
ones a task emits one. Signatures travel packed, a few bytes each, to the task of their bucket, which finds
the shared ones; these are grouped by sums with partial aggregation. Each set has a hub, the set of most
shared signatures among those that it shares one with; in a group of near copies this is the one that the
others derive from. Sketches of the sets, which differ in no more bits than the sets in elements, tell of
most sets that they are linked neither to their hub nor to another set of it; these go without a link lost.
The others are compared with the hub.
Two sets of one hub differ from each other where exactly one of them differs from the hub, so they are
compared by their differences from it: an inverted index of the differences of those that aren't linked
to the hub is held in blocks of bounded size, and the differences of all members of the hub stream past
it; only links that join two components come out. If the sets of a signature still are in several
components and have several hubs, all of them are compared in the same way with the leading one of their
group, and through it with each other. All comparisons are exact and of whole texts. They are dealt out
by (set compared with, salt), so that a large group is the work of many tasks.

Defined results: a null or empty text has no n-grams and is its own component; a text with fewer than n
words has its whole sequence as the only element; a row with a null id links nothing and comes back
without a component; repeated rows, and rows of one id with different texts, are rows of their own, linked
as their texts are; ties on the threshold are linked; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions.memo import memo
from strandlake.llm.common import SLICE_ROWS, as_bytes, bounded_batches, discard, frugal, give_back, materialize, sliced
from strandlake.llm.components import components

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
WORDS_KEPT = 200_000
#: Cost of an unselective signature (of two elements), in signatures.
UNSELECTIVE = 0.5
#: Members that one task compares with a copy of the same document, at least, before the group is salted.
PER_SALT = 500
#: Elements in a block of the index of differences, and elements that one task streams past a block.
BLOCK_ELEMENTS, PROBE_ELEMENTS = 1_000_000, 8_000_000
#: Digests that a task remembers to have emitted.
DIGESTS_KEPT = 200_000
#: Bits of the filter of rows that may be candidates; it is broadcast, so it has a fixed size. A full one only filters less.
FILTER_BITS = 21
#: Bits of a signature, and those of them that name its bucket; by chance equal ones only give more pairs to compare.
SIG_BITS, BUCKET_BITS = 40, 10
#: Members of a hub, at most, that are compared with each other by their sketches before their texts are moved.
SKETCHED = 2_000
#: Signatures that a task gathers before it sorts and packs them.
SIGS_HELD = 1 << 20
A, B, C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


@dataclass(frozen=True)
class Scheme:
    number: int
    most: int  # H: elements in which linked sets differ at most
    equal: int
    deletion: int  # segments 0 .. deletion - 1 are of this kind


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * A
    h = (h ^ (h >> np.uint64(29))) * B
    return h ^ (h >> np.uint64(32))


@memo(4096)
def allocation(number: int, low: int, high: int, percent: int) -> Scheme | None:
    """The cheapest mix of segments for sets of ``low`` to ``high`` - 1 elements; None if linked sets are equal."""
    most = (100 - percent) * (high - 1) // percent
    if most == 0:
        return None
    best = None
    for deletion in sorted({*range(min(most // 2 + 2, 12)), most // 4, most // 2}):
        spare = 0
        for _ in range(4):
            equal = max(0, most + 1 + spare - 2 * deletion)
            mean = low / (equal + deletion) if equal + deletion else low
            weak = math.exp(-mean) * (1 + mean)  # segments of one element or none carry no unit
            empty = (equal + 2 * deletion) * weak + deletion * mean * mean / 2 * math.exp(-mean)
            spare = math.ceil(empty + 3 * math.sqrt(empty)) if equal + deletion > 1 else 0
        cost = equal + deletion * (1 + mean) + UNSELECTIVE * math.exp(-mean) * (equal * mean * mean / 2 + deletion * mean**3 / 6)
        if best is None or cost < best[0]:
            best = (cost, Scheme(number, most, equal, deletion))
    return best[1]


@memo(4096)
def band(number: int, percent: int) -> tuple[int, int]:
    if number == 0:
        return 1, 100 // percent + 1
    low = band(number - 1, percent)[1]
    return low, low * 100 // percent + 1


@memo(4096)
def schemes(size: int, percent: int) -> tuple[Scheme, ...]:
    """Of a set's own band, and of the one below."""
    k = 0
    while band(k, percent)[1] <= size:
        k += 1
    found = [allocation(j, *band(j, percent), percent) for j in (k, k - 1) if j >= 0]
    return tuple(s for s in found if s)


def signatures(h: np.ndarray, percent: int) -> np.ndarray:
    """The signatures of a sorted set of hashes."""
    out = []
    for s in schemes(len(h), percent):
        m = s.equal + s.deletion
        tag = np.uint64((s.number + 1) * int(C) % (1 << 64))
        segment = (mix(h + tag) >> np.uint64(33)).astype(np.int64) % m
        order = np.argsort(segment, kind="stable")
        segment, values = segment[order], h[order]
        first = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
        size = np.diff(np.append(first, len(values)))
        total, name = np.add.reduceat(values, first), segment[first]
        place = name.astype(np.uint64) * A + tag
        whole = size >= 2
        out.append(mix(total[whole] + place[whole]))
        units = int(whole.sum())
        if s.deletion:
            twice = (name < s.deletion) & (size >= 3)
            units += int(twice.sum())
            group = np.repeat(np.arange(len(first)), size)
            member = twice[group]
            out.append(mix(total[group[member]] - values[member] + place[group[member]]))
        if units <= s.most:  # too few units: the prefix finds the others of this kind
            prefix = len(h) - -(-percent * len(h) // 100) + 1
            out.append(mix((h[:prefix] ^ B) + tag))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


class Shingler:
    def __init__(self, n: int):
        self.n = n
        self.known: dict[bytes, int] = {}

    def __call__(self, text: bytes | None) -> np.ndarray:
        """The sorted distinct hashes of the text's n-grams."""
        from xxhash import xxh3_64_intdigest as digest

        words = (text or b"").translate(LOWER).split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > WORDS_KEPT:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = digest(w)
        w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        k = min(self.n, len(w))
        h = np.full(len(w) - k + 1, k, np.uint64)
        for i in range(k):
            h = h * B + w[i : len(w) - k + 1 + i]
        return np.unique(mix(h))


def sketch(h: np.ndarray) -> bytes:
    """Parities of the numbers of elements by their low bits, as many as a power of two not below the set's size.

    Sets that differ in d elements differ in at most d parities; halves of a sketch xored are the sketch of half the bits.
    """
    bits = max(64, 1 << (len(h) - 1).bit_length())
    return np.packbits((np.bincount((h & np.uint64(bits - 1)).view(np.int64), minlength=bits) & 1).astype(bool), bitorder="little").tobytes()


def packed(values: np.ndarray, owners: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(bucket, bytes) of signatures and the places of their documents: sorted, as differences of as few bytes as the largest needs."""
    order = np.argsort(values, kind="stable")
    values, owners = values[order], owners[order].astype("<u2")
    step = SIG_BITS - BUCKET_BITS
    bounds = np.searchsorted(values, np.arange((1 << BUCKET_BITS) + 1, dtype=np.uint64) << np.uint64(step))
    for k in np.flatnonzero(bounds[1:] > bounds[:-1]).tolist():
        at = slice(bounds[k], bounds[k + 1])
        apart = np.diff(values[at], prepend=np.uint64(k << step))
        width = max(1, (int(apart.max()).bit_length() + 7) // 8)
        yield k, bytes([width]) + apart.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes() + owners[at].tobytes()


def unpacked(bucket: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    width = data[0]
    count = (len(data) - 1) // (width + 2)
    apart = np.zeros((count, 8), np.uint8)
    apart[:, :width] = np.frombuffer(data, np.uint8, count * width, 1).reshape(count, width)
    values = np.cumsum(apart.view("<u8").ravel(), dtype=np.uint64) + np.uint64(bucket << (SIG_BITS - BUCKET_BITS))
    return values, np.frombuffer(data, "<u2", count, 1 + count * width)


def emitted(docs: DataFrame, text: str, n: int, percent: int) -> DataFrame:
    """Rows of two kinds: (doc_id, text_hash, n_shingles, digest, row, sketch) for each of ``docs``, and (row, bucket, sigs) for many of these.

    The digest names the set; it is null for the empty set. row and sketch are null where a document emits no signatures:
    without an id, or if its task has met an equal set (in a task with very many sets, that may emit again).
    sigs are those of one bucket, ``packed``, with the places of their documents after the first row.
    """
    spark = docs.sparkSession
    bounded_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from xxhash import xxh3_64_intdigest as digest

        frugal()
        shingles, met, held, first = Shingler(n), set(), [], TaskContext.get().partitionId() << 36

        def batch_of(**columns) -> pa.RecordBatch:
            rows = len(columns["row"])
            return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(rows, t) for c, t in types], names=[c for c, _ in types])

        def given_out() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            owners = np.repeat(np.arange(len(held)), [len(x) for x in held])
            made = list(packed(np.concatenate(held), owners))
            for k in range(0, len(made), SLICE_ROWS):
                some = made[k : k + SLICE_ROWS]
                yield batch_of(row=[first] * len(some), bucket=[x[0] for x in some], sigs=[x[1] for x in some])

        for part in sliced(batches):
            sizes, names, rows, sketches = [], [], [], []
            for i, t in zip(part.column(0).to_pylist(), as_bytes(part.column(2)), strict=True):
                h = shingles(t)
                name = np.uint64(digest(h.tobytes(), seed=len(h))).view(np.int64).item() if len(h) else None
                sizes.append(len(h))
                names.append(name)
                if i is None or name is None or name in met:
                    rows.append(None)
                    sketches.append(None)
                    continue
                rows.append(first + len(held))
                sketches.append(sketch(h))
                held.append(np.unique(signatures(h, percent) >> np.uint64(64 - SIG_BITS)))
                if len(met) >= DIGESTS_KEPT:
                    met.clear()
                met.add(name)
            yield batch_of(doc_id=part.column(0), text_hash=part.column(1), n_shingles=sizes, digest=names, row=rows, sketch=sketches)
            if sum(map(len, held)) >= SIGS_HELD or len(held) + SLICE_ROWS > 1 << 16:
                yield from given_out()
                held, first = [], first + len(held)
        yield from given_out()
        shingles = met = held = None
        give_back()

    types = [(c, pa.int64()) for c in ("doc_id", "text_hash", "n_shingles", "digest", "row")] + [("sketch", pa.binary()), ("bucket", pa.int32()), ("sigs", pa.binary())]
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text)
    return rows.mapInArrow(run, "doc_id bigint, text_hash bigint, n_shingles bigint, digest bigint, row bigint, sketch binary, bucket int, sigs binary")


def sharing(made: DataFrame) -> DataFrame:
    """(sig, row) of the signatures that several rows of ``emitted`` have; a task holds one bucket at once."""
    dealt = made.where("sigs IS NOT NULL").select("bucket", "row", "sigs").repartition("bucket").sortWithinPartitions("bucket")
    bounded_batches(made.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frugal()
        bucket, held = None, []

        def found() -> Iterator[pa.RecordBatch]:
            values, rows = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(values, kind="stable")
            values = values[order]
            same = np.concatenate([[False], values[1:] == values[:-1], [False]])
            several = same[1:] | same[:-1]
            values, rows = values[several].view(np.int64), rows[order[several]]
            for k in range(0, len(values), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(values[k : k + (1 << 16)]), pa.array(rows[k : k + (1 << 16)])], names=["sig", "row"])

        for part in batches:
            for k, first, data in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                if held and k != bucket:
                    yield from found()
                    held = []
                bucket = k
                values, owners = unpacked(k, data)
                held.append((values, owners + np.int64(first)))
        if held:
            yield from found()
        held = None
        give_back()

    return dealt.mapInArrow(run, "sig bigint, row bigint")


def _streamed(pairs: DataFrame, texts: DataFrame, n: int) -> tuple[DataFrame, object]:
    """Rows (u, salt, v, text), u's own text first with a null v, and a generator of (u, v, u's set, v's set) from them."""
    count = pairs.groupBy("u").agg(F.ceil(F.count("*") / PER_SALT).cast("int").alias("salts"))
    members = pairs.join(count, "u").select("u", F.pmod(F.xxhash64("v"), F.col("salts")).cast("int").alias("salt"), "v", F.col("v").alias("of"))
    hubs = count.select("u", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("bigint").alias("v"), F.col("u").alias("of"))
    both = members.unionByName(hubs)
    rows = both.join(texts, both.of == texts.node).select("u", "salt", "v", "text").repartition("u", "salt").sortWithinPartitions("u", "salt", F.asc_nulls_first("v"))
    bounded_batches(pairs.sparkSession)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        frugal()
        shingles, hub = Shingler(n), np.zeros(0, np.uint64)
        for part in sliced(batches):
            out = []
            for u, v, t in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), as_bytes(part.column(3)), strict=True):
                h = shingles(t)
                if v is None:
                    hub = h
                else:
                    out.append((u, v, hub, h))
            yield out
        shingles = hub = out = None
        give_back()

    return rows, compared


def _linked(difference: int, sizes: int, percent: int) -> bool:
    """Whether sets that differ in so many elements, with so many in both together, are linked."""
    return (100 + percent) * difference <= (100 - percent) * sizes


def linked(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The (u, v) of ``pairs`` whose texts are linked; each u's pairs are salted by their number."""
    rows, compared = _streamed(pairs, texts, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in compared(batches):
            found = [(u, v) for u, v, a, b in part if _linked(len(a) + len(b) - 2 * len(np.intersect1d(a, b, assume_unique=True)), len(a) + len(b), percent)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

    return rows.mapInArrow(run, "u bigint, v bigint")


def differences(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """(u, v, link, n): whether they are linked, and how many elements one of them has alone."""
    rows, compared = _streamed(pairs, texts, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in compared(batches):
            apart = [len(a) + len(b) - 2 * len(np.intersect1d(a, b, assume_unique=True)) for _, _, a, b in part]
            link = [_linked(d, len(a) + len(b), percent) for d, (_, _, a, b) in zip(apart, part, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.int64()), pa.array([x[1] for x in part], pa.int64()), pa.array(link, pa.bool_()), pa.array(apart, pa.int64())], names=["u", "v", "link", "n"])

    return rows.mapInArrow(run, "u bigint, v bigint, link boolean, n bigint")


class Block:
    """Members that aren't linked to their hub, with an inverted index of their differences from it."""

    def __init__(self, members: list[tuple[int, int, np.ndarray]], percent: int):
        self.names = [m[0] for m in members]
        self.sizes = np.array([m[1] for m in members], np.int64)
        self.lengths = np.array([len(m[2]) for m in members], np.int64)
        self.percent = percent
        flat = np.concatenate([m[2] for m in members]) if members else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(members)), self.lengths)
        order = np.argsort(flat, kind="stable")
        self.owner = owner[order]
        self.elements, self.first = np.unique(flat[order], return_index=True)
        self.first = np.append(self.first, len(flat))
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (up := self.parent.get(x, x)) != x:
            self.parent[x] = self.parent.get(up, up)
            x = up
        return x

    def probe(self, name: int, size: int, diff: np.ndarray, hub: int | None) -> list[tuple[int, int]]:
        """Links of a member to those of the block; only those that join two components. hub: if the member is linked to it."""
        if not len(self.elements):
            return []
        at = np.minimum(np.searchsorted(self.elements, diff), len(self.elements) - 1)
        at = at[self.elements[at] == diff]
        count = self.first[at + 1] - self.first[at]
        places = np.arange(count.sum()) + np.repeat(self.first[at] - (np.cumsum(count) - count), count)
        common = np.bincount(self.owner[places], minlength=len(self.names))
        apart = self.lengths + len(diff) - 2 * common
        found = []
        for k in np.flatnonzero((100 + self.percent) * apart <= (100 - self.percent) * (self.sizes + size)):
            other = self.names[k]
            a, b = self.root(name if hub is None else hub), self.root(other)
            if other != name and a != b:
                self.parent[max(a, b)] = min(a, b)
                found.append((name, other))
        return found


def within_hubs(compared: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (u, v) among the members of one hub of which one or both aren't linked to the hub, from ``differences``.

    Texts are moved, not differences, which are several times larger.
    """
    held_n, all_n = F.sum(F.when(F.col("link"), 0).otherwise(F.col("n"))), F.sum("n")
    count = compared.groupBy("u").agg(F.count("*").alias("m"), held_n.alias("held"), all_n.alias("all")).where("m > 1 AND held > 0")
    count = materialize(count.select("u", F.ceil((F.col("held") + 1) / BLOCK_ELEMENTS).cast("int").alias("blocks"), F.ceil((F.col("all") + 1) / PROBE_ELEMENTS).cast("int").alias("salts")))
    rows = compared.join(count, "u")
    block, salt = (F.explode(F.sequence(F.lit(0), F.col(c) - 1)) for c in ("blocks", "salts"))
    place = lambda c: F.pmod(F.xxhash64("v"), F.col(c)).cast("int")
    dealt, names = ["u", "block", "salt"], ["kind", "v", "link", "probe"]
    hubs = count.withColumn("block", block).withColumn("salt", salt).withColumn("kind", F.lit(0)).withColumn("v", F.col("u")).withColumns({"link": F.lit(True), "probe": F.lit(False)})
    held = rows.where("NOT link").withColumn("block", place("blocks")).withColumn("salt", salt).withColumn("kind", F.lit(1)).withColumn("probe", F.col("salt") == place("salts"))
    passed = rows.withColumn("salt", place("salts")).withColumn("block", block).where(F.col("link") | (F.col("block") != place("blocks"))).withColumn("kind", F.lit(2)).withColumn("probe", F.lit(True))
    visits = hubs.select(*dealt, *names).unionByName(held.select(*dealt, *names)).unionByName(passed.select(*dealt, *names))
    both = visits.join(texts, visits.v == texts.node).select(*dealt, *names, "text").repartition(*dealt).sortWithinPartitions(*dealt, "kind", "v")
    bounded_batches(compared.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frugal()
        shingles, hub, members, block = Shingler(n), None, [], None

        def filled() -> list[tuple[int, int]]:
            """Links among the block's own members, when all of them are there."""
            nonlocal members, block
            block, first = Block([m[:3] for m in members], percent), [m for m in members if m[3]]
            members = []
            return [x for v, size, d, _ in first for x in block.probe(v, size, d, None)]

        def batch_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

        for part in sliced(batches):
            found = []
            for u, kind, v, link, probe, t in zip(*(part.column(k).to_pylist() for k in (0, 3, 4, 5, 6)), as_bytes(part.column(7)), strict=True):
                h = shingles(t)
                if kind == 0:
                    if members:
                        found += filled()
                    hub, members, block = h, [], None
                    continue
                d = np.setxor1d(hub, h, assume_unique=True)
                if kind == 1:
                    members.append((v, len(h), d, probe))
                    continue
                if block is None:
                    found += filled()
                found += block.probe(v, len(h), d, u if link else None)
            yield batch_of(found)
        if members:
            yield batch_of(filled())
        shingles = hub = members = block = None
        give_back()

    return both.mapInArrow(run, "u bigint, v bigint")


def promising(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The (u, v) of ``pairs`` without those v that, by their sketches, are linked neither to u nor to another v of u.

    No link among a u and its v is lost, as sketches differ in no more bits than sets in elements. The v of very many are all kept.
    """
    count = pairs.groupBy("u").agg(F.count("*").alias("m"))
    rows, few = pairs.join(count, "u"), count.where(F.col("m") <= SKETCHED)
    visits = rows.where(F.col("m") <= SKETCHED).select("u", "v", F.col("v").alias("of")).unionByName(few.select("u", F.lit(None).cast("bigint").alias("v"), F.col("u").alias("of")))
    dealt = visits.join(sketches, visits.of == sketches.node).select("u", "v", "size", "sketch").repartition("u").sortWithinPartitions("u", F.asc_nulls_first("v"))
    bounded_batches(pairs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frugal()
        hub, held = None, []

        def found() -> tuple[list[int], list[int]]:
            kept = _near(np.array([x[1] for x in held], np.int64), [np.frombuffer(x[2], "<u8") for x in held], percent)
            names = [x[0] for x, k in zip(held, kept, strict=True) if k and x[0] is not None]
            return [hub] * len(names), names

        for part in batches:
            us, vs = [], []
            for u, *member in zip(*(part.column(k).to_pylist() for k in range(4)), strict=True):
                if held and u != hub:
                    for all_of, some in zip((us, vs), found(), strict=True):
                        all_of += some
                    held = []
                hub = u
                held.append(member)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found()], names=["u", "v"])
        held = None
        give_back()

    return dealt.mapInArrow(run, "u bigint, v bigint").unionByName(rows.where(F.col("m") > SKETCHED).select("u", "v"))


def _near(sizes: np.ndarray, sketches: list[np.ndarray], percent: int) -> np.ndarray:
    """Whether each of some sets may be linked to another of them."""
    near = np.zeros(len(sizes), bool)
    wide = np.array([len(x) for x in sketches])
    for w in np.unique(wide).tolist():
        own = np.flatnonzero(wide == w)
        # of linked sets, the larger has less than 200 / percent times the bits, as a sketch has less than twice its set's size
        others = np.flatnonzero((wide >= w) & ((wide * percent < 200 * w) | (wide == w)))
        bits = np.stack([np.bitwise_xor.reduce(sketches[k].reshape(-1, w), axis=0) for k in others])
        for k in own:
            apart = np.bitwise_count(bits[np.searchsorted(others, k)] ^ bits).sum(axis=1, dtype=np.int64)
            hit = others[_linked(apart, sizes[k] + sizes[others], percent) & (others != k)]
            if len(hit):
                near[k] = True
                near[hit] = True
    return near


def _possible(u: str, v: str, percent: int):
    """Whether two sizes allow a link."""
    return F.expr(f"100 * least({u}, {v}) >= {percent} * greatest({u}, {v})")


def _components_of(docs: DataFrame, text: str, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """``emitted`` rows of all documents, and (node, first, component) of the sets; first is the row (doc_id, text_hash) that stands for a set."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    both = materialize(emitted(rows, "text", n, percent))
    made = materialize(both.where("sigs IS NULL").drop("bucket", "sigs"))
    named = made.where("doc_id IS NOT NULL AND digest IS NOT NULL")
    sets = named.groupBy(F.col("digest").alias("node")).agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.max("n_shingles").alias("size"), F.min("row").alias("row"))
    # of equal sets only one has signatures here
    signed = materialize(sharing(both).join(sets.select("row", "node", "size"), "row").select("sig", "node", "size"))
    discard(both)
    sketches = sets.select("row", "node", "size").join(made.select("row", "sketch"), "row").drop("row")
    parts = _linked_sets(signed, sets.select("node", "first.doc_id", "first.text_hash"), sketches, rows, n, percent)
    return made, sets.join(parts, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component"))


def similarity_components(docs: DataFrame, text: str = "text", n: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs``."""
    made, sets = _components_of(docs, text, n, percent)
    least = sets.groupBy("component").agg(F.min("first.doc_id").alias("component_id"))
    names = sets.join(least, "component").select("node", "component_id")
    found = made.where("doc_id IS NOT NULL").join(names, made.digest == names.node).select("doc_id", "n_shingles", "component_id")
    alone = made.where("doc_id IS NULL OR digest IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone)


def distinct_documents(docs: DataFrame, text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of linked ones: the least (doc_id, hash of the text). Rows without an id stay.

    Rows without n-grams are linked with nothing; of such, and of any others, with equal ids and texts one stays.
    """
    made, sets = _components_of(docs, text, n, percent)
    keys = made.where("doc_id IS NOT NULL").select("doc_id", "text_hash", "digest")
    least = sets.groupBy("component").agg(F.min("first").alias("keeper"))
    keepers = sets.join(least, "component").select("node", "keeper")
    judged = keys.groupBy("doc_id", "text_hash", "digest").agg(F.count("*").alias("copies"))
    judged = judged.join(keepers, judged.digest == keepers.node, "left").select("doc_id", "text_hash", "copies", F.coalesce(F.struct("doc_id", "text_hash") != F.col("keeper"), F.lit(False)).alias("gone"))
    # written, so that their sizes are known: few such rows are joined without a shuffle of the texts
    judged = judged.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    gone, twice = materialize(judged.where("gone").select("_id", "_hash")), materialize(judged.where("NOT gone AND copies > 1").select("_id", "_hash"))
    tagged = docs.withColumns({"_id": F.col("doc_id").cast("bigint"), "_hash": F.xxhash64(text)})
    once = tagged.join(twice, ["_id", "_hash"], "left_anti").join(gone, ["_id", "_hash"], "left_anti")
    first = tagged.join(twice, ["_id", "_hash"], "left_semi").dropDuplicates(["_id", "_hash"])
    return once.unionByName(first).select(*docs.columns)


def _linked_sets(signed: DataFrame, sets: DataFrame, sketches: DataFrame, rows: DataFrame, n: int, percent: int) -> DataFrame:
    """(node, component) of the sets that are linked to others, from their signatures (sig, node, size)."""
    shared = signed.groupBy("sig").agg(F.count("*").alias("n")).where("n > 1")
    members = materialize(signed.join(shared, "sig"))
    discard(signed)
    # how many signatures a set shares: many if others derive from it
    pop = members.groupBy("node").agg(F.sum("n").alias("pop"))
    counted, members = members, materialize(members.drop("n").join(pop, "node"))
    discard(counted)
    sketches = materialize(members.select("node").distinct().join(sketches, "node"))
    # a set's hub: of those that it shares a signature with and that rank higher, the highest
    rank = F.struct(F.col("pop"), (-F.col("node")).alias("minus"), F.col("size"))
    leads = members.groupBy("sig").agg(F.max(rank).alias("r")).select("sig", (-F.col("r.minus")).alias("u"), F.col("r.pop").alias("u_pop"), F.col("r.size").alias("u_size"))
    led = members.join(leads, "sig").where("u <> node").where(_possible("u_size", "size", percent))
    hubs = materialize(led.groupBy("node").agg(F.max(F.struct("u_pop", (-F.col("u")).alias("minus"))).alias("r")).select("node", (-F.col("r.minus")).alias("hub")))
    chosen, texts = _pairs_and_texts(hubs.select(F.col("hub").alias("u"), F.col("node").alias("v")), sketches, sets, rows, percent)
    compared = materialize(differences(chosen, texts, n, percent))
    links = materialize(compared.where("link").select("u", "v").unionByName(within_hubs(compared, texts, n, percent)))
    parts = materialize(components(links))
    # what is left: groups of one signature with several components and several hubs; all members of such a
    # group are compared with its leading one, and through it with each other
    owned = members.join(hubs, "node", "left").join(parts, "node", "left").select("sig", "node", F.coalesce("hub", "node").alias("hub"), F.coalesce("component", "node").alias("component"))
    left = owned.groupBy("sig").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.min("hub").alias("h0"), F.max("hub").alias("h1")).where("c0 < c1 AND h0 < h1").select("sig")
    pairs = members.join(left, "sig", "left_semi").join(leads, "sig").where("u <> node")
    pairs = materialize(pairs.select("u", F.col("node").alias("v")).distinct())
    discard(members, texts)
    if not pairs.take(1):
        return parts
    pairs, texts = _pairs_and_texts(pairs, sketches, sets, rows, percent)
    alone = pairs.groupBy("u").agg(F.count("*").alias("n")).where("n = 1").select("u")
    done = compared.select("u", "v")
    single = pairs.join(alone, "u", "left_semi").join(done, ["u", "v"], "left_anti")
    several = materialize(pairs.join(alone, "u", "left_anti").select("u", "v"))
    again = differences(several.join(done, ["u", "v"], "left_anti"), texts, n, percent)
    again = materialize(again.unionByName(compared.join(several, ["u", "v"], "left_semi").select(*again.columns)))
    links = materialize(links.unionByName(linked(single, texts, n, percent)).unionByName(again.where("link").select("u", "v")).unionByName(within_hubs(again, texts, n, percent)))
    discard(texts)
    return materialize(components(links))


def _pairs_and_texts(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, rows: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The ``promising`` ones of the pairs (u, v), and the (node, text) of their sets."""
    chosen = materialize(promising(pairs, sketches, percent))
    nodes = chosen.select(F.col("u").alias("node")).unionByName(chosen.select(F.col("v").alias("node"))).distinct()
    return chosen, materialize(_texts(nodes.join(sets, "node"), rows, pairs.sparkSession))


def _texts(wanted: DataFrame, rows: DataFrame, spark) -> DataFrame:
    """(node, text) of the wanted sets (node, doc_id, text_hash); a bitmap of fixed size passes over most other rows before the join."""
    slot = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(1 << FILTER_BITS)).cast("int")
    bits = np.zeros(1 << FILTER_BITS, bool)
    bits[wanted.select(slot.alias("s")).distinct().toArrow().column(0).to_numpy()] = True
    kept = spark.sparkContext.broadcast(np.packbits(bits))

    def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frugal()
        held = np.unpackbits(kept.value).astype(bool)
        for part in batches:
            yield part.select(["doc_id", "text_hash", "text"]).filter(pa.array(held[part.column(3).to_numpy()]))
        give_back()

    bounded_batches(spark)
    hashed = rows.where("doc_id IS NOT NULL").withColumn("text_hash", F.xxhash64("text")).select("doc_id", "text_hash", "text", slot.alias("slot"))
    passed = hashed.mapInArrow(only, "doc_id bigint, text_hash bigint, text string")
    # repeated rows meet where the join has put them; by the node alone, all texts would be shuffled once more
    return passed.join(wanted.select("node", "doc_id", "text_hash"), ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash", "node"]).select("node", "text")
