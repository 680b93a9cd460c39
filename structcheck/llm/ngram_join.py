"""N-gram Jaccard self-join of documents, with rare-first prefix filtering.

A document's set is its distinct word n-grams, as 64-bit hashes; documents of equal sets form a class and only classes
are joined. Two sets of likeness t or more share one of the first ``s - ceil(t s) + 1`` n-grams of each, in any order
common to all; the order here is rare first, by counts over the whole corpus (in hashed buckets, so that their size is
bounded; a bucket's count only orders, it never drops). Candidates share a prefix n-gram and pass filters that lose no
link: by length, by the positions of the shared n-gram, and by a suffix filter, a histogram of the hashes whose
distance is at most that of the sets. Each candidate pair is verified once, on the whole sets: what a step has tested, later
ones leave out.

Only connectivity is asked for, so pairs within a known component need no test. Lists of up to SHORT nodes are tested
pair by pair; of longer lists each node is first tested against one hub alone. What a list then still holds of several
components is compared across components, whole: its largest component against its other nodes, and these among
themselves, in blocks of bounded size, each pair of blocks a task of its own. No list is held whole, and none is capped.
Blocks compare coarse histograms. What has a candidate left in its pair of blocks is compared again, by histograms of as
many bins as a set needs, which almost only links pass. First each pair of blocks gives a forest of its closest
candidates, fewer than it has nodes. These are verified and merge components; then all its other candidates across the
components that are left are verified too.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, free_name, lean, small_batches, written
from .components import components

SEGMENT = 1 << 19
#: Bins of a histogram: the fewest, and the most of a fine one; a coarse one has an eighth of a fine one's.
BINS, MOST_BINS = 128, 1 << 15
#: Bins that are compared at once.
CHUNK = 1 << 20
#: Lists of up to SHORT nodes are tested pair by pair, longer ones against hubs.
SHORT = 3
#: Grams of a node that tell whether two nodes have met in a list before.
EARLY = 16


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Shingler:
    """Sets of word n-grams of UTF-8 texts, A-Z in small letters, words between ASCII white space."""

    def __init__(self, n: int):
        self.n = n
        self.table = np.random.default_rng(20_240_229).integers(0, 2**64, 256, dtype=np.uint64)
        self.table[65:91] = self.table[97:123]
        self.space = np.zeros(256, dtype=bool)
        self.space[[32, *range(9, 14)]] = True
        self.base = 0x9E3779B97F4A7C15
        self.grow(SEGMENT * 2)

    def grow(self, size: int) -> None:
        def powers(x: int) -> np.ndarray:
            out = np.full(size, x, dtype=np.uint64)
            out[0] = 1
            return np.cumprod(out)

        self.power, self.inverse = powers(self.base), powers(pow(self.base, -1, 2**64))

    def words(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the words of some bytes."""
        if len(b) > len(self.power):
            self.grow(len(b))
        inside = np.zeros(len(b) + 2, dtype=np.int8)
        inside[1:-1] = ~self.space[b]
        edges = np.flatnonzero(np.diff(inside))
        starts, ends = edges[::2], edges[1::2]
        sums = np.zeros(len(b) + 1, dtype=np.uint64)
        np.cumsum(self.table[b] * self.power[: len(b)], out=sums[1:])
        return starts, mix((sums[ends] - sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))

    def long_words(self, text: bytes) -> np.ndarray:
        """Hashes of the words of a long text, in segments that end at white space."""
        out, at, b = [], 0, np.frombuffer(text, dtype=np.uint8)
        while at < len(b):
            end = at + SEGMENT
            while end < len(b):
                gap = np.flatnonzero(self.space[b[end : end + SEGMENT]])
                if len(gap):
                    end += int(gap[0])
                    break
                end += SEGMENT
            out.append(self.words(b[at:end])[1])
            at = min(end, len(b))
        return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)

    def combine(self, w: np.ndarray, n: int) -> np.ndarray:
        acc = w[: len(w) - n + 1] + np.uint64(n)
        for j in range(1, n):
            acc = mix(acc * np.uint64(0xD6E8FEB86659FD93) + w[j : len(w) - n + 1 + j])
        return mix(acc)

    def of_words(self, w: np.ndarray, grams: np.ndarray | None = None) -> np.ndarray:
        if not len(w):
            return w
        if len(w) < self.n:
            return self.combine(w, len(w))
        return np.unique(self.combine(w, self.n) if grams is None else grams)

    def sets(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """The sorted set of each text."""
        i = 0
        while i < len(texts):
            size, j = len(texts[i]), i + 1
            if size > SEGMENT:
                yield self.of_words(self.long_words(texts[i]))
                i = j
                continue
            while j < len(texts) and size + len(texts[j]) + 1 <= SEGMENT:
                size += len(texts[j]) + 1
                j += 1
            starts, w = self.words(np.frombuffer(b" ".join(texts[i:j]), dtype=np.uint8))
            cuts = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts[i:j])]))
            grams = self.combine(w, self.n) if len(w) >= self.n else w[:0]
            for p, q in zip(cuts, cuts[1:]):
                yield self.of_words(w[p:q], grams[p : q - self.n + 1])
            i = j


def _texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _batches(column: pa.Array, size: int = 500) -> Iterator[tuple[int, list[bytes]]]:
    for at in range(0, len(column), size):
        yield at, _texts(column.slice(at, size))


def rarity(docs: DataFrame, text_col: str, n: int, bits: int) -> np.ndarray:
    """Counts of the n-grams of all documents in 2**bits hashed buckets."""
    chunk = 4096

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, shingler = np.zeros(1 << bits, dtype=np.int64), Shingler(n)
        for b in batches:
            for _, texts in _batches(b.column(0)):
                grams = np.concatenate([np.zeros(0, dtype=np.uint64), *shingler.sets(texts)])
                total += np.bincount((grams >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        parts = total.astype(np.int32).reshape(-1, chunk)
        some = [i for i in range(len(parts)) if parts[i].any()]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([parts[i].tobytes() for i in some], pa.binary())], ["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held = sums.setdefault(part, np.zeros(chunk, dtype=np.int64))
                held += np.frombuffer(counts, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["part", "counts"])

    schema = "part int, counts binary"
    rows = docs.select(text_col).mapInArrow(lean(count), schema).repartition("part").mapInArrow(lean(add), schema).collect()  # 2**bits numbers in all
    total = np.zeros((1 << bits) // chunk * chunk, dtype=np.int64).reshape(-1, chunk)
    for r in rows:
        total[r["part"]] = np.frombuffer(r["counts"], dtype=np.int64)
    return np.minimum(total.reshape(-1), 2**32 - 1).astype(np.uint32)


def need(size: int, percent: int) -> int:
    """The least overlap of a set of `size` with any set of likeness `percent` or more."""
    return -(-percent * size // 100)


def bins_for(size: int, fine: bool) -> int:
    """Bins of a set's histogram: a power of two, of at least twice its size if fine, a quarter if coarse, in bounds."""
    wide = max(BINS, 1 << (2 * size - 1).bit_length())
    return min(MOST_BINS, wide) if fine else min(MOST_BINS, max(8 * BINS, wide)) // 8


def histogram(s: np.ndarray, fine: bool = False) -> bytes:
    """Numbers of hashes by their low bits, at most 255 each."""
    bins = bins_for(len(s), fine)
    return np.minimum(np.bincount((s & np.uint64(bins - 1)).astype(np.int64), minlength=bins), 255).astype(np.uint8).tobytes()


def folded(hist: np.ndarray, bins: int) -> np.ndarray:
    """Histograms of fewer bins, a power of two: the sums of those that agree in the low bits."""
    return hist.reshape(len(hist), -1, bins).sum(1, dtype=np.int32)


def in_chunks(rows: np.ndarray, bins: int) -> Iterator[np.ndarray]:
    """`rows` in parts of which all histograms together have CHUNK bins or little more."""
    step = max(1, CHUNK // bins)
    for at in range(0, len(rows), step):
        yield rows[at : at + step]


def describe(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int, counts: np.ndarray) -> DataFrame:
    """For each row: id, digest (MD5 of the text), fp (a digest of the set), size, prefix, hist."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)  # as many numbers as buckets
    bits = int(math.log2(len(counts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, order = Shingler(n), shared.value
        for b in batches:
            for at, texts in _batches(b.column(1)):
                digest, fp, size, prefix, hist = [hashlib.md5(t, usedforsecurity=False).digest() for t in texts], [], [], [], []
                for s in shingler.sets(texts):
                    fp.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    size.append(len(s))
                    rare = s[np.lexsort((s, order[(s >> np.uint64(64 - bits)).astype(np.int64)]))] if len(s) else s
                    prefix.append(rare[: len(s) - need(len(s), percent) + 1].view(np.int64).copy())
                    hist.append(histogram(s))
                columns = [pa.array(digest, pa.binary()), pa.array(fp, pa.binary()), pa.array(size, pa.int32()), pa.array(prefix, pa.list_(pa.int64())), pa.array(hist, pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), *columns], names)

    names = ["id", "digest", "fp", "size", "prefix", "hist"]
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return given.mapInArrow(lean(run), f"id {given.schema['id'].dataType.simpleString()}, digest binary, fp binary, size int, prefix array<long>, hist binary")


def sets_of(docs: DataFrame, id_col: str, text_col: str, n: int, wanted: DataFrame) -> DataFrame:
    """The sets of the classes in `wanted` (node, fp, least): node, set.

    A second pass over the texts makes the sets of rows whose id is in a bitmap of the wanted ones, of at most 2**28
    bits; what else passes is removed by the join.
    """
    wanted = written(wanted, "wanted")
    many = wanted.count()
    bits = 1 << min(28, max(15, (64 * many).bit_length()))

    def place(c: str):
        return F.pmod(F.xxhash64(F.coalesce(F.col(c).try_cast("long"), F.lit(0))), F.lit(bits))

    placed = wanted.select((place("least") + 1).alias("p"))  # positions count from 1
    rows = placed.groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m")).collect()  # a bitmap in all
    bitmap = np.zeros(bits // 8, dtype=np.uint8)
    for r in rows:
        bitmap[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(r["m"], dtype=np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen, given = Shingler(n), shared.value, set()
        for b in batches:
            p = b.column(0).to_numpy()
            b = b.filter(pa.array((seen[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)))
            for at, some in _batches(b.column(2)):
                made = list(shingler.sets(some))
                fp = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in made]
                ids = b.column(1).slice(at, len(some))
                first = [i for i, k in enumerate(zip(ids.to_pylist(), fp)) if k not in given and not given.add(k)]
                columns = [ids.take(pa.array(first, pa.int64())), pa.array([fp[i] for i in first], pa.binary()), pa.array([made[i].view(np.int64) for i in first], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "fp", "set"])

    given_rows = docs.select(place(id_col).alias("p"), F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    passed = given_rows.mapInArrow(lean(run), f"id {given_rows.schema['id'].dataType.simpleString()}, fp binary, set array<long>")
    met = passed.join(wanted.select("node", "least", F.col("fp").alias("print")).hint("merge"), (F.col("fp") == F.col("print")) & F.col("id").eqNullSafe(F.col("least")))
    out = written(met.select("node", "set"), "sets")
    if out.count() > many:  # rows of one id and one text, each of which has passed
        once, repeated = written(out.dropDuplicates(["node"]), "sets"), out
        discard(repeated)
        out = once
    discard(wanted)
    return out


def with_hits(rows: DataFrame, wanted: DataFrame, key: str, of: str, flag: str) -> DataFrame:
    """`rows` with `flag`: whether their `key` may be among the `of` of `wanted`; never false for one that is.

    A bitmap of 64 bits for each wanted one, of at most 2**28 bits, is broadcast in parts of 4 KB, so rows that are not wanted
    stay where they are, whatever the size of either side.
    """
    bits = 1 << min(28, max(15, (64 * wanted.count()).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits)) + 1  # noqa: E731  positions count from 1
    part, held = free_name(rows, "part"), free_name(rows, "bitmap")
    parts = wanted.select(place(of).alias("p")).groupBy(F.bitmap_bucket_number("p").alias(part)).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias(held))
    met = rows.withColumn(part, F.bitmap_bucket_number(place(key))).join(F.broadcast(parts), part, "left")
    at = F.bitmap_bit_position(place(key))
    byte = F.conv(F.hex(F.substring(F.col(held), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) != 0
    return met.withColumn(flag, F.coalesce(bit, F.lit(False))).drop(part, held)


def within(a: str, b: str, percent: int):
    """The length filter, as a condition on two size columns."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def close_enough(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that pass the suffix filter."""
    given = pairs.join(nodes.select(F.col("node").alias("a"), F.col("size").alias("sa"), F.col("hist").alias("ha")).hint("merge"), "a")
    given = given.join(nodes.select(F.col("node").alias("b"), F.col("size").alias("sb"), F.col("hist").alias("hb")).hint("merge"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = batch.column(2).to_numpy().astype(np.int64) + batch.column(3).to_numpy()
            lengths = np.array([[len(x) for x in batch.column(i).to_pylist()] for i in (4, 5)], dtype=np.int64).reshape(2, -1)
            keep = np.zeros(len(batch), dtype=bool)
            for la, lb in {*zip(*lengths.tolist())}:
                for at in in_chunks(np.flatnonzero((lengths[0] == la) & (lengths[1] == lb)), max(la, lb)):
                    sides = [np.frombuffer(b"".join(batch.column(i).take(pa.array(at)).to_pylist()), dtype=np.uint8).reshape(len(at), -1) for i in (4, 5)]
                    ha, hb = (folded(x, min(la, lb)) for x in sides)
                    keep[at] = np.abs(ha - hb).sum(1) * (100 + percent) <= (100 - percent) * total[at]
            some = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(some), batch.column(1).filter(some)], ["a", "b"])

    return given.select("a", "b", "sa", "sb", "ha", "hb").mapInArrow(lean(run), "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are alike by `percent` or more."""
    given = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    sized = given.select("a", "b", both.alias("both"), (F.size("x") + F.size("y")).alias("all"))
    return sized.filter(100 * F.col("both") >= percent * (F.col("all") - F.col("both"))).select("a", "b")


def by_gram(rows: DataFrame, found: DataFrame, total: int) -> DataFrame:
    """`rows` joined with `found` (gram, n and others) by gram, where n is the length of the gram's list.

    A list of a 20,000th of all `total` rows of lists, and of 256 rows, is joined by broadcast, so that its rows stay
    where they are; there are at most 20,000 of them. The others grow with the table and are joined by a shuffle at every
    size, so that what a small table shows holds for a large one.
    """
    long = F.col("n") >= max(256, total // 20_000)
    hot = F.broadcast(found.filter(long))
    cold = rows.join(F.broadcast(found.filter(long).select("gram")), "gram", "left_anti").join(found.filter(~long).hint("merge"), "gram")
    return rows.join(hot, "gram").unionByName(cold)


def short_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Every pair (a, b) of nodes of a list of up to SHORT, which the length filter leaves."""
    member = F.struct("size", "node")
    short = lists.filter(F.col("n") <= SHORT)
    ends = short.groupBy("gram").agg(F.min(member).alias("first"), F.max(member).alias("last"))
    met = short.select("gram", "node", "size").join(ends, "gram")
    met = met.select("node", "size", F.explode(F.array("first", "last")).alias("o")).select("node", "size", F.col("o.node").alias("other"), F.col("o.size").alias("other_size"))
    return _ordered(met, percent)


def _ordered(met: DataFrame, percent: int) -> DataFrame:
    met = met.filter((F.col("node") != F.col("other")) & within("size", "other_size", percent))
    return met.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def with_components(lists: DataFrame, known: DataFrame) -> DataFrame:
    """Adds comp, the component of the row's node as far as links are known."""
    return lists.join(known, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")


def hub_pairs(lists: DataFrame, percent: int, total: int) -> DataFrame:
    """A pair (a, b) for each node at most, with a hub of one of its lists.

    The hubs of a list are its nodes of least and of greatest hash; of all that its lists offer, a node takes the one of
    least hash, so that nodes with common lists take the same.
    """
    drawn = F.struct(F.xxhash64("node").alias("draw"), "node", "size")
    hubs = lists.groupBy("gram").agg(F.min(drawn).alias("first"), F.max(drawn).alias("last"), F.first("n").alias("n"))
    offered = by_gram(lists.drop("n"), hubs, total).select("node", "size", F.explode(F.array("first", "last")).alias("o"))
    offered = offered.filter((F.col("o.node") != F.col("node")) & within("size", "o.size", percent))
    taken = offered.groupBy("node").agg(F.min(F.struct("o.draw", "o.node")).alias("o")).select("node", F.col("o.node").alias("other"))
    return taken.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def tiles(placed: DataFrame, block: int, total: int) -> DataFrame:
    """The rows of the lists of several components, dealt to tiles: gram, lo, hi, block, node, comp, size, pos.

    The nodes outside a list's largest component fall into its first blocks, those of the largest into blocks of their
    own. A tile is a pair of blocks of which the first is of nodes outside.
    """
    each = placed.groupBy("gram", "comp").agg(F.count(F.lit(1)).alias("k"))
    most = each.groupBy("gram").agg(F.max(F.struct("k", "comp")).alias("most"), F.sum("k").alias("n")).filter(F.col("n") > F.col("most.k"))
    found = most.select("gram", "n", F.col("most.comp").alias("largest"), F.ceil((F.col("n") - F.col("most.k")) / block).cast("int").alias("out"), F.ceil(F.col("most.k") / block).cast("int").alias("in"))
    rows = by_gram(placed.drop("n"), found, total)
    outside = F.col("comp") != F.col("largest")
    place = F.when(outside, F.pmod(F.xxhash64("node"), "out")).otherwise(F.col("out") + F.pmod(F.xxhash64("node"), "in")).cast("int")
    others = F.sequence(F.lit(0), F.when(outside, F.col("out") + F.col("in")).otherwise(F.col("out")) - 1)
    rows = rows.withColumn("block", place).withColumn("other", F.explode(others))
    return rows.select("gram", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "comp", "size", "pos")


class Side:
    """One block of a tile as arrays, its rows in the order of their sizes."""

    def __init__(self, rows: list[tuple], gram: int):
        rows = sorted(rows, key=lambda r: (r[6], r[4]))
        self.node, self.comp, self.size, self.pos = (np.array([r[i] for r in rows], dtype=np.int64) for i in (4, 5, 6, 7))
        lengths = np.array([len(r[8]) for r in rows])
        cuts = [0, *(np.flatnonzero(np.diff(lengths)) + 1).tolist(), len(rows)]
        #: Rows from, to, and their histograms, for each number of bins.
        self.parts = [(p, q, np.frombuffer(b"".join(r[8] for r in rows[p:q]), dtype=np.uint8).reshape(q - p, -1)) for p, q in zip(cuts, cuts[1:])]
        self.early = [set(r[9][: r[9].index(gram)] if gram in r[9] else r[9]) for r in rows] if len(rows[0]) > 9 else []

    def hist(self, i: int) -> np.ndarray:
        return next(m[i - p : i - p + 1] for p, q, m in self.parts if i < q)


def alike(a: Side, b: Side, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of `a`, the rows of `b` that pass the filters by component, length and position.

    The position filter takes nothing shared to lie before. That holds in the first list that two nodes share, where
    every link passes; in later ones it may drop a pair that has been given out already.
    """
    for i in range(len(a.node)):
        low, high = np.searchsorted(b.size, [need(int(a.size[i]), percent), int(a.size[i]) * 100 // percent + 1])
        if a is b:
            low = max(low, i + 1)
        if low < high:
            sizes = b.size[low:high]
            least = -(-percent * (a.size[i] + sizes) // (100 + percent))
            js = np.flatnonzero((b.comp[low:high] != a.comp[i]) & (np.minimum(a.size[i] - a.pos[i], sizes - b.pos[low:high]) >= least)) + low
            if len(js):
                yield i, js


def candidates(a: Side, b: Side, percent: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row of `a`, the rows of `b` whose histograms pass too, and their distances."""
    for i, js in alike(a, b, percent):
        mine = a.hist(i)
        for p, q, theirs in b.parts:
            bins = min(mine.shape[1], theirs.shape[1])
            for some in in_chunks(js[(js >= p) & (js < q)], theirs.shape[1]):
                for n in (max(BINS, bins // 8), bins):
                    if len(some):
                        far = np.abs(folded(theirs[some - p], n) - folded(mine, n)).sum(1)
                        ok = far * (100 + percent) <= (100 - percent) * (a.size[i] + b.size[some])
                        some, far = some[ok], far[ok]
                if len(some):
                    yield i, some, far


def near_rows(a: Side, b: Side, percent: int) -> list[np.ndarray]:
    """The nodes of each block of a tile that have a candidate in it."""
    met = [np.zeros(len(x.node), dtype=bool) for x in ([a] if a is b else [a, b])]
    for i, js, _ in candidates(a, b, percent):
        met[0][i] = True
        met[-1][js] = True
    return [x.node[m] for x, m in zip([a, b], met)]


def near_pairs(a: Side, b: Side, percent: int, forest: bool) -> tuple[list[tuple[int, int]], set[int]]:
    """The candidates of a tile that have met in no earlier list, or of them a forest over components, the closest first,
    and the nodes of those that the forest leaves out."""
    found = [(int(d), i, int(j)) for i, js, far in candidates(a, b, percent) for d, j in zip(far, js) if a.early[i].isdisjoint(b.early[j])]
    left: set[int] = set()
    if forest:
        root: dict[int, int] = {}

        def top(c: int) -> int:
            while root.get(c, c) != c:
                c = root[c]
            return c

        kept = []
        for d, i, j in sorted(found):
            x, y = top(int(a.comp[i])), top(int(b.comp[j]))
            if x != y:
                root[max(x, y)] = min(x, y)
                kept.append((d, i, j))
            else:
                left |= {int(a.node[i]), int(b.node[j])}
        found = kept
    ends = [sorted((int(a.node[i]), int(b.node[j]))) for _, i, j in found]
    return [(x, y) for x, y in ends], left


def across(rows: DataFrame, percent: int, want: str) -> DataFrame:
    """What the tiles of `rows` hold: their ``rows`` that have a candidate in the tile, ``pairs`` (a, b), or a ``forest``:
    pairs, and beside them, with a and b null, the rows of nodes whose candidates are not all in it.

    `rows`: gram, lo, hi, block, node, comp, size, pos, hist and, for pairs, early (the first of the node's prefix
    n-grams that have lists). A task takes its tiles one after the other, so it holds two blocks at a time.
    """
    pairs = want != "rows"
    cols = ["gram", "lo", "hi", "block", "node", "comp", "size", "pos", "hist"] + (["early"] if pairs else [])
    given = rows.select(*cols).repartition("gram", "lo", "hi").sortWithinPartitions("gram", "lo", "hi")
    names = {"rows": cols[:8], "pairs": ["a", "b"], "forest": ["a", "b", *cols[:8]]}[want]
    small = [n in ("lo", "hi", "block", "size", "pos") for n in names]
    schema = ", ".join(f"{n} {'int' if x else 'long'}" for n, x in zip(names, small))
    kinds = [pa.int32() if x else pa.int64() for x in small]

    def found(held: list[tuple]) -> list[tuple]:
        gram, lo, hi = held[0][:3]
        sides = [[r for r in held if r[3] == x] for x in dict.fromkeys((lo, hi))]
        if not all(sides) or len({r[5] for r in held}) < 2:
            return []
        blocks = [Side(s, gram) for s in sides]
        if pairs:
            ends, left = near_pairs(blocks[0], blocks[-1], percent, want == "forest")
            if want == "pairs":
                return ends
            return [(*e, *[None] * 8) for e in ends] + [(None, None, *r[:8]) for r in held if r[4] in left]
        met = [set(x.tolist()) for x in near_rows(blocks[0], blocks[-1], percent)]
        return [r[:8] for m, s in zip(met, sides) for r in s if r[4] in m]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], names)

        for b in batches:
            for at in range(0, len(b), 512):
                for row in zip(*(c.to_pylist() for c in b.slice(at, 512).columns)):
                    if held and row[:3] != held[0][:3]:
                        out += found(held)
                        held = []
                        if len(out) > 50_000:
                            yield batch()
                            out = []
                    held.append(row)
        if held:
            out += found(held)
        yield batch()

    return given.mapInArrow(lean(run), schema)


def fine(sets: DataFrame) -> DataFrame:
    """node and hist, a histogram of as many bins as its set needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 256):
                some = b.slice(at, 256)
                hists = [histogram(s.values.to_numpy().view(np.uint64), True) for s in some.column(1)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(hists, pa.binary())], ["node", "hist"])

    return sets.select("node", "set").mapInArrow(lean(run), "node long, hist binary")


def _labelled(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int, bits: int, block: int) -> DataFrame:
    """For each row: id, digest, size and root, the node that stands for its component; null where the set is empty."""
    counts = rarity(docs, text_col, n, bits)
    base = written(describe(docs, id_col, text_col, n, percent, counts), "described")
    some = base.filter(F.col("size") > 0)
    grouped = some.groupBy("fp").agg(F.min("id").alias("least"), F.first("size").alias("size"), F.first("prefix").alias("prefix"), F.first("hist").alias("hist"))
    classes = written(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")

    def sets(nodes: DataFrame) -> DataFrame:
        return sets_of(docs, id_col, text_col, n, classes.join(nodes.distinct(), "node").select("node", "fp", "least"))

    def merged(known: DataFrame | None, links: DataFrame) -> DataFrame:
        edges = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
        return components(edges if known is None else edges.unionByName(known.select(F.col("node").alias("u"), F.col("root").alias("v"))))

    rows = classes.select("node", "size", F.posexplode("prefix").alias("pos", "gram"))
    active = written(rows.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1), "active")
    total = active.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    lists = written(by_gram(rows, active, total), "lists")
    long = lists.filter(F.col("n") > SHORT)
    near = short_pairs(lists, percent).unionByName(hub_pairs(long, percent, total)).distinct()
    near = written(close_enough(near, classes, percent), "pairs")
    made = sets(near.select(F.explode(F.array("a", "b")).alias("node")))
    links = written(verified(near, made, percent), "links")
    known = merged(None, links)
    discard(made)

    placed = written(with_components(long, known), "placed")
    rest = written(tiles(placed, block, total), "tiles")
    close = written(across(rest.join(classes.select("node", "hist").hint("merge"), "node"), percent, "rows"), "close")
    nodes = close.select("node").distinct()
    made = sets(nodes)
    order = F.array_sort(F.collect_list(F.struct("pos", "gram")))
    early = lists.join(nodes.hint("merge"), "node").groupBy("node").agg(F.transform(F.slice(order, 1, EARLY), lambda x: x["gram"]).alias("early"))
    described = written(fine(made).join(early, "node"), "fine")
    grown = written(across(close.join(described, "node"), percent, "forest"), "forest")
    forest = written(grown.filter("a IS NOT NULL").select("a", "b").distinct().join(near, ["a", "b"], "left_anti"), "pairs")
    links = written(verified(forest, made, percent), "links")
    known = merged(known, links)
    tile = ["gram", "lo", "hi"]
    left = with_components(grown.filter("a IS NULL").drop("a", "b", "comp"), known)
    mixed = left.groupBy(*tile).agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter(F.col("x") != F.col("y")).select(*tile)
    more = across(left.join(mixed, tile, "left_semi").join(described, "node"), percent, "pairs").distinct()
    more = written(more.join(near.unionByName(forest), ["a", "b"], "left_anti"), "pairs")
    links = written(verified(more, made, percent), "links")
    if not links.isEmpty():
        known = merged(known, links)
    discard(near, made, placed, rest, close, described, grown, forest, more, lists, active)

    rooted = classes.select("fp", "node").join(known, "node", "left").select("fp", F.coalesce("root", "node").alias("root"))
    return base.select("id", "digest", "fp", "size").join(rooted, "fp", "left").select("id", "digest", "size", "root")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, bits: int = 18, block: int = 512) -> DataFrame:
    """Documents with the component that links of likeness `percent` or more make.

    Returns one row for each row of `docs`: the id, n_shingles (size of its set) and component_id, the smallest id
    that links reach, itself included. Equal sets are linked. A text with fewer than `n` words is one n-gram; one
    without words, or null, has an empty set and is linked with nothing. Null ids take part and are never the smallest
    unless all are null; rows of one id are rows of their own, linked by their texts; repeated rows get equal results.
    A text of any length is taken whole, in segments. Only the two named columns are read, so others cannot clash; an
    empty table gives an empty result. `bits`: buckets of the rarity order; `block`: rows of a list on each side that a
    task compares at once. Jobs run when this is called; the result is read from what they have written.
    """
    with small_batches(docs.sparkSession):
        found = written(_labelled(docs, id_col, text_col, n, percent, bits, block), "labelled")
    smallest = found.filter(F.col("root").isNotNull()).groupBy("root").agg(F.min("id").alias("least"))
    out = found.join(smallest, "root", "left")
    component = F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("least"))
    return out.select(F.col("id").alias(id_col), F.col("size").cast("long").alias("n_shingles"), component.alias("component_id"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with one row of each component: that of the smallest id, null ids last, then of the least text digest.

    Rows that agree in id and text are copies, whatever their other columns hold; any one of them stays. Rows without
    words are linked with nothing and all stay. An id with several texts loses only those rows whose text has a smaller
    partner. Columns are as in `docs`, whatever their names; an empty table stays empty; a text is compared whole.
    """
    with small_batches(docs.sparkSession):
        found = written(_labelled(docs, id_col, text_col, n, percent, 18, 512).filter(F.col("root").isNotNull()), "labelled")
    rank = F.struct(F.col("id").isNull().alias("last"), "id", "digest")
    kept = found.groupBy("root").agg(F.min(rank).alias("kept"))
    each = found.groupBy("root", "id", "digest").agg(F.count(F.lit(1)).alias("n"))
    marked = each.join(kept, "root").select("id", "digest", "n", (F.col("id").eqNullSafe(F.col("kept.id")) & (F.col("digest") == F.col("kept.digest"))).alias("stays"))
    marked = written(marked.filter(~F.col("stays") | (F.col("n") > 1)), "marked")

    key, ident, digest = (free_name(docs, x) for x in ("digest", "id", "text"))
    given = docs.withColumn(key, F.unhex(F.md5(F.col(f"`{text_col}`").cast("binary"))))
    marks = marked.select(F.col("id").alias(ident), F.col("digest").alias(digest), "stays")
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(ident)) & (F.col(key) == F.col(digest))
    flag = free_name(docs, "hit")
    flagged = with_hits(given, marks.select(digest), key, digest, flag)
    maybe = flagged.filter(flag).drop(flag)
    out = flagged.filter(~F.col(flag)).drop(flag).unionByName(maybe.join(marks.drop("stays").hint("merge"), same, "left_anti"))
    again = marks.filter("stays").drop("stays")
    if not again.isEmpty():
        out = out.unionByName(given.join(again, same, "left_semi").dropDuplicates([id_col, key]))
    return out.drop(key)
