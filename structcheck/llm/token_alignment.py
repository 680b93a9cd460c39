"""Alignment of two tokenizers over all documents, by a cogroup of postings.

Both tokenizers cut the same bytes, so the tokens of a document are two partitions of one byte range: every end of a
token of either side closes exactly one overlap, which is a link between a token of A and one of B. A pair of ids
counts the documents that hold it linked; a link is best if its pair has the highest count of its A id.

Each task aligns its documents and turns their pairs with multiplicities into postings: for each pair of ids of a chunk
of documents, which of these hold it and how often. Postings are shuffled by the id of side A and sorted, so that a
task streams them and holds the counts of one id at a time: the counts of an id come before its postings, its maximum
is known when they arrive, and what each document gains is added up and emitted, packed by chunk; a second sorted
stream sums by document. Sorting spills, streaming holds a slice. Counts are added up before they are shuffled. An id with very many postings would
be one task's work: its postings are dealt by chunk instead, and the counts of such ids, a few times the vocabulary, go
along to each part.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, schema_with, written
from .packing import Encoder

#: Entries of a chunk of documents, of a slice that a task decodes at a time, and of what it adds up before it emits.
CHUNK, SLICE, BUFFER = 400_000, 500_000, 2_000_000
#: An A id is dealt by chunk if it has this share of all entries or this many; a part of the chunks has up to PART entries.
HOT_SHARE, HOT, PART = 2048, 50_000_000, 200_000_000


class PlainEncoder(Encoder):
    """Ids of a byte-level tokenizer file in which the strings of special tokens are plain text."""

    def __init__(self, tokenizer_path: str, ranks_path: str):
        super().__init__(tokenizer_path, ranks_path)
        self.whole.encode_special_tokens = True

    def __call__(self, text: str) -> list[int]:
        run = self.runs(text)
        if run and self.long_runs(text, run.start()):
            return self.whole.encode(text, add_special_tokens=False).ids
        return (self.full if run else self.single).encode_ordinary(text)


def rank_bytes(ranks_path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary."""
    with open(ranks_path, "rb") as f:
        ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    return [ranks.get(i, b"") for i in range(max(ranks) + 1)]


def piece_bytes(model) -> list[bytes]:
    """The bytes of each piece: the word mark is a space, a byte piece its byte; control pieces have none."""
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        out.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) or model.is_unknown(i) else piece.replace("▁", " ").encode())
    return out


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 0 on in groups of seven bits, low ones first, and the place at which each begins, the end last."""
    size = np.ones(len(values), np.int64)
    for bits in (7, 14, 21, 28, 35, 42, 49, 56):
        size += values >= 1 << bits
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(at[-1], np.uint8)
    for i in range(int(size.max(initial=0))):
        some = size > i
        out[at[:-1][some] + i] = (values[some] >> (7 * i) & 127) | np.where(size[some] > i + 1, 128, 0)
    return out, at


def numbers(data: np.ndarray) -> np.ndarray:
    """What `varints` wrote."""
    ends = np.flatnonzero(data < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    out = np.zeros(len(ends), np.int64)
    for i in range(int((ends - starts).max(initial=-1)) + 1):
        some = starts + i <= ends
        out[some] |= (data[starts[some] + i].astype(np.int64) & 127) << (7 * i)
    return out


class Aligner:
    """Both tokenizers of one worker."""

    def __init__(self, tokenizer_path: str, ranks_path: str, model_path: str):
        import sentencepiece

        self.a, self.b = PlainEncoder(tokenizer_path, ranks_path), sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.bytes_a, self.bytes_b = rank_bytes(ranks_path), piece_bytes(self.b)
        self.len_a, self.len_b = (np.array([len(x) for x in t]) for t in (self.bytes_a, self.bytes_b))
        # An id's decimal digits and what follows it: a comma within a group, else the mark that ends its side.
        words = [f"{i}{end}" for n, ends in ((len(self.bytes_a), ",|"), (len(self.bytes_b), ",;")) for i in range(n) for end in ends]
        self.words = np.array(words, dtype=object)

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        if not text:
            return None
        a, b, given = self.a(" " + text), self.b.encode(text, num_threads=1), (" " + text).encode()
        for ids, table in ((a, self.bytes_a), (b, self.bytes_b)):
            if b"".join([table[i] if i < len(table) else b"" for i in ids]) != given:
                return None
        return np.array(a, np.int64), np.array(b, np.int64)

    def align(self, a: np.ndarray, b: np.ndarray) -> tuple[int, np.ndarray, str]:
        """The number of groups, the pair (A id * B ids + B id) of each link, and the digest of the groups."""
        end_a, end_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        ends = np.concatenate([end_a, end_b])
        ends.sort(kind="stable")
        ends = ends[np.concatenate([[True], ends[1:] != ends[:-1]])]
        ia, ib = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        both = (end_a[ia] == ends) & (end_b[ib] == ends)
        cuts = ends[both]
        group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[ia[both]] = last_b[ib[both]] = 1
        words = np.empty(len(a) + len(b), np.int64)
        words[np.arange(len(a)) + np.searchsorted(group_b, group_a, "left")] = 2 * a + last_a
        words[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = 2 * (len(self.bytes_a) + b) + last_b
        shown = "".join(self.words[words].tolist())[:-1]
        return len(cuts), a[ia] * len(self.bytes_b) + b[ib], hashlib.sha256(shown.encode()).hexdigest()


def postings(codes: np.ndarray, docs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The pairs of a chunk, how many documents hold each, and which (as steps from one to the next) with how often."""
    order = np.argsort(codes, kind="stable")
    codes, docs, times = codes[order], docs[order], times[order]
    first = np.concatenate([[True], codes[1:] != codes[:-1]])
    starts = np.flatnonzero(first)
    steps = np.diff(docs, prepend=0)
    steps[starts] = docs[starts]
    data, at = varints(np.stack([steps, times], 1).ravel())
    offsets = at[np.concatenate([2 * starts, [2 * len(codes)]])].astype(np.int32)
    lists = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return codes[starts], np.diff(np.concatenate([starts, [len(codes)]])), lists


def aligned(docs: DataFrame, aligner_args: tuple[str, str, str]) -> DataFrame:
    """Two kinds of rows: of a document (node, id, n_a, n_b, n_groups, digest), and postings (code, base, n, postings) of the
    documents that count from the node `base`."""
    fields = ["id", "node", "n_a", "n_b", "n_groups", "digest", "code", "base", "n", "postings"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*aligner_args)
        node = base = TaskContext.get().partitionId() << 40
        held: list[tuple[np.ndarray, np.ndarray, int]] = []
        size = 0

        def batch(many: int, **cols) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([cols[f] if f in cols else pa.nulls(many, kinds[f]) for f in fields], fields)

        def chunk() -> pa.RecordBatch:
            codes, times = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            code, n, lists = postings(codes, np.repeat([h[2] - base for h in held], [len(h[0]) for h in held]), times)
            return batch(len(code), code=pa.array(code), base=pa.array(np.full(len(code), base)), n=pa.array(n), postings=lists)

        for b in batches:
            kinds = {"id": b.schema.field(0).type, "digest": pa.string(), "postings": pa.binary()} | {f: pa.int64() for f in fields if f not in ("id", "digest", "postings")}
            rows = []
            for text in b.column(1):
                found = aligner.tokens(text.as_py())
                if found:
                    groups, links, digest = aligner.align(*found)
                    pairs, times = np.unique(links, return_counts=True)
                    held.append((pairs, times, node))
                    size += len(pairs)
                    rows.append((node, len(found[0]), len(found[1]), groups, digest))
                else:
                    rows.append((node, 0, 0, 0, ""))
                node += 1
                if size >= CHUNK:
                    yield chunk()
                    held, size, base = [], 0, node
            if rows:
                cols = dict(zip(("node", "n_a", "n_b", "n_groups", "digest"), map(pa.array, zip(*rows))))
                yield batch(len(rows), id=b.column(0), **cols)
        if held:
            yield chunk()

    given = docs.select("id", "text")
    return given.mapInArrow(lean(run), schema_with(given.select("id"), node="long", n_a="long", n_b="long", n_groups="long", digest="string", code="long", base="long", n="long", postings="binary"))


def summed(nodes: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct nodes in order, and the sums of each of the values over them."""
    order = np.argsort(nodes, kind="stable")
    nodes = nodes[order]
    starts = np.flatnonzero(np.concatenate([[True], nodes[1:] != nodes[:-1]]))
    return nodes[starts], *(np.add.reduceat(v[order], starts) for v in values)


def contributions(sorted_rows: DataFrame, size_b: int) -> DataFrame:
    """(base, gained): for each chunk what its documents gain, packed, from rows sorted by part and A id, an id's counts
    (kind 0) before its postings (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = counts = np.zeros(0, np.int64)
        nodes, bases, best, sums, size = [], [], [], [], 0

        def added() -> pa.RecordBatch:
            node, top, total = summed(np.concatenate(nodes), np.concatenate(best), np.concatenate(sums))
            known = np.unique(np.concatenate(bases))
            chunk = known[np.searchsorted(known, node, "right") - 1]  # nodes of a chunk lie between its base and the next
            starts = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]]))
            steps = np.diff(node, prepend=0)
            steps[starts] = node[starts] - chunk[starts]
            data, at = varints(np.stack([steps, top, total], 1).ravel())
            offsets = at[np.concatenate([3 * starts, [3 * len(node)]])].astype(np.int32)
            lists = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
            return pa.RecordBatch.from_arrays([pa.array(chunk[starts]), lists], ["base", "gained"])

        for b in batches:
            if not len(b):
                continue
            code, kind, n = (b.column(i).to_numpy() for i in (0, 1, 2))
            # Counts that came along to several parts are the same in each.
            codes, at = np.unique(np.concatenate([codes, code[kind == 0]]), return_index=True)
            counts = np.concatenate([counts, n[kind == 0]])[at]
            if len(codes):
                a = codes // size_b
                starts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
                top = np.repeat(np.maximum.reduceat(counts, starts), np.diff(np.concatenate([starts, [len(a)]])))
            rows = np.flatnonzero(kind == 1)
            cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(n[rows]) // SLICE)) + 1).tolist(), len(rows)]
            for p, q in zip(cuts, cuts[1:]):
                some = rows[p:q]
                if not len(some):
                    continue
                entries = numbers(np.frombuffer(b"".join(b.column(4).take(pa.array(some)).to_pylist()), np.uint8)).reshape(-1, 2)
                lengths = n[some]
                step, starts = np.cumsum(entries[:, 0]), np.cumsum(lengths) - lengths
                before = np.where(starts > 0, step[starts - 1], 0)
                node = step - np.repeat(before - b.column(3).to_numpy()[some], lengths)
                i = np.searchsorted(codes, code[some])
                count = np.repeat(counts[i], lengths)
                nodes.append(node)
                bases.append(b.column(3).to_numpy()[some])
                sums.append(count * entries[:, 1])
                best.append(np.where(np.repeat(counts[i] == top[i], lengths), entries[:, 1], 0))
                size += len(node)
                if size >= BUFFER:
                    yield added()
                    nodes, bases, best, sums, size = [], [], [], [], 0
            keep = codes // size_b == code[-1] // size_b
            codes, counts = codes[keep], counts[keep]
        if size:
            yield added()

    return sorted_rows.select("code", "kind", "n", "base", "postings").mapInArrow(lean(run), "base long, gained binary")


def by_document(gained: DataFrame) -> DataFrame:
    """node, n_best, count_sum: the packed gains (base, gained) of each chunk added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def total() -> pa.RecordBatch:
            parts = [p.reshape(-1, 3) for p in held]
            node = np.concatenate([now + np.cumsum(p[:, 0]) for p in parts])
            sums = summed(node, *(np.concatenate([p[:, i] for p in parts]) for i in (1, 2)))
            return pa.RecordBatch.from_arrays(list(map(pa.array, sums)), ["node", "n_best", "count_sum"])

        for b in batches:
            for base, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if base != now:
                    if held:
                        yield total()
                    now, held = base, []
                held.append(numbers(np.frombuffer(data, np.uint8)))
        if held:
            yield total()

    dealt = gained.repartition("base").sortWithinPartitions("base")
    return dealt.mapInArrow(lean(run), "node long, n_best long, count_sum long")


def align(docs: DataFrame, tokenizer_path: str, ranks_path: str, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A: a byte-level tokenizer file and its vocabulary as ranks, which encodes a space and the text; B: a piece model, which
    adds the space itself; the strings of special tokens are plain text to both. A group ends where tokens of both
    end; its ids are shown as ``a1,a2|b1`` and groups are joined by ``;``. A link is an A and a B token that overlap,
    n_best the links whose pair is held linked by as many documents as any of its A id, count_sum the sum of those
    numbers over all links.

    A text that is null or empty, or that either tokenizer's bytes do not give back, has no tokens: zeros and an empty
    digest. Null ids and repeated rows are documents like others; an empty table gives an empty result. Only the two
    named columns are read. The files lie at the same places on each worker. A worker holds one document's tokens and
    a chunk's pairs.
    """
    import sentencepiece

    spark = docs.sparkSession
    size_b = sentencepiece.SentencePieceProcessor(model_file=model_path).get_piece_size()
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = written(aligned(given, (tokenizer_path, ranks_path, model_path)), "aligned")
    listed = rows.filter(F.col("code").isNotNull()).select("code", "base", "n", "postings")
    heads = written(listed.groupBy("code").agg(F.sum("n").alias("n")).withColumn("a", F.floor(F.col("code") / size_b)), "counts")
    total = heads.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = heads.groupBy("a").agg(F.sum("n").alias("entries")).filter(F.col("entries") >= max(1, min(total // HOT_SHARE, HOT)))
    entries = hot.agg(F.coalesce(F.sum("entries"), F.lit(0))).first()[0]
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(width, -(-entries // PART))
    hot = F.broadcast(hot.select("a", F.lit(True).alias("hot")))  # ids of A, so no more than its vocabulary
    listed = listed.withColumn("a", F.floor(F.col("code") / size_b)).join(hot, "a", "left").withColumn("hot", F.col("hot").isNotNull())
    listed = listed.withColumn("part", F.when(F.col("hot"), F.pmod(F.xxhash64("base"), F.lit(parts))).otherwise(F.col("a")))
    heads = heads.join(hot, "a", "left").withColumn("hot", F.col("hot").isNotNull())
    to = F.when(F.col("hot"), F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).otherwise(F.array("a"))
    none = [F.lit(0).cast("long").alias("base"), F.lit(None).cast("binary").alias("postings")]
    both = heads.select("hot", F.explode(to).alias("part"), "a", F.lit(0).alias("kind"), "code", "n", *none).unionByName(listed.select("hot", "part", "a", F.lit(1).alias("kind"), "code", "n", "base", "postings"))
    dealt = both.repartition("hot", "part").sortWithinPartitions("hot", "part", "a", "kind", "code")
    sums = by_document(contributions(dealt, size_b))
    stats = rows.filter(F.col("code").isNull()).select("node", "id", "n_a", "n_b", "n_groups", "digest")
    each = stats.join(sums, "node", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_best", "count_sum")})
    return each.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", (F.col("n_a") + F.col("n_b") - F.col("n_groups")).alias("n_links"), "n_best", "count_sum", F.col("digest").alias("groups_sha256"))
