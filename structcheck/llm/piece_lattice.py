"""Sampled segmentations over a piece lattice, by forward filtering and backward sampling, and lossless decoding.

A text is spelled with ``▁`` for spaces and one before it. No piece has a ``▁`` after another character, so the lattice
of a text falls apart at each ``▁`` that follows another character, and each part is sampled by itself. A piece weighs
``1 / (rank + 10)`` to the power `sharpness`, its rank being its place in the vocabulary's scores; a character that is
no piece is spelled by its UTF-8 bytes, and so is a literal ``▁``. Forward filtering sums the weights of all
segmentations of each beginning; backward sampling draws the last piece, then the one before it, by those sums. The
draws are hashes of the row's key, the part's number and the step, so that a row's segmentation is the same in any
batch, on any worker, in any order.

Parts of equal length are filtered together as arrays; frequent parts are filtered once a worker.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .common import schema_with

SPACE = "▁"
#: Stands for a literal ``▁`` among the characters, to be spelled in bytes.
LITERAL = 0x110000
K = np.uint64(0x9E3779B97F4A7C15)
SLOT = np.uint64(44)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Pieces:
    """A vocabulary: ids of pieces by the hash of their characters, weights, and the pieces' text."""

    def __init__(self, model_path: str, sharpness: float = 1.0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = sp.get_piece_size()
        self.text: list[bytes] = [b""] * n
        self.byte = np.zeros(256, dtype=np.int64)
        plain = []
        for i in range(n):
            if sp.is_byte(i):
                b = int(sp.id_to_piece(i)[3:5], 16)
                self.byte[b] = i
                self.text[i] = bytes([b])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                piece = sp.id_to_piece(i)
                if SPACE in piece.lstrip(SPACE):
                    raise ValueError("a piece has a space after another character")
                self.text[i] = piece.replace(SPACE, " ").encode()
                plain.append((-sp.get_score(i), i, piece))
        plain.sort()
        self.longest = max(len(p) for _, _, p in plain)
        hashes, ids, weights = [], [], []
        for rank, (_, i, piece) in enumerate(plain):
            h = np.zeros(1, dtype=np.uint64)
            for c in piece:
                h = (h + np.uint64(ord(c) + 1)) * K
            hashes.append(int(h[0]))
            ids.append(i)
            weights.append(-sharpness * np.log(rank + 10.0))
        order = np.argsort(np.array(hashes, dtype=np.uint64))
        self.hashes = np.array(hashes, dtype=np.uint64)[order]
        self.ids = np.array(ids, dtype=np.int64)[order]
        self.weights = np.array(weights)[order]
        slots, first, held = np.unique((self.hashes >> SLOT).astype(np.int64), return_index=True, return_counts=True)
        self.first = np.full(1 << 20, -1, dtype=np.int32)  # by a hash's high bits, the first piece of that slot
        self.first[slots] = first
        self.most = int(held.max())
        self.unknown = -sharpness * np.log(len(plain) + 10.0) * 3

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and weights by piece hash; id -1 and weight -inf where there is none."""
        ids, weights = np.full(h.shape, -1, dtype=np.int32), np.full(h.shape, -np.inf)
        flat_ids, flat_weights, flat = ids.reshape(-1), weights.reshape(-1), h.reshape(-1)
        at = self.first[(flat >> SLOT).astype(np.int64)]
        where = np.flatnonzero(at >= 0)
        at = at[where]
        for _ in range(self.most):
            hit = self.hashes[at] == flat[where]
            flat_ids[where[hit]], flat_weights[where[hit]] = self.ids[at[hit]], self.weights[at[hit]]
            where, at = where[~hit], np.minimum(at[~hit] + 1, len(self.hashes) - 1)
        return ids, weights


class Part(NamedTuple):
    """A filtered set of parts of one length: cumulated chances and ids, by part, end and piece length."""

    chance: np.ndarray
    ids: np.ndarray
    codes: np.ndarray


def filtered(codes: np.ndarray, pieces: Pieces) -> Part:
    """Forward filtering of parts of one length, given as rows of character codes."""
    n, length = codes.shape
    most = min(pieces.longest, length)
    c = codes.astype(np.uint64) + np.uint64(1)
    weight = np.full((n, length + 1, most), -np.inf)
    ids = np.full((n, length + 1, most), -1, dtype=np.int32)
    h = np.zeros((n, length), dtype=np.uint64)
    for l in range(1, most + 1):
        h = (h[:, : length - l + 1] + c[:, l - 1 :]) * K
        found, w = pieces.find(h)
        ids[:, l:, l - 1], weight[:, l:, l - 1] = found, w
    lone = ids[:, 1:, 0] < 0
    weight[:, 1:, 0][lone] = pieces.unknown
    alpha = np.full((n, length + 1), -np.inf)
    alpha[:, 0] = 0.0
    for end in range(1, length + 1):
        m = min(most, end)
        w = alpha[:, end - m : end][:, ::-1] + weight[:, end, :m]
        top = w.max(1, keepdims=True)
        e = np.exp(w - top)
        total = e.sum(1)
        alpha[:, end] = top[:, 0] + np.log(total)
        weight[:, end, :m] = np.cumsum(e, axis=1) / total[:, None]
        weight[:, end, m:] = 1.0
        weight[:, end, m - 1] = 1.0
    return Part(weight, ids, codes)


def spelled(text: str) -> np.ndarray:
    codes = np.frombuffer((SPACE + text).encode("utf-32-le"), dtype="<u4").astype(np.int64)
    literal = codes == ord(SPACE)
    literal[0] = False
    codes[literal] = LITERAL
    codes[codes == 32] = ord(SPACE)
    return codes


def key_hash(key: object, seed: int) -> int:
    data = repr(key).encode()
    return zlib.crc32(data, seed & 0xFFFFFFFF) << 32 | zlib.crc32(data[::-1] + b"/", seed & 0xFFFFFFFF)


class Lattices:
    """Filtered parts that stay between batches, by length: frequent words are filtered once a worker.

    Holds at most `limit` cells (12 bytes each, with the parts' codes); parts beyond that are filtered in each batch
    anew, with the same result.
    """

    def __init__(self, pieces: Pieces, limit: int = 4_000_000):
        self.pieces, self.limit, self.cells = pieces, limit, 0
        self.held: dict[int, tuple[np.ndarray, Part]] = {}

    def blocks(self, rows: np.ndarray, block: int) -> Iterator[tuple[Part, np.ndarray, np.ndarray]]:
        """For parts of one length, given as rows of codes: filtered parts, and which rows they cover at which places."""
        length = rows.shape[1]
        h = np.zeros(len(rows), dtype=np.uint64)
        for j in range(length):
            h = (h + rows[:, j].astype(np.uint64) + np.uint64(1)) * K
        _, at, inverse = np.unique(h, return_index=True, return_inverse=True)
        if not (rows[at][inverse] == rows).all():  # two parts of one hash
            _, at, inverse = np.unique(rows, axis=0, return_index=True, return_inverse=True)
            inverse = inverse.reshape(-1)
        place = np.full(len(at), -1, dtype=np.int64)
        if length in self.held:
            hashes, part = self.held[length]
            found = np.minimum(np.searchsorted(hashes, h[at]), len(hashes) - 1)
            hit = (part.codes[found] == rows[at]).all(1)
            place[hit] = found[hit]
            which = np.flatnonzero(place[inverse] >= 0)
            yield part, place[inverse[which]], which
        fresh = np.flatnonzero(place < 0)
        size = (length + 1) * min(self.pieces.longest, length)
        step = max(1, block // size)
        for lo in range(0, len(fresh), step):
            new = fresh[lo : lo + step]
            part = filtered(rows[at[new]], self.pieces)
            place[new] = np.arange(len(new))
            which = np.flatnonzero(np.isin(inverse, new))
            yield part, place[inverse[which]], which
            self._keep(length, h[at[new]], part, size * len(new))

    def _keep(self, length: int, hashes: np.ndarray, part: Part, cells: int) -> None:
        if self.cells + cells > self.limit:
            return
        self.cells += cells
        if length in self.held:
            before, held = self.held[length]
            hashes = np.concatenate([before, hashes])
            part = Part(*(np.concatenate(x) for x in zip(held, part)))
        order = np.argsort(hashes, kind="stable")
        self.held[length] = hashes[order], Part(*(x[order] for x in part))


def sample_batch(texts: list[str], keys: list, lattices: Lattices, seed: int, block: int = 500_000) -> list[np.ndarray]:
    """The ids of one sampled segmentation of each text."""
    pieces = lattices.pieces
    spelled_ = [spelled(t) if t else np.zeros(0, dtype=np.int64) for t in texts]
    codes = np.concatenate([np.zeros(0, dtype=np.int64), *spelled_])
    ends = np.cumsum([len(s) for s in spelled_])
    first = np.zeros(len(codes), dtype=bool)
    first[1:] = (codes[1:] == ord(SPACE)) & (codes[:-1] != ord(SPACE))
    first[(ends - [len(s) for s in spelled_])[[len(s) > 0 for s in spelled_]]] = True
    starts = np.flatnonzero(first)
    lengths = np.diff(np.append(starts, len(codes)))
    doc = np.searchsorted(ends, starts, side="right")
    begin = np.searchsorted(doc, np.arange(len(texts)))
    base = np.array([key_hash(k, seed) for k in keys], dtype=np.uint64)
    part_seed = mix(base[doc] + K * (np.arange(len(starts)) - begin[doc] + 1).astype(np.uint64))

    order_part, order_step, order_id = [], [], []
    for length in np.unique(lengths):
        of_length = np.flatnonzero(lengths == length)
        for part, row, which in lattices.blocks(codes[starts[of_length][:, None] + np.arange(length)], block):
            occurrence = of_length[which]
            end = np.full(len(row), length, dtype=np.int64)
            n = 0
            while len(row):
                u = (mix(part_seed[occurrence] + np.uint64(int(K) * (n + 1) % 2**64)) >> np.uint64(11)).astype(np.float64) / 2**53
                l = (part.chance[row, end] <= u[:, None]).sum(1)
                ids = part.ids[row, end, l].astype(np.int64)
                lone = ids < 0
                ids[lone] = -1 - part.codes[row[lone], end[lone] - 1]
                order_part.append(occurrence)
                order_step.append(np.full(len(row), n))
                order_id.append(ids)
                end = end - l - 1
                go = end > 0
                row, occurrence, end, n = row[go], occurrence[go], end[go], n + 1
    if not order_part:
        return [np.zeros(0, dtype=np.int64) for _ in texts]
    part_of, step_of, ids = np.concatenate(order_part), np.concatenate(order_step), np.concatenate(order_id)
    per_part = np.bincount(part_of, minlength=len(starts))
    offset = np.concatenate([[0], np.cumsum(per_part)])
    out = np.empty(len(ids), dtype=np.int64)
    out[offset[part_of] + per_part[part_of] - 1 - step_of] = ids
    bounds = offset[np.append(begin, len(starts))]
    return [in_bytes(out[a:b], pieces) for a, b in zip(bounds, bounds[1:])]


def in_bytes(ids: np.ndarray, pieces: Pieces) -> np.ndarray:
    """The ids with each character that is no piece spelled by its bytes."""
    if not (ids < 0).any():
        return ids
    out: list[np.ndarray] = []
    last = 0
    for i in np.flatnonzero(ids < 0):
        code = -1 - int(ids[i])
        char = SPACE if code == LITERAL else " " if code == ord(SPACE) else chr(code)
        out += [ids[last:i], pieces.byte[np.frombuffer(char.encode(), dtype=np.uint8)]]
        last = i + 1
    return np.concatenate([*out, ids[last:]])


def decoded(ids: list[int], pieces: Pieces) -> str:
    return b"".join([pieces.text[i] for i in ids])[1:].decode()


def runs_of(sizes: list[int], most: int = 300_000) -> Iterator[tuple[int, int]]:
    """Bounds of runs of rows whose sizes sum up to `most`, or of a single larger row."""
    at = 0
    while at < len(sizes):
        size, to = sizes[at], at + 1
        while to < len(sizes) and size + sizes[to] <= most:
            size += sizes[to]
            to += 1
        yield at, to
        at = to


def encode_batches(batches: Iterator[pa.RecordBatch], model_path: str, seed: int, sharpness: float, ids_col: str) -> Iterator[pa.RecordBatch]:
    """Batches whose last columns are key and text, with ids for these two; few rows at a time, so memory is bounded."""
    lattices = Lattices(Pieces(model_path, sharpness))
    for b in batches:
        sizes = [n or 0 for n in pc.binary_length(b.column(b.num_columns - 1)).to_pylist()]
        for at, to in runs_of(sizes):
            keys, texts = (b.column(i).slice(at, to - at).to_pylist() for i in (b.num_columns - 2, b.num_columns - 1))
            ids = sample_batch([t or "" for t in texts], keys, lattices, seed)
            ids = [None if t is None else x.astype(np.int32) for t, x in zip(texts, ids)]
            yield pa.RecordBatch.from_arrays([*(c.slice(at, to - at) for c in b.columns[:-2]), pa.array(ids, pa.list_(pa.int32()))], [*b.schema.names[:-2], ids_col])


def decode_batches(batches: Iterator[pa.RecordBatch], model_path: str, text_col: str) -> Iterator[pa.RecordBatch]:
    """Batches whose last column holds ids, with their texts added."""
    pieces = Pieces(model_path)
    for b in batches:
        ids = b.column(b.num_columns - 1)
        for at, to in runs_of([n or 0 for n in pc.list_value_length(ids).to_pylist()]):
            texts = [decoded(x.values.to_numpy(zero_copy_only=False).tolist(), pieces) if x.is_valid else None for x in ids.slice(at, to - at)]
            yield pa.RecordBatch.from_arrays([*(c.slice(at, to - at) for c in b.columns), pa.array(texts, pa.string())], [*b.schema.names, text_col])


def digest_batches(batches: Iterator[pa.RecordBatch], ids_col: str) -> Iterator[pa.RecordBatch]:
    """Batches with n_pieces and ids_crc32 of the ids added."""
    for b in batches:
        ids = b.column(b.schema.get_field_index(ids_col))
        crc = [None if not x.is_valid else zlib.crc32(x.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes()) for x in ids]
        yield pa.RecordBatch.from_arrays([*b.columns, pc.cast(pc.list_value_length(ids), pa.int64()), pa.array(crc, pa.int64())], [*b.schema.names, "n_pieces", "ids_crc32"])


def keyed(docs: DataFrame, dropped: tuple[str, ...], id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The columns of `docs` that stay, and these with key and text behind them."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in dropped]
    return docs.select(*kept), docs.select(*kept, F.col(id_col).alias("__key"), F.col(text_col).alias("__text"))


def encode(docs: DataFrame, model_path: str, seed: int = 0, sharpness: float = 1.0, id_col: str = "doc_id", text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """`docs` without its text, with a sampled segmentation of it as `ids_col`, an array of ids.

    `model_path`: a vocabulary at the same place on each worker. `id_col` seeds the draws: rows of one key and text
    have one segmentation. A null text gives null ids, an empty one an empty array. A column `ids_col` is replaced.
    """
    kept, given = keyed(docs, (text_col, ids_col), id_col, text_col)
    return given.mapInArrow(lambda batches: encode_batches(batches, model_path, seed, sharpness, ids_col), schema_with(kept, **{ids_col: ArrayType(IntegerType())}))


def decode(rows: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """`rows` with the text of `ids_col` as `text_col`; null ids give null, an empty array the empty text."""
    kept = [c for c in rows.columns if c not in (ids_col, text_col)]
    given = rows.select(*[F.col(f"`{c}`") for c in kept], F.col(ids_col))
    return given.mapInArrow(lambda batches: decode_batches(batches, model_path, text_col), schema_with(given, **{text_col: "string"}))


def digest(rows: DataFrame, ids_col: str = "ids") -> DataFrame:
    """`rows` with n_pieces and ids_crc32 (of little-endian unsigned 32-bit ids); both null for null ids."""
    return rows.mapInArrow(lambda batches: digest_batches(batches, ids_col), schema_with(rows, n_pieces="long", ids_crc32="long"))


def round_trip(docs: DataFrame, model_path: str, seed: int = 0, sharpness: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without its text, with n_pieces, ids_crc32 and back_crc32, the CRC-32 of the decoded text in UTF-8.

    It is ``decode(digest(encode(docs)))`` in one pass of one worker a task: ids and decoded texts stay there. All three
    are null for a null text. Columns of these names are replaced.
    """
    kept, given = keyed(docs, (text_col, "n_pieces", "ids_crc32", "back_crc32"), id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded = encode_batches(batches, model_path, seed, sharpness, "__ids")
        for b in decode_batches(last_moved(digest_batches(encoded, "__ids"), "__ids"), model_path, "__back"):
            crc = [None if t is None else zlib.crc32(t.encode()) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(crc, pa.int64())], [*b.schema.names[:-2], "back_crc32"])

    return given.mapInArrow(run, schema_with(kept, n_pieces="long", ids_crc32="long", back_crc32="long"))


def last_moved(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Batches with `column` behind the others."""
    for b in batches:
        names = [n for n in b.schema.names if n != column] + [column]
        yield b.select(names)
