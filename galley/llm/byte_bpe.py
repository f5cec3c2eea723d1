"""Byte-level BPE encoding and decoding with a ready rank file.

A text is cut into pre-tokens by a pattern, each pre-token is merged by rank, and
decoding concatenates the raw bytes of the ids. Long texts are handled by overlapping
chunks: the chunks are pre-tokenised in parallel tasks, each pair of neighbours is
stitched at the first place in their overlap where both have a pre-token boundary
(from there on they agree), and the pieces between stitches are encoded in parallel.
Where an overlap has no such place the chunks stay one piece.

Most texts need no pattern run: between solid characters a blank opens a pre-token and
a line end is one, so in evenly spaced texts each word is cut by itself. Distinct words
are found and merged together with numpy, and a bounded number is remembered by key.

Nulls and edge cases: a null text counts as empty and has no ids. Special tokens are
ordinary text. Texts of any length are encoded whole. Repeated rows, ids included, give
a row each. Empty tables give empty results.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galley.llm.common import prepare
from galley.llm.words import SLICE_BYTES, mix, powers, raw

RANK_FILE = "byte_bpe_multi_50k.tiktoken"
CHUNK, OVERLAP = 65_536, 4_096
CACHE = 1_000_000  # words a worker remembers
ROWS, ROW_BYTES = 400, 1_500_000  # texts encoded together; the decimals of their ids take most memory
LONG_PIECE = 96  # bytes from which the merges use a heap


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: the pair of the lowest rank is merged first, the leftmost of equals."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    if len(piece) > LONG_PIECE:
        return _merge_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    get = ranks.get
    pair = [get(parts[i] + parts[i + 1]) for i in range(len(parts) - 1)]
    while True:
        best, at = None, -1
        for i, rank in enumerate(pair):
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            return [ranks[p] for p in parts]
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del pair[at]
        if at < len(pair):
            pair[at] = get(parts[at] + parts[at + 1])
        if at:
            pair[at - 1] = get(parts[at - 1] + parts[at])


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges over a linked list with a heap of pairs."""
    n = len(piece)
    end = list(range(1, n + 1))  # end of the part that starts at i
    before = list(range(-1, n - 1))
    alive = bytearray(b"\1" * n)
    get = ranks.get
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue
        gone = end[i]
        alive[gone] = 0
        end[i] = stop
        if stop < n:
            before[stop] = i
            rank = get(piece[i : end[stop]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, end[stop]))
        if i:
            left = before[i]
            rank = get(piece[left:stop])
            if rank is not None:
                heapq.heappush(heap, (rank, left, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


NONE = np.int32(2**31 - 1)


class BatchMerger:
    """Merges many short pre-tokens together, a merge of each at a time, with numpy."""

    def __init__(self, ranks: dict[bytes, int]):
        left, right, joined = [], [], []
        get = ranks.get
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = get(token[:cut]), get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    joined.append(rank)
        key = (np.array(left, dtype=np.int64) << 32) | np.array(right, dtype=np.int64)
        order = np.argsort(key)
        self.key = np.r_[key[order], np.int64(2**62)]
        self.joined = np.r_[np.array(joined, dtype=np.int32)[order], NONE]
        self.single = np.array([get(bytes([i]), -1) for i in range(256)], dtype=np.int32)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of neighbours; a negative id has no pair."""
        key = (a.astype(np.int64) << 32) | b.astype(np.int64)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where((self.key[at] == key) & (a >= 0) & (b >= 0), self.joined[at], NONE)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, one after the other, and how many each has."""
        lengths = np.array([len(p) for p in pieces], dtype=np.int64)
        order = np.argsort(lengths, kind="stable")
        parts, counts = [], np.zeros(len(pieces), dtype=np.int64)
        for low in range(0, len(order), 8192):
            part = order[low : low + 8192]
            done, count = self._merge_padded([pieces[i] for i in part], lengths[part])
            counts[part] = count
            parts.append(done[np.arange(done.shape[1]) < count[:, None]])
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        begin = np.zeros(len(pieces), dtype=np.int64)
        begin[order] = np.cumsum(counts[order]) - counts[order]
        return flat[ragged(begin, counts)], counts

    def _merge_padded(self, pieces: list[bytes], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        width = max(int(lengths.max()), 1)
        data = np.zeros((len(pieces), width), dtype=np.uint8)
        data[np.arange(width) < lengths[:, None]] = np.frombuffer(b"".join(pieces), np.uint8)
        ids = np.full((len(pieces), width + 1), -1, dtype=np.int32)
        ids[:, :width] = np.where(np.arange(width) < lengths[:, None], self.single[data], -1)
        pair = self.rank(ids[:, :-1], ids[:, 1:])
        done, counts = np.full_like(ids, -1), lengths.copy()
        rows = np.arange(len(pieces))
        column = np.arange(width + 1)
        while len(rows):
            at = pair.argmin(1)
            best = pair[np.arange(len(at)), at]
            more = best != NONE
            if not more.all():
                done[rows[~more]] = ids[~more]
                ids, pair, rows, at, best = ids[more], pair[more], rows[more], at[more], best[more]
            if not len(rows):
                break
            lane = np.arange(len(at))
            counts[rows] -= 1
            ids[lane, at] = best
            source = np.minimum(column + (column > at[:, None]), width)
            ids = ids[lane[:, None], source]
            ids[:, -1] = -1
            pair = pair[lane[:, None], np.minimum(source[:, :-1], width - 1)]
            pair[:, -1] = NONE
            pair[lane, at] = self.rank(best, ids[lane, at + 1])
            inner = lane[at > 0]
            pair[inner, at[inner] - 1] = self.rank(ids[inner, at[inner] - 1], best[inner])
        return done, counts


def ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Places start .. start + count of each item, one item after the other."""
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(start - (ends - count), count)


# Bytes that may open white space other than a blank or a line end.
_MAYBE = np.zeros(256, dtype=bool)
_MAYBE[[9, 11, 12, 13, 0xC2, 0xE1, 0xE2, 0xE3]] = True
START, BLANK, LINE = 0, 1, 2  # what stands before a word


@dataclass
class Codec:
    """Encodes and decodes with one rank file and one pattern; remembers the words it has met."""

    ranks: dict[bytes, int]
    pattern: str

    def __post_init__(self) -> None:
        self.find = regex.compile(self.pattern).findall
        self.boundaries = lambda text, it=regex.compile(self.pattern).finditer: [m.start() for m in it(text)]
        self.merger = BatchMerger(self.ranks)
        top = max(self.ranks.values(), default=-1) + 1
        lengths = np.zeros(top, dtype=np.int64)
        parts = [b""] * top
        for token, rank in self.ranks.items():
            parts[rank], lengths[rank] = token, len(token)
        self.length = lengths
        self.start = np.cumsum(lengths) - lengths
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)
        digits = [b"%d," % i for i in range(top)] + [b"%d" % i for i in range(top)]  # the last of a text has no comma
        self.digit_length = np.array([len(d) for d in digits], dtype=np.int64)
        self.digit_start = np.cumsum(self.digit_length) - self.digit_length
        self.digits = np.frombuffer(b"".join(digits), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.key = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def _merged(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and id counts of texts, each cut by the pattern."""
        index: dict[str, int] = {}
        number, pieces_of = [], []
        for text in texts:
            pieces = (text,) if text.isascii() and (text.isalpha() or text[:1] == " " and text[1:].isalpha()) else self.find(text)
            number += [index.setdefault(p, len(index)) for p in pieces]
            pieces_of.append(len(pieces))
        pieces = [p.encode() for p in index]
        flats: list = [None] * len(pieces)
        short = []
        for i, data in enumerate(pieces):
            whole = self.ranks.get(data)
            if whole is not None:
                flats[i] = (whole,)
            elif len(data) > LONG_PIECE:
                flats[i] = merge(data, self.ranks)
            else:
                short.append(i)
        flat, count = self.merger.merge([pieces[i] for i in short])
        counts = np.array([0 if f is None else len(f) for f in flats], dtype=np.int64)
        others = np.array([x for f in flats if f is not None for x in f], dtype=np.int32)
        begin = np.zeros(len(pieces), dtype=np.int64)
        known = counts > 0
        begin[known] = np.cumsum(counts[known]) - counts[known] + len(flat)
        counts[short] = count
        begin[short] = np.cumsum(count) - count
        every = np.concatenate([flat, others])
        number = np.array(number, dtype=np.int64)
        ids = every[ragged(begin[number], counts[number])] if len(number) else every
        per_piece = np.r_[0, np.cumsum(counts[number])]
        ends = np.cumsum(pieces_of).astype(np.int64)
        return ids, per_piece[ends] - per_piece[ends - np.array(pieces_of, dtype=np.int64)]

    def _places(self, key: np.ndarray) -> np.ndarray:
        """Where the keys are remembered, -1 where they are not."""
        if not len(self.key):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, at, -1)

    def _slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and id counts of the rows of a slice."""
        n, rows = len(data), len(offsets) - 1
        gap = (data == 32) | (data == 10)
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        odd = self._odd(data)
        odd |= gap & edge[:-1]
        odd |= gap & edge[1:]
        odd[1:] |= gap[1:] & gap[:-1]
        uneven = np.unique(np.searchsorted(offsets, np.flatnonzero(odd), "right") - 1)
        before = np.ones(n, dtype=bool)
        before[1:] = gap[:-1]
        after = np.ones(n, dtype=bool)
        after[:-1] = gap[1:]
        start = np.flatnonzero(~gap & (before | edge[:-1]))
        end = np.flatnonzero(~gap & (after | edge[1:])) + 1
        row = np.searchsorted(offsets, start, "right") - 1
        if len(uneven):
            keep = ~np.isin(row, uneven)
            start, end, row = start[keep], end[keep], row[keep]
        kind = np.where(edge[start], START, np.where(data[start - 1] == 10, LINE, BLANK))
        up, down = powers(n)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64, out=total[1:])
        key = mix(mix((total[end] - total[start]) * down[start]) + kind.astype(np.uint64))
        distinct, first, back = np.unique(key, return_index=True, return_inverse=True)
        place = self._places(distinct)
        fresh = np.flatnonzero(place < 0)
        if len(fresh):
            if len(self.key) + len(fresh) > CACHE:
                self.forget()
                fresh = np.arange(len(distinct))
            raw_bytes = data.tobytes()
            lead = ("", " ", "\n")
            at = first[fresh]
            texts = [
                lead[k] + raw_bytes[a:b].decode()
                for a, b, k in zip(start[at].tolist(), end[at].tolist(), kind[at].tolist())
            ]
            ids, counts = self._merged(texts)
            begin = np.cumsum(counts) - counts + len(self.flat)
            self.flat = np.concatenate([self.flat, ids])
            where = np.searchsorted(self.key, distinct[fresh])
            self.key = np.insert(self.key, where, distinct[fresh])
            self.at = np.insert(self.at, where, begin)
            self.count = np.insert(self.count, where, counts)
            place = self._places(distinct)
        word_at, word_count = self.at[place][back], self.count[place][back]
        ids = self.flat[ragged(word_at, word_count)]
        counts = np.bincount(row, word_count, minlength=rows).astype(np.int64)
        if not len(uneven):
            return ids, counts
        texts = [data[offsets[r] : offsets[r + 1]].tobytes().decode() for r in uneven]
        own, own_counts = self._merged(texts)
        ends = np.cumsum(counts) - counts
        begin = ends.copy()
        begin[uneven] = np.cumsum(own_counts) - own_counts + len(ids)
        counts[uneven] = own_counts
        return np.concatenate([ids, own])[ragged(begin, counts)], counts

    @staticmethod
    def _odd(data: np.ndarray) -> np.ndarray:
        """Where white space other than a blank or a line end begins."""
        out = np.zeros(len(data), dtype=bool)
        for i in np.flatnonzero(_MAYBE[data]).tolist() if _MAYBE[data].any() else ():
            lead = data[i]
            if lead < 128:
                out[i] = True
            else:
                out[i] = data[i : i + 3 - (lead == 0xC2)].tobytes().decode("utf-8", "replace")[:1].isspace()
        return out

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of a column, one text after the other, and how many each has."""
        data, offsets = raw(column)
        n, first = len(offsets) - 1, 0
        parts, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        while first < n:
            last = int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1
            last = min(max(last, first + 1), n)
            ids, count = self._slice(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
            parts.append(ids)
            counts.append(count)
            first = last
        return np.concatenate(parts), np.concatenate(counts)

    def ids_texts(self, column: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The ids of each text in decimals, joined by commas, and how many there are."""
        ids, counts = self.encode_column(column)
        form = ids.astype(np.int64)
        form[np.cumsum(counts)[counts > 0] - 1] += len(self.length)
        length = self.digit_length[form]
        data = self.digits[ragged(self.digit_start[form], length)]
        ends = np.r_[0, np.cumsum(length)]
        offsets = ends[np.r_[0, np.cumsum(counts)]].astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(counts), pa.py_buffer(offsets), pa.py_buffer(data)).cast(pa.string()), counts

    def encode(self, text: str) -> np.ndarray:
        return self.encode_column(pa.array([text], pa.string()))[0]

    def decode(self, ids: np.ndarray) -> bytes:
        """The raw bytes of the ids, one after the other."""
        if not len(ids):
            return b""
        return self.bytes[ragged(self.start[ids], self.length[ids])].tobytes()


_codecs: dict[tuple[str, str], Codec] = {}


def codec(ranks: dict[bytes, int], pattern: str, name: str) -> Codec:
    """The codec of a worker; one rank table is kept."""
    key = (name, pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(ranks, pattern)
    return _codecs[key]


def encode_texts(
    docs: DataFrame,
    ranks: dict[bytes, int],
    pattern: str,
    name: str = RANK_FILE,
    text_col: str = "text",
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
    prefix: str = "",
) -> DataFrame:
    """Adds n_tokens and ids, the ids in decimals joined by commas; all columns stay."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(ranks)  # a rank file has a fixed size
    count, ids = prefix + "n_tokens", prefix + "ids"
    docs = docs.drop(count, ids)
    row, text = "_bpe_row", "_bpe_text"
    docs = docs.withColumn(text, F.coalesce(F.col(text_col), F.lit("")))
    short = docs.where(F.length(text) <= chunk)
    out = short.mapInArrow(
        _encode_batches(shared, pattern, name, text), short.drop(text).withColumn(count, F.lit(0).cast("long")).withColumn(ids, F.lit("")).schema
    )
    # A long text leaves as chunks; its other columns wait under a row number and meet the ids again.
    long = docs.where(F.length(text) > chunk).withColumn(row, F.monotonically_increasing_id())
    pieces = _long_pieces(long.select(row, text), shared, pattern, name, chunk, overlap)
    encoded = (
        pieces.groupBy(row)
        .agg(F.array_sort(F.collect_list(F.struct("run", "ids"))).alias("parts"))
        .select(row, F.array_join(F.col("parts.ids"), ",").alias(ids))
        .withColumn(count, (F.length(ids) - F.length(F.replace(F.col(ids), F.lit(","))) + 1).cast("long"))
    )
    return out.unionByName(long.drop(text).join(encoded, row).drop(row).select(*out.columns))


def _encode_batches(shared, pattern: str, name: str, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(shared.value, pattern, name)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            ids, counts = coder.ids_texts(batch.column(at))
            kept = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in kept], pa.array(counts, pa.int64()), ids],
                names=[*[batch.schema.names[i] for i in kept], "count", "ids"],
            )

    return run


def _long_pieces(long: DataFrame, shared, pattern: str, name: str, chunk: int, overlap: int) -> DataFrame:
    """(row, run, ids) of the stitched pieces of long texts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for k in range(0, len(text), chunk):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row]), pa.array([k // chunk], pa.int32()), pa.array([text[k : k + chunk + overlap]], pa.string())],
                        names=["row", "chunk", "part"],
                    )

    def pretokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Boundaries of a chunk in the two overlaps it shares, counted from the start of the overlap."""
        coder = codec(shared.value, pattern, name)
        for batch in batches:
            head, tail = [], []
            for part in batch.column("part").to_pylist():
                found = coder.boundaries(part)
                head.append([b for b in found if b < overlap])
                # The last pre-token may go on beyond the chunk.
                tail.append([b - chunk for b in found[:-1] if b >= chunk])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(head, pa.list_(pa.int32())), pa.array(tail, pa.list_(pa.int32()))],
                names=[*batch.schema.names, "head", "tail"],
            )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(shared.value, pattern, name)
        for batch in batches:
            ids, _ = coder.ids_texts(batch.column("piece"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), ids], names=["row", "run", "ids"]
            )

    chunks = long.mapInArrow(cut, "_bpe_row long, chunk int, part string").repartition("_bpe_row", "chunk")
    seen = chunks.mapInArrow(
        pretokenise, "_bpe_row long, chunk int, part string, head array<int>, tail array<int>"
    )
    along = Window.partitionBy("_bpe_row").orderBy("chunk")  # the chunks of one text, which was one row
    stitched = (
        seen.withColumn("meet", F.array_min(F.array_intersect("head", F.lag("tail").over(along))))
        .withColumn("meet", F.when(F.col("chunk") == 0, F.lit(0)).otherwise(F.col("meet")))
        .withColumn("next", F.lead("meet").over(along))
        .withColumn("final", F.lead("chunk").over(along).isNull())
        .withColumn("run", F.sum(F.col("meet").isNotNull().cast("int")).over(along))
    )
    # A chunk gives its own characters, and those of the overlap up to the next stitch.
    begin = F.coalesce("meet", F.lit(0))
    stop = F.when(F.col("final"), F.length("part")).when(F.col("next").isNotNull(), chunk + F.col("next")).otherwise(F.lit(chunk))
    pieces = (
        stitched.select("_bpe_row", "run", "chunk", F.substring(F.col("part"), begin + 1, stop - begin).alias("part"))
        .groupBy("_bpe_row", "run")
        .agg(F.array_sort(F.collect_list(F.struct("chunk", "part"))).alias("parts"))
        .select("_bpe_row", "run", F.array_join(F.col("parts.part"), "").alias("piece"))
    )
    return pieces.repartition("_bpe_row", "run").mapInArrow(encode, "_bpe_row long, run long, ids string").where("ids <> ''")


def decode_ids(
    encoded: DataFrame, ranks: dict[bytes, int], pattern: str, name: str = RANK_FILE, ids_col: str = "ids", out_col: str = "decoded"
) -> DataFrame:
    """Adds the raw bytes of the ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)
    encoded = encoded.drop(out_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(shared.value, pattern, name)
        for batch in batches:
            out = [
                coder.decode(np.fromstring(x, dtype=np.int64, sep=",")) if x else b""
                for x in batch.column(ids_col).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, out_col])

    return encoded.mapInArrow(run, encoded.withColumn(out_col, F.lit(b"")).schema)


def given_ranks() -> tuple[dict[bytes, int], str]:
    import public_tokenizers

    return read_ranks(public_tokenizers.path(RANK_FILE)), public_tokenizers.PATTERN


def round_trip(docs: DataFrame, prefix: str = "") -> DataFrame:
    """Adds n_tokens, ids and decoded to the documents, with the given rank file."""
    prepare(docs.sparkSession, ROWS, ROW_BYTES)
    ranks, pattern = given_ranks()
    return decode_ids(encode_texts(docs, ranks, pattern, prefix=prefix), ranks, pattern, ids_col=prefix + "ids", out_col=prefix + "decoded")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return round_trip(docs).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
