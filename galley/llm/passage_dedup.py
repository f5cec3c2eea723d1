"""Suffix dedup of repeated passages with a run-length index.

Every 50-byte string of a text has an anchor, the 20 bytes in it with the least hash. Equal strings
have equal anchors, so occurrences in different texts meet under the anchor's key. Texts are packed
into parts; what goes between tasks are keys first, and then only the stretches around keys
that several texts hold:

1. parts send 32-bit fingerprints of their keys by bucket; each bucket answers which of them are repeated;
2. parts send the distinct stretches of repeated keys, each with its smallest id; each bucket indexes its
   stretches in a run-compressed transform and streams them through it: a place whose match reaches
   50 bytes in a stretch of a smaller id is marked;
3. parts take the marks and cut the covered bytes out.

Stretches of one key stay together up to a block size; beyond it the key's stretches are indexed in
blocks and all of them are streamed against every block.

Nulls and edge cases: a null text counts as empty. Texts shorter than 50 bytes lose nothing. A text
without an id neither loses bytes nor makes others lose them. Rows with the same id do not make each other
lose bytes. Texts of any length are read whole, and matches never cross texts. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.llm.byte_bpe import ragged
from galley.llm.common import groups, prepare, stored
from galley.llm.run_index import RunIndex
from galley.llm.words import mix, powers, raw

LENGTH = 50
ANCHOR = 20
INDEX_BYTES = 384 << 10  # stretches that are indexed together
PART_ROWS, PART_BYTES = 400, 1_250_000  # texts of a part
BUCKETS_PER_PARTITION = 4
NO_ID = np.iinfo(np.int64).max


class Part:
    """Some whole texts: their bytes, offsets and ids (NO_ID for none)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, ids: np.ndarray):
        self.data, self.offsets, self.ids = data, offsets, ids

    def pack(self) -> bytes:
        head = np.array([len(self.ids)], dtype=np.int64).tobytes()
        return zstandard.ZstdCompressor(level=3).compress(
            head + self.offsets.astype(np.int64).tobytes() + self.ids.astype(np.int64).tobytes() + self.data.tobytes()
        )

    @classmethod
    def unpack(cls, packed: bytes) -> Part:
        body = zstandard.ZstdDecompressor().decompress(packed)
        n = int(np.frombuffer(body[:8], np.int64)[0])
        offsets = np.frombuffer(body, np.int64, n + 1, 8)
        ids = np.frombuffer(body, np.int64, n, 8 * (n + 2))
        return cls(np.frombuffer(body, np.uint8, offset=8 * (2 * n + 2)), offsets, ids)

    def stretches(self):
        """First window, last window, key and content hash of each anchor's stretch, and its text."""
        data, n = self.data, len(self.data)
        windows = LENGTH - ANCHOR + 1
        if n < LENGTH:
            none = np.zeros(0, dtype=np.int64)
            return none, none, none.astype(np.uint64), none.astype(np.uint64), none
        up, down = powers(n)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64, out=total[1:])
        gram = mix((total[ANCHOR:] - total[:-ANCHOR]) * down[: n - ANCHOR + 1])
        # High bits of the hash over the place: the least is the leftmost of equals, and windows of equal
        # bytes choose alike. The minimum over a window by doubling.
        least, width = gram & np.uint64(0xFFFFFFFF00000000) | np.arange(len(gram), dtype=np.uint64), 1
        while width * 2 <= windows:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        shift, count = windows - width, len(gram) - windows + 1
        least = (np.minimum(least[:count], least[shift : shift + count]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        length = np.diff(self.offsets)
        limit = np.where(self.ids == NO_ID, 0, self.offsets[1:] - LENGTH)  # the last window of each text
        start = np.flatnonzero(np.arange(count) <= np.repeat(limit, length)[:count])
        least, row = least[start], np.repeat(np.arange(len(length)), length)[start]
        fresh = np.ones(len(start), dtype=bool)
        fresh[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(fresh)
        last = np.r_[first[1:], len(start)] - 1 if len(first) else first
        low, high, spot, row = start[first], start[last], least[first], row[first]
        key = gram[spot]
        inner = (total[high + LENGTH] - total[low]) * down[low]
        content = mix(inner + mix((spot - low).astype(np.uint64) * np.uint64(64) + (high - low).astype(np.uint64)))
        return low, high, key, content, row


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, k = TaskContext.get().partitionId(), 0
    for batch in batches:
        data, offsets = raw(batch.column("text"))
        ids = batch.column("doc_id").cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays(
            [pa.array([(task << 32) + k]), pa.array([Part(data, offsets, ids).pack()], pa.binary())], names=["home", "packed"]
        )
        k += 1


def _bucketed(key: np.ndarray, buckets: int):
    """The keys' buckets, and for each bucket the places of its keys in the order of the keys."""
    bucket = (key % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((key, bucket))
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    return [(b, order[x:y]) for b, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])) if y > x]


def _known_keys(part: Part):
    """Distinct keys of a part, whether several of its texts hold them, and each stretch's key number."""
    low, high, key, content, row = part.stretches()
    distinct, number = np.unique(key, return_inverse=True)
    ids = part.ids[row]
    least = np.full(len(distinct), NO_ID)
    most = np.full(len(distinct), -1)
    np.minimum.at(least, number, ids)
    np.maximum.at(most, number, ids)
    return (low, high, key, content, row), distinct, number, least != most


def _fingerprints(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for home, packed in zip(batch.column("home").to_pylist(), batch.column("packed").to_pylist()):
                _, distinct, _, several = _known_keys(Part.unpack(packed))
                out = [
                    (b, home, (distinct[at] >> np.uint64(32)).astype(np.uint32).tobytes(), np.packbits(several[at]).tobytes())
                    for b, at in _bucketed(distinct, buckets)
                ]
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))],
                        names=["bucket", "home", "prints", "several"],
                    )

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each part, one bit per key: do several texts hold it?"""
    for table in groups(batches, ["bucket"]):
        prints = [np.frombuffer(p, np.uint32) for p in table.column("prints").to_pylist()]
        several = [np.unpackbits(np.frombuffer(s, np.uint8))[: len(p)].astype(bool) for s, p in zip(table.column("several").to_pylist(), prints)]
        _, number, count = np.unique(np.concatenate(prints), return_inverse=True, return_counts=True)
        # Keys of one part with equal fingerprints only add a candidate.
        hot = count > 1
        np.logical_or.at(hot, number, np.concatenate(several))
        bits = np.split(hot[number], np.cumsum([len(p) for p in prints])[:-1])
        yield pa.RecordBatch.from_arrays(
            [
                table.column("home").combine_chunks(),
                table.column("bucket").combine_chunks(),
                pa.array([np.packbits(b).tobytes() for b in bits], pa.binary()),
            ],
            names=["home", "bucket", "bits"],
        )


def _asked(part: Part, answers: pa.Table, buckets: int):
    """The distinct stretches of repeated keys of a part in the order they are sent, by bucket."""
    (low, high, key, content, row), distinct, number, _ = _known_keys(part)
    bits = dict(zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist()))
    hot = np.zeros(len(distinct), dtype=bool)
    for b, at in _bucketed(distinct, buckets):
        hot[at] = np.unpackbits(np.frombuffer(bits[b], np.uint8))[: len(at)].astype(bool)
    keep = np.flatnonzero(hot[number])
    low, high, key, content, row = low[keep], high[keep], key[keep], content[keep], row[keep]
    identity = mix(key) ^ content
    _, first, back = np.unique(identity, return_index=True, return_inverse=True)
    least = np.full(len(first), NO_ID)
    np.minimum.at(least, back, part.ids[row])
    return low, high, row, first, back, key[first], least, _bucketed(key[first], buckets)


def _send(buckets: int):
    names = ["bucket", "home", "keys", "least", "sizes", "bytes"]

    def run(parts: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for home, packed in zip(parts.column("home").to_pylist(), parts.column("packed").to_pylist()):
            part = Part.unpack(packed)
            low, high, row, first, back, key, least, dealt = _asked(part, answers, buckets)
            pack = zstandard.ZstdCompressor(level=3).compress
            for b, at in dealt:
                begin, size = low[first[at]], high[first[at]] + LENGTH - low[first[at]]
                out.append((b, home, key[at].tobytes(), least[at].tobytes(), size.astype(np.uint8).tobytes(), pack(part.data[ragged(begin, size)].tobytes())))
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, kinds)], names=names)

    return run


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each part and stretch: the smallest id that holds the stretch, and the windows repeated in smaller ones."""
    for table in groups(batches, ["bucket"]):
        unpack = zstandard.ZstdDecompressor().decompress
        keys = [np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()]
        key = np.concatenate(keys)
        least = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("least").to_pylist()])
        size = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("sizes").to_pylist()]).astype(np.int64)
        data = np.concatenate([np.frombuffer(unpack(x), np.uint8) for x in table.column("bytes").to_pylist()])
        begin = np.cumsum(size) - size
        texts = data.tobytes()
        known: dict[tuple[int, bytes], int] = {}
        number = np.array(
            [known.setdefault((k, texts[b : b + n]), len(known)) for k, b, n in zip(key.tolist(), begin.tolist(), size.tolist())]
        )
        head = np.unique(number, return_index=True)[1]
        owner = np.full(len(head), NO_ID)
        np.minimum.at(owner, number, least)
        mask = _windows(data, begin[head], size[head], key[head], owner)
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        yield pa.RecordBatch.from_arrays(
            [
                table.column("home").combine_chunks(),
                table.column("bucket").combine_chunks(),
                pa.array([x.tobytes() for x in np.split(owner[number], cuts)], pa.binary()),
                pa.array([x.tobytes() for x in np.split(mask[number], cuts)], pa.binary()),
            ],
            names=["home", "bucket", "owners", "masks"],
        )


def _windows(data, begin, size, key, owner) -> np.ndarray:
    """Bits of the windows of each stretch that a stretch of a smaller id holds as well."""
    mask = np.zeros(len(key), dtype=np.uint32)
    order = np.argsort(key, kind="stable")
    total = np.cumsum(size[order])
    fresh = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
    key_end = np.r_[fresh[1:], len(order)]
    at = 0
    while at < len(fresh):
        base = total[fresh[at]] - size[order[fresh[at]]]
        stop = int(np.searchsorted(total[key_end - 1], base + INDEX_BYTES, "right"))
        stop = max(stop, at + 1)
        members = order[fresh[at] : key_end[stop - 1]]
        bytes_of = np.cumsum(size[members])
        cuts = np.searchsorted(bytes_of, np.arange(INDEX_BYTES, int(bytes_of[-1]) + INDEX_BYTES, INDEX_BYTES)) + 1
        cuts = np.unique(np.r_[0, np.minimum(cuts, len(members))])
        blocks = [members[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        for indexed in blocks:
            index = RunIndex(data[ragged(begin[indexed], size[indexed])], size[indexed], owner[indexed], LENGTH)
            for streamed in blocks:
                _mark(index, streamed, data, begin, size, owner, mask, streamed is indexed)
        at = stop
    return mask


def _mark(index: RunIndex, streamed, data, begin, size, owner, mask, own: bool) -> None:
    local = np.cumsum(size[streamed]) - size[streamed]
    for lane, place, match, row in index.stream(data[ragged(begin[streamed], size[streamed])], size[streamed], own):
        long = match >= LENGTH
        if long.any():
            lane, place, row = lane[long], place[long], row[long]
            hit = index.least_of(row) < owner[streamed[lane]]
            lane, window = lane[hit], (place - local[lane])[hit]
            mask[streamed[lane]] |= np.uint32(1) << window.astype(np.uint32)


def _cut(buckets: int):
    def run(parts: pa.Table, answers: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        for packed in parts.column("packed").to_pylist():
            part = Part.unpack(packed)
            n = len(part.data)
            change = np.zeros(n + 1, dtype=np.int64)
            if answers.num_rows:
                kinds = answers.column("owners").is_null().to_pylist()
                bits = answers.filter(pa.array(kinds))
                marks = answers.filter(pa.array([not k for k in kinds]))
                low, high, row, first, back, key, _, dealt = _asked(part, bits, buckets)
                given = {b: (o, m) for b, o, m in zip(*(marks.column(c).to_pylist() for c in ("bucket", "owners", "masks")))}
                owner, mask = np.zeros(len(first), np.int64), np.zeros(len(first), np.uint32)
                for b, at in dealt:
                    owner[at], mask[at] = np.frombuffer(given[b][0], np.int64), np.frombuffer(given[b][1], np.uint32)
                whole = part.ids[row] > owner[back]
                change += np.bincount(low[whole], minlength=n + 1) - np.bincount(high[whole] + LENGTH, minlength=n + 1)
                some = np.flatnonzero(~whole & (mask[back] != 0))
                for window in range(LENGTH - ANCHOR + 1):
                    hit = low[some[((mask[back[some]] >> np.uint32(window)) & np.uint32(1)).astype(bool)]] + window
                    np.add.at(change, hit, 1)
                    np.add.at(change, hit + LENGTH, -1)
            gone = np.cumsum(change[:-1]) > 0
            for r, (a, b) in enumerate(zip(part.offsets[:-1].tolist(), part.offsets[1:].tolist())):
                lost = gone[a:b]
                kept = part.data[a:b][~lost].tobytes()
                line = np.flatnonzero(np.diff(np.r_[0, lost.view(np.int8), 0]))
                out[0].append(None if part.ids[r] == NO_ID else int(part.ids[r]))
                out[1].append(b - a)
                out[2].append(int(lost.sum()))
                out[3].append([{"start": int(s), "end": int(e)} for s, e in zip(line[::2], line[1::2])])
                out[4].append(kept)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(out, kinds)], names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept) of every row of (doc_id, text)."""
    spark = docs.sparkSession
    prepare(spark, PART_ROWS, PART_BYTES)
    buckets = buckets or BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = stored(docs.mapInArrow(_pack, "home long, packed binary"), "passage-parts")
    bits = stored(
        parts.mapInArrow(_fingerprints(buckets), "bucket int, home long, prints binary, several binary")
        .repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_repeated, "home long, bucket int, bits binary"),
        "passage-bits",
    )
    sent = (
        parts.groupBy("home")
        .cogroup(bits.withColumnRenamed("home", "to").groupBy("to"))
        .applyInArrow(_send(buckets), "bucket int, home long, keys binary, least binary, sizes binary, bytes binary")
    )
    marks = (
        sent.repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_marks, "home long, bucket int, owners binary, masks binary")
    )
    both = bits.select(F.col("home").alias("to"), "bucket", "bits", F.lit(None).cast("binary").alias("owners"), F.lit(None).cast("binary").alias("masks")).unionByName(
        marks.select(F.col("home").alias("to"), "bucket", F.lit(None).cast("binary").alias("bits"), "owners", "masks")
    )
    out = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"
    return parts.groupBy("home").cogroup(both.groupBy("to")).applyInArrow(_cut(buckets), out)


def op3_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
